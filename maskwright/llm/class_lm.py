"""Brown class-based n-grams: exchange clustering of words into classes; class transitions and word emissions."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import dropped, held_out, id_and_text, mixed, public_id, released, released_memory, text_blocks, token_block, written

#: Word classes, and words that the exchange moves one by one, of a small vocabulary; both grow with it.
LEAST_CLASSES, LEAST_OWN = 31, 600
#: Most frequent words whose counts and classes are broadcast; those of the rest are joined by shuffle.
BROADCAST_WORDS = 1 << 18
#: Entries that a task gathers before it hands them on.
GATHERED = 1 << 18
#: Steps of a nat in which contexts are weighed: sums of whole numbers do not depend on their order.
STEPS = 1 << 16


def own_words(distinct: int) -> int:
    """Words that are exchanged one by one: their pairs are no more than the words of the vocabulary."""
    return max(LEAST_OWN, math.isqrt(distinct))


def word_classes(distinct: int) -> int:
    return max(LEAST_CLASSES, int(1.25 * distinct**0.25))


def _summed(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct keys with their rows' sum of the first value and any of the others."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return [keys[first], np.add.reduceat(values[0][order], first) if len(first) else values[0][:0], *[v[order][first] for v in values[1:]]]


def _counted(keys: np.ndarray) -> list[np.ndarray]:
    """Distinct keys and how often each stands there."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return [keys[first], np.diff(np.append(first, len(keys)))]


class Gathered:
    """Sums by key of what a task's blocks add (without values: one for each key); add() and rest() yield
    [keys, sums, *values] to hand on."""

    def __init__(self):
        self.held: list[list[np.ndarray]] = []
        self.size = 0

    def merge(self) -> None:
        self.held = [_summed(*[np.concatenate(x) for x in zip(*self.held)])]
        self.size = len(self.held[0][0])

    def add(self, keys: np.ndarray, *values: np.ndarray):
        if len(keys):
            self.held.append(_summed(keys, *values) if values else _counted(keys))
            self.size += len(self.held[-1][0])
        if self.size > 2 * GATHERED:
            self.merge()
            if self.size > GATHERED:
                yield self.held[0]
                self.held, self.size = [], 0

    def rest(self):
        if self.held:
            self.merge()
            yield self.held[0]


def _blocks(batches):
    """(rows, number of texts, token block) of all texts."""
    for rows, texts in text_blocks(batches):
        yield rows, len(texts), token_block(texts)


def _count(batches):
    words = Gathered()
    row = lambda x: pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1])], ["h", "n"])
    for _, _, block in _blocks(batches):
        yield from map(row, words.add(block.hashes))
    yield from map(row, words.rest())
    del words
    released_memory()


class Vocabulary:
    """Sorted hashes of the broadcast words with their counts, and a number for each: its item, later its class.

    Items are the ranks of the first `own` words, then the end, then all other words as one.
    """

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, own: int):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        # for each value of the first bits, the first word from it on: hashes are spread evenly, so a few lie there
        self.shift = np.uint64(64 - max(1, len(hashes).bit_length()))
        first = np.arange(1 << (64 - int(self.shift)), dtype=np.uint64) << self.shift
        self.first = np.searchsorted(self.hashes, first).astype(np.int32)
        self.end, self.rest = own, own + 1
        self.number = np.where(order < own, order, self.rest)

    def classed(self, of: np.ndarray) -> Vocabulary:
        """The same words with the classes of their items."""
        out = Vocabulary(self.hashes, self.counts, 0)
        out.number, out.end, out.rest = of[self.number], int(of[self.end]), int(of[self.rest])
        return out

    def look(self, block) -> tuple[np.ndarray, np.ndarray]:
        """For each token its count (-1: not among these words) and its number."""
        if not len(self.hashes):
            return np.full(len(block.hashes), -1), np.full(len(block.hashes), self.rest)
        last = len(self.hashes) - 1
        k = np.minimum(self.first[block.hashes >> self.shift], last)
        less = np.flatnonzero(self.hashes[k] < block.hashes)
        while len(less):
            k[less] += 1
            less = less[k[less] < last]
            less = less[self.hashes[k[less]] < block.hashes[less]]
        same = self.hashes[np.minimum(k, last, out=k)] == block.hashes
        return np.where(same, self.counts[k], -1), np.where(same, self.number[k], self.rest)


def sequences(block, numbers: np.ndarray, texts: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The numbers of all texts in a row, an end before the first and after each; the text of each end or word; and
    the place of each token."""
    per = np.bincount(block.doc, minlength=texts)
    ends = np.cumsum(per + 1)
    line = np.full(len(numbers) + texts + 1, end, np.int64)
    at = 1 + np.arange(len(numbers)) + block.doc
    line[at] = numbers
    return line, np.searchsorted(ends, np.arange(len(line) - 1), "right"), at


def _pairs(vocabulary):
    """Counts of item pairs, code = first * items + second."""

    def gather(batches):
        words, pairs = vocabulary.value, Gathered()
        row = lambda x: pa.RecordBatch.from_arrays([pa.array(x[0]), pa.array(x[1])], ["code", "n"])
        for _, texts, block in _blocks(batches):
            line, _, _ = sequences(block, words.look(block)[1], texts, words.end)
            code = line[:-1] * (words.rest + 1) + line[1:]
            yield from map(row, pairs.add(code))
        yield from map(row, pairs.rest())

    return gather


def exchange(codes: np.ndarray, counts: np.ndarray, items: int, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """The class of each item and the counts of class pairs, by the exchange algorithm: each item in turn, frequent
    ones first, moves to the class that raises the likelihood of the class bigrams most, until a sweep moves none.

    codes: first * items + second of the pairs that occur. The last two items, the end and all other words, have the
    last two classes alone.
    """
    h = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)
    sides = []
    for key, other in ((codes // items, codes % items), (codes % items, codes // items)):
        by = np.argsort(key, kind="stable")
        sides.append((np.searchsorted(key[by], np.arange(items + 1)), other[by], counts[by].astype(np.float64)))
    (row_at, row_item, row_n), (col_at, col_item, col_n) = sides
    freq = np.bincount(codes // items, counts, items) + np.bincount(codes % items, counts, items)
    order = np.argsort(-freq, kind="stable")
    order = order[(order < items - 2) & (freq[order] > 0)]
    of = np.zeros(items, np.int64)
    of[order] = np.arange(len(order)) % classes
    of[items - 2], of[items - 1] = classes, classes + 1
    size = classes + 2
    m = np.bincount(of[codes // items] * size + of[codes % items], counts, size * size).reshape(size, size)
    # a gain under what rounding leaves of the sums is none; with it, the sweeps end
    least = 1e-9 + 1e-12 * float(h(m.sum()))
    moved = 1
    while moved:
        moved = 0
        for i in order.tolist():
            a = of[i]
            to, n_to = row_item[row_at[i] : row_at[i + 1]], row_n[row_at[i] : row_at[i + 1]]
            back, n_back = col_item[col_at[i] : col_at[i + 1]], col_n[col_at[i] : col_at[i + 1]]
            own = n_to[to == i].sum()
            out, into = np.bincount(of[to], n_to, size), np.bincount(of[back], n_back, size)
            out[a] -= own
            into[a] -= own
            m[a, :] -= out
            m[:, a] -= into
            m[a, a] -= own
            # gain of class b: its row, its column, their crossing, and the two marginals
            hm = h(m)
            rows, cols = h(m + out[None, :]) - hm, h(m + into[:, None]) - hm
            diagonal = np.diagonal(m)
            gain = rows.sum(1) - np.diagonal(rows) + cols.sum(0) - np.diagonal(cols)
            gain += h(diagonal + out + into + own) - h(diagonal)
            left, right = m.sum(1) + into, m.sum(0) + out
            gain -= h(left + n_to.sum()) - h(left) + h(right + n_back.sum()) - h(right)
            gain[classes:] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + least:
                b = a
            m[b, :] += out
            m[:, b] += into
            m[b, b] += own
            if b != a:
                of[i] = b
                moved += 1
    return of, m


def _neighbours(vocabulary, learned: bool):
    """Rows (id, h, key, n) about the words without a class (learned: of those that are broadcast; else of the others).

    h, key, n: how often the word has a neighbour of a class in training, key = class before, or classes + class after.
    Unless learned also: id, h for each word of a document, and key, n for pairs of classes in training.
    """
    names = ["id", "h", "key", "n"]

    def rows(length, **own):
        kinds = {"id": pa.int64(), "h": pa.int64(), "key": pa.int32(), "n": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array(own[c], kinds[c]) if c in own else pa.nulls(length, kinds[c]) for c in names], names)

    def gather(batches):
        words, near = vocabulary.value, Gathered()
        size = words.rest + 1
        total = np.zeros(size * size, np.int64)
        row = lambda x: rows(len(x[0]), h=x[2].view(np.int64), key=x[3].astype(np.int32), n=x[1])
        for batch, texts, block in _blocks(batches):
            ids, train = batch.column("id").to_numpy(), batch.column("train").to_numpy(zero_copy_only=False)
            count, numbers = words.look(block)
            line, text, at = sequences(block, numbers, texts, words.end)
            open_ = (count >= 0) & (numbers == words.rest) if learned else count < 0
            own = np.flatnonzero(open_ & train[block.doc])
            hs = np.tile(block.hashes[own], 2)
            key = np.concatenate([line[at[own] - 1], size + line[at[own] + 1]])
            mixture = mixed(hs ^ (key.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
            yield from map(row, near.add(mixture, np.ones(len(hs), np.int64), hs, key))
            if not learned:
                code = (line[:-1] * size + line[1:])[train[text]]
                total += np.bincount(code, minlength=size * size)
                rest = np.flatnonzero(open_)
                order = rest[np.argsort(block.hashes[rest])]
                order = order[np.argsort(block.doc[order].astype(np.uint16 if texts <= 1 << 16 else np.int64), kind="stable")]
                d, hs = block.doc[order], block.hashes[order]
                first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (hs[1:] != hs[:-1])])) if len(order) else order
                yield rows(len(first), id=ids[d[first]], h=hs[first].view(np.int64))
        yield from map(row, near.rest())
        del near
        released_memory()
        code = np.flatnonzero(total)
        yield rows(len(code), key=code.astype(np.int32), n=total[code])

    return gather


def context_weights(m: np.ndarray) -> np.ndarray:
    """For each key of a neighbour (class before, then class after) the gain of each word class from one such place."""
    size = len(m)
    smooth = m + 0.5
    before = np.log(smooth / smooth.sum(0, keepdims=True))[:, : size - 2]
    after = np.log(smooth / smooth.sum(1, keepdims=True))[: size - 2].T
    return np.round(np.concatenate([before, after]) * STEPS)


def _assign(weights):
    """The class of each word, from rows (h, key, n) in the order of h."""

    def assign(batches):
        own, held = weights.value, [np.zeros(0, np.int64)] * 3
        row = lambda x: pa.RecordBatch.from_arrays([pa.array(c) for c in x], ["h", "n", "class"])
        for batch in batches:
            held = [np.concatenate([x, batch.column(c).to_numpy().astype(np.int64)]) for x, c in zip(held, ("h", "key", "n"))]
            done = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if done:  # the last word's rows may go on
                yield row(_best(own, *[x[:done] for x in held]))
                held = [x[done:] for x in held]
        if len(held[0]):
            yield row(_best(own, *held))

    return assign


def _best(own: np.ndarray, h: np.ndarray, key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word, its count and the class of greatest gain."""
    new = np.concatenate([[True], h[1:] != h[:-1]])
    row, words = np.cumsum(new) - 1, int(new.sum())
    found = np.bincount(row * len(own) + key, n, words * len(own)).reshape(words, len(own))
    times = found[:, : len(own) // 2].sum(1).astype(np.int64)
    return h[new], times, np.argmax(found @ own, 1).astype(np.int32)


def assigned(near: DataFrame, m: np.ndarray) -> DataFrame:
    """(h, n, class): each word's count and the class whose neighbours are most like its own; near: (h, key, n)."""
    weights = near.sparkSession.sparkContext.broadcast(context_weights(m))
    rows = near.select("h", "key", "n").repartition("h").sortWithinPartitions("h")
    return rows.mapInArrow(_assign(weights), "h long, n long, class int")


class Model:
    """Transition log10 probabilities, for each class the denominator of its emissions, and the class of unseen words."""

    def __init__(self, m: np.ndarray, kinds: np.ndarray, unseen: int, total: int, distinct: int):
        self.transition = np.log10((m + 0.5) / (m.sum(1, keepdims=True) + 0.5 * len(m)))
        self.emission = m.sum(0) + 0.5 * (kinds + 1)
        self.unseen, self.total, self.distinct = unseen, total, distinct


def _known(words: Vocabulary, batch, block, unseen: int) -> tuple[np.ndarray, np.ndarray]:
    """The count and the class of each token; words that are not broadcast stand in the batch's lists."""
    count, kind = words.look(block)
    rest = np.flatnonzero(count < 0)
    count[rest], kind[rest] = 0, unseen
    entries = batch.column("words").flatten()
    if len(entries) and len(rest):
        hs, n, c = (entries.field(i).to_numpy() for i in range(3))
        hs, first = np.unique(hs.view(np.uint64), return_index=True)
        k = np.minimum(np.searchsorted(hs, block.hashes[rest]), len(hs) - 1)
        same = hs[k] == block.hashes[rest]
        count[rest[same]], kind[rest[same]] = n[first[k[same]]], c[first[k[same]]]
    return count, kind


def _transitions(vocabulary):
    def gather(batches):
        words = vocabulary.value
        size = words.end + 1
        total = np.zeros(size * size, np.int64)
        for batch, texts, block in _blocks(batches):
            line, _, _ = sequences(block, _known(words, batch, block, 0)[1], texts, words.end)
            total += np.bincount(line[:-1] * size + line[1:], minlength=size * size)
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], ["code", "n"])

    return gather


def _score(vocabulary, model, ends: int):
    names = ["id", "n_tokens", "n_known", "base_score", "score"]

    def score(batches):
        words, lm = vocabulary.value, model.value
        unit = lm.total + 0.5 * (lm.distinct + 1)
        for batch, texts, block in _blocks(batches):
            count, kind = _known(words, batch, block, lm.unseen)
            line, text, _ = sequences(block, kind, texts, words.end)
            score = np.bincount(text, lm.transition[line[:-1], line[1:]], texts)
            score += np.bincount(block.doc, np.log10((count + 0.5) / lm.emission[kind]), texts)
            score += np.log10((ends + 0.5) / lm.emission[words.end])
            base = np.bincount(block.doc, np.log10((count + 0.5) / unit), texts) + np.log10((ends + 0.5) / unit)
            known = np.bincount(block.doc[count > 0], minlength=texts) + (ends > 0)
            n_tokens = np.bincount(block.doc, minlength=texts) + 1
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n_tokens), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score)], names)

    return score


def _square(rows: pa.Table, size: int, code: str) -> np.ndarray:
    out = np.zeros(size * size)
    out[rows.column(code).to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(size, size)


def most_frequent(counts: DataFrame, limit: int) -> pa.Table:
    """(h, n) of the words above the least power of 2**(1/16) that at most limit words reach.

    Counted by power first: one row for each, and no sort of the words.
    """
    power = F.floor(F.log2("n") * 16).cast("int")
    by = sorted(((r["power"], r["count"]) for r in counts.groupBy(power.alias("power")).count().collect()), reverse=True)
    least, held = 1 << 30, 0
    for p, count in by:
        if held + count > limit:
            break
        least, held = p, held + count
    return counts.filter(power >= least).toArrow()


def score_documents(docs: DataFrame, share: int = 5, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each whole text.

    Tokens are runs between ASCII blanks, lower-cased in A-Z, and one end. The model learns from documents that are
    not held out. Every word belongs to a class: the own_words() most frequent words are exchanged one by one, until
    none moves; each other word goes to the class whose neighbours are most like its own. First the words that are
    broadcast do so, beside the exchanged words; then the rest, beside all of these. A word that training has not
    seen is of the class with most words seen once. score: sum over tokens of log10 P(class | class before) +
    log10 P(token | class), both with half a count added, with one unseen word in each class. Null texts are empty:
    one end. A null doc_id is the text '' for the split; rows that share a doc_id count as one document, the one of
    least text. Extra columns are not read. An empty table gives no rows; without training documents every probability
    is the smoothed one.

    All words of the training documents are counted; tasks add up before the shuffle. The driver clusters a number of
    words that grows with the root of the vocabulary. Neighbours are counted by shuffle; counts and classes of words
    that are not broadcast are joined by shuffle with each document's words and then, by id, with its text.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast
    base = id_and_text(docs).withColumn("train", ~held_out(share))
    train = base.filter("train")
    counts = written(train.mapInArrow(_count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "word-counts")
    ends = train.count()
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, distinct = whole["n"] + ends, whole["v"] + (ends > 0)
    top = most_frequent(counts, broadcast_words).sort_by([("n", "descending"), ("h", "ascending")])
    dropped(counts)
    classes, own = word_classes(whole["v"]), min(own_words(whole["v"]), len(top))
    words = Vocabulary(top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy(), own)
    pairs = train.mapInArrow(_pairs(shared(words)), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    of, m = exchange(pairs.column("code").to_numpy(), pairs.column("n").to_numpy(), own + 2, classes)

    words = words.classed(of)
    near = "id long, h long, key int, n long"
    found = assigned(train.mapInArrow(_neighbours(shared(words), True), near).filter("h is not null").select("h", "key", "n"), m).toArrow()
    words.number[np.searchsorted(words.hashes, found.column("h").to_numpy().view(np.uint64))] = found.column("class").to_numpy()
    vocabulary = shared(words)
    rows = written(base.mapInArrow(_neighbours(vocabulary, False), near), "neighbours")
    beside = rows.filter("h is null").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    rare = written(assigned(rows.filter("id is null and h is not null").select("h", "key", "n"), _square(beside, classes + 2, "key")), "rare-words")

    kinds, once = np.bincount(words.number, minlength=classes + 1), np.bincount(words.number[words.counts == 1], minlength=classes + 1)
    for r in rare.groupBy("class").agg(F.count("*").alias("kinds"), F.count(F.when(F.col("n") == 1, 1)).alias("once")).collect():
        kinds[r["class"]] += r["kinds"]
        once[r["class"]] += r["once"]
    kinds[classes] = ends > 0
    lists = rows.filter("id is not null").select("id", "h").join(rare, "h").groupBy("id").agg(F.collect_list(F.struct("h", "n", "class")).alias("words"))
    lists = written(lists, "words")
    dropped(rows, rare)
    # texts meet their words by shuffle in each of the two passes that are left, and are not written beside them
    classed = base.join(lists, "id", "left").withColumn("words", F.coalesce("words", F.array().cast("array<struct<h:long,n:long,class:int>>")))
    steps = classed.filter("train").mapInArrow(_transitions(vocabulary), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    released(spark)
    model = Model(_square(steps, classes + 1, "code"), kinds, int(np.argmax(once[:classes])), total, distinct)
    out = classed.mapInArrow(_score(vocabulary, shared(model), ends), "id long, n_tokens long, n_known long, base_score double, score double")
    return out.select(public_id().alias("doc_id"), held_out(share).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
