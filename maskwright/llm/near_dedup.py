"""MinHash near-dedup: ProbMinHash over weighted word shingles, banding, exact verification, connected classes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from maskwright.llm.common import Block, dropped, id_and_text, joined_by_key, mixed, public_id, released, text_blocks, written
from maskwright.llm.decontaminate import gram_hashes

SHINGLE, SIMILARITY = 5, 0.8
#: At likeness 0.8 a pair shares none of the bands with probability (1 - 0.8**ROWS)**BANDS = 3e-6.
BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
#: Leaders of a bucket in the first round after the stars, and how many times more in each later one.
LEADERS, GROWTH = 16, 8
#: A document's rarest shared shingles that a row of the prefix filter names, to bound its likeness to others: so many
#: at most, and none of the most frequent that make up this part of its weight.
HEAD, FREQUENT = 64, 0.5
#: Members up to this distance from their leader (and those that may be alike to one) are known by what they differ in
#: from it, the others by their shingles. Such differences leave Arrow by so many at once.
NEAR, DIFFERENCES = 0.5, 1 << 16
#: Bytes of text that are sketched at once, and pairs that leave Arrow at once for their check.
BLOCK, PAIRS = 1 << 20, 256
SKETCH, GRAMS = "id long, k1 long, k2 long, bands array<long>", "id long, grams binary, weights binary"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(block: Block, texts: int, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count) of each distinct shingle, by text and hash; a text of fewer than n words is one shingle."""
    at, hashes = gram_hashes(block.hashes, block.doc, n)
    doc = block.doc[at]
    size = np.bincount(block.doc, minlength=texts)
    first = np.concatenate([[0], np.cumsum(size)])
    short = np.flatnonzero((size > 0) & (size < n))
    if len(short):
        own = np.array([hash_of(block.hashes[first[d] : first[d + 1]]) for d in short.tolist()], np.uint64)
        doc, hashes = np.concatenate([doc, short]), np.concatenate([hashes, own])
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    if not len(doc):
        return doc, hashes, doc
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])]))
    return doc[new], hashes[new], np.diff(np.append(new, len(doc)))


def hash_of(words: np.ndarray) -> np.uint64:
    out = np.array([len(words)], np.uint64)
    for w in words:
        out = mixed(out * _STEP + w)
    return out[0]


def prob_minhash(doc: np.ndarray, hashes: np.ndarray, weights: np.ndarray, texts: int, m: int = REGISTERS) -> np.ndarray:
    """(texts, m) signatures: two texts agree in a register with the probability Jaccard likeness of their weights.

    Every element is a Poisson process of arrivals whose rate is its weight, each arrival at a random register; a
    register keeps the element that arrives first. All elements of the block step to their next arrival together, and
    an element ends when it arrives after the latest first arrival of its text's registers.
    """
    first = np.full(texts * m, np.inf)
    signature = np.zeros(texts * m, np.uint64)
    at, time, step = doc, np.zeros(len(doc)), 0
    h, w = hashes, weights.astype(np.float64)
    while len(h):
        step += 1
        even, odd = (np.uint64(k * int(_STEP) % 2**64) for k in (2 * step, 2 * step + 1))
        draw = mixed(h + even)
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / w
        place = at * m + ((mixed(h + odd) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        early = time < first[place]
        np.minimum.at(first, place[early], time[early])
        won = early & (first[place] == time)
        signature[place[won]] = h[won]
        last = first.reshape(texts, m).max(1)
        on = time < last[at]
        at, time, h, w = at[on], time[on], h[on], w[on]
    return signature.reshape(texts, m)


def band_hashes(signature: np.ndarray) -> np.ndarray:
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(signature), BANDS)).copy()
    for r in range(ROWS):
        out = mixed(out * _STEP + signature[:, r::ROWS][:, :BANDS])
    return out.view(np.int64)


def _shingled(batches):
    """(ids, texts, for each text its sorted shingles and their counts, all of the block's)."""
    for batch, texts in text_blocks(batches, limit=BLOCK):
        doc, hashes, counts = shingles(Block(texts), len(texts))
        cut = np.searchsorted(doc, np.arange(len(texts) + 1))
        own = [(hashes[a:b], counts[a:b]) for a, b in zip(cut[:-1], cut[1:])]
        yield batch.column("id").to_pylist(), texts, own, (doc, hashes, counts)


def _short(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted short hashes of shingles with their counts; shingles that meet in one are one from here on."""
    short = (grams >> np.uint64(32)).astype("<u4")
    if len(short) > 1 and (short[1:] == short[:-1]).any():
        short, where = np.unique(short, return_inverse=True)
        counts = np.bincount(where, counts).astype(np.int64)
    return short, counts


def _weights(counts: np.ndarray) -> bytes | None:
    return counts.astype("<u4").tobytes() if len(counts) and counts.max() > counts.min() else None


def _sketch(batches):
    for ids, texts, own, every in _shingled(batches):
        bands = band_hashes(prob_minhash(*every, len(texts)))
        rows = []
        for i, text, (grams, counts), mine in zip(ids, texts, own, bands):
            key = b"g" + grams.tobytes() + (_weights(counts) or b"") if len(grams) else b"t" + text
            k1, k2 = np.frombuffer(hashlib.blake2b(key, digest_size=16).digest(), np.int64).tolist()
            rows.append((i, k1, k2, mine.tolist() if len(grams) else []))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["id", "k1", "k2", "bands"])


def _grams_of(batches):
    for ids, _, own, _ in _shingled(batches):
        short = [_short(*x) for x in own]
        rows = [(i, grams.tobytes(), _weights(counts)) for i, (grams, counts) in zip(ids, short)]
        kinds = (pa.int64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["id", "grams", "weights"])


def likeness(a: np.ndarray, wa: np.ndarray | None, b: np.ndarray, wb: np.ndarray | None) -> float:
    """Probability Jaccard: sum over shared i of 1 / sum over j of max(a_j / a_i, b_j / b_i). a, b: sorted hashes."""
    if wa is None and wb is None:
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both / max(len(a) + len(b) - both, 1)
    every = np.union1d(a, b)
    x, y = np.zeros(len(every)), np.zeros(len(every))
    np.add.at(x, np.searchsorted(every, a), 1.0 if wa is None else wa)
    np.add.at(y, np.searchsorted(every, b), 1.0 if wb is None else wb)
    with np.errstate(divide="ignore"):
        ratio = x / y
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    start = np.searchsorted(ratio, ratio, "left")
    above = x.sum() - np.concatenate([[0], np.cumsum(x)])[start]
    below = np.concatenate([[0], np.cumsum(y)])[start]
    shared = (x > 0) & (y > 0)
    return float((1 / (above[shared] / x[shared] + below[shared] / y[shared])).sum())


def _verify(batches):
    for batch in (b.slice(k, PAIRS) for b in batches for k in range(0, b.num_rows, PAIRS)):
        out = []
        g = [batch.column(c).to_pylist() for c in ("g1", "w1", "g2", "w2")]
        for a, wa, b, wb in zip(*g):
            out.append(likeness(*[None if x is None else np.frombuffer(x, "<u4") for x in (a, wa, b, wb)]))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.float64())], ["a", "b", "likeness"])


def verified(pairs: DataFrame, sketch: DataFrame) -> DataFrame:
    """(a, b, likeness) of distinct pairs of ids."""
    of = lambda c, k: sketch.select(F.col("id").alias(c), F.col("grams").alias(f"g{k}"), F.col("weights").alias(f"w{k}"))
    whole = pairs.join(of("b", 2), "b").join(of("a", 1), "a")
    return whole.select("a", "b", "g1", "w1", "g2", "w2").mapInArrow(_verify, "a long, b long, likeness double")


def classes(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(id, class) of the ids in links (a, b) and of the known ones: class is the least id that is reached.

    known: the same for links before these. Links between ids of one class are nothing new; the others join classes. In
    each round every node points to its least neighbour, pointers are followed to their ends, by halves, and links are
    drawn between these; so their number falls fast, and rounds grow as its logarithm.
    """
    empty = links.select(F.col("a").alias("id"), F.col("a").alias("class")).limit(0)
    known = empty if known is None else known
    of = lambda rows, c: rows.join(known.select(F.col("id").alias(c), F.col("class").alias("__c")), c, "left").withColumn(c, F.coalesce("__c", c)).drop("__c")
    between = lambda rows, n: written(rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "links", n)
    edges, steps = between(of(of(links.select("a", "b"), "a"), "b"), links.count()), []
    while n := edges.count():
        both = edges.union(edges.select("b", "a"))
        up = written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("up")), "labels", 2 * n)
        while True:
            top = up.select(F.col("id").alias("up"), F.col("up").alias("top"))
            next_ = written(up.join(top, "up").select("id", F.col("top").alias("up"), (F.col("up") != F.col("top")).alias("moved")), "labels", 2 * n)
            dropped(up)
            up = next_.drop("moved")
            up.shared_path = next_.shared_path
            if next_.filter("moved").isEmpty():
                break
        steps.append(up)
        ends = edges.join(up.select(F.col("id").alias("a"), F.col("up").alias("x")), "a").join(up.select(F.col("id").alias("b"), F.col("up").alias("y")), "b")
        last, edges = edges, between(ends.select(F.col("x").alias("a"), F.col("y").alias("b")), n)
        dropped(last)
    if not steps:
        return known
    bound = known.count() + steps[0].count()
    labels = known.unionByName(steps[0].select("id", F.col("id").alias("class")).join(known.select("id"), "id", "left_anti"))
    for step in steps:
        labels = labels.join(step.select(F.col("id").alias("class"), "up"), "class", "left").select("id", F.coalesce("up", "class").alias("class"))
    out = written(labels, "labels", bound)
    dropped(*steps)
    return out


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b", "likeness").union(pairs.select("b", "a", "likeness")).distinct()


def compared(asked: DataFrame, sketch: DataFrame, known: DataFrame | None) -> DataFrame:
    """(a, b, likeness), a < b, of the pairs asked for (two id columns) that are not among the known."""
    one, two = asked.columns
    pairs = asked.select(F.least(one, two).alias("a"), F.greatest(one, two).alias("b")).distinct()
    if known is not None:
        pairs = pairs.join(known.select("a", "b"), ["a", "b"], "left_anti")
    return written(verified(pairs, sketch), "pairs")


def stars(rows: DataFrame, sketch_of, known: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Compares the most central id of each bucket with the bucket's others. rows: (bucket, id);
    sketch_of: the table of sketches for a table of ids.

    An id is as central as its buckets are large in sum: the text that copies were made from shares more with each of
    them than they share with each other. Gives all pairs known now, and (bucket, lead, id, score, d) with each
    member's distance from that leader, the leader left out, and the sketches.
    """
    full = rows.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    shared = written(rows.join(full, "bucket"), "buckets")
    score = shared.groupBy("id").agg(F.sum("n").alias("score"))
    scored = written(shared.select("bucket", "id").join(score, "id"), "buckets")
    lead = scored.groupBy("bucket").agg(F.max_by("id", F.struct("score", -F.col("id"))).alias("lead"))
    bucket = written(scored.join(lead, "bucket").filter("id <> lead"), "buckets")
    dropped(shared, scored)
    sketch = sketch_of(bucket.select("id").union(bucket.select("lead")).distinct())
    released(rows.sparkSession)
    new = compared(bucket.select("lead", "id"), sketch, known)
    found = new if known is None else known.unionByName(new)
    d = both_ways(found).select(F.col("a").alias("lead"), F.col("b").alias("id"), (1 - F.col("likeness")).alias("d"))
    rest = written(bucket.join(d, ["lead", "id"]).select("bucket", "lead", "id", "score", "d"), "rest")
    dropped(bucket)
    return found, rest, sketch


def _grams(batches):
    for batch in batches:
        for i, g, w in zip(*(batch.column(c).to_pylist() for c in ("id", "grams", "weights"))):
            own = np.frombuffer(g, "<u4").astype(np.int64)
            share = np.ones(len(own)) if w is None else np.frombuffer(w, "<u4").astype(float)
            own, where = np.unique(own, return_inverse=True)
            share = np.bincount(where, share) / share.sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), i)), pa.array(own), pa.array(share)], ["id", "gram", "share"])


def prefixes(grams: DataFrame, similarity: float) -> DataFrame:
    """(bucket, id, key, left, alone, least, head): each document's rarest shingles, as many as leave less than `similarity` of
    its weight, but for those that no other document has.

    Alike documents share that much of the weight of each, so the rarest shingle that they share is among these of
    both. A passage that many documents share is frequent and so last in the order: it brings none of them together.
    key: place of the shingle in the order; left: the weight from it on; alone: the weight of the shingles that no other
    document has; least: the least weight of a shingle; head: keys of the document's first shingles in the order that
    other documents have too.
    A bucket whose members all have the same shingle just before it is left out: they all meet in that one's bucket.
    """
    counts = grams.groupBy("gram").agg(F.count("*").alias("n"))
    key = F.shiftleft(F.col("n"), 32).bitwiseOR(F.col("gram"))
    left = grams.join(counts.filter("n > 1"), "gram", "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumn("key", key)
    by_key, own = W.partitionBy("id").orderBy("key"), W.partitionBy("id")
    left = left.withColumn("left", F.sum("share").over(W.partitionBy("id").orderBy(F.desc("key")).rowsBetween(W.unboundedPreceding, W.currentRow)))
    left = left.withColumn("alone", F.coalesce(F.sum(F.when(F.col("n") == 1, F.col("share"))).over(own), F.lit(0.0)))
    left = left.withColumn("least", F.min("share").over(own)).filter((F.col("left") >= min(similarity - 1e-9, FREQUENT)) & (F.col("n") > 1))
    head = F.slice(F.collect_list("key").over(by_key.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), 1, HEAD)
    rows = left.select(F.col("gram").alias("bucket"), "id", "key", "left", "alone", "least", head.alias("head"), F.lag("key").over(by_key).alias("last"))
    rows = written(rows.filter(F.col("left") >= similarity - 1e-9), "prefixes")
    whole = rows.groupBy("bucket").agg(F.min("last").alias("low"), F.max("last").alias("high"), (F.count("last") == F.count("*")).alias("every"))
    inside = whole.filter("every and low = high").select("bucket")
    return rows.drop("last").join(inside, "bucket", "left_anti")


def may_be_alike(similarity: float) -> Column:
    """Whether two members of a bucket can be alike and do not meet in an earlier one. Columns key, left, alone,
    least, head of one, lleft, lalone, lleast, lhead of the other.

    Where they share no shingle before this one, it is the rarest that they share. Then the parts s and t of their
    weights that they share are at most what is left from here on, and their likeness at most 1 / (1/s + 1/t - 1): the
    sum over shared i of 1 / (x + (1 - t) y) with 1/x, 1/y the shares of i, which is concave in these, is at most its
    value for their sums s and t. The heads bound these parts too: up to the lesser of their last keys all shared
    shingles are in both, so what only one of them has there, and what it has alone, is not shared.
    """
    alike = lambda s, t: (s > 0) & (t > 0) & (1 / F.nullif(s, F.lit(0.0)) + 1 / F.nullif(t, F.lit(0.0)) <= 1 / similarity + 1 + 1e-6)
    both = F.array_intersect("head", "lhead")
    upto = F.least(F.element_at("head", -1), F.element_at("lhead", -1))

    def shared(alone: str, least: str, head: str) -> Column:
        lost = F.size(F.filter(head, lambda k: k <= upto)) - F.size(both)
        return 1 - F.col(alone) - lost * F.col(least) + 1e-9

    earlier = F.coalesce(F.get(both, F.lit(0)) < F.col("key"), F.lit(False))
    return alike(F.col("left"), F.col("lleft")) & ~earlier & alike(shared("alone", "least", "head"), shared("lalone", "lleast", "lhead"))


def _differences(batches):
    """(lead, id, key, size): 2 * shingle for those that only id has, of two sets, + 1 for those that only its leader has."""
    names = ["lead", "id", "key", "size"]
    held, total = [], 0
    row = lambda: pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names)
    for batch in batches:
        for lead, i, g, own in zip(*(batch.column(c).to_pylist() for c in ("lead", "id", "g1", "g2"))):
            g, own = np.frombuffer(g, "<u4"), np.frombuffer(own, "<u4")
            new, gone = (np.setdiff1d(x, y, assume_unique=True).astype(np.int64) for x, y in ((own, g), (g, own)))
            key = np.concatenate([2 * new, 2 * gone + 1])
            held.append([np.full(len(key), lead), np.full(len(key), i), key, np.full(len(key), len(own))])
            total += len(key)
            if total > DIFFERENCES:
                yield row()
                held, total = [], 0
    if held:
        yield row()


def differing(groups: DataFrame, sketch: DataFrame, similarity: float) -> DataFrame:
    """(bucket, id, score, before, after, size, ...) of groups (lead, id, ...) of documents without repeated shingles:
    each one's rarest differences from its leader in the order of how many of the group have them.

    The shingles in which two documents of a, b shingles differ are the differences from the leader that only one of
    them has, and alike documents differ in (a + b) (1 - s) / (1 + s) at most, where b is at most a / s. So their first
    common difference has at most a (1 - s) / s others before it in each. Of two that have none in common none is
    unlike the leader. What a whole family has in common cancels out, so it brings none of them together.
    before, after: how many differences come before this one, and from it on; size: number of shingles.
    """
    of = lambda c, k: sketch.select(F.col("id").alias(c), F.col("grams").alias(f"g{k}"))
    whole = groups.select("lead", "id").join(of("id", 2), "id").join(of("lead", 1), "lead").select("lead", "id", "g1", "g2")
    each = written(whole.mapInArrow(_differences, "lead long, id long, key long, size long"), "differences")
    counts = each.groupBy("lead", "key").agg(F.count("*").alias("n")).filter("n > 1")
    own = W.partitionBy("lead", "id")
    rows = each.join(counts, ["lead", "key"], "left").withColumn("n", F.coalesce("n", F.lit(1)))
    rows = rows.withColumn("before", F.row_number().over(own.orderBy("n", "key")) - 1).withColumn("after", F.count("*").over(own) - F.col("before"))
    rows = rows.withColumn("score", F.sum(F.when(F.col("n") > 1, F.col("n"))).over(own))
    rows = rows.filter((F.col("n") > 1) & (F.col("before") * similarity <= F.col("size") * (1 - similarity) + 1e-6))
    out = written(rows.join(groups, ["lead", "id"]).withColumn("bucket", F.xxhash64("lead", "key")).drop("lead", "key", "n"), "prefixes")
    dropped(each)
    return out


def may_differ_little(similarity: float) -> Column:
    """Whether two members of a bucket can be alike, if it is that of their first common difference. Columns before,
    after, size of one, lbefore, lafter, lsize of the other."""
    apart = F.col("before") + F.col("lbefore") + F.abs(F.col("after") - F.col("lafter"))
    return apart * (1 + similarity) <= (F.col("size") + F.col("lsize")) * (1 - similarity) + 1e-6


def classed(rows: DataFrame, labels: DataFrame, c: str, out: str) -> DataFrame:
    """rows with the class of the id in column c as column out."""
    return rows.join(labels.select(F.col("id").alias(c), F.col("class").alias("__c")), c, "left").withColumn(out, F.coalesce("__c", c)).drop("__c")


def links(pairs: DataFrame, similarity: float) -> DataFrame:
    return pairs.filter(F.col("likeness") >= similarity).select("a", "b")


def brought_together(rows: DataFrame, meet: Column, sketch: DataFrame, found: DataFrame, labels: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The pairs known and the classes after all pairs of a bucket are compared that are of different classes, may meet,
    and of which one asks. rows: (bucket, id, score, ask, free, more); meet reads more, of the other member as l<name>;
    free: asks, and is of a class of which no member is compared with the whole bucket yet.

    In each round one member leads for each of some classes, several times more than in the last one, until all classes
    that ask have led. Last, members that never led and are still in different classes are compared.
    """
    own = classed(rows, labels, "id", "class").groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.max("ask").alias("asks"))
    rest = written(rows.join(own.filter("low < high and asks").select("bucket"), "bucket"), "several")
    more = [c for c in rows.columns if c not in ("bucket", "id", "score", "free")]
    other = lambda rows, *c: rows.select("bucket", F.col("id").alias("lead"), *[F.col(x).alias(f"l{x}") for x in (*more, *c)])
    most = rest.count()
    free, led, leaders = written(rest.filter("free"), "free", most), None, LEADERS
    while not free.isEmpty():
        one = W.partitionBy("bucket", "class").orderBy(F.desc("score"), "id")
        some = W.partitionBy("bucket").orderBy(F.desc("score"), "id")
        first = classed(free, labels, "id", "class").withColumn("__n", F.row_number().over(one)).filter("__n = 1")
        lead = written(first.withColumn("__n", F.row_number().over(some)).filter(F.col("__n") <= leaders).drop("__n", "class"), "leaders", most)
        pairs = rest.join(other(lead), "bucket").filter((F.col("id") != F.col("lead")) & meet).select("lead", "id").distinct()
        asked = written(classed(classed(pairs, labels, "lead", "c1"), labels, "id", "c2").filter("c1 <> c2").select("lead", "id"), "asked")
        new = compared(asked, sketch, found)
        found, labels = found.unionByName(new), classes(links(new, similarity), labels)
        led = lead if led is None else led.unionByName(lead)
        done = classed(led.select("bucket", "id"), labels, "id", "class").select("bucket", "class").distinct()
        last, free = free, written(classed(free, labels, "id", "class").join(done, ["bucket", "class"], "left_anti").drop("class"), "free", most)
        dropped(asked, last)
        leaders *= GROWTH
    # members that never led may be linked though they are in different classes
    kept = rest if led is None else rest.join(led.select("bucket", "id"), ["bucket", "id"], "left_anti")
    kept = written(classed(kept, labels, "id", "class"), "covered", most)
    several = kept.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.max("ask").alias("asks")).filter("low < high and asks").select("bucket")
    split = written(kept.join(several, "bucket"), "split", most)
    missed = split.join(other(split.filter("ask"), "class"), "bucket").filter((F.col("class") != F.col("lclass")) & meet).select("lead", "id")
    late = compared(missed, sketch, found)
    return found.unionByName(late), classes(links(late, similarity), labels)


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id): documents linked by chains of pairs with that likeness have the least doc_id of the class.

    Likeness is the probability Jaccard likeness of five-word shingles weighted by their counts (of documents that do
    not repeat shingles: the Jaccard likeness). Documents of the same shingles are one for all that follows; a document of one to four words
    is one shingle, and documents without words (null or empty texts too) are alike only if their texts are equal. A
    null doc_id is an id that sorts first; rows that share a doc_id count as one document, the one of least text.
    Extra columns are not read. An empty table gives no rows.

    In each band bucket the most central id leads: it is compared with all others, so pairs grow with members, not with
    their square. Members unlike their leader, and those that the distances from it (a metric) leave in reach of them,
    are brought together again by an exact filter for the likeness: by the rarest of the shingles in which they differ
    from their leader, as a family shares its leader's; or, where they have little of it or repeat shingles, by their
    rarest shingles, where one leads again. Then leaders are added by rounds, see brought_together(): only pairs of
    different classes are compared that the filter's bounds leave in reach. So no link between classes that shares a
    band bucket is missed. Ties: of equally central ids the least leads. Texts of any length are sketched whole.
    """
    found = near_classes(id_and_text(docs), similarity)
    return found.select(public_id().alias("doc_id"), public_id("class").alias("class_id"))


def near_classes(base: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(id, class) of rows (id, text) from id_and_text(); see near_duplicates()."""
    bands = written(base.mapInArrow(_sketch, SKETCH), "sketch")
    heads = written(bands.groupBy("k1", "k2").agg(F.min("id").alias("head"), F.count("*").alias("n")), "heads")
    keyed = bands.select("id", "k1", "k2")
    members = written(joined_by_key(keyed, heads, ["k1", "k2"], keyed.count()).select("id", "head"), "members")
    dropped(heads)
    own = members.filter("id = head").select("id")
    reach = 1 - similarity + 1e-9
    banded = bands.select("id", F.explode("bands").alias("bucket")).join(own, "id", "left_semi")
    # shingles themselves are taken a second time, from those texts alone that share a bucket
    found, rest, sketch = stars(banded, lambda ids: written(base.join(ids, "id", "left_semi").mapInArrow(_grams_of, GRAMS), "grams"), None)
    dropped(bands)
    labels = classes(links(found, similarity))
    # what a leader leaves open: members of other classes than its own, and those that are near enough to one of them
    plain = F.col("weights").isNotNull()
    groups = classed(classed(rest.select("lead", "id", "d").distinct(), labels, "lead", "own"), labels, "id", "class")
    groups = groups.join(sketch.select("id", plain.alias("repeats")), "id").select("lead", "id", "d", "repeats", (F.col("own") != F.col("class")).alias("other"))
    known = written(groups, "known", rest.count())
    least = known.filter("other").groupBy("lead").agg(F.min("d").alias("least"))
    open_ = written(known.join(least, "lead").filter(F.col("other") | (F.col("d") >= F.col("least") - reach)).drop("least"), "open")
    # far from the leader or with repeated shingles: by shingles, beside all that may be alike to one of these
    asks = F.col("repeats") | (F.col("d") > NEAR + reach)
    least = open_.filter("repeats").groupBy("lead").agg(F.min("d").alias("least"))
    beside = open_.join(least, "lead", "left").filter(asks | (F.col("d") > NEAR) | (F.col("d") >= F.col("least") - reach))
    whole = sketch
    by_shingle = beside.groupBy("id").agg(F.max(asks).alias("asks"))
    by_shingle = written(whole.join(by_shingle, "id"), "open")
    dropped(rest, known)
    grams = written(by_shingle.mapInArrow(_grams, "id long, gram long, share double"), "grams")
    rows = prefixes(grams, similarity).join(by_shingle.select("id", "asks", plain.alias("repeats")), "id")
    rows = written(rows.join(rows.filter("asks").select("bucket").distinct(), "bucket", "left_semi"), "asking")
    found, near, _ = stars(rows.select("bucket", "id"), lambda _: whole, found)
    labels = classes(links(found, similarity), labels)
    rest = classed(classed(near.join(rows, ["bucket", "id"]).withColumn("ask", asks), labels, "lead", "own"), labels, "id", "class")
    rest = written(rest.withColumn("free", F.expr("ask and own <> class")).drop("asks"), "rest")
    dropped(grams, near, rows)
    meet = (F.abs(F.col("d") - F.col("ld")) <= reach) & may_be_alike(similarity)
    alone = rest.select("bucket", "id", "score", "ask", "free", "d", "key", "left", "alone", "least", "head")
    found, labels = brought_together(alone, meet & (F.col("ask") | F.col("lask")), whole, found, labels, similarity)
    # the others by what they differ in from their leaders of both kinds
    groups = open_.select("lead", "id", "d", "repeats").union(rest.select("lead", "id", "d", "repeats")).filter(~asks).distinct()
    groups = classed(classed(groups, labels, "lead", "own"), labels, "id", "class").select("lead", "id", "d", (F.col("own") != F.col("class")).alias("ask"))
    least = groups.filter("ask").groupBy("lead").agg(F.min("d").alias("least"))
    groups = written(groups.join(least, "lead").filter(F.col("ask") | (F.col("d") >= F.col("least") - reach)).select("lead", "id", "ask"), "groups")
    rows = differing(groups, whole, similarity).withColumn("free", F.col("ask"))
    _, labels = brought_together(rows, may_differ_little(similarity), whole, found, labels, similarity)
    return members.join(labels.withColumnRenamed("id", "head"), "head", "left").select("id", F.coalesce("class", "head").alias("class"))
