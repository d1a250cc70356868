"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, token windows, verified hits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import Block, id_and_text, mixed, public_id, text_blocks, written

WINDOW = 8
#: Bytes of benchmark text whose windows are broadcast at once, about ten bytes for each; a larger benchmark is scanned
#: in several passes, one job each, so that no machine ever holds more.
BROADCAST_BYTES = 8 << 20
HITS = "id long, n_words long, items array<long>, spans array<struct<start:int,end:int,word:int,words:int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("word", pa.int32()), ("words", pa.int32())]))
_Q = np.uint64(0xD6E8FEB86659FD93)
#: The second, independent hash of a window is this polynomial's; windows of one benchmark are the same if both agree.
_R = np.uint64(0xA24BAED4963EE407)


def gram_hashes(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of each window of n words that lies in one text."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(doc[:count] == doc[n - 1 :])
    total = np.zeros(count, np.uint64)
    for j in range(n):
        total = total * _Q + hashes[j : j + count]
    return at, mixed(total[at])


def _second(hashes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    total = np.zeros(len(at), np.uint64)
    for j in range(n):
        total = total * _R + mixed(hashes[at + j])
    return total


class Windows:
    """The windows of benchmark texts, by length, as flat arrays: sorted hashes, the place of one such window's words in
    the texts for verification, and the items that hold it, by their numbers. Texts without an item (None) have windows too.
    """

    def __init__(self, items: list[tuple[int | None, bytes]], n: int = WINDOW):
        self.block = Block([t for _, t in items])
        self.ids = sorted({i for i, _ in items if i is not None})
        number = {i: k for k, i in enumerate(self.ids)}
        of = np.array([-1 if i is None else number[i] for i, _ in items], np.int64)
        block = self.block
        count = np.bincount(block.doc, minlength=len(items))
        size_of = np.minimum(count, n)
        self.by_length: dict[int, tuple[np.ndarray, ...]] = {}
        for size in sorted({int(s) for s in size_of if s}):
            at, hashes = gram_hashes(block.hashes, block.doc, size)
            own = size_of[block.doc[at]] == size
            at, hashes = at[own], hashes[own]
            second = _second(block.hashes, at, size)
            item = of[block.doc[at]]
            order = np.lexsort((item, second, hashes))
            at, hashes, second, item = at[order], hashes[order], second[order], item[order]
            new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (second[1:] != second[:-1])])
            fresh = (new | np.concatenate([[True], item[1:] != item[:-1]])) & (item >= 0)
            first = np.flatnonzero(new)
            owners = item[fresh].astype(np.int32)
            bounds = np.concatenate([np.cumsum(fresh) - fresh, [len(owners)]])[np.append(first, len(at))]
            seen = np.zeros(1 << 16, bool)
            seen[(hashes >> np.uint64(48)).astype(np.int64)] = True
            self.by_length[size] = (hashes[first], seen, at[first].astype(np.int32), bounds, owners)
        # for verification the words alone are needed
        block.starts, block.ends = block.starts.astype(np.int32), block.ends.astype(np.int32)
        block.raw = block.hashes = block.doc = block.offsets = None

    def scan(self, block: Block) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Which words of the block lie in an occurring window, and the distinct (text, item) of those windows."""
        marks = np.zeros(len(block.starts) + 1, np.int64)
        pairs: set[tuple[int, int]] = set()
        for size, (keys, seen, place, bounds, owners) in self.by_length.items():
            at, hashes = gram_hashes(block.hashes, block.doc, size)
            likely = np.flatnonzero(seen[(hashes >> np.uint64(48)).astype(np.int64)])
            low = np.searchsorted(keys, hashes[likely])
            same = keys[np.minimum(low, len(keys) - 1)] == hashes[likely]
            for i, k in zip(at[likely[same]].tolist(), low[same].tolist()):
                while True:  # several windows may share the first hash
                    if self._verified(block, i, int(place[k]), size):
                        marks[i] += 1
                        marks[i + size] -= 1
                        d = int(block.doc[i])
                        pairs.update((d, self.ids[x]) for x in owners[bounds[k] : bounds[k + 1]].tolist())
                    k += 1
                    if k == len(keys) or keys[k] != keys[k - 1]:
                        break
        return np.cumsum(marks[:-1]) > 0, sorted(pairs)

    def _verified(self, block: Block, i: int, k: int, size: int) -> bool:
        return all(block.run(i + j) == self.block.run(k + j) for j in range(size))


def _scanner(windows, texts_too: bool = False):
    def scan(batches):
        table = windows.value
        for batch, texts in text_blocks(batches):
            block = Block(texts)
            hit, pairs = table.scan(block)
            items: list[list] = [[] for _ in texts]
            for d, item in pairs:
                items[d].append(item)
            places: list[list] = [[] for _ in texts]
            if hit.any():
                points = block.code_points()
                first = np.searchsorted(block.doc, np.arange(len(texts)))
                follows = np.zeros(len(hit), bool)
                follows[1:] = hit[:-1] & (block.doc[1:] == block.doc[:-1])
                goes_on = np.zeros(len(hit), bool)
                goes_on[:-1] = hit[1:] & (block.doc[1:] == block.doc[:-1])
                for i, j in zip(np.flatnonzero(hit & ~follows).tolist(), np.flatnonzero(hit & ~goes_on).tolist()):
                    d = int(block.doc[i])
                    zero = points[block.offsets[d]]
                    places[d].append({"start": int(points[block.starts[i]] - zero), "end": int(points[block.ends[j]] - zero), "word": int(i - first[d]), "words": j - i + 1})
            n_words = np.bincount(block.doc, minlength=len(texts)).astype(np.int64)
            columns, names = [batch.column("id"), pa.array(n_words), pa.array(items, pa.list_(pa.int64())), pa.array(places, _SPANS)], ["id", "n_words", "items", "spans"]
            if texts_too:
                columns, names = [*columns, batch.column("text")], [*names, "text"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return scan


def united(spans: Column) -> Column:
    """Runs of hit words, sorted; runs that share words (found in different passes) become one."""
    none = F.array().cast("array<struct<start:int,end:int,word:int,words:int>>")

    def add(out, x):
        last = F.try_element_at(out, F.lit(-1))
        until = F.greatest(last["word"] + last["words"], x["word"] + x["words"])
        both = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), last["word"].alias("word"), (until - last["word"]).alias("words"))
        joins = F.coalesce(last["word"] + last["words"] > x["word"], F.lit(False))
        return F.when(joins, F.array_append(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), both)).otherwise(F.array_append(out, x))

    return F.aggregate(F.sort_array(spans), none, add)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, text, n_words, n_hit, items, spans): each document's words inside windows of benchmark items.

    A window is `window` consecutive words of an item; an item of fewer words, but not none, is one window. spans:
    runs of hit words as code points [start, end) with the first word and their number. items: ids of the items that
    have an occurring window. Null texts have no words. Rows without a doc_id are documents of their own by their text;
    rows that share a doc_id count as one, the one of least text. All rows of the benchmark count: those that share an
    item_id are one item with the windows of all, and the windows of rows without one hit words of no item. Extra
    columns are not read. An empty benchmark hits nothing; no documents give no rows.

    Documents are scanned where they lie: no shuffle, so copies and frequent passages do not meet in a task. A hit by
    hash is verified word for word. A benchmark over BROADCAST_BYTES, measured first, is scanned in passes that write
    their hits, which then meet by document.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item"), F.col("text").cast("string").alias("text")).filter("text <> ''").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-size // broadcast_bytes))
    base = id_and_text(docs)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["words"])
    found = []
    for k in range(passes):
        own = items.filter(F.pmod(F.xxhash64("text"), F.lit(passes)) == k) if passes > 1 else items
        windows = spark.sparkContext.broadcast(Windows([(r["item"], r["text"].encode("utf-8", "surrogatepass")) for r in own.toLocalIterator()], window))
        if passes == 1:
            out = base.mapInArrow(_scanner(windows, True), f"{HITS}, text string")
            return out.select(public_id().alias("doc_id"), "text", "n_words", n_hit.alias("n_hit"), "items", "spans")
        hits = base.mapInArrow(_scanner(windows), HITS)
        found.append(written(hits.filter("size(spans) > 0") if k else hits, "hits"))
        windows.destroy()
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    own = every.groupBy("id").agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), united(F.flatten(F.collect_list("spans"))).alias("spans"))
    return base.join(own, "id").select(public_id().alias("doc_id"), "text", "n_words", n_hit.alias("n_hit"), "items", "spans")


def without_spans(text: Column, spans: Column) -> Column:
    """The text without the sorted spans; what stands before and after a span is joined by one space."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def cut(state, span):
        part = F.btrim(F.substr(text, state["at"] + 1, span["start"] - state["at"]), F.lit(" "))
        return F.struct(span["end"].alias("at"), F.array_append(state["parts"], part).alias("parts"))

    def rest(state):
        parts = F.array_append(state["parts"], F.btrim(F.substr(text, state["at"] + 1), F.lit(" ")))
        return F.array_join(F.filter(parts, lambda p: p != ""), " ")

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, cut, rest))
