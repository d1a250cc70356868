"""Best-fit packing: tokenised pieces into sequences of a fixed length, by bulk-synchronous rounds over size classes."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from maskwright.llm.common import even_parts, id_and_text, public_id, text_blocks, written
from maskwright.llm.tokens import CACHE_WORDS

SEQUENCE = 2048
#: Bytes of text that are tokenized at once.
BLOCK = 512 << 10
PIECES = "id long, piece int, start long, length long, ids_crc32 long"
_END = b"\0\0\0\0"


def _cutter(path: str | None, limit: int, cache_words: int):
    def cut(batches):
        from maskwright.llm.tokens import HELD, word_ids

        words = word_ids(path, cache_words)
        for batch, texts in text_blocks(batches, limit=BLOCK, keep=HELD):
            rows = []
            for i, packed in zip(batch.column("id").to_pylist(), words.ids([t.decode("utf-8", "replace") for t in texts])):
                packed += _END
                for k in range(0, len(packed), 4 * limit):
                    part = packed[k : k + 4 * limit]
                    rows.append((i, k // (4 * limit), k // 4, len(part) // 4, zlib.crc32(part)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["id", "piece", "start", "length", "ids_crc32"])

    return cut


def pieces(docs: DataFrame, limit: int = SEQUENCE, tokenizer: str | None = None, cache_words: int = CACHE_WORDS) -> DataFrame:
    """(id, piece, start, length, ids_crc32): each document's ids with id 0 after them, cut at every limit ids."""
    return id_and_text(docs).mapInArrow(_cutter(tokenizer, limit, cache_words), PIECES)


STATE = "kind int, value long, first long, count long, sequence long, offset long"
GAP, PIECE, PLACE = 0, 1, 2


def best_fit(pieces: list[tuple[int, int, int]], gaps: list[tuple[int, int, int]], limit: int = SEQUENCE) -> list[tuple]:
    """Rows of STATE: what becomes of runs of pieces (length, first rank, count) and of gaps (size, first sequence, count).

    Long pieces choose first, each the successor of its length, the smallest gap that holds it; where there are more
    pieces than such gaps the lower ranks take them and the rest go on to the next gap; a gap that was filled is a gap of
    its new size at once. PLACE: length, first rank, count, first sequence, offset. Pieces that no gap holds stay.
    """
    runs: dict[int, list[tuple[int, int]]] = {}
    out: list[tuple] = []
    sizes: list[int] = []

    def add(gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in runs:
                insort(sizes, gap)
            runs.setdefault(gap, []).append((first, count))

    for gap, first, count in sorted(gaps, reverse=True):
        add(gap, first, count)
    for length, rank, count in sorted(pieces, key=lambda p: (-p[0], p[1])):
        while count:
            k = bisect_left(sizes, length)
            if k == len(sizes):
                out.append((PIECE, length, rank, count, 0, 0))
                break
            gap = sizes[k]
            first, held = runs[gap].pop()
            if not runs[gap]:
                del runs[gap]
                sizes.pop(k)
            took = min(held, count)
            out.append((PLACE, length, rank, took, first, limit - gap))
            add(gap - length, first, took)
            add(gap, first + took, held - took)
            rank, count = rank + took, count - took
    return out + [(GAP, gap, first, count, 0, 0) for gap, own in runs.items() for first, count in own]


def _matcher(limit: int):
    def match(rows: pd.DataFrame) -> pd.DataFrame:
        of = lambda kind: [tuple(r) for r in rows.loc[rows["kind"] == kind, ["value", "first", "count"]].itertuples(index=False)]
        return pd.DataFrame(best_fit(of(PIECE), of(GAP), limit), columns=["kind", "value", "first", "count", "sequence", "offset"])

    return match


def places(classes: DataFrame, limit: int = SEQUENCE) -> DataFrame:
    """PLACE rows of STATE for all pieces; classes: (length, count), at most `limit` rows.

    Pieces of one length are a class and take ranks 0, 1, ...; sequences with the same gap are runs of consecutive
    numbers. Pieces of more than half a sequence open one each, for no two fit together. Then rounds: pieces and gaps
    are sorted by size together, which shows each class of pieces its successor, the smallest gap that holds it; the
    pieces that chose one gap meet there, all gaps at once on as many machines, and conflicts are resolved by length and
    rank; gaps get their new sizes, and what is left goes into the next round. Pieces that no gap holds open as many
    sequences as their lengths fill. Rows are runs, so a length that a third of the pieces have is one row; their
    number depends on the limit, not on the input.
    """
    spark = classes.sparkSession
    order = W.orderBy(F.desc("length"))
    opened = F.coalesce(F.sum("count").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    large = classes.filter(F.col("length") > limit // 2).withColumn("sequence", opened)
    row = lambda kind, value, first, sequence: [F.lit(kind).alias("kind"), value.alias("value"), first.cast("long").alias("first"), F.col("count").cast("long").alias("count"), sequence.cast("long").alias("sequence"), F.lit(0).cast("long").alias("offset")]
    none = F.lit(0)
    placed = large.select(*row(PLACE, F.col("length"), none, F.col("sequence")))
    gaps = large.filter(F.col("length") < limit).select(*row(GAP, limit - F.col("length"), F.col("sequence"), none))
    small = classes.filter(F.col("length") <= limit // 2).select(*row(PIECE, F.col("length"), none, none))
    state = written(placed.unionByName(gaps).unionByName(small), "round")
    done, sequences = [state.filter(F.col("kind") == PLACE)], large.agg(F.coalesce(F.sum("count"), none)).first()[0]
    # from large to small, a gap before pieces of its size: the last gap that was seen is the successor
    after = F.min(F.when(F.col("kind") == GAP, F.col("value"))).over(W.orderBy(F.desc("value"), "kind").rowsBetween(W.unboundedPreceding, W.currentRow))
    while True:
        left = state.filter(F.col("kind") != PLACE)
        most = left.agg(F.max(F.when(F.col("kind") == GAP, F.col("value"))).alias("gap"), F.max(F.when(F.col("kind") == PIECE, F.col("value"))).alias("piece")).first()
        if most["piece"] is None:
            break
        if most["piece"] > (most["gap"] or 0):
            over = left.filter((F.col("kind") == PIECE) & (F.col("value") > (most["gap"] or 0))).agg(F.sum(F.col("value") * F.col("count"))).first()[0]
            fresh = -(-over // limit)
            left = left.unionByName(spark.createDataFrame([(GAP, limit, sequences, fresh, 0, 0)], STATE))
            sequences += fresh
        state = written(left.withColumn("gap", after).groupBy("gap").applyInPandas(_matcher(limit), STATE), "round")
        done.append(state.filter(F.col("kind") == PLACE))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _placer(table):
    def place(batches):
        key, shift, first, low, offset = table.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            k = np.searchsorted(key, length * shift + rank, "right") - 1
            names = ["id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(first[k] + rank - low[k]), pa.array(offset[k])], [*names, "sequence_id", "offset"])

    return place


def pack(docs: DataFrame, limit: int = SEQUENCE, tokenizer: str | None = None, cache_words: int = CACHE_WORDS) -> DataFrame:
    """Each piece with the sequence that holds it and its offset there, gapless from 0; see pieces().

    tokenizer: path of the vocabulary file on every machine; by default the public file of the installed package.
    cache_words: words whose ids a Python worker keeps, about 200 bytes each; fewer take more time, the result is the same.
    Null texts are empty: one piece, the end id. A null doc_id stays; rows that share a doc_id count as one document,
    the one of least text. Extra columns are not read. An empty table gives no rows.

    Texts of any length are tokenized whole. What is matched are runs of pieces of one length, see places(); their places
    are broadcast, as their number depends on the limit alone. A piece's rank in its class is its rank in a bucket of its
    (length, hash) plus the counts of the buckets before it, so a length that a third of the pieces have is spread over
    all buckets; ties in length go by bucket, id and piece.
    """
    spark = docs.sparkSession
    buckets = even_parts(spark)
    cut = written(pieces(docs, limit, tokenizer, cache_words), "pieces").withColumn("bucket", F.pmod(F.xxhash64("id", "piece"), F.lit(buckets)))
    counts = cut.groupBy("length", "bucket").count()
    before = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    base = counts.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    classes = cut.groupBy("length").count()
    runs = sorted((r["value"], r["first"], r["sequence"], r["offset"], r["count"]) for r in places(classes, limit).collect())
    runs = np.array(runs, np.int64).reshape(-1, 5)
    shift = int((runs[:, 1] + runs[:, 4]).max(initial=0)) + 1
    table = spark.sparkContext.broadcast((runs[:, 0] * shift + runs[:, 1], shift, runs[:, 2], runs[:, 1], runs[:, 3]))
    own = W.partitionBy("length", "bucket").orderBy("id", "piece")
    ranked = cut.withColumn("__r", F.row_number().over(own) - 1).join(base, ["length", "bucket"])
    ranked = ranked.select("id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("__r")).cast("long").alias("rank"))
    placed = ranked.mapInArrow(_placer(table), f"{PIECES}, sequence_id long, offset long")
    return placed.select(public_id().alias("doc_id"), *placed.columns[1:])
