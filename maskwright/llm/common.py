"""What the training-data operators share: input shaping, shared-folder tables, byte-level text blocks."""

from __future__ import annotations

import contextlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.sources.shared import dropped, released, shared_table  # noqa: F401

#: Words: runs of ASCII letters and digits and of everything outside ASCII, after A-Z is lower-cased.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Inside an operator a row without an id has one of the NULL_IDS lowest numbers, chosen by its text, so that such rows
#: are documents of their own that sort first; ids of data do not lie there.
NULL_ID, NULL_IDS = -(2**63), 2**60


#: Bytes of an Arrow batch, and the setting.
BATCH_BYTES, _BATCH_CONF = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words_of(c: Column) -> Column:
    """The words of a text, in order."""
    return F.regexp_extract_all(ascii_lower(c), F.lit(WORD_PATTERN), F.lit(0))


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of this session have at most BATCH_BYTES, so that what executors and Python workers hold of long
    texts has a bound; Spark's own bound is in rows."""
    if int(spark.conf.get(_BATCH_CONF, "64m").rstrip("bkmgBKMG") or 0) != BATCH_BYTES:
        spark.conf.set(_BATCH_CONF, f"{BATCH_BYTES}b")


def row_id(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The number that a row has inside the operators: its id or, without one, a number by its text."""
    by_text = F.lit(NULL_ID) + F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), 4)
    return F.coalesce(F.col(id_col).cast("long"), by_text)


def unique_rows(df: DataFrame, id_col: str = "doc_id", by: str = "text") -> DataFrame:
    """One row for each id, see row_id(): of rows that share one the least by text, nulls first, stays.

    The test for repeated ids reads ids alone; the texts are moved only if there are any.
    """
    own = F.col(id_col).cast("long")
    if df.groupBy(own.alias("id")).count().filter("count > 1").isEmpty():
        return df
    rest = [c for c in df.columns if c not in (id_col, by)]
    sortable = F.struct(F.col(by), F.to_json(F.struct(*rest)).alias("__rest")) if rest else F.struct(F.col(by))
    whole = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(row_id(id_col, by).alias("__id")).agg(F.min_by(whole, sortable).alias("__row")).select("__row.*")


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) with unique non-null ids and non-null texts; other columns, whatever their names, are left behind."""
    small_batches(df.sparkSession)
    pairs = unique_rows(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    return pairs.select(row_id().alias("id"), F.coalesce("text", F.lit("")).alias("text"))


def without_id(c: str = "id") -> Column:
    return F.col(c) < NULL_ID + NULL_IDS


def public_id(c: str = "id") -> Column:
    return F.when(~without_id(c), F.col(c))


def held_out(share: int) -> Column:
    """Whether crc32 of the id as text (without an id: of the empty text) leaves 1 when divided by share."""
    return F.crc32(F.when(without_id(), F.lit("")).otherwise(F.col("id").cast("string"))) % share == 1


#: Rows of a small table that one task writes, where their number is known to be small before.
TASK_ROWS = 20_000


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """The same rows, read from a table in the shared folder: lineage ends there and survives lost executors.

    rows: a bound on their number, if one is known: a table of few rows is written by few tasks.
    """
    if rows is not None and rows // TASK_ROWS + 1 < even_parts(df.sparkSession):
        df = df.coalesce(rows // TASK_ROWS + 1)
    return shared_table(df, name)


#: A key with more than this part of all rows is joined by broadcast, as many keys at most.
HOT_KEYS = 10_000


def joined_by_key(rows: DataFrame, values: DataFrame, keys: list[str], total: int, parts: int | None = None) -> DataFrame:
    """rows with the columns of values (keys, n, more), where n is the number of rows of a key, total that of all rows.

    Rows of a key with more than one in `parts` of all rows are joined where they lie; the others meet by shuffle, so no
    task takes more of one key than that. Rows without a value go. Both tables are read twice.
    """
    hot = F.col("n") > total / (parts or HOT_KEYS)
    more = [c for c in values.columns if c not in (*keys, "n")]
    often = F.broadcast(values.filter(hot).select(*keys, F.struct(*more).alias("__often")))
    marked = rows.join(often, keys, "left")
    there = marked.filter("__often is not null").select(*rows.columns, "__often.*")
    seldom = marked.filter("__often is null").select(*rows.columns).join(values.filter(~hot).select(*keys, *more), keys)
    return there.unionByName(seldom.select(*there.columns))


def even_parts(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


# ---- byte-level blocks for the Arrow operators -------------------------------------------------

#: Bytes of text that are worked on at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD_BYTE = np.zeros(256, bool)
for _lo, _hi in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
    _WORD_BYTE[_lo : _hi + 1] = True
_TOKEN_BYTE = np.ones(256, bool)
_TOKEN_BYTE[[0x20, *range(0x09, 0x0E)]] = False

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("p")
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        for key, base in (("p", _P), ("i", _P_INV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _powers[key] = np.multiply.accumulate(a)
    return _powers["p"][:n], _powers["i"][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Block:
    """Consecutive texts as one lower-cased byte buffer with the runs (words or tokens) in it.

    starts, ends: byte ranges of the runs; hashes: 64-bit hash of each; doc: index of the text it lies in.
    """

    def __init__(self, texts: list[bytes], kind: np.ndarray = _WORD_BYTE):
        self.raw = np.frombuffer(b"".join(texts), np.uint8)
        self.buf = _LOWER[self.raw]
        self.offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=self.offsets[1:])
        n = len(self.buf)
        inside = kind[self.buf]
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | edge[1:n]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | edge[1:n]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(last) + 1
        pw, inv = powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * pw[:n], out=total[1:])
        self.hashes = mixed((total[self.ends] - total[self.starts]) * inv[self.starts] + (self.ends - self.starts).astype(np.uint64))
        self.doc = np.searchsorted(self.offsets, self.starts, "right") - 1

    def run(self, i: int) -> bytes:
        return self.buf[self.starts[i] : self.ends[i]].tobytes()

    def code_points(self) -> np.ndarray:
        """At each byte position, the code points before it in the whole block."""
        out = np.zeros(len(self.raw) + 1, np.int64)
        np.cumsum((self.raw & 0xC0) != 0x80, out=out[1:])
        return out


def token_block(texts: list[bytes]) -> Block:
    return Block(texts, _TOKEN_BYTE)


def released_memory() -> None:
    """Gives what a Python worker has freed back to the system: it lives on for other operators' tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def ranges_of(sizes, limit: int = BLOCK_BYTES):
    """Ranges [a, b) of texts with at most limit bytes together, or of a single text."""
    a, held = 0, 0
    for b, n in enumerate(sizes):
        if held and held + n > limit:
            yield a, b
            a, held = b, 0
        held += n
    if a < len(sizes):
        yield a, len(sizes)


#: What a Python worker holds between tasks, by name, and how to let it go; an operator's tasks drop what others left.
held_between_tasks: dict = {}


def text_blocks(batches, column: str = "text", limit: int = BLOCK_BYTES, keep: str = ""):
    """(rows, their texts as UTF-8) for ranges of each batch; null is empty. Only one range at a time leaves Arrow.

    keep: the name in held_between_tasks that the caller goes on with.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    others = [name for name in held_between_tasks if name != keep]
    for name in others:
        held_between_tasks.pop(name)()
    if others:
        released_memory()
    try:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
            for a, b in ranges_of(sizes, limit):
                rows = batch.slice(a, b - a)
                own = rows.column(column)
                yield rows, [x or b"" for x in own.cast(pa.large_binary() if pa.types.is_large_string(own.type) else pa.binary()).to_pylist()]
            del batch
    finally:
        released_memory()
