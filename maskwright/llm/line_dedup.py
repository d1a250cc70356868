"""Line dedup: explode normalised lines, hash, count documents per hash, drop the repeats, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import ascii_lower, id_and_text, joined_by_key, public_id, written

#: Stripped at both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def dedup_lines(docs: DataFrame, min_docs: int = 2, min_chars: int = 10) -> DataFrame:
    """(doc_id, text, kept_text, n_lines, n_dropped) for each document.

    A line's key is the line stripped of ASCII blanks and lower-cased in A-Z. Keys of min_chars code points or more
    that stand in at least min_docs documents stay only in the smallest doc_id that holds them (all of their lines
    there). Null and empty texts are one empty line. A null doc_id is a document that sorts first; rows that share a
    doc_id count as one document, the one of least text. Texts of any length are split whole; lines of one key in one
    document go or stay together. Extra columns are not read. An empty table gives no rows.

    Keys travel as two 64-bit hashes with their document and position, written once; texts are shuffled once, for
    reassembly. Counts combine on the map side; the join back is joined_by_key(), so no task takes all lines of a key.
    """
    if min_docs < 2:
        raise ValueError("min_docs must be 2 or more")
    base = id_and_text(docs)
    lines = (
        base.select("id", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
        .select("id", "pos", line_key(F.col("line")).alias("key"))
        .filter(F.length("key") >= min_chars)
        .select("id", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), F.col("key")).alias("h2"))
    )
    lines = written(lines, "lines")
    sizes = lines.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n")).filter("first < last")
    if min_docs > 2:
        each = lines.select("h1", "h2", "id").distinct().groupBy("h1", "h2").agg(F.count("*").alias("docs")).filter(F.col("docs") >= min_docs)
        sizes = sizes.join(each, ["h1", "h2"])
    common = written(sizes.select("h1", "h2", "first", "n"), "common-lines")
    repeats = joined_by_key(lines, common, ["h1", "h2"], lines.count()).filter("first <> id")
    drops = repeats.groupBy("id").agg(F.collect_list("pos").alias("drops"))
    split = base.join(drops, "id", "left").withColumn("lines", lines_of(F.col("text")))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drops")), lambda p: F.get(F.col("lines"), p))
    return split.select(
        public_id().alias("doc_id"),
        "text",
        F.when(F.col("drops").isNull(), F.col("text")).otherwise(F.concat_ws("\n", kept)).alias("kept_text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"),
    )
