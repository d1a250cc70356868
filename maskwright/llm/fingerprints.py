"""I-Match document fingerprints: terms in an inverse-document-frequency band, sorted, hashed under random lexicons."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from maskwright.llm.common import even_parts, id_and_text, public_id, written

#: A term is in the lexicon if its share of the documents lies in this band. The lower end bounds the lexicon:
#: documents that hold m distinct terms on average have at most m / LOW terms that reach it, at any size.
LOW, HIGH = 0.01, 0.2
#: Up to this many terms the lexicon is a set in the plan; above, it is joined by shuffle, with the same result.
SET_TERMS = 50_000
#: A document with fewer terms in the band is known by all its terms: short ones, and groups of copies so large that
#: their terms stand in too many documents.
LEAST_TERMS = 8
#: Each random lexicon keeps one in so many terms, by bits of their hashes: long documents need sparse lexicons.
SPARSITY = (4, 16, 64, 128)
#: First bit of each sparsity's window in the 16 bits that a round of lexicons takes of a term's 128 hash bits.
WINDOW_AT = (0, 2, 6, 9)
ROUNDS = 8


def terms_of(text: Column) -> Column:
    """Distinct terms: lower-cased runs between blanks, tabs and line ends."""
    blank = F.lower(text)
    for sign in ("\n", "\t", "\r"):
        blank = F.replace(blank, F.lit(sign), F.lit(" "))
    return F.array_remove(F.array_distinct(F.split(blank, " ", -1)), "")


def lexicon(texts: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """(term) for the terms whose share of documents is in the band, by counts over all documents."""
    n = texts.count()
    least, most = max(1, math.ceil(low * n)), max(3, math.ceil(high * n))
    counts = texts.select(F.explode(terms_of(F.col("text"))).alias("term")).groupBy("term").count()
    return counts.filter(F.col("count").between(least, most)).select("term")


def hashed(terms: Column, text_hash: Column) -> Column:
    """The fingerprint: for each lexicon the hash of the document's terms in it, or nothing.

    terms: sorted array of (term, h1, h2), a column that is already computed. A document of which no lexicon holds a
    term is known by its text alone.
    """
    parts = []
    for k in range(ROUNDS):
        word, base = ("h1", "h2")[k // 4], 16 * (k % 4)
        for size, at in zip(SPARSITY, WINDOW_AT):
            parts.append(_joined(terms, word, base + at, size - 1))
    short = F.transform(F.array(*parts), lambda s: F.when(s == "", s).otherwise(F.substring(F.md5(s), 1, 12)))
    joined = F.array_join(short, ",")
    return F.when(joined != "," * (len(parts) - 1), joined).otherwise(F.concat(F.lit("t:"), text_hash))


def _joined(terms: Column, word: str, shift: int, mask: int) -> Column:
    drawn = F.filter(terms, lambda x: F.shiftrightunsigned(x[word], shift).bitwiseAND(F.lit(mask).cast("long")) == 0)
    return F.concat_ws(" ", F.transform(drawn, lambda x: x["term"]))


def with_hashes(terms: Column) -> Column:
    return F.transform(F.sort_array(terms), lambda t: F.struct(t.alias("term"), F.xxhash64(t).alias("h1"), F.xxhash64(F.lit(7), t).alias("h2")))


def likeness(a: Column, b: Column) -> Column:
    """Share of lexicons under which both fingerprints have the same hash, of those under which either has one."""
    pairs = F.arrays_zip(F.split(a, ",").alias("a"), F.split(b, ",").alias("b"))
    either = F.size(F.filter(pairs, lambda x: (F.coalesce(x["a"], F.lit("")) != "") | (F.coalesce(x["b"], F.lit("")) != "")))
    both = F.size(F.filter(pairs, lambda x: (x["a"] != "") & (x["a"] == x["b"])))
    return F.when(a == b, F.lit(1.0)).otherwise(F.coalesce(both / F.nullif(either, F.lit(0)), F.lit(0.0))).cast("double")


def ranged(df: DataFrame, parts: int) -> DataFrame:
    """With a column part: the id's place among quantiles of the ids, so that ids in order are parts in order."""
    cuts = df.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)], max(1000, 20 * parts)).alias("c")).first()["c"] if parts > 1 else []
    cuts = sorted(set(cuts or []))
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("id"))) if cuts else F.lit(0)
    return df.withColumn("part", part)


def successors(df: DataFrame, heads: DataFrame, cols: list[str]) -> DataFrame:
    """Adds next_<c>: the column's value in the row of the next id, cyclically.

    df: (part, id, ...) from ranged(); heads: the same rows for the first of each part, (part, id, *cols). Rows of a
    part are shuffled to one task by part, a bounded share of the table; only the heads, one a part, are seen at once.
    """
    firsts = heads.groupBy("part").agg(F.min_by(F.struct(*cols), "id").alias("first"))
    order = W.orderBy("part")
    one = W.partitionBy(F.lit(1))
    parts = firsts.select("part").withColumn("after", F.coalesce(F.lead("part").over(order), F.min("part").over(one)))
    after = parts.join(firsts.withColumnRenamed("part", "after"), "after").select("part", "first")
    own = W.partitionBy("part").orderBy("id")
    led = df.withColumn("__next", F.lead(F.struct(*cols)).over(own)).join(after, "part", "left")
    got = F.coalesce(F.col("__next"), F.col("first"))
    return led.select(*df.columns, *[got[c].alias(f"next_{c}") for c in cols])


def fingerprints(texts: DataFrame, band: DataFrame, keys: list[str], set_terms: int = SET_TERMS) -> DataFrame:
    """(keys, n_chars, text_sha256, fingerprint) of rows (keys, text) with unique keys; band: the lexicon's terms.

    Within set_terms, counted first, each document's terms are filtered in place, without join or shuffle.
    """
    base = texts.select(*keys, F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"), terms_of(F.col("text")).alias("__all"))
    known = [r["term"] for r in band.limit(set_terms + 1).collect()]
    if len(known) <= set_terms:
        own = base.select(*keys, "n_chars", "text_sha256", "__all", F.filter("__all", lambda t: t.isin(known or [""])).alias("__own"))
    else:
        slim = base.select(*[k for k in keys if k in ("part", "id")], F.explode("__all").alias("term"))
        each = slim.join(band, "term").groupBy(*[c for c in slim.columns if c != "term"]).agg(F.collect_list("term").alias("__own"))
        own = base.join(each, [k for k in keys if k in ("part", "id")], "left").withColumn("__own", F.coalesce("__own", F.array().cast("array<string>")))
    ready = own.select(*keys, "n_chars", "text_sha256", with_hashes(F.when(F.size("__own") >= LEAST_TERMS, F.col("__own")).otherwise(F.col("__all"))).alias("__terms"))
    return ready.select(*keys, "n_chars", "text_sha256", hashed(F.col("__terms"), F.col("text_sha256")).alias("fingerprint"))


def fingerprint_neighbours(docs: DataFrame, set_terms: int = SET_TERMS) -> DataFrame:
    """Fingerprints of each document and of its edited text, and their likeness; see the columns of the query.

    The edited text is the text with its last floor(n/4) code points replaced by the first as many (or all) of the
    next document in ascending doc_id, cyclically. Null texts are empty. A null doc_id sorts first; rows that share a
    doc_id count as one document, the one of least text. Extra columns are not read. An empty table gives no rows.

    Texts of any length are read whole. Ties cannot arise: ids are unique here. Document frequencies come from all
    documents. Texts are shuffled once, by quantile of doc_id, a key without hot values; both fingerprints are made in
    the same tasks.
    """
    base = id_and_text(docs)
    terms = written(lexicon(base), "lexicon")
    placed = ranged(base, 4 * even_parts(docs.sparkSession))
    both = successors(placed, placed, ["text"])
    cut = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.length("text") - cut), F.substr("next_text", F.lit(1), cut))
    sides = both.select("part", "id", "text", edited.alias("edited"))
    own = fingerprints(sides, terms, ["part", "id", "edited"], set_terms).drop("text_sha256")
    wide = fingerprints(own.withColumnRenamed("edited", "text").withColumnsRenamed({"n_chars": "n", "fingerprint": "print"}), terms, ["part", "id", "n", "print"], set_terms)
    wide = wide.select("part", "id", F.col("n").alias("n_chars"), F.col("text_sha256").alias("edited_sha256"), F.col("print").alias("fingerprint"), F.col("fingerprint").alias("edited_fingerprint"))
    prints = written(wide, "fingerprints")
    return successors(prints, prints, ["fingerprint"]).select(
        public_id().alias("doc_id"),
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
