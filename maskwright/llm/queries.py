"""The queries over the training-data operators, with production parameters and whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import table
from maskwright.llm.oracle_sql import ORACLE_SQL  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskwright.llm.fingerprints import fingerprint_neighbours

    return fingerprint_neighbours(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskwright.llm.line_dedup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskwright.llm.language_id import identify

    return identify(table(spark, sf_dir, "documents"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskwright.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskwright.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskwright.llm.pii import listed, personal_data

    out = personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter("spans", _base_of(k))).cast("long").alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    return out.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _base_of(kind: str):
    return lambda s: s["base"] & (s["kind"] == kind)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskwright.llm.licenses import license_scan

    out = license_scan(table(spark, sf_dir, "documents"))
    base = F.array_distinct(F.col("places.label"))
    return out.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.start").alias("first_word"),
        F.array_max("places.start").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.col("blocks.label"))), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("blocks.score"), F.lit(0.0))).alias("score"),
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskwright.llm.decontaminate import contamination

    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    n_items = F.size("items").cast("long")
    return out.select("doc_id", "n_words", "n_hit", n_items.alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (n_items >= 2).alias("contaminated"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskwright.llm.class_lm import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskwright.llm.html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_fingerprints, op2_line_dedup, op3_language_id, op4_near_dedup, op5_packing, op6_pii, op7_license_scan, op8_decontamination, op9_lm_scoring, op10_html_extraction)}
