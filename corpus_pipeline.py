"""The training-corpus pipeline: five stages over documents, each written before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import id_and_text, row_id, table, unique_rows, written
from maskwright.llm.decontaminate import contamination, without_spans
from maskwright.llm.language_id import UNKNOWN, language_of, learn
from maskwright.llm.line_dedup import dedup_lines
from maskwright.llm.near_dedup import near_classes
from maskwright.llm.packing import pack

#: A language is rejected under this pooled probability; mixed documents of two known languages lie above it.
LEAST_SCORE = 0.35
#: Words that a worker keeps for packing: half of what packing alone takes, as the stages before have grown the executors.
CACHE_WORDS = 500_000


def _packed(docs: DataFrame) -> DataFrame:
    """(id, row): one row for each document, all of its columns in one, so that no name of theirs can clash."""
    return unique_rows(docs).select(row_id().alias("id"), F.struct(*docs.columns).alias("row"))


def _retexted(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """The columns of docs for the documents in texts (id, new), with that text and its length as n_chars."""
    joined = _packed(docs).join(texts, "id")
    made = {"text": F.col("new"), "n_chars": F.length("new").cast("long")}
    return joined.select(*[made.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network knows; rows stay as and where they are, repeated ones too.

    Texts that are null, empty or without a letter are in none and go. An empty table stays empty.
    """
    model = spark.sparkContext.broadcast(learn(docs))
    found = docs.select(F.struct(*docs.columns).alias("row"), language_of(model, F.col("text")).alias("language"))
    return found.filter((F.col("language.lang_pred") != UNKNOWN) & (F.col("language.score") >= LEAST_SCORE)).select("row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document holds; documents that lose all lines stay, empty.

    Of rows that share a doc_id the one of least text stays; rows without one are documents of their own by their text.
    """
    return _retexted(docs, dedup_lines(docs).select(row_id().alias("id"), F.col("kept_text").alias("new")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each class of near copies (without ids: the class's least row_id())."""
    kept = near_classes(id_and_text(docs)).filter(F.col("id") == F.col("class")).select("id")
    return _packed(docs).join(kept, "id", "left_semi").select("row.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with windows of two benchmark items go; of one item, the hit words are cut out of the text."""
    out = contamination(docs, table(spark, sf_dir, "benchmark")).filter(F.size("items") < 2)
    return _retexted(docs, out.select(row_id().alias("id"), without_spans(F.col("text"), F.col("spans")).alias("new")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' pieces and their places in sequences."""
    return pack(docs, cache_words=CACHE_WORDS)


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents table, each result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: A trained network, a tokenizer and likeness over shingles are not SQL. No test covers run() or the stages as yet.
ORACLE_SQL = None
