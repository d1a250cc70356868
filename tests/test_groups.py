"""Groups in Python: whole and in order wherever Arrow batches end, and without a call for each of them."""

from pyspark.sql import functions as F

from maskwright.sources.groups import by_group
from maskwright.streaming.event_stream import restore_event_chunks
from maskwright.streaming.stream import restore_chunks


def test_groups_are_whole_across_batches(spark):
    rows = spark.range(200).select(F.when(F.col("id") % 7 != 0, F.concat(F.lit("k"), F.col("id") % 7)).alias("k"), (-F.col("id")).alias("o"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        out = by_group(rows, "k", "o", lambda k, own: [(k, [o for _, o in own])], "k string, os array<long>").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {r.k: list(r.os) for r in out} == {f"k{i}" if i else None: sorted(-n for n in range(200) if n % 7 == i) for i in range(7)}
    assert len(out) == 7


def test_no_call_for_each_stream(spark):
    columns = "cast(id as string) as stream_id", "id % 2 as chunk_no", "encode('[A_1]', 'UTF-8') as chunk", "true as is_eof", "map('[A_1]', 'x') as mapping"
    chunks = spark.range(10).selectExpr(*columns)
    for out in (restore_chunks(chunks), restore_event_chunks(chunks)):
        assert "FlatMapGroups" not in out._jdf.queryExecution().optimizedPlan().toString()
        assert out.select("stream_id").distinct().count() == 10


def test_rows_of_a_stream_give_one_mapping(spark):
    rows = [("s", 1, b"B_1] [C_1]", True, {"[B_1]": "y"}), ("s", 0, b"[A_1] [", False, {"[A_1]": "x", "[B_1]": "w"}), ("t", 0, b"[A_1]", True, None), (None, 0, b"[A_1]", True, {"[A_1]": "z"})]
    chunks = spark.createDataFrame(rows, "stream_id string, chunk_no long, chunk binary, is_eof boolean, mapping map<string,string>")
    out = restore_chunks(chunks).collect()
    assert {(r.stream_id, r.chunk_no): r.text for r in out} == {("s", 0): "x ", ("s", 1): "y [C_1]", ("t", 0): "[A_1]", (None, 0): "z"}
