"""What findings are made from is written once in the plan, however many projections stand on it."""

import pytest

from maskwright.config import Engine
from maskwright.plans import queries

FOLDER = "/root/testdata/sf0.001"
RULES = {**{name: 1 for name in queries._FINDERS}, "resolve_overlaps": 2, "entity_report": sum(1 + bool(r.group) for _, r in Engine().plan())}


def written(df, name):
    df.sparkSession.conf.set("spark.sql.debug.maxToStringFields", "1000")
    return df._jdf.queryExecution().optimizedPlan().toString().count(name + "(")


@pytest.mark.parametrize("name", sorted(RULES))
def test_each_pattern_is_looked_for_once(spark, name):
    assert written(queries.QUERIES[name](spark, FOLDER), "regexp_extract_all") == RULES[name]


def test_a_mapping_writes_its_events_once(spark):
    assert written(queries.mapping_table(spark, FOLDER), "filter") == 1


def test_bodies_are_dealt_before_they_are_read(spark, monkeypatch):
    from maskwright.operators import transport

    read = {}
    monkeypatch.setattr(transport, "shared_table", lambda df, name, keep=transport.shared_table: read.setdefault(name, df) and keep(df, name))
    rows = spark.range(3).selectExpr("id as request_id", "'POST' as method", "200 as status", "array(named_struct('name', 'Content-Type', 'value', 'application/json')) as headers", "encode('{}', 'UTF-8') as body")
    transport.mask_requests(rows)
    transport.restore_responses(rows, spark.createDataFrame([], "request_id long, placeholder string, plaintext string"))
    for name in ("requests", "responses"):
        plan = read[name]._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("ArrowEvalPython") < plan.index("RepartitionByExpression [request_id")
