"""Every query that has SQL gives the rows that DuckDB gives for it, over the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from maskwright.plans import edge_queries, queries

FOLDER = "/root/testdata/sf0.001"
EVERY = {**queries.QUERIES, **edge_queries.QUERIES}
SQL = {**queries.ORACLE_SQL, **edge_queries.ORACLE_SQL}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(v, 9) if isinstance(v, float) and not math.isnan(v) else v
    return sorted(columns), sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


def test_every_query_has_sql():
    assert set(SQL) == set(EVERY)


@pytest.mark.parametrize("name", sorted(EVERY))
def test_query_and_sql_agree(spark, duck, name):
    got = EVERY[name](spark, FOLDER)
    want = duck.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(columns, want.fetchall())
