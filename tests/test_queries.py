"""Every query with SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pytest

from codeloom import graph_queries, plan_queries, queries, snapshot_queries, text_queries  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    con = duck.execute(queries.ORACLES[name])
    columns = [d[0] for d in con.description]
    assert sorted(got.columns) == sorted(columns)
    want = con.fetchall()
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(want, key=str) and want
