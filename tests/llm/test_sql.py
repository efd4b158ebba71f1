"""The queries that SQL can express, against DuckDB."""

import time

import duckdb
import pytest

from llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    began = time.time()
    want = con.sql(ORACLE_SQL[name])
    names = sorted(want.columns)
    rows = sorted(tuple(r) for r in con.sql(f"SELECT {', '.join(names)} FROM ({ORACLE_SQL[name]})").fetchall())
    assert time.time() - began < 120
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == names
    assert sorted(tuple(r) for r in got.select(*names).collect()) == rows
