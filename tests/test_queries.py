"""Every registered query against its SQL counterpart on DuckDB."""

import glob
import math
import os

import duckdb
import pytest

from edascope.queries import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float) and (math.isnan(v) or v == 0):
        return None if math.isnan(v) else 0.0
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    got = QUERIES[name](spark, SF)
    want = con.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).columns
    QUERIES[name](spark, SF).collect()
