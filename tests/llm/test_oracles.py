"""Corpus queries with an oracle give DuckDB's rows."""

import os

import duckdb
import pytest

from vellum.llm.queries import ORACLES, QUERIES

DATA = os.environ.get("VELLUM_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{DATA}/documents.parquet')")
    df, want = QUERIES[name](spark, DATA), con.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted(map(tuple, df.select(want.columns).collect())) == sorted(want.fetchall())
