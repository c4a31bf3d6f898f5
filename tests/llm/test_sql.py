"""Queries with SQL, against DuckDB."""

import duckdb
import pytest

from thicket.llm.queries import QUERIES, SQL

D = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from read_parquet('{D}/{t}.parquet')")
    rel = con.sql(SQL[name])
    df = QUERIES[name](spark, D)
    assert sorted(df.columns) == sorted(rel.columns)
    got = sorted((tuple(r[c] for c in rel.columns) for r in df.collect()), key=str)
    assert got == sorted(rel.fetchall(), key=str)
