"""Queries that SQL can express, on the smallest tables; and that all are registered."""

import os

import duckdb
import pytest

from gridlore.llm import queries

SF = "/root/testdata/sf0.001"
SQL = queries.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, name):
    df = queries.queries()[name](spark, SF)
    found = con.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect()), key=str) == sorted(found.fetchall(), key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(SQL)))
def test_query_covers_its_table(spark, name):
    """Without SQL: the columns are there, and a row or more for every document."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.queries()[name](spark, SF)
    ids = {r.doc_id for r in got.select("doc_id").collect()}
    known = {r.doc_id for r in docs.select("doc_id").collect()}
    assert ids <= known and (ids == known or name in ("op2_secret_scan", "pipeline"))
