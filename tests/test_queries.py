"""Every registered query with SQL against DuckDB on the smallest tables; the others run."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def norm(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return v.replace(tzinfo=None).isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n in SQL))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    r = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(r.columns)
    cols = sorted(df.columns)
    mine = sorted(tuple(norm(row[c]) for c in cols) for row in df.collect())
    theirs = sorted(tuple(norm(row[r.columns.index(c)]) for c in cols) for row in r.fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in SQL))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
