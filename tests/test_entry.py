"""Every registered query against its SQL, on the smallest driver tables."""

import datetime as dt
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, (str, bytes)):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dt.datetime):
        return v.date() if v.time() == dt.time(0) else v
    if isinstance(v, dt.date):
        return v
    v = float(v)
    return None if math.isnan(v) else round(v, 6) + 0.0


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    told = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(told.columns)
    assert rows(df.columns, df.collect()) == rows(told.columns, told.fetchall())


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in SQL and not n.startswith("op") and n != "pipeline"))
def test_query_without_sql_has_its_rows(spark, duck, sf_dir, name):
    """SQL says at least how many rows there are, or that there are some."""
    df = QUERIES[name](spark, sf_dir)
    whole = {
        "m6_concept_predict": "SELECT count(DISTINCT l_partkey) FROM lineitem",
    }
    n = df.count()
    assert n == duck.sql(whole[name]).fetchall()[0][0] if name in whole else n > 0


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
