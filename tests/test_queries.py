"""Every registered query of the engine against its SQL twin, on the smallest tables."""

import datetime
from decimal import Decimal

import duckdb
import pytest

from duelframe import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = queries.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return round(x, 8)
    if isinstance(x, Decimal):
        return float(x)
    if isinstance(x, datetime.datetime):
        return str(x)
    return x


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rel = duck.sql(SQL[name])
    names = list(rel.columns)
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(SQL)))
def test_runs(spark, name):
    df = queries.queries()[name](spark, SF)
    assert df.columns and df.count() >= 0
