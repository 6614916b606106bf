"""Every query that has SQL gives the same rows as DuckDB, on the smallest tables."""

from __future__ import annotations

import datetime
import os

import duckdb
import pytest

import __spark_entry__ as entry
from newsloom.plans import catalogue

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DIR}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 4)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, db, name):
    df = catalogue.queries()[name](spark, DIR)
    got = sorted(repr(tuple(plain(x) for x in r)) for r in df.select(*sorted(df.columns)).collect())
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        return
    r = db.execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in sorted(names)]
    assert got == sorted(repr(tuple(plain(row[i]) for i in order)) for row in r.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
