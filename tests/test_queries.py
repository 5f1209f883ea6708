"""Every query with SQL gives the rows that DuckDB gives on the smallest tables."""

import os

import duckdb
import pytest

from corpusloom.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for name in os.listdir(DATA):
        con.sql(f"create view {name.split('.')[0]} as select * from '{DATA}/{name}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "null" if value != value else repr(round(value, 9))
    return "null" if value is None else str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


def test_names():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equal_to_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    wanted = duck.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(wanted.columns)
    assert rows(df.columns, df.collect()) == rows(wanted.columns, wanted.fetchall())


@pytest.mark.parametrize("name", ["merkle_root", "audit_paths", "dedup_summary", "consent_files", "index_statistics", "document_digests"])
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0
