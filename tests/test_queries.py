"""Every query with SQL gives the same rows on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from millrace import catalog, catalog_landed, catalog_sources

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(rows):
    return sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted({**catalog.QUERIES, **catalog_landed.QUERIES, **catalog_sources.QUERIES}))
def test_query(spark, sql, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*columns).collect()]
    if name in entry.oracle_sql():
        want = sql.sql(entry.oracle_sql()[name])
        assert sorted(want.columns) == columns
        order = [want.columns.index(c) for c in columns]
        assert plain(rows) == plain([tuple(r[i] for i in order) for r in want.fetchall()])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
