"""Every query against DuckDB on the smallest tables, where they are at hand."""

import datetime
import decimal
import os

import duckdb
import pytest
from loomwork.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, list):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", catalog.queries())
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    rows = sorted((tuple(map(plain, r)) for r in df.select(cols).collect()), key=str)
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(want.columns) == cols
    assert rows == sorted((tuple(map(plain, r)) for r in want.select(*(f'"{c}"' for c in cols)).fetchall()), key=str)


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(catalog.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
