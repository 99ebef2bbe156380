"""Every query with SQL gives the rows that DuckDB gives at the smallest scale."""

import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = [n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    r = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == sorted(df.columns)
    cols = sorted(names)
    want = sorted((tuple(plain(x[names.index(c)]) for c in cols) for x in r.fetchall()), key=str)
    got = sorted((tuple(plain(x[c]) for c in cols) for x in df.collect()), key=str)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
