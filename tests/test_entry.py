"""The driver's contract, and every query with SQL against DuckDB on the smallest tables."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry
from quern.plans import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables aren't here")


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(SQL) <= set(QUERIES) <= set(entry.queries())


@needs_tables
def test_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and {"source", "lang", "band"} <= set(df.columns)


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "none"
    if isinstance(value, (list, tuple)) or hasattr(value, "tolist"):
        return str([plain(v) for v in value])
    if isinstance(value, bool):
        return str(value)
    try:
        return f"{float(value):.5g}"
    except (TypeError, ValueError):
        return str(value)[:19] if hasattr(value, "year") else str(value)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@needs_tables
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    found = QUERIES[name](spark, FOLDER)
    result = duck.execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(found.columns) == sorted(columns)
    order = sorted(columns)
    rows = sorted(tuple(plain(r[c]) for c in order) for r in found.collect())
    expected = sorted(tuple(plain(dict(zip(columns, r))[c]) for c in order) for r in result.fetchall())
    assert rows == expected
