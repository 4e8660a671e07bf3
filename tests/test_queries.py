"""The entry point, and every query with SQL against DuckDB at the least scale."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = entry.oracle_sql()
CORE = [k for k in SQL if not k.startswith(("op", "pipeline"))]


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.8g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    return con


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", CORE)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    r = duck.execute(SQL[name])
    columns = [d[0] for d in r.description]
    assert sorted(columns) == sorted(df.columns)
    order = lambda rows, names: sorted((tuple(plain(x[names.index(c)]) for c in sorted(names)) for x in rows), key=repr)
    assert order(df.collect(), df.columns) == order(r.fetchall(), columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
