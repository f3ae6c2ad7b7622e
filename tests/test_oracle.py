"""Every query with SQL equals DuckDB's result on the same tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from tidemark.plans import catalog

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    return round(x, 6) if isinstance(x, float) else bool(x) if isinstance(x, bool) else x


def key(row):
    return [(v is None, str(v)) for v in row]


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    want = duck.sql(catalog.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=key)
    names = want.columns
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in want.fetchall()), key=key)
    assert mine == theirs
