"""Every core query runs on the smallest tables and, where it has SQL, equals it."""

import os

import duckdb
import pytest

from weftline.plans.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS FROM '{DATA}/{name}'")
    return con


def plain(rows, order):
    return sorted((tuple(round(r[k], 6) if isinstance(r[k], float) else r[k] for k in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = plain(df.collect(), columns)
    if name in ORACLE_SQL:
        want = duck.sql(ORACLE_SQL[name])
        assert sorted(want.columns) == columns
        assert got == plain(want.fetchall(), [want.columns.index(c) for c in columns])
