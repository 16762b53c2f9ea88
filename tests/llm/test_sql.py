"""Queries of this part that SQL can express equal it on the smallest tables."""

import os

import pytest

from tests.test_queries import DATA, duck, plain, pytestmark  # noqa: F401
from weftline.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):  # noqa: F811
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    assert plain(df.collect(), columns) == plain(want.fetchall(), [want.columns.index(c) for c in columns])
