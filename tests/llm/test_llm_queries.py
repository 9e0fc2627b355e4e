"""Every registered query with SQL agrees with DuckDB; all queries run on the smallest tables."""

import os

import pytest
from compare import compare, connect

from windowlark.llm.queries import QUERIES, SQL

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(SQL))
def test_agrees_with_sql(spark, duck, name):
    assert compare(spark, duck, QUERIES[name], SQL[name], FOLDER, need_rows=True) == []


def test_registered():
    import __spark_entry__ as entry

    found = entry.queries()
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(found)
