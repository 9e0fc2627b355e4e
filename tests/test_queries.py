"""Every registered query runs; those with SQL agree with DuckDB."""

import os

import pytest
from compare import compare, connect

from windowlark import catalog

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
catalog.load()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(catalog.PLANS))
def test_query(spark, duck, name):
    assert compare(spark, duck, catalog.PLANS[name], catalog.CHECKS.get(name), FOLDER) == []


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
