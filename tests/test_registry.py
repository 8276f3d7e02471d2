"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as registry
from tests.check import compare, duck

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_names():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert registry.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, SF_DIR, QUERIES[name], SQL.get(name)) is None
