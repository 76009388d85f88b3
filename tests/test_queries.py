"""Every registered query against its SQL, and the driver contract."""

import pytest
from check import compare, duck

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return duck(data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, data, con, name):
    assert compare(QUERIES[name](spark, data), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, small_data, name):
    assert QUERIES[name](spark, small_data).count() > 0


def test_contract(spark):
    assert set(ORACLES) <= set(QUERIES)
    assert entry.entry(spark).count() == 5
