import pytest

import __spark_entry__ as contract
from annoframe.catalog import QUERIES, SQL
from tests.oracle import assert_same, connect


@pytest.fixture(scope="module")
def duck(tables):
    return connect(tables)


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)
    assert set(QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(name, spark, duck, tables):
    assert_same(QUERIES[name](spark, tables), duck, SQL[name])
