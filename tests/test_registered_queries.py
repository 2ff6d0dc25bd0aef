"""Every registered query with a SQL twin gives the twin's rows."""

import pytest

import __spark_entry__ as contract
from tests.compare import connect, differences

QUERIES, CHECKS = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_equals_sql(spark, con, folder, name):
    assert differences(spark, con, folder, name, QUERIES[name], CHECKS[name]) == []


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0
