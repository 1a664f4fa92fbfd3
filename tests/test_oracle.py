"""Every query with SQL agrees with it on the small data set."""

import pytest
from oracle import compare, oracle_connection

from callscope.plans.catalog import load

QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def oracle(sf):
    return oracle_connection(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, sf, oracle, name):
    assert compare(spark, oracle, sf, QUERIES[name], ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.count() > 0
    assert len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
