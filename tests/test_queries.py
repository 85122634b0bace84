import pytest

import __spark_entry__ as contract
from oracle import compare
from siftloom.plans import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, data, name):
    compare(spark, data, registry.queries()[name], registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, data, name):
    assert registry.queries()[name](spark, data).count() > 0


def test_entry(spark, data):
    df = contract.entry(spark)
    assert df.columns == ["l_partkey", "hit"] and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
