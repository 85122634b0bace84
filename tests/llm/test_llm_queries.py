import pytest

from oracle import compare
from siftloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, data, name):
    compare(spark, data, queries.queries()[name], queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_runs(spark, data, name):
    assert queries.queries()[name](spark, data).count() > 0
