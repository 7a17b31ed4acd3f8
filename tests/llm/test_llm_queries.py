import pytest

from callframe.llm import queries
from tests.oracle import agree


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_sql(spark, data, name):
    agree(spark, data, queries.QUERIES[name], queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_runs(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    df.collect()
    assert df.columns
