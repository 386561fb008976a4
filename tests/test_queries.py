"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as contract
from checks.compare import connect, difference

QUERIES, SQL = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(name, spark, con, small):
    df = QUERIES[name](spark, small)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert difference(df, con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(name, spark, small):
    assert QUERIES[name](spark, small).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
