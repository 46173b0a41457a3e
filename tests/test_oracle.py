"""Every query of the core that SQL can express, against DuckDB; the others must run."""

import oracle
import pytest

from siltstone.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, data, name):
    assert oracle.compare(spark, name, QUERIES[name], SQL[name], data) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.columns and df.count() >= 0


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)
