"""Every query with SQL beside it gives the same rows as DuckDB."""

import pytest
from conftest import same_rows

from chromaspan.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, "/root/testdata/sf0.001"), duck.sql(ORACLES[name]))


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert e.oracle_sql().keys() <= e.queries().keys()
