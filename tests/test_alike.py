"""Queries that tell the same of isomorphic graphs work on one graph of each class."""

import importlib

import duckdb
import pytest
from conftest import same_rows

from chromaspan.queries import ORACLES, QUERIES

#: Where the work is done that grew with the labelings: (query, module, function).
WORK = [
    ("universal_census_tight_palette", "plans.census", "universal"), ("status_rollup", "plans.census", "universal"),
    ("matching_core_run_tight", "plans.matching_core", "run"), ("matching_core_extensions", "plans.matching_core", "extensions"),
]


@pytest.fixture(scope="module")
def relabelled(spark, tmp_path_factory):
    """Twelve graphs of four orders and five copies of them whose vertices are turned by one more each."""
    path = str(tmp_path_factory.mktemp("relabelled"))
    some = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").where("l_orderkey < 48")
    some.crossJoin(spark.range(6)).selectExpr("l_orderkey + 1024 * id AS l_orderkey", "l_partkey + id AS l_partkey", "l_suppkey + id AS l_suppkey", "l_linenumber").write.parquet(f"{path}/lineitem.parquet")
    return path


@pytest.mark.parametrize(("name", "module", "function"), WORK)
def test_isomorphic_graphs_are_worked_on_once(spark, relabelled, monkeypatch, name, module, function):
    where = importlib.import_module(f"chromaspan.{module}")
    given, plain = [], getattr(where, function)

    def spy(rows, *more, **named):
        given.append(rows.select("graph_id").distinct().count())
        return plain(rows, *more, **named)

    monkeypatch.setattr(where, function, spy)
    rows = QUERIES[name](spark, relabelled)
    assert given and max(given) <= 12
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{relabelled}/lineitem.parquet/*.parquet'")
    same_rows(rows, con.sql(ORACLES[name]))
