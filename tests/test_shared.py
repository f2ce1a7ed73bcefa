"""Queries that tell of graphs by their edges work once on equal graphs, and every graph gets its rows."""

import importlib

import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from chromaspan.queries import ORACLES, QUERIES

#: Where the work is done that grew with the table: (query, module, function).
WORK = [
    ("solvers_agree", "queries", "solve"), ("status_rollup", "plans.census", "universal"), ("universal_census_tight_palette", "plans.census", "universal"),
    ("matching_core_run_tight", "plans.matching_core", "run"), ("universal_check_matrix", "plans.census", "checks"), ("matching_core_extensions", "plans.matching_core", "extensions"),
    ("cnf_model_verdicts", "queries", "solve"), ("precoloring_counts", "plans.matching_core", "precolourings"), ("check_all_tight_palette", "plans.census", "check_all"),
    ("partition_counts", "operators.partitions", "partitions"), ("aux_invariants", "operators.partitions", "partitions"), ("cnf_clause_counts", "queries", "_total_problem"),
    ("cnf_dimacs_digest", "queries", "_total_problem"), ("census_records", "plans.census", "checks"), ("census_record_faults", "plans.census", "checks"), ("search_record_faults", "plans.census", "search"),
    ("hole_blockages", "plans.holes", "blockages"), ("hole_crossings", "plans.holes", "crossings"), ("hole_verdicts", "plans.holes", "verdicts"), ("hole_counters", "plans.holes", "verdicts"), ("hole_scope", "plans.holes", "scope_issues"), ("hole_orbits", "plans.holes", "verdicts"),
]


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    """Six graphs of eight orders and five copies of them under other keys."""
    path = str(tmp_path_factory.mktemp("copies"))
    some = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").where("l_orderkey < 48")
    some.crossJoin(spark.range(6)).selectExpr("l_orderkey + 1024 * id AS l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").write.parquet(f"{path}/lineitem.parquet")
    return path


@pytest.mark.parametrize(("name", "module", "function"), WORK)
def test_equal_graphs_are_worked_on_once(spark, copies, monkeypatch, name, module, function):
    where = importlib.import_module(f"chromaspan.{module}")
    given, plain = [], getattr(where, function)

    def spy(rows, *more, **named):
        given.append(rows.select("graph_id").distinct().count())
        return plain(rows, *more, **named)

    monkeypatch.setattr(where, function, spy)
    rows = QUERIES[name](spark, copies)
    assert given and max(given) <= 12
    if name in ORACLES:
        import duckdb

        con = duckdb.connect()
        con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{copies}/lineitem.parquet/*.parquet'")
        same_rows(rows, con.sql(ORACLES[name]))


def test_walks_are_of_two_colours(spark, copies, monkeypatch):
    """Equal sets of edges of two colours are walked once, so no graph that is walked has a third one."""
    from chromaspan.plans import kempe

    given, plain = [], kempe.walks
    monkeypatch.setattr(kempe, "walks", lambda edges: given.append(edges) or plain(edges))
    assert QUERIES["kempe_walks"](spark, copies).count() % 6 == 0
    colours = given[0].groupBy("graph_id").agg(F.count_distinct("color").alias("k"), F.sort_array(F.collect_set(F.struct("u", "v", "color"))).alias("e"))
    assert colours.where("k <> 2").isEmpty() and colours.count() == colours.select("e").distinct().count()


@pytest.mark.parametrize("name", ["cnf_clause_counts", "cnf_dimacs_digest"])
def test_clauses_are_built_once_for_equal_graphs(spark, copies, monkeypatch, name):
    """Counts the rows for which clauses are built, where it happens."""
    from chromaspan.operators import cnf

    seen, plain = spark.sparkContext.accumulator(0), cnf.clauses
    counted = F.udf(lambda items: seen.add(1) or items, "int")
    monkeypatch.setattr(cnf, "clauses", lambda items, *more: plain(counted(items), *more))
    assert len(QUERIES[name](spark, copies).collect()) == 72
    assert 0 < seen.value <= 12


@pytest.mark.parametrize("name", ["hole_blockages", "hole_crossings", "hole_fans", "hole_scope", "hole_verdicts", "hole_orbits"])
def test_sets_of_edges_dont_pass_through_the_driver(spark, copies, name):
    """However small its tables, the plan as it was run broadcasts nothing: on seven vertices there are two million sets of edges."""
    rows = QUERIES[name](spark, copies)
    assert rows.collect()
    assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["hole_blockages", "hole_verdicts", "hole_orbits"])
def test_many_equal_graphs_are_dealt(spark, copies, monkeypatch, name):
    """A set of edges that many graphs have is worked on for a few of them at a time, with the same rows."""
    from chromaspan.sources import families

    want = sorted(map(repr, QUERIES[name](spark, copies).collect()))
    holes = importlib.import_module("chromaspan.queries_holes")
    given, plain = [], holes._states
    monkeypatch.setattr(families, "TOGETHER", 2)
    monkeypatch.setattr(holes, "_states", lambda rows: given.append(rows.count()) or plain(rows))
    assert sorted(map(repr, QUERIES[name](spark, copies).collect())) == want
    assert given and 12 < given[0] <= 72
