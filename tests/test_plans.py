"""Censuses, completeness and audits on known cases."""

import pytest
from pyspark.sql import functions as F

from chromaspan.functions import graphs as G
from chromaspan.plans import census, completeness, dependency
from chromaspan.plans.transfer import pins, variables
from chromaspan.sources.universe import GraphUniverse, graphs_of

SCHEMA = "graph_id long, n int, edges array<struct<u:int,v:int>>"
C4 = [(0, 1), (0, 3), (1, 2), (2, 3)]


def test_status_discipline(spark):
    c4 = spark.createDataFrame([(0, 4, C4), (1, 4, [(0, 1)])], SCHEMA)
    tight = {r.graph_id: r for r in census.universal(c4, 2, [("dsatur-iterative-v1", 0)]).collect()}
    assert tight[0].status == "candidate_unsat" and tight[1].outcome_code == "outside_high_degree_filter"
    assert census.universal(c4, 2).where("graph_id = 0").first().status == "verified_all"
    limited = census.universal(c4, 2, max_nodes=1).where("graph_id = 0").first()
    assert (limited.status, limited.outcome_code) == ("unknown", "incomplete_partition_check")
    assert census.existential(c4, 2).where("graph_id = 0").first().first_partition == 0


def test_disagreement_is_an_error(spark, monkeypatch):
    rows = spark.createDataFrame([(0, 0, "a", 1, "witness"), (0, 0, "b", 1, "candidate_unsat")], "graph_id long, partition_index int, backend string, palette_offset int, status string")
    monkeypatch.setattr(census, "checks", lambda *a: rows)
    got = census.universal(spark.createDataFrame([(0, 4, C4)], SCHEMA), 2).first()
    assert (got.status, got.outcome_code) == ("error", "backend_status_disagreement")


def test_completeness(spark):
    direct = spark.createDataFrame([(i, f"g{i}") for i in range(6)], "i long, k string")
    shards = spark.createDataFrame([(0, "g0"), (1, "g1"), (2, "g0"), (0, "x"), (0, "g3"), (0, "g3")], "s long, k string")
    got = completeness.union_audit(direct, shards, "k", "s").first()
    assert (got.direct_rows, got.shard_rows, got.overlapping, got.repeated, got.missing, got.extra) == (6, 6, 1, 2, 3, 1)
    done = spark.createDataFrame([(0, "g0"), (1, "bad")], "i long, k string")
    assert [r.i for r in completeness.prefix_mismatches(direct, done, "i", "k").collect()] == [1]
    gaps = spark.createDataFrame([("a", 0), ("a", 1), ("b", 1), ("c", 0), ("c", 0)], "g string, i long")
    assert sorted(r.g for r in completeness.index_gaps(gaps, "i", "g").collect()) == ["b", "c"]


@pytest.mark.parametrize("partitions", [1, 5])
def test_results_do_not_depend_on_partitions(spark, partitions):
    rows = spark.createDataFrame([(i, 4, C4 if i % 2 else [(0, 1), (0, 2), (0, 3)]) for i in range(8)], SCHEMA).repartition(partitions)
    got = sorted(map(tuple, census.universal(rows, 2).collect()))
    assert got == sorted(map(tuple, census.universal(rows.coalesce(1), 2).collect()))


def test_universe_options(spark):
    spark.dataSource.register(GraphUniverse)
    read = lambda **o: spark.read.format("graph_universe").options(**o).load()
    assert read(order="4").count() == 11 and read(order="4", connected="true").count() == 6
    assert sorted(r.graph_id for r in read(order="5", shards="3").collect()) == list(range(34))
    assert read(order="4", mindegree="1", maxdegree="2").where(F.array_min(G.degrees(F.col("n"), F.col("edges"))) < 1).count() == 0
    assert [len(graphs_of(n)) for n in range(1, 7)] == [1, 2, 4, 11, 34, 156]


def test_pivots_of_a_large_profile(spark):
    got = dependency.counters(spark, dependency.PROFILES[2]).first()
    assert (got.candidates, got.fragile, got.resolved) == (256, 8, 8)


@pytest.mark.parametrize("kind", ["d8_counters", "d8_depth_histogram"])
def test_a_dependency_query_has_every_profile(duck, kind):
    """By the SQL, whose rows test_oracles holds against the query's."""
    from chromaspan.queries import ORACLES

    got = [duck.sql(sql).fetchall() for name, sql in ORACLES.items() if name.startswith(kind)]
    assert {p.name for p in dependency.PROFILES} in [{r[0] for r in x} for x in got]


def test_transfer_pins(spark):
    v = variables(spark)
    assert v.count() == 1032
    assert pins(v, 1).count() == 13 and pins(v, 3).count() == 13
    with pytest.raises(ValueError):
        pins(v, 2)


def test_stream_counts_an_edge_once(spark, tmp_path):
    from chromaspan.streaming.incremental import drain, windowed_counts

    rows = [(1, "2024-01-01 00:00:00", 2), (1, "2024-01-01 00:00:01", 2), (3, "2024-01-01 00:20:00", 4)]
    events = spark.createDataFrame(rows, "event_id long, t string, user_id long").select("event_id", F.to_timestamp("t").alias("ts"), "user_id")
    events.write.parquet(f"{tmp_path}/events.parquet")
    assert [tuple(r) for r in drain(spark, str(tmp_path)).collect()] == [(0, 2)]
    assert sum(r.edges for r in windowed_counts(events).collect()) == 3
