"""The cut loop against direct solving, runs that break off, and replays of damaged rounds."""

import itertools
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from chromaspan.operators.solve import solve
from chromaspan.plans import cuts

SCHEMA = "graph_id long, partition_index int, items int, colours int, conflicts array<struct<i:int,j:int>>, fixed array<struct<item:int,color:int>>"


def made():
    rng = random.Random(8)
    out = []
    for i in range(40):
        n = rng.randint(1, 9)
        pairs = list(itertools.combinations(range(n), 2))
        conflicts = sorted(rng.sample(pairs, rng.randint(0, len(pairs))))
        out.append((i, i % 3, n, rng.randint(2, 5), conflicts, [(0, 1)] if i % 4 == 0 else []))
    return [*out, (90, 0, 5, 4, list(itertools.combinations(range(5), 2)), []), (91, 0, 5, 5, list(itertools.combinations(range(5), 2)), [])]


@pytest.fixture(scope="module")
def problems(spark):
    return spark.createDataFrame(made(), SCHEMA)


def rows(df):
    return sorted(map(tuple, df.drop("assignment").collect()))


def test_equal_to_direct_solving(spark, problems, tmp_path):
    path = str(tmp_path / "rounds")
    found = {(r.graph_id, r.partition_index): r for r in cuts.loop(problems, path).collect()}
    direct = {(r.graph_id, r.partition_index): r.status for r in solve(problems, "dsatur-iterative-v1").collect()}
    assert {k: r.status for k, r in found.items()} == direct and set(direct.values()) == {"witness", "candidate_unsat"}
    for g, p, n, colours, conflicts, fixed in made():
        r = found[g, p]
        assert r.cuts <= len(conflicts) and r.rounds >= 1
        if r.status == "witness":
            assert len(r.assignment) == n and all(0 <= c < colours for c in r.assignment)
            assert all(r.assignment[i] != r.assignment[j] for i, j in conflicts) and all(r.assignment[i] == c for i, c in fixed)
    assert max(r.rounds for r in found.values()) > 2 and any(r.cuts < len(p[4]) for p in made() if (r := found[p[:2]]))
    assert cuts.replay(problems, path).count() == 0


def test_runs_that_break_off(spark, problems, tmp_path):
    whole = str(tmp_path / "whole")
    want = cuts.loop(problems, whole)
    want, rounds = rows(want), len([x for x in os.listdir(whole) if x.startswith("round=")])
    assert rounds > 3
    path = str(tmp_path / "broken")
    some = cuts.loop(problems, path, max_rounds=2)
    assert {r.status for r in some.collect()} >= {"unknown"} and cuts.replay(problems, path).count() == 0
    kept = {f: os.stat(f"{path}/round=0/{f}").st_mtime_ns for f in os.listdir(f"{path}/round=0")}
    assert rows(cuts.loop(problems, path)) == want
    assert kept == {f: os.stat(f"{path}/round=0/{f}").st_mtime_ns for f in os.listdir(f"{path}/round=0")}
    # A round that lost a file is written anew.
    lost = sorted(f for f in os.listdir(f"{path}/round=1") if f.endswith(".parquet"))
    for f in (lost[0], f".{lost[0]}.crc"):
        if os.path.exists(f"{path}/round=1/{f}"):
            os.remove(f"{path}/round=1/{f}")
    shutil.rmtree(f"{path}/round=2")
    assert rows(cuts.loop(problems, path)) == want and cuts.replay(problems, path).count() == 0


def test_other_problems(spark, problems, tmp_path):
    path = str(tmp_path / "rounds")
    cuts.loop(problems, path)
    with pytest.raises(cuts.OtherProblems):
        cuts.loop(problems.withColumn("colours", F.col("colours") + 1), path)
    assert {r.fault for r in cuts.replay(problems.withColumn("colours", F.col("colours") + 1), path).collect()} == {"digest"}
    assert {r.fault for r in cuts.replay(problems.where("graph_id <> 5"), path).collect()} == {"extra"}
    more = problems.union(spark.createDataFrame([(500, 0, 1, 1, [], [])], SCHEMA))
    assert [tuple(r) for r in cuts.replay(more, path).collect()] == [(500, 0, 0, "missing")]


@pytest.mark.parametrize("column, value, faults", [
    ("cuts", "slice(cuts, 1, size(cuts) - 1)", {"cuts"}), ("broken", "array()", {"broken", "extra", "cuts"}), ("assignment", "transform(assignment, x -> 0)", {"broken", "proper", "cuts", "fixed"}),
    ("assignment", "transform(assignment, x -> x + 9)", {"palette", "fixed"}), ("digest", "'x'", {"digest"}),
])
def test_damage(spark, problems, tmp_path, column, value, faults):
    path, other = str(tmp_path / "rounds"), str(tmp_path / "other")
    cuts.loop(problems, path)
    stored = cuts.stored(spark, path)
    test = "round = 1 AND status = 'witness' AND size(cuts) > 0"
    harmed = stored.withColumn(column, F.when(F.expr(test), F.expr(f"CAST({value} AS {stored.schema[column].dataType.simpleString()})")).otherwise(F.col(column)))
    harmed.write.partitionBy("round").parquet(other)
    got = {r.fault for r in cuts.replay(problems, other).collect()}
    assert got and got <= faults


def test_nothing(spark, problems, tmp_path):
    none = problems.limit(0)
    assert cuts.loop(none, str(tmp_path / "r")).count() == 0 and cuts.replay(none, str(tmp_path / "r")).count() == 0
    assert {r.status for r in cuts.loop(problems, str(tmp_path / "m"), max_rounds=0).collect()} == {"unknown"}
