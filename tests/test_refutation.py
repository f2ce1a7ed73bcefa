"""Proofs that colourings don't exist, and their checker."""

import itertools

import pytest
from pyspark.sql import functions as F

from chromaspan.operators.refutation import line, refute
from chromaspan.plans import proofs

SCHEMA = "graph_id long, partition_index int, items int, colours int, conflicts array<struct<i:int,j:int>>, fixed array<struct<item:int,color:int>>"
CLIQUE = list(itertools.combinations(range(4), 2))
WHEEL = [(i, (i + 1) % 5) for i in range(5)] + [(i, 5) for i in range(5)]
PROBLEMS = [
    (1, 0, 4, 3, CLIQUE, []), (1, 1, 4, 4, CLIQUE, []), (2, 0, 6, 3, sorted(tuple(sorted(e)) for e in WHEEL), [(5, 0)]), (2, 1, 6, 4, sorted(tuple(sorted(e)) for e in WHEEL), [(5, 0)]),
    (3, 0, 2, 2, [(0, 1)], [(0, 1), (1, 1)]), (4, 0, 3, 1, [], []), (5, 0, 5, 2, [(0, 1), (1, 2), (2, 3), (3, 4), (0, 4)], []), (6, 0, 7, 3, sorted([*CLIQUE, (4, 5), (5, 6)]), []),
]


@pytest.fixture(scope="module")
def problems(spark):
    return spark.createDataFrame(PROBLEMS, SCHEMA)


@pytest.fixture(scope="module")
def made(problems):
    outcomes, proof = refute(problems)
    return {(r.graph_id, r.partition_index): r.status for r in outcomes.collect()}, proof.collect(), proof.schema


def colourable(items, colours, conflicts, fixed):
    return any(all(c[i] != c[j] for i, j in conflicts) and all(c[i] == k for i, k in fixed) for c in itertools.product(range(colours), repeat=items))


def test_outcomes(made):
    assert made[0] == {p[:2]: "satisfiable" if colourable(*p[2:]) else "refuted" for p in PROBLEMS}
    assert "refuted" in made[0].values() and "satisfiable" in made[0].values()


def test_every_proof_is_accepted(spark, problems, made):
    proof = spark.createDataFrame(made[1], made[2])
    got = {(r.graph_id, r.partition_index): (r.accepted, r.wrong, r.steps) for r in proofs.verdicts(problems, proof).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: s == "refuted" for k, s in made[0].items()}
    assert all(v[1] == 0 for v in got.values()) and sum(v[2] for v in got.values()) == len(made[1])
    last = {(r.graph_id, r.partition_index): r.literals for r in sorted(made[1], key=lambda r: r.step)}
    assert all(x == [] for x in last.values())


def brute_holds(problem, lemmas, literals):
    """Whether a clause follows from the clauses of a problem and lemmas, over all assignments."""
    _, _, items, colours, conflicts, fixed = problem
    n = items * colours
    clauses = [[1 + i * colours + c for c in range(colours)] for i in range(items)]
    clauses += [[-1 - i * colours - a, -1 - i * colours - b] for i in range(items) for a, b in itertools.combinations(range(colours), 2)]
    clauses += [[-1 - i * colours - c, -1 - j * colours - c] for i, j in conflicts for c in range(colours)] + [[1 + i * colours + c] for i, c in fixed]
    return not any(all(any((x > 0) == bits[abs(x) - 1] for x in c) for c in clauses + lemmas) and not any((x > 0) == bits[abs(x) - 1] for x in literals) for bits in itertools.product([False, True], repeat=n))


def test_steps_follow(made):
    """The accepted steps of small problems do follow, by looking at all assignments."""
    for p in PROBLEMS:
        if p[2] * p[3] <= 12:
            steps = [r.literals for r in sorted(made[1], key=lambda r: r.step) if (r.graph_id, r.partition_index) == p[:2]]
            assert all(brute_holds(p, steps[:k], s) for k, s in enumerate(steps))


def changed(spark, problems, made, change):
    rows = [r for r in (change(r) for r in made[1]) if r is not None]
    return {(r.graph_id, r.partition_index): r.accepted for r in proofs.verdicts(problems, spark.createDataFrame(rows, made[2])).collect()}


def test_damage(spark, problems, made):
    refuted = {k for k, s in made[0].items() if s == "refuted"}
    wheel = [r for r in made[1] if (r.graph_id, r.partition_index) == (2, 0)]
    assert len(wheel) > 2
    # Without the closing step, or with one moved to a problem that has a colouring.
    assert not any(changed(spark, problems, made, lambda r: None if not r.literals else r).values())
    moved = lambda r: (r.graph_id, 1 if r.graph_id < 3 else r.partition_index, r.step, r.literals)
    got = changed(spark, problems, made, moved)
    assert not got[1, 1] and not got[2, 1] and got[5, 0]
    # A step before those it rests on, and one without them.
    order = lambda r: (r.graph_id, r.partition_index, -r.step if (r.graph_id, r.partition_index) == (2, 0) else r.step, r.literals)
    assert {k for k, v in changed(spark, problems, made, order).items() if v} == refuted - {(2, 0)}
    alone = lambda r: r if not r.literals or (r.graph_id, r.partition_index) != (2, 0) else None
    assert {k for k, v in changed(spark, problems, made, alone).items() if v} == refuted - {(2, 0)}
    # A repeated literal changes nothing.
    assert {k for k, v in changed(spark, problems, made, lambda r: (r.graph_id, r.partition_index, r.step, r.literals * 2)).items() if v} == refuted


def test_no_proof_of_a_stopped_search(spark, problems):
    outcomes, proof = refute(problems.where("graph_id = 2"), max_nodes=1)
    assert {r.status for r in outcomes.collect()} <= {"unknown", "satisfiable"} and proof.count() == 0
    assert not any(r.accepted for r in proofs.verdicts(problems, proof).collect())


def test_text(spark):
    assert spark.range(1).select(line(F.array(F.lit(-3), F.lit(5))), line(F.array().cast("array<int>"))).first()[:] == ("-3 5 0", "0")
