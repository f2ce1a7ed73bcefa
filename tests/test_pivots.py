"""Dependency states on tables against the published counts and a search of its own."""

from collections import Counter

from pyspark.sql import functions as F

from chromaspan.plans import dependency as D
from chromaspan.plans import pivots as P
from chromaspan.queries_pivots import order_states
from chromaspan.sources.stored import cut

SF = "/root/testdata/sf0.001"
SCHEMA = "state_id long, w int, root int, targets array<int>, sources array<int>, mobile array<int>"


def made(spark, p):
    """The profile's candidates of exact incidence that reach every vertex, as states."""
    rows = cut(D.incident(spark, p), "incident").where("admissible")
    masks = F.array(*[f"s{c}" for c in range(len(p.indegrees))])
    array = lambda xs: F.array(*map(F.lit, xs))
    return rows.select(F.xxhash64(masks).alias("state_id"), F.lit(p.w).alias("w"), F.lit(0).alias("root"), array(range(1, p.w)).alias("targets"), masks.alias("sources"), array(p.mobile).alias("mobile"))


def test_published_depths(spark):
    for p, want in ((D.PROFILES[0], {0: 231, 1: 6}), (D.PROFILES[2], {0: 77, 1: 8}), (D.PROFILES[3], {0: 3730, 1: 224, 2: 24})):
        rows = P.depths(made(spark, p)).collect()
        assert Counter(r.depth for r in rows) == want and {r.status for r in rows} == {"resolved"}


def brute_depth(r, most):
    def reach(root, targets, sources, gone):
        seen = {root}
        while more := {t for t, s in zip(targets, sources, strict=True) if t != gone and t not in seen and any(s >> v & 1 for v in seen)}:
            seen |= more
        return seen

    level, seen = {(r.root, tuple(r.targets), tuple(r.sources))}, set()
    for depth in range(most + 1):
        if any({v for v in range(r.w) if s[c] >> v & 1} <= reach(root, t, s, t[c]) for root, t, s in level for c in r.mobile):
            return depth, "resolved"
        seen |= level
        new = set()
        for root, t, s in level:
            for c in range(len(t)):
                if s[c] >> root & 1:
                    new.add((t[c], (*t[:c], root, *t[c + 1 :]), (*s[:c], s[c] - (1 << root) | 1 << t[c], *s[c + 1 :])))
        level = new - seen
        if not level:
            return None, "exhausted"
    return None, "bounded"


def test_orders_equal_a_search(spark):
    states = order_states(spark, SF)
    got = {r.state_id: (r.depth, r.status) for r in P.depths(states, 2).collect()}
    want = {r.state_id: brute_depth(r, 2) for r in states.collect()}
    differ = {k for k in want if got[k] != want[k]}
    # A state without a next one is exhausted for the search only in the round that finds this.
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and {got[k][1], want[k][1]} == {"bounded", "exhausted"} for k in differ)
    assert {d for d, _ in got.values()} == {0, 1, 2, None}


def test_statuses_and_no_states(spark):
    rows = [(1, 3, 0, [1, 2], [4, 2], [0]), (2, 3, 0, [1, 2], [1, 1], [0]), (3, 3, 0, [1, 2], [1, 2], [1]), (4, 3, 0, [1], [5], [0])]
    states = spark.createDataFrame(rows, SCHEMA)
    want = {r.state_id: brute_depth(r, 9) for r in states.collect()}
    assert {r.state_id: (r.depth, r.status) for r in P.depths(states).collect()} == want and want[2] == (0, "resolved") and want[4] == (None, "exhausted")
    assert P.depths(states.where("false")).count() == 0
    assert [r.outdegrees for r in P.judged(states.where("state_id = 2")).collect()] == [[2, 0, 0]]
