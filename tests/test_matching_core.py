"""Runs of the matching-core search that end at the first failure, and their receipts."""

import itertools

import pytest

from chromaspan.plans import census
from chromaspan.plans import matching_core as M

SCHEMA = "graph_id long, n int, edges array<struct<u:int,v:int>>"
GRAPHS = [(1, 4, [(0, 1), (0, 2), (1, 2), (2, 3)]), (2, 4, list(itertools.combinations(range(4), 2))), (3, 4, [(0, 1)]), (4, 4, [(0, 1), (1, 2), (2, 3), (0, 3)]), (5, 5, [(0, 1), (1, 2), (2, 3), (3, 4), (0, 4), (0, 2)])]


def brute(n, edges, extra):
    """[(colours, whether they extend)] of all precolourings in order."""
    degree = max(sum(v in e for e in edges) for v in range(n))
    out = []
    for colors in itertools.product(range(degree + 1), repeat=n):
        if any(c > max(colors[:i], default=-1) + 1 for i, c in enumerate(colors)) or max(map(colors.count, colors)) > 2 or any(colors[u] == colors[v] for u, v in edges):
            continue

        def extends(k, chosen, colors=colors):
            if k == len(edges):
                return True
            u, v = edges[k]
            taken = {colors[u], colors[v]} | {c for e, c in zip(edges, chosen, strict=False) if set(e) & {u, v}}
            return any(extends(k + 1, [*chosen, c]) for c in range(degree + extra) if c not in taken)

        out.append((list(colors), extends(0, [])))
    return out


@pytest.mark.parametrize("extra", [1, 2])
@pytest.mark.parametrize("most", [None, 1, 3])
def test_run(spark, extra, most):
    for n in (4, 5):
        graphs = [g for g in GRAPHS if g[1] == n]
        got = {r.graph_id: r for r in M.run(spark.createDataFrame(graphs, SCHEMA), n, extra, most).collect()}
        for i, _, edges in graphs:
            want = brute(n, edges, extra)
            if not want:
                assert i not in got
                continue
            tried = want if most is None else want[:most]
            bad = next((k for k, (_, ok) in enumerate(tried) if not ok), None)
            status = "candidate_unsat" if bad is not None else "complete_positive" if len(tried) == len(want) else "bounded_positive"
            r = got[i]
            assert (r.status, r.precolourings, r.failure, r.started) == (status, len(want), bad, len(tried) if bad is None else bad + 1)
            assert r.colors == (None if bad is None else want[bad][0])


def test_receipts(spark):
    rows = [(4, "complete_positive", 9, 9, None), (7, "candidate_unsat", 9, 3, 2), (5, "unknown", 9, 1, 0), (6, "bounded_positive", 9, 4, None)]
    df = spark.createDataFrame(rows, "graph_id long, status string, precolourings long, started long, failure int")
    assert tuple(M.receipt(df).first()) == ("unknown", 4, 17, 5, 0)
    assert tuple(M.receipt(df.where("graph_id IN (4, 6)")).first()) == ("bounded_positive", 2, 13, None, None)
    assert tuple(M.receipt(df.where("graph_id = 4")).first()) == ("complete_positive", 1, 9, None, None)
    assert tuple(M.receipt(df.limit(0)).first()) == ("complete_positive", 0, 0, None, None)


def test_a_lost_check_is_an_error(spark, monkeypatch):
    """A census whose checks aren't partitions times checks isn't verified."""
    whole = census.checks
    monkeypatch.setattr(census, "checks", lambda *a: whole(*a).where("NOT (graph_id = 2 AND partition_index = 0 AND palette_offset = 2)"))
    got = {r.graph_id: (r.status, r.outcome_code) for r in census.universal(spark.createDataFrame(GRAPHS, SCHEMA)).collect()}
    assert got[2] == ("error", "partition_check_error") and got[1][0] == "verified_all"
