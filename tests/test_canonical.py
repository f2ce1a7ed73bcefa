"""Canonical forms and censuses by isomorphism class."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from chromaspan.operators import canonical
from chromaspan.plans import census

SCHEMA = "graph_id long, n int, edges array<struct<u:int,v:int>>"


def moved(edges, p):
    return sorted((min(p[u], p[v]), max(p[u], p[v])) for u, v in edges)


def least(n, edges):
    return min(moved(edges, p) for p in itertools.permutations(range(n)))


def forms(spark, graphs):
    found = canonical.forms(spark.createDataFrame([(i, n, e) for i, (n, e) in enumerate(graphs)], SCHEMA)).collect()
    assert len(found) == len(graphs)
    return {r.graph_id: [tuple(e) for e in r.canonical] for r in found}


def test_every_graph_of_five_vertices(spark):
    """All 1,024 labelled graphs: equal forms for isomorphic graphs and no others, each one of the graph's own relabelings."""
    pairs = list(itertools.combinations(range(5), 2))
    graphs = [(5, [e for k, e in enumerate(pairs) if m >> k & 1]) for m in range(1 << len(pairs))]
    got = forms(spark, graphs)
    by_least, by_form = {}, {}
    for i, (n, e) in enumerate(graphs):
        by_least.setdefault(tuple(least(n, e)), set()).add(i)
        by_form.setdefault(tuple(got[i]), set()).add(i)
        assert least(n, got[i]) == least(n, e)
    assert len(by_form) == 34 and sorted(map(sorted, by_least.values())) == sorted(map(sorted, by_form.values()))


def cycle(n, *parts):
    at, out = 0, []
    for k in parts or (n,):
        out += [tuple(sorted((at + i, at + (i + 1) % k))) for i in range(k)]
        at += k
    return n, sorted(out)


CUBE = (8, sorted((a, a | 1 << k) for a in range(8) for k in range(3) if not a >> k & 1))
REGULAR = [
    cycle(8), cycle(8, 4, 4), cycle(8, 5, 3), cycle(9, 3, 3, 3), cycle(9), CUBE, (8, [*cycle(8)[1], (0, 4), (1, 5), (2, 6), (3, 7)]), (8, list(itertools.combinations(range(8), 2))), (8, []),
    (10, sorted([*cycle(5)[1], *((i, i + 5) for i in range(5)), *(tuple(sorted((5 + i, 5 + (i + 2) % 5))) for i in range(5))])), (1, []), (2, [(0, 1)]), (7, [(0, 1), (0, 2), (0, 3)]),
]


def test_relabelings_of_regular_graphs(spark):
    """Where refinement alone tells no vertices apart, and twins in plenty."""
    rng = random.Random(4)
    graphs = []
    for n, edges in REGULAR:
        for _ in range(6):
            p = list(range(n))
            rng.shuffle(p)
            graphs.append((n, moved(edges, p)))
    got = forms(spark, graphs)
    kinds = [{(graphs[i][0], tuple(got[i])) for i in range(6 * k, 6 * k + 6)} for k in range(len(REGULAR))]
    assert all(len(k) == 1 for k in kinds) and len(set.union(*kinds)) == len(REGULAR)


def test_bound_on_vertices(spark):
    rows = spark.createDataFrame([(0, 4, [(0, 1)])], SCHEMA)
    with pytest.raises(Exception, match="more than the 3 allowed"):
        canonical.forms(rows, 3).collect()
    assert canonical.classes(rows.limit(0)).count() == 0


def test_census_by_class(spark):
    """The rows of a census of each graph by itself, hot copies and relabelings included."""
    rng = random.Random(9)
    pairs = list(itertools.combinations(range(6), 2))
    rows = []
    for i in range(40):
        edges = sorted(rng.sample(pairs, rng.randint(5, 14)))
        for k in range(3):
            p = list(range(6))
            rng.shuffle(p)
            rows.append((3 * i + k, 6, moved(edges, p)))
    rows += [(1000 + i, 6, rows[0][2]) for i in range(50)]
    df = spark.createDataFrame(rows, SCHEMA)
    for wanted in (census.CHECKS, [("dsatur-iterative-v1", 0)]):
        got = census.by_class(df, 3, wanted).drop("class_id")
        want = census.universal(df, 3, wanted)
        assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    sizes = census.by_class(df, 3).groupBy("class_id").agg(F.count("*").alias("k")).collect()
    assert sum(r.k for r in sizes) == 170 and len(sizes) <= 40
