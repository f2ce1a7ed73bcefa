"""Plans in rounds: merged states, list ranking, ordinals, cut loops."""

import random
from functools import cache

import pytest
from pyspark.sql import functions as F

from chromaspan.operators import partitions as P
from chromaspan.plans import kempe, ordinals

SCHEMA = "graph_id long, n int, edges array<struct<u:int,v:int>>, size int"


def matchings(n, edges, size):
    """The number of matchings of so many edges of the complement."""
    gone = set(edges)

    @cache
    def count(v, taken, left):
        if v == n:
            return int(left == 0)
        if taken >> v & 1:
            return count(v + 1, taken, left)
        return count(v + 1, taken, left) + sum(count(v + 1, taken | 1 << w, left - 1) for w in range(v + 1, n) if left and not taken >> w & 1 and (v, w) not in gone)

    return count(0, 0, size)


def test_merged_counts(spark):
    rng = random.Random(2)
    rows = []
    for i, n in enumerate([1, 2, 5, 6, 8, 8, 11, 14, 14, 14]):
        pairs = [(u, v) for u in range(n) for v in range(u + 1, n)]
        rows.append((i, n, sorted(rng.sample(pairs, len(pairs) // (2 + i % 3))), rng.randint(0, n // 2)))
    rows += [(20, 14, [], 7), (21, 4, [(u, v) for u in range(4) for v in range(u + 1, 4)], 1), (22, 4, [], 3), (23, 6, [], -1)]
    got = {r.graph_id: r.counted for r in P.merged_counts(spark.createDataFrame(rows, SCHEMA), "size").collect()}
    assert got == {i: matchings(n, e, k) if k >= 0 else 0 for i, n, e, k in rows} and got[20] == 135135
    with pytest.raises(Exception, match="more than the 13 allowed"):
        P.merged_counts(spark.createDataFrame(rows, SCHEMA), "size", 13).collect()
    assert P.merged_counts(spark.createDataFrame([], SCHEMA), "size").count() == 0


def brute_walks(edges):
    """{(graph, first, second, component): (kind, [(tail, head, color)])} by walking."""
    out = {}
    for g in {e[0] for e in edges}:
        mine = [e[1:] for e in edges if e[0] == g]
        colours = sorted({c for _, _, c in mine})
        for a in colours:
            for b in (c for c in colours if c > a):
                near = {}
                for u, v, c in mine:
                    if c in (a, b):
                        near.setdefault(u, {})[c] = v
                        near.setdefault(v, {})[c] = u
                left = set(near)
                while left:
                    part, todo = set(), [min(left)]
                    while todo:
                        v = todo.pop()
                        if v not in part:
                            part.add(v)
                            todo += near[v].values()
                    left -= part
                    ends = [v for v in part if len(near[v]) == 1]
                    at = min(ends or part)
                    c = min(near[at])
                    walk = []
                    while c in near[at] and len(walk) < len(part) - (1 if ends else 0):
                        walk.append((at, near[at][c], c))
                        at, c = near[at][c], a + b - c
                    out[g, a, b, min(part)] = ("path" if ends else "cycle", walk)
    return out


def test_walks(spark):
    """Long paths and cycles, single edges, many colours and graphs without a second colour."""
    rng = random.Random(6)
    edges = []
    for g, (kind, k) in enumerate([("path", 1), ("path", 2), ("path", 257), ("cycle", 4), ("cycle", 256), ("cycle", 90)]):
        names = rng.sample(range(1000), k + 1)
        ring = [(names[i], names[(i + 1) % k if kind == "cycle" else i + 1]) for i in range(k)]
        edges += [(g, min(u, v), max(u, v), 3 + 4 * (i % 2)) for i, (u, v) in enumerate(ring)]
    edges += [(10, u, v, (u + v) % 9) for u in range(9) for v in range(u + 1, 9)] + [(11, 0, 1, 5), (11, 2, 3, 5)]
    got = {}
    for r in kempe.walks(spark.createDataFrame(edges, "graph_id long, u int, v int, color int")).collect():
        got.setdefault((r.graph_id, r["first"], r.second, r.component), []).append((r.position, r.kind, r.tail, r.head, r.color))
    want = brute_walks(edges)
    assert {k: [(i, v[0], *x) for i, x in enumerate(v[1])] for k, v in want.items()} == {k: sorted(v) for k, v in got.items()}
    assert kempe.walks(spark.createDataFrame([], "graph_id long, u int, v int, color int")).count() == 0


def test_ordinals(spark):
    """Dense over uneven partitions, ties and no rows at all."""
    rng = random.Random(1)
    rows = [(7, i) for i in range(500)] + [(rng.randint(0, 50), rng.randint(0, 9)) for _ in range(300)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(5)
    got = ordinals.numbered(df, "a", "b")
    assert [(r.a, r.b) for r in got.orderBy("ordinal").collect()] == sorted(rows) and ordinals.gaps(got, 800).count() == 0
    assert sorted(r.ordinal for r in got.collect()) == list(range(800))
    assert ordinals.numbered(df.limit(0), "a", "b").count() == 0
    down = ordinals.numbered(df, F.desc("a"), F.desc("b"), name="place")
    assert [(r.a, r.b) for r in down.orderBy("place").collect()] == sorted(rows, reverse=True)


def test_shards(spark):
    rows = ordinals.numbered(spark.range(23), "id")
    whole = ordinals.dealt(rows, 4)
    shards = [whole.where(f"shard = {i}") for i in range(4)]
    union = shards[0].union(shards[1]).union(shards[2]).union(shards[3])
    assert ordinals.gaps(union, 23).count() == 0
    assert sorted(map(tuple, ordinals.gaps(union.union(shards[1].where("ordinal = 5")).where("ordinal <> 8"), 23).collect())) == [(5, 2), (8, 0)]
    told = lambda df, **k: {r.shard: (r.units, r.started, r["first"], r["last"], r.status) for r in ordinals.receipts(df, 4, **k).collect()}
    assert told(whole) == {0: (6, 6, 0, 20, "complete"), 1: (6, 6, 1, 21, "complete"), 2: (6, 6, 2, 22, "complete"), 3: (5, 5, 3, 19, "complete")}
    some = ordinals.dealt(rows, 4, 5)
    assert told(some)[0] == (6, 5, 0, 16, "bounded") and told(some)[3] == (5, 5, 3, 19, "complete")
    broke = told(some, failed=F.col("id").isin(6, 20))
    assert [broke[i][4] for i in range(4)] == ["bounded", "bounded", "interrupted", "complete"]
    assert told(whole.limit(0))[2] == (0, 0, None, None, "complete")
