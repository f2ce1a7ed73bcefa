"""Models of clauses that are decoded and verified, and the table function of matchings."""

import itertools

from pyspark.sql import functions as F

from chromaspan.operators import cnf
from chromaspan.sources.table_functions import register

SCHEMA = "i int, n int, edges array<struct<u:int,v:int>>, colours int, model array<int>"


def model(colouring, k):
    return [(1 if c == x else -1) * (1 + i * k + x) for i, c in enumerate(colouring) for x in range(k)]


def test_models(spark):
    path = [(0, 1), (1, 2)]
    cases = [
        ((3, path, 3, model([0, 1, 0, 2, 2], 3)), "improper"), ((3, path, 4, model([0, 1, 0, 2, 3], 4)), "verified"), ((3, path, 4, model([0, 0, 1, 2, 3], 4)), "improper"), ((3, path, 4, model([0, 1, 0, 2, 1], 4)), "improper"),
        ((3, path, 4, model([0, 1, 0, 2], 4)), "undecodable"), ((3, path, 4, [*model([0, 1, 0, 2, 3], 4), 2]), "undecodable"), ((3, path, 4, []), "undecodable"), ((3, path, 4, None), "undecodable"), ((1, [], 1, [1]), "verified"), ((2, [(0, 1)], 3, [2, 4, 9]), "verified"),
    ]
    df = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], SCHEMA)
    got = {r.i: r.v for r in df.select("i", cnf.judged(F.col("n"), F.col("edges"), F.col("colours"), F.col("model")).alias("v")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_matchings_with_lateral(spark):
    register(spark)
    graphs = [(0, 5, [(0, 1), (2, 3)], 2), (1, 4, [], 2), (2, 4, list(itertools.combinations(range(4), 2)), 1), (3, 4, [], 0), (4, 4, [], -1), (5, None, [], 1), (6, 4, None, 1), (7, 4, [], None), (8, 4, [], 3)]
    rows = spark.createDataFrame(graphs, "g int, n int, edges array<struct<u:int,v:int>>, k int")
    found = spark.sql("SELECT g, m.* FROM {r} r, LATERAL complement_matchings(n, edges, k) m", r=rows).collect()
    want = []
    for g, n, edges, k in graphs[:4]:
        free = [e for e in itertools.combinations(range(n), 2) if e not in edges]
        matched = [x for x in itertools.combinations(range(len(free)), k) if len({v for i in x for v in free[i]}) == 2 * k]
        want += [(g, i, list(x), sorted(v for j in x for v in free[j])) for i, x in enumerate(matched)]
    assert sorted(map(tuple, found)) == sorted(want) and len(want) > 10
    pairs = spark.sql("SELECT m.idx FROM complement_matchings(3, array(array(1, 0)), 1) m").collect()
    assert [r.idx for r in pairs] == [[0], [1]]
