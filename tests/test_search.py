"""Searches that stop early, their limits and claims; problems; the universe of graphs; validators."""

from itertools import combinations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from chromaspan.functions import certificates as C
from chromaspan.functions import graphs as G
from chromaspan.functions import text as X
from chromaspan.operators import partitions as P
from chromaspan.operators import problems as M
from chromaspan.operators import search as S
from chromaspan.operators.solvers import fixed_order, saturation
from chromaspan.plans import census
from chromaspan.sources import universe as U
from chromaspan.sources.families import graphs

SCHEMA = "graph_id long, n int, edges array<struct<u:int,v:int>>"
C4 = [(0, 1), (0, 3), (1, 2), (2, 3)]


@pytest.fixture(scope="module")
def c4(spark):
    return spark.createDataFrame([(0, 4, C4), (1, 4, [(0, 1)])], SCHEMA)


def test_too_low_a_bound_raises(c4):
    """A graph whose matchings are longer than the bound must never look like one without any."""
    for run in (lambda: P.partitions(c4, 0).collect(), lambda: census.universal(c4, 0).collect(), lambda: census.existential(c4, 0).collect()):
        with pytest.raises(PySparkException, match="more than the 0 allowed"):
            run()
    assert P.partitions(c4).count() == P.partitions(c4, 1).count() == 2
    assert census.existential(c4).where("graph_id = 0").first().status == census.existential(c4, 1).where("graph_id = 0").first().status == "witness"


def test_nine_pairs_are_found(spark):
    """A star of ten rays beside nine single vertices: more pairs than a bound once written down."""
    rows = spark.createDataFrame([(0, 20, [(0, v) for v in range(1, 11)])], SCHEMA)
    found = census.search(rows, max_nodes=1000).first()
    assert (found.status, found.first_partition, found.started) == ("witness", 0, 1) and len(found.witness.pair_edges) == 9


def test_search_stops_and_counts(c4):
    one = lambda run, *a, **k: run(c4, *a, **k).where("graph_id = 0").first()
    assert tuple(one(census.search, 0))[1:8] == ("candidate_unsat", None, 2, 0, 2, 0, False)
    assert tuple(one(census.search, 1))[1:8] == ("witness", 0, 1, 1, 0, 0, False)
    assert tuple(one(census.check_all, 0))[1:8] == ("candidate_unsat", None, 1, 0, 1, 0, False)
    assert tuple(one(census.check_all, 1))[1:8] == ("witness", 0, 2, 2, 0, 0, False)
    assert one(census.search, 0, max_partitions=1).status == one(census.check_all, 1, max_partitions=1).status == "unknown"
    assert one(census.search, 0, max_partitions=2).status == "candidate_unsat"
    assert one(census.search, 1, max_nodes=1).status == one(census.search, 1, max_seconds=0.0).status == "unknown"
    assert census.search(c4).where("graph_id = 1").first().status == "skipped"


def test_no_partition_is_an_error(spark, c4, monkeypatch):
    none = spark.createDataFrame([(0, 4, C4, 3, -1, [], [], "empty", None, 0, 0)], S.KIND)
    monkeypatch.setattr(census, "searched", lambda *a, **k: none)
    for run in (census.search, census.check_all):
        assert run(c4).where("graph_id = 0").first().status == "error"


@pytest.mark.parametrize("claim", [None, [], [0] * 6, [0, 1, 2, 0, 1, 9]])
def test_a_refuted_witness_is_an_error(spark, c4, monkeypatch, claim):
    rows = spark.createDataFrame([(0, 4, C4, 3, 0, [(0, 2)], [1, 3], "witness", claim, 1, 0)], S.KIND)
    monkeypatch.setattr(census, "searched", lambda *a, **k: rows)
    assert census.search(c4).where("graph_id = 0").first().status == "error"


def test_time_limits():
    conflicts = list(combinations(range(12), 2))
    for kernel in (saturation, fixed_order):
        assert kernel.search(12, 11, conflicts, max_seconds=0.0)[0] == "unknown"
        assert kernel.search(12, 12, conflicts, max_seconds=60.0)[0] == "witness"


def test_lazy_matchings_in_order():
    pairs = list(combinations(range(6), 2))
    for free in (pairs, pairs[::2], pairs[:5], []):
        for size in range(4):
            want = [list(x) for x in combinations(free, size) if len({v for e in x for v in e}) == 2 * size]
            assert list(S.lazily(free, size)) == want


def test_kernel_s_problem_is_the_columns_problem(spark):
    rows = P.problem(P.auxiliary(P.partitions(graphs(spark, "/root/testdata/sf0.001", 6, 4).limit(60))), F.lit(1)).collect()
    assert rows
    for r in rows:
        items, conflicts, fixed = S.problem(r.n, [tuple(e) for e in r.edges], [tuple(e) for e in r.pair_edges], list(r.single_vertices))
        assert (items, conflicts, fixed) == (r["items"], [tuple(c) for c in r.conflicts], [tuple(f) for f in r.fixed])


def test_order_mismatch_is_an_error(c4):
    got = {r.graph_id: (r.status, r.outcome_code) for r in census.universal(c4, order=5).collect()}
    assert got == {0: ("error", "generator_order_mismatch"), 1: ("error", "generator_order_mismatch")}


def test_edge_problems(spark):
    rows = spark.createDataFrame([(0, 4, C4, [(1, 0), (2, 3)], 3)], SCHEMA + ", some array<struct<u:int,v:int>>, k int")
    made = M.edge_problem(rows, "k", "some", True).first()
    assert (made["items"], made.marked, [tuple(f) for f in made.fixed]) == (4, [0, 3], [(0, 0), (3, 1)]) and (0, 3) in [tuple(c) for c in made.conflicts]
    assert M.edge_problem(rows, "k").first().groups == []
    for bad in ({"some": F.array(F.struct(F.lit(0).alias("u"), F.lit(2).alias("v")))}, {"some": F.flatten(F.array("some", "some"))}, {"k": F.lit(1)}, {"k": F.lit(0)}):
        with pytest.raises(PySparkException):
            M.edge_problem(rows.withColumns(bad), "k", "some").collect()


def test_faults_of_problems(spark):
    kind = f"items int, colours int, conflicts {M.CONFLICTS}, fixed {M.FIXED}, groups {M.GROUPS}"
    rows = {
        (): (3, 2, [(0, 1), (1, 2)], [(0, 1)], [[0, 2]]), ("colours",): (1, 0, [], [], []), ("conflict_range",): (2, 2, [(0, 5)], [], []), ("conflict_order",): (3, 2, [(1, 2), (0, 1)], [], []), ("fixed_range",): (2, 2, [], [(0, 2)], []),
        ("fixed_order",): (2, 2, [], [(0, 0), (0, 1)], []), ("group_range",): (2, 2, [], [], [[0]]), ("group_order",): (3, 2, [], [], [[1, 0]]),
    }
    made = spark.createDataFrame(list(rows.values()), kind)
    got = made.select(M.faults(F.col("items"), F.col("colours"), F.col("conflicts"), F.col("fixed"), F.col("groups")).alias("f")).collect()
    assert [tuple(r.f) for r in got] == list(rows)


def test_faults_of_graphs(spark):
    rows = {(): [(0, 1), (1, 2)], ("loop",): [(1, 1)], ("orientation",): [(2, 1)], ("range",): [(0, 9)], ("repeated",): [(0, 1), (0, 1)], ("order",): [(1, 2), (0, 1)], ("orientation", "repeated", "order"): [(1, 0), (0, 1)]}
    made = spark.createDataFrame([(e,) for e in rows.values()], "edges array<struct<u:int,v:int>>")
    assert [tuple(r.f) for r in made.select(G.faults(F.lit(3), F.col("edges")).alias("f")).collect()] == list(rows)


def test_universe_by_shards(spark):
    spark.dataSource.register(U.GraphUniverse)
    read = lambda **o: spark.read.format("graph_universe").options(**o).load()
    named = lambda df: sorted((r.graph_id, tuple(map(tuple, r.edges))) for r in df.collect())
    whole = named(read(order="7"))
    assert len(whole) == 1044 == len({i for i, _ in whole})
    assert named(read(order="7", shards="5")) == whole
    assert sorted(x for i in range(3) for x in named(read(order="7", shards="3", shard=str(i)))) == whole
    pairs = {e: k for k, e in enumerate(U._pairs(7))}
    assert len({U.certificate(sum(1 << pairs[e] for e in edges), 7) for _, edges in whole}) == 1044
    assert read(order="7", split="3", shards="4").count() == 1044 and read(order="0").count() == 1
    assert read(order="7", connected="true").count() == 853
    for bad in ({"order": "10"}, {"order": "4", "shards": "0"}, {"order": "4", "shards": "2", "shard": "2"}, {"order": "4", "split": "5"}):
        with pytest.raises(Exception):  # noqa: B017  Spark wraps the error of a data source
            read(**bad).count()


def test_certificates_of_graphs_ignore_labels():
    import random

    rng = random.Random(1)
    pairs = {e: k for k, e in enumerate(U._pairs(7))}
    for _ in range(60):
        mask, order = rng.getrandbits(21), rng.sample(range(7), 7)
        moved = sum(1 << pairs[tuple(sorted((order[u], order[v])))] for (u, v), k in pairs.items() if mask >> k & 1)
        assert U.certificate(mask, 7) == U.certificate(moved, 7)


def test_texts_end_where_they_end(spark):
    good = {X.is_stable_url: "https://a.example/x", X.is_sha256: "a" * 64, X.is_canonical_utc: "2024-01-31T00:00:00Z", X.is_safe_path: "a/b.c"}
    for test, text in good.items():
        rows = spark.createDataFrame([(text,), (text + "\n",), (text + "\x01",), ("\n" + text,), (None,)], "t string")
        assert [r.ok for r in rows.select(test(F.col("t")).alias("ok")).collect()] == [True, False, False, False, False]
    rows = spark.createDataFrame([("1.0.0",), ("1.0.0\n",), ("1.0.0-1\n",), ("1.0.0-a",)], "t string")
    assert [r.ok for r in rows.select(X.semver_key(F.col("t")).isNotNull().alias("ok")).collect()] == [True, False, False, True]


def test_strict_certificates():
    made = C.make("0" * 64, 3, [0, 1], [2])
    assert C.parse(C.text_of(made)) == made and len(C.fingerprint(made)) == 64
    for change in ({"extra": 1}, {"palette_size": True}, {"palette_size": 2}, {"edge_colors": [-1]}, {"edge_colors": "2"}, {"graph_fingerprint": "A" * 64}, {"kind": "x"}, {"schema_version": "v0"}):
        with pytest.raises(C.CertificateError):
            C.checked(made | change)
    for text in ("[]", C.text_of(made)[:-1], C.text_of(made).replace('"kind"', '"kind":"total-coloring","kind"', 1), '{"kind":"total-coloring"}'):
        with pytest.raises(C.CertificateError):
            C.parse(text)
