"""Codecs and verifiers on small graphs."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chromaspan.functions import graphs as G
from chromaspan.functions.strict_json import StrictJsonError, loads
from chromaspan.operators import cnf, partitions, verify

SCHEMA = "graph_id long, n int, edges array<struct<u:int,v:int>>"


def frame(spark, *graphs):
    return spark.createDataFrame([(i, n, sorted(e)) for i, (n, e) in enumerate(graphs)], SCHEMA)


def test_graph6_literals(spark):
    rows = frame(spark, (0, []), (1, []), (2, [(0, 1)]), (5, [(0, 2), (0, 4), (1, 3), (3, 4)]), (63, [(0, 62)]))
    got = [r[0] for r in rows.orderBy("graph_id").select(G.graph6(F.col("n"), F.col("edges"))).collect()]
    assert got[:4] == ["?", "@", "A_", "DQc"] and got[4].startswith("~??~")
    back = rows.select("n", "edges", G.from_graph6(G.graph6(F.col("n"), F.col("edges"))).alias("g")).where("n > 0").collect()
    assert all(r.g.n == r.n and r.g.edges == r.edges for r in back)


def test_graph6_rejects(spark):
    bad = ["", "A", "A__", "A`", "B\x7f", "~??A_", "A_ "]
    rows = spark.createDataFrame([(x,) for x in bad], "t string")
    assert all(r[0] is None for r in rows.select(G.from_graph6(F.col("t"))).collect())
    good = spark.createDataFrame([(">>graph6<<A_\n",), ("A_\r\n",)], "t string")
    assert [r[0].n for r in good.select(G.from_graph6(F.col("t"))).collect()] == [2, 2]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)).filter(lambda e: e[0] < e[1]), max_size=20))
def test_round_trips(spark, edges):
    rows = frame(spark, (10, set(edges)))
    doc = G.canonical_json(F.col("n"), F.col("edges"))
    r = rows.select("edges", G.from_graph6(G.graph6(F.col("n"), F.col("edges"))).alias("a"), G.parsed(doc).alias("b"), G.degrees(F.col("n"), F.col("edges")).alias("d")).first()
    assert r.a.edges == r.edges and r.b.edges == r.edges and sum(r.d) == 2 * len(r.edges)


def test_documents_must_be_canonical(spark):
    good = '{"edges":[[0,1]],"order":2,"schema_version":"%s"}' % G.GRAPH_VERSION
    bad = [good.replace('"order":2', '"order": 2'), good.replace("[0,1]", "[1,0]"), good.replace("[0,1]", "[0,2]"), good.replace("[[0,1]]", "[[0,1],[0,1]]"), good[:-1] + ',"x":1}', "{}", ""]
    rows = spark.createDataFrame([(x,) for x in [good, *bad]], "t string").select(G.parsed(F.col("t")).alias("p")).collect()
    assert rows[0].p is not None and all(r.p is None for r in rows[1:])


def test_strict_json():
    assert loads('{"a":[1,null]}') == {"a": [1, None]}
    for text in ('{"a":1,"a":2}', "NaN", "1e999", '"\\ud800"', "[" * 70 + "]" * 70, "9" * 129, "{", "Infinity"):
        try:
            loads(text)
        except StrictJsonError:
            continue
        raise AssertionError(text)


def test_partitions_of_known_graphs(spark):
    c4 = (4, [(0, 1), (1, 2), (2, 3), (0, 3)])
    rows = partitions.auxiliary(partitions.partitions(frame(spark, c4), 2)).orderBy("partition_index").collect()
    assert [([tuple(e) for e in r.pair_edges], r.single_vertices) for r in rows] == [([(0, 2)], [1, 3]), ([(1, 3)], [0, 2])]
    assert all(r.h_n == 5 and len(r.marked) == 3 for r in rows)
    empty = frame(spark, (4, [])).withColumn("k", F.lit(2))
    assert partitions.matchings(empty, "k", 2).count() == 3
    assert partitions.matchings(empty.withColumn("k", F.lit(0)), "k", 2).count() == 1
    assert partitions.matchings(empty.withColumn("k", F.lit(3)), "k", 3).count() == 0


def test_every_issue_code(spark):
    k2 = frame(spark, (2, [(0, 1)]), (3, [(0, 1), (0, 2)]))
    cases = {
        "adjacent_vertices_same_color": ([0, 0], [1]), "incident_vertex_edge_same_color": ([0, 1], [1]), "vertex_assignment_count": ([0], [2]), "edge_assignment_count": ([0, 1], []),
    }

    def codes(row, vc, ec, palette=3, bound="x", mark="x"):
        ints = lambda a: F.lit(a) if a else F.array().cast("array<int>")
        found = verify.total_issues(F.col("n"), F.col("edges"), ints(vc), ints(ec), F.lit(palette), F.lit(bound), F.lit(mark))
        return [x.code for x in k2.where(F.col("graph_id") == row).select(found.alias("x")).first().x]

    assert codes(0, [0, 1], [2]) == []
    for code, (vc, ec) in cases.items():
        assert codes(0, vc, ec) == [code]
    assert codes(0, [0, 1], [2], palette=0) == ["empty_palette"]
    assert codes(0, [0, 1], [2], bound="y") == ["graph_fingerprint_mismatch"]
    assert codes(1, [0, 1, 2], [3, 3]) == ["adjacent_edges_same_color"]


def test_clauses_decode(spark):
    rows = spark.createDataFrame([(2, 2, [(0, 1)], [(0, 1)])], "items int, colours int, conflicts array<struct<i:int,j:int>>, fixed array<struct<item:int,color:int>>")
    c = cnf.clauses(F.col("items"), F.col("colours"), F.col("conflicts"), F.col("fixed"))
    assert rows.select(c.alias("c")).first().c == [[1, 2], [-1, -2], [3, 4], [-3, -4], [-1, -3], [-2, -4], [2]]
    model = lambda m: rows.select(cnf.decode(F.col("items"), F.col("colours"), F.lit(m)).alias("x")).first().x
    assert model([2, 3]) == [1, 0] and model([2]) is None and model([1, 2, 3]) is None


@settings(max_examples=8, deadline=None)
@given(st.integers(2, 7), st.integers(1, 9), st.integers(1, 9), st.integers(1, 9))
def test_counting_verifiers_agree_with_issues(spark, k, a, b, c):
    from chromaspan.sources.families import graphs

    rows = graphs(spark, "/root/testdata/sf0.001", 5, 64).limit(40)
    vc = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda v: ((v * a + 1) % k).cast("int"))
    ec = F.transform("edges", lambda e: ((e["u"] * b + e["v"] * c) % k).cast("int"))
    marked = F.filter(F.sequence(F.lit(0), F.size("edges") - 1), lambda i: i % 4 == 0)
    rows = rows.select("n", "edges", vc.alias("vc"), ec.alias("ec"), marked.alias("m"))
    got = rows.select(
        verify.is_total(F.col("n"), F.col("edges"), F.col("vc"), F.col("ec")).alias("a"), (F.size(verify.total_issues(F.col("n"), F.col("edges"), F.col("vc"), F.col("ec"), F.lit(k))) == 0).alias("b"),
        verify.is_rainbow(F.col("edges"), F.col("ec"), F.lit(k), F.col("m")).alias("c"), (F.size(verify.edge_issues(F.col("n"), F.col("edges"), F.col("ec"), F.lit(k), F.col("m"))) == 0).alias("d")).collect()
    assert all(r.a == r.b and r.c == r.d for r in got)


def test_a_proper_colouring_passes_both(spark):
    rows = frame(spark, (3, [(0, 1), (1, 2)]))
    ok = verify.is_total(F.col("n"), F.col("edges"), F.lit([0, 1, 0]), F.lit([2, 3]))
    assert rows.select(ok).first()[0] and not rows.select(verify.is_total(F.col("n"), F.col("edges"), F.lit([0, 1, 0]), F.lit([2, 2]))).first()[0]
    assert rows.select(verify.is_rainbow(F.col("edges"), F.lit([0, 1]), F.lit(2), F.lit([0, 1]))).first()[0]
