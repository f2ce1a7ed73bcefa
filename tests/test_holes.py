"""States with one uncoloured edge: the DataFrame plans against the known states and a search of its own."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from chromaspan.plans import holes as H
from chromaspan.plans import paired_hole as P
from chromaspan.queries import QUERIES
from chromaspan.queries_holes import hole_states
from chromaspan.sources.stored import counted

SF = "/root/testdata/sf0.001"
SCHEMA = "name string, n int, edges array<struct<u:int,v:int>>, vc array<int>, ec array<int>, palette int, r int, x int, y int, alpha int"


def table(spark, parsed):
    rows = [(k, s.n, s.edges, s.vc, s.ec, s.palette, s.r, s.x, s.y, s.alpha) for k, s in parsed.items()]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumn("at", H.adjacency(F.col("n"), F.col("edges"), F.col("ec"), F.col("palette")))


@pytest.fixture(scope="module")
def known(spark):
    return table(spark, {k: P.parse(d) for k, d in P.STATES.items()})


def test_known_states(known):
    found = {r["name"]: tuple(r)[1:] for r in H.verdicts(known, ["name"]).collect()}
    assert found == {
        "sharp": (12, 0, 0, 4, 0, "one_swap_exit"), "hard_residual": (12, 0, 2, 0, 0, "blocked"),
        "cross_cross_residual": (12, 0, 2, 0, 0, "blocked"), "nonaligned_release": (12, 6, 1, 0, 3, "cross_terminal_release"),
    }
    fans = {(r["name"], r.center): (r.satellites, r.surplus, r.aligned) for r in H.fans(known).collect()}
    assert all(fans[k, v] == ([2, 3] if v == 0 else [4, 5], 0, k != "nonaligned_release") for k, v in fans) and len(fans) == 8
    assert all(r.slack >= 0 for r in H.crossings(known).where("locked AND size(common) = 0").collect())


def test_scope_codes(spark):
    s = P.parse(P.STATES["sharp"])
    wide, off = P.parse(P.STATES["sharp"]), P.parse(P.STATES["sharp"])
    wide.palette, off.r = 8, 4
    got = {r["name"]: r.issues for r in H.scope_issues(table(spark, {"good": s, "wide": wide, "off": off})).collect()}
    assert got["good"] == []
    assert got["wide"][0] == "palette_not_r_plus_two" and "endpoint_missing_sets_not_pairs" in got["wide"]
    assert {"palette_not_r_plus_two", "maximum_degree_mismatch", "hole_edge_not_in_degree_core", "fan_surplus_not_zero", "degree_parameter_below_two_sided_minimum"} <= set(got["off"])


def brute_exits(s):
    """All two-swap exits of a state given as plain values, by searching edge sets."""
    color = {e: c for e, c in zip(s["edges"], s["ec"], strict=True) if c is not None}
    hole, vc, p = (s["x"], s["y"]), s["vc"], s["palette"]

    def free(col, v):
        return {c for c in range(p) if c != vc[v] and all(v not in e or k != c for e, k in col.items())}

    def parts(col, a, b):
        left, out = {e for e, c in col.items() if c in (a, b)}, []
        while left:
            part = {left.pop()}
            while more := {e for e in left if any(set(e) & set(f) for f in part)}:
                part |= more
                left -= more
            out.append(part)
        return out

    def proper(col):
        ends = Counter((v, c) for e, c in col.items() for v in e)
        return max(ends.values(), default=1) == 1 and all(vc[v] != c for v, c in ends)

    def swap(col, part, a, b):
        return {e: (a + b - c if e in part else c) for e, c in col.items()}

    x, y = hole
    mx, my = free(color, x), free(color, y)
    across = {(a, b) for a in mx for b in my if a != b}
    firsts = across | {(s["alpha"], c) for c in {vc[x], vc[y]} | mx | my if c != s["alpha"]}
    out = set()
    for one in firsts:
        for part in parts(color, *one):
            once = swap(color, part, *one)
            if not proper(once):
                continue
            for two in across:
                if len(set(one) & set(two)) != 1:
                    continue
                for second in parts(once, *two):
                    if not {x, y} & {v for e in second for v in e}:
                        continue
                    twice = swap(once, second, *two)
                    if proper(twice):
                        for fill in free(twice, x) & free(twice, y):
                            out.add((*one, min(min(e) for e in part), *two, min(min(e) for e in second), fill))
    return out


MOVE = ["first_a", "first_b", "first_at", "second_a", "second_b", "then_at", "fill"]


def test_two_swaps_find_all_that_a_search_finds(spark, known):
    some = hole_states(spark, SF).where("graph_id < 3 AND alpha IS NOT NULL")
    rows = [r.asDict() | {"id": (r.graph_id, r.x, r.y)} for r in some.collect()]
    got = {}
    for r in H.orbit_exits(some).collect():
        got.setdefault((r.graph_id, r.x, r.y), []).append(tuple(r[c] for c in MOVE))
    for r in rows:
        r["edges"] = [tuple(e) for e in r["edges"]]
        mine = got.get(r["id"], [])
        assert len(mine) == len(set(mine)) and set(mine) == brute_exits(r), r["id"]
    exits = H.orbit_exits(known).collect()
    for name, d in P.STATES.items():
        s = P.parse(d)
        want = brute_exits({"edges": s.edges, "ec": s.ec, "x": s.x, "y": s.y, "vc": s.vc, "palette": s.palette, "alpha": s.alpha})
        assert want and {tuple(r[c] for c in MOVE) for r in exits if r["name"] == name} == want
    assert all(r.detached for r in exits if r["name"] == "hard_residual")


def test_stuck_states_are_those_of_the_verdicts(spark):
    stuck = QUERIES["hole_verdicts"](spark, SF).where("status = 'blocked'")
    rows = QUERIES["hole_orbits"](spark, SF)
    assert rows.count() == stuck.count() > 0
    assert rows.where("detached > exits OR (exits = 0) <> (least IS NULL)").count() == 0


def test_states_without_edges_or_alpha(spark):
    schema = "graph_id long, n int, edges array<struct<u:int,v:int>>, vc array<int>, ec array<int>, palette int"
    rows = [(1, 3, [], [0, 1, 2], [], 5), (2, 2, [(0, 1)], [0, 1], [2], 3)]
    found = H.states(spark.createDataFrame(rows, schema))
    assert [(r.graph_id, r.x, r.y, r.alpha, r.ec) for r in found.collect()] == [(2, 0, 1, None, [None])]
    assert H.blockages(found).count() == 0
    # Colour 1 is missing at x alone and is y's own, colour 0 the other way round: no walk and no exit.
    assert sorted((r.side, r.first, r.length, r.locked, r.exit) for r in H.crossings(found).collect()) == [(0, 0, 0, False, False), (1, 1, 0, False, False)]
    assert [tuple(r)[1:] for r in H.verdicts(found, ["graph_id"]).collect()] == [(0, 0, 0, 0, 0, "blocked")]
    assert H.verdicts(found.where("false"), ["graph_id"]).count() == 0


def test_counters_are_those_of_a_second_pass(spark):
    rows = spark.range(0, 1000, 1, 7).withColumn("odd", F.col("id") % 2 == 1)
    stored, seen = counted(rows.repartition(5, "id"), "rows", rows=F.count("*"), odd=F.count_if("odd"), total=F.sum("id"))
    again = stored.agg(F.count("*").alias("rows"), F.count_if("odd").alias("odd"), F.sum("id").alias("total")).first()
    assert seen == again.asDict() == {"rows": 1000, "odd": 500, "total": 499500}
