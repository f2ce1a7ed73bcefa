"""Queries over the states that lineitem's graphs on seven vertices have: an edge each is the hole of a total colouring."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators.solve import spread
from .plans import holes
from .queries import ORACLES, family, query
from .sources.families import graphs, shared
from .sources.stored import counted, cut

#: CTEs of the states: free(graph_id, v, c), colours that neither a vertex nor an edge there has, and s(graph_id, x, y, h, alpha).
STATES = f"""{family(7, 8)}, inc AS (SELECT graph_id, u AS a, v AS b, (u + v) % 7 AS c FROM edges UNION ALL SELECT graph_id, v, u, (u + v) % 7 FROM edges),
free AS (SELECT p.graph_id, p.v, CAST(r.c AS INTEGER) AS c FROM vertices p, range(7) r(c) WHERE r.c <> 2 * p.v % 7 AND NOT EXISTS (SELECT 1 FROM inc i WHERE i.graph_id = p.graph_id AND i.a = p.v AND i.c = r.c)),
s AS (SELECT e.graph_id, e.u AS x, e.v AS y, (e.u + e.v) % 7 AS h, min(j.c) AS alpha FROM edges e LEFT JOIN inc i ON i.graph_id = e.graph_id AND i.a = e.u AND i.c <> (e.u + e.v) % 7 LEFT JOIN inc j ON j.graph_id = e.graph_id AND j.a = e.v AND j.c = i.c GROUP BY ALL),
miss AS (SELECT s.graph_id, x, y, f.v, f.c FROM s JOIN free f ON f.graph_id = s.graph_id UNION SELECT graph_id, x, y, x, h FROM s UNION SELECT graph_id, x, y, y, h FROM s)"""
FAN = """fan AS (SELECT graph_id, x, y, x AS center, y AS root, y AS w FROM s UNION ALL SELECT graph_id, x, y, y, x, x FROM s
  UNION SELECT f.graph_id, f.x, f.y, f.center, f.root, i.b FROM fan f JOIN free m ON m.graph_id = f.graph_id AND m.v = f.w JOIN inc i ON i.graph_id = f.graph_id AND i.a = f.center AND i.c = m.c)"""
#: CTEs after start(graph_id, x, y, v, f, g): ended, with the last two vertices of each walk by f, g, f, ... and what holds there.
WALK = """walk AS (SELECT graph_id, x, y, v, f, g, 0 AS len, v AS prev, v AS cur FROM start
  UNION ALL SELECT w.graph_id, w.x, w.y, w.v, w.f, w.g, w.len + 1, w.cur, i.b FROM walk w JOIN inc i ON i.graph_id = w.graph_id AND i.a = w.cur AND i.c = CASE WHEN w.len % 2 = 0 THEN w.f ELSE w.g END WHERE NOT (least(i.a, i.b) = w.x AND greatest(i.a, i.b) = w.y)),
last AS (SELECT graph_id, x, y, v, f, g, CAST(max(len) AS INTEGER) AS length, arg_max(prev, len) AS p, arg_max(cur, len) AS t FROM walk GROUP BY ALL),
lock AS (SELECT *, length > 0 AND 2 * t % 7 = CASE WHEN length % 2 = 1 THEN g ELSE f END AS locked, CAST(p IN (x, y) AS INTEGER) + CAST(t IN (x, y) AS INTEGER) AS open FROM last),
shared AS (SELECT l.graph_id, l.x, l.y, l.v, l.f, l.g, count(*) AS k FROM lock l JOIN miss a ON a.graph_id = l.graph_id AND a.x = l.x AND a.y = l.y AND a.v = l.p JOIN miss b ON b.graph_id = l.graph_id AND b.x = l.x AND b.y = l.y AND b.v = l.t AND b.c = a.c WHERE l.locked GROUP BY ALL),
ended AS (SELECT l.*, CASE WHEN l.locked THEN dp.degree + dt.degree - 5 - CASE WHEN length = 1 THEN 1 ELSE 2 END - open END AS slack, coalesce(k, 0) AS k FROM lock l JOIN deg dp ON dp.graph_id = l.graph_id AND dp.v = l.p JOIN deg dt ON dt.graph_id = l.graph_id AND dt.v = l.t
  LEFT JOIN shared h ON h.graph_id = l.graph_id AND h.x = l.x AND h.y = l.y AND h.v = l.v AND h.f = l.f AND h.g = l.g)"""
CROSS = """pair AS (SELECT a.graph_id, a.x, a.y, a.c AS a, b.c AS b FROM miss a JOIN miss b ON b.graph_id = a.graph_id AND b.x = a.x AND b.y = a.y AND a.v = a.x AND b.v = b.y
  WHERE NOT EXISTS (SELECT 1 FROM miss m WHERE m.graph_id = a.graph_id AND m.x = a.x AND m.y = a.y AND m.v = a.y AND m.c = a.c) AND NOT EXISTS (SELECT 1 FROM miss m WHERE m.graph_id = a.graph_id AND m.x = a.x AND m.y = a.y AND m.v = a.x AND m.c = b.c)),
start AS (SELECT graph_id, x, y, x AS v, b AS f, a AS g FROM pair UNION ALL SELECT graph_id, x, y, y, a, b FROM pair)"""
CROSSED = """SELECT graph_id, x, y, v AS side, f AS "first", g AS "then", CASE WHEN t = x + y - v THEN 'linked' ELSE 'distinct' END AS relation, length, locked, CAST(slack AS INTEGER) AS slack,
  t <> x + y - v AND NOT locked AND 2 * v % 7 <> f AS exit, CAST(CASE WHEN t <> x + y - v AND locked AND length > 1 THEN k ELSE 0 END AS INTEGER) AS releases FROM ended"""
BETA = """special AS (SELECT graph_id, x, y, w AS v FROM fan UNION SELECT graph_id, x, y, x FROM s UNION SELECT graph_id, x, y, y FROM s),
beta AS (SELECT graph_id, x, y, c FROM miss WHERE v IN (x, y) UNION SELECT graph_id, x, y, 2 * x % 7 FROM s UNION SELECT graph_id, x, y, 2 * y % 7 FROM s),
start AS (SELECT s.graph_id, s.x, s.y, p.v, s.alpha AS f, b.c AS g FROM s JOIN beta b ON b.graph_id = s.graph_id AND b.x = s.x AND b.y = s.y JOIN special p ON p.graph_id = s.graph_id AND p.x = s.x AND p.y = s.y
  JOIN miss m ON m.graph_id = s.graph_id AND m.x = s.x AND m.y = s.y AND m.v = p.v AND m.c = b.c WHERE s.alpha IS NOT NULL)"""
BLOCKED = """SELECT e.graph_id, e.x, e.y, e.f AS alpha, e.g AS beta, e.v AS hole, e.length, e.locked AND 2 * e.t % 7 = e.g AS blocked, e.length > 0 AND o.v IS NOT NULL AS linked, CAST(e.slack AS INTEGER) AS slack,
  CAST(CASE WHEN e.locked AND 2 * e.t % 7 = e.g AND e.length > 2 THEN e.k ELSE 0 END AS INTEGER) AS releases FROM ended e LEFT JOIN start o ON o.graph_id = e.graph_id AND o.x = e.x AND o.y = e.y AND o.g = e.g AND o.v = e.t"""


def of_states(spark, sf, work):
    """``work`` of the states of P(7, 8), done once for equal graphs: on seven vertices there are at most 2,097,152."""
    return shared(graphs(spark, sf, 7, 8), lambda rows: work(_states(rows)), store=False)


def hole_states(spark, sf):
    """Every edge of P(7, 8) as the hole of the colouring by sums of labels modulo seven."""
    return _states(graphs(spark, sf, 7, 8))


def _states(rows):
    vertex = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda v: (2 * v % 7).cast("int"))
    edge = F.transform("edges", lambda e: ((e["u"] + e["v"]) % 7).cast("int"))
    rows = spread(rows, "graph_id").select("graph_id", "n", "edges", vertex.alias("vc"), edge.alias("ec"), F.lit(7).alias("palette"))
    return holes.states(rows)


@query(f"""WITH RECURSIVE {STATES}, {FAN},
size AS (SELECT f.graph_id, f.x, f.y, center, root, count(*) - 1 AS k, string_agg(w, ',' ORDER BY w) FILTER (w <> root) AS sats, CAST(sum(5 - CASE WHEN w = root THEN 0 ELSE 1 END - degree) AS INTEGER) AS surplus,
  list_sort(list_distinct(coalesce(list(2 * w % 7) FILTER (w <> root), []))) AS own FROM fan f JOIN deg d ON d.graph_id = f.graph_id AND d.v = f.w GROUP BY ALL)
SELECT z.graph_id, z.x, z.y, z.center, coalesce(sats, '') AS satellites, surplus, own = (SELECT list_sort(list(c)) FROM miss m WHERE m.graph_id = z.graph_id AND m.x = z.x AND m.y = z.y AND m.v = z.center) AS aligned FROM size z""")
def hole_fans(spark, sf):
    return of_states(spark, sf, lambda rows: holes.fans(rows).select("graph_id", "x", "y", "center", F.array_join(F.col("satellites").cast("array<string>"), ",").alias("satellites"), "surplus", "aligned"))


@query(f"WITH RECURSIVE {STATES}, {CROSS}, {WALK} {CROSSED}")
def hole_crossings(spark, sf):
    return of_states(spark, sf, lambda rows: holes.crossings(rows).select("graph_id", "x", "y", "side", "first", "then", "relation", "length", "locked", "slack", "exit", "releases"))


@query(f"WITH RECURSIVE {STATES}, {FAN}, {BETA}, {WALK} {BLOCKED}")
def hole_blockages(spark, sf):
    return of_states(spark, sf, lambda rows: holes.blockages(rows).select("graph_id", "x", "y", "alpha", "beta", "hole", "length", "blocked", "linked", "slack", "releases"))


@query(f"""WITH RECURSIVE {STATES}, {FAN}, across AS (WITH RECURSIVE {CROSS}, {WALK} {CROSSED}), around AS (WITH RECURSIVE {BETA}, {WALK} {BLOCKED}),
c AS (SELECT graph_id, x, y, count(*) FILTER (side = x AND relation = 'linked') AS linked, count(*) FILTER (exit) AS exits, sum(releases) AS cross_releases FROM across GROUP BY ALL),
b AS (SELECT graph_id, x, y, count(*) FILTER (blocked) AS blocked, sum(releases) AS releases FROM around GROUP BY ALL),
v AS (SELECT s.graph_id, s.x, s.y, coalesce(blocked, 0) AS blocked, CAST(coalesce(releases, 0) AS BIGINT) AS releases, coalesce(linked, 0) AS linked, coalesce(exits, 0) AS exits, CAST(coalesce(cross_releases, 0) AS BIGINT) AS cross_releases
  FROM s LEFT JOIN c ON c.graph_id = s.graph_id AND c.x = s.x AND c.y = s.y LEFT JOIN b ON b.graph_id = s.graph_id AND b.x = s.x AND b.y = s.y)
SELECT *, CASE WHEN exits > 0 THEN 'one_swap_exit' WHEN cross_releases > 0 THEN 'cross_terminal_release' WHEN releases > 0 THEN 'alpha_terminal_release' ELSE 'blocked' END AS status FROM v""")
def hole_verdicts(spark, sf):
    """Which way each state has to colour its hole with another colour, by the first that there is."""
    return of_states(spark, sf, lambda rows: holes.verdicts(rows, ["graph_id", "x", "y"]))


@query(f"""WITH {STATES}, top AS (SELECT graph_id, max(degree) AS t, count(*) FILTER (degree = 5) AS k FROM deg GROUP BY graph_id), core AS (SELECT graph_id, v FROM deg WHERE degree = 5),
crowd AS (SELECT DISTINCT graph_id FROM (SELECT c.graph_id, c.v FROM core c JOIN inc i ON i.graph_id = c.graph_id AND i.a = c.v JOIN core d ON d.graph_id = c.graph_id AND d.v = i.b GROUP BY ALL HAVING count(*) > 1)),
sizes AS (SELECT graph_id, x, y, count(*) FILTER (v = x) AS a, count(*) FILTER (v = y) AS b FROM miss GROUP BY ALL)
SELECT s.graph_id, s.x, s.y, t.t <> 5 AS off_degree, NOT (dx.degree = 5 AND dy.degree = 5) AS off_core, w.graph_id IS NOT NULL AS crowded, z.a <> 2 OR z.b <> 2 AS no_pairs FROM s JOIN top t ON t.graph_id = s.graph_id
JOIN deg dx ON dx.graph_id = s.graph_id AND dx.v = s.x JOIN deg dy ON dy.graph_id = s.graph_id AND dy.v = s.y JOIN sizes z ON z.graph_id = s.graph_id AND z.x = s.x AND z.y = s.y LEFT JOIN crowd w ON w.graph_id = s.graph_id""")
def hole_scope(spark, sf):
    """The residue's profile on the table's states: four of the codes, as columns."""
    codes = {"off_degree": "maximum_degree_mismatch", "off_core": "hole_edge_not_in_degree_core", "crowded": "degree_core_not_matching", "no_pairs": "endpoint_missing_sets_not_pairs"}
    return of_states(spark, sf, lambda rows: holes.scope_issues(rows).select("graph_id", "x", "y", *[F.array_contains("issues", code).alias(c) for c, code in codes.items()]))


@query()
def hole_orbits(spark, sf):
    """For each state that no single move helps: exits by two swaps that give the hole another colour than it had, how many of
    their first swaps part ends that were in one component, and the least exit.  Tested by a search of its own instead of SQL."""
    key = ["graph_id", "x", "y"]
    had = (F.col("x") + F.col("y")) % 7
    move = F.array("first_a", "first_b", "first_at", "second_a", "second_b", "then_at", "fill")

    def work(rows):
        stuck = cut(holes.verdicts(rows, key).where("status = 'blocked'").select(*key), "stuck").hint("merge")
        exits = holes.orbit_exits(spread(rows.join(stuck, key, "left_semi"), *key)).where(F.col("fill") != had)
        found = exits.groupBy(*key).agg(F.count("*").alias("exits"), F.count_if("detached").alias("detached"), F.min(move).alias("least"))
        least = F.array_join(F.col("least").cast("array<string>"), ",")
        return stuck.join(found, key, "left").select(*key, F.coalesce("exits", F.lit(0)).alias("exits"), F.coalesce("detached", F.lit(0)).alias("detached"), least.alias("least"))

    return of_states(spark, sf, work)


WAYS = ["one_swap_exit", "cross_terminal_release", "alpha_terminal_release", "blocked"]
SUMS = ["blocked", "releases", "linked", "exits", "cross_releases"]


@query(f"""SELECT count(*) AS states, {', '.join(f"count(*) FILTER (status = '{w}') AS status_{w}" for w in WAYS)}, {', '.join(f'CAST(sum({c}) AS BIGINT) AS sum_{c}, count(*) FILTER ({c} > 0) AS with_{c}' for c in SUMS)} FROM ({ORACLES['hole_verdicts']})""")
def hole_counters(spark, sf):
    """Counters of all states, observed by the job that stores the verdicts."""
    found = hole_verdicts(spark, sf)
    wanted = {"states": F.count("*")} | {f"status_{w}": F.count_if(F.col("status") == w) for w in WAYS}
    for c in SUMS:
        wanted |= {f"sum_{c}": F.sum(c), f"with_{c}": F.count_if(F.col(c) > 0)}
    _, seen = counted(found, "verdicts", **wanted)
    return spark.createDataFrame([tuple(seen.get(c) for c in wanted)], ", ".join(f"{c} long" for c in wanted))
