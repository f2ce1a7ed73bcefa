"""Queries over the supplied tables and, beside each, DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import graphs as G
from .operators import canonical, cnf, partitions, problems, verify
from .operators.solve import solve, spread
from .plans import census, completeness, dependency
from .plans import counting, cuts, ordinals
from .sources.families import edges, graphs, merged, shared
from .sources.stored import cut, new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

EMPTY = "array<struct<item:int,color:int>>"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def family(n: int, k: int) -> str:
    """CTEs edges(graph_id, edge_index, u, v), vertices(graph_id, v), deg(graph_id, v, degree)."""
    return f"""edges AS (SELECT *, CAST(row_number() OVER (PARTITION BY graph_id ORDER BY u, v) - 1 AS INTEGER) AS edge_index FROM (
  SELECT DISTINCT l_orderkey // {k} AS graph_id, CAST(least(l_partkey % {n}, l_suppkey % {n}) AS INTEGER) AS u, CAST(greatest(l_partkey % {n}, l_suppkey % {n}) AS INTEGER) AS v
  FROM lineitem WHERE l_partkey % {n} <> l_suppkey % {n})),
vertices AS (SELECT graph_id, CAST(t.v AS INTEGER) AS v FROM (SELECT DISTINCT graph_id FROM edges), range({n}) t(v)),
deg AS (SELECT x.graph_id, x.v, CAST(count(e.u) AS INTEGER) AS degree FROM vertices x LEFT JOIN edges e ON e.graph_id = x.graph_id AND (e.u = x.v OR e.v = x.v) GROUP BY ALL)"""


P8, P6 = family(8, 8), family(6, 4)
FREE = "free AS (SELECT a.graph_id, a.v AS u, b.v FROM vertices a JOIN vertices b ON a.graph_id = b.graph_id AND a.v < b.v ANTI JOIN edges e ON e.graph_id = a.graph_id AND e.u = a.v AND e.v = b.v)"


def free(n: int) -> str:
    return """free AS (SELECT a.graph_id, a.v AS u, b.v AS v, CAST(row_number() OVER (PARTITION BY a.graph_id ORDER BY a.v, b.v) - 1 AS INTEGER) AS i FROM vertices a JOIN vertices b ON a.graph_id = b.graph_id AND a.v < b.v
  LEFT JOIN edges e ON e.graph_id = a.graph_id AND e.u = a.v AND e.v = b.v WHERE e.u IS NULL)"""


def eligible(n: int) -> str:
    return f"""top AS (SELECT graph_id, max(degree) AS t FROM deg GROUP BY graph_id),
prof AS (SELECT graph_id, t + 1 AS d, {n} - t - 1 AS pairs, 2 * (t + 1) - {n} AS singles,
  CASE WHEN 2 * t < {n} THEN 'outside_high_degree_filter' WHEN t + 1 > {n} OR {n} > 2 * (t + 1) THEN 'outside_auxiliary_regime' ELSE '' END AS outcome FROM top)"""


def matched(n: int) -> str:
    """CTE m(graph_id, idx, k): matchings of the complement, and parts(graph_id, idx): those of full size."""
    rounds = ["m0 AS (SELECT graph_id, CAST([] AS INTEGER[]) AS idx, CAST([] AS INTEGER[]) AS used FROM prof WHERE outcome = '')"]
    for k in range(1, n // 2 + 1):
        rounds.append(f"m{k} AS (SELECT m.graph_id, list_append(m.idx, f.i) AS idx, list_concat(m.used, [f.u, f.v]) AS used FROM m{k - 1} m JOIN free f ON f.graph_id = m.graph_id AND f.i > coalesce(m.idx[-1], -1) AND NOT list_contains(m.used, f.u) AND NOT list_contains(m.used, f.v))")
    every = " UNION ALL ".join(f"SELECT graph_id, idx, used FROM m{k}" for k in range(n // 2 + 1))
    return ",\n".join(rounds) + f",\nparts AS (SELECT m.graph_id, m.idx, m.used, CAST(row_number() OVER (PARTITION BY m.graph_id ORDER BY m.idx) - 1 AS INTEGER) AS partition_index, p.d, p.pairs, p.singles FROM ({every}) m JOIN prof p ON p.graph_id = m.graph_id AND len(m.idx) = p.pairs)"


def _matchings6() -> list[tuple[int, int]]:
    """(edges, vertices) as masks of all matchings of six vertices; edge u < v has bit v (v - 1) / 2 + u."""
    out, waiting = [], [(0, 0, 0)]
    pairs = [(u, v) for v in range(6) for u in range(v)]
    while waiting:
        e, x, k = waiting.pop()
        out.append((e, x))
        waiting += [(e | 1 << i, x | 1 << u | 1 << v, i + 1) for i, (u, v) in enumerate(pairs) if i >= k and not x >> u & 1 and not x >> v & 1]
    return sorted(out)


#: CTEs mt(e, x), the matchings of six vertices, and av(x, e), the edges that no vertex of x is on.
TABLES6 = f"""mt(e, x) AS (VALUES {', '.join(map(str, _matchings6()))}),
av(x, e) AS (SELECT CAST(m.i AS INTEGER), CAST(coalesce(sum(1 << CAST(v.i * (v.i - 1) // 2 + u.i AS INTEGER)) FILTER (u.i < v.i AND (m.i >> u.i) & 1 = 0 AND (m.i >> v.i) & 1 = 0), 0) AS INTEGER) FROM range(64) m(i), range(6) u(i), range(6) v(i) GROUP BY m.i),
masks AS (SELECT graph_id, CAST(sum(1 << CAST(v * (v - 1) // 2 + u AS INTEGER)) AS INTEGER) AS rem FROM edges GROUP BY graph_id)"""


def extends6(name: str, source: str, offset: int) -> str:
    """CTE name(graph_id, p, ok): whether the vertex classes of each row of source(graph_id, p, d, classes)
    extend to a total colouring with d + offset colours.

    A search by itself, colour by colour: a colour's edges are a matching off its class, without loss
    a largest one among the edges left; states are the sets of edges left."""
    steps = [f"{name}0 AS (SELECT s.graph_id, p, d + {offset} AS k, classes, rem FROM {source} s JOIN masks USING (graph_id))"]
    for c in range(9):
        steps.append(f"""{name}{c + 1} AS (SELECT DISTINCT graph_id, p, k, classes, rem & ~m.e AS rem FROM {name}{c} s JOIN mt m ON m.e & s.rem = m.e AND m.x & coalesce(classes[{c + 1}], 0) = 0 JOIN av ON av.x = m.x | coalesce(classes[{c + 1}], 0) AND av.e & s.rem = 0 WHERE {c} < k AND rem > 0
  UNION SELECT * FROM {name}{c} WHERE {c} >= k OR rem = 0)""")
    return ",\n".join([*steps, f"{name} AS (SELECT graph_id, p, bool_or(rem = 0) AS ok FROM {name}9 GROUP BY ALL)"])


# --- graphs ---------------------------------------------------------------


@query(f"WITH {P8} SELECT graph_id, v, degree FROM deg")
def graph_degrees(spark, sf):
    rows = graphs(spark, sf, 8, 8)
    return rows.select("graph_id", F.posexplode(G.degrees(F.col("n"), F.col("edges"))).alias("v", "degree"))


@query(f"""WITH {P8} SELECT graph_id, 8 AS vertices, CAST(sum(degree) // 2 AS INTEGER) AS size, min(degree) AS min_degree, max(degree) AS max_degree, min(degree) = max(degree) AS is_regular FROM deg GROUP BY graph_id""")
def graph_regularity(spark, sf):
    d = G.degrees(F.col("n"), F.col("edges"))
    return graphs(spark, sf, 8, 8).select("graph_id", F.col("n").alias("vertices"), F.size("edges").alias("size"), F.array_min(d).alias("min_degree"), F.array_max(d).alias("max_degree"), (F.size(F.array_distinct(d)) <= 1).alias("is_regular"))


@query(f"""WITH {P8} SELECT graph_id, sha256('{{"edges":[' || string_agg('[' || u || ',' || v || ']', ',' ORDER BY u, v) || '],"order":8,"schema_version":"{G.GRAPH_VERSION}"}}') AS fingerprint FROM edges GROUP BY graph_id""")
def graph_fingerprint(spark, sf):
    return graphs(spark, sf, 8, 8).select("graph_id", G.fingerprint(F.col("n"), F.col("edges")).alias("fingerprint"))


@query(f"""WITH {P8} SELECT graph_id, CAST(count(*) AS INTEGER) AS size FROM edges GROUP BY graph_id""")
def graph_document_roundtrip(spark, sf):
    rows = graphs(spark, sf, 8, 8).select("graph_id", "edges", G.parsed(G.canonical_json(F.col("n"), F.col("edges"))).alias("p"))
    return rows.where(F.col("p.edges") == F.col("edges")).select("graph_id", F.size("p.edges").alias("size"))


GRAPH6 = f"""WITH {P8}, bits AS (SELECT g.graph_id, b.k, max(CASE WHEN e.u IS NULL THEN 0 ELSE 1 END) AS x
  FROM (SELECT DISTINCT graph_id FROM edges) g, range(30) b(k) LEFT JOIN edges e ON e.graph_id = g.graph_id AND e.v * (e.v - 1) // 2 + e.u = b.k GROUP BY ALL),
letters AS (SELECT graph_id, k // 6 AS j, chr(CAST(63 + sum(x * (32 >> (k % 6))) AS INTEGER)) AS c FROM bits GROUP BY ALL)
"""


@query(GRAPH6 + "SELECT graph_id, chr(71) || string_agg(c, '' ORDER BY j) AS graph6 FROM letters GROUP BY graph_id")
def graph6_encode(spark, sf):
    return graphs(spark, sf, 8, 8).select("graph_id", G.graph6(F.col("n"), F.col("edges")).alias("graph6"))


@query(f"WITH {P8} SELECT graph_id, 8 AS vertices, u, v FROM edges")
def graph6_decode(spark, sf):
    rows = graphs(spark, sf, 8, 8).select("graph_id", G.graph6(F.col("n"), F.col("edges")).alias("t"))
    return rows.select("graph_id", G.from_graph6(F.col("t")).alias("g")).select("graph_id", F.col("g.n").alias("vertices"), F.explode("g.edges").alias("e")).select("graph_id", "vertices", "e.u", "e.v")


@query("""WITH e AS (SELECT DISTINCT l_orderkey // 8 AS graph_id, least(l_partkey % 8, l_suppkey % 8) AS u, greatest(l_partkey % 8, l_suppkey % 8) AS v FROM lineitem WHERE l_partkey % 8 <> l_suppkey % 8)
SELECT graph_id, CAST(u AS INTEGER) AS u, CAST(v AS INTEGER) AS v FROM (SELECT g.graph_id, a.x AS u, b.x AS v FROM (SELECT DISTINCT graph_id FROM e) g, range(8) a(x), range(8) b(x) WHERE a.x < b.x EXCEPT SELECT graph_id, u, v FROM e)""")
def complement_edges(spark, sf):
    return graphs(spark, sf, 8, 8).select("graph_id", F.explode(G.complement(F.col("n"), F.col("edges"))).alias("e")).select("graph_id", "e.u", "e.v")


RAW = "raw AS (SELECT l_orderkey // 8 AS graph_id, CAST(l_partkey % 8 AS INTEGER) AS u, CAST(l_suppkey % 8 AS INTEGER) AS v, row_number() OVER (PARTITION BY l_orderkey // 8 ORDER BY l_orderkey, l_linenumber) AS i FROM lineitem)"


@query(f"""WITH {RAW}, near AS (SELECT *, lag(u) OVER w AS pu, lag(v) OVER w AS pv FROM raw WINDOW w AS (PARTITION BY graph_id ORDER BY i))
SELECT graph_id, concat_ws(',', CASE WHEN bool_or(u = v) THEN 'loop' END, CASE WHEN bool_or(u > v) THEN 'orientation' END, CASE WHEN count(DISTINCT least(u, v) * 8 + greatest(u, v)) < count(*) THEN 'repeated' END, CASE WHEN bool_or(pu > u OR pu = u AND pv > v) THEN 'order' END) AS faults FROM near GROUP BY graph_id""")
def graph_faults(spark, sf):
    """What keeps the table's own pairs, in its order, from being canonical graphs."""
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.expr("l_orderkey div 8").alias("graph_id"), F.struct("l_orderkey", "l_linenumber", F.struct((F.col("l_partkey") % 8).cast("int").alias("u"), (F.col("l_suppkey") % 8).cast("int").alias("v")).alias("e")).alias("x"))
    listed = rows.groupBy("graph_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["e"]).alias("edges"))
    return listed.select("graph_id", F.array_join(G.faults(F.lit(8), F.col("edges")), ",").alias("faults"))


@query(f"""WITH {P8}, arcs AS (SELECT graph_id, u AS a, v AS b, edge_index FROM edges UNION ALL SELECT graph_id, v, u, edge_index FROM edges)
SELECT x.graph_id, x.v, coalesce(string_agg(b, ',' ORDER BY b), '') AS neighbours, coalesce(string_agg(edge_index, ',' ORDER BY edge_index), '') AS incident, coalesce(bool_or(b = 0), false) AS joins_0 FROM vertices x LEFT JOIN arcs ON arcs.graph_id = x.graph_id AND a = x.v GROUP BY ALL""")
def vertex_neighbours(spark, sf):
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    rows = graphs(spark, sf, 8, 8).select("graph_id", "edges", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("v"))
    return rows.select("graph_id", "v", text(G.neighbours(F.col("v"), F.col("edges"))).alias("neighbours"), text(G.incident_edges(F.col("v"), F.col("edges"))).alias("incident"), G.has_edge(F.col("v"), F.lit(0), F.col("edges")).alias("joins_0"))


@query(f"WITH {P8} SELECT graph_id, CAST(least((3 * u + 1) % 8, (3 * v + 1) % 8) AS INTEGER) AS u, CAST(greatest((3 * u + 1) % 8, (3 * v + 1) % 8) AS INTEGER) AS v FROM edges")
def relabel_edges(spark, sf):
    permutation = F.lit([(3 * v + 1) % 8 for v in range(8)])
    return graphs(spark, sf, 8, 8).select("graph_id", F.explode(G.relabel(F.col("edges"), permutation)).alias("e")).select("graph_id", "e.u", "e.v")


CORE = "core AS (SELECT e.graph_id, e.u, e.v FROM edges e JOIN (SELECT graph_id, max(degree) AS t FROM deg GROUP BY graph_id) m USING (graph_id) JOIN deg a ON a.graph_id = e.graph_id AND a.v = e.u AND a.degree = t JOIN deg b ON b.graph_id = e.graph_id AND b.v = e.v AND b.degree = t)"


@query(f"WITH {P8}, {CORE} SELECT graph_id, u, v FROM core")
def core_edges(spark, sf):
    return graphs(spark, sf, 8, 8).select("graph_id", F.explode(G.core(F.col("n"), F.col("edges"))).alias("e")).select("graph_id", "e.u", "e.v")


@query(f"""WITH RECURSIVE {P8}, {CORE},
arcs AS (SELECT graph_id, u AS a, v AS b FROM core UNION ALL SELECT graph_id, v, u FROM core),
reach AS (SELECT graph_id, a AS s, a AS x FROM arcs UNION SELECT r.graph_id, r.s, c.b FROM reach r JOIN arcs c ON c.graph_id = r.graph_id AND c.a = r.x),
parts AS (SELECT graph_id, count(DISTINCT s) AS k, count(DISTINCT lo) AS c FROM (SELECT graph_id, s, min(x) AS lo FROM reach GROUP BY ALL) GROUP BY graph_id),
one AS (SELECT graph_id, max(k) AS most FROM (SELECT graph_id, a, count(*) AS k FROM arcs GROUP BY ALL) GROUP BY graph_id),
near AS (SELECT e.graph_id, e.a, e.b, (SELECT count(*) FROM (SELECT u AS p, v AS q, graph_id FROM edges UNION ALL SELECT v, u, graph_id FROM edges) l JOIN deg d ON d.graph_id = l.graph_id AND d.v = l.q
   WHERE l.graph_id = e.graph_id AND l.p = e.a AND l.q <> e.b AND d.degree = (SELECT max(degree) - 1 FROM deg z WHERE z.graph_id = e.graph_id)) AS k FROM arcs e),
two AS (SELECT graph_id, max(CASE WHEN k >= 2 AND k2 >= 2 THEN 1 ELSE 0 END) AS ok FROM (SELECT x.graph_id, x.k, y.k AS k2 FROM near x JOIN near y ON y.graph_id = x.graph_id AND y.a = x.b AND y.b = x.a) GROUP BY graph_id)
SELECT g.graph_id, p.k IS NOT NULL AS any_nonempty, coalesce((SELECT count(*) FROM core c WHERE c.graph_id = g.graph_id) = p.k - p.c, false) AS forest_nonempty,
  coalesce(most = 1, false) AS matching_nonempty, coalesce(most = 1 AND ok = 1, false) AS two_sided
FROM (SELECT DISTINCT graph_id FROM edges) g LEFT JOIN parts p USING (graph_id) LEFT JOIN one USING (graph_id) LEFT JOIN two USING (graph_id)""")
def in_scope_classes(spark, sf):
    from .plans.matching_core import scopes

    return scopes(graphs(spark, sf, 8, 8))


# --- problems and clauses -------------------------------------------------

CONFLICTS = """inc AS (SELECT graph_id, edge_index, u AS x FROM edges UNION ALL SELECT graph_id, edge_index, v FROM edges),
conf AS (SELECT graph_id, u AS i, v AS j FROM edges UNION ALL SELECT graph_id, x, 6 + edge_index FROM inc
  UNION ALL SELECT a.graph_id, 6 + a.edge_index, 6 + b.edge_index FROM inc a JOIN inc b ON a.graph_id = b.graph_id AND a.x = b.x AND a.edge_index < b.edge_index)"""


@query(f"WITH {P6}, {CONFLICTS} SELECT graph_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j FROM conf")
def total_conflicts(spark, sf):
    return graphs(spark, sf, 6, 4).select("graph_id", F.explode(G.conflicts(F.col("n"), F.col("edges"))).alias("c")).select("graph_id", "c.i", "c.j")


@query("""WITH e AS (SELECT DISTINCT l_orderkey // 8 AS graph_id, least(l_partkey % 8, l_suppkey % 8) AS u, greatest(l_partkey % 8, l_suppkey % 8) AS v FROM lineitem WHERE l_partkey % 8 <> l_suppkey % 8),
k AS (SELECT graph_id, u, v, CAST(row_number() OVER (PARTITION BY graph_id ORDER BY u, v) - 1 AS INTEGER) AS at FROM e)
SELECT a.graph_id, a.at AS i, b.at AS j FROM k a JOIN k b ON a.graph_id = b.graph_id AND a.at < b.at AND (a.u = b.u OR a.u = b.v OR a.v = b.u OR a.v = b.v)""")
def edge_conflicts(spark, sf):
    return graphs(spark, sf, 8, 8).select("graph_id", F.explode(G.line_conflicts(F.col("edges"))).alias("c")).select("graph_id", "c.i", "c.j")


def _total_problem(rows, extra):
    rows = spread(rows, "graph_id")
    d = F.array_max(G.degrees(F.col("n"), F.col("edges")))
    return rows.select("graph_id", "n", "edges", (F.col("n") + F.size("edges")).alias("items"), (d + extra).cast("int").alias("colours"), G.conflicts(F.col("n"), F.col("edges")).alias("conflicts"), F.array().cast(EMPTY).alias("fixed"))


@query(f"""WITH {P6}, {CONFLICTS}, base AS (SELECT graph_id, 6 + (SELECT count(*) FROM edges e WHERE e.graph_id = t.graph_id) AS items, t.k, (SELECT count(*) FROM conf c WHERE c.graph_id = t.graph_id) AS c FROM (SELECT graph_id, max(degree) + 2 AS k FROM deg GROUP BY graph_id) t)
SELECT graph_id, CAST(items * k AS INTEGER) AS variables, CAST(items + items * k * (k - 1) // 2 + c * k AS INTEGER) AS clauses, CAST(items AS INTEGER) AS at_least, CAST(items * k * (k - 1) // 2 AS INTEGER) AS at_most FROM base""")
def cnf_clause_counts(spark, sf):
    def work(rows):
        rows = _total_problem(rows, 2)
        found = cnf.clauses(F.col("items"), F.col("colours"), F.col("conflicts"), F.col("fixed"))
        rows = rows.select("graph_id", "items", "colours", F.size(found).alias("clauses"), F.size("conflicts").alias("c"))
        return rows.select("graph_id", (F.col("items") * F.col("colours")).alias("variables"), "clauses", F.col("items").alias("at_least"), (F.col("clauses") - F.col("items") - F.col("c") * F.col("colours")).alias("at_most"))

    return shared(graphs(spark, sf, 6, 4), work)


@query(f"""WITH {P6}, {CONFLICTS}, k AS (SELECT graph_id, max(degree) + 2 AS k FROM deg GROUP BY graph_id), items AS (SELECT graph_id, v AS i FROM vertices UNION ALL SELECT graph_id, 6 + edge_index FROM edges),
cl AS (SELECT graph_id, 1 AS a, i AS b, 0 AS c, 0 AS d, 0 AS e, array_to_string(list_transform(range(k), lambda x: 1 + i * k + x), ' ') AS t FROM items JOIN k USING (graph_id)
  UNION ALL SELECT graph_id, 1, i, 1, p.x, q.x, (-(1 + i * k + p.x)) || ' ' || (-(1 + i * k + q.x)) FROM items JOIN k USING (graph_id), range(20) p(x), range(20) q(x) WHERE p.x < q.x AND q.x < k
  UNION ALL SELECT graph_id, 2, i, j, p.x, 0, (-(1 + i * k + p.x)) || ' ' || (-(1 + j * k + p.x)) FROM conf JOIN k USING (graph_id), range(20) p(x) WHERE p.x < k),
body AS (SELECT graph_id, count(*) AS n, string_agg(t || ' 0', chr(10) ORDER BY a, b, c, d, e) AS t FROM cl GROUP BY graph_id),
digest AS (SELECT graph_id, sha256('{{"color_count":' || any_value(k) || ',"conflicts":[' || string_agg('[' || i || ',' || j || ']', ',' ORDER BY i, j) || '],"fixed_colors":[],"item_count":' || (6 + (SELECT count(*) FROM edges e WHERE e.graph_id = conf.graph_id)) || ',"schema_version":1}}') AS h FROM conf JOIN k USING (graph_id) GROUP BY graph_id)
SELECT graph_id, h AS problem_digest, sha256('c encoder {cnf.ENCODER}' || chr(10) || 'c problem_sha256 ' || h || chr(10) || 'p cnf ' || (6 + (SELECT count(*) FROM edges e WHERE e.graph_id = body.graph_id)) * k || ' ' || n || chr(10) || t || chr(10)) AS dimacs_sha256
FROM body JOIN k USING (graph_id) JOIN digest USING (graph_id)""")
def cnf_dimacs_digest(spark, sf):
    pairs = F.transform("conflicts", lambda c: F.array(c["i"], c["j"]))
    document = F.to_json(F.struct(F.col("colours").alias("color_count"), pairs.alias("conflicts"), F.array().cast("array<array<int>>").alias("fixed_colors"), F.col("items").alias("item_count"), F.lit(1).alias("schema_version")))

    def work(rows):
        rows = _total_problem(rows, 2).withColumn("problem_digest", F.sha2(document, 256)).withColumn("cl", cnf.clauses(F.col("items"), F.col("colours"), F.col("conflicts"), F.col("fixed")))
        return rows.select("graph_id", "problem_digest", F.sha2(cnf.dimacs(F.col("items"), F.col("colours"), F.col("cl"), F.col("problem_digest")), 256).alias("dimacs_sha256"))

    return shared(graphs(spark, sf, 6, 4), work)


@query(f"""WITH {P6} SELECT graph_id, max(degree) + 3 AS colours, CASE graph_id % 4 WHEN 0 THEN 'undecodable' WHEN 1 THEN 'undecodable' WHEN 2 THEN 'improper' ELSE 'verified' END AS verdict FROM deg GROUP BY graph_id""")
def cnf_model_verdicts(spark, sf):
    """Models of total problems, decoded and verified; by graph_id modulo 4 the first item has a second colour or
    none, or all ends of the first edge have the colour of its lesser one.

    Equal graphs are solved once, and their models judged once for each of the four rules."""
    k, rule = F.col("palette"), lambda i: F.col("rule") == i
    first = F.get("edges", F.lit(0))
    told = F.transform("assignment", lambda c, i: F.when(rule(2) & (i == first["v"]), F.get("assignment", first["u"])).otherwise(c))
    model = F.flatten(F.transform(told, lambda c, i: F.transform(F.sequence(F.lit(0), k - 1), lambda x: F.when(x == c, 1).otherwise(-1) * (1 + i * k + x))))
    model = F.when(rule(0), F.concat(F.filter(model, lambda x: F.abs(x) > k), F.sequence(F.lit(1), F.lit(2)))).when(rule(1), F.filter(model, lambda x: F.abs(x) > k)).otherwise(model)

    def work(rows):
        found = solve(_total_problem(rows, 3).withColumn("palette", F.col("colours")), "dsatur-iterative-v1")
        found = found.withColumn("rule", F.explode(F.array(*map(F.lit, range(4)))))
        return found.select("graph_id", "rule", k.alias("colours"), cnf.judged(F.col("n"), F.col("edges"), k, model).alias("verdict"))

    return shared(graphs(spark, sf, 6, 4), work).where(F.col("graph_id") % 4 == F.col("rule")).drop("rule")


def _edge_digest(fixed: bool) -> str:
    """SQL of edge problems with 12 colours and every third edge distinguished."""
    pins = "coalesce((SELECT string_agg('[' || edge_index || ',' || r || ']', ',' ORDER BY edge_index) FROM marked m WHERE m.graph_id = g.graph_id), '')" if fixed else "''"
    return f"""WITH {P6}, inc AS (SELECT graph_id, edge_index, u AS x FROM edges UNION ALL SELECT graph_id, edge_index, v FROM edges),
marked AS (SELECT graph_id, edge_index, row_number() OVER (PARTITION BY graph_id ORDER BY edge_index) - 1 AS r FROM edges WHERE edge_index % 3 = 0),
own AS (SELECT DISTINCT a.graph_id, a.edge_index AS i, b.edge_index AS j FROM inc a JOIN inc b ON a.graph_id = b.graph_id AND a.x = b.x AND a.edge_index < b.edge_index),
every AS (SELECT * FROM own UNION SELECT a.graph_id, a.edge_index, b.edge_index FROM marked a JOIN marked b ON a.graph_id = b.graph_id AND a.edge_index < b.edge_index),
g AS (SELECT graph_id, count(*) AS n, string_agg('"edge:' || u || '-' || v || '"', ',' ORDER BY edge_index) AS names FROM edges GROUP BY graph_id),
pair AS (SELECT graph_id, coalesce((SELECT string_agg('[' || i || ',' || j || ']', ',' ORDER BY i, j) FROM every e WHERE e.graph_id = g.graph_id), '') AS a, coalesce((SELECT string_agg('[' || i || ',' || j || ']', ',' ORDER BY i, j) FROM own e WHERE e.graph_id = g.graph_id), '') AS b,
  (SELECT CASE WHEN count(*) > 1 THEN '[' || string_agg(edge_index, ',' ORDER BY edge_index) || ']' ELSE '' END FROM marked m WHERE m.graph_id = g.graph_id) AS grp, {pins} AS pins FROM g),
sem AS (SELECT graph_id, sha256('{{"color_count":12,"conflicts":[' || a || '],"fixed_colors":[' || pins || '],"item_count":' || n || ',"schema_version":1}}') AS h FROM g JOIN pair USING (graph_id))
SELECT graph_id, h AS semantic_digest, sha256('{{"all_different":[' || grp || '],"explicit_conflicts":[' || b || '],"item_names":[' || names || '],"metadata":{{"kind":"rainbow_edge_coloring"}},"schema_version":1,"semantic_digest":"' || h || '"}}') AS representation_digest FROM g JOIN pair USING (graph_id) JOIN sem USING (graph_id)"""


def _edge_problem(spark, sf, fix):
    rows = graphs(spark, sf, 6, 4).withColumn("twelve", F.lit(12)).withColumn("some", F.filter("edges", lambda e, i: i % 3 == 0))
    rows = problems.edge_problem(rows, "twelve", "some", fix)
    semantic = problems.semantic_digest(F.col("items"), F.col("colours"), F.col("conflicts"), F.col("fixed"))
    rows = rows.withColumn("semantic_digest", semantic)
    told = {"kind": F.lit("rainbow_edge_coloring")}
    return rows.select("graph_id", "semantic_digest", problems.representation_digest(problems.edge_names(F.col("edges")), F.col("explicit"), F.col("groups"), F.col("semantic_digest"), told).alias("representation_digest"))


@query(_edge_digest(False))
def edge_problem_digests(spark, sf):
    return _edge_problem(spark, sf, False)


@query(_edge_digest(True))
def pinned_edge_problem_digests(spark, sf):
    return _edge_problem(spark, sf, True)


# --- verifiers on a synthetic colouring ------------------------------------


def _synthetic(spark, sf, k):
    vertex = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda v: ((v * 7 + 3) % k).cast("int"))
    edge = F.transform("edges", lambda e: ((e["u"] * 5 + e["v"] * 3) % k).cast("int"))
    return graphs(spark, sf, 8, 8).select("graph_id", "n", "edges", vertex.alias("vc"), edge.alias("ec"))


COLOURED = "vc AS (SELECT graph_id, v, (v * 7 + 3) % {k} AS c FROM vertices), ec AS (SELECT *, (u * 5 + v * 3) % {k} AS c FROM edges), inc AS (SELECT graph_id, edge_index, u, v, c, u AS x, 0 AS o FROM ec UNION ALL SELECT graph_id, edge_index, u, v, c, v, 1 FROM ec)"
FIRST = "first AS (SELECT *, first_value(edge_index) OVER w AS fi, first_value(u) OVER w AS fu, first_value(v) OVER w AS fv, row_number() OVER w AS rn FROM inc WINDOW w AS (PARTITION BY graph_id, x, c ORDER BY edge_index))"


@query(f"""WITH {P8}, {COLOURED.format(k=7)}, {FIRST}, iss AS (
SELECT e.graph_id, 1 AS a, e.edge_index AS b, 0 AS o, 'adjacent_vertices_same_color' AS code, 'edges[' || e.edge_index || ']' AS path, 'adjacent vertices ' || u || ' and ' || e.v || ' share a color' AS message FROM ec e JOIN vc p ON p.graph_id = e.graph_id AND p.v = e.u JOIN vc q ON q.graph_id = e.graph_id AND q.v = e.v WHERE p.c = q.c
UNION ALL SELECT i.graph_id, 1, i.edge_index, 1 + o, 'incident_vertex_edge_same_color', 'edge_colors[' || i.edge_index || ']', 'edge (' || i.u || ', ' || i.v || ') shares a color with endpoint ' || x FROM inc i JOIN vc p ON p.graph_id = i.graph_id AND p.v = i.x AND p.c = i.c
UNION ALL SELECT graph_id, 2, edge_index, o, 'adjacent_edges_same_color', 'edge_colors[' || edge_index || ']', 'incident edges (' || fu || ', ' || fv || ') and (' || u || ', ' || v || ') share color ' || c || ' at vertex ' || x FROM first WHERE rn > 1)
SELECT graph_id, CAST(row_number() OVER (PARTITION BY graph_id ORDER BY a, b, o) - 1 AS INTEGER) AS seq, code, path, message FROM iss""")
def verify_total_issues(spark, sf):
    rows = _synthetic(spark, sf, 7)
    found = verify.total_issues(F.col("n"), F.col("edges"), F.col("vc"), F.col("ec"), F.lit(7))
    return rows.select("graph_id", F.posexplode(found).alias("seq", "x")).select("graph_id", "seq", "x.code", "x.path", "x.message")


@query(f"""WITH {P8}, {COLOURED.format(k=7)}, {FIRST}, marked AS (SELECT graph_id, edge_index, c, first_value(edge_index) OVER w AS fi, row_number() OVER w AS rn FROM ec WHERE edge_index % 3 = 0 WINDOW w AS (PARTITION BY graph_id, c ORDER BY edge_index))
SELECT graph_id, 'edges ' || fi || ' and ' || edge_index || ' incident with vertex ' || x || ' both use color ' || c AS issue FROM first WHERE rn > 1
UNION ALL SELECT graph_id, 'distinguished edges ' || fi || ' and ' || edge_index || ' both use color ' || c FROM marked WHERE rn > 1""")
def verify_edge_issues(spark, sf):
    rows = _synthetic(spark, sf, 7)
    marked = F.filter(F.sequence(F.lit(0), F.size("edges") - 1), lambda i: i % 3 == 0)
    return rows.select("graph_id", F.explode(verify.edge_issues(F.col("n"), F.col("edges"), F.col("ec"), F.lit(7), marked)).alias("issue"))


@query(f"WITH {P8}, {COLOURED.format(k=7)}, {FIRST} SELECT graph_id, CAST(x AS INTEGER) AS vertex, CAST(c AS INTEGER) AS color, CAST(fi AS INTEGER) AS first_edge, CAST(edge_index AS INTEGER) AS edge FROM first WHERE rn > 1")
def first_conflict_window(spark, sf):
    from pyspark.sql import Window

    long = edges(graphs(spark, sf, 8, 8)).withColumn("color", (F.col("u") * 5 + F.col("v") * 3) % 7)
    inc = long.select("graph_id", "edge_index", "color", F.explode(F.array("u", "v")).alias("vertex"))
    w = Window.partitionBy("graph_id", "vertex", "color").orderBy("edge_index")
    return inc.withColumn("first_edge", F.first("edge_index").over(w)).withColumn("rn", F.row_number().over(w)).where("rn > 1").select("graph_id", "vertex", "color", "first_edge", F.col("edge_index").alias("edge"))


@query(f"WITH {P6}, {CONFLICTS}, item AS (SELECT graph_id, v AS i FROM vertices UNION ALL SELECT graph_id, 6 + edge_index FROM edges) SELECT g.graph_id, count(c.i) FILTER ((c.i * 5 + 2) % 7 = (c.j * 5 + 2) % 7) AS conflicts FROM (SELECT DISTINCT graph_id FROM item) g LEFT JOIN conf c USING (graph_id) GROUP BY g.graph_id")
def assignment_conflict_counts(spark, sf):
    """Conflicts of total problems whose two items share a colour under a colouring by a rule."""
    def work(rows):
        rows = _total_problem(rows, 3).withColumn("assignment", F.transform(F.sequence(F.lit(0), F.col("items") - 1), lambda i: (i * 5 + 2) % 7))
        return rows.select("graph_id", verify.assignment_conflicts(rows).cast("long").alias("conflicts"))

    return shared(graphs(spark, sf, 6, 4), work)


@query(f"WITH {P8}, {COLOURED.format(k=3)} SELECT graph_id, bool_and(p.c <> q.c) AS proper FROM ec e JOIN vc p USING (graph_id) JOIN vc q USING (graph_id) WHERE p.v = e.u AND q.v = e.v GROUP BY graph_id")
def proper_vertex_colouring(spark, sf):
    rows = _synthetic(spark, sf, 3)
    return rows.select("graph_id", F.forall("edges", lambda e: F.get("vc", e["u"]) != F.get("vc", e["v"])).alias("proper"))


# --- kernels --------------------------------------------------------------


@query(f"""WITH {P6} SELECT graph_id, 6 AS vertices, CAST(sum(degree) // 2 AS INTEGER) AS size, max(degree) AS max_degree, max(degree) + 3 AS palette, 'witness' AS status, 0 AS violations FROM deg GROUP BY graph_id""")
def total_coloring_violations(spark, sf):
    vertex, edge = F.slice("assignment", 1, F.col("n")), F.expr("slice(assignment, n + 1, size(edges))")
    issues = verify.total_issues(F.col("n"), F.col("edges"), vertex, edge, F.col("palette"))

    def work(rows):
        found = solve(_total_problem(rows, 3).withColumn("palette", F.col("colours")), "dsatur-iterative-v1")
        return found.select("graph_id", F.col("n").alias("vertices"), F.size("edges").alias("size"), (F.col("palette") - 3).alias("max_degree"), "palette", "status", F.size(issues).alias("violations"))

    return shared(graphs(spark, sf, 6, 4), work)


@query(f"WITH {P6} SELECT graph_id, true AS agree FROM edges GROUP BY graph_id")
def solvers_agree(spark, sf):
    spec = F.explode(F.array(F.lit("dsatur-iterative-v1"), F.lit("static-order-iterative-v1"))).alias("backend")

    def work(rows):
        found = solve(_total_problem(rows, 1).select("*", spec))
        return found.groupBy("graph_id").agg((F.count_distinct("status") == 1).alias("agree"))

    return shared(graphs(spark, sf, 6, 4), work)


# --- partitions and censuses ----------------------------------------------


@query(f"WITH {P6}, {eligible(6)} SELECT graph_id, outcome, CAST(d AS INTEGER) AS d, CAST(pairs AS INTEGER) AS pairs, CAST(singles AS INTEGER) AS singles FROM prof")
def equitable_profile(spark, sf):
    return partitions.profile(graphs(spark, sf, 6, 4)).select("graph_id", "outcome", "d", "pairs", "singles")


@query(f"WITH {P6}, {free(6)}, {eligible(6)}, {matched(6)} SELECT graph_id, partition_index, array_to_string(list_sort(used), ',') AS covered, array_to_string(idx, ',') AS idx FROM parts")
def complement_matchings(spark, sf):
    rows = partitions.partitions(graphs(spark, sf, 6, 4), 3)
    free_edges = G.complement(F.col("n"), F.col("edges"))
    covered = F.sort_array(F.flatten(F.transform("pair_edges", lambda e: F.array(e["u"], e["v"]))))
    idx = F.transform("pair_edges", lambda e: (F.array_position(free_edges, e) - 1).cast("string"))
    return rows.select("graph_id", "partition_index", F.array_join(F.transform(covered, lambda x: x.cast("string")), ",").alias("covered"), F.array_join(idx, ",").alias("idx"))


@query(f"WITH {P6}, {free(6)}, {eligible(6)}, {matched(6)} SELECT graph_id, partition_index, array_to_string(list_sort(used), ',') AS covered, array_to_string(idx, ',') AS idx FROM parts")
def complement_matchings_lateral(spark, sf):
    """The rows of complement_matchings by a table function called with LATERAL."""
    from .sources.table_functions import register

    register(spark)
    rows = partitions.profile(graphs(spark, sf, 6, 4)).where("outcome = ''").select("graph_id", "n", "edges", "pairs")
    return spark.sql("SELECT g.graph_id, m.partition_index, array_join(m.covered, ',') AS covered, array_join(m.idx, ',') AS idx FROM {g} g, LATERAL complement_matchings(g.n, g.edges, g.pairs) m", g=spread(rows, "graph_id"))


@query(f"WITH {P6}, {free(6)}, {eligible(6)}, {matched(6)} SELECT graph_id, count(*) AS enumerated, count(*) AS counted FROM parts GROUP BY graph_id")
def partition_counts(spark, sf):
    def work(rows):
        listed = partitions.partitions(rows, 3).groupBy("graph_id").agg(F.count("*").alias("enumerated"))
        prof = spread(partitions.profile(rows).where("outcome = ''"), "graph_id")
        summed = prof.select("graph_id", partitions.counted(6, G.complement(F.col("n"), F.col("edges")), F.col("pairs")).alias("counted"))
        return listed.join(summed, "graph_id").select("graph_id", "enumerated", "counted")

    return shared(graphs(spark, sf, 6, 4), work)


@query(f"WITH {P8}, {free(8)}, {eligible(8)}, {matched(8)} SELECT p.graph_id, count(m.graph_id) AS counted FROM prof p LEFT JOIN parts m USING (graph_id) WHERE outcome = '' GROUP BY p.graph_id")
def merged_partition_counts(spark, sf):
    """Equitable partitions of graphs of eight vertices, counted by states that merge."""
    rows = partitions.profile(graphs(spark, sf, 8, 8)).where("outcome = ''")
    return partitions.merged_counts(rows, "pairs", 8)


ORDINALS = f"WITH {P6}, {free(6)}, {eligible(6)}, {matched(6)}, o AS (SELECT graph_id, partition_index, row_number() OVER (ORDER BY graph_id, partition_index) - 1 AS ordinal FROM parts)"


def _units(spark, sf):
    """A unit of work for each equitable partition, in order, and the seven shards that bounded searches take."""
    units = partitions.partitions(graphs(spark, sf, 6, 4), 3).select("graph_id", "partition_index")
    return ordinals.dealt(ordinals.numbered(units, "graph_id", "partition_index"), 7, 100)


@query(ORDINALS + " SELECT graph_id, partition_index, ordinal, CAST(ordinal % 7 AS INTEGER) AS shard, ordinal // 7 < 100 AS started FROM o")
def search_ordinals(spark, sf):
    return _units(spark, sf)


@query(ORDINALS + """ SELECT CAST(s.i AS INTEGER) AS shard, count(ordinal) AS units, count(ordinal) FILTER (ordinal // 7 < 100) AS started, min(ordinal) FILTER (ordinal // 7 < 100) AS "first", max(ordinal) FILTER (ordinal // 7 < 100) AS "last",
CASE WHEN count(ordinal) > 100 THEN 'bounded' ELSE 'complete' END AS status FROM range(7) s(i) LEFT JOIN o ON ordinal % 7 = s.i GROUP BY s.i""")
def search_receipts(spark, sf):
    return ordinals.receipts(_units(spark, sf), 7)


@query(f"""WITH {P6}, {free(6)}, {eligible(6)}, {matched(6)} SELECT graph_id, partition_index, CAST(6 + (singles > 0)::INTEGER AS INTEGER) AS h_vertices, CAST((SELECT count(*) FROM edges e WHERE e.graph_id = parts.graph_id) + d AS INTEGER) AS h_edges, CAST(d AS INTEGER) AS marked, CAST(d AS INTEGER) AS h_max_degree FROM parts""")
def aux_invariants(spark, sf):
    def work(rows):
        rows = partitions.auxiliary(partitions.partitions(rows, 3))
        rows = rows.withColumn("h_max_degree", F.array_max(G.degrees(F.col("h_n"), F.col("h_edges")))).withColumn("size", F.size("h_edges"))
        return rows.select("graph_id", "partition_index", F.col("h_n").alias("h_vertices"), F.col("size").alias("h_edges"), F.size("marked").alias("marked"), "h_max_degree")

    return shared(graphs(spark, sf, 6, 4), work)


CLASSES = """list_concat([(1 << used[2 * i + 1]) | (1 << used[2 * i + 2]) for i in range(len(used) // 2)], [1 << v for v in range(6) if NOT list_contains(used, v)])"""
PARTS6 = f"WITH {P6}, {free(6)}, {eligible(6)}, {matched(6)}, {TABLES6}, cls AS (SELECT graph_id, partition_index AS p, d, CAST({CLASSES} AS INTEGER[]) AS classes FROM parts)"


def checked6(wanted: list[tuple[str, int]]) -> str:
    """PARTS6 with checks(graph_id, p, b, o, status) of the wanted (backend, offset), searched in SQL."""
    offsets = sorted({o for _, o in wanted})
    rows = " UNION ALL ".join(f"SELECT graph_id, p, '{b}' AS b, {o} AS o, CASE WHEN ok THEN 'witness' ELSE 'candidate_unsat' END AS status FROM ext{o}_" for b, o in wanted)
    return ",\n".join([PARTS6, *(extends6(f"ext{o}_", "cls", o) for o in offsets), f"checks AS ({rows})"])


UNIVERSAL = """ SELECT p.graph_id, CASE WHEN outcome <> '' THEN 'skipped' WHEN k IS NULL THEN 'error' WHEN failures > 0 THEN 'candidate_unsat' ELSE 'verified_all' END AS status,
  CASE WHEN outcome <> '' THEN outcome WHEN k IS NULL THEN 'empty_check_transcript' WHEN failures > 0 THEN 'candidate_partition_nonextension' ELSE 'verified_all_partitions' END AS outcome_code,
  coalesce(k, 0) AS partitions, coalesce(n, 0) AS checks, coalesce(n - failures, 0) AS witnesses
FROM prof p LEFT JOIN (SELECT graph_id, count(DISTINCT p) AS k, count(*) AS n, count(*) FILTER (status <> 'witness') AS failures FROM checks GROUP BY graph_id) c USING (graph_id)"""
THREE = [("dsatur-iterative-v1", 1), ("static-order-iterative-v1", 1), ("dsatur-iterative-v1", 2)]
TIGHT = [("dsatur-iterative-v1", 0), ("static-order-iterative-v1", 0)]


def _existential(offset: int) -> str:
    return checked6([("dsatur-iterative-v1", offset)]) + """ SELECT p.graph_id, CASE WHEN outcome <> '' THEN 'skipped' WHEN first IS NOT NULL THEN 'witness' WHEN c.graph_id IS NULL THEN 'error' ELSE 'candidate_unsat' END AS status, first AS first_partition
FROM prof p LEFT JOIN (SELECT graph_id, CAST(min(p) FILTER (status = 'witness') AS INTEGER) AS first FROM checks GROUP BY graph_id) c USING (graph_id)"""


@query(_existential(2))
def existential_census_status(spark, sf):
    return shared(graphs(spark, sf, 6, 4), lambda rows: census.existential(rows, 3))


@query(_existential(0))
def existential_tight_palette(spark, sf):
    """Palette offset 0, where some graphs have no partition that extends."""
    return shared(graphs(spark, sf, 6, 4), lambda rows: census.existential(rows, 3, offset=0))


@query(checked6(THREE) + UNIVERSAL)
def universal_census_status(spark, sf):
    return census.by_class(graphs(spark, sf, 6, 4), 3).drop("class_id")


#: The least of the 720 relabelings of each edge set of six vertices, as a mask.
LEAST6 = """places AS (SELECT row_number() OVER () AS p, [a, b, c, d, e, f] AS to_ FROM range(6) a(a), range(6) b(b), range(6) c(c), range(6) d(d), range(6) e(e), range(6) f(f) WHERE len(list_distinct([a, b, c, d, e, f])) = 6),
bits AS (SELECT p, v * (v - 1) // 2 + u AS k, greatest(to_[u + 1], to_[v + 1]) AS y, least(to_[u + 1], to_[v + 1]) AS x FROM places, range(6) u(u), range(6) v(v) WHERE u < v),
masks AS (SELECT graph_id, CAST(sum(1 << CAST(v * (v - 1) // 2 + u AS INTEGER)) AS INTEGER) AS m FROM edges GROUP BY graph_id),
moved AS (SELECT m, p, sum(1 << CAST(y * (y - 1) // 2 + x AS INTEGER)) AS r FROM (SELECT DISTINCT m FROM masks) JOIN bits ON (m >> CAST(k AS INTEGER)) & 1 = 1 GROUP BY m, p),
least6 AS (SELECT m, min(r) AS r FROM moved GROUP BY m)"""


#: CTE codecs(graph_id, graph6, fingerprint) of six vertices.
GRAPH6_OF_SIX = f"""codecs AS (SELECT graph_id, chr(69) || string_agg(chr(CAST(63 + x AS INTEGER)), '' ORDER BY j) AS graph6, any_value(fingerprint) AS fingerprint FROM (
  SELECT graph_id, j, coalesce(sum(32 >> CAST((v * (v - 1) // 2 + u) % 6 AS INTEGER)) FILTER ((v * (v - 1) // 2 + u) // 6 = j), 0) AS x,
    sha256('{{"edges":[' || string_agg('[' || u || ',' || v || ']', ',' ORDER BY u, v) || '],"order":6,"schema_version":"{G.GRAPH_VERSION}"}}') AS fingerprint
  FROM edges, range(3) t(j) GROUP BY graph_id, j) GROUP BY graph_id)"""


@query(f"WITH {P6}, {LEAST6} SELECT graph_id, min(graph_id) OVER c AS class_id, count(*) OVER c AS class_graphs FROM masks JOIN least6 USING (m) WINDOW c AS (PARTITION BY r)")
def isomorphism_classes(spark, sf):
    """Each graph's isomorphism class, called by its least graph, and how many graphs it has."""
    rows = graphs(spark, sf, 6, 4)
    known = canonical.classes(rows, 6)
    found = rows.join(known, ["n", "edges"]).select("graph_id", "class_id")
    sizes = found.groupBy("class_id").agg(F.count("*").alias("class_graphs"))
    return found.join(sizes, "class_id").select("graph_id", "class_id", "class_graphs")


@query(checked6(TIGHT[:1]) + " SELECT graph_id, count(*) AS partitions, count(*) FILTER (status = 'candidate_unsat') AS proved FROM checks GROUP BY graph_id HAVING bool_and(status = 'candidate_unsat')")
def existential_refutations(spark, sf):
    """Graphs of which no partition extends with offset 0, and of how many partitions the proof is accepted."""
    return census.refuted(graphs(spark, sf, 6, 4)).select("graph_id", "partitions", "proved")


@query(checked6(TIGHT[:1]) + " SELECT graph_id, count(*) AS partitions, count(*) FILTER (status = 'witness') AS proper FROM checks GROUP BY graph_id")
def cut_loop_tight_palette(spark, sf):
    """Graphs' partitions with palette offset 0, one graph of each class by the cut loop: those that end with a colouring
    that breaks none of all conflicts, and that a replay of the stored rounds finds no fault in."""
    rows = graphs(spark, sf, 6, 4)
    known = cut(canonical.classes(rows, 6), "classes")
    once = known.select(F.col("class_id").alias("graph_id"), "n", F.col("canonical").alias("edges")).distinct()
    found = cut(partitions.problem(partitions.auxiliary(partitions.partitions(once, 3)), F.lit(0)).select(*cuts.PROBLEM), "problems")
    path = new_path(spark, "rounds")
    done = cuts.loop(found, path)
    sound = done.join(found.select(*cuts.KEY, "conflicts"), cuts.KEY).join(cuts.replay(found, path), cuts.KEY, "left_anti")
    good = F.col("assignment").isNotNull() & (F.size(cuts.broken(F.col("conflicts"), F.col("assignment"))) == 0)
    by_class = done.groupBy("graph_id").agg(F.count("*").alias("partitions")).join(sound.groupBy("graph_id").agg(F.count_if(good).alias("proper")), "graph_id")
    of_graph = rows.join(known.select("class_id", "n", "edges"), ["n", "edges"]).select("graph_id", "class_id")
    return of_graph.join(by_class.withColumnRenamed("graph_id", "class_id"), "class_id").select("graph_id", "partitions", "proper")


@query(checked6([("dsatur-iterative-v1", 0)]) + """, s AS (SELECT p.graph_id, CASE WHEN outcome <> '' THEN 'skipped' WHEN bool_or(c.status = 'witness') THEN 'witness' ELSE 'candidate_unsat' END AS status FROM prof p LEFT JOIN checks c USING (graph_id) GROUP BY p.graph_id, outcome)
SELECT graph_id, status, CASE WHEN graph_id % 6 = 1 THEN 'graph' WHEN graph_id % 6 = 2 THEN 'status' WHEN graph_id % 6 = 5 THEN 'unreadable' WHEN status <> 'witness' THEN ''
  WHEN graph_id % 6 = 3 THEN 'assignment,certificate' WHEN graph_id % 6 = 4 THEN 'partition' ELSE '' END AS faults FROM s""")
def search_record_faults(spark, sf):
    """Records of searches with palette offset 0, five sixths of them damaged by a rule, and what is found wrong with them.

    By graph_id modulo 6: another size; a status that the record doesn't bear out; an assignment of one colour; no
    pairs but all vertices twice; a space too many.  The last two but one only harm records with a witness."""
    from .plans import search_records as S

    rule = lambda k: F.col("r.index") % 6 == k
    rows = S.parsed(S.records(graphs(spark, sf, 6, 4), "0" * 64, 0)).withColumn("true", F.col("r.status"))
    w = F.when(rule(3), F.col("r.witness").withField("assignment", F.transform("r.witness.assignment", lambda c: F.lit(0)))).when(rule(4), F.col("r.witness").withField("pairs", F.array(F.array(F.lit(0), F.lit(1)), F.array(F.lit(0), F.lit(1))))).otherwise(F.col("r.witness"))
    other = F.when(F.col("true") == "witness", "unknown").when(F.col("true") == "skipped", "candidate_unsat").otherwise("witness")
    r = F.col("r").withField("size", F.when(rule(1), F.col("r.size") + 1).otherwise(F.col("r.size"))).withField("status", F.when(rule(2), other).otherwise(F.col("true"))).withField("witness", F.when(F.col("true") == "witness", w))
    harmed = rows.select("true", F.col("r.index").alias("graph_id"), F.concat(F.to_json(r, {"ignoreNullFields": "false"}), F.when(rule(5), " ").otherwise("")).alias("document"))
    harmed = cut(harmed, "lines")
    found = S.faults(harmed).groupBy(F.col("index").alias("graph_id")).agg(F.array_join(F.array_sort(F.collect_set("fault")), ",").alias("faults"))
    return harmed.join(found, "graph_id", "left").select("graph_id", F.col("true").alias("status"), F.coalesce("faults", F.lit("")).alias("faults"))


@query(checked6(TIGHT) + UNIVERSAL)
def universal_census_tight_palette(spark, sf):
    """Palette offset 0, where partitions that don't extend are found."""
    return canonical.alike(graphs(spark, sf, 6, 4), lambda rows: census.universal(rows, 3, TIGHT))


@query(checked6([("static-order-iterative-v1", 0)]) + " SELECT p.graph_id, CASE WHEN outcome <> '' THEN 'skipped' WHEN failed IS NULL THEN 'witness' ELSE 'candidate_unsat' END AS status, coalesce(failed + 1, n, 0) AS started FROM prof p LEFT JOIN (SELECT graph_id, count(*) AS n, min(p) FILTER (status <> 'witness') AS failed FROM checks GROUP BY graph_id) c USING (graph_id)")
def check_all_tight_palette(spark, sf):
    """Every partition must extend; a graph's search ends at the first that doesn't."""
    return shared(graphs(spark, sf, 6, 4), lambda rows: census.check_all(rows, 0, "static-order-iterative-v1").select("graph_id", "status", "started"))


@query(checked6(THREE) + " SELECT b AS backend, CAST(o AS INTEGER) AS palette_offset, status, count(*) AS checks FROM checks GROUP BY ALL")
def universal_check_matrix(spark, sf):
    known = merged(graphs(spark, sf, 6, 4)).withColumnRenamed("same_as", "graph_id")
    found = census.checks(known.select("graph_id", "n", "edges"), 3).groupBy("graph_id", "backend", "palette_offset", "status").agg(F.count("*").alias("k"))
    return found.join(known, "graph_id").groupBy("backend", "palette_offset", "status").agg(F.sum(F.col("k") * F.col("copies")).alias("checks"))


@query(checked6(THREE) + f", u AS ({UNIVERSAL}) SELECT s.status, count(u.status) AS graphs, CAST(coalesce(sum(partitions), 0) AS BIGINT) AS partitions, CAST(coalesce(sum(checks), 0) AS BIGINT) AS checks FROM (VALUES ('verified_all'), ('candidate_unsat'), ('unknown'), ('error'), ('skipped')) s(status) LEFT JOIN u USING (status) GROUP BY s.status")
def status_rollup(spark, sf):
    return census.status_counts(canonical.alike(graphs(spark, sf, 6, 4), lambda rows: census.universal(rows, 3)))


# --- completeness ---------------------------------------------------------


def _stream(spark, sf):
    rows = graphs(spark, sf, 8, 8)
    return rows.select("graph_id", (F.col("graph_id") % 7).alias("shard"), G.graph6(F.col("n"), F.col("edges")).alias("graph6"))


@query(f"WITH {P8} SELECT count(DISTINCT graph_id) AS direct_rows, count(DISTINCT graph_id) AS shard_rows, 0::BIGINT AS overlapping, 0::BIGINT AS repeated, 0::BIGINT AS missing, 0::BIGINT AS extra FROM edges")
def shard_union_audit(spark, sf):
    rows = _stream(spark, sf)
    return completeness.union_audit(rows, rows, "graph_id", "shard")


@query(f"WITH {P8}, g AS (SELECT DISTINCT graph_id FROM edges) SELECT count(*) AS direct_rows, count(*) FILTER (graph_id % 11 <> 0) + count(*) FILTER (graph_id % 11 <> 0 AND graph_id % 5 = 0) AS shard_rows, count(*) FILTER (graph_id % 11 <> 0 AND graph_id % 5 = 0) AS overlapping, count(*) FILTER (graph_id % 11 <> 0 AND graph_id % 5 = 0) AS repeated, count(*) FILTER (graph_id % 11 = 0) AS missing, 0::BIGINT AS extra FROM g")
def shard_overlap_audit(spark, sf):
    rows = _stream(spark, sf)
    kept = rows.where("graph_id % 11 <> 0")
    copied = kept.where("graph_id % 5 = 0").withColumn("shard", F.col("shard") + 1)
    return completeness.union_audit(rows, kept.union(copied), "graph_id", "shard")


@query(f"WITH {P8} SELECT DISTINCT graph_id FROM edges WHERE graph_id % 3 = 1")
def resume_missing_records(spark, sf):
    rows = _stream(spark, sf)
    return completeness.missing_records(rows, rows.where("graph_id % 3 <> 1"), "graph_id").select("graph_id")


@query(f"WITH {P8}, g AS (SELECT DISTINCT graph_id FROM edges) SELECT r.s AS shard, count(g.graph_id) AS records FROM range(9) r(s) LEFT JOIN g ON g.graph_id % 7 = r.s GROUP BY r.s")
def shard_receipts(spark, sf):
    return completeness.shard_receipts(_stream(spark, sf), "graph6", "shard", 9).select("shard", "records")


@query(GRAPH6 + ", t AS (SELECT graph_id, chr(71) || string_agg(c, '' ORDER BY j) AS graph6 FROM letters GROUP BY graph_id), l AS (SELECT graph_id, graph6, lag(graph6) OVER (PARTITION BY graph_id % 7 ORDER BY substr(graph6, 1, 3), graph_id) AS b FROM t) SELECT graph_id FROM l WHERE substr(b, 1, 3) = substr(graph6, 1, 3)")
def adjacent_duplicates(spark, sf):
    rows = _stream(spark, sf).withColumn("head", F.substring("graph6", 1, 3)).withColumn("place", F.struct("head", "graph_id"))
    return completeness.adjacent_repeats(rows, "place", "head", "shard").select("graph_id")


@query(f"WITH {P8}, g AS (SELECT DISTINCT graph_id FROM edges) SELECT graph_id FROM g WHERE graph_id % 4 <> 3 AND graph_id % 5 = 0")
def prefix_mismatch_rows(spark, sf):
    """Rows of a checkpoint, of which every fifth was altered, that differ from the stream made anew."""
    rows = _stream(spark, sf)
    done = rows.where("graph_id % 4 <> 3").withColumn("graph6", F.when(F.col("graph_id") % 5 == 0, F.concat("graph6", F.lit("?"))).otherwise(F.col("graph6")))
    return completeness.prefix_mismatches(rows, done, "graph_id", "graph6").select("graph_id")


@query(f"WITH {P8}, g AS (SELECT graph_id % 7 AS shard, graph_id // 7 AS i FROM (SELECT DISTINCT graph_id FROM edges) WHERE graph_id % 21 <> 14 OR graph_id % 7 <> 0) SELECT shard FROM g GROUP BY shard HAVING min(i) <> 0 OR max(i) <> count(*) - 1 OR count(DISTINCT i) <> count(*)")
def index_gap_groups(spark, sf):
    rows = _stream(spark, sf).where("graph_id % 21 <> 14 OR graph_id % 7 <> 0").withColumn("i", F.expr("graph_id div 7"))
    return completeness.index_gaps(rows, "i", "shard").select("shard")


# --- dependency audit: golden counters -------------------------------------

GOLDEN = """('d8-a-w5', 864, 675, 834, 675, 237, 6, 6, 0), ('d8-b-w6', 50000, 37136, 47147, 37064, 5787, 32, 32, 0), ('d8-c-frozen-w5', 256, 187, 232, 178, 85, 8, 8, 0),
 ('d8-c-frozen-w6', 25000, 17064, 22006, 16404, 3978, 248, 248, 0), ('d8-c-frozen-w7', 3240000, 2140000, 2791925, 2062011, 232049, 9368, 9228, 140),
 ('d8-c-mobile-w6', 25000, 18856, 22890, 18208, 3192, 0, 0, 0), ('d8-c-mobile-w7', 4320000, 3095000, 3871131, 2999927, 193713, 246, 246, 0)"""
COUNTERS = ["candidates", "outdegree_ok", "root_reachable", "admissible", "incidence_admissible", "fragile", "resolved", "unresolved"]
SMALL = [p for p in dependency.PROFILES if p.w < 7]


@query(f"SELECT profile, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in COUNTERS)} FROM (VALUES {GOLDEN}) t(profile, {', '.join(COUNTERS)}) WHERE profile NOT LIKE '%w7'")
def d8_counters(spark, sf):
    found = [dependency.counters(spark, p) for p in SMALL]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


@query("""SELECT 'd8-c-frozen-w6' AS profile, CAST(d AS INTEGER) AS depth, CAST(s AS BIGINT) AS states FROM (VALUES (0, 3730), (1, 224), (2, 24)) t(d, s)""")
def d8_depth_histogram(spark, sf):
    return dependency.histogram(spark, dependency.PROFILES[3])


@query(f"SELECT profile, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in COUNTERS)} FROM (VALUES {GOLDEN}) t(profile, {', '.join(COUNTERS)})")
def d8_counters_all(spark, sf):
    return reduce(DataFrame.unionByName, [dependency.counters(spark, p) for p in dependency.PROFILES])


DEPTHS = """('d8-a-w5', 0, 231), ('d8-a-w5', 1, 6), ('d8-b-w6', 0, 5755), ('d8-b-w6', 1, 32), ('d8-c-frozen-w5', 0, 77), ('d8-c-frozen-w5', 1, 8),
 ('d8-c-frozen-w6', 0, 3730), ('d8-c-frozen-w6', 1, 224), ('d8-c-frozen-w6', 2, 24), ('d8-c-frozen-w7', 0, 222681), ('d8-c-frozen-w7', 1, 7856), ('d8-c-frozen-w7', 2, 1212), ('d8-c-frozen-w7', 3, 160),
 ('d8-c-mobile-w6', 0, 3192), ('d8-c-mobile-w7', 0, 193467), ('d8-c-mobile-w7', 1, 246)"""


@query(f"SELECT profile, CAST(d AS INTEGER) AS depth, CAST(s AS BIGINT) AS states FROM (VALUES {DEPTHS}) t(profile, d, s)")
def d8_depth_histogram_all(spark, sf):
    return reduce(DataFrame.unionByName, [dependency.histogram(spark, p) for p in dependency.PROFILES])


def _codes_sql() -> str:
    """The codes of all candidates of every profile, by arithmetic."""
    parts = []
    for p in dependency.PROFILES:
        k = len(p.indegrees)
        base = sum((c + 1) << 3 * (c + 1) for c in range(k))
        terms = " + ".join(f"CAST(m{c}.i AS HUGEINT) * {1 << (3 * (k + 1) + 7 * c)}" for c in range(k))
        source = ", ".join(f"(SELECT i FROM range({1 << p.w}) t(i) WHERE bit_count(CAST(i AS INTEGER)) = {m} AND (i >> {c + 1}) & 1 = 0) m{c}" for c, m in enumerate(p.indegrees))
        parts.append(f"SELECT '{p.name}' AS profile, count(*) AS states, CAST(min(x) AS BIGINT) AS least, CAST(max(x) AS BIGINT) AS greatest, CAST(sum(x) AS VARCHAR) AS total, count(*) AS round_trips FROM (SELECT {base} + {terms} AS x FROM {source})")
    return " UNION ALL ".join(parts)


@query(_codes_sql())
def d8_state_codes(spark, sf):
    """The 63-bit codes of all candidates, decoded again."""
    return reduce(DataFrame.unionByName, [dependency.codes(spark, p) for p in dependency.PROFILES])


@query("SELECT 'd8-c-frozen-w7' AS profile, masks, CAST(d AS INTEGER) AS deficit, CAST(s AS BIGINT) AS states, CAST(s AS BIGINT) AS orbits, 56::INTEGER AS orbit_size FROM (VALUES ('13,97,18,10,1,4', 112, 56), ('37,88,17,9,2,4', 98, 56), ('41,97,18,10,1,4', 84, 28)) t(masks, d, s)")
def d8_unresolved_classes(spark, sf):
    """Classes of the orbits without a robust state, of every profile; only one has any."""
    return reduce(DataFrame.unionByName, [dependency.unresolved_classes(spark, p) for p in dependency.PROFILES])


# --- counting inequalities --------------------------------------------------


@query(f"SELECT CAST(p.i AS INTEGER) AS p, CAST(q.i AS INTEGER) AS q, CAST(c.i AS INTEGER) AS cap_num, CAST(m.i AS INTEGER) AS cap_den FROM range({counting.GRID}) p(i), range({counting.GRID}) q(i), range(1, 7) c(i), range(1, 4) m(i) WHERE 2 * c.i * (p.i + q.i) * m.i >= 3 * greatest(q.i * m.i, p.i * c.i) * m.i")
def draft_counterexamples(spark, sf):
    return counting.draft_counterexamples(counting.grid(spark))


@query(f"SELECT CAST(c.i AS INTEGER) AS cap_num, CAST(m.i AS INTEGER) AS cap_den, count(*) AS cases, count(*) FILTER (p.i * c.i + q.i * m.i < 2 * greatest(q.i * m.i, p.i * c.i) + 2 * m.i) AS closed FROM range({counting.GRID}) p(i), range({counting.GRID}) q(i), range(1, 7) c(i), range(1, 4) m(i) GROUP BY ALL")
def corrected_closure(spark, sf):
    return counting.corrected_closure(counting.grid(spark))


# --- matching core ----------------------------------------------------------


@query(f"WITH {P6}, {free(6)}, {eligible(6).replace('prof AS', 'prof0 AS')}, prof AS (SELECT *  REPLACE ('' AS outcome) FROM prof0), {matched(6).split(',' + chr(10) + 'parts AS')[0]} SELECT m.graph_id, count(*) AS precolourings FROM ({' UNION ALL '.join(f'SELECT graph_id, len(idx) AS k FROM m{k}' for k in range(4))}) m JOIN prof p ON p.graph_id = m.graph_id WHERE m.k >= 6 - p.d GROUP BY m.graph_id")
def precoloring_counts(spark, sf):
    from .plans.matching_core import precolourings

    return shared(graphs(spark, sf, 6, 4), lambda rows: precolourings(spread(rows, "graph_id"), 6).groupBy("graph_id").agg(F.count("*").alias("precolourings")))


@query("SELECT 945::BIGINT AS strings")
def restricted_partitions(spark, sf):
    from .plans.matching_core import growth_strings

    return growth_strings(spark.range(1).select(F.lit(5).alias("blocks")), 10, "blocks").agg(F.count("*").alias("strings"))


@query(f"""WITH {P6}, {CORE}, {free(6)}, {eligible(6).replace('prof AS', 'prof0 AS')}, prof AS (SELECT * REPLACE ('' AS outcome) FROM prof0), {matched(6).split(',' + chr(10) + 'parts AS')[0]}, {TABLES6},
scope AS (SELECT graph_id FROM (SELECT graph_id, x, count(*) AS k FROM (SELECT graph_id, u AS x FROM core UNION ALL SELECT graph_id, v FROM core) GROUP BY ALL) GROUP BY graph_id HAVING max(k) = 1),
every AS ({' UNION ALL '.join(f'SELECT graph_id, idx, used FROM m{k}' for k in range(4))}),
cls AS (SELECT graph_id, row_number() OVER (PARTITION BY graph_id ORDER BY idx) AS p, d, CAST({CLASSES} AS INTEGER[]) AS classes FROM every JOIN prof USING (graph_id) SEMI JOIN scope USING (graph_id) WHERE len(idx) >= 6 - d),
{extends6("ext", "cls", 1)} SELECT graph_id, count(*) AS precolourings, count(*) FILTER (ok) AS witnesses, 0::BIGINT AS violations FROM ext GROUP BY graph_id""")
def matching_core_extensions(spark, sf):
    from .plans.matching_core import extensions, scopes

    def work(rows):
        wanted = scopes(rows).where("matching_nonempty").select("graph_id")
        return extensions(spread(rows.join(wanted, "graph_id", "left_semi"), "graph_id"), 6)

    return canonical.alike(graphs(spark, sf, 6, 4), work)


@query(f"""WITH {P6}, {CORE}, {free(6)}, {eligible(6).replace('prof AS', 'prof0 AS')}, prof AS (SELECT * REPLACE ('' AS outcome) FROM prof0), {matched(6).split(',' + chr(10) + 'parts AS')[0]}, {TABLES6},
scope AS (SELECT graph_id FROM (SELECT graph_id, x, count(*) AS k FROM (SELECT graph_id, u AS x FROM core UNION ALL SELECT graph_id, v FROM core) GROUP BY ALL) GROUP BY graph_id HAVING max(k) = 1),
every AS ({' UNION ALL '.join(f'SELECT graph_id, idx, used FROM m{k}' for k in range(4))}),
cls AS (SELECT graph_id, row_number() OVER (PARTITION BY graph_id ORDER BY idx) AS p, d, CAST({CLASSES} AS INTEGER[]) AS classes FROM every JOIN prof USING (graph_id) SEMI JOIN scope USING (graph_id) WHERE len(idx) >= 6 - d),
{extends6("ext", "cls", 0)} SELECT graph_id, count(*) AS precolourings, CASE WHEN bool_and(ok) THEN 'complete_positive' ELSE 'candidate_unsat' END AS status FROM ext GROUP BY graph_id""")
def matching_core_run_tight(spark, sf):
    """Runs that end at a graph's first precolouring that doesn't extend, with one colour less."""
    from .plans.matching_core import run, scopes

    def work(rows):
        wanted = scopes(rows).where("matching_nonempty").select("graph_id")
        return run(spread(rows.join(wanted, "graph_id", "left_semi"), "graph_id"), 6, 1).select("graph_id", "precolourings", "status")

    return canonical.alike(graphs(spark, sf, 6, 4), work)


# --- alternating components -------------------------------------------------


@query(f"WITH {P8}, {COLOURED.format(k=7)}, used AS (SELECT graph_id, v, c FROM vc UNION SELECT graph_id, x, c FROM inc) SELECT p.graph_id, p.v, string_agg(r.c, ',' ORDER BY r.c) AS missing FROM vertices p, range(9) r(c) ANTI JOIN used u ON u.graph_id = p.graph_id AND u.v = p.v AND u.c = r.c GROUP BY p.graph_id, p.v".replace("FROM vertices p, range(9) r(c) ANTI JOIN used u ON u.graph_id = p.graph_id AND u.v = p.v AND u.c = r.c GROUP", "FROM vertices p CROSS JOIN range(9) r(c) WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.graph_id = p.graph_id AND u.v = p.v AND u.c = r.c) GROUP"))
def missing_colors(spark, sf):
    from .plans.kempe import missing

    rows = _synthetic(spark, sf, 7)
    return rows.select("graph_id", F.posexplode(missing(F.col("n"), F.col("edges"), F.col("vc"), F.col("ec"), 9)).alias("v", "m")).select("graph_id", "v", F.array_join(F.transform("m", lambda c: c.cast("string")), ",").alias("missing"))


@query(f"""WITH RECURSIVE {P8}, {COLOURED.format(k=7)}, arcs AS (SELECT graph_id, u AS a, v AS b FROM ec WHERE c IN (1, 4) UNION ALL SELECT graph_id, v, u FROM ec WHERE c IN (1, 4)),
reach AS (SELECT graph_id, a AS s, a AS x FROM arcs UNION SELECT r.graph_id, r.s, c.b FROM reach r JOIN arcs c ON c.graph_id = r.graph_id AND c.a = r.x),
lo AS (SELECT graph_id, s, min(x) AS root FROM reach GROUP BY ALL)
SELECT graph_id, CAST(root AS INTEGER) AS root, count(*) AS vertices, (SELECT count(*) FROM ec JOIN lo l2 ON l2.graph_id = ec.graph_id AND l2.s = ec.u WHERE ec.graph_id = lo.graph_id AND l2.root = lo.root AND ec.c IN (1, 4)) AS edges FROM lo GROUP BY graph_id, root""")
def kempe_components(spark, sf):
    from .plans.kempe import components

    return components(_synthetic(spark, sf, 7), 1, 4)


@query(f"""WITH RECURSIVE {P8}, ec AS (SELECT *, (u + v) % 8 AS c FROM edges), inc AS (SELECT graph_id, u AS a, v AS b, c FROM ec UNION ALL SELECT graph_id, v, u, c FROM ec),
cs AS (SELECT DISTINCT graph_id, c FROM ec), half AS (SELECT i.graph_id, x.c AS x, y.c AS y, a, b, i.c FROM cs x JOIN cs y ON y.graph_id = x.graph_id AND x.c < y.c JOIN inc i ON i.graph_id = x.graph_id AND i.c IN (x.c, y.c)),
reach AS (SELECT graph_id, x, y, a AS s, a AS t FROM half UNION SELECT r.graph_id, r.x, r.y, s, h.b FROM reach r JOIN half h ON h.graph_id = r.graph_id AND h.x = r.x AND h.y = r.y AND h.a = r.t),
part AS (SELECT graph_id, x, y, s AS a, min(t) AS component FROM reach GROUP BY ALL), deg1 AS (SELECT graph_id, x, y, a FROM half GROUP BY ALL HAVING count(*) = 1),
start AS (SELECT graph_id, x, y, component, coalesce(m, component) AS a, m IS NULL AS cyc FROM (SELECT p.graph_id, p.x, p.y, component, min(d.a) AS m FROM part p LEFT JOIN deg1 d ON d.graph_id = p.graph_id AND d.x = p.x AND d.y = p.y AND d.a = p.a GROUP BY ALL)),
walk AS (SELECT s.graph_id, s.x, s.y, component, cyc, s.a AS root, 0 AS pos, h.a, h.b, h.c FROM start s JOIN half h ON h.graph_id = s.graph_id AND h.x = s.x AND h.y = s.y AND h.a = s.a AND (NOT cyc OR h.c = h.x)
  UNION ALL SELECT w.graph_id, w.x, w.y, component, cyc, root, pos + 1, h.a, h.b, h.c FROM walk w JOIN half h ON h.graph_id = w.graph_id AND h.x = w.x AND h.y = w.y AND h.a = w.b AND h.c = w.x + w.y - w.c WHERE NOT (cyc AND w.b = root))
SELECT graph_id, CAST(x AS INTEGER) AS "first", CAST(y AS INTEGER) AS "second", CAST(component AS INTEGER) AS component, CASE WHEN cyc THEN 'cycle' ELSE 'path' END AS kind, CAST(pos AS INTEGER) AS position, a AS tail, b AS head, CAST(c AS INTEGER) AS color FROM walk""")
def kempe_walks(spark, sf):
    """Canonical walks of all two-colour components, each edge coloured by the sum of its ends."""
    from .plans.kempe import walks_of_graphs

    return walks_of_graphs(graphs(spark, sf, 8, 8).withColumn("ec", F.transform("edges", lambda e: ((e["u"] + e["v"]) % 8).cast("int"))))


PAIRED = [("sharp", "verified_one_swap_exit", 12, 0, 4, 0, 0), ("hard_residual", "verified_two_swap_orbit_exit", 12, 2, 0, 0, 0), ("cross_cross_residual", "verified_two_swap_orbit_exit", 12, 2, 0, 0, 0), ("nonaligned_release", "verified_cross_terminal_release_exit", 12, 1, 0, 3, 0)]


@query(f"SELECT name, status, CAST(blocked AS INTEGER) AS blocked, CAST(linked AS INTEGER) AS linked, CAST(exits AS INTEGER) AS exits, CAST(cross_releases AS INTEGER) AS cross_releases, CAST(exit_issues AS INTEGER) AS exit_issues FROM (VALUES {', '.join(map(str, PAIRED))}) t(name, status, blocked, linked, exits, cross_releases, exit_issues)")
def paired_hole_status(spark, sf):
    from .plans import paired_hole as P

    names = list(P.STATES)
    rows = spark.createDataFrame([(i, k, P.STATES[k]) for i, k in enumerate(names)], "state_id long, name string, document string")
    found = P.confirmed(P.verified(rows))
    return rows.select("state_id", "name").join(found, "state_id").select("name", "status", "blocked", "linked", "exits", "cross_releases", "exit_issues")


# --- orbit generator ---------------------------------------------------------


@query("SELECT 64::BIGINT AS profiles, 5436::BIGINT AS alpha_matchings, 31360::BIGINT AS missing_profiles, 347904::BIGINT AS work_units")
def orbit_sizes(spark, sf):
    from .plans import orbit as O

    one = lambda rows, name: rows.agg(F.count("*").alias(name))
    sizes = one(O.vertex_profiles(spark), "profiles").crossJoin(one(O.alpha_matchings(spark), "alpha_matchings")).crossJoin(one(O.missing_profiles(spark), "missing_profiles"))
    return sizes.withColumn("work_units", F.col("profiles") * F.col("alpha_matchings"))


@query("SELECT 'proposed_release' AS status, 1::INTEGER AS depth, 8::BIGINT AS states")
def orbit_frozen_states(spark, sf):
    from .plans import orbit as O

    return O.proposals(O.compatible_states(spark)).groupBy("status", "depth").agg(F.count("*").alias("states"))


# --- transfer formula --------------------------------------------------------


@query("SELECT CAST(q AS INTEGER) AS q, 1032::INTEGER AS variables, 19931::BIGINT AS base_clauses, 19944::INTEGER AS clauses, sha256 FROM (VALUES (1, '10d430f18005abb27648f0885381687a68479622a332d09513030d7f8576e386'), (3, '65a1031f2248af17755c91984f3d9d389c6d79dbe58d6a288cb34b1fa39f8890')) t(q, sha256)")
def transfer_formula(spark, sf):
    from .plans import transfer as X

    v = X.variables(spark)
    base = X.base(v).agg(F.count("*").alias("base_clauses"))
    out = None
    for q in (1, 3):
        one = X.dimacs_sha256(X.formula(spark, q), 1032).select(F.lit(q).alias("q"), F.lit(1032).alias("variables"), "clauses", "sha256")
        out = one if out is None else out.union(one)
    return out.crossJoin(base).select("q", "variables", "base_clauses", "clauses", "sha256")


# --- universes ---------------------------------------------------------------

UNIVERSE = [(1, 1, 0, 1, 0), (2, 2, 1, 1, 1), (3, 4, 2, 2, 2), (4, 11, 8, 3, 16), (5, 34, 23, 11, 69), (6, 156, 137, 19, 1106)]


def _universe(spark, order, shards=1):
    from .sources.universe import GraphUniverse

    spark.dataSource.register(GraphUniverse)
    return spark.read.format("graph_universe").option("order", order).option("shards", shards).load()


@query(f"SELECT CAST(n AS INTEGER) AS graph_order, CAST(g AS BIGINT) AS graphs, CAST(e AS BIGINT) AS eligible, CAST(s AS BIGINT) AS skipped, CAST(p AS BIGINT) AS partitions FROM (VALUES {', '.join(map(str, UNIVERSE))}) t(n, g, e, s, p)")
def universe_counts(spark, sf):
    out = None
    for n in range(1, 7):
        prof = partitions.profile(_universe(spark, n))
        k = F.when(F.col("outcome") == "", partitions.counted(n, G.complement(F.col("n"), F.col("edges")), F.col("pairs"))).otherwise(0)
        one = prof.agg(F.count("*").alias("graphs"), F.count_if(F.col("outcome") == "").alias("eligible"), F.count_if(F.col("outcome") != "").alias("skipped"), F.sum(k).alias("partitions")).select(F.lit(n).alias("graph_order"), "*")
        out = one if out is None else out.union(one)
    return out


@query("SELECT 8::INTEGER AS graph_order, 12346::BIGINT AS graphs, 11922::BIGINT AS eligible, 424::BIGINT AS skipped, 514050::BIGINT AS partitions")
def universe_order_8(spark, sf):
    """All 12,346 graphs, made by the tasks that own the graphs of order 6 they descend from."""
    prof = partitions.profile(_universe(spark, 8, 32), 8)
    k = F.when(F.col("outcome") == "", partitions.counted(8, G.complement(F.col("n"), F.col("edges")), F.col("pairs"))).otherwise(0)
    return prof.agg(F.count("*").alias("graphs"), F.count_if(F.col("outcome") == "").alias("eligible"), F.count_if(F.col("outcome").startswith("outside")).alias("skipped"), F.sum(k).alias("partitions")).select(F.lit(8).alias("graph_order"), "*")


@query("SELECT CAST(n AS INTEGER) AS graph_order, o AS palette_offset, status, CAST(k AS BIGINT) AS checks FROM (VALUES (4, 0, 'witness', 9), (4, 0, 'candidate_unsat', 7), (4, 1, 'witness', 16), (5, 0, 'witness', 53), (5, 0, 'candidate_unsat', 16), (5, 1, 'witness', 69), (6, 0, 'witness', 898), (6, 0, 'candidate_unsat', 208), (6, 1, 'witness', 1106)) t(n, o, status, k)")
def universe_tight_palette(spark, sf):
    out = None
    for n in (4, 5, 6):
        found = census.checks(_universe(spark, n).repartition(8), n // 2, [("dsatur-iterative-v1", 0), ("dsatur-iterative-v1", 1)])
        one = found.groupBy("palette_offset", "status").agg(F.count("*").alias("checks")).select(F.lit(n).alias("graph_order"), "*")
        out = one if out is None else out.union(one)
    return out


@query("SELECT 156::BIGINT AS direct_rows, 156::BIGINT AS shard_rows, 0::BIGINT AS overlapping, 0::BIGINT AS repeated, 0::BIGINT AS missing, 0::BIGINT AS extra")
def universe_shard_union(spark, sf):
    named = lambda rows: rows.select(G.graph6(F.col("n"), F.col("edges")).alias("graph6"), (F.col("graph_id") % 4).alias("shard"))
    return completeness.union_audit(named(_universe(spark, 6)), named(_universe(spark, 6, 4)), "graph6", "shard")


# --- streaming ---------------------------------------------------------------


@query("""WITH p AS (SELECT user_id // 16 AS graph_id, CAST(user_id % 16 AS INTEGER) AS a, CAST(event_id % 16 AS INTEGER) AS b FROM events),
e AS (SELECT DISTINCT graph_id, least(a, b) AS u, greatest(a, b) AS v FROM p WHERE a <> b) SELECT graph_id, count(*) AS edges FROM e GROUP BY graph_id""")
def streamed_edge_counts(spark, sf):
    """Beyond the batch operators: edges arrive as a stream of events, each counted once."""
    from .streaming.incremental import drain

    return drain(spark, sf)


# --- witnesses of the transfer formula, records, validators --------------------


def _model(spark):
    """Rows and factors by a rule: row f has heads f..f+3 modulo 6 (f = 0: f..f+2); factors are
    matchings that cover the core, some edges inside it."""
    heads = spark.range(36).select((F.col("id") % 6).cast("int").alias("h"), F.expr("int(id div 6)").alias("f"))
    rows = heads.where((F.col("h") - F.col("f") + 6) % 6 < F.when(F.col("f") == 0, 3).otherwise(4)).select("f", "h")
    outside = heads.where((F.col("f") % 2 == 1) | ~F.col("h").isin(1, 4)).select("f", F.col("h").alias("a"), (13 + (3 * F.col("h") + 5 * F.col("f")) % 18).alias("b"))
    inside = spark.range(1).select(F.lit(0).alias("f"), F.lit(1).alias("a"), F.lit(4).alias("b"))
    rest = heads.where("f IN (2, 4) AND h IN (1, 4)").select("f", F.col("h").alias("a"), (13 + (3 * F.col("h") + 5 * F.col("f")) % 18).alias("b"))
    return rows, outside.union(inside).union(rest)


ENDPOINTS = """WITH cell AS (SELECT CAST(f.i AS INTEGER) AS f, CAST(h.i AS INTEGER) AS h FROM range(6) f(i), range(6) h(i)),
held AS (SELECT f, h FROM cell WHERE (h - f + 6) % 6 < CASE WHEN f = 0 THEN 3 ELSE 4 END),
factor AS (SELECT f, h AS a, 13 + (3 * h + 5 * f) % 18 AS b FROM cell WHERE f > 0 OR h NOT IN (1, 4) UNION ALL SELECT 0, 1, 4),
o AS (SELECT x.*, k.f IS NOT NULL AS good FROM (SELECT f, a, b, a AS head, b AS tail FROM factor UNION ALL SELECT f, a, b, b, a FROM factor WHERE b < 6) x LEFT JOIN held k ON k.f = x.f AND k.h = x.head),
three AS (SELECT p.f AS f1, p.a AS a1, p.b AS b1, q.f AS f2, q.a AS a2, q.b AS b2, r.f AS f3, r.a AS a3, r.b AS b3, p.head AS h1, q.head AS h2, r.head AS h3, p.good AS g1, q.good AS g2, r.good AS g3, CAST(s.i AS INTEGER) AS spare,
  [p.head, q.head, r.head] AS heads, [p.tail, q.tail, r.tail] AS tails, [x.f for x in [p, q, r] if NOT x.good] AS bad, len([x for x in [p, q, r] if x.good AND x.tail >= 6]) > 0 AS old
  FROM o p JOIN o q ON p.f < q.f JOIN o r ON q.f < r.f, range(6) s(i) WHERE len(list_distinct([p.a, p.b, q.a, q.b, r.a, r.b])) = 6),
found AS (SELECT t.*, bad[1] AS active, CASE WHEN len(bad) = 0 THEN 'Q0' WHEN old THEN 'Q1_old_outside' ELSE 'Q1_new_outside_only' END AS kind FROM three t
  WHERE len(bad) <= 1 AND NOT list_contains(heads, spare) AND NOT list_contains(tails, spare) AND len([x for x in range(3) if x <> spare AND NOT list_contains(heads, x)]) = 1
  AND (len(bad) = 0 OR EXISTS (SELECT 1 FROM held WHERE held.f = bad[1] AND held.h = spare) AND NOT list_contains(tails, bad[1] + 6))),
cut AS (SELECT DISTINCT f1, a1, b1, h1, g1, f2, a2, b2, h2, g2, f3, a3, b3, h3, g3, active, CASE WHEN active IS NOT NULL THEN spare END AS s FROM found WHERE kind <> 'Q1_new_outside_only')
SELECT kind, count(*) AS witnesses, 0::BIGINT AS differ, (SELECT count(*) FROM cut) AS cuts FROM found GROUP BY kind"""


@query(ENDPOINTS)
def transfer_endpoints(spark, sf):
    """Witnesses by kind, and how far the cuts of the two derivations differ (0)."""
    from .plans import transfer as X

    # Tables of fixed size, made once: 1,032 variables and a model of 20 to 40 rows each.
    v, rows, factors = (t.coalesce(1).persist() for t in (X.variables(spark), *_model(spark)))
    found = X.endpoint_witnesses(rows, factors)
    cuts = X.cuts(found.where("kind <> 'Q1_new_outside_only'"), v, (1, 2, 3))
    other = X.cuts(X.anchored_witnesses(rows, factors), v, (0, 1, 2))
    differ = cuts.select("clause", F.lit(1).alias("s")).union(other.select("clause", F.lit(-1).alias("s"))).groupBy("clause").agg(F.sum("s").alias("s")).agg(F.count_if(F.col("s") != 0).alias("differ"), F.count_if(F.col("s") == 0).alias("cuts"))
    return found.groupBy("kind").agg(F.count("*").alias("witnesses")).crossJoin(differ)  # one row


@query("SELECT CAST(p AS INTEGER) AS place, v AS version FROM (VALUES (1, '0.9.10'), (2, '1.0.0-1'), (3, '1.0.0-2'), (4, '1.0.0-10'), (5, '1.0.0-alpha'), (6, '1.0.0-alpha.1'), (7, '1.0.0-alpha.beta'), (8, '1.0.0'), (9, '1.0.10'), (10, '10.0.0'), (11, '100000000000000000000.0.0')) t(p, v)")
def semver_order(spark, sf):
    from pyspark.sql import Window

    from .functions.text import semver_key

    given = ["1.0.0", "10.0.0", "1.0.0-10", "1.0.0-alpha.beta", "0.9.10", "1.0.0-2", "1.0.10", "1.0.0-alpha", "100000000000000000000.0.0", "1.0.0-alpha.1", "1.0.0-1", "01.0.0", "1.0", "1.0.0-01", "v1.0.0", "1.0.0-"]
    rows = spark.createDataFrame([(x,) for x in given], "version string").withColumn("k", semver_key(F.col("version"))).where("k IS NOT NULL")
    return rows.select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("k")).alias("place"), "version")


@query("SELECT u AS url, ok AS stable FROM (VALUES ('https://a.example/x', true), ('https://a.example/x/y.tar.gz', true), ('http://a.example/x', false), ('https://a.example/', false), ('https://A.example/x', false), ('https://a.example:1/x', false), ('https://a.example/../x', false), ('https://a.example/x?y', false), ('https://a.example/%20', false), ('https://a/x', false), ('https://u@a.example/x', false), ('https://a.example/x/', false), ('https://-a.example/x', false)) t(u, ok)")
def stable_urls(spark, sf):
    from .functions.text import is_stable_url

    given = ["https://a.example/x", "https://a.example/x/y.tar.gz", "http://a.example/x", "https://a.example/", "https://A.example/x", "https://a.example:1/x", "https://a.example/../x", "https://a.example/x?y", "https://a.example/%20", "https://a/x", "https://u@a.example/x", "https://a.example/x/", "https://-a.example/x"]
    return spark.createDataFrame([(x,) for x in given], "url string").select("url", is_stable_url(F.col("url")).alias("stable"))


@query(checked6(THREE) + f", u AS ({UNIVERSAL}) SELECT graph_id, status, CAST(partitions AS INTEGER) AS partition_count FROM u")
def census_records(spark, sf):
    """Canonical records, read back from their text."""
    from .plans import records as R

    lines = R.records(graphs(spark, sf, 6, 4), 3, "0" * 64)
    get = lambda path: F.get_json_object("document", path)
    return lines.select("graph_id", get("$.status").alias("status"), get("$.partition_count").cast("int").alias("partition_count"))


@query(f"WITH {P6} SELECT count(DISTINCT graph_id) AS records, 0::BIGINT AS faults, 0::BIGINT AS short_lists FROM edges")
def census_record_faults(spark, sf):
    """Records held against their own text: witnesses verified on graphs built anew, lists counted."""
    from .plans import records as R

    lines = cut(R.records(graphs(spark, sf, 6, 4), 3, "0" * 64), "records")  # read by five branches
    parts = [lines.select(F.lit("records").alias("k")), R.record_faults(lines).select(F.lit("faults").alias("k")), R.missing_partitions(lines, 6).select(F.lit("short_lists").alias("k"))]
    return reduce(DataFrame.union, parts).agg(*[F.count_if(F.col("k") == k).alias(k) for k in ("records", "faults", "short_lists")])


from . import queries_holes as queries_holes  # noqa: E402  registers its queries, and reads this module's helpers
from . import queries_pivots as queries_pivots  # noqa: E402
