"""The matching-core falsifier: scopes of graphs, proper precolourings, and their extensions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import graphs as G
from ..operators import verify
from ..operators.solve import solve
from ..sources.stored import cut


def _adjacent(v: Column, edges: Column) -> Column:
    return F.transform(F.filter(edges, lambda e: (e["u"] == v) | (e["v"] == v)), lambda e: F.when(e["u"] == v, e["v"]).otherwise(e["u"]))


def scopes(rows: DataFrame) -> DataFrame:
    """(graph_id, any_nonempty, forest_nonempty, matching_nonempty, two_sided) by the graph's core."""
    rows = rows.withColumn("core", G.core(F.col("n"), F.col("edges"))).withColumn("d", G.degrees(F.col("n"), F.col("edges")))
    some = F.size("core") > 0
    ends = F.flatten(F.transform("core", lambda e: F.array(e["u"], e["v"])))
    matching = some & (F.size(F.array_distinct(ends)) == F.size(ends))
    close = lambda v, other: F.size(F.filter(_adjacent(v, F.col("edges")), lambda x: (x != other) & (F.get("d", x) == F.array_max("d") - 1))) >= 2
    two = matching & F.exists("core", lambda e: close(e["u"], e["v"]) & close(e["v"], e["u"]))
    return rows.select("graph_id", some.alias("any_nonempty"), (some & G.is_forest(F.col("n"), F.col("core"))).alias("forest_nonempty"), matching.alias("matching_nonempty"), two.alias("two_sided"))


def growth_strings(rows: DataFrame, n: int, blocks: str) -> DataFrame:
    """rows -> a row for each restricted-growth string ``colors`` of length n with blocks of at most
    two and at most ``blocks`` of them, by n rounds in place."""
    rows = rows.withColumn("colors", F.array().cast("array<int>"))
    others = [c for c in rows.columns if c != "colors"]
    for _ in range(n):
        top = F.coalesce(F.array_max("colors"), F.lit(-1))
        choices = F.filter(F.sequence(F.lit(0), F.least(top + 1, F.greatest(F.col(blocks) - 1, F.lit(0)))), lambda c: (F.size(F.filter("colors", lambda x: x == c)) < 2) & (F.col(blocks) > 0))
        rows = rows.select(*others, "colors", F.explode(choices).alias("c")).select(*others, F.concat("colors", F.array("c")).alias("colors"))
    return rows


def precolourings(rows: DataFrame, n: int) -> DataFrame:
    """graphs in scope -> a row for each proper vertex colouring with classes of at most two and at
    most maximum degree + 1 of them."""
    rows = rows.withColumn("blocks", F.array_max(G.degrees(F.col("n"), F.col("edges"))) + 1)
    every = growth_strings(rows, n, "blocks")
    return every.where(F.forall("edges", lambda e: F.get("colors", e["u"]) != F.get("colors", e["v"])))


def _solved(pre: DataFrame, extra: int, max_nodes: int | None = None) -> DataFrame:
    """Precolourings solved with maximum degree + ``extra`` colours, with bad, how many issues a witness has."""
    fixed = F.transform("colors", lambda c, v: F.struct(v.alias("item"), c.alias("color")))
    top = F.array_max(G.degrees(F.col("n"), F.col("edges")))
    kept = [c for c in pre.columns if c not in ("blocks", "items", "colours", "conflicts", "fixed")]
    problems = pre.select(*kept, (F.col("n") + F.size("edges")).alias("items"), (top + extra).cast("int").alias("colours"), G.conflicts(F.col("n"), F.col("edges")).alias("conflicts"), fixed.alias("fixed"))
    found = solve(problems, "dsatur-iterative-v1", max_nodes)
    issues = verify.total_issues(F.col("n"), F.col("edges"), F.slice("assignment", 1, F.col("n")), F.expr("slice(assignment, n + 1, size(edges))"))
    return found.withColumn("bad", F.when(F.col("status") == "witness", F.size(issues)).otherwise(0))


def extensions(rows: DataFrame, n: int, extra: int = 2) -> DataFrame:
    """(graph_id, precolourings, witnesses, violations): each precolouring fixed, edges solved with
    maximum degree + ``extra`` colours, and witnesses verified."""
    found = _solved(precolourings(rows, n), extra)
    return found.groupBy("graph_id").agg(F.count("*").alias("precolourings"), F.count_if(F.col("status") == "witness").alias("witnesses"), F.sum("bad").alias("violations"))


def run(rows: DataFrame, n: int, extra: int = 2, most: int | None = None, max_nodes: int | None = None) -> DataFrame:
    """(graph_id, status, precolourings, started, failure, colors): precolourings in their order, until the first
    that isn't a verified witness.

    Rounds take twice as many of each graph that has none yet as the round before, so a graph that fails early
    costs little and one that doesn't is done in a few rounds.  status is complete_positive, bounded_positive
    where only the first ``most`` were tried, else the failed one's: candidate_unsat, unknown, or error for a
    refuted claim.  failure and colors tell that one; started counts up to it."""
    place = F.row_number().over(Window.partitionBy("graph_id").orderBy("colors")) - 1
    pre = cut(precolourings(rows, n).withColumn("place", place), "precolourings")
    totals = pre.groupBy("graph_id").agg(F.count("*").alias("precolourings"))
    tried = pre if most is None else pre.where(F.col("place") < most)
    failed, first, width = [], 0, 1
    waiting = tried
    while not waiting.isEmpty():
        here = waiting.where(F.col("place") < first + width)
        found = _solved(here, extra, max_nodes).where("status <> 'witness' OR bad > 0")
        status = F.when(F.col("bad") > 0, "error").otherwise(F.col("status"))
        lost = found.groupBy("graph_id").agg(F.min(F.struct("place", status.alias("status"), "colors")).alias("x"))
        failed.append(cut(lost, "failed"))
        first, width = first + width, 2 * width
        waiting = tried.where(F.col("place") >= first).join(reduce(DataFrame.union, failed), "graph_id", "left_anti")
    every = reduce(DataFrame.union, failed) if failed else totals.limit(0).select("graph_id", F.lit(None).cast("struct<place:int,status:string,colors:array<int>>").alias("x"))
    out = totals.join(every, "graph_id", "left")
    bound = F.col("precolourings") if most is None else F.least("precolourings", F.lit(most))
    good = F.when(bound < F.col("precolourings"), "bounded_positive").otherwise("complete_positive")
    return out.select("graph_id", F.coalesce("x.status", good).alias("status"), "precolourings", F.coalesce(F.col("x.place") + 1, bound).cast("long").alias("started"), F.col("x.place").alias("failure"), "x.colors")


def receipt(found: DataFrame) -> DataFrame:
    """One row about a run: (status, graphs, started, first_graph, failure).  A run is complete_positive if all its
    graphs are, bounded_positive if none failed, else it has the status of the first graph that did."""
    positive = F.col("status").isin("complete_positive", "bounded_positive")
    first = F.min(F.when(~positive, F.struct("graph_id", "status", "failure"))).alias("x")
    sums = found.agg(F.count("*").alias("graphs"), F.coalesce(F.sum("started"), F.lit(0)).alias("started"), first, F.count_if(F.col("status") == "bounded_positive").alias("bounded"))
    status = F.coalesce("x.status", F.when(F.col("bounded") > 0, "bounded_positive").otherwise("complete_positive"))
    return sums.select(status.alias("status"), "graphs", "started", F.col("x.graph_id").alias("first_graph"), "x.failure")
