"""Missing colours and two-colour components on arrays; canonical walks of the components by list ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stored import cut


def missing(n: Column, edges: Column, vertex_colors: Column, edge_colors: Column, palette: int) -> Column:
    """For each vertex the colours that neither it nor an edge there has (null edges have none)."""
    at = F.sequence(F.lit(0), F.size(edges) - 1)
    own = lambda v: F.transform(F.filter(at, lambda i: (F.get(edges, i)["u"] == v) | (F.get(edges, i)["v"] == v)), lambda i: F.get(edge_colors, i))
    free = lambda v: F.array_except(F.sequence(F.lit(0), F.lit(palette - 1)), F.concat(F.array(F.get(vertex_colors, v)), own(v)))
    return F.transform(F.sequence(F.lit(0), n - 1), free)


def components(rows: DataFrame, first: int, second: int) -> DataFrame:
    """rows(graph_id, n, edges, ec) -> (graph_id, root, vertices, edges) of the components with
    edges of two colours: one fold over the edges names each vertex by the least in its part."""
    at = F.sequence(F.lit(0), F.size("edges") - 1)
    picked = F.transform(F.filter(at, lambda i: F.get("ec", i).isin(first, second)), lambda i: F.get("edges", i))

    def merge(part: Column, e: Column) -> Column:
        a, b = F.get(part, e["u"]), F.get(part, e["v"])
        return F.transform(part, lambda x: F.when((x == a) | (x == b), F.least(a, b)).otherwise(x))

    rows = rows.where(F.size("edges") > 0).select("graph_id", "n", picked.alias("e"))
    rows = rows.withColumn("part", F.aggregate("e", F.sequence(F.lit(0), F.col("n") - 1), merge))
    roots = F.array_distinct(F.transform("e", lambda e: F.get("part", e["u"])))
    rows = rows.select("graph_id", "part", "e", F.explode(roots).alias("root"))
    count = lambda a, test: F.size(F.filter(a, test)).cast("long")
    return rows.select("graph_id", "root", count("part", lambda x: x == F.col("root")).alias("vertices"), count("e", lambda e: F.get("part", e["u"]) == F.col("root")).alias("edges"))


ARC = ["graph_id", "first", "second", "tail", "head"]
PAIR = ARC[:3]


def arcs(edges: DataFrame) -> DataFrame:
    """edges(graph_id, u, v, color), properly coloured -> both directions of each edge for every pair of the
    graph's colours, first < second, that its colour is in, with the head of the arc behind it, or null
    where the walk ends."""
    colours = edges.select("graph_id", "color").distinct()
    pairs = colours.withColumnRenamed("color", "first").join(colours.withColumnRenamed("color", "second"), "graph_id").where("first < second")
    both = F.explode(F.array(F.struct(F.col("u").alias("tail"), F.col("v").alias("head")), F.struct(F.col("v").alias("tail"), F.col("u").alias("head"))))
    each = edges.select("graph_id", "color", both.alias("e")).join(pairs, "graph_id").where("color = first OR color = second").select(*PAIR, "e.*", "color")
    behind = each.select(*PAIR, F.col("tail").alias("head"), F.col("color").alias("other"), F.col("head").alias("next"))
    return each.withColumn("other", F.col("first") + F.col("second") - F.col("color")).join(behind, [*PAIR, "head", "other"], "left").drop("other")


def _doubled(rows: DataFrame, rounds: int, **merged: Column) -> DataFrame:
    """Pointer doubling: rows(arc, to_tail, to_head, ...) whose pointers, and what they have summed up, reach twice
    as far after each round.  ``merged`` says how a column takes up the pointed one's, called its_<name>."""
    for _ in range(rounds):
        its = rows.select(*PAIR, F.col("tail").alias("to_tail"), F.col("head").alias("to_head"), F.col("to_tail").alias("its_tail"), F.col("to_head").alias("its_head"), *[F.col(c).alias(f"its_{c}") for c in merged])
        kept = [c for c in rows.columns if c not in (*merged, "to_tail", "to_head")]
        found = rows.join(its, [*PAIR, "to_tail", "to_head"], "left")
        rows = cut(found.select(*kept, F.col("its_tail").alias("t"), F.col("its_head").alias("h"), *[x.alias(f"new_{c}") for c, x in merged.items()]).toDF(*kept, "to_tail", "to_head", *merged), "doubled")
    return rows


def walks(edges: DataFrame) -> DataFrame:
    """edges(graph_id, u, v, color), properly coloured -> (graph_id, first, second, component, kind, position, tail,
    head, color): the canonical walk of every component of every two colours, arc by arc.

    A component is called by its least vertex.  A path is walked from its lesser end; a cycle from its least vertex
    along its edge of the first colour.  Positions are list ranks by pointer doubling: rounds are the
    logarithm of the longest walk, and no walk is ever in one task's memory."""
    every = cut(arcs(edges), "arcs")
    longest = every.groupBy(*PAIR).agg(F.count("*").alias("k")).agg(F.max("k")).first()[0] or 0  # one number
    rounds = max(0, longest - 1).bit_length()
    point = [F.when(F.col("next").isNotNull(), F.col("head")).alias("to_tail"), F.col("next").alias("to_head")]
    reach = _doubled(every.select(*ARC, "color", "next", *point, F.least("tail", "head").alias("least")), rounds, least=F.least("least", "its_least"))
    # A pointer that still leads on is on a cycle, which is opened at its least vertex.
    cyclic = F.col("to_head").isNotNull()
    opened = reach.select(*ARC, "color", "least", cyclic.alias("cyclic"), F.when(~cyclic | (F.col("head") != F.col("least")), F.col("next")).alias("next"))
    own = [F.lit(1).alias("count"), F.col("head").alias("end"), F.col("color").alias("last")]
    ranked = _doubled(opened.select(*ARC, "color", "least", "cyclic", *point, *own), rounds, count=F.col("count") + F.coalesce("its_count", F.lit(0)), end=F.coalesce("its_end", "end"), last=F.coalesce("its_last", "last"))
    back = ranked.select(*PAIR, F.col("tail").alias("head"), F.col("head").alias("tail"), F.col("count").alias("before"), F.col("end").alias("start"), F.col("least").alias("least_back"))
    chosen = F.when(F.col("cyclic"), F.col("last") == F.col("second")).otherwise(F.col("end") > F.col("start"))
    return ranked.join(back, ARC).where(chosen).select(
        *PAIR, F.least("least", "least_back").alias("component"), F.when(F.col("cyclic"), "cycle").otherwise("path").alias("kind"), (F.col("before") - 1).cast("int").alias("position"), "tail", "head", "color")


def walks_of_graphs(rows: DataFrame) -> DataFrame:
    """rows(graph_id, edges, ec), properly coloured -> the rows of ``walks``.

    Two colours' walks depend on the edges of these alone, so equal sets of them are walked once, whatever graphs they
    are in, and joined to every graph and pair of colours that has them."""
    coloured = F.transform("edges", lambda e, i: F.struct(e["u"].alias("u"), e["v"].alias("v"), F.get("ec", i).alias("color")))
    colours = F.array_sort(F.array_distinct("ec"))
    pairs = F.flatten(F.transform(colours, lambda a: F.transform(F.filter(colours, lambda b: b > a), lambda b: F.struct(a.alias("first"), b.alias("second")))))
    each = rows.select("graph_id", coloured.alias("e"), F.explode(pairs).alias("p")).select("graph_id", "p.*", F.filter("e", lambda x: (x["color"] == F.col("p.first")) | (x["color"] == F.col("p.second"))).alias("part"))
    key = ["first", "second", "part"]
    known = cut(each.select(*key).distinct().withColumn("pattern", F.monotonically_increasing_id()), "patterns")
    found = walks(known.select(F.col("pattern").alias("graph_id"), F.explode("part").alias("e")).select("graph_id", "e.*")).withColumnRenamed("graph_id", "pattern")
    walked = cut(known.select("pattern", "part").join(found, "pattern").drop("pattern"), "walks")
    return each.join(walked, key).select("graph_id", *[c for c in walked.columns if c != "part"])
