"""Canonical forms: graphs that are isomorphic, and no others, get the same edges.

Vertices are coloured by refinement: a vertex's new colour is the place of its colour and of the
hashes of its neighbours' colours among all vertices.  Where colours tie, each vertex of the first cell in
turn is told apart from the rest, and refinement goes on.  Every way to the end orders the vertices;
the least of the edge lists that those orders give is the canonical one.

Hashes only order cells.  If two collide a cell stays larger and has more ways to its end, of which
the least is the same for all relabelings all the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import graphs as G
from ..sources.families import shared
from ..sources.stored import cut
from .solve import spread

#: Refinements behind each choice: fewer leave more choices, never another form.
ROUNDS = 2


def refined(colours: Column, near: Column) -> Column:
    """Colours after one round; a colour is the number of vertices in cells before its own."""
    mixed = lambda us: F.aggregate(us, F.lit(0).cast("long"), lambda a, u: a + F.shiftright(F.xxhash64(F.get(colours, u)), 8))
    keys = F.transform(near, lambda us, v: F.struct(F.get(colours, v).alias("c"), mixed(us).alias("h")))
    return G.let(keys, lambda k: F.transform(k, lambda a: F.size(F.filter(k, lambda b: b < a))))


def _refined(colours: Column, near: Column) -> Column:
    for _ in range(ROUNDS):
        colours = G.let(colours, lambda c: refined(c, near))
    return colours


def choices(colours: Column, near: Column) -> Column:
    """The vertices of the first cell of several, one of each set of twins: swapping twins changes no edge,
    so they have the same ways to the end.  [-1] where all colours differ."""
    at = F.sequence(F.lit(0), F.size(colours) - 1)
    tied = F.array_min(F.filter(colours, lambda c: F.size(F.filter(colours, lambda x: x == c)) > 1))
    without = lambda v, w: F.array_except(F.get(near, v), F.array(w))
    twin = lambda v: lambda w: (w < v) & (F.get(colours, w) == tied) & (without(v, w) == without(w, v))
    cell = F.filter(at, lambda v: (F.get(colours, v) == tied) & ~F.exists(at, twin(v)))
    return F.when(tied.isNull(), F.array(F.lit(-1))).otherwise(cell)


def forms(rows: DataFrame, most: int | None = None) -> DataFrame:
    """rows(graph_id, n, edges) -> (graph_id, n, edges, canonical).

    ``most`` bounds n, and so the rounds of choices; a graph of more vertices raises an error.
    Without it the bound is taken from the rows."""
    if most is None:
        most = rows.agg(F.max("n")).first()[0] or 0  # one number
    large = F.raise_error(F.concat(F.lit("a graph has "), F.col("n").cast("string"), F.lit(f" vertices, more than the {most} allowed"))).cast("int")
    at = F.sequence(F.lit(0), F.when(F.col("n") > most, large).otherwise(F.col("n")) - 1)
    near = F.when(F.col("n") > 0, F.transform(at, lambda v: G.neighbours(v, F.col("edges")))).otherwise(F.array().cast("array<array<int>>"))
    rows = rows.select("graph_id", "n", "edges", near.alias("near"))
    rows = rows.select("*", _refined(F.transform("near", lambda us: F.lit(0)), F.col("near")).alias("colours"))
    for _ in range(most - 1):
        rows = rows.select("graph_id", "n", "edges", "near", "colours", F.explode(choices(F.col("colours"), F.col("near"))).alias("v"))
        c = F.get("colours", F.col("v"))
        apart = F.transform("colours", lambda x, w: F.when((x == c) & (w != F.col("v")), x + 1).otherwise(x))
        rows = rows.select("graph_id", "n", "edges", "near", F.when(F.col("v") < 0, F.col("colours")).otherwise(_refined(apart, F.col("near"))).alias("colours"))
    return rows.select("graph_id", "n", "edges", G.relabel(F.col("edges"), F.col("colours")).alias("form")).groupBy("graph_id", "n", "edges").agg(F.min("form").alias("canonical"))


def classes(rows: DataFrame, most: int | None = None) -> DataFrame:
    """rows(graph_id, n, edges) -> (class_id, n, edges, canonical), a row for each labelled graph there is:
    class_id is the least graph_id among all that are isomorphic.

    Equal graphs are merged before anything is refined, so a graph that a third of all rows hold is
    one row.  Those that are left are dealt over tasks: they are few bytes, but each has many ways."""
    once = spread(rows.groupBy("n", "edges").agg(F.min("graph_id").alias("graph_id")), "n", "edges")
    found = forms(once, most)
    least = found.groupBy("n", "canonical").agg(F.min("graph_id").alias("class_id"))
    return found.join(least, ["n", "canonical"]).select("class_id", "n", "edges", "canonical")


def alike(rows: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` of rows(graph_id, n, edges), which tells the same of isomorphic graphs, done once for each class, by its
    canonical graph; every graph gets the rows of its class.  On six vertices there are 156 classes, however many rows."""

    def once(known: DataFrame) -> DataFrame:
        of_class = cut(classes(known), "classes")
        found = work(of_class.select(F.col("class_id").alias("graph_id"), "n", F.col("canonical").alias("edges")).distinct()).withColumnRenamed("graph_id", "class_id")
        of = known.join(of_class.select("class_id", "n", "edges"), ["n", "edges"]).select("graph_id", "class_id")
        return of.join(found, "class_id").drop("class_id")

    return shared(rows, once)
