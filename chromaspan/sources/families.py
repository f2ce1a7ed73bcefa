"""Graph families projected from the lineitem table.

A graph is one row: graph_id, n (vertices 0..n-1) and its edges as a sorted array of (u, v), u < v.
One aggregation by graph_id builds it; what follows works on the arrays and needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.graphs import shift_left, shift_right
from .stored import cut

#: Vertices up to which a graph's pairs are gathered as bits.
BITS = 11
#: Graphs with the same edges, on average, that one task gives their rows where sets of edges may be many.
TOGETHER = 4096


def from_pairs(pairs: DataFrame, n: int) -> DataFrame:
    """pairs(graph_id, a, b), any orientation, loops and repeats -> graphs(graph_id, n, edges)."""
    a, b = F.col("a").cast("int"), F.col("b").cast("int")
    edge = F.struct(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
    return pairs.where("a <> b").groupBy("graph_id").agg(F.sort_array(F.collect_set(edge)).alias("edges")).select("graph_id", F.lit(n).alias("n"), "edges")


def from_remainders(pairs: DataFrame, n: int) -> DataFrame:
    """``from_pairs`` where a and b are remainders modulo n; those of negative numbers are 1 - n and more.

    While it is gathered, a graph is a bit for each pair of vertices: rows add up in place in buffers of fixed size, and
    what is shuffled is a few longs a graph and task, where sets of pairs were objects that were sorted.  Pairs of
    vertices from 0 on have the first long for themselves, so the others are looked into only where they aren't 0."""
    if n > BITS:
        return from_pairs(pairs, n)
    every = [(u, v) for u in range(1 - n, n) for v in range(u + 1, n)]
    usual, odd = [p for p in every if p[0] >= 0], [p for p in every if p[0] < 0]
    words = [usual, *(odd[i : i + 63] for i in range(0, len(odd), 63))]
    a, b = F.col("a").cast("int"), F.col("b").cast("int")
    u, v = F.least(a, b), F.greatest(a, b)
    # The pair's number among ``every``, or among ``usual``: the pairs of lesser vertices come before it.
    number = lambda least: F.shiftright((F.col("u") - least) * (2 * n - 1 - least - F.col("u")), 1) + F.col("v") - F.col("u") - 1
    rows = pairs.where("a <> b").select("graph_id", u.alias("u"), v.alias("v"))
    rows = rows.select("graph_id", F.when(F.col("u") >= 0, number(0)).otherwise(len(usual) + number(1 - n)).alias("i"))
    bounds = [0, *accumulate(map(len, words))]
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    bits = [F.bit_or(F.when((F.col("i") >= x) & (F.col("i") < y), shift_left(one, F.col("i") - x)).otherwise(none)).alias(f"w{k}") for k, (x, y) in enumerate(zip(bounds, bounds[1:]))]
    kind = "array<struct<u:int,v:int>>"

    def listed(k: int, word: list[tuple[int, int]]) -> Column:
        known = F.array(*[F.struct(F.lit(x).alias("u"), F.lit(y).alias("v")) for x, y in word]).cast(kind)
        return F.filter(known, lambda p, i: shift_right(F.col(f"w{k}"), i).bitwiseAND(one) == 1)

    found = listed(0, usual)
    if odd:
        below = range(1, len(words))
        some = reduce(Column.__or__, [F.col(f"w{k}") != 0 for k in below])
        found = F.when(some, F.concat(*[listed(k, words[k]) for k in below], found)).otherwise(found)
    return rows.groupBy("graph_id").agg(*bits).select("graph_id", F.lit(n).alias("n"), found.alias("edges"))


def graphs(spark: SparkSession, sf_dir: str, n: int, k: int) -> DataFrame:
    """The family P(n, k): orders dealt k to a graph, parts and suppliers as vertices modulo n."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return from_remainders(rows.select(F.expr(f"l_orderkey div {k}").alias("graph_id"), (F.col("l_partkey") % n).alias("a"), (F.col("l_suppkey") % n).alias("b")), n)


def edges(of: DataFrame) -> DataFrame:
    """Long form (graph_id, edge_index, u, v)."""
    return of.select("graph_id", F.posexplode("edges").alias("edge_index", "e")).select("graph_id", "edge_index", "e.u", "e.v")


def vertices(of: DataFrame) -> DataFrame:
    return of.select("graph_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("v"))


def merged(rows: DataFrame) -> DataFrame:
    """rows(graph_id, n, edges) -> (same_as, n, edges, copies), stored: a row for each set of edges that there is, called
    by the least graph_id that has it.  Graphs of n vertices have at most 2 ** (n (n - 1) / 2) of them, however many rows."""
    return cut(rows.groupBy("n", "edges").agg(F.min("graph_id").alias("same_as"), F.count("*").alias("copies")), "merged")


def shared(rows: DataFrame, work: Callable[[DataFrame], DataFrame], store: bool = True) -> DataFrame:
    """``work`` of rows(graph_id, n, edges), which tells of each graph by its edges alone, done once for equal graphs;
    every graph gets the rows of its like.  ``store`` keeps what was done as a table, so that joins know its size.

    Without it sets of edges may be many, and neither they nor what was done pass through the driver: a stored table's
    bytes, which decide on a broadcast, may be a sixtieth of what it then takes there, and the size of what follows an
    explode isn't told by its input.  So both joins sort.  A set that very many graphs have is then worked on once for
    each ``TOGETHER`` of them, under graph_ids of its own, so that no task gives rows to all of them."""
    known = merged(rows)
    if store:
        found = cut(work(known.select(F.col("same_as").alias("graph_id"), "n", "edges")).withColumnRenamed("graph_id", "same_as"), "shared")
        of = rows.select("graph_id", "n", "edges").join(known, ["n", "edges"]).select("graph_id", "same_as")
    else:
        known, more = known.where("same_as is not null"), F.expr(f"copies div {TOGETHER}")
        called = F.struct("same_as", "part")
        once = known.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), more)))
        found = work(once.select(called.alias("graph_id"), "n", "edges")).withColumnRenamed("graph_id", "same_as").hint("merge")
        of = rows.select("graph_id", "n", "edges").join(known.hint("merge"), ["n", "edges"])
        of = of.withColumn("part", F.pmod(F.xxhash64("graph_id"), more + 1)).select("graph_id", called.alias("same_as"))
    return of.join(found, "same_as").select("graph_id", *[c for c in found.columns if c != "same_as"])
