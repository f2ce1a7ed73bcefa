"""Equitable partitions: matchings of the complement and two independent counts of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import graphs as G
from ..functions.graphs import shift_left


def profile(rows: DataFrame, order: int | None = None) -> DataFrame:
    """graphs -> graphs with d (maximum degree + 1), pairs and singles of an equitable partition,
    and outcome: '' or the first reason not to take the graph: it hasn't the order that a generator
    was asked for (an error), or lies outside the domain (skipped)."""
    top = F.array_max(G.degrees(F.col("n"), F.col("edges")))
    rows = rows.withColumn("d", top + 1)
    outcome = F.when(2 * (F.col("d") - 1) < F.col("n"), "outside_high_degree_filter").when((F.col("d") > F.col("n")) | (F.col("n") > 2 * F.col("d")), "outside_auxiliary_regime").otherwise("")
    if order is not None:
        outcome = F.when(F.col("n") != order, "generator_order_mismatch").otherwise(outcome)
    return rows.withColumn("outcome", outcome).withColumn("pairs", F.col("n") - F.col("d")).withColumn("singles", 2 * F.col("d") - F.col("n"))


def matchings(rows: DataFrame, size: str, most: int | None = None) -> DataFrame:
    """rows(graph_id, n, edges, size, ...) -> a row for each matching of ``size`` complement edges,
    with idx, their indices in order.  Rounds add an edge behind the last one to rows that still need
    one, on arrays, without a shuffle.

    ``most`` bounds size, and so the rounds; a row that needs more raises an error rather than
    go without matchings.  Without it the bound is taken from the rows."""
    if most is None:
        most = rows.agg(F.max(size)).first()[0] or 0  # one number
    none = F.array().cast("array<int>")
    more = F.raise_error(F.concat(F.lit("a graph needs "), F.col(size).cast("string"), F.lit(f" pairs, more than the {most} allowed")))
    rows = rows.withColumn("free", G.complement(F.col("n"), F.col("edges"))).withColumn("idx", F.when(F.col(size) > most, more.cast("array<int>")).otherwise(none)).withColumn("used", F.lit(0).cast("long"))

    def add() -> Column:
        def fits(i: Column) -> Column:
            e = F.get("free", i)
            return (i > F.coalesce(F.array_max("idx"), F.lit(-1))) & (F.col("used").bitwiseAND(shift_left(F.lit(1).cast("long"), e["u"]).bitwiseOR(shift_left(F.lit(1).cast("long"), e["v"]))) == 0)

        # As many edges must be left behind i as are still to come.
        room = F.size("free") - (F.col(size) - F.size("idx"))
        return F.when(F.size("idx") >= F.col(size), F.array(F.lit(-1))).when(room < 0, F.array().cast("array<int>")).otherwise(F.filter(F.sequence(F.lit(0), F.greatest(room, F.lit(0))), fits))

    others = [c for c in rows.columns if c not in ("idx", "used")]
    for _ in range(most):
        rows = rows.select(*others, "idx", "used", F.explode(add()).alias("i"))
        e = F.get("free", F.col("i"))
        bits = shift_left(F.lit(1).cast("long"), e["u"]).bitwiseOR(shift_left(F.lit(1).cast("long"), e["v"]))
        rows = rows.select(*others, F.when(F.col("i") < 0, F.col("idx")).otherwise(F.concat("idx", F.array("i"))).alias("idx"), F.when(F.col("i") < 0, F.col("used")).otherwise(F.col("used").bitwiseOR(bits)).alias("used"))
    return rows.where(F.size("idx") == F.col(size)).drop("used")


def partitions(rows: DataFrame, most: int | None = None) -> DataFrame:
    """Eligible graphs -> a row for each equitable partition, in the order of its pairs:
    partition_index, pair_edges, single_vertices."""
    eligible = profile(rows).where("outcome = ''")
    found = matchings(eligible, "pairs", most)
    place = F.row_number().over(Window.partitionBy("graph_id").orderBy("idx")) - 1
    pairs = F.transform("idx", lambda i: F.get("free", i))
    singles = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda v: ~F.exists("pair_edges", lambda e: (e["u"] == v) | (e["v"] == v)))
    return found.withColumn("partition_index", place).withColumn("pair_edges", pairs).withColumn("single_vertices", singles).drop("free", "idx")


def counted(n: int, free: Column, size: Column) -> Column:
    """The number of matchings of ``size`` among the edges ``free`` on n vertices, by a table of
    how many matchings cover exactly each set of vertices."""
    masks = F.sequence(F.lit(0), F.lit((1 << n) - 1))
    first = F.transform(masks, lambda m: F.when(m == 0, 1).otherwise(0).cast("long"))

    def add(table: Column, e: Column) -> Column:
        bits = shift_left(F.lit(1), e["u"]).bitwiseOR(shift_left(F.lit(1), e["v"]))
        return F.transform(table, lambda x, m: x + F.when(m.bitwiseAND(bits) == bits, F.get(table, m.bitwiseXOR(bits))).otherwise(0))

    table = F.aggregate(free, first, add)
    return F.aggregate(F.transform(table, lambda x, m: F.when(F.bit_count(m) == 2 * size, x).otherwise(0)), F.lit(0).cast("long"), lambda a, x: a + x)


def merged_counts(rows: DataFrame, size: str, most: int | None = None) -> DataFrame:
    """rows(graph_id, n, edges, size) -> (graph_id, counted): the number of matchings of ``size`` edges of the
    complement, by states that merge.

    A round decides one vertex of every graph: it stays single or is matched with a later one.  What
    matters from then on is which later vertices are taken and how many pairs are to come; states
    that agree in both are one row.  ``most`` bounds n, and so the rounds, and is at most 62."""
    if most is None:
        most = rows.agg(F.max("n")).first()[0] or 0  # one number
    one = F.lit(1).cast("long")
    bit = lambda v: shift_left(one, v)
    at = F.sequence(F.lit(0), F.col("n") - 1)
    free = G.complement(F.col("n"), F.col("edges"))
    later = F.transform(at, lambda v: F.aggregate(F.filter(free, lambda e: e["u"] == v), F.lit(0).cast("long"), lambda m, e: m.bitwiseOR(bit(e["v"]))))
    large = F.raise_error(F.concat(F.lit("a graph has "), F.col("n").cast("string"), F.lit(f" vertices, more than the {min(most, 62)} allowed"))).cast("int")
    rows = rows.withColumn("n", F.when(F.col("n") > min(most, 62), large).otherwise(F.col("n")))
    states = rows.where(F.col(size) >= 0).select("graph_id", "n", later.alias("later"), F.lit(0).cast("long").alias("taken"), F.col(size).cast("int").alias("left"), one.alias("ways"))
    for v in range(min(most, 62)):
        mine, last = 1 << v, F.col("n") <= v
        partners = F.filter(F.sequence(F.lit(v), F.col("n") - 1), lambda w: (F.get("later", F.lit(v)).bitwiseAND(bit(w)) != 0) & (F.col("taken").bitwiseAND(bit(w)) == 0))
        stay = F.array(F.struct(F.col("taken").bitwiseAND(F.lit(~mine)).alias("taken"), F.col("left").alias("left")))
        paired = F.transform(partners, lambda w: F.struct(F.col("taken").bitwiseOR(bit(w)).alias("taken"), (F.col("left") - 1).alias("left")))
        none = F.col("taken").bitwiseAND(mine) != 0
        more = F.when(last | none | (F.col("left") == 0), stay).otherwise(F.concat(stay, paired))
        states = states.select("graph_id", "n", "later", "ways", F.explode(more).alias("s")).select("graph_id", "n", "later", F.col("s.taken").alias("taken"), F.col("s.left").alias("left"), "ways")
        # Each pair to come needs two vertices that are left.
        enough = F.col("n") - (v + 1) - F.bit_count("taken") >= 2 * F.col("left")
        states = states.where(last | enough).groupBy("graph_id", "n", "later", "taken", "left").agg(F.sum("ways").alias("ways"))
    found = states.where("left = 0").groupBy("graph_id").agg(F.sum("ways").alias("counted"))
    return rows.select("graph_id").join(found, "graph_id", "left").select("graph_id", F.coalesce("counted", F.lit(0)).alias("counted"))


def auxiliary(rows: DataFrame) -> DataFrame:
    """partitions -> with h_n, h_edges (sorted) and marked, the indices in it of pair and star edges."""
    star = F.transform("single_vertices", lambda v: F.struct(v.alias("u"), F.col("n").alias("v")))
    added = F.concat("pair_edges", star)
    rows = rows.withColumn("h_n", F.col("n") + F.when(F.size("single_vertices") > 0, 1).otherwise(0)).withColumn("added", added).withColumn("h_edges", F.sort_array(F.concat("edges", "added")))
    return rows.withColumn("marked", F.filter(F.sequence(F.lit(0), F.size("h_edges") - 1), lambda i: F.array_contains("added", F.get("h_edges", i)))).drop("added")


def problem(rows: DataFrame, offset: Column) -> DataFrame:
    """auxiliary rows -> with items, colours (d + offset), conflicts and fixed: marked edges differ
    pairwise and have colours 0, 1, ... in order."""
    all_marked = F.flatten(F.transform("marked", lambda i: F.transform(F.filter("marked", lambda j: j > i), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    conflicts = F.array_sort(F.array_union(G.line_conflicts(F.col("h_edges")), all_marked))
    fixed = F.transform("marked", lambda m, i: F.struct(m.alias("item"), i.alias("color")))
    return rows.withColumn("items", F.size("h_edges")).withColumn("colours", (F.col("d") + offset).cast("int")).withColumn("conflicts", conflicts).withColumn("fixed", fixed)
