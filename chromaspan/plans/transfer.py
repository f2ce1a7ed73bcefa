"""The protected-transfer formula: its clauses as DataFrames of literals, and its DIMACS text.

Variables are numbered in the order rows R(f, h), exposed row RX(h), selected edges E(f, edge),
heads H(f, h); factors f and heads h run from 0 to 5, owners of factors are vertices 6..11, the
exposed vertex is 12 and the other outside vertices are 13..30.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Sizes of the formula's parts, its pinned row sizes and labels.
FACTORS, HEADS, OUTSIDE = 6, 6, tuple(range(6, 31))
ROW_SIZES = (3, 4, 4, 4, 4, 4)
EXPOSED = 0
SHORT_LABEL, LONG_LABEL, PIVOT = 0, 1, 0


def variables(spark: SparkSession) -> DataFrame:
    """(kind, f, a, b, id): R and H have head a, RX has head a, E has edge (a, b)."""
    small = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    grid = spark.range(FACTORS).select(F.col("id").cast("int").alias("f")).select("f", small(HEADS).alias("a"))
    rows = grid.select(F.lit("R").alias("kind"), "f", "a", F.lit(-1).alias("b"), F.lit(0).alias("part"))
    exposed = grid.where("f = 0").select(F.lit("RX").alias("kind"), F.lit(-1).alias("f"), "a", F.lit(-1).alias("b"), F.lit(1).alias("part"))
    edges = grid.select("f", "a", F.explode(F.sequence(F.lit(1), F.lit(OUTSIDE[-1]))).alias("b")).where("b > a AND b <> f + 6").select(F.lit("E").alias("kind"), "f", "a", "b", F.lit(2).alias("part"))
    heads = grid.select(F.lit("H").alias("kind"), "f", "a", F.lit(-1).alias("b"), F.lit(3).alias("part"))
    every = rows.union(exposed).union(edges).union(heads)
    # A table of fixed size, numbered in one place.
    from pyspark.sql import Window

    return every.select("kind", "f", "a", "b", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("part", "f", "a", "b")).alias("id"))


def _choose(ids: Column, sign: int, sizes: list[tuple[int, int]]) -> Column:
    """Clauses of all k of the n ids, negated for sign -1, for each (n, k)."""
    out = F.array().cast("array<array<int>>")
    for n, k in sizes:
        places = F.lit([list(c) for c in combinations(range(n), k)])
        out = F.when(F.size(ids) == n, F.transform(places, lambda p: F.transform(p, lambda i: sign * F.get(ids, i)))).otherwise(out)
    return out


def _pairs(ids: Column) -> Column:
    """At most one of the ids."""
    at = F.sequence(F.lit(0), F.size(ids) - 1)
    return F.flatten(F.transform(at, lambda i: F.transform(F.filter(at, lambda j: j > i), lambda j: F.array(-F.get(ids, i), -F.get(ids, j)))))


def base(v: DataFrame) -> DataFrame:
    """(clause) of the formula without pins."""
    ids = lambda rows, *by: rows.groupBy(*by).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    out = lambda rows, c: rows.select(F.explode(c).alias("clause"))
    r, rx, e, h = (v.where(F.col("kind") == k) for k in ("R", "RX", "E", "H"))
    parts = []
    by_factor = ids(r, "f").withColumn("k", F.get(F.lit(list(ROW_SIZES)), F.col("f")))
    six = lambda sign, k: _choose(F.col("ids"), sign, [(6, k)])
    parts += [out(by_factor, six(1, 6)), out(by_factor, six(-1, 5))]
    for k in sorted(set(ROW_SIZES)):  # exactly k of six
        own = by_factor.where(F.col("k") == k)
        parts += [out(own, six(1, 6 - k + 1)), out(own, six(-1, k + 1))]
    column = ids(r, "a").join(rx.select("a", F.col("id").alias("x")), "a")
    parts += [out(column, six(1, 4)), out(column, six(-1, 5))]
    with_x = lambda c, x: F.transform(c, lambda y: F.concat(F.array(x), y))
    parts += [out(column, with_x(six(-1, 4), -F.col("x"))), out(column, with_x(six(1, 3), F.col("x")))]
    exposed = ids(rx, "kind")
    parts += [out(exposed, six(-1, 5)), out(exposed, six(1, 6)), out(exposed, six(-1, 2))]
    parts.append(rx.select(F.array(F.when(F.col("a") == EXPOSED, F.col("id")).otherwise(-F.col("id"))).alias("clause")))
    owned = e.where("b BETWEEN 6 AND 11").withColumn("g", F.col("b") - 6).join(r.select(F.col("f").alias("g"), "a", F.col("id").alias("r")), ["g", "a"])
    parts.append(owned.select(F.array(-F.col("id"), -F.col("r")).alias("clause")))
    parts.append(e.where("b = 12").join(rx.select("a", F.col("id").alias("r")), "a").select(F.array(-F.col("id"), -F.col("r")).alias("clause")))
    ends = e.select("f", "id", F.explode(F.array("a", "b")).alias("end"))
    at_core = ids(ends.where("end < 6"), "f", "end")
    parts += [at_core.select(F.col("ids").alias("clause")), out(at_core, _pairs(F.col("ids")))]
    parts.append(out(ids(ends.where("end >= 6"), "f", "end"), _pairs(F.col("ids"))))
    parts.append(out(ids(e, "a", "b"), _pairs(F.col("ids"))))
    spokes = ids(e.where("b >= 6"), "f", "a")
    head = h.select("f", "a", F.col("id").alias("h"))
    parts.append(head.join(r.select("f", "a", F.col("id").alias("r")), ["f", "a"]).select(F.array(-F.col("h"), F.col("r")).alias("clause")))
    parts.append(head.join(spokes, ["f", "a"]).select(F.concat(F.array(-F.col("h")), "ids").alias("clause")))
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    return normal(every)


def normal(clauses: DataFrame) -> DataFrame:
    """Clauses as a set: literals distinct and ordered by variable, tautologies gone."""
    order = F.transform(F.array_sort(F.transform(F.array_distinct("clause"), lambda x: F.struct(F.abs(x).alias("v"), x.alias("x")))), lambda s: s["x"])
    rows = clauses.select(order.alias("clause"))
    return rows.where(~F.exists("clause", lambda x: F.array_contains("clause", -x))).distinct()


def pins(v: DataFrame, q: int) -> DataFrame:
    """The clauses that fix a transfer with head q, 1 or 3."""
    if q not in (1, 3):
        raise ValueError("the head of a protected transfer is 1 or 3")
    one = lambda test, sign: v.where(test).select(F.array(sign * F.col("id")).alias("clause"))
    kept = F.col("f") != SHORT_LABEL
    edge = lambda a, b: (F.col("kind") == "E") & kept & (F.col("a") == a) & (F.col("b") == b)
    row = lambda f, a: (F.col("kind") == "R") & (F.col("f") == f) & (F.col("a") == a)
    heads = v.where((F.col("kind") == "H") & kept & ~((F.col("f") == LONG_LABEL) & (F.col("a") == q)))
    some = heads.groupBy("kind").agg(F.sort_array(F.collect_list("id")).alias("clause")).select("clause")
    return one(row(SHORT_LABEL, q), -1).union(one(row(LONG_LABEL, PIVOT), -1)).union(one(row(LONG_LABEL, q), 1)).union(one(edge(q, 6 + SHORT_LABEL), -1)).union(one(edge(PIVOT, 6 + LONG_LABEL), -1)).union(some)


def formula(spark: SparkSession, q: int) -> DataFrame:
    v = variables(spark)
    return normal(base(v).union(pins(v, q)))


def dimacs_sha256(clauses: DataFrame, count: int) -> DataFrame:
    """(clauses, sha256): clauses ordered by length and literals, behind the header line."""
    one = clauses.agg(F.array_sort(F.collect_list(F.struct(F.size("clause").alias("n"), "clause"))).alias("all"))
    line = lambda c: F.concat(F.array_join(F.transform(c["clause"], lambda x: x.cast("string")), " "), F.lit(" 0\n"))
    text = F.concat(F.format_string("p cnf %d %d\n", F.lit(count), F.size("all")), F.array_join(F.transform("all", line), ""))
    return one.select(F.size("all").alias("clauses"), F.sha2(text, 256).alias("sha256"))


# --- models: decoding, semantics and endpoint witnesses -----------------------


def decode(v: DataFrame, model: DataFrame) -> tuple[DataFrame, DataFrame]:
    """model(id), the true variables -> rows(f, h) and factors(f, a, b)."""
    true = v.join(model, "id", "left_semi")
    rows = true.where("kind = 'R'").select("f", F.col("a").alias("h"))
    return rows, true.where("kind = 'E'").select("f", "a", "b")


def faults(rows: DataFrame, factors: DataFrame) -> DataFrame:
    """(fault, cases) of a model's rows and factors against the meaning of the formula, each fault
    derived anew: sizes of rows and columns, matchings that cover the core, disjoint factors, and
    edges that the completed complement doesn't have."""
    fault = lambda df, name: df.agg(F.count("*").alias("cases")).select(F.lit(name).alias("fault"), "cases")
    size = rows.groupBy("f").count()
    column = rows.groupBy("h").count()
    core = factors.select("f", F.explode(F.array("a", "b")).alias("v"), F.lit(1).alias("k")).groupBy("f", "v").agg(F.sum("k").alias("k"))
    complement = rows.select((F.col("f") + 6).alias("b"), F.col("h").alias("a")).union(column.where("count = 3").select(F.lit(12).alias("b"), F.col("h").alias("a")))
    covered = core.where("v < 6").groupBy("f").count()
    parts = [
        fault(size.where("count NOT BETWEEN 1 AND 4"), "row_size"), fault(column.where("count NOT BETWEEN 3 AND 4"), "column_size"), fault(core.where("k > 1"), "vertex_used_twice"),
        fault(covered.where("count <> 6"), "core_not_covered"), fault(factors.groupBy("a", "b").count().where("count > 1"), "edge_shared"), fault(factors.where("b = f + 6"), "own_owner"),
        fault(factors.join(complement, ["a", "b"], "left_semi"), "edge_of_complement"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.where("cases > 0")


def _oriented(rows: DataFrame, factors: DataFrame) -> DataFrame:
    """(f, a, b, head, tail, good): factor edges at each of their core ends; good if the head is in
    the factor's row."""
    both = factors.select("f", "a", "b", F.col("a").alias("head"), F.col("b").alias("tail")).union(factors.where("b < 6").select("f", "a", "b", F.col("b").alias("head"), F.col("a").alias("tail")))
    marked = rows.select("f", F.col("h").alias("head"), F.lit(True).alias("good"))
    return both.join(marked, ["f", "head"], "left").withColumn("good", F.coalesce("good", F.lit(False)))


def endpoint_witnesses(rows: DataFrame, factors: DataFrame) -> DataFrame:
    """(kind, f1..f3, a1.., b1.., h1.., t1.., g1.., spare, activated): edges of three factors, pairwise
    disjoint, oriented to three heads, with a spare head that is no tail and whose leaving gives a
    pair across the two triples of heads.

    Q0: all heads are in their rows.  Q1: one isn't, its row has the spare, its owner is no tail;
    old_outside if a good one has a tail outside the core, else new_outside_only.
    """
    o = _oriented(rows, factors)
    pick = lambda i: o.select(*[F.col(c).alias(f"{c}{i}") for c in ("f", "a", "b", "head", "tail", "good")])
    apart = lambda i, j: (F.col(f"f{i}") < F.col(f"f{j}")) & ~F.arrays_overlap(F.array(f"a{i}", f"b{i}"), F.array(f"a{j}", f"b{j}"))
    two = pick(1).join(pick(2), apart(1, 2))
    # Few rows, much work for each: over all cores.
    two = two.repartition(rows.sparkSession.sparkContext.defaultParallelism * 2, "f1", "a1", "b1", "a2", "b2")
    three = two.join(pick(3), apart(1, 3) & apart(2, 3))
    heads, tails = F.array("head1", "head2", "head3"), F.array("tail1", "tail2", "tail3")
    rest = F.array_except(F.lit(list(range(HEADS))), heads)
    across = lambda s: F.size(F.filter(rest, lambda x: (x != s) & (x < 3))) == 1
    spares = F.filter(rest, lambda s: across(s) & ~F.array_contains(tails, s))
    three = three.withColumn("spare", F.explode(spares))
    bad = F.filter(F.array(*[F.when(~F.col(f"good{i}"), F.col(f"f{i}")) for i in (1, 2, 3)]), lambda x: x.isNotNull())
    three = three.withColumn("bad", bad).where(F.size("bad") <= 1).withColumn("activated", F.get("bad", F.lit(0))).drop("bad")
    held = rows.select(F.col("f").alias("activated"), F.col("h").alias("spare"), F.lit(True).alias("held"))
    three = three.join(held, ["activated", "spare"], "left").where(F.col("activated").isNull() | (F.col("held") & ~F.array_contains(tails, F.col("activated") + 6)))
    old = F.exists(F.array(*[F.struct(F.col(f"good{i}").alias("g"), F.col(f"tail{i}").alias("t")) for i in (1, 2, 3)]), lambda x: x["g"] & (x["t"] >= 6))
    kind = F.when(F.col("activated").isNull(), "Q0").when(old, "Q1_old_outside").otherwise("Q1_new_outside_only")
    return three.withColumn("kind", kind).drop("held")


def anchored_witnesses(rows: DataFrame, factors: DataFrame) -> DataFrame:
    """Q0 and old-outside Q1 derived another way: from an anchor, a good edge with its tail outside,
    and two other factors in order.  Its cuts must equal those of ``endpoint_witnesses``."""
    o = _oriented(rows, factors)
    anchor = o.where("good AND tail >= 6").select(*[F.col(c).alias(f"{c}0") for c in ("f", "a", "b", "head", "tail", "good")])
    pick = lambda i: o.select(*[F.col(c).alias(f"{c}{i}") for c in ("f", "a", "b", "head", "tail", "good")])
    free = lambda i, j: (F.col(f"a{i}") != F.col(f"a{j}")) & (F.col(f"a{i}") != F.col(f"b{j}")) & (F.col(f"b{i}") != F.col(f"a{j}")) & (F.col(f"b{i}") != F.col(f"b{j}"))
    found = anchor.join(pick(1), (F.col("f0") != F.col("f1")) & free(0, 1)).join(pick(2), (F.col("f0") != F.col("f2")) & (F.col("f1") < F.col("f2")) & free(0, 2) & free(1, 2) & (F.col("good1") | F.col("good2")))
    taken = F.array(*[F.col(f"{x}{i}") for x in ("head", "tail") for i in range(3)])
    found = found.where("head0 <> head1 AND head0 <> head2 AND head1 <> head2")
    spare = F.explode(F.filter(F.sequence(F.lit(0), F.lit(HEADS - 1)), lambda s: ~F.array_contains(taken, s)))
    found = found.withColumn("spare", spare)
    low = sum((F.when(F.col(f"head{i}") < 3, 1).otherwise(0) for i in range(3)), F.when(F.col("spare") < 3, 1).otherwise(0))
    found = found.where(low == 2).withColumn("activated", F.when(~F.col("good1"), F.col("f1")).when(~F.col("good2"), F.col("f2")))
    held = rows.select(F.col("f").alias("activated"), F.col("h").alias("spare"))
    plain = found.where("activated IS NULL")
    turned = found.where("activated IS NOT NULL").join(held, ["activated", "spare"], "left_semi").where(~F.array_contains(F.array("tail0", "tail1", "tail2"), F.col("activated") + 6))
    return plain.unionByName(turned).select(*[c for c in plain.columns])


def cuts(found: DataFrame, v: DataFrame, places: tuple[int, int, int]) -> DataFrame:
    """(clause): for each witness, that not all its atoms hold.  Without the spare's atom the rows
    of a Q0 witness are the same for any spare."""
    e = v.where("kind = 'E'").select("f", "a", "b", "id")
    r = v.where("kind = 'R'").select("f", F.col("a").alias("h"), "id")
    for i in places:
        found = found.join(e.select(F.col("f").alias(f"f{i}"), F.col("a").alias(f"a{i}"), F.col("b").alias(f"b{i}"), F.col("id").alias(f"e{i}")), [f"f{i}", f"a{i}", f"b{i}"])
        found = found.join(r.select(F.col("f").alias(f"f{i}"), F.col("h").alias(f"head{i}"), F.col("id").alias(f"r{i}")), [f"f{i}", f"head{i}"])
    found = found.join(r.select(F.col("f").alias("activated"), F.col("h").alias("spare"), F.col("id").alias("s")), ["activated", "spare"], "left")
    atoms = [-F.col(f"e{i}") for i in places] + [F.when(F.col(f"good{i}"), -F.col(f"r{i}")).otherwise(F.col(f"r{i}")) for i in places]
    atoms.append(F.when(F.col("activated").isNotNull(), -F.col("s")))
    return normal(found.select(F.filter(F.array(*atoms), lambda x: x.isNotNull()).alias("clause")))
