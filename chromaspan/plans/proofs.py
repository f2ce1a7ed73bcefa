"""Checks refutations by reverse propagation; shares no code with what makes them.

The clauses are derived again from the problems.  A step holds if, with all its literals false, unit
propagation over the problem's clauses and the steps before it ends in a conflict.  All steps of all
proofs are checked at once, each by itself, so a long proof is many rows and not one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stored import cut

PROBLEM = "graph_id, partition_index"


def formula(problems: DataFrame) -> DataFrame:
    """problems(graph_id, partition_index, items, colours, conflicts, fixed) -> the clauses that say
    each item has one colour, conflicting items differ and fixed colours hold: a row for each literal,
    (graph_id, partition_index, name, literal).  Item i has colour c if 1 + i * colours + c is true."""
    each = problems.selectExpr("graph_id", "partition_index", "colours", "explode(sequence(0, items - 1)) AS i").where("i >= 0")
    coloured = each.selectExpr("graph_id", "partition_index", "colours", "i", "explode(sequence(0, colours - 1)) AS c")
    some = coloured.selectExpr("graph_id", "partition_index", "concat('some ', i) AS name", "1 + i * colours + c AS literal")
    twice = coloured.selectExpr("*", "explode(sequence(0, colours - 1)) AS other").where("c < other")
    one = twice.selectExpr("graph_id", "partition_index", "concat('one ', i, ' ', c, ' ', other) AS name", "explode(array(-1 - i * colours - c, -1 - i * colours - other)) AS literal")
    pairs = problems.selectExpr("graph_id", "partition_index", "colours", "explode(conflicts) AS p").selectExpr("*", "explode(sequence(0, colours - 1)) AS c")
    differ = pairs.selectExpr("graph_id", "partition_index", "concat('differ ', p.i, ' ', p.j, ' ', c) AS name", "explode(array(-1 - p.i * colours - c, -1 - p.j * colours - c)) AS literal")
    given = problems.selectExpr("graph_id", "partition_index", "colours", "explode(fixed) AS f").selectExpr("graph_id", "partition_index", "concat('fixed ', f.item) AS name", "1 + f.item * colours + f.color AS literal")
    return some.union(one).union(differ).union(given)


def checked(problems: DataFrame, proof: DataFrame) -> DataFrame:
    """(graph_id, partition_index, step, holds) for every step of proof(graph_id, partition_index, step,
    literals).

    No clause of the problems, nor of a step once repeats are taken out, has a literal twice, so counts
    of rows are counts of literals.  Each round counts, by step and clause, literals that aren't false yet: none left is the conflict, one
    left is a new literal.  Rounds end when no step that still has no conflict learns anything."""
    steps = cut(proof.select("graph_id", "partition_index", F.col("step").cast("long").alias("step"), F.array_distinct("literals").alias("literals")), "steps")
    lemmas = steps.selectExpr("graph_id", "partition_index", "concat('step ', step) AS name", "step AS at", "explode(literals) AS literal")
    rows = cut(formula(problems).withColumn("at", F.lit(-1).cast("long")).unionByName(lemmas), "known").withColumn("var", F.abs("literal"))
    lengths = cut(rows.groupBy("graph_id", "partition_index", "name", "at").agg(F.count("*").alias("n"), F.sum("literal").alias("all")), "lengths")
    alone = lengths.where("n = 1").selectExpr("graph_id", "partition_index", "at AS unit_at", "CAST(`all` AS int) AS unit")
    # Of each step the literals that are true: those it denies, and unit clauses that come before it.
    start = steps.join(alone, ["graph_id", "partition_index"], "left").groupBy("graph_id", "partition_index", "step", "literals").agg(F.collect_set(F.when(F.col("unit_at") < F.col("step"), F.col("unit"))).alias("units"))
    waiting = start.selectExpr("graph_id", "partition_index", "step", "array_union(transform(literals, x -> -x), units) AS truth")
    done = []
    while True:
        truths = waiting.selectExpr("graph_id", "partition_index", "step", "explode(truth) AS t").withColumn("var", F.abs("t"))
        met = truths.join(rows, ["graph_id", "partition_index", "var"]).where("at < step").groupBy("graph_id", "partition_index", "step", "name", "at").agg(
            F.max(F.expr("literal = t")).alias("holds"), F.expr("count_if(literal = -t)").alias("k"), F.expr("sum(CASE WHEN literal = -t THEN literal ELSE 0 END)").alias("less"))
        left = met.where("NOT holds").join(lengths, ["graph_id", "partition_index", "name", "at"])
        news = left.groupBy("graph_id", "partition_index", "step").agg(F.max(F.expr("k = n")).alias("conflict"), F.collect_set(F.expr("CASE WHEN k = n - 1 THEN CAST(`all` - less AS int) END")).alias("news"))
        after = waiting.join(news, ["graph_id", "partition_index", "step"], "left").selectExpr(
            "graph_id", "partition_index", "step", "size(truth) AS was", "coalesce(conflict, false) OR exists(truth, x -> array_contains(truth, -x)) AS holds", "array_union(truth, coalesce(news, array())) AS truth")
        after = cut(after, "round")
        waiting = after.where("NOT holds AND size(truth) > was").select("graph_id", "partition_index", "step", "truth")
        done.append(after.where("holds OR size(truth) = was").select("graph_id", "partition_index", "step", "holds"))
        if waiting.isEmpty():
            break
    found = done[0]
    for more in done[1:]:
        found = found.union(more)
    return found


def verdicts(problems: DataFrame, proof: DataFrame) -> DataFrame:
    """(graph_id, partition_index, steps, wrong, accepted) for every problem: a proof is accepted if every
    step holds and one is the empty clause.  A problem without a proof isn't refuted."""
    closing = proof.groupBy("graph_id", "partition_index").agg(F.max(F.expr("size(literals) = 0")).alias("closed"))
    sums = checked(problems, proof).groupBy("graph_id", "partition_index").agg(F.count("*").alias("steps"), F.count_if(~F.col("holds")).alias("wrong"))
    rows = problems.select("graph_id", "partition_index").join(sums, ["graph_id", "partition_index"], "left").join(closing, ["graph_id", "partition_index"], "left")
    return rows.selectExpr("graph_id", "partition_index", "coalesce(steps, 0) AS steps", "coalesce(wrong, 0) AS wrong", "coalesce(closed AND wrong = 0, false) AS accepted")
