"""Refutations with proofs: clauses as rows, unit propagation as rounds of equi-joins, branching level by level.

A node is a problem and the literals decided on the way to it.  Every level propagates all nodes of all
problems at once; a node without conflict branches over the literals left in its smallest open clause.
The negated decisions of every node that ended or branched are a clause of the proof, deepest first:
each follows from the clauses before it by propagation alone, and the last one is empty.

plans/proofs.py checks such proofs and shares no code with this module.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import cut
from . import cnf

KEY = ["graph_id", "partition_index"]
NODE = [*KEY, "path"]
NONE = "array<int>"


def clauses(problems: DataFrame) -> DataFrame:
    """problems(graph_id, partition_index, items, colours, conflicts, fixed) -> a row for each literal of
    each clause: (graph_id, partition_index, clause, literal, var)."""
    found = cnf.clauses(F.col("items"), F.col("colours"), F.col("conflicts"), F.col("fixed"))
    rows = problems.select(*KEY, F.posexplode(found).alias("clause", "literals"))
    return rows.select(*KEY, "clause", F.explode("literals").alias("literal")).withColumn("var", F.abs("literal"))


def _sizes(formula: DataFrame) -> DataFrame:
    """Of each clause its length, the sum of its literals and how many are negative."""
    return formula.groupBy(*KEY, "clause").agg(F.count("*").alias("size"), F.sum("literal").alias("total"), F.count_if(F.col("literal") < 0).alias("negative"))


def _touched(nodes: DataFrame, formula: DataFrame) -> DataFrame:
    """(node, clause, kept, lost, gone, negative_gone): whether a literal is true, how many are false, their sum
    and how many of them are negative, for clauses with a literal
    whose variable the node has a value for."""
    known = nodes.select(*NODE, F.explode("literals").alias("held")).withColumn("var", F.abs("held"))
    no = F.col("literal") == -F.col("held")
    return known.join(formula, [*KEY, "var"]).groupBy(*NODE, "clause").agg(
        F.bool_or(F.col("literal") == F.col("held")).alias("kept"), F.count_if(no).alias("lost"), F.coalesce(F.sum(F.when(no, F.col("literal"))), F.lit(0)).alias("gone"), F.count_if(no & (F.col("literal") < 0)).alias("negative_gone"))


def propagated(nodes: DataFrame, formula: DataFrame, sizes: DataFrame) -> DataFrame:
    """nodes(graph_id, partition_index, path, literals) after one round: literals with those of all unit
    clauses, conflict, and grew.  A clause's last literal is its sum less the sum of the false ones."""
    open_ = _touched(nodes, formula).where("NOT kept").join(sizes, [*KEY, "clause"])
    last = F.when(F.col("lost") == F.col("size") - 1, F.col("total") - F.col("gone")).cast("int")
    units = open_.groupBy(*NODE).agg(F.collect_set(last).alias("units"), F.bool_or(F.col("lost") == F.col("size")).alias("empty"))
    rows = nodes.join(units, NODE, "left").withColumn("now", F.array_union("literals", F.coalesce("units", F.array().cast(NONE))))
    clash = F.exists("now", lambda x: F.array_contains("now", -x))
    return rows.select(*NODE, F.col("now").alias("literals"), (F.coalesce("empty", F.lit(False)) | clash).alias("conflict"), (F.size("now") > F.size("literals")).alias("grew"))


def branched(nodes: DataFrame, formula: DataFrame, sizes: DataFrame, whole: DataFrame) -> DataFrame:
    """nodes after another round, with ``over``: the literals left in the open clause that had fewest,
    among clauses of which only positive ones were left; null where there is none.  With all other
    variables false, what is open then holds, but for clauses that no variable with a value is in."""
    open_ = _touched(nodes, formula).where("NOT kept").join(sizes, [*KEY, "clause"])
    last = F.when(F.col("lost") == F.col("size") - 1, F.col("total") - F.col("gone")).cast("int")
    choice = F.when((F.col("lost") < F.col("size")) & (F.col("negative") == F.col("negative_gone")), F.struct((F.col("size") - F.col("lost")).alias("left"), "clause"))
    found = open_.groupBy(*NODE).agg(F.collect_set(last).alias("units"), F.bool_or(F.col("lost") == F.col("size")).alias("empty"), F.min(choice)["clause"].alias("clause"))
    rows = nodes.join(found, NODE, "left").join(whole, [*KEY, "clause"], "left").withColumn("now", F.array_union("literals", F.coalesce("units", F.array().cast(NONE))))
    clash = F.exists("now", lambda x: F.array_contains("now", -x))
    over = F.filter("whole", lambda x: ~F.array_contains("now", -x))
    grew = F.col("grew") | (F.size("now") > F.size("literals"))
    return rows.select(*NODE, F.col("now").alias("literals"), grew.alias("grew"), (F.coalesce("empty", F.lit(False)) | clash).alias("conflict"), over.alias("over"))


def _untouched(nodes: DataFrame, formula: DataFrame, sizes: DataFrame, whole: DataFrame) -> DataFrame:
    """(node, other): the literals of the shortest clause of positive ones whose variables have no values."""
    fresh = nodes.join(sizes.where("negative = 0"), KEY).join(_touched(nodes, formula), [*NODE, "clause"], "left_anti")
    least = fresh.groupBy(*NODE).agg(F.min(F.struct("size", "clause"))["clause"].alias("clause"))
    return least.join(whole, [*KEY, "clause"]).select(*NODE, F.col("whole").alias("other"))


def refute(problems: DataFrame, max_nodes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """problems(graph_id, partition_index, items, colours, conflicts, fixed) -> (outcomes, proof).

    outcomes(graph_id, partition_index, status): refuted, satisfiable, or unknown where the search was
    stopped because a level had over ``max_nodes`` nodes.  proof(graph_id, partition_index, step,
    literals): the clauses of the refuted ones, in order from 0."""
    formula = cut(clauses(problems), "formula")
    sizes = cut(_sizes(formula), "clauses")
    first = formula.join(sizes.where("size = 1"), [*KEY, "clause"], "left_semi").groupBy(*KEY).agg(F.collect_set("literal").alias("literals"))
    none = F.array().cast(NONE)
    open_ = problems.select(*KEY).distinct().join(first, KEY, "left").select(*KEY, none.alias("path"), F.coalesce("literals", none).alias("literals"))
    whole = cut(formula.groupBy(*KEY, "clause").agg(F.sort_array(F.collect_list("literal")).alias("whole")), "whole")
    levels: list[DataFrame] = []
    ended = False
    while True:
        # Two rounds a level: what is still to propagate is found below, where there is more to go on.
        nodes = cut(propagated(open_, formula, sizes), "propagated")
        alive = branched(nodes.where("NOT conflict"), formula, sizes, whole)
        dead = nodes.where("conflict").select(*NODE, "literals", "grew", "conflict", F.lit(None).cast(NONE).alias("over"))
        level = cut(dead.union(alive.select(*dead.columns)), "level")
        stuck = "NOT conflict AND over IS NULL AND NOT grew"
        if not level.where(stuck).isEmpty():
            fresh = _untouched(level.where(stuck), formula, sizes, whole)
            level = cut(level.join(fresh, NODE, "left").withColumn("over", F.coalesce("over", "other")).drop("other"), "level")
        levels.append(level)
        models = level.where(stuck)
        living = level.where("NOT conflict AND (over IS NOT NULL OR grew)").join(models.select(*KEY), KEY, "left_anti")
        n = living.count()
        if not n:
            break
        if max_nodes is not None and n > max_nodes:
            ended = True
            break
        more = living.where("over IS NOT NULL").select(*KEY, "path", "literals", F.explode("over").alias("x"))
        more = more.select(*KEY, F.concat("path", F.array("x")).alias("path"), F.array_union("literals", F.array("x")).alias("literals"))
        open_ = more.union(living.where("over IS NULL").select(*NODE, "literals"))
    every = reduce(DataFrame.union, levels)
    models = every.where("NOT conflict AND over IS NULL AND NOT grew").select(*KEY).distinct()
    rest = living.select(*KEY).distinct() if ended else models.limit(0)
    outcomes = problems.select(*KEY).distinct().join(models.withColumn("model", F.lit(True)), KEY, "left").join(rest.withColumn("rest", F.lit(True)), KEY, "left")
    outcomes = cut(outcomes.select(*KEY, F.when(F.col("model"), "satisfiable").when(F.col("rest"), "unknown").otherwise("refuted").alias("status")), "outcomes")
    steps = every.where("conflict OR over IS NOT NULL").join(outcomes.where("status = 'refuted'"), KEY, "left_semi")
    order = Window.partitionBy(*KEY).orderBy(F.size("path").desc(), "path")
    return outcomes, steps.select(*KEY, (F.row_number().over(order) - 1).cast("long").alias("step"), F.transform("path", lambda x: -x).alias("literals"))


def line(literals: Column) -> Column:
    """A clause of a proof as text, ended by 0."""
    return F.array_join(F.transform(F.concat(literals, F.array(F.lit(0))), lambda x: x.cast("string")), " ")
