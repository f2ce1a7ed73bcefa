"""Dependency states on tables: reachability, robustness and least numbers of pivots.

A state is a row: state_id, w vertices, a root, targets, a vertex for each column, sources, a mask of vertices for each
column, and mobile, the places of columns that may be given up.  A column's target is reached when one of
its sources is.  A pivot at a column whose sources hold the root swaps root and target in it.  Searches go by
rounds over all states at once: a round is one expression over the frontier, one ``distinct`` and one anti-join with
the states seen, each a stored table, so a lost executor costs only its tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.solve import spread
from ..sources.stored import cut

STATE = ["root", "targets", "sources"]


def bit(v: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), v)


def reached(removed: Column | None = None) -> Column:
    """Mask of the vertices that the root reaches, without a removed target and its column."""
    columns = F.sequence(F.lit(0), F.size("targets") - 1)

    def take(seen: Column, i: Column) -> Column:
        t = F.get("targets", i)
        leads = F.get("sources", i).bitwiseAND(seen) != 0
        return F.when(leads if removed is None else leads & (t != removed), seen.bitwiseOR(bit(t))).otherwise(seen)

    # As many rounds as columns reach all that can be reached.
    every = F.flatten(F.array_repeat(columns, F.size("targets")))
    return F.when(F.size("targets") > 0, F.aggregate(every, bit(F.col("root")), take)).otherwise(bit(F.col("root")))


def robust() -> Column:
    """Whether some mobile column's sources are all reached without its target."""
    return F.exists("mobile", lambda c: F.get("sources", c).bitwiseAND(F.bitwise_not(reached(F.get("targets", c)))) == 0)


def outdegrees() -> Column:
    """For each vertex the number of columns that have it among their sources."""
    return F.transform(F.sequence(F.lit(0), F.col("w") - 1), lambda v: F.size(F.filter("sources", lambda s: s.bitwiseAND(bit(v)) != 0)))


def judged(states: DataFrame) -> DataFrame:
    """states -> with outdegrees, reachable (the root reaches every vertex) and robust."""
    return states.withColumns({"outdegrees": outdegrees(), "reachable": reached() == bit(F.col("w")) - 1, "robust": robust()})


def pivots(frontier: DataFrame) -> DataFrame:
    """states -> the states one pivot away, repeats included."""
    root = F.col("root")
    rows = frontier.withColumn("c", F.explode(F.sequence(F.lit(0), F.size("targets") - 1))).where(F.get("sources", F.col("c")).bitwiseAND(bit(root)) != 0)
    t = F.get("targets", F.col("c"))
    source = F.transform("sources", lambda s, i: F.when(i == F.col("c"), s.bitwiseXOR(bit(root)).bitwiseOR(bit(t))).otherwise(s))
    target = F.transform("targets", lambda v, i: F.when(i == F.col("c"), root).otherwise(v))
    # Under their final names, a lambda would take the new root for the old one.
    kept = [c for c in frontier.columns if c not in STATE]
    return rows.select(*kept, t.alias("new_root"), target.alias("new_targets"), source.alias("new_sources")).toDF(*kept, *STATE)


def depths(states: DataFrame, most: int | None = None) -> DataFrame:
    """states, with distinct state_id and at least a column each -> (state_id, depth, status): the least number of pivots to a
    robust state; status is resolved, exhausted (all states that pivots lead to were seen, none robust) or
    bounded (more than ``most`` pivots would be needed to tell).

    Only states still open go on to a round.  The driver sees whether a frontier is empty."""
    key = ["state_id", *STATE]
    frontier = cut(spread(states.select("state_id", "mobile", *STATE), "state_id").withColumn("robust", robust()), "frontier")
    seen, found, depth = frontier.select(*key), [], 0
    while True:
        done = frontier.groupBy("state_id").agg(F.bool_or("robust").alias("robust")).where("robust").select("state_id", F.lit(depth).alias("depth"))
        found.append(done)
        left = frontier.join(done, "state_id", "left_anti").drop("robust")
        if most is not None and depth >= most:
            break
        depth += 1
        new = spread(pivots(left).distinct().join(seen, key, "left_anti"), "state_id")
        frontier = cut(new.withColumn("robust", robust()), "frontier")
        if frontier.isEmpty():
            left = frontier.drop("robust")
            break
        seen = seen.unionByName(frontier.select(*key))
    known = found[0]
    for more in found[1:]:
        known = known.unionByName(more)
    waiting = left.select("state_id").distinct().withColumn("waits", F.lit(True))
    every = states.select("state_id").join(known, "state_id", "left").join(waiting, "state_id", "left")
    status = F.when(F.col("depth").isNotNull(), "resolved").when(F.col("waits"), "bounded").otherwise("exhausted")
    return every.select("state_id", "depth", status.alias("status"))
