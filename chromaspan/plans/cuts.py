"""The cut loop: problems solved with few of their conflicts, and those that a solution breaks added until none is.

Each round is a partition of a stored table: what was cut so far, the solution, and the conflicts that it
breaks.  A run that broke off goes on behind the last round that is whole, and a replay holds every stored
round against the problems and the round before it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.problems import semantic_digest
from ..operators.solve import solve, spread
from ..sources.stored import cut

KEY = ["graph_id", "partition_index"]
PROBLEM = [*KEY, "items", "colours", "conflicts", "fixed"]
PAIRS = "array<struct<i:int,j:int>>"
ROUND = f"graph_id long, partition_index int, digest string, cuts {PAIRS}, status string, assignment array<int>, broken {PAIRS}, nodes long, round int"


class OtherProblems(ValueError):
    """The stored rounds are of other problems, or not what the loop would have stored."""


def broken(conflicts: Column, assignment: Column) -> Column:
    """The conflicts whose two items have one colour."""
    return F.filter(conflicts, lambda p: F.get(assignment, p["i"]) == F.get(assignment, p["j"]))


def _solved(rows: DataFrame, backend: str, max_nodes: int | None) -> DataFrame:
    """Problems with digest and cuts -> a round's rows but for its number."""
    kept = rows.select(*KEY, "digest", F.col("conflicts").alias("all"), F.col("cuts"), "items", "colours", F.col("cuts").alias("conflicts"), "fixed")
    found = solve(spread(kept, *KEY), backend, max_nodes)
    over = F.when(F.col("status") == "witness", broken(F.col("all"), F.col("assignment"))).otherwise(F.array().cast(PAIRS))
    return found.select(*KEY, "digest", "cuts", "status", "assignment", over.alias("broken"), "nodes")


def _open(rounds: DataFrame, number: int) -> DataFrame:
    """(key, cuts) of the problems that the next round solves: their solution broke conflicts."""
    return rounds.where((F.col("round") == number) & (F.size("broken") > 0)).select(*KEY, F.array_sort(F.array_union("cuts", "broken")).alias("cuts"))


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The rounds below a path, None before any."""
    try:
        return spark.read.schema(ROUND).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _told(problems: DataFrame) -> DataFrame:
    return cut(problems.select(*PROBLEM, semantic_digest(F.col("items"), F.col("colours"), F.col("conflicts"), F.col("fixed")).alias("digest")), "problems")


def loop(problems: DataFrame, path: str, backend: str = "dsatur-iterative-v1", max_nodes: int | None = None, max_rounds: int | None = None) -> DataFrame:
    """problems(graph_id, partition_index, items, colours, conflicts, fixed) -> (graph_id, partition_index, status, rounds,
    cuts, assignment), cuts being how many conflicts were needed.

    A witness breaks no conflict; candidate_unsat with some conflicts is so with all; a problem
    still open after ``max_rounds`` rounds, or whose search ended at ``max_nodes``, is unknown.  Rounds that are stored
    below ``path`` aren't solved again; they must be of the same problems."""
    spark = problems.sparkSession
    told = _told(problems)
    waiting, number = told.select(*KEY, F.array().cast(PAIRS).alias("cuts")), 0
    rounds = stored(spark, path)
    while max_rounds is None or number < max_rounds:
        expected = waiting.count()
        if not expected:
            break
        here = rounds.where(F.col("round") == number) if rounds is not None else None
        # A round whose writing broke off has fewer rows, or none, and is written anew.
        if here is None or here.count() != expected:
            made = _solved(told.join(waiting, KEY), backend, max_nodes).withColumn("round", F.lit(number))
            made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("round").parquet(path)
            rounds = stored(spark, path)
            here = rounds.where(F.col("round") == number)
        same = here.select(*KEY, "digest", "cuts").join(told.select(*KEY, "digest").join(waiting, KEY), [*KEY, "digest", "cuts"], "left_semi").count()
        if same != expected:
            raise OtherProblems(f"round {number} below {path} isn't of these problems")
        waiting, number = _open(rounds, number), number + 1
    if rounds is None:
        rounds = spark.createDataFrame([], ROUND)
    last = rounds.where(F.col("round") < number).groupBy(*KEY).agg(F.max_by(F.struct("status", "assignment", "broken", F.size("cuts").alias("cuts")), "round").alias("x"), (F.max("round") + 1).alias("rounds"))
    status = F.when((F.col("x.status") == "witness") & (F.size("x.broken") > 0), "unknown").otherwise(F.coalesce("x.status", F.lit("unknown")))
    good = F.when(status == "witness", F.col("x.assignment"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("int")
    return problems.select(*KEY).join(last, KEY, "left").select(*KEY, status.alias("status"), zero("rounds").alias("rounds"), zero("x.cuts").alias("cuts"), good.alias("assignment"))


def replay(problems: DataFrame, path: str) -> DataFrame:
    """(graph_id, partition_index, round, fault) of the stored rounds: digest, cuts (not those of the round before with what it
    broke), broken (not what the solution breaks), fixed (the solution changes a given colour),
    palette (it has other colours or items), proper (it breaks a cut), missing and extra rows.

    Nothing is solved: a claim that no solution exists is the solver's, for ``proofs`` to judge."""
    spark = problems.sparkSession
    rounds = stored(spark, path)
    if rounds is None:
        rounds = spark.createDataFrame([], ROUND)
    told = _told(problems)
    joined = rounds.join(told.withColumnRenamed("digest", "own"), KEY, "left")
    before = rounds.select(*KEY, (F.col("round") + 1).alias("round"), F.array_sort(F.array_union("cuts", "broken")).alias("due"), (F.size("broken") > 0).alias("open"))
    joined = joined.join(before, [*KEY, "round"], "left")
    due = F.when(F.col("round") == 0, F.array().cast(PAIRS)).otherwise(F.col("due"))
    wit = F.col("status") == "witness"
    at = lambda i: F.get("assignment", i)
    tests = {
        "extra": F.col("own").isNull() | ((F.col("round") > 0) & ~F.coalesce("open", F.lit(False))), "digest": F.col("digest") != F.col("own"), "cuts": ~F.col("cuts").eqNullSafe(due),
        "broken": wit & ~F.col("broken").eqNullSafe(broken(F.col("conflicts"), F.col("assignment"))), "fixed": wit & F.exists("fixed", lambda f: ~at(f["item"]).eqNullSafe(f["color"])),
        "palette": wit & ((F.size("assignment") != F.col("items")) | F.exists("assignment", lambda c: ~c.between(0, F.col("colours") - 1))), "proper": wit & F.exists("cuts", lambda p: at(p["i"]) == at(p["j"])),
    }
    own = lambda name, test: F.coalesce(test, F.lit(False)) & (F.lit(name == "extra") | F.col("own").isNotNull())
    found = F.filter(F.array(*[F.when(own(name, test), name) for name, test in tests.items()]), lambda x: x.isNotNull())
    faults = [joined.select(*KEY, "round", F.explode(found).alias("fault"))]
    first = told.select(*KEY, F.lit(0).alias("round"))
    # Behind an open round there must be another one; the last of all may have been the last allowed.
    top = rounds.agg(F.max("round").alias("top"))
    after = before.where("open").select(*KEY, "round").join(F.broadcast(top), F.col("round") <= F.col("top")).select(*KEY, "round")
    faults.append(first.union(after).join(rounds.select(*KEY, "round"), [*KEY, "round"], "left_anti").select(*KEY, "round", F.lit("missing").alias("fault")))
    return reduce(DataFrame.union, faults)
