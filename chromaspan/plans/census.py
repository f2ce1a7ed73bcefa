"""Censuses: every equitable partition of every eligible graph, solved, verified and summed up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import partitions as P
from ..operators import verify as V
from ..operators.canonical import classes
from ..operators.refutation import refute
from ..operators.search import searched, solved
from ..operators.solve import spread
from ..sources.stored import cut
from .proofs import verdicts

#: The checks of a universal census, (backend, palette offset).
CHECKS = [("dsatur-iterative-v1", 1), ("static-order-iterative-v1", 1), ("dsatur-iterative-v1", 2)]
STATUSES = ["verified_all", "candidate_unsat", "unknown", "error", "skipped"]


def _judged(rows: DataFrame) -> DataFrame:
    """Solved auxiliary rows with color_count -> the same with total and status: a witness counts only
    if the colouring of the auxiliary graph and the total colouring that it gives are both found
    proper by verifiers that know nothing of the solvers; otherwise the status is error."""
    colors = F.col("assignment")
    good_h = V.is_rainbow(F.col("h_edges"), colors, F.col("color_count"), F.col("marked"))
    total = V.project_to_total(F.col("n"), F.col("edges"), F.col("h_edges"), F.col("pair_edges"), colors)
    rows = rows.withColumn("total", F.when(F.col("status") == "witness", total))
    good_g = V.is_total(F.col("n"), F.col("edges"), F.col("total.vertex_colors"), F.col("total.edge_colors"))
    sound = F.when(F.col("status") != "witness", True).otherwise(F.coalesce(good_h & good_g, F.lit(False)))
    return rows.withColumn("status", F.when(sound, F.col("status")).otherwise("error"))


def checks(rows: DataFrame, most: int | None = None, wanted: list[tuple[str, int]] = CHECKS, max_nodes: int | None = None, max_seconds: float | None = None) -> DataFrame:
    """graphs -> (graph_id, partition_index, backend, palette_offset, color_count, status, nodes,
    backtracks, ...) for each partition and check, witnesses verified."""
    aux = P.auxiliary(spread(P.partitions(rows, most), "graph_id", "partition_index"))
    return _judged(solved(aux, wanted, max_nodes, max_seconds))


def verdict(outcome: Column, started: Column, differ: Column, broke: Column, unknown: Column, failed: Column) -> tuple[Column, Column]:
    """(status, outcome_code) of a graph: outside the domain it's skipped; no check at all, checks of
    offset 1 that disagree on a partition, and refuted claims are errors; then unknown,
    candidate_unsat, verified_all."""
    cases = [
        (outcome == "generator_order_mismatch", "error", outcome), (outcome != "", "skipped", outcome), (~started, "error", F.lit("empty_check_transcript")), (differ, "error", F.lit("backend_status_disagreement")),
        (broke, "error", F.lit("partition_check_error")), (unknown, "unknown", F.lit("incomplete_partition_check")), (failed, "candidate_unsat", F.lit("candidate_partition_nonextension")),
    ]
    status, code = F.when(cases[0][0], cases[0][1]), F.when(cases[0][0], cases[0][2])
    for test, name, text in cases[1:]:
        status, code = status.when(test, name), code.when(test, text)
    return status.otherwise("verified_all"), code.otherwise("verified_all_partitions")


def universal(rows: DataFrame, most: int | None = None, wanted: list[tuple[str, int]] = CHECKS, max_nodes: int | None = None, order: int | None = None) -> DataFrame:
    """(graph_id, status, outcome_code, partitions, checks, witnesses) for every graph, by ``verdict``."""
    one = F.when(F.col("palette_offset") == 1, F.col("status"))
    n = lambda s: F.count_if(F.col("status") == s)
    by_part = checks(rows, most, wanted, max_nodes).groupBy("graph_id", "partition_index").agg(
        F.coalesce(F.min(one) != F.max(one), F.lit(False)).alias("differ"), F.count("*").alias("checks"), n("witness").alias("witnesses"), n("error").alias("errors"), n("unknown").alias("unknown"), n("candidate_unsat").alias("failures"))
    done = by_part.groupBy("graph_id").agg(
        F.bool_or("differ").alias("differ"), F.count("*").alias("partitions"), *[F.sum(c).alias(c) for c in ("checks", "witnesses", "errors", "unknown", "failures")])
    every = P.profile(rows, order).select("graph_id", "outcome").join(done, "graph_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    # A partition that some check is missing of, or has twice, wasn't checked as it should be.
    broke = (zero("errors") > 0) | (zero("checks") != len(wanted) * zero("partitions"))
    status, code = verdict(F.col("outcome"), zero("partitions") > 0, F.coalesce("differ", F.lit(False)), broke, zero("unknown") > 0, zero("failures") > 0)
    return every.select("graph_id", status.alias("status"), code.alias("outcome_code"), *[zero(c).alias(c) for c in ("partitions", "checks", "witnesses")])


def by_class(rows: DataFrame, most: int | None = None, wanted: list[tuple[str, int]] = CHECKS, max_nodes: int | None = None) -> DataFrame:
    """The rows of ``universal`` and class_id, with one graph of each isomorphism class solved.

    Isomorphic graphs have the same partitions but for names, and those extend or not alike.  Only a bound
    ``max_nodes`` may tell them apart: then a class has the outcome of its canonical graph."""
    known = cut(classes(rows), "classes")
    solved_once = known.select(F.col("class_id").alias("graph_id"), "n", F.col("canonical").alias("edges")).distinct()
    outcomes = universal(solved_once, most, wanted, max_nodes).withColumnRenamed("graph_id", "class_id")
    of_graph = rows.select("graph_id", "n", "edges").join(known.select("class_id", "n", "edges"), ["n", "edges"]).select("graph_id", "class_id")
    return of_graph.join(outcomes, "class_id").select("graph_id", "class_id", *outcomes.columns[1:])


def _started(rows: DataFrame, offset: int, backend: str, stop_at: str, **limits) -> DataFrame:
    """Verified rows of the partitions that a search started, one graph a row of the shuffle."""
    eligible = spread(P.profile(rows).where("outcome = ''").select("graph_id", "n", "edges", "d", "pairs"), "graph_id")
    found = searched(eligible, offset, backend, stop_at, **limits).withColumn("color_count", (F.col("d") + offset).cast("int"))
    return _judged(P.auxiliary(found))


def _outcome(rows: DataFrame, found: DataFrame, status: Column) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    by_graph = found.groupBy("graph_id").agg(
        F.count_if(F.col("partition_index") >= 0).alias("started"), n("witness").alias("witnesses"), n("candidate_unsat").alias("failures"), n("unknown").alias("unknown"), n("truncated").alias("truncated"), n("error").alias("errors"),
        F.min(F.when(F.col("status") == "witness", F.col("partition_index"))).alias("first_partition"), F.max_by(F.struct("pair_edges", "single_vertices", "assignment", "total"), F.when(F.col("status") == "witness", -F.col("partition_index"))).alias("witness"))
    out = P.profile(rows).select("graph_id", "outcome").join(by_graph, "graph_id", "left")
    return out.select("graph_id", F.when(F.col("outcome") != "", "skipped").otherwise(status).alias("status"), "first_partition", F.coalesce("started", F.lit(0)).alias("started"), F.coalesce("witnesses", F.lit(0)).alias("witnesses"), F.coalesce("failures", F.lit(0)).alias("failures"), F.coalesce("unknown", F.lit(0)).alias("unknown"), (F.coalesce("truncated", F.lit(0)) > 0).alias("truncated"), "witness")


def search(rows: DataFrame, offset: int = 2, backend: str = "dsatur-iterative-v1", max_partitions: int | None = None, max_nodes: int | None = None, max_seconds: float | None = None) -> DataFrame:
    """(graph_id, status, first_partition, started, witnesses, failures, unknown, truncated, witness)
    for every graph: the search ends at the first partition that extends.

    witness: that one's pairs, singles, auxiliary colouring and total colouring.  Without one the
    status is error if a claim was refuted or no partition was there to start, unknown if a
    partition or the list of them was cut short, and only then candidate_unsat.  Skipped graphs
    have none."""
    found = _started(rows, offset, backend, "witness", max_partitions=max_partitions, max_nodes=max_nodes, max_seconds=max_seconds)
    none = F.coalesce("started", F.lit(0)) == 0
    status = F.when(F.col("errors") > 0, "error").when(F.col("witnesses") > 0, "witness").when(F.col("truncated") + F.col("unknown") > 0, "unknown").when(none, "error").otherwise("candidate_unsat")
    return _outcome(rows, found, status)


def check_all(rows: DataFrame, offset: int = 2, backend: str = "dsatur-iterative-v1", max_partitions: int | None = None, max_nodes: int | None = None, max_seconds: float | None = None) -> DataFrame:
    """The columns of ``search`` where every partition must extend: it ends at the first that doesn't,
    and the status is witness only if all were started and verified."""
    found = _started(rows, offset, backend, "candidate_unsat", max_partitions=max_partitions, max_nodes=max_nodes, max_seconds=max_seconds)
    none = F.coalesce("started", F.lit(0)) == 0
    status = F.when(F.col("errors") > 0, "error").when(F.col("failures") > 0, "candidate_unsat").when(F.col("truncated") + F.col("unknown") > 0, "unknown").when(none, "error").otherwise("witness")
    return _outcome(rows, found, status)


def existential(rows: DataFrame, most: int | None = None, offset: int = 2, backend: str = "dsatur-iterative-v1", max_nodes: int | None = None) -> DataFrame:
    """(graph_id, status, first_partition) of ``search``; a graph that needs more than ``most`` pairs
    raises an error."""
    if most is not None:
        short = F.raise_error(F.concat(F.lit("a graph needs "), (F.col("n") - F.col("d")).cast("string"), F.lit(f" pairs, more than the {most} allowed")))
        rows = P.profile(rows).withColumn("n", F.when((F.col("outcome") == "") & (F.col("pairs") > most), short.cast("int")).otherwise(F.col("n"))).select("graph_id", "n", "edges")
    return search(rows, offset, backend, max_nodes=max_nodes).select("graph_id", "status", "first_partition")


def refuted(rows: DataFrame, offset: int = 0, backend: str = "dsatur-iterative-v1", max_nodes: int | None = None) -> DataFrame:
    """(graph_id, class_id, partitions, proved, steps) for every graph that ``search`` finds
    candidate_unsat: its partitions, those of which the proof that none extends was accepted, and the
    proofs' clauses.  One graph of each isomorphism class is refuted."""
    known = cut(classes(rows), "classes")
    once = known.select(F.col("class_id").alias("graph_id"), "n", F.col("canonical").alias("edges")).distinct()
    failed = search(once, offset, backend).where("status = 'candidate_unsat'").select("graph_id")
    problems = P.problem(P.auxiliary(P.partitions(once.join(failed, "graph_id"))), F.lit(offset))
    problems = cut(problems.select("graph_id", "partition_index", "items", "colours", "conflicts", "fixed"), "problems")
    proof = cut(refute(problems, max_nodes)[1], "proof")
    sums = verdicts(problems, proof).groupBy(F.col("graph_id").alias("class_id")).agg(F.count("*").alias("partitions"), F.count_if("accepted").alias("proved"), F.sum("steps").alias("steps"))
    of_graph = rows.select("graph_id", "n", "edges").join(known.select("class_id", "n", "edges"), ["n", "edges"]).select("graph_id", "class_id")
    return of_graph.join(sums, "class_id").select("graph_id", "class_id", "partitions", "proved", "steps")


def status_counts(census: DataFrame, names: list[str] = STATUSES) -> DataFrame:
    """(status, graphs, partitions, checks) with every status present."""
    spark = census.sparkSession
    known = spark.createDataFrame([(s,) for s in names], "status string")
    counts = census.groupBy("status").agg(F.count("*").alias("graphs"), F.sum("partitions").alias("partitions"), F.sum("checks").alias("checks"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return known.join(counts, "status", "left").select("status", zero("graphs"), zero("partitions"), zero("checks"))
