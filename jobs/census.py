"""Census of the graphs of an orders table: every equitable partition of every graph, with records by status.

    python -m jobs.census --lineitem sf0.1/lineitem.parquet --out /data/census --config jobs/census.json

Writes three tables below ``out``:

* ``graphs``, by shard: each graph's edges, graph6 text and fingerprint;
* ``records``, by status and shard: its isomorphism class, outcome and counts of partitions and checks;
* ``proofs``, by shard: for a graph of each class that isn't verified, the clauses of the proofs that a partition doesn't
  extend, as text, each step with the colours it was made for;
* ``verdicts``, by status: the proofs that an independent check accepted, and partitions without one;
* ``summary``: graphs, partitions and checks by status.

A run replaces what an earlier one left, table by table, so a run that broke off is run again.  The same
table and settings give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromaspan.functions import graphs as G
from chromaspan.operators import partitions as P
from chromaspan.operators.refutation import line, refute
from chromaspan.plans import census, completeness, proofs
from chromaspan.sources.families import from_pairs
from chromaspan.sources.stored import cut

from .common import LOG, command, read_back, written

#: order: vertices of a graph; orders_per_graph: orders that make one; shards: parts of each table;
#: checks: (solver, colours beyond the maximum degree + 1); max_nodes: bound on a search, or null.
SETTINGS = {"order": 6, "orders_per_graph": 4, "shards": 8, "checks": [list(c) for c in census.CHECKS], "max_nodes": None}
EDGES = "array<struct<u:int,v:int>>"
GRAPHS = f"graph_id long, n int, edges {EDGES}, graph6 string, fingerprint string, shard int"
RECORDS = "graph_id long, class_id long, outcome_code string, partitions long, checks long, witnesses long, status string, shard int"
PROOFS = "class_id long, partition_index int, palette_offset int, step long, clause string, shard int"
VERDICTS = "class_id long, partition_index int, palette_offset int, steps long, status string"
SUMMARY = "status string, graphs long, partitions long, checks long"


def pairs(lineitem: DataFrame, order: int, orders_per_graph: int) -> DataFrame:
    """(graph_id, a, b): parts and suppliers as vertices modulo the order, orders dealt to graphs."""
    return lineitem.select(F.expr(f"l_orderkey div {orders_per_graph}").alias("graph_id"), (F.col("l_partkey") % order).alias("a"), (F.col("l_suppkey") % order).alias("b"))


def proved(known: DataFrame, records: DataFrame, offset: int) -> tuple[DataFrame, DataFrame]:
    """(clauses, verdicts) for the partitions, in one graph of each class that isn't verified, that have no
    colouring with so many colours more than the maximum degree + 1."""
    failed = records.where("status = 'candidate_unsat'").groupBy("class_id").agg(F.min("graph_id").alias("graph_id"))
    rows = known.select("graph_id", "n", "edges").join(failed.where("graph_id = class_id").select("graph_id"), "graph_id")
    problems = P.problem(P.auxiliary(P.partitions(rows)), F.lit(offset)).select("graph_id", "partition_index", "items", "colours", "conflicts", "fixed")
    problems = cut(problems, "problems")
    outcomes, clauses = refute(problems)
    clauses = cut(clauses, "proof")
    wanted = problems.join(outcomes.where("status <> 'satisfiable'"), ["graph_id", "partition_index"], "left_semi")
    found = proofs.verdicts(wanted, clauses).select(F.col("graph_id").alias("class_id"), "partition_index", F.lit(offset).alias("palette_offset"), "steps", F.when(F.col("accepted"), "accepted").otherwise("open").alias("status"))
    return clauses.select(F.col("graph_id").alias("class_id"), "partition_index", F.lit(offset).alias("palette_offset"), "step", line(F.col("literals")).alias("clause")), found


def run(spark: SparkSession, lineitem: str, out: str, settings: dict = SETTINGS) -> None:
    """Censuses the graphs of the lineitem table."""
    shards = settings["shards"]
    table = spark.read.parquet(lineitem)
    LOG.info("reading %d rows of %s", table.count(), lineitem)
    made = from_pairs(pairs(table, settings["order"], settings["orders_per_graph"]), settings["order"])
    shard = F.pmod("graph_id", F.lit(shards)).cast("int").alias("shard")
    n, edges = F.col("n"), F.col("edges")
    # Rows of a shard meet in one task, of a large one in several: few files, none too large.
    written(made.select("graph_id", "n", "edges", G.graph6(n, edges).alias("graph6"), G.fingerprint(n, edges).alias("fingerprint"), shard).hint("rebalance", "shard"), f"{out}/graphs", "shard")

    known = read_back(spark, f"{out}/graphs", GRAPHS)
    found = census.by_class(known.select("graph_id", "n", "edges"), settings["order"] // 2, [tuple(c) for c in settings["checks"]], settings["max_nodes"])
    written(found.select(*[c for c in found.columns if c != "status"], "status", shard).hint("rebalance", "status", "shard"), f"{out}/records", "status", "shard")

    records = read_back(spark, f"{out}/records", RECORDS)
    audit = completeness.union_audit(known, records, "graph_id", "shard").first()
    if any(audit[c] for c in ("overlapping", "repeated", "missing", "extra")):
        raise RuntimeError(f"records don't match graphs: {audit.asDict()}")

    clauses, verdicts = spark.createDataFrame([], PROOFS).drop("shard"), spark.createDataFrame([], VERDICTS)
    if not records.where("status = 'candidate_unsat'").isEmpty():
        for offset in sorted({c[1] for c in settings["checks"]}):
            more = proved(known, records, offset)
            clauses, verdicts = clauses.union(more[0]), verdicts.union(more[1])
    written(clauses.withColumn("shard", F.pmod("class_id", F.lit(shards)).cast("int")).hint("rebalance", "shard"), f"{out}/proofs", "shard")
    written(verdicts.hint("rebalance", "status"), f"{out}/verdicts", "status")
    told = read_back(spark, f"{out}/verdicts", VERDICTS).agg(F.count_if(F.col("status") == "accepted").alias("accepted"), F.count_if(F.col("status") == "open").alias("open")).first()
    LOG.info("%d proofs accepted, %d partitions without one", told["accepted"], told["open"])

    written(census.status_counts(records), f"{out}/summary")
    for row in read_back(spark, f"{out}/summary", SUMMARY).where("graphs > 0").orderBy("status").collect():  # at most five rows
        LOG.info("%s: %d graphs, %d partitions, %d checks", row["status"], row["graphs"], row["partitions"], row["checks"])
    LOG.info("%d graphs, %d records", audit["direct_rows"], audit["shard_rows"])


def main(arguments: list[str] | None = None) -> None:
    command("census", SETTINGS, run, "lineitem", "out", arguments=arguments)


if __name__ == "__main__":
    main()
