"""Edges from a stream of events: each edge of a graph is taken once, counts are kept by graph."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER = 16


def edges(events: DataFrame) -> DataFrame:
    """events(event_id, user_id, ...) -> (graph_id, u, v) of the events that join two vertices."""
    a, b = (F.col("user_id") % ORDER).cast("int"), (F.col("event_id") % ORDER).cast("int")
    rows = events.select(F.expr(f"user_id div {ORDER}").alias("graph_id"), F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
    return rows.where("u <> v")


def edge_counts(stream: DataFrame) -> DataFrame:
    """Distinct edges by graph: state is one row for each edge and one for each graph."""
    return edges(stream).dropDuplicates(["graph_id", "u", "v"]).groupBy("graph_id").agg(F.count("*").alias("edges"))


def windowed_counts(stream: DataFrame, late: str = "1 hour", width: str = "10 minutes") -> DataFrame:
    """Edge events by window of ``ts``; windows close ``late`` behind the latest event."""
    rows = stream.withWatermark("ts", late)
    a, b = F.col("user_id") % ORDER, F.col("event_id") % ORDER
    return rows.where(a != b).groupBy(F.window("ts", width)).agg(F.count("*").alias("edges")).select(F.col("window.start").alias("start"), "edges")


def drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs edge_counts over the events table as a stream until it's used up.  Each batch writes the
    graphs whose count it changed, and a graph's latest count is that of its last batch."""
    source = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(source).schema
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="chromaspan-stream-")
    folder = f"{folder.rstrip('/')}/stream-{uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(schema)
    # A file source watches folders: a table that is one file is picked from its own.
    stream = reader.parquet(source) if whole else reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = edge_counts(stream).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema("graph_id long, edges long, batch long").parquet(f"{folder}/out")
    return rows.groupBy("graph_id").agg(F.max_by("edges", "batch").alias("edges"))
