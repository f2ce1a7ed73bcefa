"""Tables that cut a plan's lineage: Parquet under ``spark.checkpoint.dir``, so that a lost executor costs
only the tasks that ran there."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def new_path(spark: SparkSession, name: str) -> str:
    """A folder that nothing uses yet; only a local session may lack the setting."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="chromaspan-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{name}-{uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df and returns the table that was written."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str, **counters: Column) -> tuple[DataFrame, dict[str, int]]:
    """As ``cut``, with aggregates over the rows that the writing job itself observes, so no second pass reads them.

    The observation is in the job's last stage, whose tasks count once each, however often they were tried."""
    path, seen = new_path(df.sparkSession, name), Observation()
    df.observe(seen, *[c.alias(k) for k, c in counters.items()]).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get
