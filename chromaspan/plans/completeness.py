"""Completeness of sharded runs as anti-joins and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def union_audit(direct: DataFrame, sharded: DataFrame, key: str, shard: str) -> DataFrame:
    """One row: rows of the direct stream and of all shards, keys in several shards, repeated keys,
    keys missing from the shards and keys that only shards have.  One aggregation by key."""
    both = direct.select(F.col(key), F.lit(1).alias("a"), F.lit(None).cast("long").alias("s")).union(sharded.select(F.col(key), F.lit(0), F.col(shard).cast("long")))
    by_key = both.groupBy(key).agg(F.sum("a").alias("a"), F.count("s").alias("b"), F.min("s").alias("lo"), F.max("s").alias("hi"))
    n = lambda test, name: F.count_if(test).alias(name)
    return by_key.agg(
        F.coalesce(F.sum("a"), F.lit(0)).alias("direct_rows"), F.coalesce(F.sum("b"), F.lit(0)).alias("shard_rows"), n(F.col("lo") < F.col("hi"), "overlapping"), n(F.col("b") > F.greatest("a", F.lit(1)), "repeated"),
        n((F.col("a") > 0) & (F.col("b") == 0), "missing"), n((F.col("a") == 0) & (F.col("b") > 0), "extra"))


def shard_receipts(sharded: DataFrame, key: str, shard: str, count: int) -> DataFrame:
    """(shard, records, digest) for shards 0..count-1, also empty ones: the digest is of all keys,
    whatever their order."""
    spark = sharded.sparkSession
    known = spark.range(count).select(F.col("id").alias(shard))
    got = sharded.groupBy(F.col(shard).cast("long").alias(shard)).agg(F.count("*").alias("records"), F.bit_xor(F.xxhash64(key)).alias("digest"))
    return known.join(got, shard, "left").select(shard, F.coalesce("records", F.lit(0)).cast("long").alias("records"), F.coalesce("digest", F.lit(0)).cast("long").alias("digest"))


def missing_records(expected: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed run still has to do."""
    return expected.join(done.select(key), key, "left_anti")


def prefix_mismatches(expected: DataFrame, done: DataFrame, index: str, key: str) -> DataFrame:
    """(index, expected, found) where a checkpoint isn't a prefix of the regenerated stream."""
    pair = expected.select(index, F.col(key).alias("expected")).join(done.select(index, F.col(key).alias("found")), index, "full_outer")
    return pair.where(F.col("found").isNotNull() & ~F.col("expected").eqNullSafe(F.col("found")))


def adjacent_repeats(rows: DataFrame, index: str, key: str, group: str) -> DataFrame:
    """Rows equal to the one before them in their group."""
    before = F.lag(key).over(Window.partitionBy(group).orderBy(index))
    return rows.withColumn("before", before).where(F.col("before") == F.col(key)).drop("before")


def index_gaps(rows: DataFrame, index: str, group: str) -> DataFrame:
    """(group, rows, first, last) of groups whose indices aren't 0, 1, 2, ... once each."""
    got = rows.groupBy(group).agg(F.count("*").alias("rows"), F.count_distinct(index).alias("distinct"), F.min(index).alias("first"), F.max(index).alias("last"))
    return got.where((F.col("first") != 0) | (F.col("last") != F.col("rows") - 1) | (F.col("distinct") != F.col("rows"))).drop("distinct")
