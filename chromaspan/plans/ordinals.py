"""Dense ordinals of all rows, and bounded searches over shards of them.

Rows are sorted by range partitions.  A row's ordinal is its place in its partition and the number of rows in
the partitions before it, so no task sees more than a partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stored import cut

#: A row's id has its place in the low bits and its partition above them.
PLACE_BITS = 33


def numbered(rows: DataFrame, *keys: str | Column, name: str = "ordinal") -> DataFrame:
    """rows with their ordinals 0, 1, ... in the order of keys, which should tell rows apart: equal ones are in
    any order, and in one task.  The driver sees the number of rows of each partition."""
    ids = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("id", F.monotonically_increasing_id())
    stored = cut(ids, "ordered")
    counts = stored.groupBy(F.shiftright("id", PLACE_BITS).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    before, offsets = 0, []
    for r in counts:
        offsets.append((r["part"], before))
        before += r["n"]
    known = rows.sparkSession.createDataFrame(offsets, "part long, before long")
    placed = stored.withColumn("part", F.shiftright("id", PLACE_BITS)).join(F.broadcast(known), "part")
    return placed.select(*rows.columns, (F.col("before") + F.col("id").bitwiseAND((1 << PLACE_BITS) - 1)).alias(name))


def dealt(rows: DataFrame, shards: int, most: int | None = None, name: str = "ordinal") -> DataFrame:
    """numbered rows with shard, and started: whether a search over their shard that takes at most ``most`` of its
    rows, in order, comes to them."""
    turn = F.expr(f"{name} div {shards}")
    return rows.withColumn("shard", F.pmod(name, F.lit(shards)).cast("int")).withColumn("started", F.lit(True) if most is None else turn < most)


def receipts(rows: DataFrame, shards: int, failed: Column | None = None, name: str = "ordinal") -> DataFrame:
    """dealt rows -> (shard, units, started, first, last, status) of every shard, empty ones too: complete if
    all its units were started, bounded if not, and interrupted if one that was started failed."""
    broke = F.lit(False) if failed is None else F.coalesce(failed, F.lit(False))
    n = lambda test: F.count_if(test)
    found = rows.groupBy("shard").agg(F.count("*").alias("units"), n(F.col("started")).alias("started"), F.min(F.when(F.col("started"), F.col(name))).alias("first"), F.max(F.when(F.col("started"), F.col(name))).alias("last"), n(F.col("started") & broke).alias("broke"))
    known = rows.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    status = F.when(F.col("broke") > 0, "interrupted").when(F.col("started") < F.col("units"), "bounded").otherwise("complete")
    return known.join(found, "shard", "left").select("shard", zero("units"), zero("started"), "first", "last", status.alias("status"))


def gaps(rows: DataFrame, total: int, name: str = "ordinal") -> DataFrame:
    """(ordinal, times) where the union of shards hasn't an ordinal below total once, or has others."""
    seen = rows.groupBy(name).agg(F.count("*").alias("times"))
    every = rows.sparkSession.range(total).select(F.col("id").alias(name))
    return every.join(seen, name, "full_outer").select(name, F.coalesce("times", F.lit(0)).alias("times")).where(f"times <> 1 OR {name} >= {total} OR {name} < 0")
