"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014).

Every round is two aggregations and two equality joins over the link table.  Links stay in
DataFrames; the driver sees a row count and one checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, drop


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame) -> DataFrame:
    """links(a long, b long) -> (node, root): root is the smallest node reachable.

    Nodes without a link are absent; loops, repeats and rows with a null end are ignored.
    """
    ends = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = cut(ends.distinct(), "links")
    mark = _mark(now)
    while mark[0]:
        # A round never has more links than the one before.
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cut(large, "links", mark[0])
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        then = cut(small.where("a <> b").distinct(), "links", mark[0])
        drop(now)
        drop(large)
        before, now, mark = mark, then, _mark(then)
        if mark == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
