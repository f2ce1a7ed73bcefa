"""Counting inequalities over a grid, exact: the cap c is a fraction num / den."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRID = 12


def grid(spark: SparkSession, size: int = GRID, num: int = 6, den: int = 3) -> DataFrame:
    """(p, q, cap_num, cap_den) with p, q below size."""
    axis = lambda a, b: F.explode(F.sequence(F.lit(a), F.lit(b)))
    rows = spark.range(size).select(F.col("id").cast("int").alias("p"))
    return rows.select("p", axis(0, size - 1).alias("q")).select("p", "q", axis(1, num).alias("cap_num")).select("p", "q", "cap_num", axis(1, den).alias("cap_den"))


def _h():
    """max(q, p c), times the cap's denominator."""
    return F.greatest(F.col("q") * F.col("cap_den"), F.col("p") * F.col("cap_num"))


def draft_counterexamples(rows: DataFrame) -> DataFrame:
    """Rows where p + q < 3 h / (2 c) fails."""
    return rows.where(2 * F.col("cap_num") * (F.col("p") + F.col("q")) >= 3 * _h())


def corrected_closure(rows: DataFrame) -> DataFrame:
    """(cap_num, cap_den, cases, closed): how often p c + q < 2 h + 2."""
    holds = F.col("p") * F.col("cap_num") + F.col("q") * F.col("cap_den") < 2 * _h() + 2 * F.col("cap_den")
    return rows.groupBy("cap_num", "cap_den").agg(F.count("*").alias("cases"), F.count_if(holds).alias("closed"))
