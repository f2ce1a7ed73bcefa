"""What the jobs share: a small config file, a log, and a session for the command line."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

LOG = logging.getLogger("jobs")


def config_of(path: str | None, known: dict) -> dict:
    """The settings of a JSON file over those known; a name or a type that isn't known is an error."""
    given: dict = {}
    if path:
        with open(path, encoding="utf-8") as file:
            given = json.load(file)
    if odd := sorted(set(given) - set(known)):
        raise ValueError(f"unknown settings: {', '.join(odd)}")
    for name, value in given.items():
        if known[name] is not None and type(value) is not type(known[name]):
            raise ValueError(f"{name} must be of type {type(known[name]).__name__}")
    return known | given


def written(df: DataFrame, path: str, *by: str, **options: str) -> None:
    df.write.mode("overwrite").options(**options).partitionBy(*by).parquet(path)
    LOG.info("wrote %s by %s", path, ", ".join(by) or "nothing")


def read_back(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def begun(spark: SparkSession, path: str, schema: str, *by: str) -> None:
    """Leaves a table without rows where there is none yet, and one that is there as it is."""
    spark.createDataFrame([], schema).write.mode("append").partitionBy(*by).parquet(path)


def command(name: str, known: dict, run: Callable[..., None], *paths: str, arguments: list[str] | None = None) -> None:
    """Reads the command line, makes the session, runs and ends it."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=run.__doc__)
    for path in paths:
        parser.add_argument(f"--{path}", required=True, metavar="PATH")
    parser.add_argument("--config", metavar="PATH", help="a JSON file of settings")
    given = vars(parser.parse_args(arguments))
    settings = config_of(given.pop("config"), known)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(f"jobs.{name}").getOrCreate()
    try:
        run(spark, **given, settings=settings)
    finally:
        spark.stop()
