"""Shared-folder tables: how the operators of this folder cut lineage.

A cut is a Parquet table under ``spark.checkpoint.dir``.  Losing an executor then costs only the
tasks that ran there, and nothing is kept in executors' own folders.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see; only a local session may lack the setting."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        path = spark._jvm.org.apache.hadoop.fs.Path(found)
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        full = path.makeQualified(store.getUri(), store.getWorkingDirectory()).toString()
        return "file://" + full[5:] if full.startswith("file:/") and not full.startswith("file://") else full
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="chromaspan-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: A table with a known bound on its rows is written in one file for so many, and FEW at least.
ROWS, FEW = 1 << 14, 4


def cut(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Writes df to the shared folder and returns the table that was written.

    rows: a bound on df's rows.  A small table then isn't scattered over as many files as there are
    shuffle partitions; a large one has as many tasks as before."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    if rows is not None:
        df = df.coalesce(max(FEW, -(-rows // ROWS)))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes the files of a cut that no later plan reads."""
    spark = df.sparkSession
    for top in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(top)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Bounds an Arrow batch of whole texts by rows; never raises a smaller bound."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, rows)


#: Where a worker process keeps what its later tasks may use again.
KEPT = "chromaspan_kept"


def give_back(kept: bool = True) -> None:
    """In a worker process: frees memory that it holds for no task, and with ``kept`` also what it
    keeps for tasks of another operator.  Workers serve many tasks, one after another."""
    import ctypes
    import gc
    import sys

    import pyarrow as pa

    if kept and sys.modules.pop(KEPT, None) is not None:
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not with this C library
        pass


def text_or_empty(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def positional(docs: DataFrame) -> DataFrame:
    """docs with its columns called c0, c1, ...: no name of a caller's can clash with an operator's
    own, whatever its case, dots or quotes.  ``toDF(*docs.columns)`` gives them back."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def place(docs: DataFrame, name: str) -> str:
    """The name in ``positional(docs)`` of the column called name: exactly so, or but for case."""
    for found in (docs.columns, [c.lower() for c in docs.columns]):
        if name in found:
            return f"c{found.index(name)}"
    raise ValueError(f"no column {name}")


def parts(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns of docs and no others."""
    return positional(docs).select(*[F.col(place(docs, n)).alias(n) for n in names])


def sized(df: DataFrame, rows: int) -> DataFrame:
    """df, a cut table, with the hint to send it to all tasks if it has at most ``rows`` rows and to
    sort otherwise."""
    return F.broadcast(df) if df.count() <= rows else df.hint("merge")
