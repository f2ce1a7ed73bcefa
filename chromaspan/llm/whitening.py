"""Embedding whitening: principal components of integer vectors, scaled to unit variance.

Vectors become whole numbers of 1/256.  The fit list holds each distinct one once.  Its sums are exact,
so its rows are centred exactly before anything is multiplied; MLlib's RowMatrix adds up their Gramian,
numpy solves the small symmetric problem on the driver, and the few numbers of the solution are
broadcast to the tasks that whiten all rows.

Only numbers of the vectors' dimension reach the driver: one row of sums for each dimension, and
one square matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, parts, small_batches

#: A vector's entry is a whole number of 1 / SCALE.
SCALE = 256
COMPONENTS = 4
#: Eigenvalues of at most this share of the largest are zero but for rounding.
NONE = 1e-12
#: Half of a long's bits: sums of halves can't overflow below 2^31 rows a partial sum and 2^31 of those.
HALF = 32
LONG = 1 << 63


@dataclass
class Fit:
    """The fit list's size, its sums, and components by falling eigenvalue."""

    n: int
    sums: list[int]
    most: int
    vectors: np.ndarray
    values: np.ndarray
    trace: float


def whole(vectors: DataFrame) -> DataFrame:
    """vectors(vec_id, embedding, ...) -> (vec_id long, x array<long>) of those without null or
    non-finite entries; a vector with an entry that no long holds is none either."""
    c = F.col("c")
    rows = parts(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("c"))
    good = F.forall(c, lambda v: F.coalesce(F.abs(v) < float(LONG // SCALE), F.lit(False)))
    return rows.where(c.isNotNull() & good).select("vec_id", F.transform(c, lambda v: F.floor(v * SCALE)).alias("x"))


def _sums(fit: DataFrame, d: int) -> tuple[int, list[int], int]:
    """(rows, sums by dimension, largest absolute entry) of fit(x), exactly; d rows reach the driver."""
    rows = fit.select(F.posexplode("x").alias("i", "v"))
    halves = [F.sum(F.shiftright("v", HALF)).alias("high"), F.sum(F.col("v").bitwiseAND((1 << HALF) - 1)).alias("low")]
    found = rows.groupBy("i").agg(F.count("*").alias("n"), *halves, F.max("v").alias("most"), F.min("v").alias("least")).orderBy("i").collect()
    return found[0]["n"], [(r["high"] << HALF) + r["low"] for r in found], max(max(r["most"], -r["least"]) for r in found)


def gramian(fit: DataFrame, n: int, sums: list[int], most: int) -> np.ndarray:
    """The sum of y y' over fit(x), y = (n x - sums) / n."""
    kind = "long" if 2 * n * most < LONG else "decimal(38,0)"
    shift = F.array(*[F.lit(s).cast(kind) for s in sums])
    y = F.zip_with("x", shift, lambda v, s: (v.cast(kind) * F.lit(n).cast(kind) - s).cast("double") / F.lit(float(n)))
    rows = MLUtils.convertVectorColumnsFromML(fit.select(array_to_vector(y).alias("y")), "y")
    return RowMatrix(rows).computeGramianMatrix().toArray()


def fitted(fit: DataFrame, d: int, components: int = COMPONENTS) -> Fit:
    """Components of fit(x), distinct vectors of d entries; fewer where the covariance has less rank."""
    n, sums, most = _sums(fit, d)
    covariance = gramian(fit, n, sums, most) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    kept = values > NONE * max(values[0], 0.0)
    values, vectors = values[kept], vectors[:, kept]
    # Of the two signs, the one with which the largest entry is above zero.
    heads = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.sign(vectors[heads, np.arange(len(values))])
    return Fit(n, sums, most, vectors, values, float(np.trace(covariance)))


def _centred(x: np.ndarray, fit: Fit) -> tuple[np.ndarray, list[int | None]]:
    """((n x - sums) / n, the sum of (n x - sums)^2 or None where no long holds it) by row of x."""
    small = 2 * fit.n * fit.most < LONG
    y = (x * fit.n - np.array(fit.sums) if small else x.astype(object) * fit.n - np.array(fit.sums, object)).astype(float) / fit.n
    # n^2 (x.x) - 2 n (x.sums) + sums.sums, with products of longs while those can't overflow.
    largest = max(map(abs, fit.sums))
    x = x if x.shape[1] * max(fit.most, largest) * fit.most < LONG else x.astype(object)
    of_sums = np.array(fit.sums, x.dtype)
    square, mixed, rest = (x * x).sum(axis=1).tolist(), (x * of_sums).sum(axis=1).tolist(), sum(s * s for s in fit.sums)
    found = [fit.n * fit.n * a - 2 * fit.n * b + rest for a, b in zip(square, mixed, strict=True)]
    return y, [v if v < LONG else None for v in found]


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row for each vector of
    vectors(vec_id, embedding, ...) and component.

    A vector that is null, or that holds a null, non-finite or too large entry, gives no rows.  The
    vectors' dimension is the one most distinct vectors have, the larger in a tie; vectors of another one
    give no rows.  Components that have no variance can't be whitened and are left out, so there are
    fewer than ``components`` where the covariance's rank is less, and no rows where all vectors are
    equal.  Repeated rows, and rows without vec_id, give their rows like others.  deviation is null where
    it's beyond a long.  An empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    small_batches(spark, 10_000)
    rows = whole(vectors)
    fit = cut(rows.select("x").distinct(), "fit")
    usual = fit.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    none = spark.createDataFrame([], schema)
    if usual is None or usual["d"] == 0:
        return none
    fit, rows = (t.where(F.size("x") == usual["d"]) for t in (fit, rows))
    found = fitted(fit, usual["d"], components)
    k = len(found.values)
    if not k:
        return none
    sent = spark.sparkContext.broadcast((found, found.vectors / np.sqrt(found.values)))

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fit, matrix = sent.value
        for frame in frames:
            if len(frame):
                z = _centred(np.stack(frame["x"].to_numpy()), fit)[0] @ matrix
                yield pd.DataFrame({f"w{j}": z[:, j] for j in range(z.shape[1])})

    own = fit.mapInPandas(project, ", ".join(f"w{j} double" for j in range(k)))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    covariance = own.agg(*[F.covar_pop(f"w{i}", f"w{j}") for i, j in pairs]).first()
    error = max(abs(v - (i == j)) for v, (i, j) in zip(covariance, pairs, strict=True))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fit, matrix = sent.value
        share = fit.values / fit.trace
        for frame in frames:
            if len(frame):
                y, deviation = _centred(np.stack(frame["x"].to_numpy()), fit)
                m = len(frame)
                yield pd.DataFrame({
                    "vec_id": frame["vec_id"].astype("Int64").repeat(k).array, "component": np.tile(np.arange(1, k + 1, dtype=np.int32), m), "n": fit.n,
                    "deviation": pd.array(deviation, "Int64").repeat(k), "whitened": (y @ matrix).ravel(), "explained": np.tile(share, m), "identity_error": error,
                })

    return rows.mapInPandas(run, schema)
