"""The kernel operator: a colouring problem per row, solved in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .solvers import fixed_order, saturation

#: The names of the two kernels.
BACKENDS = {"dsatur-iterative-v1": saturation.search, "static-order-iterative-v1": fixed_order.search}
RESULT = [("status", T.StringType()), ("assignment", T.ArrayType(T.IntegerType())), ("nodes", T.LongType()), ("backtracks", T.LongType())]


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt over four tasks a core, before problems are built from them: rows are small but
    each is much work, and the optimizer would gather them in a few tasks by their bytes."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *keys)


def _pairs(column: pa.ListArray) -> Iterator[list[tuple[int, int]]]:
    """Lists of two-field structs as lists of tuples; a null is an empty list."""
    flat = column.flatten()
    both = list(zip(*(flat.field(k).to_pylist() for k in range(2)), strict=True))
    end = 0
    for n in pc.fill_null(pc.list_value_length(column), 0).to_pylist():
        yield both[end : end + n]
        end += n


def solve(problems: DataFrame, backend: str | None = None, max_nodes: int | None = None, max_seconds: float | None = None) -> DataFrame:
    """problems(..., items int, colours int, conflicts array<struct<i,j>>, fixed array<struct<item,color>>)
    -> its other columns and (status, assignment, nodes, backtracks).

    ``backend`` names the kernel for all rows; without it a column of that name does.  A row is a
    whole problem, so rows spread over as many tasks as their input has.
    """
    keep = [f for f in problems.schema if f.name not in ("conflicts", "fixed", "items", "colours")]
    schema = T.StructType(list(keep))
    for name, kind in RESULT:
        schema = schema.add(name, kind)
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = {f: i for i, f in enumerate(b.schema.names)}
            out = []
            kinds = b.column(at["backend"]).to_pylist() if backend is None else [backend] * b.num_rows
            for kind, items, colours, pairs, fixed in zip(kinds, b.column(at["items"]).to_pylist(), b.column(at["colours"]).to_pylist(), _pairs(b.column(at["conflicts"])), _pairs(b.column(at["fixed"])), strict=True):
                out.append(BACKENDS[kind](items, colours, pairs, fixed, max_nodes, max_seconds))
            kind = [pa.string(), pa.list_(pa.int32()), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([*(b.column(at[c]) for c in names), *(pa.array([r[i] for r in out], k) for i, k in enumerate(kind))], [*names, *(n for n, _ in RESULT)])

    return problems.mapInArrow(run, schema)
