"""A search per graph over its equitable partitions, in their order, that stops when it is decided.

The kernel makes partitions one by one, so a graph whose first partition extends costs one solved
problem however many partitions it has.  It gives a row for every partition it started; what those
rows claim is for the verifiers to judge.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .solve import BACKENDS, _pairs

Edge = tuple[int, int]
KIND = "graph_id long, n int, edges array<struct<u:int,v:int>>, d int, partition_index int, pair_edges array<struct<u:int,v:int>>, single_vertices array<int>, status string, assignment array<int>, nodes long, backtracks long"


def lazily(free: list[Edge], size: int) -> Iterator[list[Edge]]:
    """Matchings of ``size`` of the edges, by the order of their indices, made when they are asked for."""
    at: list[int] = []
    used = 0
    i = 0
    while True:
        if len(at) == size:
            yield [free[k] for k in at]
            i = len(free)
        while i < len(free) and (len(free) - i < size - len(at) or used >> free[i][0] & 1 or used >> free[i][1] & 1):
            i += 1
        if i < len(free):
            used |= 1 << free[i][0] | 1 << free[i][1]
            at.append(i)
            i += 1
            continue
        if not at:
            return
        i = at.pop()
        used &= ~(1 << free[i][0] | 1 << free[i][1])
        i += 1


def problem(n: int, edges: list[Edge], pairs: list[Edge], singles: list[int]) -> tuple[int, list[Edge], list[Edge]]:
    """(items, conflicts, fixed) of the partition's edge colouring: marked edges differ pairwise and
    have colours 0, 1, ... in order."""
    added = {*pairs, *((v, n) for v in singles)}
    lines = sorted([*edges, *added])
    at: list[list[int]] = [[] for _ in range(n + 1)]
    for i, (u, v) in enumerate(lines):
        at[u].append(i)
        at[v].append(i)
    marked = [i for i, e in enumerate(lines) if e in added]
    conflicts = {(a, b) for group in (*at, marked) for k, a in enumerate(group) for b in group[k + 1 :]}
    return len(lines), sorted(conflicts), [(i, c) for c, i in enumerate(marked)]


def searched(eligible: DataFrame, offset: int, backend: str, stop_at: str, max_partitions: int | None = None, max_nodes: int | None = None, max_seconds: float | None = None) -> DataFrame:
    """Rows of ``partitions.profile`` within the domain -> a row for each partition started.

    A graph's search ends behind the first partition with the status ``stop_at``.  A graph with more
    than max_partitions partitions has a last row of index -1 and status truncated, and one with
    none at all a row of index -1 and status empty.  Limits are those of one partition."""

    def of_graph(graph: int, n: int, edges: list[Edge], d: int, pairs: int) -> Iterator[tuple]:
        held = set(edges)
        free = [(u, v) for u in range(n) for v in range(u + 1, n) if (u, v) not in held]
        started = 0
        for chosen in lazily(free, pairs):
            if max_partitions is not None and started >= max_partitions:
                yield graph, n, edges, d, -1, [], [], "truncated", None, 0, 0
                return
            covered = {v for e in chosen for v in e}
            singles = [v for v in range(n) if v not in covered]
            items, conflicts, fixed = problem(n, edges, chosen, singles)
            status, found, nodes, backtracks = BACKENDS[backend](items, d + offset, conflicts, fixed, max_nodes, max_seconds)
            yield graph, n, edges, d, started, chosen, singles, status, found, nodes, backtracks
            started += 1
            if status == stop_at:
                return
        if not started:
            yield graph, n, edges, d, -1, [], [], "empty", None, 0, 0

    names = [x.split()[0] for x in KIND.replace("<u:int,v:int>", "").split(", ")]
    edge = pa.list_(pa.struct([("u", pa.int32()), ("v", pa.int32())]))
    kinds = [pa.int64(), pa.int32(), edge, pa.int32(), pa.int32(), edge, pa.list_(pa.int32()), pa.string(), pa.list_(pa.int32()), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = [[r[i] for r in rows] for i in range(len(names))]
            for i in (2, 5):
                columns[i] = [[{"u": u, "v": v} for u, v in x] for x in columns[i]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        rows: list[tuple] = []
        for b in batches:
            for graph, n, edges, d, pairs in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                for row in of_graph(graph, n, [(e["u"], e["v"]) for e in edges], d, pairs):
                    rows.append(row)
                    if len(rows) >= 1000:
                        yield out(rows)
                        rows = []
        yield out(rows)

    return eligible.select("graph_id", "n", "edges", F.col("d").cast("int"), F.col("pairs").cast("int")).mapInArrow(run, KIND)


def solved(partitions: DataFrame, wanted: list[tuple[str, int]], max_nodes: int | None = None, max_seconds: float | None = None) -> DataFrame:
    """Rows with n, edges, d, pair_edges, single_vertices -> a row for each of them and each check
    (backend, palette offset), with backend, palette_offset, color_count, status, assignment, nodes
    and backtracks.  A partition's problem is made once for all its checks."""
    names = [f.name for f in partitions.schema]
    added = [("backend", T.StringType()), ("palette_offset", T.IntegerType()), ("color_count", T.IntegerType()), ("status", T.StringType()), ("assignment", T.ArrayType(T.IntegerType())), ("nodes", T.LongType()), ("backtracks", T.LongType())]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.int64(), pa.int64()]
    schema = T.StructType([*partitions.schema.fields, *(T.StructField(n, k) for n, k in added)])
    at = {n: names.index(n) for n in ("n", "edges", "d", "pair_edges", "single_vertices")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            columns = [b.column(at["n"]).to_pylist(), _pairs(b.column(at["edges"])), b.column(at["d"]).to_pylist(), _pairs(b.column(at["pair_edges"])), b.column(at["single_vertices"]).to_pylist()]
            for n, edges, d, pairs, singles in zip(*columns, strict=True):
                items, conflicts, fixed = problem(n, edges, pairs, singles)
                for backend, offset in wanted:
                    rows.append((backend, offset, d + offset, *BACKENDS[backend](items, d + offset, conflicts, fixed, max_nodes, max_seconds)))
            again = pa.array([i for i in range(b.num_rows) for _ in wanted], pa.int32())
            yield pa.RecordBatch.from_arrays([*(c.take(again) for c in b.columns), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], [*names, *(n for n, _ in added)])

    return partitions.mapInArrow(run, schema)
