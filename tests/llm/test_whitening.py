"""Embedding whitening against exact integers and numpy."""

import math
from fractions import Fraction

import numpy as np
import pytest

from chromaspan.llm import queries as Q
from chromaspan.llm import whitening as W

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>"


def brute(rows):
    """({(vec_id, component): (n, deviation, whitened, explained)}, identity error) by integers and numpy."""
    x = [(i, [math.floor(256 * c) for c in e]) for i, e in rows if e is not None and all(c is not None and math.isfinite(c) for c in e)]
    fit = sorted({tuple(v) for _, v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    y = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(v, sums, strict=True)] for v in fit])
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1][:4], vectors[:, ::-1][:, :4]
    z = y @ vectors / np.sqrt(values)
    at = {v: k for k, v in enumerate(fit)}
    out = [(i, c + 1, n, sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)), z[at[tuple(v)], c], values[c] / np.trace(y.T @ y / n)) for i, v in x for c in range(len(values))]
    return out, np.abs(z.T @ z / n - np.eye(len(values))).max()


def compared(got, rows):
    want, error = brute(rows)
    assert error < 1e-9 and all(r.identity_error < 1e-9 for r in got)
    assert sorted((r.vec_id, r.component, r.n, r.deviation) for r in got) == sorted(w[:4] for w in want)
    signs = {}
    key = lambda r: (r[0], r[1], abs(r[4]))
    for r, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert abs(abs(r[4]) - abs(w[4])) < 1e-9 and abs(r[5] / w[5] - 1) < 1e-9
        if abs(w[4]) > 1e-6:
            assert signs.setdefault(r[1], r[4] * w[4] > 0) == (r[4] * w[4] > 0)


def test_whole_table(spark, duck):
    compared(Q.op11_embedding_whitening(spark, SF).collect(), duck.sql("SELECT vec_id, embedding FROM embeddings").fetchall())


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(40)]
    rows += [(3, rows[3][1]), (77, rows[4][1]), (90, None), (91, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (92, [float("nan")] * 6), (93, [float("inf")] * 6), (94, [1e300] * 6), (95, []), (96, [1.0])]
    got = W.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    compared(got, rows[:42])
    assert {r.n for r in got} == {40} and sum(r.vec_id == 3 for r in got) == 8
    named = spark.createDataFrame([(*r, 1, 2) for r in rows[:42]], SCHEMA + ", x int, n int")
    compared(W.whiten(named).collect(), rows[:42])
    none = W.whiten(spark.createDataFrame([(None, r[1]) for r in rows[:40]], SCHEMA)).collect()
    assert len(none) == 160 and {r.vec_id for r in none} == {None}


def test_large_entries(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=5) * scale).tolist()) for i, scale in enumerate([1e6, 1e7, 1e12, 1e13, 3e13] * 4)]
    got, (want, _) = W.whiten(spark.createDataFrame(rows, SCHEMA)).collect(), brute(rows)
    assert {(r.vec_id, r.deviation) for r in got} == {(w[0], w[3] if w[3] < 1 << 63 else None) for w in want}
    assert max(r.identity_error for r in got) < 1e-6


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [0.5, 2.0])], [(1, [0.5, 2.0]), (2, [0.5, 2.0])]])
def test_nothing_to_whiten(spark, rows):
    got = W.whiten(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.count() == 0


def test_less_rank(spark):
    rows = [(i, [float(i), 2.0 * i, 5.0, float(i * i)]) for i in range(9)]
    got = W.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted({r.component for r in got}) == [1, 2] and len(got) == 18
    assert abs(sum(r.explained for r in got if r.vec_id == 0) - 1) < 1e-9
