"""Quality classifier: naive Bayes support vectors.

Features are indicators of byte n-grams and of n-grams of word repeats (whether a word equals the
one before it), with bands of their share.  They are scaled by the logarithm of the ratio of their
class frequencies (Wang and Manning, 2012); a linear hinge-loss model is fitted to them by dual
coordinate descent (Hsieh et al., 2008), and a logistic curve turns its margins into scores.  The
model is fitted on a bounded sample of labelled rows and scores every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .shared import give_back, parts, place, positional, small_batches, text_or_empty

#: Labelled rows that the fit reads at most, the first in the order of a hash of doc_id.
SAMPLE = 6000
BITS = 18
ORDER = 3
THRESHOLD = 0.7


#: Feature numbers: hashed byte n-grams, then four-grams of repeats, then bands of repeats.
SIZE = (1 << BITS) + 16 + 6
_BANDS = np.array([0.0, 0.02, 0.1, 0.3, 0.6])


def repeats(raw: bytes) -> np.ndarray:
    """Indicators of how words repeat the word before them; none below two words."""
    words = raw.split()
    if len(words) < 2:
        return np.empty(0, np.int64)
    same = np.fromiter(map(bytes.__eq__, words, words[1:]), bool, len(words) - 1).astype(np.int64)
    band = int(np.searchsorted(_BANDS, same.mean()))
    four = same[:-3] * 8 + same[1:-2] * 4 + same[2:-1] * 2 + same[3:] if len(same) > 3 else np.empty(0, np.int64)
    seen = np.zeros(16, bool)
    seen[four] = True
    return np.r_[np.flatnonzero(seen), 16 + band] + (1 << BITS)


def grams(raw: bytes, bits: int = BITS, order: int = ORDER) -> np.ndarray:
    """Sorted distinct features of a text; byte n-grams are hashed to ``bits`` bits."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(b) < order:
        b = np.r_[b, np.zeros(order - len(b), np.uint32)] if len(b) else b
    if not len(b):
        return np.empty(0, np.int64)
    code = b[: len(b) - order + 1].copy()
    for i in range(1, order):
        code = code << np.uint32(8) | b[i : len(b) - order + 1 + i]
    seen = np.zeros(1 << bits, bool)
    seen[(code * np.uint32(2654435761)) >> np.uint32(32 - bits)] = True
    return np.r_[np.flatnonzero(seen), repeats(raw)]


def packed(feats: np.ndarray) -> bytes:
    """Features of a row in at most 33 kB: their numbers, or a bit for each that there is."""
    if 4 * len(feats) < SIZE // 8:
        return b"n" + feats.astype("<i4").tobytes()
    bits = np.zeros(SIZE, bool)
    bits[feats] = True
    return b"b" + np.packbits(bits).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    if raw[:1] == b"b":
        return np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8, offset=1), count=SIZE))
    return np.frombuffer(raw, "<i4", offset=1).astype(np.int64)


class Rows:
    """Features of many rows, kept packed: a row is unpacked when it is asked for."""

    def __init__(self, raw: list[bytes]) -> None:
        self.raw = raw

    def __len__(self) -> int:
        return len(self.raw)

    def __getitem__(self, i: int) -> np.ndarray:
        if i >= len(self.raw):
            raise IndexError(i)
        return unpacked(self.raw[i])


class _Chosen:
    """Some of the rows, as they are or scaled by the ratios of their features."""

    def __init__(self, rows, index: list[int], ratio: np.ndarray | None = None) -> None:
        self.rows, self.index, self.ratio = rows, index, ratio

    def __len__(self) -> int:
        return len(self.index)

    def __getitem__(self, i: int) -> np.ndarray:
        if i >= len(self.index):
            raise IndexError(i)
        x = self.rows[self.index[i]]
        return x if self.ratio is None else self.ratio[x] / max(1.0, len(x) ** 0.5)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def score(self, feats: np.ndarray) -> float:
        margin = float(self.weights[feats].sum()) / max(1.0, len(feats) ** 0.5) + self.bias
        return 1.0 / (1.0 + float(np.exp(np.clip(-(self.slope * margin + self.offset), -40, 40))))


def _descend(rows: Sequence[np.ndarray], scale: Sequence[np.ndarray], y: np.ndarray, size: int, c: float, rounds: int, seed: int) -> tuple[np.ndarray, float]:
    """L1-loss support vectors: minimises |w|^2 / 2 + c * sum of hinge losses over the dual."""
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(rows))
    square = np.array([float(v @ v) + 1.0 for v in scale])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(rows)):
            x, v = rows[i], scale[i]
            g = y[i] * (float(w[x] @ v) + bias) - 1.0
            new = min(max(alpha[i] - g / square[i], 0.0), c)
            d = new - alpha[i]
            if d:
                w[x] += d * y[i] * v
                bias += d * y[i]
                alpha[i] = new
                most = max(most, abs(d))
        if most < 1e-3 * c:
            break
    return w, bias


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's curve with his smoothed targets, by Newton's method."""
    up, down = float((y > 0).sum()), float((y < 0).sum())
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.c_[margin, np.ones_like(margin)]
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), x.T @ (t - p))
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def fit(rows: Sequence[np.ndarray], labels: list[int], size: int = SIZE, c: float = 1.0, rounds: int = 30, seed: int = 5) -> Model:
    """rows: features of each text.  A fifth of the rows sets the curve and isn't used before.
    With one class only, or no rows, the score is the smoothed share of class 1."""
    y = np.where(np.array(labels, int) == 1, 1.0, -1.0)
    if len({*labels}) < 2:
        share = (float((y > 0).sum()) + 1) / (len(y) + 2)
        return Model(np.zeros(size, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    own = np.arange(len(y)) % 5 != 0
    if len({*y[own]}) < 2 or len({*y[~own]}) < 2:
        own = np.ones(len(y), bool)
    up, down = np.ones(size), np.ones(size)
    for x, k in zip(rows, y * own, strict=True):
        if k:
            (up if k > 0 else down)[x] += 1
    ratio = np.log(up / up.sum()) - np.log(down / down.sum())
    shape = np.flatnonzero(own).tolist()
    w, bias = _descend(_Chosen(rows, shape), _Chosen(rows, shape, ratio), y[own], size, c, rounds, seed)
    weights = (w * ratio).astype(np.float32)
    held = [i for i, k in enumerate(own) if not k] or list(range(len(y)))
    held_rows = _Chosen(rows, held)
    margin = np.array([float(weights[x].sum()) / max(1.0, len(x) ** 0.5) + bias for x in held_rows])
    return Model(weights, bias, *_logistic(margin, y[held]))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on rows of labels(doc_id, quality) that aren't held out.  Null labels and labels of
    missing documents are skipped; of repeated rows each counts, up to ``sample`` in all.  The driver
    gets at most 33 kB for each of them, 200 MB in all."""
    small_batches(docs.sparkSession)
    docs, labels = parts(docs, "doc_id", "text"), parts(labels, "doc_id", "quality")
    doc = F.col("doc_id").cast("long")
    named = labels.where(doc.isNotNull() & F.col("quality").isin(0, 1) & ~held_out(doc)).select(doc.alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    first = named.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)  # at most ``sample`` rows of two numbers
    rows = docs.select(doc.alias("doc_id"), text_or_empty("text").alias("text")).join(F.broadcast(first), "doc_id").select("doc_id", "quality", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for b in batches:
            found = [packed(grams(t or b"")) for t in b.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.binary())], ["doc_id", "quality", "x"])

    got = rows.mapInArrow(run, "doc_id long, quality int, x binary").orderBy("doc_id", "quality", F.xxhash64("x")).limit(sample).collect()
    return fit(Rows([bytes(r["x"]) for r in got]), [r["quality"] for r in got])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs' columns and ``score``, last, for every row; a null text counts as empty.  Nothing but
    the text is an input.  A column of docs named score is replaced."""
    kept = [i for i, c in enumerate(docs.columns) if c.lower() != "score"]
    return _scored(docs, model).select(*[f"c{i}" for i in kept], "score").toDF(*[docs.columns[i] for i in kept], "score")


def _scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs under positional names, and score."""
    small_batches(docs.sparkSession)
    rows = positional(docs)
    names, at = rows.columns, rows.columns.index(place(docs, "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for b in batches:
            found = [model.score(grams(t or b"")) for t in b.column(at).cast(pa.string()).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.float64())], [*names, "score"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("score", DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row.  Repeated rows each keep a row; a row
    without doc_id is never held out; an empty table gives an empty result."""
    docs = parts(docs, "doc_id", "text")
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs, labels, sample))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least ``threshold``, with all columns as they are."""
    return _scored(docs, train(docs, labels, sample)).where(F.col("score") >= threshold).drop("score").toDF(*docs.columns)
