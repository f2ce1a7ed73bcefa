"""Media columns: lossless PNG in binary columns, read back and hashed by low cosine frequencies.

The writer stores grey 8-bit samples in rows of 64, filters each row by the least sum of absolute
differences (none, sub, up), and frames zlib data in checksummed chunks.  The reader tests every
chunk's checksum, inflates, and undoes all five filters in numpy.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import parts, small_batches, text_or_empty

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"


class PngError(ValueError):
    pass


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def write_png(pixels: np.ndarray, level: int = 1, part: int = 1 << 20) -> bytes:
    """pixels: rows x width of uint8.  The zlib stream is cut into IDAT chunks of ``part`` bytes."""
    rows, width = pixels.shape
    sub = pixels.copy()
    sub[:, 1:] -= pixels[:, :-1]
    up = pixels.copy()
    up[1:] -= pixels[:-1]
    kinds = np.stack([pixels, sub, up])
    cost = np.minimum(kinds, -kinds).sum(axis=2, dtype=np.int64)
    best = cost.argmin(axis=0)
    lines = np.empty((rows, width + 1), np.uint8)
    lines[:, 0] = best
    lines[:, 1:] = kinds[best, np.arange(rows)]
    data = zlib.compress(lines.tobytes(), level)
    head = struct.pack(">IIBBBBB", width, rows, 8, 0, 0, 0, 0)
    body = b"".join(_chunk(b"IDAT", data[i : i + part]) for i in range(0, len(data), part))
    return SIGNATURE + _chunk(b"IHDR", head) + body + _chunk(b"IEND", b"")


def unfilter(lines: np.ndarray) -> np.ndarray:
    """lines: rows x (1 + width), a filter type and filtered samples -> rows x width samples."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise PngError("unknown filter type")
    sub = kinds == 1
    out[sub] = np.cumsum(out[sub], axis=1, dtype=np.uint8)
    bounds = np.flatnonzero(np.r_[True, kinds[1:] != kinds[:-1], True])
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if kinds[a] == 2:  # a run of ups adds onto the row above it
            if a:
                out[a] += out[a - 1]
            out[a:b] = np.cumsum(out[a:b], axis=0, dtype=np.uint8)
        elif kinds[a] > 2:
            above = out[a - 1] if a else np.zeros(out.shape[1], np.uint8)
            out[a:b] = _by_diagonals(out[a:b], above, _average if kinds[a] == 3 else _paeth)
    return out


def _average(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    return (left + up) // 2


def _paeth(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Whichever of the three is nearest to left + up - corner, the first of equals."""
    p = left + up - corner
    away = np.abs(np.stack([p - left, p - up, p - corner]))
    return np.choose(away.argmin(axis=0), [left, up, corner])


def _by_diagonals(lines: np.ndarray, above: np.ndarray, guess) -> np.ndarray:
    """A run of rows whose samples depend on their left, upper and corner neighbours: the samples of
    a diagonal depend on those of the two before it only, so a diagonal is undone at once."""
    rows, width = lines.shape
    out = np.zeros((rows + 1, width + 1), np.int16)
    out[0, 1:] = above
    for d in range(rows + width - 1):
        r = np.arange(max(0, d - width + 1), min(rows, d + 1))
        c = d - r
        out[r + 1, c + 1] = (lines[r, c] + guess(out[r + 1, c], out[r, c + 1], out[r, c])) & 255
    return out[1:, 1:].astype(np.uint8)


def read_png(stored: bytes) -> np.ndarray:
    """rows x width of uint8; raises PngError on a bad signature, checksum, order or length."""
    if stored[:8] != SIGNATURE:
        raise PngError("signature")
    at, shape, parts, ended = 8, None, [], False
    while at < len(stored) and not ended:
        if at + 12 > len(stored):
            raise PngError("truncated chunk")
        (n,), kind = struct.unpack(">I", stored[at : at + 4]), stored[at + 4 : at + 8]
        data, check = stored[at + 8 : at + 8 + n], stored[at + 8 + n : at + 12 + n]
        if len(check) < 4 or zlib.crc32(kind + data) != struct.unpack(">I", check)[0]:
            raise PngError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            width, rows, *rest = struct.unpack(">IIBBBBB", data)
            if rest != [8, 0, 0, 0, 0]:
                raise PngError("only grey 8-bit samples without interlacing are read")
            shape = rows, width
        elif kind == b"IDAT":
            parts.append(data)
        ended = kind == b"IEND"
        at += 12 + n
    if shape is None or not ended:
        raise PngError("missing chunk")
    flat = zlib.decompress(b"".join(parts))
    if len(flat) != shape[0] * (shape[1] + 1):
        raise PngError("length of samples")
    return unfilter(np.frombuffer(flat, np.uint8).reshape(shape[0], shape[1] + 1))


def _cosines(n: int, keep: int) -> np.ndarray:
    k, x = np.arange(keep)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * n))


_LOW = _cosines(32, 8)


def low_hash(pixels: np.ndarray) -> bytes:
    """8 bytes: the 64 lowest frequencies of the image averaged to 32 x 32, above their median.

    The averages are exact over fractional rows, so any height will do."""

    def means(rows: np.ndarray) -> np.ndarray:
        total = np.concatenate([np.zeros((1, rows.shape[1])), np.cumsum(rows, axis=0, dtype=np.float64)])
        at = np.arange(33) * (len(rows) / 32)
        low = np.minimum(at.astype(int), len(rows) - 1)
        upto = total[low] + (at - low)[:, None] * rows[low]
        return np.diff(upto, axis=0) / (len(rows) / 32)

    small = means(means(pixels).T).T
    low = np.round(_LOW @ small @ _LOW.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def payload_of(text: bytes) -> bytes:
    """The text and zero bytes up to a positive multiple of WIDTH."""
    return text + bytes(-len(text) % WIDTH if text else WIDTH)


def media_columns(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media, payload_bytes, payload_sha256, tail_crc32, feature) for every row.

    media is the stored PNG; all figures behind it come from samples read back from it.  A null
    text counts as empty.  Repeated rows and rows without doc_id are stored like others.  An empty
    table gives an empty result; other columns are ignored.
    """
    small_batches(docs.sparkSession, 200)
    names = ["doc_id", "n_bytes", "media", "payload_bytes", "payload_sha256", "tail_crc32", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column(1).cast(pa.binary()).to_pylist():
                stored = write_png(np.frombuffer(payload_of(text), np.uint8).reshape(-1, WIDTH))
                pixels = read_png(stored)
                back = pixels.tobytes()
                rows.append((len(text), stored, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), low_hash(pixels).hex()))
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names)

    kind = "doc_id long, n_bytes long, media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"
    return parts(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text")).mapInArrow(run, kind)
