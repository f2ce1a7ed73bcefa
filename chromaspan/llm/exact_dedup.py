"""Exact deduplication through an extendible-hash index kept on shared files.

* Entries: 64-bit text hash, byte length and SHA-256 of every row, and the count of rows by hash,
  written to the shared folder.
* Directory: counts of distinct hashes by prefix grow a directory; an overfull bucket splits and,
  when its depth is the directory's, the directory doubles.  It is stored as a table beside the
  index and sent to the tasks.  The prefix deepens with the number of owners.
* Owners: every bucket belongs to one task, which owns a range of buckets.  Each map task first
  chains equal texts in a table of bounded bytes.  The owner reads its key range in order, chains
  texts whose hashes collide, compares their bytes and writes one index row for each distinct text.
* Hot texts: a hash with more than 1/65,536 of all rows is hot, so there are under 65,536 of them.
  The chains of hot texts are merged by (hash, salt) before they reach their owner, and rows of hot
  texts find their class in a table that is sent to all tasks.
* Lookup: every row finds its bucket in the directory and its class there, by hash and digest.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, drop, parts, small_batches, text_or_empty

SEED = 42
PREFIX = 16
#: Bytes of distinct texts that a map task holds at most.
ROOM = 32 << 20
#: Bytes of distinct texts for each owner; more owners than DEEPEST bits tell apart aren't made.
SHARE = 256 << 20
DEEPEST = 20


class Directory:
    """Slots of the top ``depth`` hash bits; slot -> bucket, bucket -> (local depth, keys)."""

    def __init__(self, counts: dict[int, int], capacity: int, bits: int = PREFIX) -> None:
        """counts: distinct keys by their top ``bits`` bits.  A bucket of one prefix isn't split:
        owners stream their keys, so an overfull bucket costs time only."""
        self.depth, self.slots, self.local = 0, [0], [0]
        fine = np.zeros((1 << bits) + 1, np.int64)
        for prefix, n in counts.items():
            fine[prefix + 1] = n
        below = np.cumsum(fine)
        start = [0]

        def held(b: int) -> int:
            width = 1 << (bits - self.local[b])
            return int(below[start[b] + width] - below[start[b]])

        waiting = [0]
        while waiting:
            b = waiting.pop()
            if held(b) <= capacity or self.local[b] == bits:
                continue
            if self.local[b] == self.depth:
                self.slots = [s for s in self.slots for _ in (0, 1)]
                self.depth += 1
            self.local[b] += 1
            new = len(self.local)
            self.local.append(self.local[b])
            start.append(start[b] + (1 << (bits - self.local[b])))
            first, n = start[new] >> (bits - self.depth), 1 << (self.depth - self.local[b])
            self.slots[first : first + n] = [new] * n
            waiting += [b, new]
        order = sorted(range(len(start)), key=start.__getitem__)
        rank = {b: i for i, b in enumerate(order)}
        #: Buckets in the order of their key ranges.
        self.slots = [rank[s] for s in self.slots]
        self.sizes = [held(b) for b in order]
        self.local = [self.local[b] for b in order]

    def owners(self, n: int) -> list[int]:
        """The owner of each bucket: ranges of about equal keys."""
        total, middle = max(1, sum(self.sizes)), np.cumsum(self.sizes) - np.array(self.sizes) / 2
        return np.clip(middle * n // total, 0, n - 1).astype(int).tolist()

    def to_json(self) -> str:
        return json.dumps({"depth": self.depth, "slots": self.slots, "local": self.local, "sizes": self.sizes})

    def store(self, spark: SparkSession, owners: int) -> DataFrame:
        """(slot, bucket, owner), written to the shared folder: at most 1 << DEEPEST rows."""
        of = np.array(self.owners(owners), np.int32)
        slots = np.array(self.slots, np.int32)
        table = pa.table({"slot": np.arange(len(slots), dtype=np.int64), "bucket": slots, "owner": of[slots]})
        return cut(spark.createDataFrame(table), "directory", len(slots))

    def slot(self, h: str):
        """Column: the slot of a signed 64-bit hash."""
        return F.shiftrightunsigned(h, 64 - self.depth) if self.depth else F.lit(0).cast("long")


def entries(docs: DataFrame) -> DataFrame:
    """(doc_id, h, n_bytes, text_sha256) for every row."""
    text = text_or_empty("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("text_sha256"))


def _later(a: int | None, b: int | None) -> int | None:
    return b if a is None or b is not None and b > a else a


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array(np.array([r[0] for r in rows], np.uint64).view(np.int64)), pa.array([r[1] for r in rows], pa.binary()),
        pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64()),
    ], ["h", "text", "keep_id", "n"])


def _in_batches(rows: Iterator[tuple], limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """(h, text, keep_id, n) in batches of about ``limit`` bytes."""
    out, size = [], 0
    for r in rows:
        out.append(r)
        size += len(r[1])
        if size >= limit:
            yield _batch(out)
            out, size = [], 0
    if out:
        yield _batch(out)


def _chain(batches: Iterator[pa.RecordBatch], room: int = ROOM) -> Iterator[pa.RecordBatch]:
    """Map side: (h, text, keep_id, n), a row for each distinct text of a task.  A full table gives
    up the texts seen once, and all of them if the others fill over half of it."""
    table: dict[bytes, list] = {}
    held = 0

    def leave(single: bool) -> Iterator[tuple]:
        for text, (keep, n) in table.items():
            if n == 1 or not single:
                yield xxhash.xxh64_intdigest(text, SEED), text, keep, n

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            link = table.get(text)
            if link is not None:
                link[0], link[1] = _later(link[0], doc), link[1] + 1
                continue
            table[text] = [doc, 1]
            held += len(text) + 200
            if held > room:
                yield from _in_batches(leave(True))
                table = {t: link for t, link in table.items() if link[1] > 1}
                held = sum(len(t) + 200 for t in table)
                if held > room // 2:
                    yield from _in_batches(leave(False))
                    table, held = {}, 0
    yield from _in_batches(leave(False))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows (bucket, h, text, keep_id, n) in order of (bucket, h) -> (bucket, h, chain), where a chain
    has a link [text, keep_id, n] for each distinct text, compared by its bytes."""
    key, chain = None, []
    for batch in batches:
        for b, h, text, keep, n in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if (b, h) != key:
                if key is not None:
                    yield *key, chain
                key, chain = (b, h), []
            for link in chain:
                if link[0] == text:
                    link[1], link[2] = _later(link[1], keep), link[2] + n
                    break
            else:
                chain.append([text, keep, n])
    if key is not None:
        yield *key, chain


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (salt, h) -> (h, text, keep_id, n), one row for each distinct text of a salt."""
    yield from _in_batches((h & (1 << 64) - 1, *link) for _, h, chain in _runs(batches) for link in chain)


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Owner side, rows in order of (bucket, h): one row for each distinct text."""
    names = ["bucket", "h", "chain", "n_bytes", "text_sha256", "keep_id", "group_size"]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    found: list[tuple] = []
    for bucket, h, chain in _runs(batches):
        found += [(bucket, h, i, len(text), hashlib.sha256(text).hexdigest(), keep, n) for i, (text, keep, n) in enumerate(chain)]
        if len(found) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], names)
            found = []
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], names)


def build_index(docs: DataFrame, listed: DataFrame, capacity: int | None = None, hot: int | None = None, room: int = ROOM) -> tuple[DataFrame, DataFrame, Directory, DataFrame]:
    """The index table (bucket, h, chain, n_bytes, text_sha256, keep_id, group_size), the hot hashes,
    the directory and its stored table.  docs(doc_id, text), listed: its ``entries``.

    capacity: keys of a bucket; by default such that each owner has some eight buckets.  hot: rows
    above which a hash is hot; by default 64 and 1/65,536 of all rows."""
    spark = docs.sparkSession
    small_batches(spark)
    keys = cut(listed.groupBy("h").agg(F.count("*").alias("n"), F.max("n_bytes").alias("b")), "keys", listed.count())
    distinct, rows, size = keys.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    owners = min(1 << (DEEPEST - 4), max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // SHARE + 1))
    capacity = capacity or max(1, distinct // (8 * owners))
    bits = min(DEEPEST, max(8, (distinct // capacity).bit_length() + 3))
    counts = keys.groupBy(F.shiftrightunsigned("h", 64 - bits).alias("prefix")).agg(F.count("*").alias("n")).toArrow()
    directory = Directory(dict(zip(counts["prefix"].to_pylist(), counts["n"].to_pylist(), strict=True)), capacity, bits)
    stored = directory.store(spark, owners)
    hot = 64 + rows // 65536 if hot is None else hot
    large = cut(keys.where(F.col("n") > hot).select("h"), "hot", 1 << 16)
    drop(keys)

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    hashed = text.withColumn("h", F.xxhash64("text"))
    kind = "h long, text binary, keep_id long, n long"
    chain = lambda rows: rows.select("doc_id", "text").mapInArrow(lambda b: _chain(b, room), kind)
    # Under 65,536 numbers, whatever the corpus's size.
    few = chain(hashed.join(F.broadcast(large), "h", "left_semi"))
    rest = chain(hashed.join(F.broadcast(large), "h", "left_anti"))
    # Tasks of a salt share one merge, so an owner meets a hot text once for each salt.
    salts = int(owners**0.5) + 1
    few = few.select((F.spark_partition_id() % salts).alias("salt"), "h", "text", "keep_id", "n")
    few = few.repartition("salt", "h").sortWithinPartitions("salt", "h").mapInArrow(_merge, kind)

    def own(chained: DataFrame) -> DataFrame:
        dealt = chained.withColumn("slot", directory.slot("h")).join(F.broadcast(stored), "slot")
        dealt = dealt.repartitionById(owners, "owner").sortWithinPartitions("bucket", "h").select("bucket", "h", "text", "keep_id", "n")
        return dealt.mapInArrow(_own, "bucket int, h long, chain int, n_bytes long, text_sha256 string, keep_id long, group_size long")

    return cut(own(rest).union(own(few)), "index"), large, directory, stored


def exact_duplicates(docs: DataFrame, **index) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of docs(doc_id, text, ...).

    Texts are compared byte by byte, unchanged; null counts as empty.  Of equal texts the row with
    the largest doc_id stays.  Rows that repeat the largest doc_id are all kept; a row without
    doc_id is kept only if no row of its group has one, and keep_id is null then.  An empty table
    gives an empty result; other columns are ignored.  ``index``: see build_index.
    """
    docs = parts(docs, "doc_id", "text")
    listed = cut(entries(docs), "entries")
    made, large, directory, stored = build_index(docs, listed, **index)
    named = made.select("bucket", "h", "text_sha256", "keep_id", "group_size")
    rows = listed.withColumn("slot", directory.slot("h")).join(F.broadcast(stored), "slot").select("bucket", "h", "text_sha256", "doc_id")
    at = ["bucket", "h", "text_sha256"]
    hot = rows.join(F.broadcast(large), "h", "left_semi").join(F.broadcast(named.join(F.broadcast(large), "h", "left_semi")), at)
    rest = rows.join(F.broadcast(large), "h", "left_anti").join(named, at)
    found = rest.select("doc_id", *at, "keep_id", "group_size").union(hot.select("doc_id", *at, "keep_id", "group_size"))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
