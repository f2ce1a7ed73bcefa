"""SimHash near-duplicates found through deletion-variant signatures.

A 64-bit fingerprint is cut into blocks and some of them are chosen as a segment, so that among
fingerprints at most ``distance`` bits apart some segment differs in at most one bit.  For every
segment and every bit of it, the segment with that bit wiped is an index key; two segments that
differ in at most one bit share a key.  Rows meet by equality of the key and every pair is then
verified on whole fingerprints.

Nothing emits all pairs of a group: equal fingerprints are one node, and each key's members are
searched breadth first, which emits at most one link for every member reached.  Members of a key
with over ``block`` fingerprints are dealt to pairs of blocks in a second pass, so no task holds
an unbounded group and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import cut, drop, give_back, parts, place, positional, small_batches

SEED = 42
#: (blocks, chosen) of segments to take the cheapest of; all give the same links.
SETTINGS = [(3, 1), (5, 2), (6, 3)]
#: Comparisons within a key that cost as much as one index row.
COMPARED = 8
#: At most this many ids are broadcast, 8 MB of numbers; more are joined by sorting.
SENT_IDS = 1 << 20


def simhash(raw: bytes, width: int = 4) -> int:
    """Unsigned fingerprint of UTF-8 text: bits set in over half the hashes of its shingles."""
    words = raw.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    starts = np.zeros(n + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1, out=starts[1:])
    firsts, ends = starts[:-width], starts[width:] - 1
    total, digest = np.zeros(64, np.int64), xxhash.xxh64_digest
    for at in range(0, len(firsts), 1 << 15):
        pairs = zip(firsts[at : at + (1 << 15)].tolist(), ends[at : at + (1 << 15)].tolist(), strict=True)
        got = np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in pairs]), np.uint8)
        total += np.unpackbits(got).reshape(-1, 64).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * total > len(firsts)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = np.fromiter((simhash(t.as_py() or b"", width) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def segment_masks(blocks: int, chosen: int, distance: int = 4) -> list[int]:
    """Masks of the segments; any ``distance`` flipped bits leave one with at most one flip."""
    if sorted([distance // blocks + (i < distance % blocks) for i in range(blocks)])[:chosen] > [0] * (chosen - 1) + [1]:
        raise ValueError("so few blocks leave no segment with at most one differing bit")
    cuts = [round(i * 64 / blocks) for i in range(blocks + 1)]
    masks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(x) for x in combinations(masks, chosen)]


def cheapest(nodes: int, distance: int = 4) -> tuple[int, int]:
    """The setting of least cost for so many fingerprints: index rows, and comparisons at the load
    that a key of as many bits has to expect.  Wider segments have more rows and less loaded keys."""

    def cost(setting: tuple[int, int]) -> float:
        bits = [m.bit_count() for m in segment_masks(*setting, distance)]
        return sum(b * (1 + nodes / (1 << (b - 1)) / COMPARED) for b in bits)

    return min(SETTINGS, key=cost)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def variants(nodes: DataFrame, blocks: int, chosen: int, distance: int = 4) -> DataFrame:
    """(key, fp): a row for each segment and wiped bit of every fingerprint."""
    keys = []
    for s, mask in enumerate(segment_masks(blocks, chosen, distance)):
        for bit in range(64):
            if mask >> bit & 1:
                keys.append(F.xxhash64(F.lit(s * 64 + bit), F.col("fp").bitwiseAND(F.lit(_signed(mask & ~(1 << bit))))))
    return nodes.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _reach(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among fps."""
    out: list[tuple[int, int]] = []
    rest = fps
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(rest ^ at) <= distance
            if near.any():
                found = rest[near]
                rest = rest[~near]
                queue.extend(found)
                out.extend((int(at), int(x)) for x in found)
    return out


def _links_of(key: np.ndarray, fp: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links within each run of equal keys."""
    edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    sizes = np.diff(edges)
    out: list[tuple[int, int]] = []
    small = np.repeat((sizes > 1) & (sizes <= 8), sizes)
    at, step = np.flatnonzero(small), 1
    while len(at):
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
        near = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= distance]
        out.extend(zip(fp[near].tolist(), fp[near + step].tolist(), strict=True))
        step += 1
    for i in np.flatnonzero(sizes > 8):
        out.extend(_reach(np.unique(fp[edges[i] : edges[i + 1]]), distance))
    return out


def _linker(distance: int, block: int | None):
    """Rows sorted by key -> (a, b, key): a link, or with a null b a member of too large a key."""

    def batch(links: list[tuple[int, int]], key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        a = np.r_[np.array([x for x, _ in links], np.uint64), fp].view(np.int64)
        b = pa.concat_arrays([pa.array(np.array([x for _, x in links], np.uint64).view(np.int64)), pa.nulls(len(fp), pa.int64())])
        return pa.RecordBatch.from_arrays([pa.array(a), b, pa.concat_arrays([pa.nulls(len(links), pa.int64()), pa.array(key)])], ["a", "b", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        none_k, none_f = np.empty(0, np.int64), np.empty(0, np.uint64)
        tail_k, tail_f, large = none_k, none_f, None
        for got in batches:
            key = np.r_[tail_k, got.column(0).to_numpy()]
            fp = np.r_[tail_f, got.column(1).to_numpy().view(np.uint64)]
            if large is not None:
                end = np.searchsorted(key, large, "right")
                if end:
                    yield batch([], key[:end], fp[:end])
                key, fp = key[end:], fp[end:]
            if not len(key):
                tail_k, tail_f = key, fp
                continue
            at = np.searchsorted(key, key[-1], "left")
            if at:
                yield batch(_links_of(key[:at], fp[:at], distance), none_k, none_f)
            tail_k, tail_f = key[at:], fp[at:]
            if block is not None and len(tail_k) > block:
                large = tail_k[0]
                yield batch([], tail_k, tail_f)
                tail_k, tail_f = none_k, none_f
        if len(tail_k):
            yield batch(_links_of(tail_k, tail_f, distance), none_k, none_f)

    return run


def fingerprint_links(nodes: DataFrame, distance: int = 4, blocks: int | None = None, chosen: int = 1, block: int = 4096) -> DataFrame:
    """nodes(fp), distinct -> links(a, b) between fingerprints at most ``distance`` bits apart,
    enough of them to connect all that the full set of links connects."""
    spark = nodes.sparkSession
    if blocks is None:
        blocks, chosen = cheapest(nodes.count(), distance)
    rows = variants(nodes, blocks, chosen, distance).repartition("key").sortWithinPartitions("key")
    found = cut(rows.mapInArrow(_linker(distance, block), "a long, b long, key long"), "found")
    links = found.where("b is not null").select("a", "b")
    large = found.where("b is null").select("key", F.col("a").alias("fp"))
    if large.isEmpty():
        return links
    parts = large.groupBy("key").agg(F.ceil(F.count("*") / (block // 2)).cast("int").alias("n"))
    dealt = large.join(parts, "key").withColumn("i", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    dealt = dealt.select("key", "fp", "i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"))
    dealt = dealt.select(F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).alias("key"), "fp")
    more = dealt.repartition(spark.sparkContext.defaultParallelism * 4, "key").sortWithinPartitions("key")
    return links.union(more.mapInArrow(_linker(distance, None), "a long, b long, key long").select("a", "b"))


def near_duplicates(docs: DataFrame, distance: int = 4, width: int = 4, **index) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs(doc_id, text, ...).

    fingerprint: 16 hex digits.  component_id: the smallest doc_id reachable over links of at most
    ``distance`` bits, the row's own included.  A null text counts as empty; empty texts have the
    fingerprint zero and link like others.  Repeated rows each keep a row.  A row without doc_id
    isn't a node: it takes the component of its fingerprint, null if no other row has that.
    An empty table gives an empty result; other columns are ignored.
    """
    prints = cut(fingerprints(parts(docs, "doc_id", "text"), width), "prints")
    n = prints.count()
    nodes = cut(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes", n)
    linked = components(fingerprint_links(nodes.select("fp"), distance, **index))
    members = linked.select(F.col("node").alias("fp"), "root").union(linked.select(F.col("root").alias("fp"), "root").distinct())
    members = members.join(nodes, "fp")
    roots = members.groupBy("root").agg(F.min("first").alias("low"))
    moved = members.join(roots, "root").select("fp", "low")
    # A table of its own, so that the join below has a plain exchange on either side and a
    # fingerprint with many copies is split over tasks.
    named = cut(nodes.join(moved, "fp", "left").select("fp", F.coalesce("low", "first").alias("component_id")), "named", n)
    return prints.join(named, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, sent: int = SENT_IDS, **params) -> DataFrame:
    """docs without all but the smallest doc_id of each component.  Rows without doc_id stay; of
    rows that repeat a doc_id one stays.  All columns stay as they are, whatever their names."""
    found = cut(near_duplicates(docs, **params).select("doc_id", "component_id"), "found")
    gone = cut(found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct(), "gone", found.count())
    # Whole texts aren't shuffled while the ids that go are few enough to send.
    gone = F.broadcast(gone) if gone.count() <= sent else gone.hint("merge")
    doc = place(docs, "doc_id")
    kept = positional(docs).join(gone, F.col(doc).cast("long") == F.col("gone"), "left_anti")
    ids = found.where("doc_id is not null").groupBy("doc_id").count()
    if not ids.where("count > 1").isEmpty():
        kept = kept.where(F.col(doc).isNotNull()).dropDuplicates([doc]).unionByName(kept.where(F.col(doc).isNull()))
    return kept.toDF(*docs.columns)
