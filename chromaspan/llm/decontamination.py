"""Benchmark decontamination by suffix arrays of the training words.

Tasks collect the words of their documents in shards and sort the shards' suffixes.  Every suffix of the
benchmark is looked up in them by binary search: the suffixes that begin with one of its windows lie side
by side, so one search finds all places of a window, and the neighbours of a suffix's own place hold its
longest verbatim match.

Words are runs of a-z, digits and characters beyond ASCII, after A-Z are put in lower case.  The
benchmark is stored in blocks of a bounded number of words.  A task reads one block after another, so
neither side has to fit in its memory and no text is ever shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, drop, new_path, parts, place, positional, small_batches, text_or_empty

#: Consecutive words that make a match.
WINDOW = 10
#: Words of a shard: its arrays take some 60 MB.
SHARD = 1 << 20
#: An item is stored in pieces of so many words, WINDOW - 1 of them shared with the next piece.
PIECE = 4096
#: Words of a block of the benchmark, about: blocks are dealt by hash.
BLOCK = 1 << 20
#: Everything but a word's characters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all words of the texts one after another, the number of words of each text)."""
    split = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=BETWEEN)
    flat, owner = split.flatten(), pc.list_parent_indices(split)
    there = pc.not_equal(flat, "")
    return flat.filter(there), np.bincount(owner.filter(there).to_numpy(), minlength=len(texts)).astype(np.int64)


def pieces(benchmark: DataFrame, window: int = WINDOW, piece: int = PIECE) -> DataFrame:
    """benchmark(item_id, text, ...) -> (item string, start, words): every window of an item is whole in
    one of its pieces; an item without words has none."""
    rows = parts(benchmark, "item_id", "text")
    rows = rows.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), text_or_empty("text").alias("text"))
    small_batches(benchmark.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, counts = words_of(b.column(1))
            at = 0
            for item, n in zip(b.column(0).to_pylist(), counts.tolist(), strict=True):
                for start in range(0, max(min(n, 1), n - window + 1), piece - window + 1):
                    words = flat.slice(at + start, min(piece, n - start)).to_pylist()
                    yield pa.RecordBatch.from_arrays([pa.array([item]), pa.array([start], pa.int64()), pa.array([words], pa.list_(pa.string()))], ["item", "start", "words"])
                at += n

    return rows.mapInArrow(run, "item string, start long, words array<string>")


def store(benchmark: DataFrame, window: int = WINDOW, piece: int = PIECE, block: int = BLOCK) -> list[str]:
    """Writes the benchmark's pieces to the shared folder; returns the folders of its blocks."""
    spark = benchmark.sparkSession
    made = cut(pieces(benchmark, window, piece), "pieces")
    total = made.agg(F.sum(F.size("words"))).first()[0] or 0
    n = -(-total // block)
    path = new_path(spark, "benchmark")
    dealt = made.withColumn("block", F.pmod(F.xxhash64("item", "start"), F.lit(max(1, n))).cast("int"))
    (dealt.coalesce(1) if n <= 1 else dealt.repartition(n, "block")).write.partitionBy("block").parquet(path)
    drop(made)
    return [f"{path}/block={b}" for b in range(n)]


@dataclass
class Tests:
    """A block: the words of its pieces with a gap behind each, and where its windows begin."""

    vocabulary: pa.Array
    words: np.ndarray
    items: list[str]
    starts: list[int]
    piece: np.ndarray
    left: np.ndarray
    window: np.ndarray
    length: np.ndarray
    owners: list[tuple[str, ...]]
    depth: int


def load(folder: str, window: int = WINDOW) -> Tests | None:
    """The block stored in a folder, None if it has no pieces."""
    from pyarrow import dataset, fs

    files, top = fs.FileSystem.from_uri(folder)
    if files.get_file_info(top).type == fs.FileType.NotFound:
        return None
    table = dataset.dataset(top, filesystem=files, format="parquet").to_table(columns=["item", "start", "words"]).combine_chunks()
    lists = table["words"].combine_chunks()
    flat = lists.flatten()
    vocabulary = flat.unique()
    sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
    ids = pc.index_in(flat, value_set=vocabulary).to_numpy().astype(np.int64)
    # left: words from here to the piece's end.
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(ids))
    piece = np.repeat(np.arange(len(sizes)), sizes)
    # A piece that starts its item and is shorter than a window is one window.
    size = np.minimum(window, sizes)
    begins = np.flatnonzero(left >= size[piece])
    first: dict[bytes, int] = {}
    owners: list[set[str]] = []
    items = table["item"].to_pylist()
    for at, p in zip(begins.tolist(), piece[begins].tolist(), strict=True):
        w = first.setdefault(ids[at : at + size[p]].tobytes(), len(first))
        if w == len(owners):
            owners.append(set())
        owners[w].add(items[p])
    places = np.zeros(len(first), np.int64)
    keys = {k: i for k, i in first.items()}
    for at, p in zip(begins[::-1].tolist(), piece[begins][::-1].tolist(), strict=True):
        places[keys[ids[at : at + size[p]].tobytes()]] = at
    interned: dict[tuple[str, ...], tuple[str, ...]] = {}
    of_window = [interned.setdefault(t, t) for t in (tuple(sorted(o)) for o in owners)]
    return Tests(vocabulary, ids, items, table["start"].to_pylist(), piece, left, places, size[piece[places]] if len(places) else places, of_window, int(sizes.max(initial=0)))


def suffixes(s: np.ndarray, depth: int) -> np.ndarray:
    """The positions of s in the order of the ``depth`` numbers from there on; a suffix that ends
    comes before those that go on.  Sorted by doubling: ranks of k numbers give those of 2 k."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    rank = np.empty(n, np.int64)

    def ranked(keys: np.ndarray) -> int:
        steps = np.concatenate([[0], np.cumsum(keys[1:] != keys[:-1])]) if n else np.zeros(0, np.int64)
        rank[order] = steps
        return int(steps[-1]) + 1 if n else 0

    found, k = ranked(s[order]), 1
    while k < depth and found < n:
        key = rank * (n + 1)
        key[:-k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        found = ranked(key[order])
        k *= 2
    return order


def _compare(tests: np.ndarray, t: np.ndarray, n: np.ndarray, s: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each n words from t in tests and those from p in s: (their order as -1, 0, 1, words in common)."""
    order, common = np.zeros(len(t), np.int8), np.zeros(len(t), np.int64)
    live, j = np.flatnonzero(n > 0), 0
    while live.size:
        a, at = tests[t[live] + j], p[live] + j
        b = np.where(at < len(s), s[np.minimum(at, len(s) - 1)], -1)
        order[live] = np.sign(a - b)
        live, j = live[a == b], j + 1
        common[live] = j
        live = live[n[live] > j]
    return order, common


def search(tests: np.ndarray, t: np.ndarray, n: np.ndarray, s: np.ndarray, order: np.ndarray, behind: bool = False) -> np.ndarray:
    """For each n words from t: how many suffixes of s come before them, with ``behind`` also those
    that begin with them.  One binary search for all."""
    low, high = np.zeros(len(t), np.int64), np.full(len(t), len(order), np.int64)
    live = np.flatnonzero(low < high)
    while live.size:
        mid = (low[live] + high[live]) // 2
        c = _compare(tests, t[live], n[live], s, order[mid])[0]
        right = c >= 0 if behind else c > 0
        low[live] = np.where(right, mid + 1, low[live])
        high[live] = np.where(right, high[live], mid)
        live = live[low[live] < high[live]]
    return low


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the range, number) of each number of the ranges low <= number < high."""
    sizes = high - low
    which = np.repeat(np.arange(len(low)), sizes)
    return which, np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low, sizes)


def _numbers(flat: pa.Array, counts: np.ndarray, tests: Tests) -> np.ndarray:
    """Documents' words as the block's numbers, with a gap behind each document.  A gap, and a word
    that isn't in the block, is a number of its own: no match goes over it."""
    ids = pc.fill_null(pc.index_in(flat, value_set=tests.vocabulary), -1).to_numpy().astype(np.int64)
    s = np.insert(ids, np.cumsum(counts), -1)
    other = np.flatnonzero(s < 0)
    s[other] = len(tests.vocabulary) + np.arange(len(other))
    return s


def _shards(s: np.ndarray, tests: Tests, shard: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(position, numbers, suffix array) of s in shards that overlap by the longest piece; suffixes
    that begin with no word of the block are left out."""
    for at in range(0, max(1, len(s)), shard):
        part = s[at : at + shard + tests.depth]
        order = suffixes(part, tests.depth)
        yield at, part, order[: np.searchsorted(part[order], len(tests.vocabulary))]


def _hits(s: np.ndarray, tests: Tests, shard: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether each number of s is in a window that occurs, places of windows, windows there)."""
    marks, places, windows = np.zeros(len(s) + 1, np.int64), [], []
    for at, part, order in _shards(s, tests, shard):
        low = search(tests.words, tests.window, tests.length, part, order)
        high = search(tests.words, tests.window, tests.length, part, order, behind=True)
        which, rank = _spread(low, high)
        found = order[rank] + at
        marks += np.bincount(found, minlength=len(s) + 1) - np.bincount(found + tests.length[which], minlength=len(s) + 1)
        places.append(found)
        windows.append(which)
    return np.cumsum(marks)[:-1] > 0, np.concatenate(places), np.concatenate(windows)


def _rate(flat: pa.Array, counts: np.ndarray, folders: list[str], window: int, shard: int) -> tuple[np.ndarray, list[set[str]]]:
    """(words hit, items that occur) by document."""
    ends = np.cumsum(counts)
    hit = np.zeros(len(flat), bool)
    items: list[set[str]] = [set() for _ in counts]
    # Where a document's words are among those of all, gaps counted.
    docs = np.repeat(np.arange(len(counts)), counts)
    for folder in folders:
        if (tests := load(folder, window)) is None:
            continue
        marked, places, windows = _hits(_numbers(flat, counts, tests), tests, shard)
        hit |= marked[np.arange(len(flat)) + docs]
        owner = np.searchsorted(ends + np.arange(len(ends)), places, side="left")
        for doc, w in np.unique(np.stack([owner, windows], axis=1), axis=0).tolist():
            items[doc].update(tests.owners[w])
    before = np.concatenate([[0], np.cumsum(hit)])
    return before[ends] - before[ends - counts], items


def _groups(batches: Iterator[pa.RecordBatch], text: int, shard: int) -> Iterator[tuple[pa.RecordBatch | pa.Table, pa.Array, np.ndarray]]:
    """Batches joined up to a shard of words, with their words."""
    held, flats, sizes, n = [], [], [], 0
    for b in batches:
        flat, counts = words_of(b.column(text))
        held.append(b)
        flats.append(flat)
        sizes.append(counts)
        n += len(flat)
        if n >= shard:
            yield pa.Table.from_batches(held), pa.concat_arrays(flats), np.concatenate(sizes)
            held, flats, sizes, n = [], [], [], 0
    if held:
        yield pa.Table.from_batches(held), pa.concat_arrays(flats), np.concatenate(sizes)


def _each(docs: DataFrame, folders: list[str], schema: str, made: Callable, window: int, shard: int) -> DataFrame:
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, flat, counts in _groups(batches, -1, shard):
            yield from made(table, counts, *_rate(flat, counts, folders, window, shard)).to_batches()

    return docs.mapInArrow(run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard: int = SHARD, piece: int = PIECE, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_words, n_hit, items array<string>) for every row of docs(doc_id, text, ...): the
    document's words, those inside a verbatim window of the benchmark, and the items with such windows.

    A window is ``window`` words of an item in a row; an item of fewer is one window, one of none has
    none.  Items are told by item_id as text: rows of one id are one item, and a null id is the item ''.
    A null or empty text has no words.  Repeated rows, and rows without doc_id, are rated like others.  An
    empty benchmark has no windows; an empty table gives an empty result; other columns are ignored.
    """
    folders = store(benchmark, window, piece, block)
    rows = parts(docs, "doc_id", "text")
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))

    def made(table: pa.Table, counts: np.ndarray, hit: np.ndarray, items: list[set[str]]) -> pa.Table:
        columns = [table["doc_id"], pa.array(counts), pa.array(hit, pa.int64()), pa.array([sorted(i) for i in items], pa.list_(pa.string()))]
        return pa.table(columns, ["doc_id", "n_words", "n_hit", "items"])

    return _each(rows, folders, "doc_id long, n_words long, n_hit long, items array<string>", made, window, shard)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard: int = SHARD, piece: int = PIECE, block: int = BLOCK) -> DataFrame:
    """The rows of docs(text, ...) without a window of the benchmark, all their columns as they are.
    Nulls, empty texts and repeated rows are as in ``contamination``: without words nothing is hit."""
    folders = store(benchmark, window, piece, block)
    rows = positional(docs)
    own = rows.schema
    rows = rows.withColumn("text", text_or_empty(place(docs, "text")))

    def made(table: pa.Table, counts: np.ndarray, hit: np.ndarray, items: list[set[str]]) -> pa.Table:
        return table.drop_columns(["text"]).filter(pa.array(hit == 0))

    return _each(rows, folders, own, made, window, shard).toDF(*docs.columns)


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard: int = SHARD, piece: int = PIECE, block: int = BLOCK) -> DataFrame:
    """(item, words, start, doc_id, doc_start) of each item that shares a word with docs: its longest
    verbatim match, where it starts in the item and in a document, in words from 0.

    Of equally long ones the first of the item counts, then the least doc_id (null before all), then the
    first there.  Each shard gives one candidate a piece, and those are merged by aggregation.  A
    match is sought within a piece.
    """
    folders = store(benchmark, window, piece, block)
    rows = parts(docs, "doc_id", "text")
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    small_batches(docs.sparkSession)
    names = ["item", "words", "start", "doc_id", "doc_start"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, flat, counts in _groups(batches, -1, shard):
            ids = table["doc_id"].to_pylist()
            begins = np.cumsum(counts) - counts + np.arange(len(counts))
            # Places in the order of doc_id, null first, and within a document.
            by_id = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, i))
            turn = np.empty(len(ids), np.int64)
            turn[by_id] = np.arange(len(ids))
            for folder in folders:
                if (tests := load(folder, window)) is None:
                    continue
                s, t = _numbers(flat, counts, tests), np.arange(len(tests.words))
                turns = np.repeat(turn, counts + 1) * len(s) + np.arange(len(s))
                first = np.searchsorted(tests.piece, np.arange(len(tests.items)))
                for at, part, order in _shards(s, tests, shard):
                    if not len(order):
                        continue
                    place = search(tests.words, t, tests.left, part, order)
                    sides = [np.maximum(place - 1, 0), np.minimum(place, len(order) - 1)]
                    common = np.maximum(*[_compare(tests.words, t, tests.left, part, order[side])[1] for side in sides])
                    # Of each piece the first suffix with its longest match goes on.
                    top = np.maximum.reduceat(common, first)
                    chosen = np.flatnonzero((common > 0) & (common == top[tests.piece]))
                    chosen = chosen[np.unique(tests.piece[chosen], return_index=True)[1]]
                    if not len(chosen):
                        continue
                    low = search(tests.words, chosen, common[chosen], part, order)
                    high = search(tests.words, chosen, common[chosen], part, order, behind=True)
                    ranges, which = np.unique(np.stack([low, high], axis=1), axis=0, return_inverse=True)
                    least = np.minimum.reduceat(np.append(turns[order + at], np.iinfo(np.int64).max), ranges.ravel())[::2]
                    doc, place = np.divmod(least[which.ravel()], len(s))
                    doc = np.array(by_id)[doc]
                    piece = tests.piece[chosen]
                    found = [
                        pa.array([tests.items[p] for p in piece]), pa.array(common[chosen]), pa.array([tests.starts[p] for p in piece] + chosen - first[piece]),
                        pa.array([ids[d] for d in doc], pa.int64()), pa.array(place - begins[doc]),
                    ]
                    yield pa.RecordBatch.from_arrays(found, names)

    found = rows.mapInArrow(run, "item string, words long, start long, doc_id long, doc_start long")
    best = F.min(F.struct((-F.col("words")).alias("less"), "start", "doc_id", "doc_start")).alias("m")
    return found.groupBy("item").agg(best).select("item", (-F.col("m.less")).alias("words"), "m.start", "m.doc_id", "m.doc_start")


def oracle(window: int = WINDOW) -> str:
    """The same digests by a join of windows as text."""
    words = lambda table: f"regexp_extract_all(translate(coalesce({table}.text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {words("benchmark")} AS w FROM benchmark),
windows AS (SELECT DISTINCT item, size, array_to_string(w[i + 1 : i + size], ' ') AS gram FROM (SELECT item, w, least(len(w), {window}) AS size, unnest(range(len(w) - least(len(w), {window}) + 1)) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT row_number() OVER () AS r, doc_id, {words("documents")} AS w FROM documents),
grams AS (SELECT r, size, i, array_to_string(w[i + 1 : i + size], ' ') AS gram FROM (SELECT r, w, size, unnest(range(len(w) - size + 1)) AS i FROM docs, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)),
found AS (SELECT r, i, size, item FROM grams JOIN windows USING (size, gram)),
hit AS (SELECT r, count(DISTINCT word) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS word FROM (SELECT DISTINCT r, i, size FROM found)) GROUP BY r),
of_doc AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN of_doc USING (r)"""
