"""Benchmark decontamination against a plain search for windows."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chromaspan.llm import decontamination as D
from chromaspan.llm import queries as Q

SF = "/root/testdata/sf0.001"


def words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute(docs, items, window=10):
    """(doc_id, n_words, n_hit, items) by comparing every place with every window."""
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    sizes = sorted({len(k) for k in windows})
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[k]
        out.append((doc, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def rated(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in df.collect()), key=repr)


def test_whole_tables(spark, duck):
    docs, items = (duck.sql(f"SELECT * EXCLUDE (text), text FROM {t}").fetchall() for t in ("documents", "benchmark"))
    want = brute([(d[0], d[-1]) for d in docs], [(i[0], i[-1]) for i in items])
    got = {(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in Q.op12_decontamination(spark, SF).collect()}
    assert got == {(d, n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0) for d, n, h, i in want}
    assert sum(h > 0 for _, _, h, _ in want) > 0


TEXT = "Alpha, beta gamma delta. Epsilon zeta eta theta iota kappa lambda mu"
ITEMS = [(1, TEXT), (1, "one id, two rows"), (None, "short Item"), (2, None), (3, "  ..!"), (4, ""), (5, TEXT), (6, "ünïcode")]
DOCS = [
    (10, "x " + TEXT.upper() + " y"), (11, TEXT.replace("eta", "ETA!")), (12, "alpha beta gamma delta epsilon zeta eta theta iota"), (13, None), (14, ""), (15, "a short\titem; short item short"),
    (None, "one ID two rows one id"), (16, "ünïcode Ünïcode ÜNÏCODE"), (17, "short"), (17, "item short item"), (18, "no match " * 5000 + TEXT), (19, "kappa lambda mu alpha beta"),
]


@pytest.mark.parametrize("sizes", [{}, {"shard": 16, "piece": 11, "block": 4}, {"shard": 1, "piece": 10, "block": 1000}])
def test_odd_rows(spark, sizes):
    docs = spark.createDataFrame([(d, t, 1, "a") for d, t in DOCS], "doc_id long, text string, items int, words string")
    items = spark.createDataFrame([(i, t, 2) for i, t in ITEMS], "item_id long, text string, start int")
    want = brute(DOCS, ITEMS)
    assert rated(D.contamination(docs, items, **sizes)) == want
    left = D.decontaminate(docs, items, **sizes)
    assert left.columns == docs.columns
    clean = {d for d, t in DOCS if not brute([(d, t)], ITEMS)[0][2]}
    assert sorted((r.doc_id, r.text) for r in left.collect() if r.text) == sorted([*((d, t) for d, t in DOCS if t and d in clean and d != 17), (17, "short")])


def test_empty_tables(spark):
    docs, items = (spark.createDataFrame(r, f"{n} long, text string") for r, n in ((DOCS, "doc_id"), (ITEMS, "item_id")))
    assert {r[2:] for r in map(tuple, D.contamination(docs, items.limit(0)).select("doc_id", "n_words", "n_hit", D.F.size("items")).collect())} == {(0, 0)}
    assert D.decontaminate(docs, items.where("item_id IN (2, 3)")).count() == len(DOCS)
    assert D.contamination(docs.limit(0), items).count() == 0 and D.longest_matches(docs.limit(0), items).count() == 0


def longest(docs, items):
    """{item: (words, start, doc_id, doc_start)} of the longest verbatim match, ties by least."""
    out = {}
    for item, text in items:
        a = words(text)
        for doc, other in docs:
            b = words(other)
            for i in range(len(a)):
                for j in range(len(b)):
                    n = 0
                    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                        n += 1
                    key = (-n, i, doc is not None, doc or 0, j)
                    name = "" if item is None else str(item)
                    if n and (name not in out or key < out[name]):
                        out[name] = key
    return {k: (-v[0], v[1], v[3] if v[2] else None, v[4]) for k, v in out.items()}


@pytest.mark.parametrize("sizes", [{}, {"shard": 16, "block": 4}])
def test_longest_matches(spark, sizes):
    docs = [d for d in DOCS if d[0] != 18]
    got = D.longest_matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string"), **sizes).collect()
    assert {r.item: (r.words, r.start, r.doc_id, r.doc_start) for r in got} == longest(docs, ITEMS)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 70))
def test_suffixes(numbers, depth):
    s = np.array(numbers, np.int64)
    got = D.suffixes(s, depth).tolist()
    assert sorted(got) == list(range(len(s)))
    heads = [numbers[i : i + depth] for i in got]
    assert heads == sorted(heads)


def test_common_passage_in_equal_items(spark):
    """Many documents hold a passage that many items share: sets of items are built once."""
    docs = spark.createDataFrame([(i, f"w{i} {TEXT} v{i}") for i in range(3000)], "doc_id long, text string")
    items = spark.createDataFrame([(i, TEXT) for i in range(300)], "item_id long, text string")
    got = D.contamination(docs, items)
    assert got.where("n_hit = 12 AND size(items) = 300").count() == 3000
