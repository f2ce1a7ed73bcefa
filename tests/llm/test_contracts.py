"""Each query against a brute-force version over the whole smallest tables."""

import base64
import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from chromaspan.llm import queries as Q

SF = "/root/testdata/sf0.001"
KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


@pytest.fixture(scope="module")
def docs(duck):
    return {i: t or "" for i, t in duck.sql("SELECT doc_id, text FROM documents").fetchall()}


def rows(spark, name):
    return Q.QUERIES[name](spark, SF).collect()


def same(df, relation):
    columns = df.columns
    got = sorted(map(repr, (tuple(r) for r in df.collect())))
    assert got == sorted(map(repr, (tuple(r[relation.columns.index(c)] for c in columns) for r in relation.fetchall())))


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_sql(spark, duck, name):
    same(Q.QUERIES[name](spark, SF), duck.sql(Q.ORACLES[name]))


def brute_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_near_dedup(spark, docs):
    got = rows(spark, "op3_near_dedup")
    prints = {i: brute_print(t) for i, t in docs.items()}
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == prints
    assert {r.doc_id: r.component_id for r in got} == brute_components(prints)


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    tokenizer, by = Tokenizer.from_file(Q.TOKENIZER), defaultdict(list)
    got = rows(spark, "op4_packing")
    for r in got:
        by[r.doc_id].append(r)
    assert len({r.sequence_id for r in got}) == len(got) and all(r.offset == 0 and r.length <= 2048 and not r.length & (r.length - 1) for r in got)
    for i, t in docs.items():
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert (r.start, r.ids_crc32, r.doc_tokens) == (at, zlib.crc32(ids[at : at + r.length].tobytes()), len(ids))
            at += r.length
        assert at == len(ids)


def test_quality(spark, duck, docs):
    got = rows(spark, "op5_quality")
    assert {r.doc_id for r in got} == docs.keys()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    labels = dict(duck.sql("SELECT doc_id, quality FROM labels").fetchall())
    held = [r.predicted == labels[r.doc_id] for r in got if r.held_out and r.doc_id in labels]
    assert sum(held) >= 0.9 * len(held)


def test_media(spark, docs):
    for r in rows(spark, "op6_media_columns"):
        raw = docs[r.doc_id].encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_warc(spark, duck):
    pages = {i: (h or "").encode() for i, h in duck.sql("SELECT page_id, html FROM pages").fetchall()}
    first = {}
    for i in sorted(pages):
        first.setdefault(pages[i], i)
    got = rows(spark, "op7_warc")
    assert len(got) == len(pages)
    for r in got:
        raw = pages[r.page_id]
        to = None if first[raw] == r.page_id else first[raw]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if to is None else "revisit", to)


def passes(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(x) <= 255 for x in text.split("."))
    if kind == "card":
        total = sum((2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) if i % 2 else int(c) for i, c in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in KINDS.items() for m in re.finditer(p, text) if passes(k, m[0])]


def test_personal_data(spark, docs):
    for r in rows(spark, "op10_personal_data"):
        base = base_spans(docs[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k + ":") for s in base) for k in KINDS]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r.spans.split(",") if r.spans else [])


def test_secrets(spark, docs):
    planted = {(i, *m.span(1)) for i, t in docs.items() for m in re.finditer(r'(?i)token = "([^"]*)"', t)}
    found = {(r.doc_id, r.start, r.end) for r in rows(spark, "op1_secret_scan") if r.is_secret}
    assert found == planted


def test_pipeline(spark, duck, docs):
    import corpus_pipeline as P

    table = spark.read.parquet(f"{SF}/documents.parquet")
    labels = dict(duck.sql("SELECT doc_id, quality FROM labels").fetchall())
    step = table
    for name, stage in P.STAGES:
        before, step = step, stage(spark, step, SF)
        if name != "packing":
            assert step.columns == table.columns
            step = spark.createDataFrame(step.collect(), table.schema)
        ids = {r.doc_id for r in step.select("doc_id").collect()}
        if name == "quality_classifier":
            good, bad = ([i for i in docs if labels.get(i) == q] for q in (1, 0))
            assert sum(i in ids for i in good) >= 0.95 * len(good) and sum(i in ids for i in bad) <= 0.3 * len(bad)
        elif name == "line_dedup":
            assert step.count() == before.count()
        elif name == "near_dedup":
            prints = {r.doc_id: brute_print(r.text) for r in before.collect()}
            assert ids == set(brute_components(prints).values())
        elif name == "packing":
            assert ids == {r.doc_id for r in before.collect()}
    assert len(P.run(spark, SF).columns) > 5
