"""Other ways of an operator give the same rows; hot groups; what the trained models decide; damage."""

import hashlib
import itertools
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chromaspan.llm import exact_dedup, line_dedup, media, mixing, near_dedup, packing, pii, quality, secrets, warc
from chromaspan.llm import queries as Q

SF = "/root/testdata/sf0.001"


def plain(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_boilerplate_by_join_equals_boilerplate_sent(spark, docs):
    more = docs.union(docs.select(F.lit(None).cast("long"), F.concat("text", F.lit("\nrow without id"), F.col("doc_id")), "lang", "source", "n_chars"))
    for run in (line_dedup.drop_boilerplate, line_dedup.clean_lines):
        want = plain(run(more))
        assert plain(run(more, sent=0)) == want and plain(run(more, sent=0, broadcast=0)) == want and plain(run(more, broadcast=0)) == want


def test_mix_by_salted_leaf_equals_mix(spark, docs):
    assert plain(mixing.mix(docs, most=0)) == plain(mixing.mix(docs))
    assert plain(mixing.take(docs)) == plain(mixing.mix(docs).select(*docs.columns))


@pytest.mark.parametrize("setting", near_dedup.SETTINGS)
def test_every_setting_gives_the_same_components(docs, setting):
    blocks, chosen = setting
    assert plain(near_dedup.near_duplicates(docs, blocks=blocks, chosen=chosen, block=64)) == plain(near_dedup.near_duplicates(docs))


def test_cheapest_setting_widens_with_the_fingerprints():
    picked = [near_dedup.cheapest(1 << n) for n in (4, 20, 28, 33)]
    assert picked[0] == picked[1] == (3, 1) and picked[-1] == (6, 3) and [near_dedup.SETTINGS.index(p) for p in picked] == sorted(near_dedup.SETTINGS.index(p) for p in picked)


def test_keep_one_by_merge_equals_keep_one_by_broadcast(docs):
    assert plain(near_dedup.keep_one(docs, sent=0)) == plain(near_dedup.keep_one(docs))


@pytest.mark.parametrize("index", [{"hot": 0}, {"hot": 3, "capacity": 2}, {"hot": 1 << 40, "room": 100}, {"hot": 20, "room": 0}])
def test_exact_dedup_of_hot_texts(spark, index):
    texts = ["hot"] * 400 + ["warm"] * 30 + [f"t{i % 50}" for i in range(120)] + [None, "", "x" * 5000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(7)
    of: dict = {}
    for i, t in enumerate(texts):
        of.setdefault(t or "", []).append(i)
    want = {(i, max(of[t or ""]), len(of[t or ""]), i == max(of[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in enumerate(texts)}
    got = exact_dedup.exact_duplicates(rows, **index).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(texts)


def test_a_task_sends_a_hot_text_once():
    """Texts seen again stay in the table when it's full, and each is whole."""
    rows = [(i, b"hot" if i % 2 else b"cold %05d" % i) for i in range(2000)]
    batches = [pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows[a : a + 50]]), pa.array([t.decode() for _, t in rows[a : a + 50]])], ["doc_id", "text"]) for a in range(0, 2000, 50)]
    got = [r for b in exact_dedup._chain(iter(batches), room=5000) for r in b.to_pylist()]
    assert [r["n"] for r in got if r["text"] == b"hot"] == [1000] and len(got) == 1001 and max(r["keep_id"] for r in got if r["text"] == b"hot") == 1999


def test_directory_is_stored_and_leads_to_classes(spark, docs):
    listed = exact_dedup.entries(docs)
    made, _, directory, stored = exact_dedup.build_index(docs, listed, capacity=4)
    assert stored.count() == 1 << directory.depth and directory.depth > 3
    found = listed.withColumn("slot", directory.slot("h")).join(stored, "slot")
    classes = found.join(made, ["bucket", "h", "text_sha256"])
    assert classes.count() == docs.count() and found.join(made, ["h"]).where(found.bucket != made.bucket).isEmpty()


def test_buckets_are_folders_of_one_length(spark, docs, tmp_path):
    packing.write_buckets(packing.pack(docs, Q.TOKENIZER), str(tmp_path / "packed"))
    got = spark.read.parquet(str(tmp_path / "packed"))
    assert got.where(F.col("length") != F.pow(F.lit(2), F.col("bucket"))).isEmpty() and got.count() == packing.pack(docs, Q.TOKENIZER).count()
    assert len([p for p in (tmp_path / "packed").iterdir() if p.name.startswith("bucket=")]) == got.select("bucket").distinct().count()


def test_tokenizers_with_other_rules_take_the_plain_way(tmp_path):
    import json

    with open(Q.TOKENIZER, encoding="utf-8") as file:
        made = json.load(file)
    assert packing.cuts_at_spaces(Q.TOKENIZER)
    made["normalizer"] = None
    path = str(tmp_path / "other.json")
    with open(path, "w", encoding="utf-8") as file:
        json.dump(made, file)
    words, texts = packing.Words(path), ["Two Words  here", "", "Ünï\n\nx"]
    assert not words.by_chunk
    ids, bounds = words.encode(pa.array(texts))
    fresh = Tokenizer.from_file(path)
    assert [ids[a:b].tolist() for a, b in itertools.pairwise(bounds)] == [[*fresh.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_packed_features():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 8192, 200_000):
        x = np.sort(rng.choice(quality.SIZE, n, replace=False))
        raw = quality.packed(x)
        assert (quality.unpacked(raw) == x).all() and len(raw) <= 33_000


def brute_png(payload):
    """Rows filtered one by one: least sum of distances from zero among none, sub and up."""
    rows, out = [payload[i : i + 64] for i in range(0, len(payload), 64)], b""
    for r, row in enumerate(rows):
        above = rows[r - 1] if r else bytes(64)
        kinds = [row, bytes((x - (row[i - 1] if i else 0)) % 256 for i, x in enumerate(row)), bytes((x - above[i]) % 256 for i, x in enumerate(row))]
        costs = [sum(min(x, 256 - x) for x in k) for k in kinds]
        best = costs.index(min(costs))
        out += bytes([best]) + kinds[best]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    data = zlib.compress(out, 1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 64, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", data) + chunk(b"IEND", b"")


def brute_hash(payload):
    """Low frequencies of the picture averaged to 32 x 32, each average taken over fractional rows."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, 64).astype(float)
    fine = np.repeat(rows, 32, axis=0).reshape(32, -1, 64).mean(axis=1)
    small = fine.reshape(32, 32, 2).mean(axis=2)
    wave = np.array([[np.cos(np.pi * k * (2 * x + 1) / 64) for x in range(32)] for k in range(8)])
    low = np.round(wave @ small @ wave.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def test_media_against_brute_force(spark, docs):
    texts = {r.doc_id: (r.text or "").encode() for r in docs.where("length(text) < 6000").collect()}
    got = {r.doc_id: r for r in Q.QUERIES["op6_media_columns"](spark, SF).collect()}
    assert len(texts) > 50
    for i, raw in texts.items():
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        stored = brute_png(payload)
        assert (got[i].media_bytes, got[i].media_sha256, got[i].feature) == (len(stored), hashlib.sha256(stored).hexdigest(), brute_hash(payload))


def test_diagonals_undo_all_filters():
    rng = np.random.default_rng(5)
    for rows in (1, 2, 63, 64, 65, 200):
        pixels, lines = rng.integers(0, 256, (rows, 64), dtype=np.uint8), np.zeros((rows, 65), np.uint8)
        padded = np.zeros((rows + 1, 65), int)
        padded[1:, 1:] = pixels
        left, up, corner = padded[1:, :-1], padded[:-1, 1:], padded[:-1, :-1]
        for kind in (3, 4):
            lines[:, 0] = kind
            p = left + up - corner
            paeth = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
            lines[:, 1:] = (pixels - ((left + up) // 2 if kind == 3 else paeth)) % 256
            assert (media.unfilter(lines) == pixels).all()


def test_warc_damage_and_headers():
    plain = zlib.decompress(warc.write_record(1, "http://a/ü​\nb", b"<p>x</p>", None), 31)
    assert "http://a/ü%E2%80%8B%0Ab".encode() in plain
    for head in ("WARC-Type", "Content-Length", "WARC-Block-Digest", "WARC-Payload-Digest"):
        with pytest.raises(warc.WarcError):
            warc.read_record(re.sub(rf"\r\n{head}: [^\r]*".encode(), b"", plain, count=1))
    for damaged in (plain.replace(b"Content-Length: ", b"Content-Length: x", 1), plain.replace(b"X-Page-ID: 1", b"X-Page-ID: one"), b"WARC/1.1\xff\r\n\r\n"):
        with pytest.raises(warc.WarcError):
            warc.read_record(damaged)


def test_warc_record_ids_are_different(spark):
    pages = spark.createDataFrame([(3, "u", "same"), (3, "v", "same"), (None, "w", "a"), (None, "w", "b"), (5, "x", "same")], "page_id long, url string, html string").coalesce(1)
    path = warc.write_archives(pages).first().path.removeprefix("file://")
    with open(path, "rb") as file:
        fields = [warc.parse_record(m)[0] for m in warc.read_members(file)]
    ids = [f["warc-record-id"] for f in fields]
    assert len(set(ids)) == 5 and {f["warc-refers-to"] for f in fields if "warc-refers-to" in f} <= set(ids)


def test_warc_by_merge_equals_warc_by_broadcast(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    found = lambda **k: plain(warc.read_archives(warc.write_archives(pages, **k)))
    assert found(sent=0) == found()


def test_forest_on_the_corpus(spark):
    """Precision and recall on candidates of the supplied documents, none of which it was trained on."""
    sf = "/root/testdata/sf0.1"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    planted = {(i, *m.span(1)) for i, t in docs.items() for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', t)}
    rows = Q.QUERIES["op1_secret_scan"](spark, sf).collect()
    called = {(r.doc_id, r.start, r.end) for r in rows if r.is_secret}
    assert len(rows) > 5 * len(planted) > 500
    assert len(called & planted) >= 0.98 * len(planted) and len(called & planted) >= 0.98 * len(called)


def test_lexicon():
    words = secrets.lexicon(Q.TOKENIZER)
    assert len(words.words) > 10_000 and words.covered("houseboat") > 0.9 > words.covered("xqzvkjwpq")
    assert words.transitions("houseboat") > words.transitions("xqzvkjwpq") and words.covered("") == 0


def test_span_classifier_decides(spark):
    """On the supplied documents: numbers that fail their test are rejected, telephone numbers that
    the base pattern lost by running on into other digits are accepted."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    looser = pii.candidates(docs).select("doc_id", F.explode("spans").alias("x")).where("not x.base")
    found = pii.find(docs).select("doc_id", F.explode(F.array_except("spans", "base")).alias("x"))
    counts = dict(looser.groupBy("x.kind").count().collect())
    assert counts[2] >= 100 and counts[3] >= 1
    assert {r.kind for r in found.select("x.kind").collect()} == {3}
    text = found.join(docs, "doc_id").select(F.expr("substring(text, x.s + 1, x.e - x.s)").alias("t"))
    assert all(re.fullmatch(r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}", r.t) for r in text.collect())
    assert looser.select("x.gazetteer").distinct().count() == 2 and looser.select("x.pattern").distinct().count() == 2
