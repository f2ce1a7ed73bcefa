"""Hostile texts of the secret scan, and records of repeated pages over many tasks."""

import re
import time
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chromaspan.llm import secrets, warc


def brute_values(text):
    """Every value behind every cue, and of those inside one that is bare or without spaces none."""
    found = []
    for m in secrets.CUES.finditer(text):
        if v := secrets.VALUE.match(text, m.end()):
            start, whole = v.span(v.lastgroup)
            end = start + len(v["bare"].rstrip(".:)]}")) if v.lastgroup == "bare" else whole
            found.append((m.end(), secrets.HEAD.match(text, m.end()).end(), v.end(), start, end, v.lastgroup == "bare" or not any(c.isspace() for c in text[start:whole])))
    kept = []
    for f in found:
        if not any(g[5] and g is not f and g[0] < f[0] and f[1] < g[2] for g in kept):
            kept.append(f)
    return sorted({f[3:5] for f in kept if f[4] > f[3]})


PIECES = ["token", "secret", "password", ":", "=", " = ", '"', "'", " ", "\n", "abc", "Xy7!", "a1b2c3d4e5f6a7b8c9", ",", ";", ".", "}", "&", "auth: ", "Bearer "]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=30))
def test_values(pieces):
    text = "".join(pieces)
    assert secrets.values(text) == brute_values(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=30))
def test_only_inner_values_are_left_out(pieces):
    """What a match behind every cue finds is a candidate, or lies inside one."""
    text = "".join(pieces)
    every = [v.span(v.lastgroup) for m in secrets.CUES.finditer(text) if (v := secrets.VALUE.match(text, m.end()))]
    kept = secrets.values(text)
    assert all(any(a <= s < b + 5 for a, b in kept) for s, e in every if text[s:e].rstrip(".:)]}"))


@pytest.mark.parametrize("piece", ["token:", "token=", 'token:"', "token='x ", "a", "é", "secret: a1b2c3d4e5f6g7h8 ", "api_key=", "token,", "token.", "0123456789abcdef"])
def test_a_megabyte_of(piece):
    text = piece * (1_000_000 // len(piece))
    began = time.time()
    spans = secrets.every_candidate(text)
    rows = [secrets.features(text, a, b, "") for a, b in spans]
    assert time.time() - began < 20 and np.isfinite(np.array(rows)).all()
    assert sum(b - a for a, b in spans) <= 3 * len(text)


def test_wide_alphabet():
    """A value of many different characters is counted once, not once for each of them."""
    text = 'token = "' + "".join(map(chr, range(0x4E00, 0x9FFF))) * 5 + '"'
    began = time.time()
    (span,) = secrets.values(text)
    x = text[slice(*span)]
    assert abs(secrets.features(text, *span, "")[4] - -sum(k / len(x) * np.log2(k / len(x)) for k in Counter(x).values())) < 1e-9 and time.time() - began < 10


def test_scan_of_a_long_text(spark):
    key = "ghp_" + "a1B2" * 9
    text = "token:" * 20_000 + f'\napi_key = "{key}"\n' + "token:" * 20_000
    got = secrets.scan(spark.createDataFrame([(1, text, "")], "doc_id long, text string, source string")).collect()
    assert [r.secret for r in got if r.is_secret and r.secret == key] == [key] and len(got) == 3




@pytest.mark.parametrize("sent", [warc.SENT, 0])
def test_record_ids_over_tasks(spark, sent):
    """Repeated pages, equal ones too, in four tasks: no id twice, and each revisit names one response of its payload."""
    rows = [(i % 7, f"http://h/{i % 3}", f"payload {i % 5}") for i in range(120)] + [(None, "u", "payload 1")] * 6 + [(3, "u", None)] * 5 + [(100 + i, "u", "payload 2") for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    path = f"{warc.new_path(spark, 'pages')}"
    pages.write.parquet(path)
    pages = spark.read.parquet(path)
    found = []
    for row in warc.write_archives(pages, sent=sent).collect():
        with open(row.path.removeprefix("file://"), "rb") as file:
            found += [warc.parse_record(m)[0] for m in warc.read_members(file)]
    ids = [r["warc-record-id"] for r in found]
    assert len(found) == len(rows) and len(set(ids)) == len(ids)
    responses = {r["warc-record-id"]: r for r in found if r["warc-type"] == "response"}
    revisits = [r for r in found if r["warc-type"] == "revisit"]
    assert revisits
    for r in revisits:
        to = responses[r["warc-refers-to"]]
        assert to["warc-payload-digest"] == r["warc-payload-digest"] and to["x-page-id"] == r["x-refers-to-page-id"]


def test_read_back(spark):
    """A row for each page, whatever repeats."""
    rows = [(1, "u", "<p>"), (1, "u", "<p>"), (1, "u", "<q>"), (2, "u", "<p>"), (None, "u", "<q>")]
    path = f"{warc.new_path(spark, 'pages')}"
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(path)
    got = Counter((r.page_id, r.record_type, r.refers_to) for r in warc.archive_and_read(spark.read.parquet(path)).collect())
    assert got == {(1, "response", None): 3, (2, "revisit", 1): 1, (None, "revisit", 1): 1}
    assert re.fullmatch("<urn:uuid:[0-9a-f-]{36}>", warc.record_id(None, "x", "y"))
