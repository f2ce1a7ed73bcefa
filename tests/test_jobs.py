"""The jobs: reruns, growing input, runs that break off, and the command line."""

import hashlib
import json
import logging
import os
import shutil
import subprocess
import sys
from collections import defaultdict

import pytest

from jobs import census, common, lines
from jobs.registered import JOB_SQL, JOBS
from tests.conftest import same_rows

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", sorted(JOBS))
def test_registered(spark, duck, name):
    same_rows(JOBS[name](spark, SF), duck.sql(JOB_SQL[name]))


def rows_of(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_census_runs_again(spark, tmp_path, caplog):
    """A second run with other settings replaces the first one's rows; the same settings give the same rows."""
    out = str(tmp_path / "out")
    small = census.SETTINGS | {"checks": [["dsatur-iterative-v1", 1]], "shards": 3}
    found = []
    with caplog.at_level(logging.INFO, "jobs"):
        for settings in (small, census.SETTINGS, small):
            census.run(spark, f"{SF}/lineitem.parquet", out, settings)
            found.append({t: rows_of(common.read_back(spark, f"{out}/{t}", s)) for t, s in (("graphs", census.GRAPHS), ("records", census.RECORDS), ("summary", census.SUMMARY))})
    assert found[0] == found[2] and found[0]["records"] != found[1]["records"] and len(found[0]["graphs"]) == 375
    assert sorted(p for p in os.listdir(f"{out}/graphs") if "=" in p) == ["shard=0", "shard=1", "shard=2"]
    assert "reading 6000 rows" in caplog.text and "375 graphs, 375 records" in caplog.text


def test_census_with_proofs(spark, tmp_path, caplog):
    """With the tightest palette some graphs aren't verified: each partition that a check found none for has an accepted proof."""
    source, out = str(tmp_path / "some.parquet"), str(tmp_path / "out")
    spark.read.parquet(f"{SF}/lineitem.parquet").where("l_orderkey < 160").write.parquet(source)
    settings = census.SETTINGS | {"checks": [["dsatur-iterative-v1", 0]]}
    found = []
    with caplog.at_level(logging.INFO, "jobs"):
        for _ in range(2):
            census.run(spark, source, out, settings)
            found.append([rows_of(common.read_back(spark, f"{out}/{t}", s)) for t, s in (("proofs", census.PROOFS), ("verdicts", census.VERDICTS))])
    assert found[0] == found[1]
    records = common.read_back(spark, f"{out}/records", census.RECORDS)
    failed = records.where("status = 'candidate_unsat'").groupBy("class_id").agg({"checks": "max", "witnesses": "max"}).collect()
    verdicts = common.read_back(spark, f"{out}/verdicts", census.VERDICTS).collect()
    by = defaultdict(int)
    for r in verdicts:
        by[r.class_id] += 1
    assert failed and dict(by) == {r.class_id: r["max(checks)"] - r["max(witnesses)"] for r in failed} and {r.status for r in verdicts} == {"accepted"}
    proofs = common.read_back(spark, f"{out}/proofs", census.PROOFS).collect()
    assert len(proofs) == sum(r.steps for r in verdicts) and sum(r.clause == "0" for r in proofs) == len(verdicts)
    assert f"{len(verdicts)} proofs accepted, 0 partitions without one" in caplog.text


def test_census_of_nothing(spark, tmp_path):
    source = str(tmp_path / "none.parquet")
    spark.read.parquet(f"{SF}/lineitem.parquet").limit(0).write.parquet(source)
    census.run(spark, source, str(tmp_path / "out"))
    summary = common.read_back(spark, f"{tmp_path}/out/summary", census.SUMMARY).collect()
    assert len(summary) == 5 and {r.graphs for r in summary} == {0}


def test_census_notices_lost_records(spark, tmp_path, monkeypatch):
    whole = census.census.by_class
    monkeypatch.setattr(census.census, "by_class", lambda *a: whole(*a).where("graph_id <> 7"))
    with pytest.raises(RuntimeError, match="'missing': 1"):
        census.run(spark, f"{SF}/lineitem.parquet", str(tmp_path / "out"))


def brute(docs, order=8, least=4):
    """{(lang, size, graph6): (fingerprint, max degree, lines, first doc)} line by line."""
    counts = defaultdict(lambda: [0, None])
    for doc, text, lang in docs:
        lang = (lang or "").strip(" ") or "und"
        for line in (text or "").split("\n") if text is not None else []:
            v = [len(w) % order for w in line.replace("\t", " ").replace("\r", " ").split(" ") if w]
            edges = tuple(sorted({(min(a, b), max(a, b)) for a, b in zip(v, v[1:], strict=False) if a != b}))
            if len(v) >= least and edges:
                at = counts[lang, edges]
                at[0] += 1
                at[1] = doc if at[1] is None else min(at[1], doc) if doc is not None else at[1]
    out = {}
    for (lang, edges), (n, first) in counts.items():
        bits = [int((u, v) in edges) for v in range(order) for u in range(v)]
        bits += [0] * (-len(bits) % 6)
        text = chr(63 + order) + "".join(chr(63 + int("".join(map(str, bits[i : i + 6])), 2)) for i in range(0, len(bits), 6))
        document = json.dumps({"edges": edges, "order": order, "schema_version": "total-coloring.simple-graph.v1"}, separators=(",", ":"))
        out[lang, text] = (hashlib.sha256(document.encode()).hexdigest(), len(edges), max(sum(x in e for e in edges) for x in range(order)), n, first)
    return out


def catalogue(spark, out):
    return {(r.lang, r.graph6): (r.fingerprint, r["size"], r.max_degree, r.lines, r.first_doc) for r in lines.read(spark, out).collect()}


ODD = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "one three\tfive  seven\r\nno", None, "a", 0), (4, "one three five seven", "", "a", 0), (None, "a bb ccc dddd\na bb ccc dddd", "x/y z", "a", 0),
    (5, "a bb ccc dddd", "x/y z", "a", 0), (5, "a bb ccc dddd", "x/y z", "a", 0), (6, "aa bb cc dd ee", "en", "a", 0), (7, "a ünï " * 30_000, "en", "a", 0), (8, "a bb ccc", "en", "a", 0),
]


def test_growing_input(spark, tmp_path, caplog):
    """Each run takes the files that are new; all runs together give what one run over all files gives."""
    table = spark.read.schema(SCHEMA).parquet(f"{SF}/documents.parquet")
    source, out, state = str(tmp_path / "documents.parquet"), str(tmp_path / "out"), str(tmp_path / "state")
    parts = [table.where("doc_id % 3 = 0"), table.where("doc_id % 3 = 1"), spark.createDataFrame(ODD, SCHEMA), table.where("doc_id % 3 = 2")]
    seen = []
    for i, part in enumerate(parts):
        part.coalesce(2).write.mode("append").parquet(source)
        seen += [(r.doc_id, r.text, r.lang) for r in part.collect()]
        caplog.clear()
        with caplog.at_level(logging.INFO, "jobs"):
            lines.run(spark, source, out, state, lines.SETTINGS | {"files": 1 if i == 3 else 0})
        assert f"read {part.count()} new rows" in caplog.text
        assert catalogue(spark, out) == brute(seen)
    before = {p: os.stat(p).st_mtime_ns for d, _, f in os.walk(out) for p in (os.path.join(d, x) for x in f) if p.endswith(".parquet")}
    with caplog.at_level(logging.INFO, "jobs"):
        lines.run(spark, source, out, state)
    assert "read 0 new rows" in caplog.text and "nothing new" in caplog.text
    # A run without news leaves the files alone.
    assert before == {p: os.stat(p).st_mtime_ns for d, _, f in os.walk(out) for p in (os.path.join(d, x) for x in f) if p.endswith(".parquet")}
    lines.run(spark, source, str(tmp_path / "whole"), str(tmp_path / "whole-state"))
    assert catalogue(spark, str(tmp_path / "whole")) == catalogue(spark, out)


def test_runs_that_break_off(spark, tmp_path, monkeypatch):
    table = spark.read.schema(SCHEMA).parquet(f"{SF}/documents.parquet")
    source, out, state = str(tmp_path / "docs"), str(tmp_path / "out"), str(tmp_path / "state")
    table.where("doc_id < 90").coalesce(1).write.parquet(source)
    want = brute([(r.doc_id, r.text, r.lang) for r in table.where("doc_id < 90").collect()])

    def broken(counts):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:  # after the batch, before its languages are written
        m.setattr(lines, "catalogue", broken)
        with pytest.raises(RuntimeError, match="lost"):
            lines.run(spark, source, out, state)
    lines.run(spark, source, out, state)
    assert catalogue(spark, out) == want
    # A batch that was written but not committed is tried again and replaces its counts.
    table.where("doc_id >= 90").coalesce(1).write.mode("append").parquet(source)
    lines.run(spark, source, out, state)
    for name in ("1", ".1.crc"):
        os.remove(f"{state}/stream/commits/{name}")
    for d, folders, _ in os.walk(f"{state}/sums"):
        for f in folders:
            if f == "upto=1":
                shutil.rmtree(f"{d}/{f}")
    lines.run(spark, source, out, state)
    assert catalogue(spark, out) == brute([(r.doc_id, r.text, r.lang) for r in table.collect()])


def test_counts_that_were_summed_up_are_not_read_again(spark, tmp_path):
    table = spark.read.schema(SCHEMA).parquet(f"{SF}/documents.parquet")
    source, out, state = str(tmp_path / "docs"), str(tmp_path / "out"), str(tmp_path / "state")
    table.where("doc_id % 2 = 0").coalesce(1).write.parquet(source)
    lines.run(spark, source, out, state)
    for d, folders, _ in os.walk(f"{state}/counts"):  # what the first run counted is gone
        for f in folders:
            if f == "batch=0":
                shutil.rmtree(f"{d}/{f}")
    table.where("doc_id % 2 = 1 AND lang <> 'en'").coalesce(1).write.mode("append").parquet(source)
    untouched = {p: os.stat(p).st_mtime_ns for d, _, f in os.walk(f"{out}/catalogue/lang=en") for p in (os.path.join(d, x) for x in f)}
    lines.run(spark, source, out, state)
    assert catalogue(spark, out) == brute([(r.doc_id, r.text, r.lang) for r in table.where("doc_id % 2 = 0 OR lang <> 'en'").collect()])
    assert untouched and untouched == {p: os.stat(p).st_mtime_ns for d, _, f in os.walk(f"{out}/catalogue/lang=en") for p in (os.path.join(d, x) for x in f)}


def test_no_documents(spark, tmp_path):
    source = str(tmp_path / "docs")
    spark.createDataFrame([], SCHEMA).write.parquet(source)
    for _ in range(2):
        lines.run(spark, source, str(tmp_path / "out"), str(tmp_path / "state"))
    assert lines.read(spark, str(tmp_path / "out")).count() == 0


def test_settings(tmp_path):
    file = tmp_path / "c.json"
    file.write_text('{"order": 5}')
    assert common.config_of(str(file), lines.SETTINGS) == {"order": 5, "least": 4, "files": 0}
    file.write_text('{"ordre": 5}')
    with pytest.raises(ValueError, match="unknown settings: ordre"):
        common.config_of(str(file), lines.SETTINGS)
    file.write_text('{"order": "5"}')
    with pytest.raises(ValueError, match="order must be of type int"):
        common.config_of(str(file), lines.SETTINGS)
    for name, known in (("census", census.SETTINGS), ("lines", lines.SETTINGS)):
        assert common.config_of(f"{ROOT}/jobs/{name}.json", known) == known


def test_command_line(spark, tmp_path):
    arguments = ["--documents", f"{SF}/documents.parquet", "--out", str(tmp_path / "out"), "--checkpoint", str(tmp_path / "state"), "--config", "jobs/lines.json"]
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 pyspark-shell"}
    done = subprocess.run([sys.executable, "-m", "jobs.lines", *arguments], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300, check=False)
    assert done.returncode == 0, done.stderr
    assert "read 200 new rows" in done.stderr and "the catalogue has" in done.stderr
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert catalogue(spark, str(tmp_path / "out")) == brute([(r.doc_id, r.text, r.lang) for r in docs])
