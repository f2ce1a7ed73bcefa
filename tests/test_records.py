"""Records, replay, the command line, and the transfer formula's witnesses against brute force."""

import json
from itertools import combinations, product
from pathlib import Path

import pytest

from chromaspan import cli
from chromaspan.plans import records as R
from chromaspan.plans import transfer as X
from chromaspan.queries import _model

SCHEMA = "graph_id long, n int, edges array<struct<u:int,v:int>>"
C4 = [(0, 1), (0, 3), (1, 2), (2, 3)]


def test_publish_and_replay(spark, tmp_path):
    rows = spark.createDataFrame([(0, 4, C4), (1, 4, [(0, 1)])], SCHEMA)
    config, source = {"order": 4}, {"name": "x"}
    lines = R.records(rows, 2, R.identity(config, source))
    folder = f"file://{tmp_path}/run"
    manifest = R.publish(lines, folder, config, source)
    assert manifest["totals"] == {"partitions": 2, "records": 2, "statuses": {"verified_all": 1, "candidate_unsat": 0, "unknown": 0, "error": 0, "skipped": 1}}
    for line in (r.document for r in lines.collect()):
        assert line == R.canonical(json.loads(line))
    assert R.replay(spark, folder, lines) == []
    assert "records_differ" in R.replay(spark, folder, R.records(rows.where("graph_id = 0"), 2, R.identity(config, source)))
    with pytest.raises(Exception):  # noqa: B017  published runs aren't overwritten
        R.publish(lines, folder, config, source)
    summary = R.summary([manifest])
    assert (summary["partitions"], summary["verified"], summary["orders"]) == (2, 1, [4])
    with pytest.raises(ValueError):
        R.summary([manifest, manifest])
    bad = json.loads(json.dumps(manifest))
    bad["totals"]["statuses"]["unknown"] = 1
    with pytest.raises(ValueError):
        R.summary([bad])
    part = next(p for p in Path(f"{tmp_path}/run/records").glob("part-*") if p.stat().st_size)
    for crc in part.parent.glob(".*.crc"):
        crc.unlink()
    part.write_text(part.read_text().replace("verified_all", "verified_al1", 1).replace("skipped", "skippe1", 1))
    assert "records_digest" in R.replay(spark, folder)
    Path(f"{tmp_path}/run/completion.json").unlink()
    assert R.replay(spark, folder) == ["incomplete"]


def test_command_line(spark, tmp_path, capsys):
    graph = tmp_path / "g"
    graph.write_text("A_\n")
    run = lambda *a: (cli.main(list(a), spark), json.loads(capsys.readouterr().out.strip().split("\n")[-1]))
    code, out = run("solve", "--graph", str(graph), "--colors", "3")
    assert code == 0 and out["status"] == "witness"
    certificate = tmp_path / "c.json"
    certificate.write_text(json.dumps(out))
    assert run("verify", "--graph", str(graph), "--certificate", str(certificate)) == (0, {"status": "valid", "issues": []})
    certificate.write_text(json.dumps(out | {"edge_colors": [out["vertex_colors"][0]]}))
    assert run("verify", "--graph", str(graph), "--certificate", str(certificate))[0] == 1
    assert run("solve", "--graph", str(graph), "--colors", "2")[0] == 1
    assert run("solve", "--graph", str(graph), "--colors", "3", "--max-nodes", "1")[0] == 3
    graph.write_text("A__")
    assert run("solve", "--graph", str(graph), "--colors", "3")[0] == 2
    graph.write_text('{"edges":[[0,1],[0,3],[1,2],[2,3]],"order":4,"schema_version":"total-coloring.simple-graph.v1"}\n')
    assert run("aux-check-all", "--graph", str(graph))[1]["witnesses"] == 2
    assert run("aux-search", "--graph", str(graph), "--offset", "0")[0] == 1
    code, out = run("proof-audit", "--limit", "3")
    assert code == 1 and out["draft_counterexample"] is not None
    code, out = run("census", "--order", "4", "--out", f"file://{tmp_path}/census")
    assert code == 0 and out["records"] == 11 and out["statuses"]["verified_all"] == 8 and out["partitions"] == 16


def test_endpoint_witnesses(spark):
    rows, factors = _model(spark)
    held = {(r.f, r.h) for r in rows.collect()}
    edges = {}
    for r in factors.collect():
        edges.setdefault(r.f, []).append((r.a, r.b))
    ways = lambda e: [(e[0], e[1])] + ([(e[1], e[0])] if e[1] < 6 else [])
    want = set()
    for fs in combinations(range(6), 3):
        for es in product(*(edges[f] for f in fs)):
            if len({v for e in es for v in e}) < 6:
                continue
            for o in product(*(ways(e) for e in es)):
                heads, tails = [h for h, _ in o], [t for _, t in o]
                rest = set(range(6)) - set(heads)
                for spare in rest - set(tails):
                    if len([x for x in rest - {spare} if x < 3]) != 1:
                        continue
                    bad = [f for f, h in zip(fs, heads, strict=True) if (f, h) not in held]
                    if not bad:
                        want.add(("Q0", fs, tuple(heads), tuple(tails), spare))
                    elif len(bad) == 1 and (bad[0], spare) in held and bad[0] + 6 not in tails:
                        old = any((f, h) in held and t >= 6 for f, h, t in zip(fs, heads, tails, strict=True))
                        want.add(("Q1_old_outside" if old else "Q1_new_outside_only", fs, tuple(heads), tuple(tails), spare))
    got = {(r.kind, (r.f1, r.f2, r.f3), (r.head1, r.head2, r.head3), (r.tail1, r.tail2, r.tail3), r.spare) for r in X.endpoint_witnesses(rows, factors).collect()}
    assert got == want and len(want) > 100


def test_model_faults(spark):
    rows, factors = _model(spark)
    assert {r.fault for r in X.faults(rows, factors).collect()} <= {"column_size", "edge_of_complement"}
    twice = factors.union(spark.createDataFrame([(0, 0, 20)], "f int, a int, b int"))
    assert "vertex_used_twice" in {r.fault for r in X.faults(rows, twice).collect()}


def test_known_counterexample(spark):
    from chromaspan.plans import counting

    found = counting.draft_counterexamples(counting.grid(spark)).where("p = 1 AND q = 1 AND cap_num = 2 AND cap_den = 1")
    assert found.count() == 1


def test_bundles(spark, tmp_path):
    from chromaspan.plans import bundle as B

    files = {"records/a.jsonl": b"{}\n", "manifest.json": b"{}"}
    archive = B.archive(files)
    assert archive == B.archive(dict(reversed(files.items()))) and B.unpack(archive) == files
    for damage in (archive[:-1], archive + b"x", archive[:40] + bytes([archive[40] ^ 1]) + archive[41:]):
        with pytest.raises(B.BundleError):
            B.unpack(damage)
    with pytest.raises(B.BundleError):
        B.archive({"../x": b""})
    top = tmp_path / "b"
    B.write(top, files)
    assert B.inspect(spark, str(top)) == []
    (top / "manifest.json").write_bytes(b"{ }")
    (top / "more").write_bytes(b"")
    (top / "records/a.jsonl").unlink()
    assert B.inspect(spark, str(top)) == [("changed", "manifest.json"), ("missing", "records/a.jsonl"), ("unlisted", "more")]
    assert B.transition(None, "1.0.0", False) is None and B.transition("1.0.0", "1.0.1", False) is None
    assert B.transition("1.1.0", "1.0.1", False) == "downgrade" and B.transition("1.0.0", "1.0.0", True) == "published is immutable"
    assert B.transition("1.0.0-2", "1.0.0-10", True) is None and B.transition("1.0", "1.0.0", False) == "not a version"


def test_schemas():
    from chromaspan.functions.schema import violations

    schema = {
        "type": "object", "required": ["a"], "additionalProperties": False,
        "properties": {"a": {"type": "integer", "minimum": 1}, "b": {"type": "array", "items": {"enum": [1, "x", None]}, "uniqueItems": True, "maxItems": 3}, "c": {"$ref": "#/$defs/t"}},
        "$defs": {"t": {"anyOf": [{"const": True}, {"type": "string", "pattern": "^z", "minLength": 2}]}},
    }
    assert violations(schema, {"a": 1, "b": [1, "x", None], "c": "zz"}) == []
    bad = {"$": [], "$.a": {"a": 0}, "$.b[0]": {"a": 1, "b": [True]}, "$.b": {"a": 1, "b": [1, 1]}, "$.c": {"a": 1, "c": "z"}, "$.d": {"a": 1, "d": 1}}
    for path, value in bad.items():
        assert [p for p, _ in violations(schema, value)] == [path]
    assert violations(schema, {"a": True})[0][0] == "$.a" and violations({"const": 1}, 1.0) and violations({"enum": [0]}, False)
    with pytest.raises(ValueError):
        violations({"oddword": 1}, 1)
    assert len(violations({"items": {"type": "string"}}, list(range(500)))) == 100
