"""Runs: faults of records, interrupted runs, shards, exports, and the commands for them."""

import json

import pytest
from pyspark.sql import functions as F

from chromaspan import cli
from chromaspan.plans import dependency as D
from chromaspan.plans import orbit as O
from chromaspan.plans import records as R

SCHEMA = "graph_id long, n int, edges array<struct<u:int,v:int>>"
C4 = [(0, 1), (0, 3), (1, 2), (2, 3)]


@pytest.fixture(scope="module")
def record(spark):
    rows = spark.createDataFrame([(0, 4, C4)], SCHEMA)
    return json.loads(R.records(rows, None, "0" * 64).first().document)


def faults(spark, *documents):
    lines = spark.createDataFrame([(x if isinstance(x, str) else R.canonical(x),) for x in documents], "document string")
    return sorted({r.fault for r in R.record_faults(lines).collect()})


def changed(record, path, value):
    made = json.loads(json.dumps(record))
    at = made
    for k in path[:-1]:
        at = at[k]
    at[path[-1]] = value
    return made


def test_a_sound_record_has_no_faults(spark, record):
    assert faults(spark, record) == [] and record["partition_count"] == 2


@pytest.mark.parametrize(("path", "value", "fault"), [
    (["order"], 5, "graph"), (["size"], 3, "graph"), (["graph_fingerprint"], "0" * 64, "graph"), (["degree_parameter"], 3, "graph"), (["schema_version"], "x", "schema_version"), (["partition_count"], 1, "partition_count"),
    (["status"], "candidate_unsat", "status"), (["outcome_code"], "x", "status"), (["partitions", 0, "index"], 1, "partition_order"), (["partitions", 0, "pairs"], [[0, 1]], "partition"), (["partitions", 0, "singletons"], [0, 1], "partition"),
    (["partitions", 1, "partition_fingerprint"], "0" * 64, "partition"), (["partitions", 0, "checks", 0, "witness"], None, "check"), (["partitions", 0, "checks", 0, "witness", 0], 1, "check"), (["partitions", 0, "checks", 0, "color_count"], 9, "check"),
    (["partitions", 0, "checks", 1, "status"], "candidate_unsat", "check"), (["graph6"], "C~", "graph"), (["graph6"], "zz", "unreadable"),
])
def test_every_damage_is_a_fault(spark, record, path, value, fault):
    assert fault in faults(spark, changed(record, path, value))


def test_other_damage(spark, record):
    text = R.canonical(record)
    assert faults(spark, text + " ") == faults(spark, "{}") == faults(spark, "nothing") == ["unreadable"]
    one = json.loads(text)
    one["partitions"] = one["partitions"][:1]
    one["partition_count"] = 1
    assert faults(spark, one) == []
    lines = spark.createDataFrame([(R.canonical(one),), (text,)], "document string")
    assert [(r.listed, r.counted) for r in R.missing_partitions(lines, 4).collect()] == [(1, 2)]
    assert [r.document for r in R.rebuilt(lines.where(F.col("document") != text), "0" * 64).collect()] == [text]


def test_digests_tell_runs_apart(spark):
    one = lambda *x: R._digest(spark.createDataFrame([(t,) for t in x], "document string"))
    assert one("a", "b") == one("b", "a") and len({one("a"), one("a", "a"), one("a", "a", "a"), one("a", "b"), one("ab"), one("b")}) == 6


def test_interrupted_runs_go_on(spark, tmp_path):
    rows = spark.createDataFrame([(i, 4, C4) for i in range(9)], SCHEMA)
    config, source, folder = {"order": 4}, {"name": "x"}, f"file://{tmp_path}/run"
    R.records(rows.where("graph_id < 4"), None, R.identity(config, source)).select("document").write.text(f"{folder}/records")
    manifest = R.run_census(rows, folder, config, source, waves=3)
    assert manifest["totals"]["records"] == 9 and R.replay(spark, folder, R.records(rows, None, R.identity(config, source))) == []
    assert R.run_census(rows, folder, config, source) == manifest
    (tmp_path / "run" / "completion.json").unlink()
    assert R.replay(spark, folder) == ["incomplete"]
    assert R.run_census(rows, folder, config, source) == manifest and R.replay(spark, folder) == []
    with pytest.raises(ValueError):
        R.run_census(rows, folder, {"order": 5}, source)
    other = f"file://{tmp_path}/other"
    R.records(rows, None, "1" * 64).select("document").write.text(f"{other}/records")
    with pytest.raises(ValueError):
        R.run_census(rows, other, config, source)


def test_sums_of_shards():
    part = {"partitions": 2, "records": 3, "statuses": {"verified_all": 2, "candidate_unsat": 0, "unknown": 0, "error": 0, "skipped": 1}}
    assert R.reduced([part, part], {"records": 6, "verified_all": 4})["partitions"] == 4
    for bad in ([part, part | {"records": 4}], [part | {"statuses": part["statuses"] | {"unknown": 1}, "records": 4}], [part | {"statuses": {}}], [part | {"records": True}]):
        with pytest.raises(ValueError):
            R.reduced(bad)
    with pytest.raises(ValueError):
        R.reduced([part], {"records": 4})


def run(spark, capsys, *a):
    code = cli.main([str(x) for x in a], spark)
    return code, json.loads(capsys.readouterr().out.strip().split("\n")[-1])


def test_shards_and_exports(spark, tmp_path, capsys):
    folders = []
    for i in range(3):
        folders += ["--run", f"file://{tmp_path}/shard{i}"]
        code, out = run(spark, capsys, "universal-census", "--order", 4, "--output", folders[-1], "--shard-index", i, "--shard-count", 3, "--check", "dsatur:1", "--check", "static:1")
        assert code == 0
    code, out = run(spark, capsys, "universal-validate-shards", *folders)
    assert code == 0 and out["totals"]["records"] == 11 and out["audit"]["direct_rows"] == 11
    assert run(spark, capsys, "universal-validate-shards", *folders[:4])[0] == 2
    assert run(spark, capsys, "universal-validate-shards", *folders, "--run", folders[1])[0] == 2
    assert run(spark, capsys, "universal-validate-shards", *folders, "--max-union-graphs", 10)[0] == 2
    whole = []
    for order in (3, 4):
        whole += ["--run", f"file://{tmp_path}/order{order}"]
        assert run(spark, capsys, "universal-census", "--order", order, "--output", whole[-1], "--connected", "--min-degree", 1)[0] == 0
    told = {"--summary-id": "s-1", "--created-utc": "2024-01-31T00:00:00Z", "--release-version": "1.0.0", "--code-commit": "a" * 40, "--external-name": "archives/a.tar.gz", "--external-url": "https://a.example/a.tar.gz"}
    words = lambda name, **change: [*whole, "--bundle", tmp_path / name, "--archive", tmp_path / f"{name}.tar.gz", *[x for k, v in (told | {f"--{k.replace('_', '-')}": v for k, v in change.items()}).items() for x in (k, v)]]
    code, document = run(spark, capsys, "universal-export", *words("one"))
    assert code == 0 and document["orders"] == [3, 4]
    archive = (tmp_path / "one.tar.gz").read_bytes()
    assert run(spark, capsys, "universal-export", *words("two"))[0] == 0 and (tmp_path / "two.tar.gz").read_bytes() == archive
    assert run(spark, capsys, "universal-export", *words("one"))[0] == 2
    for change in ({"created_utc": "2024-02-31T00:00:00Z"}, {"release_version": "1.0"}, {"code_commit": "x"}, {"external_url": "http://a.example/x"}, {"external_name": "../x"}):
        assert run(spark, capsys, "universal-export", *words("three", **change))[0] == 2
    assert R.replay_archive(spark, document, archive, f"file://{tmp_path}/again") == []
    assert R.replay_archive(spark, document, archive + b"x", f"file://{tmp_path}/never") == ["archive_sha256"]
    document["runs"][0]["totals"]["records"] += 1
    assert R.replay_archive(spark, document, archive, f"file://{tmp_path}/third") == ["order-3: differs from the document"]


def test_options_that_go_together(spark, tmp_path, capsys):
    assert run(spark, capsys, "universal-census", "--order", 4, "--output", f"file://{tmp_path}/x", "--shard-index", 0)[0] == 2
    assert run(spark, capsys, "universal-census", "--order", 4, "--output", f"file://{tmp_path}/x", "--split-depth", 1)[0] == 2
    for words in (["--check", "dsatur"], ["--check", "none:1"], ["--max-nodes", "0"]):
        with pytest.raises(SystemExit):
            cli.main(["universal-census", "--order", "4", "--output", "x", *words], spark)


def test_certificates_by_command(spark, tmp_path, capsys):
    graph, certificate = tmp_path / "g", tmp_path / "c.json"
    graph.write_text("A_\n")
    solve = ["solve", "--graph", graph, "--colors", 3, "--certificate-out", certificate]
    code, out = run(spark, capsys, *solve)
    assert code == 0 and len(out["certificate_fingerprint"]) == 64
    assert run(spark, capsys, *solve)[0] == 2 and run(spark, capsys, *solve, "--force")[0] == 0
    assert run(spark, capsys, "verify", "--strict", "--graph", graph, "--certificate", certificate)[0] == 0
    certificate.write_text(json.dumps(json.loads(certificate.read_text()) | {"more": 1}))
    assert run(spark, capsys, "verify", "--graph", graph, "--certificate", certificate)[0] == 0
    assert run(spark, capsys, "verify", "--strict", "--graph", graph, "--certificate", certificate)[0] == 2
    graph.write_text("Cl\n")
    code, out = run(spark, capsys, "aux-search", "--graph", graph, "--offset", 1)
    assert code == 0 and out["started"] == 1 and len(out["witness"]["vertex_colors"]) == 4
    assert run(spark, capsys, "aux-search", "--graph", graph, "--offset", 0, "--max-partitions", 1)[0] == 3


def test_dependency_receipts(spark, capsys):
    code, out = run(spark, capsys, "d8-audit", "--profile", "d8-c-frozen-w5")
    assert code == 0 and out["complete"] and out["profiles"][0]["counts"]["minimum_pivot_depth_histogram"] == {"0": 77, "1": 8} and out["profiles"][0]["counts"]["fragile"] == 8
    assert len(run(spark, capsys, "d8-audit", "--list-profiles")[1]["profiles"]) == 7
    for words in (["--profile", "none"], ["--profile", ""], ["--profile", "d8-a-w5", "--profile", "d8-a-w5"]):
        assert run(spark, capsys, "d8-audit", *words)[0] == 2


def test_pivots_are_involutions_and_codes_decode(spark):
    p = D.PROFILES[0]
    rows = D.candidates(spark, p).limit(50)
    cols = range(len(p.indegrees))
    coded = rows.withColumn("code", D.code(p, F.lit(0), [F.lit(c + 1) for c in cols], [F.col(f"s{c}") for c in cols])).withColumn("x", D.decoded(p, F.col("code")))
    assert coded.where("x.root = 0 AND x.targets = array(1, 2, 3, 4) AND x.sources = array(s0, s1, s2, s3)").count() == 50 and coded.select("code").distinct().count() == 50
    starts = rows.limit(8).select(F.array("s0", "s1", "s2", "s3").alias("start"), F.lit(0).alias("root"), F.lit([1, 2, 3, 4]).cast("array<int>").alias("targets"), F.array("s0", "s1", "s2", "s3").alias("sources"))
    found = D.orbits(starts)
    state = lambda r: (r.root, tuple(r.targets), tuple(r.sources))
    by = {}
    for r in found.collect():
        by.setdefault(tuple(r.start), set()).add(state(r))
    # Each state of an orbit leads to all of it.
    again = {}
    each = found.select(F.concat("start", F.array("root"), "targets", "sources").alias("start"), *D.STATE)
    for r in D.orbits(each).collect():
        again.setdefault(tuple(r.start), set()).add(state(r))
    assert len(by) == 8 and all(again[*s, x[0], *x[1], *x[2]] == orbit for s, orbit in by.items() for x in orbit)
    # An orbit's certificate is the least of those of its states alone.
    whole = {tuple(r.start): ([int(m) for m in r.masks.split(",")], r.deficit) for r in D.certificates(found, p).collect()}
    alone = {tuple(r.start): ([int(m) for m in r.masks.split(",")], r.deficit) for r in D.certificates(each, p).collect()}
    assert whole == {s: min(alone[*s, x[0], *x[1], *x[2]] for x in orbit) for s, orbit in by.items()}


def test_generator_s_proposals_and_labels(spark):
    found = O.proposals(O.compatible_states(spark)).withColumn("pattern", O.orbit_pattern(F.col("status"), F.col("moves"))).collect()
    assert len(found) == 8 and {r.pattern for r in found} == {"proposed_release_in_1_moves"} and all(len(r.moves) == r.depth for r in found)
    rows = spark.createDataFrame([("x", []), ("proposed_release", ["0-4", "3-5"]), ("proposed_release", ["0-2", "4-6"]), ("proposed_release", ["3-5", "4-6"]), ("proposed_release", ["0-1", "0-2"]), ("proposed_release", ["3-5"])], "status string, moves array<string>")
    assert [r.p for r in rows.select(O.orbit_pattern(F.col("status"), F.col("moves")).alias("p")).collect()] == [
        "no_release_within_configured_orbit_bound", "alpha_hole_role_then_cross_two_swap_release", "alpha_vertex_role_then_cross_two_swap_release", "cross_role_then_cross_two_swap_release", "other_two_swap_release", "proposed_release_in_1_moves",
    ]
    rows = spark.createDataFrame([([1, 2, 3, 4, 5, 6],), ([1, 2, 4, 3, 6, 5],), ([1, 2, 3, 3, 5, 6],)], "c array<int>")
    assert [r.a for r in rows.select(O.fan_alignment(F.col("c")).alias("a")).collect()] == ["exact_role_alignment", "role_set_alignment", "other"]
    counts = O.run_counters(spark).first()
    assert (counts.alpha_matchings, counts.states, counts.proposed_releases) == (5436, 8, 8) and counts.blocked_choices > 8


def test_generator_and_verifier_share_no_code():
    import ast
    from pathlib import Path

    import chromaspan

    top = Path(chromaspan.__file__).parent / "plans"
    for name, other in (("orbit.py", "paired_hole"), ("paired_hole.py", "orbit")):
        names = [n.module or "" for n in ast.walk(ast.parse((top / name).read_text())) if isinstance(n, ast.ImportFrom)]
        assert other not in names
