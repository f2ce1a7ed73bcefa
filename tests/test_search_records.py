"""Records of searches, held against their own text after damage to one field at a time."""

import hashlib
import json
import random

import pytest

from chromaspan.plans import search_records as S

SCHEMA = "graph_id long, n int, edges array<struct<u:int,v:int>>"


@pytest.fixture(scope="module")
def documents(spark):
    rng = random.Random(3)
    pairs = [(u, v) for u in range(6) for v in range(u + 1, 6)]
    rows = [(i, 6, sorted(rng.sample(pairs, rng.randint(4, 15)))) for i in range(30)]
    rows += [(100, 6, pairs), (101, 6, [(0, 1)]), (102, 4, [(0, 1), (0, 3), (1, 2), (2, 3)])]
    df = spark.createDataFrame(rows, SCHEMA)
    return {o: [json.loads(r.document) for r in S.records(df, "run", o).orderBy("graph_id").collect()] for o in (0, 2)}


def text(record):
    return json.dumps(record, sort_keys=True, separators=(",", ":"))


def faults(spark, *texts):
    df = spark.createDataFrame([(t,) for t in texts], "document string")
    return sorted(((r["index"], r.fault) for r in S.faults(df).collect()), key=str)


def test_records_are_canonical_and_sound(spark, documents):
    for offset, records in documents.items():
        assert faults(spark, *map(text, records)) == [] and len(records) == 33
        assert {r["palette_offset"] for r in records} == {offset} and all((r["witness"] is not None) == (r["status"] == "witness") for r in records)
    assert {r["status"] for r in documents[0]} == {"witness", "candidate_unsat", "skipped"}
    assert {r["status"] for r in documents[2]} == {"witness", "skipped"}


def test_certificates(documents):
    """What a certificate says is a total colouring, by a look at every pair of neighbours."""
    for r in documents[0]:
        if r["witness"]:
            c, n = r["witness"]["certificate"], r["order"]
            bits = [int(b) for ch in r["graph6"][1:] for b in f"{ord(ch) - 63:06b}"]
            edges = sorted((u, v) for k, (u, v) in enumerate((u, v) for v in range(n) for u in range(v)) if bits[k])
            v, e = c["vertex_colors"], dict(zip(edges, c["edge_colors"], strict=True))
            assert all(v[a] != v[b] and e[a, b] not in (v[a], v[b]) for a, b in edges)
            assert all(e[x] != e[y] for x in edges for y in edges if x < y and set(x) & set(y))
            assert max(v + c["edge_colors"]) < c["palette_size"] and r["witness"]["certificate_sha256"] == hashlib.sha256(text(c).encode()).hexdigest()


def bound(record, **changes):
    """A record whose certificate is changed and has the digest that goes with it."""
    c = record["witness"]["certificate"] | changes
    return record | {"witness": record["witness"] | {"certificate": c, "certificate_sha256": hashlib.sha256(text(c).encode()).hexdigest()}}


def inner(record, **changes):
    return record | {"witness": record["witness"] | changes}


def test_damage(spark, documents):
    good = [r for r in documents[0] if r["status"] == "witness" and r["witness"]["pairs"] and r["witness"]["singletons"]]
    a, b = good[0], next(r for r in good if r["graph6"] != good[0]["graph6"])
    w, c = a["witness"], a["witness"]["certificate"]
    cases = [
        (a | {"order": 7}, {"graph"}), (a | {"graph6": b["graph6"]}, None), (a | {"graph_fingerprint": b["graph_fingerprint"]}, {"graph"}), (a | {"schema_version": "v0"}, {"version"}), (a | {"status": "unknown"}, {"status"}), (a | {"status": "perhaps"}, {"status"}),
        (a | {"witness": None}, {"status"}), (a | {"started": 0}, {"status", "partition"}), (inner(a, pairs=w["pairs"][::-1] + [[0, 1]]), {"partition"}), (inner(a, pairs=[]), {"partition"}), (inner(a, pairs=None), {"partition"}), (inner(a, singletons=w["singletons"][:-1]), {"partition"}),
        (inner(a, partition_fingerprint="0"), {"partition"}), (inner(a, partition_index=w["partition_index"] + 1), {"partition"}), (inner(a, assignment=w["assignment"][:-1]), None), (inner(a, assignment=[x + 9 for x in w["assignment"]]), {"assignment", "certificate"}), (inner(a, assignment=None), {"assignment", "certificate"}),
        (inner(a, certificate_sha256="0"), {"certificate"}), (bound(a, palette_size=c["palette_size"] + 1), {"certificate"}), (bound(a, graph_fingerprint=b["graph_fingerprint"]), {"certificate"}), (bound(a, vertex_colors=[0] * len(c["vertex_colors"])), {"certificate"}), (bound(a, edge_colors=[]), {"certificate"}),
        (a | {"palette_offset": 1}, {"certificate"}), (a | {"graph6": "?"}, None),
    ]
    for k, (record, want) in enumerate(cases):
        got = faults(spark, text(record))
        assert got and {i for i, _ in got} == {a["index"]}, k
        assert want is None or {f for _, f in got} == want, (k, got)


def test_texts_that_are_no_records(spark, documents):
    good = text(documents[0][0])
    bad = [None, "", "{", "[]", "null", good + " ", good.replace(":", ": ", 1), good.replace('"order"', '"orders"'), good[:-1] + ',"z":1}', '{"index":5}']
    got = faults(spark, *[x for x in bad if x is not None])
    assert len(got) == len(bad) - 1 and {f for _, f in got} == {"unreadable"}
    df = spark.createDataFrame([(None,)], "document string")
    assert [r.fault for r in S.faults(df).collect()] == ["unreadable"]
    assert S.faults(df.limit(0)).count() == 0
