"""python -m chromaspan.cli COMMAND: verify, solve, aux-search, aux-check-all, proof-audit, census,
universal-census, universal-validate-shards, universal-export, d8-audit.

Prints canonical JSON.  Exit codes: 0 witness or valid, 1 candidate negative or invalid, 2 error,
3 incomplete.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import certificates
from .functions import graphs as G
from .operators import verify
from .operators.solve import BACKENDS, solve
from .plans import bundle, census, counting, dependency, records
from .sources.universe import GraphUniverse

# Exit codes by status, short names of the kernels.
EXITS = {"witness": 0, "verified_all": 0, "candidate_unsat": 1, "invalid": 1, "error": 2, "unknown": 3}
SHORT = {"dsatur": "dsatur-iterative-v1", "static": "static-order-iterative-v1"} | {k: k for k in BACKENDS}


def _graph(spark: SparkSession, path: str, cap: int = 16 << 20) -> DataFrame:
    """graphs of one row from a JSON or graph6 file, or from standard input for '-'."""
    if path == "-":
        raw = sys.stdin.buffer.read(cap + 1)
    else:
        with open(path, "rb") as file:
            raw = file.read(cap + 1)
    if len(raw) > cap:
        raise ValueError("the input is too large")
    text = raw.decode("utf-8")
    row = spark.createDataFrame([(text,)], "t string")
    read = G.parsed(F.regexp_replace("t", r"\s+$", "")) if text.lstrip().startswith("{") else G.from_graph6(F.col("t"))
    found = row.select(read.alias("g")).where("g IS NOT NULL").select(F.lit(0).cast("long").alias("graph_id"), "g.n", "g.edges").cache()
    if found.isEmpty():
        raise ValueError("no canonical graph")
    return found


def _new_file(path: str, data: bytes, force: bool = False) -> None:
    """A file that is there whole or not at all, and replaces none unless told to."""
    target = Path(path)
    if target.exists() and not force:
        raise FileExistsError(f"{path} exists")
    part = target.with_name(target.name + ".part")
    part.write_bytes(data)
    part.replace(target)


def _solve(spark: SparkSession, a: argparse.Namespace) -> tuple[dict, int]:
    rows = _graph(spark, a.graph)
    problem = rows.select("*", (F.col("n") + F.size("edges")).alias("items"), F.lit(a.colors).alias("colours"), F.lit(a.colors).alias("palette"), G.conflicts(F.col("n"), F.col("edges")).alias("conflicts"), F.array().cast("array<struct<item:int,color:int>>").alias("fixed"))
    found = solve(problem, SHORT[a.backend], a.max_nodes, a.timeout_seconds)
    vertex, edge = F.expr("slice(assignment, 1, n)"), F.expr("slice(assignment, n + 1, size(edges))")
    issues = verify.total_issues(F.col("n"), F.col("edges"), vertex, edge, F.col("palette"))
    r = found.select("status", "nodes", "backtracks", vertex.alias("v"), edge.alias("e"), F.when(F.col("status") == "witness", F.size(issues)).alias("bad"), G.fingerprint(F.col("n"), F.col("edges")).alias("mark")).first()
    status = "error" if r["bad"] else r["status"]
    out = {"status": status, "nodes": r["nodes"], "backtracks": r["backtracks"], "graph_fingerprint": r["mark"], "palette_size": a.colors, "vertex_colors": r["v"], "edge_colors": r["e"]}
    if a.certificate_out and status == "witness":
        made = certificates.make(r["mark"], a.colors, list(r["v"]), list(r["e"]))
        _new_file(a.certificate_out, certificates.text_of(made).encode(), a.force)
        out["certificate_fingerprint"] = certificates.fingerprint(made)
    return out, EXITS[status]


def _verify(spark: SparkSession, a: argparse.Namespace) -> tuple[dict, int]:
    from .functions.strict_json import loads

    text = Path(a.certificate).read_text()
    doc = certificates.parse(text) if a.strict else loads(text)
    ints = lambda x: F.array(*[F.lit(v) for v in x]).cast("array<int>")
    mark = G.fingerprint(F.col("n"), F.col("edges"))
    found = verify.total_issues(F.col("n"), F.col("edges"), ints(doc["vertex_colors"]), ints(doc["edge_colors"]), F.lit(doc["palette_size"]), F.lit(doc["graph_fingerprint"]), mark)
    issues = [i.asDict() for i in _graph(spark, a.graph).select(found.alias("i")).first()["i"]]
    return {"status": "invalid" if issues else "valid", "issues": issues}, int(bool(issues))


def _auxiliary(spark: SparkSession, a: argparse.Namespace, every: bool) -> tuple[dict, int]:
    run = census.check_all if every else census.search
    r = run(_graph(spark, a.graph), a.offset, SHORT[a.backend], a.max_partitions, a.max_nodes, a.timeout_seconds).first()
    out = {k: r[k] for k in ("status", "first_partition", "started", "witnesses", "failures", "unknown", "truncated")}
    if not every and r["witness"] is not None:
        w = r["witness"].asDict(recursive=True)
        out["witness"] = {"pairs": [[e["u"], e["v"]] for e in w["pair_edges"]], "singletons": w["single_vertices"], "auxiliary_edge_colors": w["assignment"], **w["total"]}
    return out, EXITS.get(r["status"], 2)


def _audit(spark: SparkSession, a: argparse.Namespace) -> tuple[dict, int]:
    rows = counting.grid(spark, a.limit)
    first = counting.draft_counterexamples(rows).orderBy("cap_num", "cap_den", "p", "q").first()
    return {"draft_counterexample": first and first.asDict(), "closed": counting.corrected_closure(rows).agg(F.sum("closed").alias("c")).first()["c"]}, int(first is not None)


def _universe(spark: SparkSession, **options) -> DataFrame:
    spark.dataSource.register(GraphUniverse)
    return spark.read.format("graph_universe").options(**{k: str(v).lower() for k, v in options.items() if v is not None}).load()


def _code(totals: dict) -> int:
    s = totals["statuses"]
    return 2 if s["error"] else 1 if s["candidate_unsat"] else 3 if s["unknown"] else 0


def _census(spark: SparkSession, a: argparse.Namespace) -> tuple[dict, int]:
    rows = _universe(spark, order=a.order, shards=a.shards, shard=a.shard)
    config = {"checks": [list(c) for c in census.CHECKS], "order": a.order, "shard": a.shard, "shards": a.shards}
    source = {"name": "graph_universe"}
    manifest = records.publish(records.records(rows, None, records.identity(config, source)), a.out, config, source)
    return manifest["totals"], _code(manifest["totals"])


def _check(text: str) -> tuple[str, int]:
    name, sign, offset = text.partition(":")
    if not sign or SHORT.get(name) is None or not offset.isdecimal():
        raise argparse.ArgumentTypeError("a check is BACKEND:OFFSET")
    return SHORT[name], int(offset)


def _universal(spark: SparkSession, a: argparse.Namespace) -> tuple[dict, int]:
    if (a.shard_index is None) != (a.shard_count is None):
        raise ValueError("--shard-index and --shard-count go together")
    if a.split_depth is not None and a.shard_count is None:
        raise ValueError("--split-depth requires --shard-index and --shard-count")
    wanted = [tuple(c) for c in dict.fromkeys(a.check or census.CHECKS)]
    split = None if a.split_depth is None else max(0, a.order - a.split_depth)
    stream = {"connected": a.connected, "mindegree": a.min_degree, "maxdegree": a.max_degree, "order": a.order, "split": split}
    rows = _universe(spark, **stream, shards=a.shard_count, shard=a.shard_index)
    config = stream | {"checks": [list(c) for c in wanted], "max_nodes": a.max_nodes, "shard": a.shard_index or 0, "shards": a.shard_count or 1}
    manifest = records.run_census(rows, a.output, config, {"name": "graph_universe"}, wanted, a.max_nodes, a.waves)
    return manifest["totals"], _code(manifest["totals"])


def _validate(spark: SparkSession, a: argparse.Namespace) -> tuple[dict, int]:
    import json

    config = json.loads(records._read_text(spark, f"{a.run[0]}/manifest.json") or "{}").get("config")
    if config is None:
        raise ValueError(f"{a.run[0]} isn't a run")
    direct = _universe(spark, **{k: config.get(k) for k in ("order", "connected", "mindegree", "maxdegree")})
    named = direct.select(G.graph6(F.col("n"), F.col("edges")).alias("graph6"))
    return records.shard_union(spark, a.run, named, a.max_union_graphs), 0


def _export(spark: SparkSession, a: argparse.Namespace) -> tuple[dict, int]:
    told = {k: getattr(a, k) for k in ("summary_id", "created_utc", "release_version", "release_status", "code_commit", "external_name", "external_url")}
    document, archive = records.export(spark, a.run, told)
    if Path(a.bundle).exists():
        raise FileExistsError(f"{a.bundle} exists")
    _new_file(a.archive, archive)
    bundle.write(Path(a.bundle), {"summary.json": records.canonical(document).encode()})
    return document, 0


def _dependency(spark: SparkSession, a: argparse.Namespace) -> tuple[dict, int]:
    if a.list_profiles:
        return {"kind": "d8_dependency_pivot_profile_list", "profiles": [dependency.describe(p) for p in dependency.PROFILES], "schema_version": 1}, 0
    if a.profile and (len(set(a.profile)) != len(a.profile) or "" in a.profile):
        raise ValueError("a profile is named twice or by nothing")
    return dependency.receipt(spark, [p.name for p in dependency.PROFILES] if a.suite else a.profile), 0


def _positive(text: str) -> int:
    if not text.isdecimal() or int(text) == 0:
        raise argparse.ArgumentTypeError("a positive integer is needed")
    return int(text)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="chromaspan")
    sub = top.add_subparsers(dest="command", required=True)

    def limits(p: argparse.ArgumentParser) -> None:
        p.add_argument("--max-nodes", type=_positive)
        p.add_argument("--timeout-seconds", type=float)

    def command(name: str, graph: bool = True) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        if graph:
            p.add_argument("--graph", required=True)
            p.add_argument("--backend", choices=sorted(SHORT), default="dsatur")
            limits(p)
        return p

    v = command("verify")
    v.add_argument("--certificate", required=True)
    v.add_argument("--strict", action="store_true", help="the certificate must be exactly a document of its schema")
    s = command("solve")
    s.add_argument("--colors", type=int, required=True)
    s.add_argument("--certificate-out")
    s.add_argument("--force", action="store_true")
    for name in ("aux-search", "aux-check-all"):
        p = command(name)
        p.add_argument("--offset", type=int, default=2)
        p.add_argument("--max-partitions", type=_positive)
    command("proof-audit", False).add_argument("--limit", type=int, default=12)
    c = command("census", False)
    c.add_argument("--order", type=int, required=True)
    c.add_argument("--out", required=True)
    c.add_argument("--shards", type=int, default=1)
    c.add_argument("--shard", type=int, default=0)
    u = command("universal-census", False)
    u.add_argument("--order", type=int, required=True)
    u.add_argument("--output", required=True)
    u.add_argument("--connected", action="store_true")
    for name in ("--min-degree", "--max-degree", "--shard-index", "--shard-count", "--split-depth"):
        u.add_argument(name, type=int)
    u.add_argument("--check", action="append", type=_check, help="BACKEND:OFFSET, repeatable")
    u.add_argument("--waves", type=_positive, default=1, help="parts of the run that are written one after another")
    u.add_argument("--max-nodes", type=_positive)
    w = command("universal-validate-shards", False)
    w.add_argument("--run", action="append", required=True)
    w.add_argument("--max-union-graphs", type=_positive, default=10_000_000)
    e = command("universal-export", False)
    e.add_argument("--run", action="append", required=True)
    for name in ("--bundle", "--archive", "--summary-id", "--created-utc", "--release-version", "--code-commit", "--external-name", "--external-url"):
        e.add_argument(name, required=True)
    e.add_argument("--release-status", choices=("candidate", "published"), default="candidate")
    d = command("d8-audit", False).add_mutually_exclusive_group(required=True)
    d.add_argument("--suite", action="store_true")
    d.add_argument("--list-profiles", action="store_true")
    d.add_argument("--profile", action="append")
    return top


RUN = {
    "verify": _verify, "solve": _solve, "aux-search": lambda s, x: _auxiliary(s, x, False), "aux-check-all": lambda s, x: _auxiliary(s, x, True), "proof-audit": _audit, "census": _census,
    "universal-census": _universal, "universal-validate-shards": _validate, "universal-export": _export, "d8-audit": _dependency,
}


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    try:
        out, code = RUN[a.command](spark, a)
    except (ValueError, OSError, KeyError, PySparkException) as e:
        out, code = {"error": str(e)}, 2
    print(records.canonical(out))
    return code


if __name__ == "__main__":
    sys.exit(main())
