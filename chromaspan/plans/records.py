"""Census runs as records: canonical JSON lines, a manifest and a completion mark, and their replay."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import graphs as G
from ..operators import partitions as P
from ..operators import verify as V
from ..operators.solve import spread
from ..sources.families import merged
from ..sources.stored import cut
from . import census

# Versions of documents.
RECORD_VERSION, MANIFEST_VERSION, COMPLETION_VERSION = "chromaspan.census-record.v1", "chromaspan.census-manifest.v1", "chromaspan.census-completion.v1"


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def identity(config: dict, source: dict) -> str:
    """SHA-256 of what makes two runs the same run."""
    return hashlib.sha256(canonical({"config": config, "source": source}).encode()).hexdigest()


def partition_fingerprint(pair_edges: Column, single_vertices: Column) -> Column:
    pairs = F.transform(pair_edges, lambda e: F.array(e["u"], e["v"]))
    return F.sha2(F.to_json(F.struct(pairs.alias("pairs"), single_vertices.alias("singletons"))), 256)


#: A record's fields, in alphabetical order at every level.
SCHEMA = (
    "degree_parameter int, graph6 string, graph_fingerprint string, index long, order int, outcome_code string, partition_count int, "
    "partitions array<struct<checks:array<struct<backend:string,backtracks:long,color_count:int,nodes:long,palette_offset:int,status:string,witness:array<int>>>,"
    "index:int,pairs:array<array<int>>,partition_fingerprint:string,singletons:array<int>>>, run_fingerprint string, schema_version string, size int, status string"
)


def _verdict(partitions: Column, outcome: Column) -> tuple[Column, Column]:
    """(status, outcome_code) from a record's partitions and the graph's outcome."""
    has = lambda s: F.exists(partitions, lambda p: F.exists(p["checks"], lambda c: c["status"] == s))
    ones = lambda p: F.transform(F.filter(p["checks"], lambda c: c["palette_offset"] == 1), lambda c: c["status"])
    differ = F.exists(partitions, lambda p: F.size(F.array_distinct(ones(p))) > 1)
    return census.verdict(outcome, F.size(partitions) > 0, differ, has("error"), has("unknown"), has("candidate_unsat"))


def records(rows: DataFrame, most: int | None, run: str, wanted: list[tuple[str, int]] = census.CHECKS, max_nodes: int | None = None) -> DataFrame:
    """graphs -> (graph_id, document): one canonical JSON record for every graph, skipped ones with
    no partitions.  Fields are in alphabetical order at every level.  Equal graphs are solved once: their records
    differ in the index alone."""
    known = merged(rows)
    return indexed(rows, known, _records(known.select(F.col("same_as").alias("graph_id"), "n", "edges"), most, run, wanted, max_nodes))


def indexed(rows: DataFrame, known: DataFrame, lines: DataFrame) -> DataFrame:
    """rows, which ``merged`` made known, and records of known -> a record for each row, with its own index."""
    texts = lines.select(F.col("graph_id").alias("same_as"), *[x.alias(c) for c, x in zip(("before", "index", "after"), _split(F.col("document")), strict=True)])
    of = rows.select("graph_id", "n", "edges").join(known, ["n", "edges"]).select("graph_id", "same_as")
    return of.join(cut(texts, "texts"), "same_as").select("graph_id", F.concat("before", F.coalesce(F.col("graph_id").cast("string"), F.lit("null")), "after").alias("document"))


#: What a record begins with: fields before the index, which hold no quote or comma of their own, and a whole number as JSON writes it.
HEAD = r'^(\{(?:"[a-z0-9_]+":(?:"[^"]*"|[0-9]+|null),)*?"index":)(0|-?[1-9][0-9]{0,17}),'


def _split(document: Column) -> tuple[Column, Column, Column]:
    """A record's text before, of and behind its index; of other texts the second is empty."""
    before, index = F.regexp_extract(document, HEAD, 1), F.regexp_extract(document, HEAD, 2)
    return before, index, document.substr(F.length(before) + F.length(index) + 1, F.length(document))


def faults_once(lines: DataFrame, schema: str, found: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(index, ...) of ``found``, which tells of records by their text, with records that differ in the index alone looked at
    once.  ``found`` takes lines(document, key) and returns (key, ...); a text that it can't read has no other index
    than the one that is read from it."""
    before, index, after = _split(F.col("document"))
    lines = lines.select("document", before.alias("before"), index.alias("number"), after.alias("after"))
    body = F.when(F.col("number") != "", F.concat("before", F.lit("0"), "after")).otherwise(F.col("document"))
    keyed = lambda text: F.coalesce(F.sha2(text, 256), F.lit(""))
    known = cut(lines.select(body.alias("document")).distinct(), "bodies").withColumn("key", keyed(F.col("document")))
    told = cut(found(spread(known, "key")), "told")
    plain = F.coalesce(F.col("number") != "", F.lit(False)) & ~F.col("unread")
    own = F.when(plain, F.col("number").cast("long")).otherwise(F.from_json("document", schema)["index"])
    rows = lines.select("document", "number", keyed(body).alias("key")).join(told, "key")
    return rows.select(own.alias("index"), *[c for c in told.columns if c not in ("key", "unread")])


def _records(rows: DataFrame, most: int | None, run: str, wanted: list[tuple[str, int]], max_nodes: int | None) -> DataFrame:
    found = census.checks(rows, most, wanted, max_nodes)
    check = F.struct("backend", "backtracks", "color_count", "nodes", "palette_offset", "status", F.when(F.col("status") == "witness", F.col("assignment")).alias("witness"))
    by_part = found.groupBy("graph_id", "partition_index").agg(F.array_sort(F.collect_list(F.struct("palette_offset", "backend", check.alias("c")))).alias("c"), F.first("pair_edges").alias("p"), F.first("single_vertices").alias("s"))
    part = F.struct(
        F.transform("c", lambda x: x["c"]).alias("checks"), F.col("partition_index").alias("index"), F.transform("p", lambda e: F.array(e["u"], e["v"])).alias("pairs"),
        partition_fingerprint(F.col("p"), F.col("s")).alias("partition_fingerprint"), F.col("s").alias("singletons"))
    by_graph = by_part.select("graph_id", "partition_index", part.alias("part")).groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("partition_index", "part"))).alias("ps"))
    every = P.profile(rows).join(by_graph, "graph_id", "left")
    none = F.array().cast(by_graph.schema["ps"].dataType)
    every = every.withColumn("listed", F.transform(F.coalesce("ps", none), lambda x: x["part"]))
    status, code = _verdict(F.col("listed"), F.col("outcome"))
    document = F.struct(
        (F.col("d") - 1).alias("degree_parameter"), G.graph6(F.col("n"), F.col("edges")).alias("graph6"), G.fingerprint(F.col("n"), F.col("edges")).alias("graph_fingerprint"), F.col("graph_id").alias("index"), F.col("n").alias("order"),
        code.alias("outcome_code"), F.size("listed").alias("partition_count"), F.col("listed").alias("partitions"), F.lit(run).alias("run_fingerprint"), F.lit(RECORD_VERSION).alias("schema_version"), F.size("edges").alias("size"), status.alias("status"))
    return every.select("graph_id", F.to_json(document, {"ignoreNullFields": "false"}).alias("document"))


def parsed(lines: DataFrame) -> DataFrame:
    """lines(document) -> document and r, the record's fields, whose unreadable parts are null."""
    return lines.select("document", F.from_json("document", SCHEMA).alias("r"))


def _read(r: Column, document: Column) -> Column:
    """Whether the text is the canonical one of the fields read from it."""
    return F.coalesce(F.to_json(r, {"ignoreNullFields": "false"}) == document, F.lit(False))


def record_faults(lines: DataFrame) -> DataFrame:
    """(index, fault): what is wrong with records by themselves, found from their text alone.

    The graph is decoded, every partition's auxiliary graph built anew, every witness verified on it
    and on the total colouring that it gives, and the status derived again from the checks.  Records that differ
    in the index alone are looked at once."""
    return faults_once(lines, SCHEMA, _record_faults)


def _record_faults(lines: DataFrame) -> DataFrame:
    """lines(document, key) -> (key, fault, unread)."""
    rows = lines.select("key", "document", F.from_json("document", SCHEMA).alias("r")).withColumn("g", G.from_graph6(F.col("r.graph6")))
    sound = F.col("g").isNotNull() & _read(F.col("r"), F.col("document"))
    unread = rows.where(~sound).select("key", F.lit("unreadable").alias("fault"))
    rows = rows.where(sound).select("key", F.col("r").dropFields("index").alias("r"), "g").select("key", "r.*", F.col("g.n").alias("n"), F.col("g.edges").alias("edges"))
    rows = P.profile(rows)
    status, code = _verdict(F.col("partitions"), F.col("outcome"))
    same = lambda a, b: F.coalesce(a == b, F.lit(False))
    tests = {
        "graph": same(F.col("order"), F.col("n")) & same(F.col("size"), F.size("edges")) & same(F.col("graph_fingerprint"), G.fingerprint(F.col("n"), F.col("edges"))) & same(F.col("degree_parameter"), F.col("d") - 1),
        "schema_version": same(F.col("schema_version"), F.lit(RECORD_VERSION)), "partition_count": same(F.col("partition_count"), F.size("partitions")),
        "partition_order": F.forall(F.sequence(F.lit(0), F.size("partitions")), lambda i: (i == F.size("partitions")) | (F.get("partitions", i)["index"] == i)) & same(F.array_sort(F.array_distinct(F.transform("partitions", lambda p: p["pairs"]))), F.transform("partitions", lambda p: p["pairs"])),
        "status": same(F.col("status"), status) & same(F.col("outcome_code"), code),
    }
    own = rows.select("key", F.explode(F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, ok in tests.items()]), lambda x: x.isNotNull())).alias("fault"))
    # Without dropped partitions: the check of a whole list is the count by subsets, in ``plans.census``.
    part = rows.select("key", "n", "edges", "d", "pairs", "singles", F.explode("partitions").alias("p"))
    part = part.select("key", "n", "edges", "d", F.col("pairs").alias("want_pairs"), "p", F.transform("p.pairs", lambda e: F.struct(F.get(e, F.lit(0)).alias("u"), F.get(e, F.lit(1)).alias("v"))).alias("pair_edges"))
    ends = F.flatten(F.col("p.pairs"))
    free = G.complement(F.col("n"), F.col("edges"))
    left = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda v: ~F.array_contains(ends, v))
    whole = (F.size("pair_edges") == F.col("want_pairs")) & (F.size(F.array_distinct(ends)) == F.size(ends)) & F.forall("pair_edges", lambda e: F.array_contains(free, e)) & (F.array_sort("pair_edges") == F.col("pair_edges"))
    whole = whole & same(F.col("p.singletons"), left) & same(F.col("p.partition_fingerprint"), partition_fingerprint(F.col("pair_edges"), left))
    part = part.withColumn("whole", F.coalesce(whole, F.lit(False))).withColumn("single_vertices", left)
    broken = part.where("NOT whole").select("key", F.lit("partition").alias("fault"))
    checked = P.auxiliary(part.where("whole")).select("key", "n", "edges", "d", "pair_edges", "h_n", "h_edges", "marked", F.explode("p.checks").alias("c"))
    colors = F.col("c.witness")
    total = V.project_to_total(F.col("n"), F.col("edges"), F.col("h_edges"), F.col("pair_edges"), colors)
    checked = checked.withColumn("total", total)
    good = V.is_rainbow(F.col("h_edges"), colors, F.col("c.color_count"), F.col("marked")) & V.is_total(F.col("n"), F.col("edges"), F.col("total.vertex_colors"), F.col("total.edge_colors"))
    fits = F.when(F.col("c.status") == "witness", F.coalesce(good, F.lit(False))).otherwise(colors.isNull() & F.col("c.status").isin("candidate_unsat", "unknown", "error"))
    fits = fits & (F.col("c.color_count") == F.col("d") + F.col("c.palette_offset"))
    refuted = checked.where(~F.coalesce(fits, F.lit(False))).select("key", F.lit("check").alias("fault"))
    return unread.union(own).union(broken).union(refuted).withColumn("unread", F.col("fault") == "unreadable")


def missing_partitions(lines: DataFrame, n: int) -> DataFrame:
    """(index, listed, counted) of records of order n whose list of partitions isn't as long as an
    independent count says.  Records that differ in the index alone are looked at once."""

    def found(lines: DataFrame) -> DataFrame:
        rows = lines.select("key", "document", F.from_json("document", SCHEMA).alias("r")).withColumn("g", G.from_graph6(F.col("r.graph6")))
        rows = rows.select("key", _read(F.col("r"), F.col("document")).alias("read"), F.size("r.partitions").alias("listed"), "g.n", "g.edges")
        prof = P.profile(rows.where(F.col("n") == n)).where("outcome = ''")
        return prof.select("key", "listed", P.counted(n, G.complement(F.col("n"), F.col("edges")), F.col("pairs")).alias("counted"), (~F.col("read")).alias("unread")).where("listed <> counted")

    return faults_once(lines, SCHEMA, found)


def rebuilt(lines: DataFrame, run: str, wanted: list[tuple[str, int]] = census.CHECKS, max_nodes: int | None = None) -> DataFrame:
    """The records made anew from the graphs that they hold, to compare with them."""
    rows = parsed(lines).withColumn("g", G.from_graph6(F.col("r.graph6"))).where("g IS NOT NULL").select(F.col("r.index").alias("graph_id"), "g.n", "g.edges")
    return records(rows, None, run, wanted, max_nodes)


def totals(lines: DataFrame) -> dict:
    """Counts of a run from its records."""
    got = lines.select(F.get_json_object("document", "$.status").alias("s"), F.get_json_object("document", "$.partition_count").cast("long").alias("p")).groupBy("s").agg(F.count("*").alias("n"), F.sum("p").alias("p")).collect()
    statuses = dict.fromkeys(census.STATUSES, 0) | {r["s"]: r["n"] for r in got}
    return {"partitions": sum(r["p"] for r in got), "records": sum(statuses.values()), "statuses": statuses}


def _digest(lines: DataFrame) -> str:
    """SHA-256 of all records as a multiset: the digests of records, in order within 65,536 groups by
    their first four digits; the digests of these within 256; and of these."""
    at = lines.select(F.sha2("document", 256).alias("h"))
    for k in (4, 2):
        at = at.groupBy(F.substring("h", 1, k).alias("k")).agg(F.array_join(F.array_sort(F.collect_list("h")), ",").alias("all"))
        at = at.select(F.concat("k", F.sha2("all", 256)).alias("h"))
    return hashlib.sha256(canonical(sorted(r["h"] for r in at.collect())).encode()).hexdigest()  # 256 rows


def _write_text(spark, path: str, text: str) -> None:
    """A small file by rename, so that it's there whole or not at all."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".part")
    store = target.getFileSystem(conf)
    out = store.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not store.rename(part, target):
        raise FileExistsError(path)


def _read_text(spark, path: str) -> str | None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return None
    return spark.read.text(path, wholetext=True).first()[0]


def _finish(spark, folder: str, config: dict, source: dict) -> dict:
    stored = spark.read.text(f"{folder}/records").withColumnRenamed("value", "document")
    manifest = {"config": config, "digest": _digest(stored), "run_fingerprint": identity(config, source), "schema_version": MANIFEST_VERSION, "source": source, "totals": totals(stored)}
    _write_text(spark, f"{folder}/manifest.json", canonical(manifest))
    mark = {"manifest_sha256": hashlib.sha256(canonical(manifest).encode()).hexdigest(), "schema_version": COMPLETION_VERSION}
    _write_text(spark, f"{folder}/completion.json", canonical(mark))
    return manifest


def publish(lines: DataFrame, folder: str, config: dict, source: dict) -> dict:
    """Writes records, then the manifest, then the completion; a folder without completion isn't a run."""
    lines.select("document").write.text(f"{folder}/records")
    return _finish(lines.sparkSession, folder, config, source)


def run_census(rows: DataFrame, folder: str, config: dict, source: dict, wanted: list[tuple[str, int]] = census.CHECKS, max_nodes: int | None = None, waves: int = 1) -> dict:
    """Publishes the records of all graphs, or goes on with a run that was interrupted.

    Graphs are done in ``waves`` by a hash of their number, each appended whole or not at all, so what
    is lost is a wave at most.  A folder of another run, or with records of one, is refused; a
    finished run is left as it is."""
    spark, run = rows.sparkSession, identity(config, source)
    if (manifest := _read_text(spark, f"{folder}/manifest.json")) is not None:
        found = json.loads(manifest)
        if found["run_fingerprint"] != run:
            raise ValueError("the folder holds another run")
        if _read_text(spark, f"{folder}/completion.json") is None:
            _write_text(spark, f"{folder}/completion.json", canonical({"manifest_sha256": hashlib.sha256(manifest.encode()).hexdigest(), "schema_version": COMPLETION_VERSION}))
        return found
    top = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/records")
    left = rows
    if top.getFileSystem(spark._jsc.hadoopConfiguration()).exists(top):
        stored = spark.read.text(f"{folder}/records").withColumnRenamed("value", "document")
        done = parsed(stored).select(F.col("r.index").alias("graph_id"), "r.run_fingerprint")
        if not done.where(~F.coalesce(F.col("run_fingerprint") == run, F.lit(False))).isEmpty():
            raise ValueError("the folder holds records of another run")
        left = rows.join(done.select("graph_id"), "graph_id", "left_anti")
    for wave in range(waves):
        part = left.where(F.pmod(F.xxhash64("graph_id"), F.lit(waves)) == wave) if waves > 1 else left
        records(part, None, run, wanted, max_nodes).select("document").write.mode("append").text(f"{folder}/records")
    return _finish(spark, folder, config, source)


def replay(spark, folder: str, again: DataFrame | None = None) -> list[str]:
    """What is wrong with a published run; ``again`` is its records made anew."""
    manifest, mark = _read_text(spark, f"{folder}/manifest.json"), _read_text(spark, f"{folder}/completion.json")
    if manifest is None or mark is None:
        return ["incomplete"]
    found = []
    if json.loads(mark).get("manifest_sha256") != hashlib.sha256(manifest.encode()).hexdigest():
        found.append("manifest_digest")
    doc = json.loads(manifest)
    lines = spark.read.text(f"{folder}/records").withColumnRenamed("value", "document")
    found += ["records_digest"] * (_digest(lines) != doc["digest"]) + ["totals"] * (totals(lines) != doc["totals"]) + ["run_fingerprint"] * (identity(doc["config"], doc["source"]) != doc["run_fingerprint"])
    index = lines.select(F.get_json_object("document", "$.index").alias("i"), F.get_json_object("document", "$.run_fingerprint").alias("r"))
    found += ["repeated_index"] * (not index.groupBy("i").count().where("count > 1").isEmpty()) + ["foreign_record"] * (not index.where(F.col("r") != doc["run_fingerprint"]).isEmpty())
    found += [f"record_{r['fault']}" for r in record_faults(lines).select("fault").distinct().orderBy("fault").collect()]  # a handful of names
    if again is not None:
        made = again.select("document")
        found += ["records_differ"] * (not lines.exceptAll(made).isEmpty() or not made.exceptAll(lines).isEmpty())
    return found


def shard_union(spark, folders: list[str], direct: DataFrame, most_graphs: int = 10_000_000) -> dict:
    """A receipt of a whole set of shards: every one replayed, all of one configuration, their indices
    complete and their graphs together exactly those of ``direct``(graph6).  Raises ValueError."""
    from functools import reduce

    from .completeness import union_audit

    seen, rows, totals_of = {}, [], []
    for folder in folders:
        if wrong := replay(spark, folder):
            raise ValueError(f"{folder}: {', '.join(wrong)}")
        manifest = json.loads(_read_text(spark, f"{folder}/manifest.json"))
        config = manifest["config"]
        shard = config.get("shard", 0)
        if shard in seen:
            raise ValueError(f"shard {shard} comes twice")
        seen[shard] = canonical({k: v for k, v in config.items() if k != "shard"})
        totals_of.append(manifest["totals"])
        rows.append(parsed(spark.read.text(f"{folder}/records").withColumnRenamed("value", "document")).select(F.col("r.graph6").alias("graph6"), F.lit(shard).alias("shard")))
    if len(set(seen.values())) != 1 or sorted(seen) != list(range(json.loads(next(iter(seen.values()))).get("shards", 1))):
        raise ValueError("the runs aren't all shards of one configuration")
    total = reduced(totals_of)
    if total["records"] > most_graphs:
        raise ValueError(f"{total['records']} graphs are more than {most_graphs}")
    audit = union_audit(direct, reduce(DataFrame.unionByName, rows), "graph6", "shard").first().asDict()
    if any(audit[k] for k in ("overlapping", "repeated", "missing", "extra")):
        raise ValueError(f"the shards don't make up the stream: {canonical(audit)}")
    return {"audit": audit, "shards": len(seen), "status": "complete", "totals": total}


def reduced(parts: list[dict], expected: dict | None = None) -> dict:
    """The sum of shards' totals.  Raises ValueError where statuses don't add up to the records, any is
    adverse, or a number differs from ``expected``."""
    statuses = dict.fromkeys(census.STATUSES, 0)
    for p in parts:
        if p["statuses"].keys() != statuses.keys() or any(isinstance(v, bool) or not isinstance(v, int) or v < 0 for v in [*p["statuses"].values(), p["records"], p["partitions"]]):
            raise ValueError("malformed counts")
        statuses = {k: v + p["statuses"][k] for k, v in statuses.items()}
    out = {"partitions": sum(p["partitions"] for p in parts), "records": sum(p["records"] for p in parts), "statuses": statuses}
    if sum(statuses.values()) != out["records"]:
        raise ValueError("statuses don't add up to the records")
    if adverse := {k: statuses[k] for k in ("candidate_unsat", "unknown", "error") if statuses[k]}:
        raise ValueError(f"adverse statuses: {canonical(adverse)}")
    flat = {"partitions": out["partitions"], "records": out["records"]} | statuses
    if wrong := [k for k, v in (expected or {}).items() if flat.get(k) != v]:
        raise ValueError(f"{wrong[0]}: expected {expected[wrong[0]]}, got {flat.get(wrong[0])}")
    return out


def summary(manifests: list[dict]) -> dict:
    """Totals over runs and one finite claim; refuses runs that differ in configuration but for the
    order, repeat an order, are empty or have an adverse status."""
    if not manifests:
        raise ValueError("no runs")
    shape = {canonical({k: v for k, v in m["config"].items() if k != "order"}) for m in manifests}
    orders = [m["config"]["order"] for m in manifests]
    if len(shape) != 1 or len(set(orders)) != len(orders):
        raise ValueError("runs must have one configuration and different orders")
    for m in manifests:
        s = m["totals"]["statuses"]
        if s["verified_all"] == 0 or s["candidate_unsat"] or s["unknown"] or s["error"]:
            raise ValueError(f"order {m['config']['order']} is empty or adverse")
    add = lambda f: sum(f(m["totals"]) for m in manifests)
    # Nothing more is claimed than that the finite check was made.
    claim = f"every eligible graph of the orders {', '.join(map(str, sorted(orders)))} extends all its equitable partitions"
    return {"claim": claim, "orders": sorted(orders), "partitions": add(lambda t: t["partitions"]), "records": add(lambda t: t["records"]), "verified": add(lambda t: t["statuses"]["verified_all"])}


def run_files(spark, folder: str) -> dict[str, bytes]:
    """The files of a run, on the driver: records in the order of their graphs, manifest, completion.

    For archives of runs that fit into memory; a run's own folder has no such bound."""
    lines = spark.read.text(f"{folder}/records").withColumnRenamed("value", "document")
    ordered = lines.orderBy(F.get_json_object("document", "$.index").cast("long"), "document")
    text = "".join(r["document"] + "\n" for r in ordered.toLocalIterator())
    return {"records.jsonl": text.encode(), "manifest.json": _read_text(spark, f"{folder}/manifest.json").encode(), "completion.json": _read_text(spark, f"{folder}/completion.json").encode()}


# What an export has to be told, and the test of each.
EXPORT = {"summary_id": r"[a-z0-9][a-z0-9._-]*", "code_commit": r"[0-9a-f]{40}", "release_status": r"candidate|published"}


def export(spark, folders: list[str], told: dict) -> tuple[dict, bytes]:
    """(summary document, archive) of replayed runs.  told: summary_id, created_utc, release_version,
    release_status, code_commit, external_name, external_url.  Raises ValueError."""
    from . import bundle as B
    from ..functions import text as X

    by_column = {"created_utc": X.is_canonical_utc, "external_url": X.is_stable_url, "external_name": X.is_safe_path, "release_version": lambda c: X.semver_key(c).isNotNull()}
    row = spark.createDataFrame([tuple(told[k] for k in by_column)], ", ".join(f"{k} string" for k in by_column))
    fits = row.select(*[test(F.col(k)).alias(k) for k, test in by_column.items()]).first().asDict() | {k: bool(re.fullmatch(p, told[k])) for k, p in EXPORT.items()}
    if wrong := [k for k, ok in fits.items() if not ok]:
        raise ValueError(f"{wrong[0]} isn't in its canonical form")
    manifests, files = [], {}
    for folder in folders:
        if faults := replay(spark, folder):
            raise ValueError(f"{folder}: {', '.join(faults)}")
        manifests.append(json.loads(_read_text(spark, f"{folder}/manifest.json")))
        files |= {f"order-{manifests[-1]['config']['order']}/{k}": v for k, v in run_files(spark, folder).items()}
    whole = summary(manifests)
    archive = B.archive(files)
    runs = [{"order": m["config"]["order"], "run_fingerprint": m["run_fingerprint"], "totals": m["totals"]} for m in sorted(manifests, key=lambda m: m["config"]["order"])]
    return whole | told | {"archive_bytes": len(archive), "archive_sha256": hashlib.sha256(archive).hexdigest(), "runs": runs}, archive


def replay_archive(spark, document: dict, archive: bytes, folder: str) -> list[str]:
    """What is wrong with an export: its archive's digest and form, every archived run replayed below
    ``folder``, and its totals against the document's."""
    from . import bundle as B

    if hashlib.sha256(archive).hexdigest() != document["archive_sha256"]:
        return ["archive_sha256"]
    files, found = B.unpack(archive), []
    for run in document["runs"]:
        top, name = f"{folder}/order-{run['order']}", f"order-{run['order']}"
        _write_text(spark, f"{top}/records/records.jsonl", files[f"{name}/records.jsonl"].decode())
        for k in ("manifest.json", "completion.json"):
            _write_text(spark, f"{top}/{k}", files[f"{name}/{k}"].decode())
        found += [f"{name}: {x}" for x in replay(spark, top)]
        manifest = json.loads(files[f"{name}/manifest.json"])
        found += [f"{name}: differs from the document"] * ({k: manifest[k] for k in ("run_fingerprint", "totals")} != {k: run[k] for k in ("run_fingerprint", "totals")})
    return found + ["files"] * (len(files) != 3 * len(document["runs"]))
