"""Records of searches for one extension: a JSON line a graph, bound to its certificate and held against its own text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import graphs as G
from ..operators import partitions as P
from ..operators import verify as V
from ..sources.families import merged
from . import census
from .records import faults_once, indexed, partition_fingerprint

# Fixed value: the version of these documents.
VERSION = "chromaspan.search-record.v1"
#: A record's fields, in alphabetical order at every level.
CERTIFICATE = "struct<edge_colors:array<int>,graph_fingerprint:string,palette_size:int,vertex_colors:array<int>>"
WITNESS = f"struct<assignment:array<int>,certificate:{CERTIFICATE},certificate_sha256:string,pairs:array<array<int>>,partition_fingerprint:string,partition_index:int,singletons:array<int>>"
SCHEMA = f"backend string, graph6 string, graph_fingerprint string, index long, order int, palette_offset int, run_fingerprint string, schema_version string, size int, started long, status string, witness {WITNESS}"


def _text(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def records(rows: DataFrame, run: str, offset: int = 2, backend: str = "dsatur-iterative-v1", **limits: int | None) -> DataFrame:
    """graphs -> (graph_id, document): one canonical JSON record for every graph.

    A witness tells its partition and the colouring of the auxiliary graph, and the certificate, which is the total
    colouring that those give, bound to the numbered graph by its fingerprint.  Without one it's null.  Equal graphs are
    searched once: their records differ in the index alone."""
    known = merged(rows)
    return indexed(rows, known, _records(known.select(F.col("same_as").alias("graph_id"), "n", "edges"), run, offset, backend, **limits))


def _records(rows: DataFrame, run: str, offset: int, backend: str, **limits: int | None) -> DataFrame:
    found = census.search(rows, offset, backend, **limits).select("graph_id", "status", "started", "first_partition", "witness")
    every = P.profile(rows).join(found, "graph_id")
    print_ = G.fingerprint(F.col("n"), F.col("edges"))
    w = F.col("witness")
    certificate = F.struct(w["total"]["edge_colors"].alias("edge_colors"), print_.alias("graph_fingerprint"), (F.col("d") + offset).cast("int").alias("palette_size"), w["total"]["vertex_colors"].alias("vertex_colors"))
    witness = F.struct(
        w["assignment"].alias("assignment"), certificate.alias("certificate"), F.sha2(_text(certificate), 256).alias("certificate_sha256"), F.transform(w["pair_edges"], lambda e: F.array(e["u"], e["v"])).alias("pairs"),
        partition_fingerprint(w["pair_edges"], w["single_vertices"]).alias("partition_fingerprint"), F.col("first_partition").alias("partition_index"), w["single_vertices"].alias("singletons"))
    document = F.struct(
        F.lit(backend).alias("backend"), G.graph6(F.col("n"), F.col("edges")).alias("graph6"), print_.alias("graph_fingerprint"), F.col("graph_id").alias("index"), F.col("n").alias("order"), F.lit(offset).alias("palette_offset"),
        F.lit(run).alias("run_fingerprint"), F.lit(VERSION).alias("schema_version"), F.size("edges").alias("size"), F.col("started").cast("long").alias("started"), "status", F.when(F.col("status") == "witness", witness).alias("witness"))
    return every.select("graph_id", _text(document).alias("document"))


def parsed(lines: DataFrame) -> DataFrame:
    """lines(document) -> document and r, the record's fields, whose unreadable parts are null."""
    return lines.select("document", F.from_json("document", SCHEMA).alias("r"))


def faults(lines: DataFrame) -> DataFrame:
    """(index, fault) of records, found from their text alone; no fault means that a witness is one.

    The graph is decoded, the partition's auxiliary graph built anew, its colouring and the total colouring that it
    gives verified, and the certificate compared with that.  What the tests are about:

    * unreadable: the text isn't a canonical record, or its graph isn't one;
    * graph: order, size or fingerprint; version: the schema's;
    * status: skipped or not by the domain, a witness without one, one without the status, or nothing started;
    * partition: pairs that aren't an equitable matching of the complement, its singletons, fingerprint or index;
    * assignment: not a rainbow colouring of the auxiliary graph;
    * certificate: not the total colouring that the assignment gives, bound to another graph, or of another digest.

    Records that differ in the index alone are looked at once."""
    return faults_once(lines, SCHEMA, _faults)


def _faults(lines: DataFrame) -> DataFrame:
    """lines(document, key) -> (key, fault, unread)."""
    rows = lines.select("key", "document", F.from_json("document", SCHEMA).alias("r")).withColumn("g", G.from_graph6(F.col("r.graph6")))
    sound = F.col("g").isNotNull() & F.coalesce(_text(F.col("r")) == F.col("document"), F.lit(False))
    unread = rows.where(~sound).select("key", F.lit("unreadable").alias("fault"))
    rows = P.profile(rows.where(sound).select("key", F.col("r").dropFields("index").alias("r"), "g").select("key", "r.*", F.col("g.n").alias("n"), F.col("g.edges").alias("edges")))
    same = lambda a, b: F.coalesce(a == b, F.lit(False))
    is_witness = F.col("status") == "witness"
    inside = F.col("outcome") == ""
    status = same(F.col("status") == "skipped", ~inside) & same(is_witness, F.col("witness").isNotNull()) & F.coalesce(F.col("status").isin("witness", "candidate_unsat", "unknown", "error", "skipped"), F.lit(False)) & (~is_witness | (F.col("started") > 0))
    own = {
        "graph": same(F.col("order"), F.col("n")) & same(F.col("size"), F.size("edges")) & same(F.col("graph_fingerprint"), G.fingerprint(F.col("n"), F.col("edges"))), "version": same(F.col("schema_version"), F.lit(VERSION)), "status": status,
    }
    told = F.filter(F.array(*[F.when(~ok, name) for name, ok in own.items()]), lambda x: x.isNotNull())
    first = rows.select("key", F.explode(told).alias("fault"))

    held = rows.where(is_witness & inside & F.col("witness").isNotNull()).select("key", "n", "edges", "d", F.col("pairs").alias("wanted"), "palette_offset", "started", "witness")
    w = F.col("witness")
    pair_edges = F.transform(w["pairs"], lambda e: F.struct(F.get(e, F.lit(0)).alias("u"), F.get(e, F.lit(1)).alias("v")))
    held = held.withColumn("pair_edges", pair_edges).withColumn("ends", F.flatten(w["pairs"])).withColumn("free", G.complement(F.col("n"), F.col("edges")))
    held = held.withColumn("single_vertices", F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda v: ~F.array_contains("ends", v)))
    whole = same(F.size("pair_edges"), F.col("wanted")) & same(F.size(F.array_distinct("ends")), F.size("ends")) & F.coalesce(F.forall("pair_edges", lambda e: F.array_contains("free", e)), F.lit(False)) & same(F.array_sort("pair_edges"), F.col("pair_edges"))
    whole &= same(w["singletons"], F.col("single_vertices")) & same(w["partition_fingerprint"], partition_fingerprint(F.col("pair_edges"), F.col("single_vertices"))) & same(w["partition_index"] + 1, F.col("started"))
    held = P.auxiliary(held.withColumn("whole", whole))
    colors, palette = w["assignment"], (F.col("d") + F.col("palette_offset")).cast("int")
    total = V.project_to_total(F.col("n"), F.col("edges"), F.col("h_edges"), F.col("pair_edges"), colors)
    held = held.withColumn("total", total)
    good = F.coalesce(V.is_rainbow(F.col("h_edges"), colors, palette, F.col("marked")), F.lit(False))
    c = w["certificate"]
    bound = same(c["vertex_colors"], F.col("total.vertex_colors")) & same(c["edge_colors"], F.col("total.edge_colors")) & same(c["palette_size"], palette) & same(c["graph_fingerprint"], G.fingerprint(F.col("n"), F.col("edges"))) & same(w["certificate_sha256"], F.sha2(_text(c), 256))
    bound &= F.coalesce(V.is_total(F.col("n"), F.col("edges"), c["vertex_colors"], c["edge_colors"]), F.lit(False))
    # What rests on a partition that isn't one can't be told.
    parts = F.array(F.when(~F.col("whole"), "partition"), F.when(F.col("whole") & ~good, "assignment"), F.when(F.col("whole") & ~bound, "certificate"))
    found = unread.union(first).union(held.select("key", F.explode(F.filter(parts, lambda x: x.isNotNull())).alias("fault")))
    return found.withColumn("unread", F.col("fault") == "unreadable")
