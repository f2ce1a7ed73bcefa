"""The jobs as queries: each runs twice into one new folder and gives the output as it then stands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chromaspan.functions.graphs import GRAPH_VERSION
from chromaspan.queries import GRAPH6_OF_SIX, LEAST6, THREE, UNIVERSAL, checked6
from chromaspan.sources.stored import new_path

from . import census, lines
from .common import read_back


def job1_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of the census, with the graphs' codecs."""
    out = new_path(spark, "job1")
    for _ in range(2):
        census.run(spark, f"{sf_dir}/lineitem.parquet", out)
    codecs = read_back(spark, f"{out}/graphs", census.GRAPHS).select("graph_id", "graph6", "fingerprint")
    return read_back(spark, f"{out}/records", census.RECORDS).join(codecs, "graph_id")


def job2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue of lines' graphs: the second run finds nothing new."""
    out, checkpoint = new_path(spark, "job2"), new_path(spark, "job2-state")
    for _ in range(2):
        lines.run(spark, f"{sf_dir}/documents.parquet", out, checkpoint)
    return lines.read(spark, out)


JOBS = {f.__name__: f for f in (job1_census, job2_lines)}

_CLASSES = LEAST6.replace("masks", "own_masks")
_N = lines.SETTINGS["order"]
JOB_SQL = {
    "job1_census": checked6(THREE) + f""", u AS ({UNIVERSAL}), {_CLASSES}, {GRAPH6_OF_SIX}
SELECT u.*, min(u.graph_id) OVER (PARTITION BY r) AS class_id, CAST(u.graph_id % {census.SETTINGS["shards"]} AS INTEGER) AS shard, graph6, fingerprint
FROM u JOIN own_masks USING (graph_id) JOIN least6 USING (m) JOIN codecs USING (graph_id)""",
    "job2_lines": f"""
WITH l AS (SELECT coalesce(nullif(trim(lang), ''), '{lines.NO_LANGUAGE}') AS lang, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
w AS (SELECT lang, doc_id, list_transform(list_filter(string_split_regex(line, '[ \\t\\r]+'), lambda x: x <> ''), lambda x: length(x) % {_N}) AS v FROM l),
e AS (SELECT lang, doc_id, list_sort(list_distinct(list_filter(list_transform(range(1, len(v)), lambda i: [least(v[i], v[i + 1]), greatest(v[i], v[i + 1])]), lambda p: p[1] < p[2]))) AS edges FROM w WHERE len(v) >= {lines.SETTINGS["least"]}),
g AS (SELECT lang, edges, count(*) AS lines, min(doc_id) AS first_doc, list_transform(edges, lambda p: p[2] * (p[2] - 1) // 2 + p[1]) AS ks,
  list_max(list_transform(range({_N}), lambda v: len(list_filter(edges, lambda p: p[1] = v OR p[2] = v)))) AS t FROM e WHERE len(edges) > 0 GROUP BY lang, edges)
SELECT lang, lines, first_doc, CAST(len(edges) AS INTEGER) AS size, CAST(t AS INTEGER) AS max_degree,
  CASE WHEN 2 * t < {_N} THEN 'outside_high_degree_filter' WHEN t + 1 > {_N} OR {_N} > 2 * (t + 1) THEN 'outside_auxiliary_regime' ELSE '' END AS outcome,
  chr({63 + _N}) || array_to_string(list_transform(range({-(-_N * (_N - 1) // 12)}), lambda j: chr(CAST(63 + list_sum(list_transform(range(6), lambda b: CASE WHEN list_contains(ks, 6 * j + b) THEN 32 >> CAST(b AS INTEGER) ELSE 0 END)) AS INTEGER))), '') AS graph6,
  sha256('{{"edges":[' || array_to_string(list_transform(edges, lambda p: '[' || p[1] || ',' || p[2] || ']'), ',') || '],"order":{_N},"schema_version":"{GRAPH_VERSION}"}}') AS fingerprint
FROM g""",
}
