"""Queries of this folder's operators over the supplied tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, exact_dedup, line_dedup, media, mixing, near_dedup, packing, pii, quality, secrets, warc, whitening

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), words=secrets.lexicon(TOKENIZER))


#: Weights at all levels, far from those of the supply: some domains and sources run short.
UNEVEN = {"domain": {"d0": 6, "d1": 3, "d2": 1}, "lang": {"en": 5, "de": 40, "fr": 15, "es": 1}, "source": {f"src{i}": 1 + i * i for i in range(20)}}


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)


def op2_weighted_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target weights of domains, languages and sources, half of all tokens."""
    return _mixed(spark, sf_dir, share=0.5, weights=UNEVEN)


def _mixed(spark: SparkSession, sf_dir: str, **settings) -> DataFrame:
    rows = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), **settings)
    leaf = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]
    return rows.select("doc_id", F.col("__domain").alias("domain"), *leaf, F.col("__tokens").alias("tokens"), F.col("__epoch").alias("epoch"), F.col("__budget").alias("budget"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media.media_columns(table(spark, sf_dir, "documents"))
    size = F.octet_length("media").cast("long").alias("media_bytes")
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", size, F.sha2("media", 256).alias("media_sha256"), "feature")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages")).drop("payload")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op9_every_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_dedup.drop_boilerplate(docs, min_words=None, max_share=None).select("doc_id", "n_lines", "n_removed", "text")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.find(table(spark, sf_dir, "documents"))
    counts = [pii.count_of("base", k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return rows.select("doc_id", *counts, F.sha2(pii.as_text("base"), 256).alias("base_sha256"), pii.as_text("spans").alias("spans"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n = F.size("items").cast("long").alias("n_items")
    return rows.select("doc_id", "n_words", "n_hit", n, F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_secret_scan, op2_source_mixing, op2_weighted_mixing, op3_near_dedup, op4_packing, op5_quality, op6_media_columns, op7_warc, op8_exact_dedup, op9_line_dedup, op9_every_line, op10_personal_data, op11_embedding_whitening, op12_decontamination)
}

ORACLES: dict[str, str] = {
    "op2_source_mixing": mixing.oracle(),
    "op2_weighted_mixing": mixing.oracle(0.5, weights=UNEVEN),
    "op8_exact_dedup": """
SELECT doc_id, max(doc_id) OVER t AS keep_id, count(*) OVER t AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER t AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW t AS (PARTITION BY coalesce(text, ''))""",
    "op9_line_dedup": line_dedup.oracle(),
    "op9_every_line": line_dedup.oracle_every_line(),
    "op12_decontamination": decontamination.oracle(),
}
