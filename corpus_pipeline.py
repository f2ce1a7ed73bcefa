"""A training corpus from documents: stages that each read what their predecessor wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chromaspan.llm import line_dedup, mixing, near_dedup, packing, quality
from chromaspan.llm.queries import TOKENIZER, table
from chromaspan.llm.shared import new_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines go; every document stays."""
    return line_dedup.clean_lines(docs)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return near_dedup.keep_one(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each epoch in which the mix takes a document."""
    return mixing.take(docs)


def packing_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece, a sequence of its own, with its token ids."""
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("quality_classifier", quality_classifier), ("line_dedup", line_deduplication), ("near_dedup", near_deduplication),
    ("source_mixing", source_mixing), ("packing", packing_sequences),
]

#: SQL can't express the trained classifier, the fingerprints and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
