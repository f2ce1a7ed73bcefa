"""Columns of a caller's with any names: every operator gives the same rows, and stages keep their values."""

import pytest
from pyspark.sql import functions as F

from chromaspan.llm import exact_dedup, line_dedup, media, mixing, near_dedup, packing, pii, quality, secrets, warc
from chromaspan.llm.queries import TOKENIZER

NAMES = [
    "c0", "c1", "c99", "h", "n", "key", "bad", "left", "take", "takes", "n_lines", "N_Removed", "whole", "bound", "rest", "tokens", "domain", "epoch", "budget", "salt", "slot", "bucket", "owner", "score", "Score", "SCORE", "__score", "__text", "__path",
    "__tokens", "__Budget", "__line_dedup_key", "a.b", "a`b", "x y", "gone", "fp", "first", "node", "root", "sha", "site", "spans", "base", "b0", "l0", "TEXT", "Doc_Id", "Source", "start", "end", "count", "slice", "at", "", "*",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
NOTE = "a notice found on every single site"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"{NOTE}\nown words {i % 7} of text {i % 7} mail a{i % 7}@example.com and card 4111111111111111 ok", "en" if i % 2 else None, f"src{i % 6}", 0) for i in range(40)]
    return spark.createDataFrame([*rows, (90, None, None, None, None), (91, "", "de", "src1", 0)], SCHEMA)


@pytest.fixture(scope="module")
def named(spark, docs):
    table = docs.select("*", *[F.concat(F.lit(f"{i}-"), F.col("doc_id")) for i in range(len(NAMES))])
    return table.toDF(*docs.columns, *NAMES)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, "x", 0.5) for i in range(40)], "doc_id long, quality int, text string, `QUALITY` double")


def plain(rows):
    return sorted(map(repr, map(tuple, rows)))


def read_only(labels):
    return {
        "secrets": secrets.scan, "near": near_dedup.near_duplicates, "packing": lambda d: packing.pack(d, TOKENIZER).drop("sequence_id"), "quality": lambda d: quality.classify(d, labels), "media": media.media_columns,
        "exact": exact_dedup.exact_duplicates, "pii": pii.find,
    }


@pytest.mark.parametrize("name", ["secrets", "near", "packing", "quality", "media", "exact", "pii"])
def test_other_columns_change_nothing(docs, named, labels, name):
    run = read_only(labels)[name]
    assert plain(run(named).collect()) == plain(run(docs).collect())


@pytest.mark.parametrize("name", ["keep_good", "clean_lines", "keep_one", "take"])
def test_stages_keep_all_columns(docs, named, labels, name):
    run = {"keep_good": lambda d: quality.keep_good(d, labels, threshold=0.4), "clean_lines": line_dedup.clean_lines, "keep_one": near_dedup.keep_one, "take": mixing.take}[name]
    got, want = run(named), run(docs)
    assert got.columns == named.columns and want.columns == docs.columns
    rows = [tuple(r) for r in got.collect()]
    assert plain(r[:5] for r in rows) == plain(want.collect()) and rows
    assert all(r[5:] == tuple(None if r[0] is None else f"{i}-{r[0]}" for i in range(len(NAMES))) for r in rows)


@pytest.mark.parametrize(("name", "added"), [("lines", ["n_lines", "n_removed"]), ("mix", ["__domain", "__tokens", "__epoch", "__budget"]), ("score", ["score"])])
def test_only_columns_of_a_result_s_names_are_replaced(docs, named, labels, name, added):
    model = quality.train(docs, labels)
    run = {"lines": line_dedup.drop_boilerplate, "mix": mixing.mix, "score": lambda d: quality.score(d, model)}[name]
    got, want = run(named), run(docs)
    kept = [i for i, c in enumerate(named.columns) if c.lower() not in added]
    assert got.columns == [*(named.columns[i] for i in kept), *added] and want.columns == [*docs.columns, *added]
    rows = [tuple(r) for r in got.collect()]
    n = len(added)
    assert plain((*r[:5], *r[-n:]) for r in rows) == plain(want.collect())
    assert all(r[j] == f"{kept[j] - 5}-{r[0]}" for r in rows for j in range(5, len(kept)))


def test_pages_with_any_columns(docs):
    pages = docs.where("doc_id < 9").select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("source").alias("html"))
    wide = pages.select("*", *[F.lit(i) for i in range(len(NAMES))]).toDF(*pages.columns, *NAMES)
    assert plain(warc.archive_and_read(wide).collect()) == plain(warc.archive_and_read(pages).collect())


def test_required_columns(docs):
    with pytest.raises(ValueError):
        near_dedup.near_duplicates(docs.drop("text"))
    upper = docs.withColumnRenamed("text", "Text")
    assert plain(near_dedup.near_duplicates(upper).collect()) == plain(near_dedup.near_duplicates(docs).collect())
