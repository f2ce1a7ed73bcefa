"""Catalogue of the graphs that lines of text make, kept up as documents arrive.

    python -m jobs.lines --documents sf0.1/documents.parquet --out /data/lines --checkpoint /data/lines-state --config jobs/lines.json

A line's vertices are its words' lengths modulo the order, and words that follow one another are
joined.  The catalogue has a row for each language and graph: its codecs and profile, how many lines
make it and the least document that does.

Documents are a file stream with a checkpoint: a run takes the files that no run took before and ends.  Each
batch leaves its counts by graph under the checkpoint in a partition of its own, which a batch that is
tried again replaces.  For each language with counts that are new, by this run or one that broke off, its sums so far
and those counts make its part of the catalogue, and then the sums for the next run.  So a run reads
neither old documents nor old counts, and a language without news is left alone.  The checkpoint belongs
to one ``out``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromaspan.functions import graphs as G
from chromaspan.operators import partitions
from chromaspan.sources.stored import cut

from .common import LOG, begun, command, read_back, written

#: order: vertices of a graph; least: words that a line must have; files: files of a batch, 0 for all.
SETTINGS = {"order": 8, "least": 4, "files": 0}
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
EDGES = "array<struct<u:int,v:int>>"
COUNTS = f"n int, edges {EDGES}, lines long, first_doc long, lang string, batch long"
SUMS = f"n int, edges {EDGES}, lines long, first_doc long, lang string, upto long"
CATALOGUE = "graph6 string, fingerprint string, size int, max_degree int, outcome string, lines long, first_doc long, lang string"
#: A document without a language.
NO_LANGUAGE = "und"


def graphs_of(documents: DataFrame, order: int, least: int) -> DataFrame:
    """documents(doc_id, text, lang) -> (lang, n, edges, lines, first_doc) by graph.

    Lines of fewer than ``least`` words, and those whose words all have one length modulo the order,
    make no graph.  A line becomes its edges where it is read: text isn't shuffled, only a row a task
    for each graph it has seen."""
    lang = F.coalesce(F.nullif(F.trim("lang"), F.lit("")), F.lit(NO_LANGUAGE)).alias("lang")
    # All of a text's lines are one expression: a filter on the graph of a line would be pushed below and make it again.
    words = lambda line: F.filter(F.split(line, " "), lambda w: w != "")
    sizes = lambda line: F.transform(words(line), lambda w: (F.length(w) % order).cast("int"))
    # The last word is paired with null, which least and greatest pass over, and so falls out.
    steps = lambda v: F.zip_with(v, F.slice(v, 2, F.size(v)), lambda a, b: F.struct(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")))
    graph = lambda v: F.when(F.size(v) >= least, F.sort_array(F.array_distinct(F.filter(steps(v), lambda e: e["u"] < e["v"]))))
    spaced = F.replace(F.replace("text", F.lit("\t"), F.lit(" ")), F.lit("\r"), F.lit(" "))
    graphs = F.transform(F.split(spaced, "\n"), lambda line: G.let(sizes(line), graph))
    made = documents.select("doc_id", lang, F.lit(order).alias("n"), F.explode_outer(graphs).alias("edges"))
    return made.where(F.size("edges") > 0).groupBy("lang", "n", "edges").agg(F.count("*").alias("lines"), F.min("doc_id").alias("first_doc"))


def catalogue(whole: DataFrame) -> DataFrame:
    """(lang, n, edges, lines, first_doc) -> rows of the catalogue."""
    n, edges = F.col("n"), F.col("edges")
    return partitions.profile(whole).select(
        G.graph6(n, edges).alias("graph6"), G.fingerprint(n, edges).alias("fingerprint"), F.size("edges").alias("size"), (F.col("d") - 1).alias("max_degree"), "outcome", "lines", "first_doc", "lang")


def _stream(spark: SparkSession, path: str, files: int) -> DataFrame:
    """New files of a table that is a folder or one file: a pattern that only this path fits takes both."""
    path = path.rstrip("/")
    reader = spark.readStream.schema(DOCUMENTS)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def run(spark: SparkSession, documents: str, out: str, checkpoint: str, settings: dict = SETTINGS) -> None:
    """Brings the catalogue up to date with the documents table."""
    counts, sums = f"{checkpoint}/counts", f"{checkpoint}/sums"
    for path, schema, by in ((counts, COUNTS, ("lang", "batch")), (sums, SUMS, ("lang", "upto")), (f"{out}/catalogue", CATALOGUE, ("lang",))):
        begun(spark, path, schema, *by)

    def put(batch: DataFrame, number: int) -> None:
        found = graphs_of(batch, settings["order"], settings["least"]).withColumn("batch", F.lit(number).cast("long"))
        written(found.hint("rebalance", "lang"), counts, "lang", "batch", partitionOverwriteMode="dynamic")

    query = _stream(spark, documents, settings["files"]).writeStream.foreachBatch(put).option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    LOG.info("read %d new rows of %s in %d batches", sum(p["numInputRows"] for p in query.recentProgress), documents, sum(p["numInputRows"] > 0 for p in query.recentProgress))

    # A language's sums hold its batches up to a number.  They are written behind the catalogue: a run that broke
    # off in between is made up for by the next one.
    known = read_back(spark, sums, SUMS)
    upto = [(r["lang"], r["upto"]) for r in known.groupBy("lang").agg(F.max("upto").alias("upto")).collect()]  # a row a language
    # A lookup in a literal reads only the names of partitions, so others aren't opened.
    mine = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in upto for x in pair]), F.col("lang")), F.lit(-1)) if upto else F.lit(-1)
    fresh = read_back(spark, counts, COUNTS).where(F.col("batch") > mine)
    last = fresh.groupBy("lang").agg(F.max("batch").alias("last"))
    if last.isEmpty():
        LOG.info("nothing new")
        return
    held = known.where(F.col("upto") == mine).join(last, "lang", "left_semi")
    both = held.select("lang", "n", "edges", "lines", "first_doc").union(fresh.select("lang", "n", "edges", "lines", "first_doc"))
    whole = cut(both.groupBy("lang", "n", "edges").agg(F.sum("lines").alias("lines"), F.min("first_doc").alias("first_doc")), "lines")
    written(catalogue(whole).hint("rebalance", "lang"), f"{out}/catalogue", "lang", partitionOverwriteMode="dynamic")
    written(whole.join(last, "lang").withColumnRenamed("last", "upto").hint("rebalance", "lang"), sums, "lang", "upto", partitionOverwriteMode="dynamic")
    LOG.info("the catalogue has %d rows", read(spark, out).count())


def read(spark: SparkSession, out: str) -> DataFrame:
    """The catalogue that a run wrote."""
    return read_back(spark, f"{out}/catalogue", CATALOGUE)


def main(arguments: list[str] | None = None) -> None:
    command("lines", SETTINGS, run, "documents", "out", "checkpoint", arguments=arguments)


if __name__ == "__main__":
    main()
