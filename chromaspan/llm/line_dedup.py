"""Line deduplication by distinct-site spread, in DataFrame operations only.

Lines in at least ``min_sites`` documents get a HyperLogLog sketch of the sites they occur on;
sketches merge by aggregation.  Lines whose estimate is near the threshold get an exact distinct
count.  Lines on at least ``min_sites`` sites are boilerplate and are removed wherever they occur.

The hashes of boilerplate are sent to the tasks, which then filter texts where they are, as long as
there are at most ``sent`` of them; beyond that each row's hashes are joined to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, drop, place, positional, sized

MIN_SITES = 5
MIN_WORDS = 4
MAX_SHARE = 0.5
LG_K = 12
#: At most this many hashes are sent with the plan (80 kB of numbers).
SENT = 10_000
#: At most this many hashes are broadcast in a join (8 MB of numbers).
BROADCAST = 1 << 20
#: A line of these alone is empty and never boilerplate.
BLANK = " \t\r\x0b\x0c\u00a0\u3000"


def _counts(line, min_words: int | None):
    """Whether a line is counted: one of min_words words or, with None, any that isn't empty."""
    if min_words is None:
        return F.btrim(line, F.lit(BLANK)) != ""
    return F.size(F.split(F.trim(line), " ")) >= min_words


def _lines(text, min_words: int | None):
    """Array of (line's hash, or null where the line isn't counted)."""
    return F.transform(F.split(text, "\n"), lambda x: F.when(_counts(x, min_words), F.xxhash64(F.trim(x))))


def widespread(docs: DataFrame, min_sites: int = MIN_SITES, min_words: int | None = MIN_WORDS, lg_k: int = LG_K, broadcast: int = BROADCAST) -> DataFrame:
    """docs(text, source) -> boilerplate(h), written to the shared folder.

    Rows of the occurrence table are counted by line before anything is joined, so a line that is
    everywhere is one row a task from then on."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("site"), F.explode(F.array_distinct(_lines(text, min_words))).alias("h"))
    seen = cut(rows.where("h is not null"), "lines")
    often = cut(seen.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites).select("h"), "often", seen.count() // max(1, min_sites))
    n = often.count()
    sketched = seen.join(sized(often, broadcast), "h", "left_semi").groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites"))
    # Five standard errors, and one site for the rounding of an estimate.
    off = 5 * 1.04 / (1 << lg_k) ** 0.5
    low, high = int(min_sites * (1 - off)) - 1, int(min_sites * (1 + off)) + 2
    rated = cut(sketched.where(F.col("sites") >= low), "spread", n)
    near = cut(rated.where(F.col("sites") <= high).select("h"), "near", n)
    exact = seen.join(sized(near, broadcast), "h", "left_semi").select("h", "site").distinct().groupBy("h").agg(F.count("*").alias("k"))
    wide = cut(rated.where(F.col("sites") > high).select("h").union(exact.where(F.col("k") >= min_sites).select("h")), "wide", n)
    for table in (seen, often, rated, near):
        drop(table)
    return wide


def _marked(rows: DataFrame, text: Column, key: list[Column], wide: DataFrame, min_words: int | None, sent: int, broadcast: int) -> tuple[DataFrame, Column]:
    """rows, and of each the test of a line's hash for boilerplate."""
    few = [r["h"] for r in wide.limit(sent + 1).collect()]  # at most sent + 1 numbers
    if len(few) <= sent:
        return rows, lambda h: h.isin(few) if few else F.lit(False)
    # A row's hashes are joined to it by a hash of all that tells it from others, so that rows
    # without doc_id don't share a key.
    rows = rows.withColumn("key", F.xxhash64(*key))
    hashes = rows.select("key", F.explode(F.array_distinct(_lines(text, min_words))).alias("h"))
    bad = hashes.join(sized(wide, broadcast), "h", "left_semi").groupBy("key").agg(F.collect_set("h").alias("bad"))
    return rows.join(bad, "key", "left"), lambda h: F.coalesce(F.array_contains(F.col("bad"), h), F.lit(False))


def _cleaned(docs: DataFrame, min_sites: int, min_words: int | None, max_share: float | None, sent: int, broadcast: int) -> tuple[DataFrame, str]:
    """docs under positional names with its text cleaned, n_lines and n_removed; and text's name."""
    rows, t, doc, source = positional(docs), place(docs, "text"), place(docs, "doc_id"), place(docs, "source")
    wide = widespread(rows.select(F.col(t).alias("text"), F.col(source).alias("source")), min_sites, min_words, broadcast=broadcast)
    text = F.col(t).cast("string")
    rows, is_bad = _marked(rows, text, [F.col(doc), F.col(source), F.col(t)], wide, min_words, sent, broadcast)
    lines = F.split(text, "\n")
    left = F.filter(lines, lambda x: ~(_counts(x, min_words) & is_bad(F.xxhash64(F.trim(x)))))
    rows = rows.withColumn("n_lines", F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("int")).withColumn("left", left)
    less = F.col("left").isNotNull() & (F.size("left") < F.col("n_lines"))
    if max_share is not None:
        total = F.aggregate(lines, F.lit(0), lambda a, x: a + F.length(x))
        left_chars = F.aggregate(F.col("left"), F.lit(0), lambda a, x: a + F.length(x))
        less &= total - left_chars <= max_share * total
    rows = rows.withColumn("take", less)
    own = [F.when(F.col("take"), F.array_join("left", "\n")).otherwise(F.col(c)).alias(c) if c == t else F.col(c) for c in positional(docs).columns]
    n = F.when(F.col("take"), F.col("n_lines") - F.size("left")).otherwise(0).cast("int")
    return rows.select(*own, "n_lines", n.alias("n_removed")), t


def drop_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, min_words: int | None = MIN_WORDS, max_share: float | None = MAX_SHARE, sent: int = SENT, broadcast: int = BROADCAST) -> DataFrame:
    """docs with boilerplate lines taken out of ``text``, plus n_lines and n_removed (int).

    A line is compared without spaces at its ends; lines of under ``min_words`` space-separated
    words recur by chance and always stay; with None every line that isn't empty counts, in any
    script.  A site is ``source`` (null: the empty string).  Where
    boilerplate makes up over ``max_share`` of a text's characters the text is a copy, a matter of
    document deduplication, and stays whole; with None no text is spared, and one without other lines
    becomes empty.  A null text stays null with 0 lines; an empty text
    has one line.  Repeated rows are treated alike.  A row without doc_id is cleaned like others.
    An empty table gives an empty result; other columns pass through whatever their names, but that
    columns called n_lines or n_removed are replaced.
    """
    out, _ = _cleaned(docs, min_sites, min_words, max_share, sent, broadcast)
    names = ["n_lines", "n_removed"]
    kept = [i for i, c in enumerate(docs.columns) if c.lower() not in names]
    return out.select(*[f"c{i}" for i in kept], *names).toDF(*[docs.columns[i] for i in kept], *names)


def clean_lines(docs: DataFrame, min_sites: int = MIN_SITES, min_words: int | None = None, max_share: float | None = None, sent: int = SENT, broadcast: int = BROADCAST) -> DataFrame:
    """docs with its own columns, boilerplate of any length taken out of every text; n_chars, where
    there is one, counts the text that is left.  All other columns stay as they are."""
    out, text = _cleaned(docs, min_sites, min_words, max_share, sent, broadcast)
    out = out.drop("n_lines", "n_removed")
    if "n_chars" in docs.columns:
        n = place(docs, "n_chars")
        length = F.length(F.col(text).cast("string")).cast(out.schema[n].dataType)
        out = out.withColumn(n, F.when(F.col(text).isNull(), F.col(n)).otherwise(length))
    return out.toDF(*docs.columns)


def oracle(min_sites: int = MIN_SITES, min_words: int = MIN_WORDS, max_share: float = MAX_SHARE) -> str:
    """The same rows by exact counts."""
    return f"""
WITH lines AS (
  SELECT d.rowid AS r, d.doc_id, coalesce(source, '') AS site, u.i, x AS line, trim(x, ' ') AS k,
         len(string_split(trim(x, ' '), ' ')) >= {min_words} AS counts
  FROM (SELECT row_number() OVER () AS rowid, * FROM documents) d, LATERAL (SELECT unnest(string_split(d.text, chr(10))) AS x, unnest(range(len(string_split(d.text, chr(10))))) AS i) u
), wide AS (SELECT k FROM lines WHERE counts GROUP BY k HAVING count(DISTINCT site) >= {min_sites}),
rated AS (SELECT l.*, counts AND k IN (SELECT k FROM wide) AS bad FROM lines l),
docs AS (
  SELECT r, any_value(doc_id) AS doc_id, count(*) AS n, count(*) FILTER (bad) AS b,
         coalesce(sum(length(line)) FILTER (bad), 0) <= {max_share} * sum(length(line)) AS take,
         string_agg(line, chr(10) ORDER BY i) FILTER (NOT bad) AS cleaned, string_agg(line, chr(10) ORDER BY i) AS whole
  FROM rated GROUP BY r)
SELECT doc_id, CAST(n AS INTEGER) AS n_lines, CAST(CASE WHEN take THEN b ELSE 0 END AS INTEGER) AS n_removed,
       CASE WHEN take AND b > 0 THEN coalesce(cleaned, '') ELSE whole END AS text
FROM docs"""


def oracle_every_line(min_sites: int = MIN_SITES) -> str:
    """The rows without bounds on words or share, by exact counts."""
    blank = " || ".join(f"chr({ord(c)})" for c in BLANK)
    return f"""
WITH lines AS (
  SELECT d.r, d.doc_id, coalesce(source, '') AS site, u.i, x AS line, trim(x, ' ') AS k, trim(x, {blank}) <> '' AS counts
  FROM (SELECT row_number() OVER () AS r, * FROM documents) d, LATERAL (SELECT unnest(string_split(d.text, chr(10))) AS x, unnest(range(len(string_split(d.text, chr(10))))) AS i) u
), wide AS (SELECT k FROM lines WHERE counts GROUP BY k HAVING count(DISTINCT site) >= {min_sites}),
rated AS (SELECT l.*, counts AND k IN (SELECT k FROM wide) AS bad FROM lines l)
SELECT any_value(doc_id) AS doc_id, CAST(count(*) AS INTEGER) AS n_lines, CAST(count(*) FILTER (bad) AS INTEGER) AS n_removed,
       coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT bad), '') AS text
FROM rated GROUP BY r"""
