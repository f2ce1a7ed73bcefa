"""Mixing sources to target weights by hierarchical budgeting.

The tree is domain -> language -> source.  A token budget flows from the root by weights; a node
that can't use its share (its documents times ``epochs``) leaves the rest to its siblings, and
only what a whole family can't use goes back to its parent's siblings.  In integers, with the
siblings in order of supply over weight: a node is full if its supply times the weights still to
serve is at most the budget left times its own weight.

A leaf takes whole epochs and then a token-prefix of the next one, in an order seeded by seed and
epoch.  The prefix is found in two steps, sums over 4,096 slices of the order and then the one
slice where it ends, so that no task sorts a leaf.  It becomes one bound per leaf and the
documents themselves are never shuffled while the table of leaves is small enough to be sent; if
it isn't, they are joined by leaf and salt, so that a leaf with most rows is many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, drop, parts, place, positional

SEED = 7
EPOCHS = 2
SHARE = 0.8
DOMAINS = 3
PATH = ["domain", "lang", "source"]
#: Weights of the children of a node by level and name; names that aren't told weigh OTHER.
Weights = dict[str, dict[str, int]]
WEIGHTS: Weights = {"lang": {"en": 50, "de": 20, "fr": 20, "es": 20}}
OTHER = 10
#: A table of at most this many leaves is broadcast (some 20 MB); a larger one is joined by SALTS.
LEAVES = 100_000
SALTS = 32


def _leaf(text: str = "text", lang: str = "lang", source: str = "source") -> list:
    """Columns domain, lang, source and tokens of a document."""
    site = F.coalesce(F.col(source).cast("string"), F.lit(""))
    number = F.right(F.regexp_extract(site, "[0-9]+$", 0), F.lit(9)).try_cast("int")
    words = F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(r"\S+"))
    return [
        F.concat(F.lit("d"), (F.coalesce(number, F.lit(0)) % DOMAINS).cast("string")).alias("domain"),
        F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), site.alias("source"), words.cast("long").alias("tokens"),
    ]


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, domain, lang, source, tokens) for every row: tokens are the words of the text, a
    domain is a family of sources by the number in their name; nulls are the value ''."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_leaf())


def _by_leaf(rows: DataFrame, of_leaf: DataFrame, path: list[str], key: list[str], most: int) -> DataFrame:
    """rows joined with of_leaf, a cut table with a row for each leaf."""
    if of_leaf.count() <= most:
        return rows.join(F.broadcast(of_leaf), path)
    salted = of_leaf.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return rows.withColumn("salt", F.pmod(F.xxhash64(*key), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), [*path, "salt"]).drop("salt")


def checked_weights(weights: Weights) -> Weights:
    """The weights, if their levels are those of the tree and each is a whole number from 1 to a million."""
    if odd := sorted(set(weights) - set(PATH)):
        raise ValueError(f"no level {odd[0]}: levels are {', '.join(PATH)}")
    for level, by_name in weights.items():
        for name, w in by_name.items():
            if not isinstance(name, str) or type(w) is not int or not 1 <= w <= 1_000_000:
                raise ValueError(f"{level} {name!r} has the weight {w!r}, not a whole number from 1 to 1,000,000")
    return weights


def _weight(level: str, weights: Weights):
    told = weights.get(level, {})
    pairs = [x for name in sorted(told) for x in (F.lit(name), F.lit(told[name]))]
    # A map is looked up at once, however many names there are.
    found = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(level)), F.lit(OTHER)) if pairs else F.lit(OTHER)
    return found.cast("long")


def budgets(supply: DataFrame, share: float = SHARE, epochs: int = EPOCHS, weights: Weights = WEIGHTS) -> DataFrame:
    """supply(domain, lang, source, tokens) -> the same with budget: the tokens that a leaf gives.

    ``weights`` are target weights of nodes among their siblings, by level and name.
    The budget is ``share`` of all tokens, rounded down; rounding loses under one token a node.
    """
    checked_weights(weights)
    leaf = supply.withColumn("cap", F.col("tokens") * epochs)
    total = supply.agg(F.floor(F.sum("tokens") * F.lit(share)).alias("given"))
    up = total.select("given")
    for depth, name in enumerate(PATH):
        parent, node = PATH[:depth], PATH[: depth + 1]
        rows = leaf.groupBy(*node).agg(F.sum("cap").alias("cap")).withColumn("w", _weight(name, weights))
        rows = rows.join(up, parent) if parent else rows.crossJoin(F.broadcast(up))  # one row: the root
        w = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
        order = w.orderBy(F.col("cap") / F.col("w"), name)
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("remain", F.col("given") - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("serve", F.sum("w").over(w) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        # Products may pass 64 bits on a large corpus.
        full = F.col("cap").cast("decimal(38,0)") * F.col("serve") <= F.col("remain").cast("decimal(38,0)") * F.col("w")
        # Nodes behind the first that isn't full share what was left there.
        rows = rows.withColumn("full", full)
        first = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("w"), F.col(name), F.col("remain"), F.col("serve")))).over(w)
        rows = rows.withColumn("f", first)
        part = F.expr("CAST(CAST(f.remain AS decimal(20,0)) * w AS decimal(30,0)) div CAST(f.serve AS decimal(20,0))")
        rows = rows.withColumn("given", F.when(F.col("full"), F.col("cap")).otherwise(part).cast("long"))
        up = rows.select(*node, "given")
    return supply.join(up.withColumnRenamed("given", "budget"), PATH)


def _key(epoch: str, tokens: str, doc_id: str = "doc_id"):
    """A row's place in the seeded order of an epoch."""
    doc = F.coalesce(F.col(doc_id).cast("long").cast("string"), F.lit(""))
    return F.md5(F.concat_ws(":", F.lit(str(SEED)), F.col(epoch).cast("string"), doc, F.col(tokens).cast("string")))


def plan(rows: DataFrame, share: float = SHARE, epochs: int = EPOCHS, most: int = LEAVES, weights: Weights = WEIGHTS) -> DataFrame:
    """(domain, lang, source, budget, whole, bound): a leaf gives ``whole`` epochs and, of the next
    one, the documents whose key is at most ``bound`` (none where that is null)."""
    supply = rows.groupBy(*PATH).agg(F.sum("tokens").alias("tokens"))
    given = budgets(supply, share, epochs, weights)
    whole = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(1)
    given = cut(given.select(*PATH, "budget", whole.cast("int").alias("whole"), (F.col("budget") - whole * F.col("tokens")).alias("rest")), "budgets")
    n = given.count()
    keyed = _by_leaf(rows, given, PATH, ["doc_id", "tokens"], most).where("rest > 0").withColumn("key", _key("whole", "tokens"))
    sliced = keyed.withColumn("slice", F.substring("key", 1, 3)).where("tokens > 0")
    sums = sliced.groupBy(*PATH, "rest", "slice").agg(F.sum("tokens").alias("t"))
    before = Window.partitionBy(*PATH).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("b", F.coalesce(F.sum("t").over(before), F.lit(0)))
    last = cut(sums.where("b < rest and b + t >= rest").select(*PATH, F.col("slice").alias("at"), "b"), "slices", n)
    within = Window.partitionBy(*PATH).orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    tail = _by_leaf(sliced, last, PATH, ["doc_id", "tokens"], most).where("slice = at").withColumn("e", F.col("b") + F.sum("tokens").over(within))
    bound = tail.where(F.col("e") >= F.col("rest")).groupBy(*PATH).agg(F.min("key").alias("bound"))
    made = cut(given.join(bound, PATH, "left").select(*PATH, "budget", "whole", "bound"), "plan", n)
    drop(given)
    drop(last)
    return made


def _taken(docs: DataFrame, share: float, epochs: int, most: int, weights: Weights) -> DataFrame:
    """docs under positional names, a row for each epoch, and domain, tokens, epoch, budget."""
    checked_weights(weights)
    seen = cut(leaves(parts(docs, "doc_id", "text", "lang", "source")), "leaves")
    chosen = plan(seen, share, epochs, most, weights)
    drop(seen)
    rows, doc = positional(docs), place(docs, "doc_id")
    own = rows.columns
    rows = _by_leaf(rows.select(*own, *_leaf(place(docs, "text"), place(docs, "lang"), place(docs, "source"))), chosen, PATH, [doc, "tokens"], most)
    takes = F.col("whole") + F.when((F.col("tokens") > 0) & F.col("bound").isNotNull() & (_key("whole", "tokens", doc) <= F.col("bound")), 1).otherwise(0)
    rows = rows.select(*own, "domain", "tokens", "budget", takes.alias("takes")).where("takes > 0")
    return rows.select(*own, "domain", "tokens", F.explode(F.sequence(F.lit(0), F.col("takes") - 1)).alias("epoch"), "budget")


def mix(docs: DataFrame, share: float = SHARE, epochs: int = EPOCHS, most: int = LEAVES, weights: Weights = WEIGHTS) -> DataFrame:
    """docs' rows that the mix takes, once for each epoch, with __domain, __tokens, __epoch, __budget.

    ``weights`` tells the target weights of domains, languages and sources among their siblings, as
    {"domain": {"d0": 3}, "lang": {...}, "source": {...}}; what isn't told weighs OTHER.
    The document in which a leaf's prefix ends is taken whole.  Documents without words come with
    each whole epoch only, of which a leaf without any words has one.  Null language or source are
    the value ''; a null text has no words.  Rows equal in doc_id and words share a key and are
    taken together.  An empty table gives an empty result; other columns pass through whatever their
    names, but that columns with one of the four names are replaced.
    """
    names = ["__domain", "__tokens", "__epoch", "__budget"]
    kept = [i for i, c in enumerate(docs.columns) if c.lower() not in names]
    out = _taken(docs, share, epochs, most, weights).select(*[f"c{i}" for i in kept], "domain", "tokens", "epoch", "budget")
    return out.toDF(*[docs.columns[i] for i in kept], *names)


def take(docs: DataFrame, share: float = SHARE, epochs: int = EPOCHS, most: int = LEAVES, weights: Weights = WEIGHTS) -> DataFrame:
    """The rows of ``mix`` with docs' columns only, all of them as they are."""
    return _taken(docs, share, epochs, most, weights).select(*positional(docs).columns).toDF(*docs.columns)


def oracle(share: float = SHARE, epochs: int = EPOCHS, weights: Weights = WEIGHTS) -> str:
    """The same rows by direct sums over whole leaves."""
    cases = {level: " ".join(f"WHEN {level} = '{k}' THEN {v}" for k, v in told.items()) for level, told in weights.items()}
    levels = [f"supply AS (SELECT {', '.join(PATH)}, CAST(sum(tokens) AS HUGEINT) AS tokens FROM docs GROUP BY ALL)", f"up0 AS (SELECT CAST(floor(sum(tokens) * {share}) AS HUGEINT) AS given FROM supply)"]
    for d, name in enumerate(PATH):
        parent, node = ", ".join(PATH[:d]), ", ".join(PATH[: d + 1])
        by = f"PARTITION BY {parent}" if d else ""
        w = f"CASE {cases[name]} ELSE {OTHER} END" if cases.get(name) else str(OTHER)
        join = f"JOIN up{d} USING ({parent})" if d else f"CROSS JOIN up{d}"
        levels += [
            f"n{d} AS (SELECT {node}, sum(tokens) * {epochs} AS cap, {w} AS w FROM supply GROUP BY {node})",
            f"o{d} AS (SELECT *, given - coalesce(sum(cap) OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, sum(w) OVER ({by}) - coalesce(sum(w) OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS serve FROM n{d} {join} WINDOW p AS ({by} ORDER BY cap / w, {name}))",
            f"g{d} AS (SELECT *, cap * serve <= rest * w AS is_full FROM o{d})",
            f"h{d} AS (SELECT *, min(CASE WHEN NOT is_full THEN {{'a': cap / w, 'b': {name}, 'rest': rest, 'serve': serve}} END) OVER ({by}) AS f FROM g{d})",
            f"up{d + 1} AS (SELECT {node}, CASE WHEN is_full THEN cap ELSE CAST(f.rest AS HUGEINT) * w // CAST(f.serve AS HUGEINT) END AS given FROM h{d})",
        ]
    path = ", ".join(PATH)
    return f"""
WITH docs AS (SELECT doc_id, 'd' || (coalesce(TRY_CAST(right(regexp_extract(source, '[0-9]+$'), 9) AS INTEGER), 0) % {DOMAINS}) AS domain,
  coalesce(lang, '') AS lang, coalesce(source, '') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '\\S+')) AS BIGINT) AS tokens FROM documents),
{", ".join(levels)},
given AS (SELECT {path}, CAST(given AS BIGINT) AS budget, CASE WHEN tokens > 0 THEN CAST(given // tokens AS BIGINT) ELSE 1 END AS whole, CAST(given - CASE WHEN tokens > 0 THEN given // tokens ELSE 1 END * tokens AS BIGINT) AS rest FROM supply JOIN up3 USING ({path})),
keyed AS (SELECT d.*, budget, whole, rest, md5(concat_ws(':', '{SEED}', whole, coalesce(doc_id::VARCHAR, ''), tokens)) AS k FROM docs d JOIN given USING ({path})),
run AS (SELECT *, sum(tokens) OVER (PARTITION BY {path} ORDER BY k RANGE UNBOUNDED PRECEDING) - sum(tokens) OVER (PARTITION BY {path}, k) AS before FROM keyed),
takes AS (SELECT *, whole + CASE WHEN tokens > 0 AND before < rest THEN 1 ELSE 0 END AS n FROM run)
SELECT doc_id, domain, lang, source, tokens, CAST(unnest(range(n)) AS INTEGER) AS epoch, budget FROM takes"""
