"""Stand-alone colouring problems as columns: items, colours, conflicts, fixed, and their digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import graphs as G

CONFLICTS, FIXED, GROUPS = "array<struct<i:int,j:int>>", "array<struct<item:int,color:int>>", "array<array<int>>"


def _raise(test: Column, text: str, value: Column) -> Column:
    """value, or an error where the test holds."""
    return F.when(test, F.raise_error(F.lit(text))).otherwise(value)


def edge_problem(rows: DataFrame, colours: str, distinguished: str | None = None, fix: bool = False) -> DataFrame:
    """graphs with a number ``colours`` and, if named, an array of edges ``distinguished`` -> with items,
    colours, conflicts, groups, fixed and marked, the indices of distinguished edges in order.

    Distinguished edges differ pairwise; with ``fix`` they have the colours 0, 1, ... in order, which
    loses nothing since colours may be renamed.  Raises an error for an edge that isn't one of the
    graph's or is named twice, and for a palette smaller than the family or empty beside edges."""
    none = F.array().cast("array<int>")
    if distinguished is None:
        marked = none
    else:
        place = lambda e: F.array_position("edges", F.struct(F.least(e["u"], e["v"]).alias("u"), F.greatest(e["u"], e["v"]).alias("v"))).cast("int") - 1
        marked = F.array_sort(F.transform(distinguished, place))
        marked = _raise(F.exists(marked, lambda i: i < 0), "a distinguished edge isn't in the graph", marked)
        marked = _raise(F.size(F.array_distinct(marked)) != F.size(marked), "a distinguished edge is named twice", marked)
    k = F.col(colours).cast("int")
    k = _raise((k < 0) | (k == 0) & (F.size("edges") > 0), "colours must be positive where there are edges", k)
    rows = rows.withColumn("marked", marked).withColumn("items", F.size("edges")).withColumn("colours", _raise(F.size("marked") > k, "the palette is smaller than the distinguished family", k))
    pairs = F.flatten(F.transform("marked", lambda i: F.transform(F.filter("marked", lambda j: j > i), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    fixed = F.transform("marked", lambda m, c: F.struct(m.alias("item"), c.alias("color"))) if fix else F.array().cast(FIXED)
    groups = F.when(F.size("marked") > 1, F.array("marked")).otherwise(F.array().cast(GROUPS))
    return rows.withColumn("explicit", G.line_conflicts(F.col("edges"))).withColumn("conflicts", F.array_sort(F.array_union("explicit", pairs))).withColumn("groups", groups).withColumn("fixed", fixed)


def faults(items: Column, colours: Column, conflicts: Column, fixed: Column, groups: Column | None = None) -> Column:
    """Array of what is wrong with a problem; empty if nothing is."""
    when = lambda test, name: F.when(test, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    within = lambda x, n: (x >= 0) & (x < n)
    found = [
        when((items < 0) | (colours < 0) | (colours == 0) & (items > 0), "colours"), when(F.exists(conflicts, lambda c: ~within(c["i"], items) | ~within(c["j"], items)), "conflict_range"),
        when(F.exists(conflicts, lambda c: c["i"] >= c["j"]) | (F.array_sort(F.array_distinct(conflicts)) != conflicts), "conflict_order"),
        when(F.exists(fixed, lambda f: ~within(f["item"], items) | ~within(f["color"], colours)), "fixed_range"),
        when(F.array_sort(F.array_distinct(F.transform(fixed, lambda f: f["item"]))) != F.transform(fixed, lambda f: f["item"]), "fixed_order"),
    ]
    if groups is not None:
        found += [
            when(F.exists(groups, lambda g: (F.size(g) < 2) | F.exists(g, lambda x: ~within(x, items))), "group_range"),
            when(F.exists(groups, lambda g: F.array_sort(F.array_distinct(g)) != g) | (F.array_sort(F.array_distinct(groups)) != groups), "group_order"),
        ]
    return F.concat(*found)


def semantic_digest(items: Column, colours: Column, conflicts: Column, fixed: Column) -> Column:
    """SHA-256 of what a problem means: all conflicts, those of its groups too, and fixed colours."""
    pairs = F.transform(conflicts, lambda c: F.array(c["i"], c["j"]))
    given = F.transform(fixed, lambda f: F.array(f["item"], f["color"]))
    return F.sha2(F.to_json(F.struct(colours.alias("color_count"), pairs.alias("conflicts"), given.alias("fixed_colors"), items.alias("item_count"), F.lit(1).alias("schema_version"))), 256)


def representation_digest(names: Column, explicit: Column, groups: Column, semantic: Column, metadata: dict[str, Column]) -> Column:
    """SHA-256 of how a problem is written: item names, explicit conflicts, groups and metadata."""
    pairs = F.transform(explicit, lambda c: F.array(c["i"], c["j"]))
    told = F.struct(*[metadata[k].alias(k) for k in sorted(metadata)])
    return F.sha2(F.to_json(F.struct(groups.alias("all_different"), pairs.alias("explicit_conflicts"), names.alias("item_names"), told.alias("metadata"), F.lit(1).alias("schema_version"), semantic.alias("semantic_digest"))), 256)


def edge_names(edges: Column) -> Column:
    return F.transform(edges, lambda e: F.format_string("edge:%d-%d", e["u"], e["v"]))
