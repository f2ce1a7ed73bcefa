"""Column expressions over (n, edges)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def shift_left(value: Column, bits: Column) -> Column:
    return F.call_function("shiftleft", value, bits)


def shift_right(value: Column, bits: Column) -> Column:
    return F.call_function("shiftright", value, bits)


def let(value: Column, use) -> Column:
    """use(x) with value computed once for a row, however often x stands in it, also in lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Fixed value: the version that identifies a canonical graph document.
GRAPH_VERSION = "total-coloring.simple-graph.v1"


def degrees(n: Column, edges: Column) -> Column:
    """Array of the degrees of vertices 0..n-1."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda v: F.size(F.filter(edges, lambda e: (e["u"] == v) | (e["v"] == v))))


def complement(n: Column, edges: Column) -> Column:
    """Sorted array of the pairs u < v that aren't edges."""
    upto = F.sequence(F.lit(0), n - 1)
    pairs = F.flatten(F.transform(upto, lambda u: F.transform(F.filter(upto, lambda v: v > u), lambda v: F.struct(u.alias("u"), v.alias("v")))))
    return F.array_except(pairs, edges)


def relabel(edges: Column, permutation: Column) -> Column:
    """Edges under old label -> permutation[old], oriented and sorted."""
    p = lambda x: F.element_at(permutation, x + 1)
    return F.sort_array(F.transform(edges, lambda e: F.struct(F.least(p(e["u"]), p(e["v"])).alias("u"), F.greatest(p(e["u"]), p(e["v"])).alias("v"))))


def canonical_json(n: Column, edges: Column) -> Column:
    """The canonical document: sorted keys, no spaces."""
    pairs = F.transform(edges, lambda e: F.array(e["u"], e["v"]))
    return F.to_json(F.struct(pairs.alias("edges"), n.alias("order"), F.lit(GRAPH_VERSION).alias("schema_version")))


def fingerprint(n: Column, edges: Column) -> Column:
    return F.sha2(canonical_json(n, edges), 256)


def parsed(document: Column) -> Column:
    """struct(n, edges) of a canonical document, or null: the text must be exactly what
    canonical_json would write, with edges sorted, distinct, oriented and within the order."""
    raw = F.from_json(document, "edges array<array<int>>, order int, schema_version string")
    n, pairs = raw["order"], raw["edges"]
    edges = F.transform(pairs, lambda p: F.struct(F.get(p, F.lit(0)).alias("u"), F.get(p, F.lit(1)).alias("v")))
    sound = (n >= 0) & F.forall(edges, lambda e: (e["u"] >= 0) & (e["u"] < e["v"]) & (e["v"] < n)) & (F.array_sort(F.array_distinct(edges)) == edges)
    return F.when(sound & (canonical_json(n, edges) == document), F.struct(n.alias("n"), edges.alias("edges")))


def _bits(value: Column, width: int) -> Column:
    return F.transform(F.sequence(F.lit(width - 1), F.lit(0), F.lit(-1)), lambda i: shift_right(value, i).bitwiseAND(F.lit(1)))


def _pack(bits: Column) -> Column:
    """Text of six-bit groups, zero-padded, each plus 63."""

    def text(bits: Column) -> Column:
        groups = F.ceil(F.size(bits) / 6).cast("int")
        value = lambda g: F.aggregate(F.sequence(F.lit(1), F.lit(6)), F.lit(0), lambda a, i: a * 2 + F.coalesce(F.get(bits, g * 6 + i - 1), F.lit(0)).cast("int"))
        letters = F.transform(F.sequence(F.lit(0), groups - 1), lambda g: F.char(value(g) + 63))
        return F.when(groups > 0, F.array_join(letters, "")).otherwise("")

    return let(bits, text)


def graph6(n: Column, edges: Column) -> Column:
    """graph6 text: the order, then the upper triangle by columns."""
    long = n.cast("long")
    head = F.when(n <= 62, F.char(n + 63)).when(n <= 258047, F.concat(F.lit("~"), _pack(_bits(long, 18)))).otherwise(F.concat(F.lit("~~"), _pack(_bits(long, 36))))
    column = lambda v: F.transform(F.sequence(F.lit(0), v - 1), lambda u: F.when(F.array_contains(edges, F.struct(u.alias("u"), v.alias("v"))), 1).otherwise(0))
    bits = F.when(n > 1, F.flatten(F.transform(F.sequence(F.lit(1), n - 1), column))).otherwise(F.array().cast("array<int>"))
    return F.concat(head, _pack(bits))


def from_graph6(text: Column) -> Column:
    """struct(n, edges), or null unless the record is canonical: shortest length prefix, characters
    63..126, exact length and zero padding.  One header and one line end are taken off."""
    body = F.regexp_replace(F.regexp_replace(text, "^>>graph6<<", ""), "\r?\n\\z", "")
    none = F.array().cast("array<struct<u:int,v:int>>")

    def header(body: Column) -> Column:
        codes = F.transform(F.split(body, ""), lambda c: F.ascii(c) - 63)
        wide = F.when(body.startswith("~~"), 2).when(body.startswith("~"), 1).otherwise(0)
        return F.struct(codes.alias("codes"), F.length(body).alias("size"), wide.alias("wide"))

    def sized(h: Column) -> Column:
        number = lambda a, b: F.aggregate(F.slice(h["codes"], a, b), F.lit(0).cast("long"), lambda x, c: x * 64 + c)
        n = F.when(h["wide"] == 2, number(3, 6)).when(h["wide"] == 1, number(2, 3)).otherwise(F.get(h["codes"], F.lit(0)).cast("long"))
        start = F.when(h["wide"] == 2, 8).when(h["wide"] == 1, 4).otherwise(1)
        return F.struct(h["codes"].alias("codes"), h["size"].alias("size"), h["wide"].alias("wide"), n.alias("n"), start.alias("start"))

    def graph(h: Column) -> Column:
        n, codes, size = h["n"], h["codes"], h["size"]
        shortest = F.when(h["wide"] == 2, n > 258047).when(h["wide"] == 1, n > 62).otherwise(F.lit(True))
        count = n * (n - 1) / 2
        bit = lambda k: shift_right(F.get(codes, (h["start"] + F.floor(k / 6)).cast("int")), (5 - k % 6).cast("int")).bitwiseAND(F.lit(1))
        place = lambda u, v: (v * (v - 1) / 2 + u).cast("long")
        column = lambda v: F.transform(F.filter(F.sequence(F.lit(0), v - 1), lambda u: bit(place(u, v)) == 1), lambda u: F.struct(u.alias("u"), v.alias("v")))
        edges = F.when(n > 1, F.sort_array(F.flatten(F.transform(F.sequence(F.lit(1), n.cast("int") - 1), column)))).otherwise(none)
        padding = F.when(count % 6 == 0, True).otherwise(F.get(codes, size - 1).bitwiseAND(shift_left(F.lit(1), (6 - count % 6).cast("int")) - 1) == 0)
        sound = (size > 0) & F.forall(codes, lambda c: c.between(0, 63)) & shortest & (size == h["start"] + F.ceil(count / 6)) & padding
        return F.when(sound, F.struct(n.cast("int").alias("n"), edges.alias("edges")))

    return let(let(let(body, header), sized), graph)


def core(n: Column, edges: Column) -> Column:
    """Edges with both ends of maximum degree."""
    return let(degrees(n, edges), lambda d: F.filter(edges, lambda e: (F.get(d, e["u"]) == F.array_max(d)) & (F.get(d, e["v"]) == F.array_max(d))))


def is_forest(n: Column, edges: Column) -> Column:
    """No edge joins vertices that edges before it have joined."""
    start = F.struct(F.sequence(F.lit(0), n - 1).alias("part"), F.lit(True).alias("free"))

    def join(state: Column, e: Column) -> Column:
        a, b = F.element_at(state["part"], e["u"] + 1), F.element_at(state["part"], e["v"] + 1)
        return F.struct(F.transform(state["part"], lambda x: F.when(x == b, a).otherwise(x)).alias("part"), (state["free"] & (a != b)).alias("free"))

    return F.aggregate(edges, start, join)["free"]


def conflicts(n: Column, edges: Column) -> Column:
    """Pairs i < j of items that must differ in a total colouring: vertices 0..n-1, then edges."""
    pair = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    meet = lambda a, b: (a["u"] == b["u"]) | (a["u"] == b["v"]) | (a["v"] == b["u"]) | (a["v"] == b["v"])
    at = F.sequence(F.lit(0), F.size(edges) - 1)
    by_vertex = F.transform(edges, lambda e: pair(e["u"], e["v"]))
    ends = F.flatten(F.transform(at, lambda i: F.array(pair(F.get(edges, i)["u"], n + i), pair(F.get(edges, i)["v"], n + i))))
    by_edge = F.flatten(F.transform(at, lambda i: F.transform(F.filter(at, lambda j: (j > i) & meet(F.get(edges, i), F.get(edges, j))), lambda j: pair(n + i, n + j))))
    return F.when(F.size(edges) > 0, F.sort_array(F.concat(by_vertex, ends, by_edge))).otherwise(F.array().cast("array<struct<i:int,j:int>>"))


def neighbours(v: Column, edges: Column) -> Column:
    """Sorted array of the vertices joined to v."""
    mine = F.filter(edges, lambda e: (e["u"] == v) | (e["v"] == v))
    return F.array_sort(F.transform(mine, lambda e: F.when(e["u"] == v, e["v"]).otherwise(e["u"])))


def has_edge(a: Column, b: Column, edges: Column) -> Column:
    """Whether a and b, in either order, are joined."""
    return F.exists(edges, lambda e: (e["u"] == F.least(a, b)) & (e["v"] == F.greatest(a, b)))


def incident_edges(v: Column, edges: Column) -> Column:
    """Indices of the edges at v, in order."""
    at = F.transform(edges, lambda e, i: F.when((e["u"] == v) | (e["v"] == v), i))
    return F.filter(at, lambda i: i.isNotNull())


def faults(n: Column, edges: Column) -> Column:
    """Array of what keeps (n, edges) from being a canonical simple graph: loop, orientation, range,
    repeated, order; empty if nothing does."""
    when = lambda test, name: F.when(test, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    both = F.transform(edges, lambda e: F.struct(F.least(e["u"], e["v"]).alias("u"), F.greatest(e["u"], e["v"]).alias("v")))
    return F.concat(
        when(F.exists(edges, lambda e: e["u"] == e["v"]), "loop"), when(F.exists(edges, lambda e: e["u"] > e["v"]), "orientation"),
        when((n < 0) | F.exists(edges, lambda e: (F.least(e["u"], e["v"]) < 0) | (F.greatest(e["u"], e["v"]) >= n)), "range"),
        when(F.size(F.array_distinct(both)) != F.size(edges), "repeated"), when(F.sort_array(edges) != edges, "order"))


def line_conflicts(edges: Column) -> Column:
    """Pairs i < j of edges that share an end."""
    at = F.sequence(F.lit(0), F.size(edges) - 1)
    meet = lambda a, b: (a["u"] == b["u"]) | (a["u"] == b["v"]) | (a["v"] == b["u"]) | (a["v"] == b["v"])
    found = F.flatten(F.transform(at, lambda i: F.transform(F.filter(at, lambda j: (j > i) & meet(F.get(edges, i), F.get(edges, j))), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    return F.when(F.size(edges) > 0, found).otherwise(F.array().cast("array<struct<i:int,j:int>>"))
