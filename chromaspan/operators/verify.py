"""Verifiers on arrays.  They import neither solvers nor the builders of problems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _issue(code: str, path: Column, message: Column) -> Column:
    return F.struct(F.lit(code).alias("code"), path.alias("path"), message.alias("message"))


def _pair(e: Column) -> Column:
    return F.format_string("(%d, %d)", e["u"], e["v"])


def _when(test: Column, issue: Column) -> Column:
    return F.when(test, F.array(issue)).otherwise(F.array().cast("array<struct<code:string,path:string,message:string>>"))


def total_issues(n: Column, edges: Column, vertex_colors: Column, edge_colors: Column, palette: Column | None = None, bound_to: Column | None = None, fingerprint: Column | None = None) -> Column:
    """Array of (code, path, message) against a total colouring, in a fixed order."""
    vc, ec = F.size(vertex_colors), F.size(edge_colors)
    none = F.array().cast("array<struct<code:string,path:string,message:string>>")
    head = [none]
    if bound_to is not None:
        head.append(_when(bound_to != fingerprint, _issue("graph_fingerprint_mismatch", F.lit("graph_fingerprint"), F.lit("certificate is bound to a different numbered graph"))))
    if palette is not None:
        head.append(_when((n + F.size(edges) > 0) & (palette == 0), _issue("empty_palette", F.lit("palette_size"), F.lit("a nonempty set of graph elements requires at least one color"))))
    head.append(_when(vc != n, _issue("vertex_assignment_count", F.lit("vertex_colors"), F.format_string("expected %d vertex colors, got %d", n, vc))))
    head.append(_when(ec != F.size(edges), _issue("edge_assignment_count", F.lit("edge_colors"), F.format_string("expected %d edge colors, got %d", F.size(edges), ec))))
    color_of = lambda v: F.get(vertex_colors, v)

    def by_edge(e: Column, i: Column) -> Column:
        same = (e["u"] < vc) & (e["v"] < vc) & (color_of(e["u"]) == color_of(e["v"]))
        parts = [_when(same, _issue("adjacent_vertices_same_color", F.format_string("edges[%d]", i), F.format_string("adjacent vertices %d and %d share a color", e["u"], e["v"])))]
        for end in (e["u"], e["v"]):
            clash = (i < ec) & (end < vc) & (F.get(edge_colors, i) == color_of(end))
            parts.append(_when(clash, _issue("incident_vertex_edge_same_color", F.format_string("edge_colors[%d]", i), F.format_string("edge %s shares a color with endpoint %d", _pair(e), end))))
        return F.concat(*parts)

    at = F.sequence(F.lit(0), F.size(edges) - 1)

    def by_pair(e: Column, i: Column) -> Column:
        parts = []
        for end in (e["u"], e["v"]):
            first = _first(edges, edge_colors, at, i, end)
            f = F.get(edges, first)
            message = F.format_string("incident edges %s and %s share color %d at vertex %d", _pair(f), _pair(e), F.get(edge_colors, i), end)
            parts.append(_when(first.isNotNull() & (i < ec), _issue("adjacent_edges_same_color", F.format_string("edge_colors[%d]", i), message)))
        return F.concat(*parts)

    body = F.when(F.size(edges) > 0, F.concat(F.flatten(F.transform(edges, by_edge)), F.flatten(F.transform(edges, by_pair)))).otherwise(none)
    return F.concat(*head, body)


def _first(edges: Column, colors: Column, at: Column, i: Column, end: Column) -> Column:
    """The first edge before i at the vertex that has edge i's colour, or null."""
    return F.get(F.filter(at, lambda j: (j < i) & (F.get(colors, j) == F.get(colors, i)) & ((F.get(edges, j)["u"] == end) | (F.get(edges, j)["v"] == end))), F.lit(0))


def edge_issues(n: Column, edges: Column, colors: Column, palette: Column, marked: Column) -> Column:
    """Array of texts against an edge colouring in which marked edges must all differ."""
    at = F.sequence(F.lit(0), F.size(edges) - 1)
    none = F.array().cast("array<string>")
    size = F.when(F.size(colors) != F.size(edges), F.array(F.format_string("expected %d edge colors, found %d", F.size(edges), F.size(colors)))).otherwise(none)
    out = F.transform(F.filter(at, lambda i: ~F.get(colors, i).between(0, palette - 1)), lambda i: F.format_string("edge %d has out-of-range color %d", i, F.get(colors, i)))

    def vertex(v: Column) -> Column:
        clash = F.filter(at, lambda i: ((F.get(edges, i)["u"] == v) | (F.get(edges, i)["v"] == v)) & _first(edges, colors, at, i, v).isNotNull())
        return F.transform(clash, lambda i: F.format_string("edges %d and %d incident with vertex %d both use color %d", _first(edges, colors, at, i, v), i, v, F.get(colors, i)))

    earlier = lambda i: F.get(F.filter(marked, lambda j: (j < i) & (F.get(colors, j) == F.get(colors, i))), F.lit(0))
    rainbow = F.transform(F.filter(marked, lambda i: earlier(i).isNotNull()), lambda i: F.format_string("distinguished edges %d and %d both use color %d", earlier(i), i, F.get(colors, i)))
    body = F.concat(F.flatten(F.transform(F.sequence(F.lit(0), n - 1), vertex)), rainbow)
    return F.when(F.size(size) > 0, size).when(F.size(edges) == 0, none).when(F.size(out) > 0, out).otherwise(body)


def is_total(n: Column, edges: Column, vertex_colors: Column, edge_colors: Column) -> Column:
    """Whether total_issues would find nothing, by counting: at every vertex its own colour and
    those of its edges are all different, and no edge has equally coloured ends."""
    color = lambda i: F.get(edge_colors, i)
    marks = F.concat(F.transform(vertex_colors, lambda c, v: v * 4096 + c), F.transform(edges, lambda e, i: e["u"] * 4096 + color(i)), F.transform(edges, lambda e, i: e["v"] * 4096 + color(i)))
    full = (F.size(vertex_colors) == n) & (F.size(edge_colors) == F.size(edges))
    return full & (F.size(F.array_distinct(marks)) == n + 2 * F.size(edges)) & F.forall(edges, lambda e: F.get(vertex_colors, e["u"]) != F.get(vertex_colors, e["v"]))


def is_rainbow(edges: Column, colors: Column, palette: Column, marked: Column) -> Column:
    """Whether edge_issues would find nothing, by counting."""
    at_ends = F.concat(F.transform(edges, lambda e, i: e["u"] * 4096 + F.get(colors, i)), F.transform(edges, lambda e, i: e["v"] * 4096 + F.get(colors, i)))
    own = F.array_distinct(F.transform(marked, lambda i: F.get(colors, i)))
    return (F.size(colors) == F.size(edges)) & F.forall(colors, lambda c: c.between(0, palette - 1)) & (F.size(F.array_distinct(at_ends)) == 2 * F.size(edges)) & (F.size(own) == F.size(marked))


def assignment_conflicts(rows: DataFrame, colors: str = "assignment") -> Column:
    """Count of conflicts whose two items share a colour."""
    return F.size(F.filter("conflicts", lambda p: F.get(colors, p["i"]) == F.get(colors, p["j"])))


def project_to_total(n: Column, edges: Column, h_edges: Column, pair_edges: Column, colors: Column) -> Column:
    """struct(vertex_colors, edge_colors) of the graph from a rainbow colouring of its auxiliary
    graph: a vertex has the colour of its class edge."""
    of = lambda e: F.get(colors, (F.array_position(h_edges, e) - 1).cast("int"))
    star = lambda v: F.struct(v.alias("u"), n.alias("v"))
    pair = lambda v: F.get(F.filter(pair_edges, lambda e: (e["u"] == v) | (e["v"] == v)), F.lit(0))
    vertex = F.transform(F.sequence(F.lit(0), n - 1), lambda v: of(F.coalesce(pair(v), star(v))))
    return F.struct(vertex.alias("vertex_colors"), F.transform(edges, of).alias("edge_colors"))
