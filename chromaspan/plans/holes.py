"""Partial total colourings with one uncoloured edge, analysed on tables.

A state is a row: id columns, n, edges, vc, ec (null at the hole), palette, r, x and y, the hole's ends, alpha, and
``at``, for each vertex and colour the neighbour that the edge of this colour leads to, or -1.  Everything that is
told about a state is an expression over its own row: a two-colour path is a fold that follows ``at``, so a plan has
no shuffle beyond the one that built the graphs, and its work is the number of states times their paths.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import verify

INTS = "array<int>"
#: What ``with_fans`` reads of a state beside its id columns.
STATE = ["n", "edges", "vc", "ec", "palette", "r", "x", "y", "alpha", "at"]


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def adjacency(n: Column, edges: Column, ec: Column, palette: Column) -> Column:
    """The neighbour at [vertex * palette + colour], or -1.  Colours are proper; edges with a null colour are left out."""
    coloured = F.filter(F.arrays_zip(edges.alias("e"), ec.alias("c")), lambda z: z["c"].isNotNull())
    each = lambda use: F.transform(coloured, use)
    keys = F.concat(each(lambda z: z["e"]["u"] * palette + z["c"]), each(lambda z: z["e"]["v"] * palette + z["c"]))
    found = F.map_from_arrays(keys, F.concat(each(lambda z: z["e"]["v"]), each(lambda z: z["e"]["u"])))
    return _let(found, lambda m: F.transform(F.sequence(F.lit(0), n * palette - 1), lambda k: F.coalesce(F.try_element_at(m, k), F.lit(-1))))


def states(coloured: DataFrame) -> DataFrame:
    """coloured(graph_id, n, edges, vc, ec, palette), total colourings -> a state for every edge as the hole.

    r is palette - 2; alpha is the least colour on edges of both ends of the hole, null if there is none."""
    p = F.col("palette")
    full = coloured.select("graph_id", "n", "edges", "vc", "ec", "palette", adjacency(F.col("n"), F.col("edges"), F.col("ec"), p).alias("full"))
    full = full.select("*", F.posexplode("edges").alias("hole", "e"))
    h = F.get("ec", F.col("hole"))
    at = F.transform("full", lambda w, k: F.when((k == F.col("x") * p + h) | (k == F.col("y") * p + h), -1).otherwise(w))
    rows = full.withColumns({"x": F.col("e.u"), "y": F.col("e.v"), "r": p - 2}).withColumn("at", at)
    rows = rows.withColumn("ec", F.transform("ec", lambda c, i: F.when(i != F.col("hole"), c)))
    both = F.filter(F.sequence(F.lit(0), p - 1), lambda c: (_next(F.col("x"), c) >= 0) & (_next(F.col("y"), c) >= 0))
    return rows.withColumn("alpha", F.get(both, F.lit(0))).select("graph_id", *STATE)


def _next(v: Column, c: Column) -> Column:
    return F.get("at", v * F.col("palette") + c)


def is_missing(v: Column, c: Column) -> Column:
    return (_next(v, c) == -1) & (F.get("vc", v) != c)


def missing(v: Column) -> Column:
    """Sorted colours that neither the vertex nor an edge there has."""
    return F.filter(F.sequence(F.lit(0), F.col("palette") - 1), lambda c: is_missing(v, c))


def degree(v: Column) -> Column:
    return F.size(F.filter("edges", lambda e: (e["u"] == v) | (e["v"] == v)))


def path(v: Column, first: Column, then: Column) -> Column:
    """Vertices of the walk from v by first, then, first, ... to its end, where v hasn't an edge of colour then."""

    def step(seen: Column, i: Column) -> Column:
        w = _next(F.element_at(seen, -1), F.when(i % 2 == 1, first).otherwise(then))
        return F.when((F.size(seen) == i) & (w >= 0), F.concat(seen, F.array(w))).otherwise(seen)

    return F.aggregate(F.sequence(F.lit(1), F.col("n")), F.array(v), step)


def closure(center: Column, root: Column) -> Column:
    """Sorted satellites: neighbours of the centre in the least set with the root that takes a neighbour in when the colour of
    its edge to the centre is missing at a member."""
    spokes = F.filter(F.sequence(F.lit(0), F.col("palette") - 1), lambda c: _next(center, c) >= 0)

    def grow(inside: Column, _: Column) -> Column:
        taken = F.filter(spokes, lambda c: F.exists(inside, lambda z: is_missing(z, c)))
        return F.array_union(inside, F.transform(taken, lambda c: _next(center, c)))

    return F.array_sort(F.array_except(F.aggregate(F.sequence(F.lit(1), F.col("n")), F.array(root), grow), F.array(root)))


def fans(rows: DataFrame) -> DataFrame:
    """states -> two rows each, with center, root, satellites, surplus and aligned: whether the satellites' colours are those
    missing at the centre."""
    ends = F.explode(F.array(*[F.struct(F.col(a).alias("center"), F.col(b).alias("root")) for a, b in (("x", "y"), ("y", "x"))]))
    found = rows.select("*", ends.alias("fan")).select("*", "fan.*").drop("fan")
    found = found.withColumn("satellites", closure(F.col("center"), F.col("root")))
    surplus = F.aggregate("satellites", F.col("r") - degree(F.col("root")), lambda s, v: s + F.col("r") - 1 - degree(v))
    colours = F.array_sort(F.array_distinct(F.transform("satellites", lambda v: F.get("vc", v))))
    return found.withColumns({"surplus": surplus, "aligned": colours == missing(F.col("center"))})


def scope_issues(rows: DataFrame) -> DataFrame:
    """states -> with issues, the codes against the profile of a paired-hole residue, in a fixed order."""
    x, y, r = F.col("x"), F.col("y"), F.col("r")
    upto = F.sequence(F.lit(0), F.col("n") - 1)
    rows = rows.withColumns({"degrees": F.transform(upto, degree), "sx": closure(x, y), "sy": closure(y, x), "a": missing(x), "b": missing(y)})
    in_core = lambda v: F.get("degrees", v) == r
    core_edges = F.filter("edges", lambda e: in_core(e["u"]) & in_core(e["v"]))
    crowded = F.exists(upto, lambda v: F.size(F.filter(core_edges, lambda e: (e["u"] == v) | (e["v"] == v))) > 1)
    class_size = lambda v: F.size(F.filter("vc", lambda c: c == F.get("vc", v)))
    own = F.array(F.get("vc", x), F.get("vc", y), F.col("alpha"))
    pairs = (F.size("a") == 2) & (F.size("b") == 2)
    roles = F.concat("a", "b", own)
    surplus = lambda root, sats: F.aggregate(sats, r - degree(root), lambda s, v: s + r - 1 - degree(v))
    colour_to = lambda center, v: F.get(F.filter(F.sequence(F.lit(0), F.col("palette") - 1), lambda c: _next(center, c) == v), F.lit(0))

    def identity(center: Column, sats: Column, wanted: Column) -> Column:
        return F.array_sort(F.array_distinct(F.transform(sats, lambda v: colour_to(center, v)))) != wanted

    def profile(center: Column, sats: Column, wanted: Column) -> Column:
        def other(v: Column) -> Column:
            rest = F.array_except(wanted, F.array(colour_to(center, v)))
            return missing(v) != F.array_sort(F.array_union(F.array(F.get("vc", center)), rest))

        return F.exists(sats, other)

    tests = [  # fixed values: the codes
        ("palette_not_r_plus_two", F.col("palette") != r + 2), ("maximum_degree_mismatch", F.array_max("degrees") != r), ("hole_edge_not_in_degree_core", ~(in_core(x) & in_core(y))),
        ("degree_core_not_matching", crowded), ("alpha_used_on_vertex", F.array_contains("vc", F.col("alpha"))), ("vertex_color_class_too_large", F.exists(upto, lambda v: class_size(v) > 2)),
        ("fan_closure_not_q_two", (F.size("sx") != 2) | (F.size("sy") != 2)), ("fan_surplus_not_zero", (surplus(y, "sx") != 0) | (surplus(x, "sy") != 0)),
        ("endpoint_missing_sets_not_pairs", ~pairs), ("color_roles_not_pairwise_disjoint", pairs & (F.size(F.array_distinct(roles)) < 7)),
        ("degree_parameter_below_two_sided_minimum", pairs & (r < 5)), ("fan_edge_color_identity", pairs & (identity(x, "sx", F.col("b")) | identity(y, "sy", F.col("a")))),
        ("satellite_missing_profile", pairs & (profile(x, "sx", F.col("b")) | profile(y, "sy", F.col("a")))),
    ]
    return rows.withColumn("issues", F.array_compact(F.array(*[F.when(test, code) for code, test in tests]))).drop("degrees", "sx", "sy", "a", "b")


def recoloured(walk: Column, a: Column, b: Column, last: Column | None = None, fill: Column | None = None) -> Column:
    """Edge colours after the colours a and b of the walk's edges change places; with ``last`` its last edge has this
    colour instead, with ``fill`` the hole has that."""

    def new(e: Column, i: Column) -> Column:
        c, p, q = F.get("ec", i), F.array_position(walk, e["u"]), F.array_position(walk, e["v"])
        on = (p > 0) & (q > 0) & (F.abs(p - q) == 1) & c.isin(a, b)
        value = F.when(on, a + b - c).otherwise(c)
        if last is not None:
            value = F.when(on & (F.greatest(p, q) == F.size(walk)), last).otherwise(value)
        if fill is not None:
            value = F.when((e["u"] == F.least("x", "y")) & (e["v"] == F.greatest("x", "y")), fill).otherwise(value)
        return value

    return F.transform("edges", new)


def _holds(new: Column) -> Column:
    """Whether the verifier has nothing against these edge colours; an edge without one is judged by its ends alone."""
    proper = F.forall("edges", lambda e: F.get("vc", e["u"]) != F.get("vc", e["v"]))
    coloured = _let(new, lambda ec: F.filter(F.arrays_zip(F.col("edges").alias("e"), ec.alias("c")), lambda z: z["c"].isNotNull()))
    return proper & _let(coloured, lambda z: verify.is_total(F.col("n"), z["e"], F.col("vc"), z["c"]))


def _ended(rows: DataFrame) -> DataFrame:
    """rows with walk, first, then -> with length, terminal, before, locked (the colour that a swap would give the last edge is
    the terminal's own), common (colours missing at both last vertices of a locked walk) and slack: by how much
    the degrees of these two exceed the least sum that a locked walk without a common colour can have."""
    length = F.size("walk") - 1
    rows = rows.withColumns({"length": length, "terminal": F.element_at("walk", -1), "before": F.get("walk", length - 1)})
    swapped = F.when(F.col("length") % 2 == 1, F.col("then")).otherwise(F.col("first"))
    rows = rows.withColumn("locked", (F.col("length") > 0) & (F.get("vc", F.col("terminal")) == swapped))
    t, s = F.col("terminal"), F.col("before")
    open_at = lambda v: ((v == F.col("x")) | (v == F.col("y"))).cast("int")
    least = F.col("r") + F.when(F.col("length") == 1, 1).otherwise(2) + open_at(s) + open_at(t)
    return rows.withColumns({"common": F.when(F.col("locked"), F.array_intersect(missing(s), missing(t))), "slack": F.when(F.col("locked"), degree(s) + degree(t) - least)})


def crossings(rows: DataFrame) -> DataFrame:
    """states -> for each colour a missing at x alone and b missing at y alone, and each end of the hole: side, relation (linked
    if the walk of these colours joins both ends, else distinct), length, locked, slack, exit (swapping the walk frees a colour
    for the hole) and releases, the number of colours whose use on the locked walk's last edge lets the rest swap.

    Every exit and release is judged by the verifier on the completed colouring."""
    rows = rows.withColumns({"ma": missing(F.col("x")), "mb": missing(F.col("y"))})
    rows = rows.withColumn("a", F.explode(F.array_except("ma", "mb"))).withColumn("b", F.explode(F.array_except("mb", "ma"))).drop("ma", "mb")
    side = lambda v, far, first, then: F.struct(F.col(v).alias("side"), F.col(far).alias("far"), F.col(first).alias("first"), F.col(then).alias("then"))
    rows = rows.withColumn("s", F.explode(F.array(side("x", "y", "b", "a"), side("y", "x", "a", "b")))).select("*", "s.*").drop("s")
    rows = _ended(rows.withColumn("walk", path(F.col("side"), F.col("first"), F.col("then"))))
    linked, a, b, fill = F.col("terminal") == F.col("far"), F.col("a"), F.col("b"), F.col("first")
    exits = ~linked & _holds(recoloured(F.col("walk"), a, b, fill=fill))
    frees = F.size(F.filter("common", lambda c: _holds(recoloured(F.col("walk"), a, b, last=c, fill=fill))))
    releases = F.when(~linked & F.col("locked") & (F.col("length") >= 2), frees).otherwise(0)
    return rows.withColumns({"relation": F.when(linked, "linked").otherwise("distinct"), "exit": exits, "releases": releases})


def blockages(rows: DataFrame) -> DataFrame:
    """states -> for every colour beta that the hole's ends have or miss, and every vertex among the ends and satellites that
    misses it: hole, length, blocked (the walk by alpha and beta ends at a vertex of colour beta), linked (or at another such
    hole), slack and releases, the number of colours that free alpha at the hole.  States without alpha give no rows."""
    x, y = F.col("x"), F.col("y")
    rows = rows.withColumn("special", F.array_distinct(F.concat(F.array(x, y), closure(x, y), closure(y, x))))
    roles = F.array_distinct(F.concat(F.array(F.get("vc", x), F.get("vc", y)), missing(x), missing(y)))
    # Tests of alpha and of a column that is exploded would be pushed to where these are made, and make them again there.
    rows = rows.withColumn("beta", F.explode(F.when(F.col("alpha").isNotNull(), roles)))
    rows = rows.withColumn("hole", F.explode(F.filter("special", lambda v: is_missing(v, F.col("beta")))))
    rows = _ended(rows.withColumns({"first": F.col("alpha"), "then": F.col("beta")}).withColumn("walk", path(F.col("hole"), F.col("first"), F.col("then"))))
    blocked = F.col("locked") & (F.get("vc", F.col("terminal")) == F.col("beta"))
    frees = F.size(F.filter("common", lambda c: _holds(recoloured(F.col("walk"), F.col("alpha"), F.col("beta"), last=c))))
    linked = (F.col("length") > 0) & F.array_contains("special", F.col("terminal")) & is_missing(F.col("terminal"), F.col("beta"))
    return rows.withColumns({"blocked": blocked, "linked": linked, "releases": F.when(blocked & (F.col("length") >= 3), frees).otherwise(0)})


def verdicts(rows: DataFrame, key: list[str]) -> DataFrame:
    """states -> a row for each: numbers of walks blocked, releases, linked colour pairs, exits and releases across, and status,
    the first of one_swap_exit, cross_terminal_release, alpha_terminal_release and blocked that they allow.

    Numbers of rows with the same key meet in one aggregation with partial sums."""
    names = ["blocked", "releases", "linked", "exits", "cross_releases"]
    zero = {c: F.lit(0) for c in names}
    own = lambda found, **said: found.select(*key, *[said.get(c, zero[c]).cast("long").alias(c) for c in names])
    every = own(rows).unionByName(own(blockages(rows), blocked=F.col("blocked"), releases=F.col("releases")))
    once = F.col("side") == F.col("x")
    every = every.unionByName(own(crossings(rows), linked=once & (F.col("relation") == "linked"), exits=F.col("exit"), cross_releases=F.col("releases")))
    found = every.groupBy(*key).agg(*[F.sum(c).alias(c) for c in names])
    ladder = F.when(F.col("exits") > 0, "one_swap_exit").when(F.col("cross_releases") > 0, "cross_terminal_release").when(F.col("releases") > 0, "alpha_terminal_release").otherwise("blocked")
    return found.withColumn("status", ladder)


def _component(v: Column, a: Column, b: Column) -> Column:
    """Sorted vertices of v's component by edges of two colours."""

    def grow(inside: Column, _: Column) -> Column:
        near = F.flatten(F.transform(inside, lambda z: F.array(_next(z, a), _next(z, b))))
        return F.array_union(inside, F.filter(near, lambda w: w >= 0))

    return F.array_sort(F.aggregate(F.sequence(F.lit(2), F.col("n")), F.array(v), grow))


def _swaps(rows: DataFrame, starts: Column, a: str, b: str, name: str) -> DataFrame:
    """states with two colours a and b -> a row for each component that meets ``starts`` and whose swap clashes with no vertex, with
    its least vertex as ``name`` and ``at`` after the swap.  A component is a row once, whatever vertices it has."""
    f, g, p = F.col(a), F.col(b), F.col("palette")
    rows = rows.withColumn("part", F.explode(F.array_distinct(F.transform(starts, lambda v: _component(v, f, g))))).where(F.size("part") > 1)
    clash = F.exists("part", lambda v: ((F.get("vc", v) == f) & (_next(v, g) >= 0)) | ((F.get("vc", v) == g) & (_next(v, f) >= 0)))
    rows = rows.where(~clash).withColumn(name, F.element_at("part", 1))

    def moved(w: Column, k: Column) -> Column:
        v, c = F.floor(k / p).cast("int"), k % p
        return F.when(~F.array_contains("part", v), w).when(c == f, _next(v, g)).when(c == g, _next(v, f)).otherwise(w)

    return rows.withColumn("at", F.transform("at", moved)).drop("part")


def _colours(at: Column, fill: Column) -> Column:
    """Edge colours as told by ``at``, with the hole's."""
    p = F.col("palette")

    def told(e: Column) -> Column:
        c = F.get(F.filter(F.sequence(F.lit(0), p - 1), lambda c: F.get(at, e["u"] * p + c) == e["v"]), F.lit(0))
        return F.coalesce(c, fill)

    return F.transform("edges", told)


def orbit_exits(rows: DataFrame) -> DataFrame:
    """states -> a row for every way to free a colour for the hole by two swaps: first_a, first_b and at, the least vertex of the
    first component; second_a, second_b and then_at; fill; completed, verified edge colours; and for what the first swap
    did to the second pair: relation_before and relation_after of the hole's ends (coincident or distinct) and
    detached: the first swap parted them.

    The first pair is alpha with a colour that an end has or misses, or a pair across; the second is a pair across, its
    component meets the hole, and it shares just one colour with the first.  A state has at most 10 first pairs when
    its ends miss two colours each, so the frontier is bounded by the state's own size."""
    x, y = F.col("x"), F.col("y")
    rows = rows.withColumns({"ma": missing(x), "mb": missing(y)})
    pair = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
    across = F.flatten(F.transform("ma", lambda a: F.transform(F.filter("mb", lambda b: b != a), lambda b: pair(a, b))))
    roles = F.array_distinct(F.concat(F.array(F.get("vc", x), F.get("vc", y)), "ma", "mb"))
    alphas = F.transform(F.filter(roles, lambda c: c != F.col("alpha")), lambda c: pair(F.col("alpha"), c))
    rows = rows.withColumn("across", F.array_distinct(across)).withColumn("one", F.explode(F.array_distinct(F.concat(alphas, "across"))))
    rows = rows.withColumns({"first_a": F.col("one.a"), "first_b": F.col("one.b"), "before": F.col("at")}).drop("one", "ma", "mb")
    rows = _swaps(rows, F.sequence(F.lit(0), F.col("n") - 1), "first_a", "first_b", "first_at")
    shared = lambda t: t["a"].isin(F.col("first_a"), F.col("first_b")).cast("int") + t["b"].isin(F.col("first_a"), F.col("first_b")).cast("int")
    rows = rows.withColumn("two", F.explode(F.filter("across", lambda t: shared(t) == 1)))
    rows = rows.withColumns({"second_a": F.col("two.a"), "second_b": F.col("two.b")}).drop("two", "across")
    joined = lambda: F.when(F.array_contains(_component(x, F.col("second_a"), F.col("second_b")), y), "coincident").otherwise("distinct")
    rows = rows.withColumn("relation_after", joined()).withColumns({"after": F.col("at"), "at": F.col("before")}).withColumn("relation_before", joined()).withColumn("at", F.col("after")).drop("before", "after")
    rows = _swaps(rows, F.array("x", "y"), "second_a", "second_b", "then_at")
    rows = rows.withColumn("fill", F.explode(F.array_intersect(missing(x), missing(y))))
    rows = rows.withColumn("completed", _colours(F.col("at"), F.col("fill"))).where(_holds(F.col("completed")))
    return rows.withColumn("detached", (F.col("relation_before") == "coincident") & (F.col("relation_after") == "distinct"))
