"""Personal data by weak supervision, in DataFrame operations only.

Candidates are the base spans, which always stay, and looser ones: matches of the base patterns
that fail their test or are a little short or long, and matches of patterns of their own.  Labelers
vote on each: a pattern test, a gazetteer, the words before it and its edges (1 for, 0 against, -1 none).
Expectation-maximisation over counts of vote patterns estimates the labelers' reliabilities; its
posteriors train a logistic span classifier, which decides on the looser candidates.

The driver sees counts by (kind, votes, size) only, at most 4 * 81 * 6 rows for any corpus.
Texts are read once; the second pass reads a table of spans.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, parts, text_or_empty

KINDS = ["email", "ip", "card", "phone"]
# Fixed values.  The base patterns; a possessive quantifier or a look behind changes no match but
# keeps the matcher from recursing and from scanning a run again from each of its characters.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# The looser patterns.
LOOSE = {
    0: r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[(\[](?:at|AT)[)\]] ?[A-Za-z0-9-]{1,63}(?: ?(?:[(\[](?:dot|DOT)[)\]]|\.) ?[A-Za-z0-9-]{1,63}){1,4}",
    1: r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    2: r"(?<![0-9-])[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}(?![0-9-])",
    3: r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
}
# What the pattern labeler takes for well formed.
ADDRESS = r"^[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9])?(?:@| ?[(\[](?:at|AT)[)\]] ?).*[.)\]] ?[A-Za-z]{2,24}$"
QUAD = r"^(?:(?:0|[1-9][0-9]?|1[0-9][0-9]|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$"
GROUPS = r"^(?:[0-9A-Fa-f]{1,4}(?::|$)){8}$"
NUMBER = r"^(?:\+[1-9][0-9]{0,2}[ .-]?(?:\([0-9]{1,5}\)[ .-]?)?[0-9]{2,5}(?:[ .-]?[0-9]{2,5}){1,4}|\(?[2-9][0-9]{2}\)?[ .-][2-9][0-9]{2}[ .-][0-9]{4})$"
# Gazetteers.
DOMAINS = r"(?i)(?:\.|[(\[]dot[)\]] ?)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$"
RESERVED = r"^(?:0|10|127|169\.254|192\.168|172\.(?:1[6-9]|2[0-9]|3[01])|22[4-9]|2[3-5][0-9])\.|^(?:0{0,3}:|f[cde])"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)"
CODES = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|^\(?[2-9][0-9]{2}"
# Words before a span that speak for each kind, and against any.
CUES = {
    0: r"(?i)mail|contact|kontakt|correo|courriel|write to|schreib",
    1: r"(?i)\bip\b|address|adresse|host|server|client|login",
    2: r"(?i)card|karte|carte|tarjeta|visa|master|amex|payment|credit",
    3: r"(?i)phone|tel\b|tel[.:]|call|fax|mobil|cell|anruf|appel|llam",
}
DOUBTS = r"(?i)version|isbn|issn|order no|invoice|serial|build|release|chapter|section|page \Z"
BEFORE = 40
THRESHOLD = 0.5
VOTES = ["pattern", "gazetteer", "context", "edges"]


def _spans(found: Column) -> Column:
    """Array of (s, e, t), matches with start and end in code points, from (m, p): the matches and the
    pieces between them."""
    none = F.array().cast("array<struct<s:int,e:int,t:string>>")

    def step(state: Column, i: Column) -> Column:
        start = state["at"] + F.length(F.element_at(found["p"], i))
        text = F.element_at(found["m"], i)
        end = start + F.length(text)
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(start.alias("s"), end.alias("e"), text.alias("t")))).alias("out"))

    n = F.size(found["m"])
    first = F.struct(F.lit(0).alias("at"), none.alias("out"))
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), first, step)["out"]).otherwise(none)


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check of cards."""

    def value(i: Column) -> Column:
        v = F.ascii(F.substring(digits, -i, F.lit(1))) - 48
        return F.when(i % 2 == 0, F.when(v > 4, v * 2 - 9).otherwise(v * 2)).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def _only_valid(kind: int, spans: str) -> Column:
    return F.filter(spans, lambda x: _valid(kind, x["t"]))


def _near_misses(kind: int, spans: str) -> Column:
    return F.filter(spans, lambda x: ~_valid(kind, x["t"]) & _nearly(kind, x["t"]))


def _clear_of(spans: str, *others: str) -> Column:
    """The spans that meet none of the others."""
    meets = lambda x, other: F.exists(other, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
    return F.filter(spans, lambda x: ~reduce(lambda a, b: a | b, [meets(x, o) for o in others]))


def _all_candidates(text: Column, kind: int, base: bool, spans) -> Column:
    return F.transform(spans, lambda x: _candidate(text, kind, base, x))


def _valid(kind: int, t: Column) -> Column:
    n = F.length(_digits(t))
    if kind == 1:
        return F.forall(F.split(t, r"\."), lambda x: (F.length(F.regexp_replace(x, "^0+", "")) <= 3) & (F.coalesce(F.right(x, F.lit(9)).try_cast("int"), F.lit(0)) <= 255))
    if kind == 2:
        return F.when(n.between(13, 19), luhn(_digits(t))).otherwise(False)
    if kind == 3:
        return n.between(9, 15)
    return F.lit(True)


def _nearly(kind: int, t: Column) -> Column:
    """Whether a match that isn't valid is a candidate all the same."""
    n = F.length(_digits(t))
    return {0: F.lit(False), 1: F.lit(True), 2: n.between(12, 19), 3: n.between(7, 16)}[kind]


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, 0).otherwise(-1)


def _shape(kind: int, t: Column) -> Column:
    """The pattern labeler, the same test for base and looser candidates."""
    if kind == 2:
        return _vote(_digits(t).rlike("^.{13,19}$") & luhn(_digits(t)), F.lit(True))
    if kind == 1:
        return _vote(t.rlike(QUAD) | t.rlike(GROUPS), F.lit(True))
    return _vote(t.rlike(ADDRESS if kind == 0 else NUMBER), F.lit(True))


def _candidate(text: Column, kind: int, base: bool, x: Column) -> Column:
    t = x["t"]
    before = F.substring(text, F.greatest(F.lit(1), x["s"] + 1 - BEFORE), F.least(x["s"], F.lit(BEFORE)))
    near = F.concat(F.right(before, F.lit(1)), F.substring(text, x["e"] + 1, F.lit(1)))
    gazetteer = {
        0: _vote(t.rlike(DOMAINS), F.lit(True)), 1: _vote(~F.lower(t).rlike(RESERVED), F.lit(True)),
        2: _vote(_digits(t).rlike(ISSUERS), F.lit(True)), 3: _vote(t.rlike(CODES), F.lit(True)),
    }[kind]
    return F.struct(
        F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), F.lit(base).alias("base"), _shape(kind, t).alias("pattern"), gazetteer.alias("gazetteer"),
        _vote(before.rlike(CUES[kind]), before.rlike(DOUBTS)).alias("context"), _vote(~near.rlike("[A-Za-z0-9]"), F.lit(True)).alias("edges"), F.least(F.lit(5), F.floor((x["e"] - x["s"]) / 8).cast("int")).alias("size"),
    )


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): all candidates of every row with their votes, written to the shared folder."""
    rows = parts(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    text = F.col("text")
    may = {0: text.contains("@"), 1: text.rlike(r"[0-9]\.[0-9]"), 2: text.rlike(r"[0-9][\x20-]?[0-9]"), 3: text.contains("+")}
    also = {0: text.rlike(r"[(\[](?:at|AT)[)\]]"), 1: text.rlike("[0-9A-Fa-f]:[0-9A-Fa-f]"), 2: text.rlike(r"[0-9]{4}[ -][0-9]{4}[ -]"), 3: text.rlike("[ .-][0-9]{3}[ .-][0-9]{4}")}
    strict = {0: EMAIL, 1: IP, 2: CARD, 3: PHONE}
    for k in range(4):
        for name, when, pattern in ((f"b{k}", may[k], strict[k]), (f"l{k}", also[k], LOOSE[k])):
            pair = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern).alias("p"))
            rows = rows.withColumn(name, F.when(when, pair))
    none = F.array().cast("array<struct<s:int,e:int,t:string>>")
    rows = rows.select("doc_id", "text", *[F.when(F.col(n).isNotNull(), _spans(F.col(n))).otherwise(none).alias(n) for k in range(4) for n in (f"b{k}", f"l{k}")])
    rows = rows.select("doc_id", "text", *[_only_valid(k, f"b{k}").alias(f"b{k}") for k in range(4)], *[f"l{k}" for k in range(4)], *[_near_misses(k, f"b{k}").alias(f"n{k}") for k in range(4)])
    rows = rows.withColumn("base", F.flatten(F.array(*[F.transform(f"b{k}", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))) for k in range(4)])))
    own = [_all_candidates(text, k, True, f"b{k}") for k in range(4)]
    # A looser pattern goes before a near miss that it meets: it says more.
    loose = [_clear_of(f"l{k}", "base") for k in range(4)]
    missed = [_clear_of(f"n{k}", "base", f"l{k}") for k in range(4)]
    more = [_all_candidates(text, k, False, F.concat(loose[k], missed[k])) for k in range(4)]
    return cut(rows.select("doc_id", F.flatten(F.array(*own, *more)).alias("spans")), "spans")


def reliabilities(counts: list[tuple[int, tuple[int, ...], int]], rounds: int = 100) -> tuple[list[float], list[list[float]], dict]:
    """counts of (kind, votes): expectation-maximisation for two classes.

    Returns the share of true spans by kind, each labeler's chances of voting for when the span is
    true and when it's false, and the posterior of every (kind, votes)."""
    n = max((len(v) for _, v, _ in counts), default=0)
    prior, hit = [0.5] * len(KINDS), [[0.8, 0.3] for _ in range(n)]
    post: dict = {}
    for _ in range(rounds):
        for kind, votes, _n in counts:
            a, b = math.log(prior[kind]), math.log(1 - prior[kind])
            for (p, q), v in zip(hit, votes, strict=True):
                if v >= 0:
                    a += math.log(p if v else 1 - p)
                    b += math.log(q if v else 1 - q)
            post[kind, votes] = 1 / (1 + math.exp(min(50, max(-50, b - a))))
        for k in range(len(KINDS)):
            all_k = sum(c for kind, _, c in counts if kind == k)
            prior[k] = (1 + sum(c * post[kind, v] for kind, v, c in counts if kind == k)) / (2 + all_k)
        for i in range(n):
            one = [[1.6, 2.0], [0.6, 2.0]]  # a labeler is held to be better than chance
            for kind, votes, c in counts:
                if votes[i] >= 0:
                    for j, w in enumerate((post[kind, votes], 1 - post[kind, votes])):
                        one[j][0] += c * w * votes[i]
                        one[j][1] += c * w
            hit[i] = [min(0.99, max(0.01, a / b)) for a, b in one]
    return prior, hit, post


def _inputs(kind: int, votes: tuple[int, ...], size: int) -> list[float]:
    return [1.0, *(float(kind == k) for k in range(len(KINDS))), *(float(v == x) for v in votes for x in (1, 0)), size / 5]


def _solve(matrix: list[list[float]], right: list[float]) -> list[float]:
    """The solution of a small positive definite system, by elimination."""
    rows = [[*m, r] for m, r in zip(matrix, right, strict=True)]
    n = len(rows)
    for i in range(n):
        for j in range(i + 1, n):
            f = rows[j][i] / rows[i][i]
            rows[j] = [a - f * b for a, b in zip(rows[j], rows[i], strict=True)]
    out = [0.0] * n
    for i in reversed(range(n)):
        out[i] = (rows[i][n] - sum(rows[i][j] * out[j] for j in range(i + 1, n))) / rows[i][i]
    return out


def fit_classifier(rows: list[tuple[int, tuple[int, ...], int, int]], rounds: int = 50, ridge: float = 1e-4) -> list[float]:
    """rows: (kind, votes, size, count).  Logistic weights over ``_inputs``, fitted to the posteriors
    by Newton's method."""
    merged: dict = {}
    for kind, votes, _, c in rows:
        merged[kind, votes] = merged.get((kind, votes), 0) + c
    _, _, post = reliabilities([(k, v, c) for (k, v), c in sorted(merged.items())])
    x = [_inputs(kind, votes, size) for kind, votes, size, _ in rows]
    total = sum(c for *_, c in rows)
    w = [0.0] * len(_inputs(0, (0,) * len(VOTES), 0))
    for _ in range(rounds if total else 0):
        grad, curve = [ridge * v for v in w], [[ridge * (i == j) for j in range(len(w))] for i in range(len(w))]
        for xs, (kind, votes, _, c) in zip(x, rows, strict=True):
            p = 1 / (1 + math.exp(-min(50, max(-50, sum(a * b for a, b in zip(w, xs, strict=True))))))
            g, h = c / total * (p - post[kind, votes]), c / total * max(p * (1 - p), 1e-6)
            on = [i for i, v in enumerate(xs) if v]
            for i in on:
                grad[i] += g * xs[i]
                for j in on:
                    curve[i][j] += h * xs[i] * xs[j]
        step = _solve(curve, grad)
        w = [a - min(2.0, max(-2.0, b)) for a, b in zip(w, step, strict=True)]
        if max(map(abs, step)) < 1e-6:
            break
    return w


def _probability(w: list[float], x: Column) -> Column:
    z = F.lit(w[0])
    terms = [*(x["kind"] == k for k in range(len(KINDS))), *(x[v] == y for v in VOTES for y in (1, 0))]
    for weight, term in zip(w[1:-1], terms, strict=True):
        z = z + F.when(term, weight).otherwise(0.0)
    return 1 / (1 + F.exp(-(z + w[-1] * x["size"] / 5)))


def find(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, spans, base) for every row: arrays of (kind, s, e) ordered by kind and start; kind
    is a place in KINDS, offsets are code points with the end exclusive.

    A null text counts as empty and has no spans.  Repeated rows each keep a row; a null doc_id
    stays null.  An empty table gives an empty result; other columns are ignored.
    """
    found = candidates(docs)
    rows = found.select(F.explode("spans").alias("x")).groupBy("x.kind", *[f"x.{v}" for v in VOTES], "x.size").count().collect()
    model = fit_classifier(sorted((r["kind"], tuple(r[v] for v in VOTES), r["size"], r["count"]) for r in rows))
    kept = F.filter("spans", lambda x: x["base"] | (_probability(model, x) >= threshold))
    place = lambda a: F.array_sort(F.transform(a, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"))))
    return found.select("doc_id", place(kept).alias("spans"), place(F.filter("spans", lambda x: x["base"])).alias("base"))


def count_of(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def as_text(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")
