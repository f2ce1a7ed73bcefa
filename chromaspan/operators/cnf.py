"""One-hot pairwise clauses of a colouring problem, and their DIMACS text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.graphs import let
from . import verify

#: Fixed value: the encoder's name in DIMACS comments.
ENCODER = "onehot-pairwise-v1"


def clauses(items: Column, colours: Column, conflicts: Column, fixed: Column) -> Column:
    """Array of clauses, each an array of literals: for every item one of its colours and then no
    two of them, then the conflicts by colour, then the fixed colours."""
    var = lambda i, c: 1 + i * colours + c
    palette = F.sequence(F.lit(0), colours - 1)
    at_most = lambda i: F.flatten(F.transform(palette, lambda a: F.transform(F.filter(palette, lambda b: b > a), lambda b: F.array(-var(i, a), -var(i, b)))))
    by_item = F.flatten(F.transform(F.sequence(F.lit(0), items - 1), lambda i: F.concat(F.array(F.transform(palette, lambda c: var(i, c))), at_most(i))))
    by_conflict = F.flatten(F.transform(conflicts, lambda p: F.transform(palette, lambda c: F.array(-var(p["i"], c), -var(p["j"], c)))))
    return F.concat(by_item, by_conflict, F.transform(fixed, lambda f: F.array(var(f["item"], f["color"]))))


def dimacs(items: Column, colours: Column, found: Column, problem_digest: Column) -> Column:
    line = lambda c: F.concat(F.array_join(F.transform(c, lambda x: x.cast("string")), " "), F.lit(" 0"))
    head = F.concat_ws("\n", F.concat(F.lit(f"c encoder {ENCODER}\nc problem_sha256 "), problem_digest), F.format_string("p cnf %d %d", items * colours, F.size(found)))
    return F.concat(head, F.lit("\n"), F.array_join(F.transform(found, line), "\n"), F.lit("\n"))


def decode(items: Column, colours: Column, model: Column) -> Column:
    """Colours by item from positive literals; null unless every item has exactly one."""
    mine = lambda i: F.filter(model, lambda x: (x > i * colours) & (x <= (i + 1) * colours))
    each = F.transform(F.sequence(F.lit(0), items - 1), mine)
    return F.when(F.forall(each, lambda m: F.size(m) == 1), F.transform(each, lambda m, i: F.get(m, F.lit(0)) - 1 - i * colours))


def judged(n: Column, edges: Column, colours: Column, model: Column) -> Column:
    """What a model of a graph's total problem is: undecodable, improper where a verifier that knows nothing of clauses
    finds an issue in the colouring that it says, or verified."""
    items = n + F.size(edges)
    halves = lambda found: F.struct(F.slice(found, F.lit(1), n).alias("v"), F.slice(found, n + 1, F.size(edges)).alias("e"))
    issues = lambda c: F.when(c["v"].isNull(), "undecodable").when(F.size(verify.total_issues(n, edges, c["v"], c["e"], colours)) > 0, "improper").otherwise("verified")
    return let(let(decode(items, colours, model), halves), issues)
