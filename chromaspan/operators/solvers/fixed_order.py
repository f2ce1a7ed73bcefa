"""Backtracking in a fixed order: most neighbours first, all colours at every level."""

from __future__ import annotations

import time

from collections.abc import Sequence


def search(items: int, colours: int, conflicts: Sequence[tuple[int, int]], fixed: Sequence[tuple[int, int]] = (), max_nodes: int | None = None, max_seconds: float | None = None) -> tuple[str, list[int] | None, int, int]:
    """(status, colours by item or None, nodes, backtracks).  A node is a level entered anew, a
    backtrack a level left for good; without open items there is one node."""
    around = [0] * items
    for a, b in conflicts:
        around[a] |= 1 << b
        around[b] |= 1 << a
    given = dict(fixed)
    if any(a in given and b in given and given[a] == given[b] for a, b in conflicts):
        return "candidate_unsat", None, 0, 0
    order = sorted((i for i in range(items) if i not in given), key=lambda i: (-bin(around[i]).count("1"), i))
    #: Items of each colour, as masks.
    holds = [0] * colours
    for i, c in given.items():
        holds[c] |= 1 << i
    if not order:
        return "witness", [given[i] for i in range(items)], 1, 0
    chosen: list[int] = []
    nodes, backtracks, start, entering = 0, 0, 0, True
    end = None if max_seconds is None else time.monotonic() + max_seconds
    while True:
        if max_nodes is not None and nodes >= max_nodes or end is not None and time.monotonic() >= end:
            return "unknown", None, nodes, backtracks
        item = order[len(chosen)]
        nodes += entering
        c = next((c for c in range(start, colours) if not holds[c] & around[item]), None)
        if c is not None:
            holds[c] |= 1 << item
            chosen.append(c)
            if len(chosen) == len(order):
                found = given | dict(zip(order, chosen, strict=True))
                return "witness", [found[i] for i in range(items)], nodes, backtracks
            start, entering = 0, True
            continue
        backtracks += 1
        if not chosen:
            return "candidate_unsat", None, nodes, backtracks
        c = chosen.pop()
        holds[c] &= ~(1 << order[len(chosen)])
        start, entering = c + 1, False
