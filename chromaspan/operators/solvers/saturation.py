"""Saturation-order search (Brelaz, 1979) with counted nodes and backtracks.

State is kept by increments: for every item, how many coloured neighbours use each colour.  The
item chosen has most blocked colours, then most neighbours, then the least number; an item with no
colour left ends the choice at once.  With symmetry breaking a search level tries the colours in
use and the first unused one.
"""

from __future__ import annotations

import time


def search(items: int, colours: int, conflicts: list[tuple[int, int]], fixed: list[tuple[int, int]] = (), max_nodes: int | None = None, max_seconds: float | None = None) -> tuple[str, list[int] | None, int, int]:
    """(status, colours by item or None, nodes, backtracks); the status is witness, candidate_unsat
    or unknown (a limit on nodes or seconds was reached)."""
    near: list[set[int]] = [set() for _ in range(items)]
    for i, j in conflicts:
        near[i].add(j)
        near[j].add(i)
    colour = [-1] * items
    blocks = [[0] * colours for _ in range(items)]
    blocked, in_use = [0] * items, [0] * colours

    def put(i: int, c: int) -> None:
        colour[i] = c
        in_use[c] += 1
        for j in near[i]:
            blocks[j][c] += 1
            blocked[j] += blocks[j][c] == 1

    def take(i: int) -> None:
        c, colour[i] = colour[i], -1
        in_use[c] -= 1
        for j in near[i]:
            blocks[j][c] -= 1
            blocked[j] -= blocks[j][c] == 0

    for i, c in fixed:
        put(i, c)
    if any(colour[i] >= 0 and colour[i] == colour[j] for i, j in conflicts):
        return "candidate_unsat", None, 0, 0
    pinned = {c for _, c in fixed}
    symmetric = not pinned or pinned == set(range(len(pinned)))

    def options(i: int) -> list[int]:
        free = [c for c in range(colours) if not blocks[i][c]]
        if not symmetric:
            return free
        fresh = next((c for c in range(colours) if not in_use[c]), None)
        return [c for c in free if in_use[c]] + [c for c in free if c == fresh]

    nodes = backtracks = 0
    trail: list[tuple[int, list[int]]] = []
    end = None if max_seconds is None else time.monotonic() + max_seconds
    while True:
        if max_nodes is not None and nodes >= max_nodes or end is not None and time.monotonic() >= end:
            return "unknown", None, nodes, backtracks
        nodes += 1
        open_items = [i for i in range(items) if colour[i] < 0]
        if not open_items:
            return "witness", list(colour), nodes, backtracks
        dead = next((i for i in open_items if blocked[i] == colours), None)
        if dead is None:
            item = max(open_items, key=lambda i: (blocked[i], len(near[i]), -i))
            left = options(item)
            if left:
                put(item, left[0])
                trail.append((item, left[1:]))
                continue
        backtracks += 1
        while trail:
            item, left = trail.pop()
            take(item)
            if left:
                put(item, left[0])
                trail.append((item, left[1:]))
                break
            backtracks += 1
        else:
            return "candidate_unsat", None, nodes, backtracks
