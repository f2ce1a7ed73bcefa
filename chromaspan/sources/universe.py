"""A Python data source of all graphs of an order up to isomorphism, by canonical augmentation.

A graph gets a vertex more; the child is taken only if the new vertex is one that a canonical rule
would take away again (McKay, 1998), and once for each class of rooted children of one parent.  So
every class comes from exactly one parent, and a task that owns some graphs of a smaller order
makes what descends from them without knowing what other tasks make.

A graph is the mask of its edges, pairs numbered by columns of the upper triangle as in graph6.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Up to this order a task makes all graphs and keeps its share, so that graph_id counts 0, 1, 2, ...
DENSE = 6
MOST = 9


def _pairs(n: int) -> list[tuple[int, int]]:
    return [(u, v) for v in range(1, n) for u in range(v)]


def _rows(mask: int, n: int) -> list[int]:
    near = [0] * n
    for k, (u, v) in enumerate(_pairs(n)):
        if mask >> k & 1:
            near[u] |= 1 << v
            near[v] |= 1 << u
    return near


def _mask(near: list[int], order: list[int]) -> int:
    """The mask of a graph whose vertex order[i] is called i."""
    m = k = 0
    for v in range(1, len(order)):
        row = near[order[v]]
        for u in range(v):
            m |= (row >> order[u] & 1) << k
            k += 1
    return m


def _refine(near: list[int], colour: list[int]) -> list[int]:
    """The coarsest equitable colouring below colour, numbered in an order that relabelling keeps."""
    n, classes = len(near), len(set(colour))
    while True:
        masks = [0] * classes
        for v, c in enumerate(colour):
            masks[c] |= 1 << v
        keys = [(colour[v], *[(near[v] & m).bit_count() for m in masks]) for v in range(n)]
        rank = {k: i for i, k in enumerate(sorted(set(keys)))}
        colour = [rank[k] for k in keys]
        if len(rank) == classes:
            return colour
        classes = len(rank)


def _are_twins(near: list[int], v: int, w: int) -> bool:
    """Whether swapping v and w changes no edge."""
    both = 1 << v | 1 << w
    return near[v] & ~both == near[w] & ~both


def _least(near: list[int], colour: list[int]) -> int:
    """The least mask among the labellings that refinement and choices within classes lead to."""
    colour = _refine(near, colour)
    n = len(near)
    cells: list[list[int]] = [[] for _ in range(max(colour, default=-1) + 1)]
    for v in range(n):
        cells[colour[v]].append(v)
    cell = min((c for c in cells if len(c) > 1), key=len, default=None)
    if cell is None:
        return _mask(near, [c[0] for c in cells])
    tried: list[int] = []
    best: int | None = None
    for v in cell:
        if any(_are_twins(near, v, w) for w in tried):
            continue
        tried.append(v)
        # v goes before the others of its class.
        found = _least(near, _dense([2 * c + (c == colour[v] and w != v) for w, c in enumerate(colour)]))
        best = found if best is None else min(best, found)
    return best or 0


def _dense(colour: list[int]) -> list[int]:
    rank = {c: i for i, c in enumerate(sorted(set(colour)))}
    return [rank[c] for c in colour]


def certificate(mask: int, n: int) -> int:
    """Equal for two graphs just if they are isomorphic."""
    near = _rows(mask, n)
    return _least(near, _dense([x.bit_count() for x in near]))


def _rooted(near: list[int], colour: list[int], root: int) -> int:
    return _least(near, _dense([2 * c + (v == root) for v, c in enumerate(colour)]))


def children(near: list[int]) -> Iterator[list[int]]:
    """The graphs with a vertex more, one for each class, that belong to this parent."""
    k = len(near)
    degree = [x.bit_count() for x in near]
    seen: set[int] = set()
    for mask in range(1 << k):
        size = mask.bit_count()
        # The vertex to take away has the largest degree.
        if any(d + (mask >> u & 1) > size for u, d in enumerate(degree)):
            continue
        child = [x | (mask >> u & 1) << k for u, x in enumerate(near)] + [mask]
        colour = _refine(child, _dense([x.bit_count() for x in child]))
        top = max(colour)
        if colour[k] != top:
            continue
        own = _rooted(child, colour, k)
        if own in seen:
            continue
        rivals = [v for v in range(k) if colour[v] == top and not _are_twins(child, v, k)]
        if all(_rooted(child, colour, v) <= own for v in rivals):
            seen.add(own)
            yield child


def descendants(near: list[int], order: int) -> Iterator[list[int]]:
    if len(near) >= order:
        yield near
        return
    for child in children(near):
        yield from descendants(child, order)


def graphs_of(n: int) -> list[int]:
    """Masks of all graphs on n vertices, one for each class."""
    return [_mask(near, list(range(n))) for near in descendants([], n)]


class _Shard(InputPartition):
    def __init__(self, order: int, shard: int, shards: int, split: int) -> None:
        super().__init__((order, shard, shards, split))


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        number = lambda name, default: int(options.get(name, str(default)))
        self.order, self.shards = number("order", 4), number("shards", 1)
        self.shard = number("shard", -1)
        self.split = number("split", max(0, self.order - 2))
        self.low, self.high = number("mindegree", 0), number("maxdegree", self.order)
        self.connected = str(options.get("connected", "false")).lower() == "true"
        if not 0 <= self.order <= MOST or self.shards < 1 or not -1 <= self.shard < self.shards or not 0 <= self.split <= self.order:
            raise ValueError(f"order is 0 to {MOST}, shards at least 1, shard one of them and split at most the order")

    def partitions(self) -> list[InputPartition]:
        wanted = range(self.shards) if self.shard < 0 else [self.shard]
        return [_Shard(self.order, i, self.shards, self.split) for i in wanted]

    @staticmethod
    def _joined(near: list[int]) -> bool:
        reached, last = 1, 0
        while reached != last:
            last = reached
            for v, x in enumerate(near):
                if last >> v & 1:
                    reached |= x
        return reached == (1 << max(1, len(near))) - 1

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        order, shard, shards, split = partition.value
        if order <= DENSE:
            share = ((i, g) for i, g in enumerate(descendants([], order)) if i % shards == shard)
        else:
            bases = (b for b in enumerate(descendants([], split)) if b[0] % shards == shard)
            share = ((i << 32 | j, g) for i, base in bases for j, g in enumerate(descendants(base, order)))
        for graph_id, near in share:
            degrees = [x.bit_count() for x in near] or [0]
            if min(degrees) >= self.low and max(degrees) <= self.high and (not self.connected or self._joined(near)):
                yield graph_id, order, [{"u": u, "v": v} for u in range(order) for v in range(u + 1, order) if near[u] >> v & 1]


class GraphUniverse(DataSource):
    """Options: order, shards, shard (only that one), split (the order whose graphs are dealt to the
    shards), connected, mindegree, maxdegree.

    graph_id is the same however many shards there are: 0, 1, 2, ... up to order 6; above, the number
    of the graph of order ``split`` that it descends from, times 2 ** 32, plus its place among those
    that do."""

    @classmethod
    def name(cls) -> str:
        return "graph_universe"

    def schema(self) -> str:
        return "graph_id long, n int, edges array<struct<u:int,v:int>>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
