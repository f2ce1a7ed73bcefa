"""Table functions to be called with LATERAL: rows that SQL asks for, one call a row of the other table."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators.search import lazily


@udtf(returnType="partition_index int, idx array<int>, covered array<int>", useArrow=True)
class ComplementMatchings:
    """complement_matchings(n, edges, size): the matchings of ``size`` edges of the complement, in the order of the
    indices of their edges; none for a null or negative argument.  Edges are structs or arrays of two ends."""

    def eval(self, n: int, edges: list, size: int) -> Iterator[tuple]:
        if n is None or edges is None or size is None or size < 0:
            return
        held = {(min(e[0], e[1]), max(e[0], e[1])) for e in edges}
        free = [(u, v) for u in range(n) for v in range(u + 1, n) if (u, v) not in held]
        place = {e: i for i, e in enumerate(free)}
        for k, chosen in enumerate(lazily(free, size)):
            yield k, [place[e] for e in chosen], sorted(v for e in chosen for v in e)


def register(spark: SparkSession) -> None:
    """Makes the functions known to a session's SQL."""
    spark.udtf.register("complement_matchings", ComplementMatchings)
