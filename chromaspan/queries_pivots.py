"""Queries over dependency states that orders make: lines are columns, parts modulo eight their sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators.solve import spread
from .plans import pivots
from .queries import query

MOST = 2

STATES = """mask AS (SELECT l_orderkey // 4 AS state_id, CAST(l_linenumber AS INTEGER) AS t, CAST(bit_or(1 << CAST(l_partkey % 8 AS INTEGER)) AS INTEGER) AS s FROM lineitem WHERE l_partkey % 8 <> l_linenumber GROUP BY ALL),
st AS (SELECT state_id, 0 AS root, list(t ORDER BY t) AS t, list(s ORDER BY t) AS s FROM mask GROUP BY state_id)"""


def _reach(gone: str) -> str:
    return f"list_reduce(list_concat([1 << root], flatten(list_transform(range(1, len(t) + 1), lambda k: range(1, len(t) + 1)))), lambda acc, i: CAST(acc | CASE WHEN s[i] & acc <> 0 AND t[i] <> {gone} THEN 1 << t[i] ELSE 0 END AS BIGINT))"


ROBUST = " OR ".join(f"(len(t) >= {c} AND s[{c}] & ~{_reach(f't[{c}]')} = 0)" for c in (1, 2))


def order_states(spark, sf):
    """A state of four orders: column i has the target l_linenumber and the sources l_partkey modulo 8 of such lines, but for the
    target itself.  The root is 0; the first two columns are mobile."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.expr("l_orderkey div 4").alias("state_id"), F.col("l_linenumber").cast("int").alias("t"), (F.col("l_partkey") % 8).cast("int").alias("v")).where("v <> t")
    masks = lines.groupBy("state_id", "t").agg(F.bit_or(pivots.bit(F.col("v"))).alias("s"))
    rows = spread(masks.groupBy("state_id").agg(F.sort_array(F.collect_list(F.struct("t", "s"))).alias("c")), "state_id")
    mobile = F.slice(F.sequence(F.lit(0), F.size("c") - 1), 1, 2)
    return rows.select("state_id", F.lit(8).alias("w"), F.lit(0).alias("root"), F.col("c.t").alias("targets"), F.col("c.s").alias("sources"), mobile.alias("mobile"))


@query(f"""WITH {STATES} SELECT state_id, CAST(len(t) AS INTEGER) AS columns, {_reach('-1')} = 255 AS reachable, {ROBUST} AS robust,
  array_to_string(list_transform(range(8), lambda v: len(list_filter(s, lambda m: m & (1 << v) <> 0))), ',') AS outdegrees FROM st""")
def order_dependencies(spark, sf):
    found = pivots.judged(order_states(spark, sf))
    return found.select("state_id", F.size("targets").alias("columns"), "reachable", "robust", F.array_join(F.col("outdegrees").cast("array<string>"), ",").alias("outdegrees"))


@query(f"""WITH RECURSIVE {STATES}, go AS (SELECT state_id, 0 AS depth, root, t, s FROM st
  UNION SELECT state_id, depth + 1, t[c], list_transform(t, lambda v, i: CASE WHEN i = c THEN root ELSE v END), list_transform(s, lambda m, i: CAST(CASE WHEN i = c THEN xor(m, 1 << root) | (1 << t[c]) ELSE m END AS INTEGER)) FROM go, range(1, 8) r(c) WHERE depth < {MOST} AND c <= len(t) AND s[c] & (1 << root) <> 0),
ok AS (SELECT state_id, min(depth) AS depth FROM go WHERE {ROBUST} GROUP BY state_id)
SELECT st.state_id, ok.depth FROM st LEFT JOIN ok ON ok.state_id = st.state_id""")
def order_pivots(spark, sf):
    """Least numbers of pivots, up to two, that make the orders' states robust."""
    return pivots.depths(order_states(spark, sf), MOST).select("state_id", "depth")
