"""Graphs gathered as bits are those gathered as sets of pairs."""

import random

import pytest

from chromaspan.sources.families import BITS, from_pairs, from_remainders, graphs


@pytest.mark.parametrize("n", [1, 2, 6, 8, BITS, BITS + 1])
def test_bits_are_pairs(spark, n):
    """Remainders of negative numbers, loops, repeats and nulls."""
    some = random.Random(n)
    rows = [(some.randrange(60), some.choice([None, *range(1 - n, n)]), some.randrange(1 - n if k % 3 else 0, n)) for k in range(600)]
    pairs = spark.createDataFrame(rows, "graph_id long, a long, b long").repartition(3)
    bits, sets = from_remainders(pairs, n), from_pairs(pairs, n)
    assert bits.schema.simpleString() == sets.schema.simpleString()
    assert sorted(map(repr, bits.collect())) == sorted(map(repr, sets.collect()))


def test_rows_of_a_graph_add_up_in_place(spark):
    plan = graphs(spark, "/root/testdata/sf0.001", 6, 4)._jdf.queryExecution().sparkPlan().toString()
    assert "HashAggregate" in plan and "ObjectHashAggregate" not in plan and "SortAggregate" not in plan
