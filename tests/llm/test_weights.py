"""Target weights of the mix at all levels, against a plain budget by hand."""

from collections import defaultdict

import pytest

from chromaspan.llm import mixing

SCHEMA = "domain string, lang string, source string, tokens long"


def brute(supply, share, epochs, weights):
    """Budgets from the root down: siblings in order of supply over weight; a full one leaves the rest to the others."""
    weigh = lambda level, name: weights.get(level, {}).get(name, mixing.OTHER)
    given = {(): int(sum(supply.values()) * share)}
    for depth, level in enumerate(mixing.PATH):
        caps = defaultdict(int)
        for path, tokens in supply.items():
            caps[path[: depth + 1]] += tokens * epochs
        for parent in {p[:-1] for p in caps}:
            rest, nodes = given[parent], sorted((p for p in caps if p[:-1] == parent), key=lambda p: (caps[p] / weigh(level, p[-1]), p[-1]))
            while nodes:
                left = sum(weigh(level, p[-1]) for p in nodes)
                if caps[nodes[0]] * left > rest * weigh(level, nodes[0][-1]):
                    break
                given[nodes[0]] = caps[nodes[0]]
                rest -= caps[nodes.pop(0)]
            left = sum(weigh(level, p[-1]) for p in nodes)
            for p in nodes:
                given[p] = rest * weigh(level, p[-1]) // left
    return {p: given[p] for p in supply}


SUPPLY = {(f"d{d}", lang, f"src{s}"): 10 + 997 * (d + 1) * (s * s + 1) % 5000 for d in range(3) for lang in ("en", "de", "xx") for s in range(4)}


@pytest.mark.parametrize("weights", [{}, mixing.WEIGHTS, {"domain": {"d0": 50, "d1": 1}}, {"source": {"src0": 100, "src3": 1}, "lang": {"xx": 40}}, {"domain": {"d2": 7}, "lang": {"en": 1, "de": 99}, "source": {"src1": 1000}}, {"source": {}}])
@pytest.mark.parametrize("share", [0.1, 0.8, 1.9])
def test_budgets(spark, weights, share):
    rows = spark.createDataFrame([(*k, v) for k, v in SUPPLY.items()], SCHEMA)
    got = {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(rows, share, 2, weights).collect()}
    assert got == brute(SUPPLY, share, 2, weights)


@pytest.mark.parametrize("weights, text", [({"langs": {}}, "no level langs"), ({"lang": {"en": 0}}, "lang 'en'"), ({"lang": {"en": 1.5}}, "1.5"), ({"source": {"a": True}}, "True"), ({"domain": {3: 4}}, "domain 3"), ({"domain": {"d0": 10**7}}, "1,000,000")])
def test_weights_are_checked(spark, weights, text):
    docs = spark.createDataFrame([(1, "a b", "en", "src1")], "doc_id long, text string, lang string, source string")
    with pytest.raises(ValueError, match=text):
        mixing.mix(docs, weights=weights)


def test_shortage_goes_to_siblings_first(spark):
    """A source that runs short leaves its share to sources of its language before other languages get any."""
    supply = {("d0", "en", "src0"): 10, ("d0", "en", "src1"): 1000, ("d0", "de", "src2"): 1000}
    rows = spark.createDataFrame([(*k, v) for k, v in supply.items()], SCHEMA)
    got = {r.source: r.budget for r in mixing.budgets(rows, 0.5, 1, {"source": {"src0": 100, "src1": 1}}).collect()}
    assert got == {"src0": 10, "src1": 492, "src2": 502}
