"""Graphs of lines, against Python, and how often their words are looked for."""

from jobs.lines import graphs_of

TEXTS = [
    None, "", "\n\n", "one", "a bb ccc dddd", "a\tbb\r\n\t ccc  dddd \r ccc\r\nxx", "aaaaaaaaa a a a", "  lead bb ccc dddd eeeee\n\nlead bb ccc dddd eeeee", "a bb ccc", "éé a \U0001f600 bb ccc", "a b cc ddd e\x0bf gggg\x0c",
]


def python_graphs(order, least):
    found = {}
    for doc, text in enumerate(TEXTS):
        for line in (text or "").split("\n"):
            v = [len(w) % order for w in line.replace("\t", " ").replace("\r", " ").split(" ") if w]
            edges = tuple(sorted({(min(p), max(p)) for p in zip(v, v[1:]) if p[0] != p[1]}))
            if len(v) >= least and edges:
                lines, first = found.get(edges, (0, doc))
                found[edges] = lines + 1, min(first, doc)
    return sorted((e, *x) for e, x in found.items())


def test_graphs_are_those_of_python(spark):
    rows = spark.createDataFrame([(i, t, " " if i % 2 else None) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string")
    for order, least in ((8, 4), (5, 2), (3, 1)):
        got = graphs_of(rows, order, least).collect()
        assert {(r["lang"], r["n"]) for r in got} == {("und", order)}
        assert sorted((tuple((e["u"], e["v"]) for e in r["edges"]), r["lines"], r["first_doc"]) for r in got) == python_graphs(order, least)


def test_words_of_a_line_are_made_once(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = graphs_of(rows, 8, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 2  # a text's lines, a line's words
