"""Rules on claims, captions, boxes and artifacts, on rows made by hand."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import evidence as ev
from lectern.operators import aggregates, windows


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_reference_boost(spark):
    rows = [
        ("see Tab. 3", "table", "Table 3", None, None), ("see Table 3", "figure", " table 3", None, None), ("Section 3.2.1 says", "text_chunk", None, "3.2.1", None), ("Section 3.2.1 says", "text_chunk", None, "3.2", None),
        ("Section 3.2.1 says", "text_chunk", None, "3.2.11", None), ("Sec. 4 says", None, None, None, "In Section 4.1"), (None, "table", "Table 3", "1", "x"), ("Table 3.1", "table", "Table 3", None, None),
    ]
    got = values(spark, rows, "c string, k string, l string, n string, s string", ev.reference_boost(*map(F.col, "cklns")))
    assert [g[0] for g in got] == [1.0, 0.9, 0.7, 0.4, 0.0, 0.7, 0.0, 0.0]


def test_cues_and_labels(spark):
    rows = [("As shown in the plot", "Fig. 2"), ("see the text", "fig. 2 "), ("Figure 2 and Fig. 3", "fig. 3"), (None, None)]
    got = values(spark, rows, "c string, l string", ev.lexical_gate(F.col("c")), ev.names_figure(F.col("c")), ev.label_matches(F.col("l"), ev.explicit_labels(F.col("c"), "figure")), ev.prefers_figure(F.col("c")))
    assert got == [(True, False, False, False), (False, False, False, False), (True, True, True, True), (False, False, False, False)]


@pytest.mark.parametrize(("line", "inline", "heading", "section", "capitals", "start"), [
    ("Table 8, respectively.", True, False, False, False, False), ("Figure 3 also shows more", True, False, False, False, False), ("Table 1: Results", False, False, False, False, False), ("3.1 Ablation", False, True, True, True, False),
    ("Related Work", False, True, True, False, False), ("RESULTS", False, False, True, True, False), ("Finally, we stop", False, False, False, False, False), ("We evaluate all", False, False, False, False, True), (None, False, False, False, False, False),
])
def test_lines(spark, line, inline, heading, section, capitals, start):
    s = F.col("s")
    got = values(spark, [(line,)], "s string", ev.inline_reference(s), ev.heading_like(s), ev.section_heading(s), ev.caption_heading(s), ev.paragraph_start(s))[0]
    assert got[:4] == (inline, heading, section, capitals) and got[4] == start


def test_boxes(spark):
    rows = [('{"detected_bbox":[1,2,3,4],"dino_x":1}',), ('{"caption_bbox":[5,300,60,310]}',), ('{"caption_bbox":[5,30,60,50]}',), ("{}",), ("nonsense",), (None,)]
    box = ev.figure_box(F.col("m"), F.lit(None).cast("array<double>"))
    got = values(spark, rows, "m string", ev.box_source(F.col("m")), box["source"], box["box"])
    assert got == [("groundingdino", "detected_bbox", [1, 2, 3, 4]), ("unknown", "caption_fallback", [5, 200, 60, 310]), ("unknown", "caption_fallback", [5, 0, 60, 50]), ("unknown", "none", None), ("unknown", "none", None), ("unknown", "none", None)]
    assert values(spark, [("[1,2,3,4]",), ("[1,2]",), ("x",), (None,)], "s string", ev.parsed_box(F.col("s"))) == [([1, 2, 3, 4],), (None,), (None,), (None,)]


def test_artifacts(spark):
    rows = [("",), (None,), ("TODO: x",), ("https://github.com/test-mode-only/r/blob/main/a",), ("https://github.com/Own/Repo/blob/main/a",), ("https://github.com/own/other/blob/main/a",)]
    got = values(spark, rows, "u string", ev.artifact_failure(F.col("u"), F.lit("github"), F.lit("https://github.com/own/repo"), "own/repo"))
    assert [g[0] for g in got] == ["empty", "empty", "placeholder", "test_mode", None, "other_repository"]
    text = ev.verdict_artifact(F.lit("p"), F.lit("7"), F.lit("body"), F.col("c"))
    got = values(spark, [(["1", "2"],), ([],)], "c array<string>", F.size(ev.cited_comments(text)), ev.posted_body(F.concat(F.lit("[DRY-RUN — not posted]\n"), F.lit("x "))))
    assert got == [(2, "x"), (0, "x")]


def test_keys_and_tools(spark):
    assert values(spark, [('["a", 1, " "]',), (" a, b ,",), (None,), ("[broken",)], "r string", ev.chunk_keys(F.col("r"))) == [(["a", "1"],), (["a", "b"],), ([],), (["[broken"],)]
    rows = [("Bash", '{"command":" ls "}'), ("Grep", '{"query":"q"}'), ("Other", '{"x":1}'), ("Read", "{}")]
    assert [v[0] for v in values(spark, rows, "n string, a string", ev.tool_summary(F.col("n"), F.col("a")))] == ["ls", "q", '{"x":1}', ""]


def test_ranks_and_statistics_in_parts(spark):
    rows = [(i % 3, (i * 7919) % 1000, i) for i in range(3000)] + [(9, 5, 10000)]
    df = spark.createDataFrame(rows, "k long, v long, i long").repartition(7)
    got = windows.ranked_in_parts(df, ["k"], [F.expr("div(v, 100)")], ["v", "i"], "place").collect()
    for k in (0, 1, 2, 9):
        own = sorted((r["v"], r["i"], r["place"]) for r in got if r["k"] == k)
        assert [p for _, _, p in own] == list(range(1, len(own) + 1))
    for r in aggregates.ordered_statistics(df, ["k"], "v").collect():
        v = sorted(x for k, x, _ in rows if k == r["k"])
        assert (r["n"], r["median"], r["p95"]) == (len(v), v[len(v) // 2], v[max(0, int(len(v) * 0.95) - 1)])


def test_a_missing_score_fails(spark):
    df = spark.createDataFrame([("https://x/y", None, 3, True), ("https://x/y", 10.0, 3, True), ("https://x/y", 10.5, 3, True), ("", None, 3, True)], "url string, score double, cited int, eligible boolean")
    assert [r[0] for r in df.select(ev.verdict_failure(*map(F.col, df.columns))).collect()] == ["score", None, "score", "url"]
