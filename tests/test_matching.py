from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lectern.operators import matching


def test_similarity(spark):
    pairs = [("The red fox ran.", "the  red fox runs"), ("a", ""), (None, "x"), ("same", "same")]
    got = spark.createDataFrame(pairs, "a string, b string").select(matching.similarity(F.col("a"), F.col("b"))).toPandas().iloc[:, 0].tolist()
    words = 3 / 5
    assert got == pytest.approx([0.7 * SequenceMatcher(None, "the red fox ran.", "the red fox runs").ratio() + 0.3 * words, 0, 0, 1.0])


def test_bound_holds(spark):
    texts = ["alpha beta gamma", "alpha", "beta gamma delta epsilon zeta", "x y z", "gamma beta alpha", "", "the same words, the same words"]
    rows = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    a, b = F.col("a"), F.col("b")
    got = rows.select(matching.bound(a, b).alias("most"), matching.similarity(a, b).alias("real"), matching.similarity(a, b, 0.5).alias("cut")).collect()
    for r in got:
        assert r["real"] <= r["most"] + 1e-12 and (r["cut"] == r["real"] or (r["most"] < 0.5 and r["cut"] < 0.5))


def test_quote_spans(spark):
    rows = [("q", 1, 1, "alpha beta gamma delta", "zzz"), ("q", 1, 2, "alpha beta gamma delta", "alpha beta"), ("q", 1, 3, "alpha beta gamma delta", "gamma delta"), ("q", 2, 1, "alpha beta gamma delta", "0123456789")]
    got = matching.quote_spans(spark.createDataFrame(rows, "id string, page int, position int, quote string, text string"), ["id"], top=1)
    assert [(r["page"], r["position"]) for r in got.where("chosen").orderBy("page", "position").collect()] == [(1, 2), (1, 3)]


def line(i, text, top, page=1, left=10.0, section="s"):
    return ("p", page, i, section, text, [left, top, left + 100, top + 10])


def test_captions(spark):
    lines = [
        line(0, "Body text.", 0.0), line(1, "Table 1: Results of", 20.0), line(2, "all runs.", 32.0), line(3, "Far below.", 90.0), line(4, "Figure 2. A map", 120.0), line(5, "Table 3: next", 132.0), line(6, "4 Conclusion", 144.0),
        line(0, "Fig. 2: the same map, longer", 5.0, page=2), line(1, "shifted", 17.0, page=2, left=90.0), line(0, "nothing here", 5.0, page=3),
    ]
    spans = spark.createDataFrame(lines, "paper_id string, page_num int, span_index int, section string, text string, box array<double>")
    found = matching.captions(spans)
    got = {(r["page_num"], r["label"], r["n_spans"], r["text"]) for r in found.collect()}
    assert got == {(1, "Table 1", 2, "Table 1: Results of all runs."), (1, "Figure 2", 1, "Figure 2. A map"), (1, "Table 3", 1, "Table 3: next"), (2, "Figure 2", 1, "Fig. 2: the same map, longer")}
    best = {(r["label"], r["page_num"]) for r in matching.best_captions(found).collect()}
    assert best == {("Table 1", 1), ("Figure 2", 2), ("Table 3", 1)}


def test_captions_need_no_python(spark):
    """A line may jump, move aside, be too long, name another section or begin as prose; pages are not grouped in Python."""
    lines = [
        line(0, "Table 1: a", 0.0), line(3, "too far down the list", 12.0), line(4, "Table 2: b", 30.0), line(5, "x" * 261, 42.0), line(6, "Table 3: c", 60.0, section="s"), line(7, "other section", 72.0, section="t"),
        line(8, "Table 4: d", 90.0, section=None), line(9, "one", 102.0), line(10, "two", 114.0), line(11, "three", 126.0), line(12, "four", 138.0), line(13, "Table 5: " + "y" * 250, 150.0), line(14, "z" * 240, 162.0), line(15, "w" * 10, 174.0),
    ]
    spans = spark.createDataFrame(lines, "paper_id string, page_num int, span_index int, section string, text string, box array<double>")
    found = matching.captions(spans)
    assert "InPandas" not in found._jdf.queryExecution().toString()
    got = {r["label"]: (r["first_span"], r["n_spans"], r["box"]) for r in found.collect()}
    assert got == {f"Table {i}": (s, n, [10.0, t, 110.0, t + 10 + 12 * (n - 1)]) for i, s, n, t in ((1, 0, 1, 0.0), (2, 4, 1, 30.0), (3, 6, 1, 60.0), (4, 8, 4, 90.0), (5, 13, 1, 150.0))} | {"Table 5": (13, 2, [10.0, 150.0, 110.0, 172.0])}
