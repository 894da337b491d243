"""Lines on pages are ordered once for chunks, and regions grow without texts."""

import re

import pytest
from pyspark.sql import functions as F

from lectern.operators import layout
from lectern.plans import layout as plans

from oracle import SF, answer, rows
from test_layout import LINES, pages


def _plan(df, which="executedPlan"):
    return getattr(df._jdf.queryExecution(), which)().toString()


def test_chunks_of_lines_are_ordered_once(spark):
    plan = _plan(plans.QUERIES["w8_line_chunks"](spark, SF))
    texts = plan[: plan.index("Union")]  # above where hints come in
    assert len(re.findall(r"Exchange hashpartitioning", texts)) == 1 and len(re.findall(r"- Sort ", texts)) == 1
    assert "Join" not in texts and "collect_list" not in texts


def test_chunks_go_on_from_run_to_run(spark, monkeypatch):
    lines = spark.createDataFrame(pages(60, 3)[0], LINES)
    hints = layout.layout_hints(lines.where("span_index % 9 = 0").select("paper_id", F.array("span_index").alias("spans")), lines.where("span_index % 11 = 0").select("paper_id", F.col("text").alias("heading")))
    want = sorted(tuple(r) for r in layout.line_chunks(lines, *hints).collect())
    monkeypatch.setattr(layout, "PAGES", 1)
    assert sorted(tuple(r) for r in layout.line_chunks(lines, *hints).collect()) == want and want


@pytest.mark.parametrize("name", ["w17_object_regions", "w18_figure_regions"])
def test_regions_read_no_text(spark, name):
    assert "text#" not in _plan(plans.QUERIES[name](spark, SF), "optimizedPlan")


def test_odd_spaces(spark):
    texts = [None, "", " ", "a\n\nb", "a  b", " a\tb\x0bc\fd\re ", "a b", "é  è", "Table\n1: x " * 30]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = docs.select("doc_id", layout.clean(F.col("text")).alias("c"), F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")).alias("w")).collect()
    assert all(r["c"] == r["w"] for r in got)
