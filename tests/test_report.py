"""Marked texts and blocks of evidence, by hand and against a plain version in Python."""

import html
import re

from pyspark.sql import functions as F

from lectern.functions import text
from lectern.functions import report
from lectern.operators import aggregates, ranking


def _words(s):
    return {w for w in re.findall("[a-z0-9]+", s.lower()) if len(w) >= 3}


def _best(raw, claim):
    """Sentence, start and end by splitting as one would by hand."""
    best, at = ("", None, None, 0), 0
    for m in [*re.finditer(r"(?<=[.!?])\s+|\n+", raw), None]:
        piece = raw[at : m.start() if m else len(raw)]
        hits = len(_words(piece) & _words(claim))
        if hits > best[3]:
            start = at + len(piece) - len(piece.lstrip())
            best = (piece.strip(), start, start + len(piece.strip()), hits)
        at = m.end() if m else 0
    return best[:3]


def test_best_sentence_at(spark):
    cases = [
        ("One two. Three four!  Five\n\n six seven", "seven eight six"), ("\n\nalpha beta.\tgamma", "gamma"), ("same words. same words.", "words"), ("", "any"), (None, "any"), ("any", None), (" .  ", "x"), ("naïve café. über straße one", "one"),
        ("a. b. ccc ddd" * 2000, "ddd"), ("<b> & 'q' \"word\"", "word"),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, raw string, claim string").withColumn("best", report.best_sentence_at(F.col("raw"), F.col("claim")))
    got = df.select("i", "best.*", report.marked(F.col("raw"), F.col("best.sentence")).alias("html")).orderBy("i").collect()
    for row, (raw, claim) in zip(got, cases, strict=True):
        sentence, start, end = _best(raw or "", claim or "")
        assert (row["sentence"], row["start"], row["end"]) == (sentence, start, end)
        first = (raw or "").find(sentence)
        esc = html.escape
        expected = esc(raw or "") if not sentence else f"{esc(raw[:first])}<mark>{esc(sentence)}</mark>{esc(raw[first + len(sentence):])}"
        assert row["html"] == expected


def test_marked_all(spark):
    hit = "array<struct<start:int,end:int,label:string>>"
    cases = [
        ("a<b. c&d. e", [(5, 9, "C2"), (0, 4, "C1")], "<mark>[C1] a&lt;b.</mark> <mark>[C2] c&amp;d.</mark> e"),
        ("abcdef", [(0, 2, "C1"), (0, 4, "C2"), (3, 6, "C3"), (4, 6, "C4")], "<mark>[C2] abcd</mark><mark>[C4] ef</mark>"), ("x'y", [], "x&#x27;y"), ("x", None, "x"), (None, None, ""),
    ]
    df = spark.createDataFrame(cases, f"raw string, hits {hit}, expected string")
    assert all(r[0] == r[1] for r in df.select(report.marked_all(F.col("raw"), F.col("hits")), "expected").collect())


def test_evidence_without_values(spark):
    none = "cast(null as struct<figure_summary:string,key_observations:array<string>,possible_verification_use:array<string>,needs_precise_ocr:boolean>)"
    nulls = [F.lit(None).cast(t) for t in ("string", "int", "string", "boolean", "double", "string", "string", "string")]
    rows = spark.range(1).select(*(report.evidence_item(F.lit(1), F.lit(k), *nulls, F.expr(none)).alias(str(k)) for k in ("table", "figure", None)), report.evidence_block(F.array().cast("array<string>")).alias("block"))
    got = rows.first()
    assert got["table"] == "[Evidence E1 | Type: Table]\nSection: unknown\nPage: ?\nContent:\n(No extracted table text available)"
    assert got["figure"] == "[Evidence E1 | Type: Figure]\nSection: unknown\nPage: ?\nContent:\n(No extracted figure context available)"
    assert got["None"] == "[Evidence E1 | Type: Text]\nSection: unknown\nPage: ?\nContent:\n(No text available)" and got["block"] == "(No evidence items retrieved.)"


def test_poor_pages(spark):
    spans = spark.createDataFrame([(1, " abc "), (1, None), (2, "long enough"), (3, "12345678"), (None, "x")], "page int, text string")
    got = {r["page"]: r["quality"] for r in aggregates.poor_pages(spans, ["page"], "text").collect()}
    assert got == {1: 1.5, None: 1.0} and aggregates.poor_pages(spans.limit(0), ["page"], "text").count() == 0


def test_figure_answers(spark):
    full = '{"figure_type": " Heatmap", "figure_summary": " s ", "key_observations": ["a", "", null, "d"], "possible_verification_use": [1, " u ", "z"], "needs_precise_ocr": true}'
    none = ("other", "", [], [], False)
    cases = [
        (full, ("heatmap", "s", ["a"], ["1", "u"], True)), (f"```JSON\n{full}\n```", ("heatmap", "s", ["a"], ["1", "u"], True)), (f"Sure: {full} - done", ("heatmap", "s", ["a"], ["1", "u"], True)),
        ('{"figure_type": "pie", "key_observations": "x", "needs_precise_ocr": "Yes "}', ("other", "", [], [], True)), ('{"figure_summary": "' + "y" * 500 + '", "needs_precise_ocr": "no"}', ("other", "y" * 400, [], [], False)),
        ('{"figure_type": null, "needs_precise_ocr": 1}', ("other", "", [], [], True)), ("no answer", none), ("", none), (None, none), ('{"figure_type": "heatmap"', none), ("[1, 2]", none), ("{}", none),
        ('{"key_observations": ["' + "k" * 300 + '"]}', ("other", "", ["k" * 200], [], False)),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, raw string")
    got = {r["i"]: tuple(r["a"]) for r in df.select("i", report.figure_answer(F.col("raw")).alias("a")).collect()}
    assert got == {i: c[1] for i, c in enumerate(cases)}


def test_seed_candidates(spark):
    rows = spark.createDataFrame([(1, " " + "a" * 149 + " b ", "T"), (2, "{title}", None), (3, " ", "T"), (4, None, "T")], "id int, abstract string, name string")
    got = {(r["id"], r["i"]): r["body"] for r in ranking.seed_candidates(rows, ["{title}: {excerpt}", "{excerpt}?"], "abstract", "name").collect()}
    assert got == {(1, 1): "T: " + "a" * 149 + "...", (1, 2): "a" * 149 + "...?", (2, 1): "this topic: {title}", (2, 2): "{title}?"}


def test_long_texts_are_cleaned_once(spark):
    df = spark.createDataFrame([("a  b " * 9,), (None,), ("x",)], "t string").select(text.truncated(F.col("t"), 10).alias("t"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
    assert [r["t"] for r in df.collect()] == ["a b a b...", "", "x"]
