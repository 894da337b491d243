"""Truth tables and edges of the rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lectern.functions import geometry as geo
from lectern.functions import rules
from lectern.functions import text as tx
from lectern.operators import aggregates, upserts, windows
from lectern.sources import sinks, tables

NOW = dt.datetime(2024, 1, 10)
HOUR = dt.timedelta(hours=1)
TICK = dt.timedelta(microseconds=1)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "elapsed, phase, micro",
    [
        (-TICK, "NEW", "SEED_WINDOW"), (0 * HOUR, "REVIEW_ACTIVE", "SEED_WINDOW"), (12 * HOUR - TICK, "REVIEW_ACTIVE", "SEED_WINDOW"), (12 * HOUR, "REVIEW_ACTIVE", "BUILD_WINDOW"),
        (36 * HOUR, "REVIEW_ACTIVE", "LOCK_IN_WINDOW"), (48 * HOUR, "REVIEW_ACTIVE", "ELIGIBILITY_WINDOW"), (48 * HOUR + TICK, "VERDICT_ACTIVE", "ELIGIBILITY_WINDOW"),
        (60 * HOUR, "VERDICT_ACTIVE", "SUBMISSION_WINDOW"), (72 * HOUR, "VERDICT_ACTIVE", "EXPIRED"), (72 * HOUR + TICK, "EXPIRED", "EXPIRED"),
    ],
)
def test_phases(spark, elapsed, phase, micro):
    df = spark.createDataFrame([(NOW, NOW - elapsed)], "now timestamp_ntz, opened timestamp_ntz")
    h = rules.elapsed_hours(F.col("now"), F.col("opened"))
    assert tuple(df.select(rules.phase(h), rules.micro_phase(h)).first()) == (phase, micro)


@pytest.mark.parametrize("n, band, score", [(0, "cold", 0.15), (1, "warm", 0.75), (2, "goldilocks", 1.0), (3, "goldilocks", 0.95), (4, "crowded", 0.75), (6, "crowded", 0.35), (7, "saturated", 0.10), (50, "saturated", 0.10)])
def test_crowding(spark, n, band, score):
    assert one(spark, rules.heat_band(F.lit(n))) == band and one(spark, rules.crowding_score(F.lit(n))) == score


@pytest.mark.parametrize("conf, reacts, unclear, score", [(0.85, 1, 0, 3.5), (0.8499, 1, 0, 4.5), (0.65, 1, 0, 4.5), (0.6499, 0, 2, 5.5), (None, 0, 1, 5.5), (None, 0, 0, 6.5)])
def test_verdict_scores(spark, conf, reacts, unclear, score):
    assert one(spark, rules.verdict_score(F.lit(conf).cast("double"), F.lit(reacts), F.lit(unclear))) == score


def test_contradictions(spark):
    assert [one(spark, rules.is_contradiction(F.lit(v).cast("string"))) for v in ("Refuted ", "CONTRADICTED", "supported", None)] == [True, True, False, False]


@pytest.mark.parametrize("raw, field", [("Review Summary", "summary"), ("questions-to authors", "questions"), ("Score", "rating"), ("Other Notes", "other_notes"), ("", None)])
def test_fields(spark, raw, field):
    assert one(spark, tx.field_name(F.lit(raw))) == field


@pytest.mark.parametrize("field, n, reason", [("rating", 500, "tier_c_metadata_only"), ("summary", 0, "tier_a_empty"), ("summary", 1, "tier_a"), ("soundness", 99, "tier_b_insufficient_text"), ("soundness", 100, "tier_b_substantive_text"), ("notes", 100, "unknown_substantive_heuristic")])
def test_field_policy(spark, field, n, reason):
    assert one(spark, tx.field_policy(F.lit(field), F.lit("x" * n)))["reason"] == reason


def test_text_functions(spark):
    assert one(spark, tx.references(F.lit("Fig. 2, table 3 and Table 3 of Section 3.2"))) == ["Table 3", "Figure 2", "Section 3.2"]
    assert one(spark, tx.section_ancestors(F.lit("3.2.1"))) == ["3.2.1", "3.2", "3"]
    assert one(spark, tx.best_sentence(F.lit("One red fox. Two red dogs ran!"), F.lit("red dogs"))) == ("Two red dogs ran!", pytest.approx(2 / 2**0.5))
    assert one(spark, tx.caption_prefix(F.lit("Fig. 7: a map"))) == ("figure", "Figure 7", 7)
    assert one(spark, tx.repository(F.lit("https://github.com/a-b/c.d/blob/main/x.py"))) == "a-b/c.d"
    assert [one(spark, tx.page_number(F.lit(t))) for t in ("12", "- 3 -", "4 / 10", "Page 9", "1234", "")] == [True, True, True, True, False, False]
    assert [one(spark, tx.parsed_score(F.lit(t))) for t in ("4", "Score: 3", "rating=5 of 9", "about 2 or 3", "none")] == [4, 3, 5, 2, None]
    assert [one(spark, tx.error_class(F.lit(t))) for t in ("HTTP 429", "Read timed out", "403 Forbidden", "502", "odd")] == ["rate_limit", "timeout", "auth_error", "http_error", "scoring_exception"]
    assert [one(spark, tx.json_or_null(F.lit(t).cast("string"), "array<int>")) for t in ("[1,2]", "{bad", " [3]", "7", None)] == [[1, 2], None, [3], None, None]
    assert one(spark, tx.blocked_phrase(F.lit("A Fatal Flaw, no fraud"))) == "fraud"
    assert [one(spark, tx.category(F.lit(c))) for c in ("Methods", "related-work", "cooking")] == ["methodology", "literature", None]


def test_boxes(spark):
    b = lambda *x: F.array(*(F.lit(float(v)) for v in x))
    assert one(spark, geo.area(b(0, 0, 3, 4))) == 12 and one(spark, geo.area(b(3, 0, 0, 4))) == 0
    assert one(spark, geo.overlaps(b(0, 0, 1, 1), b(21, 0, 30, 1))) and not one(spark, geo.overlaps(b(0, 0, 1, 1), b(21.5, 0, 30, 1)))
    assert one(spark, geo.parsed(F.lit("[1,2,3]"))) is None


def test_word_windows(spark):
    n = [0, 1, 119, 120, 121, 210, 211]
    df = spark.createDataFrame([(i, " ".join(["w"] * i)) for i in n], "n int, text string")
    got = {r["n"]: r["c"] for r in windows.word_windows(df, "text").groupBy("n").agg(F.count("*").alias("c")).collect()}
    assert got == {1: 1, 119: 1, 120: 1, 121: 2, 210: 2, 211: 3}


def test_clusters(spark):
    df = spark.createDataFrame([(1, 0.0, 10.0), (1, 10.0, 12.0), (1, 17.0, 20.0), (1, 25.1, 30.0)], "k int, x0 double, x1 double")
    assert [r["cluster"] for r in windows.clusters(df, ["k"], "x0", "x1", 5.0).orderBy("x0").collect()] == [0, 0, 0, 1]


@pytest.mark.parametrize("n", [1, 2, 19, 20, 21])
def test_ordered_statistics(spark, n):
    df = spark.createDataFrame([(1, float(v)) for v in range(n)] + [(1, None)], "k int, v double")
    r = aggregates.ordered_statistics(df, ["k"], "v").first()
    assert (r["n"], r["median"], r["p95"]) == (n, float(n // 2), float(max(0, int(0.95 * n) - 1)))


def test_partial_upsert(spark):
    df = spark.createDataFrame([(1, 1, "a", "x"), (1, 2, "b", "y")], "id int, at int, author string, text string")
    assert tuple(upserts.partial_upsert(df, ["id"], ["at"], ["author"], ["text"]).first()) == (1, "a", "y")


def test_dedup_gate_edges(spark):
    log = spark.createDataFrame([(1, NOW - 12 * HOUR), (2, NOW - 12 * HOUR - TICK)], "k int, at timestamp_ntz")
    got = upserts.recently_done(log.select("k"), log, ["k"], F.lit(True), "at", F.lit(NOW).cast("timestamp_ntz"), 12)
    assert {r["k"]: r["recent"] for r in got.collect()} == {1: True, 2: False}


def test_metadata(spark):
    assert one(spark, upserts.merged_metadata(F.lit('{"a":"1","b":"2"}'), F.lit('{"b":"3"}'))) == {"a": "1", "b": "3"}
    assert one(spark, upserts.merged_metadata(F.lit(None).cast("string"), F.lit("{bad"))) in ({}, None)


def test_sources(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("# head\nb\n\n a \nb\n")
    assert [r["id"] for r in tables.id_list(spark, str(tmp_path / "ids.txt")).orderBy("line_no").collect()] == ["b", "a"]
    assert tables.relation(spark, str(tmp_path / "none.parquet"), "claims").count() == 0
    df = spark.createDataFrame([("x", None, 1)], "Paper_ID string, title string, extra int")
    assert sinks.write_json_lines(df, str(tmp_path / "out.jsonl")) == 1
    assert tables.relation(spark, str(tmp_path / "out.jsonl"), "papers").first()["paper_id"] == "x"
    assert one(spark, tables.timestamp(F.lit("2024-01-02T03:04:05Z"))) == dt.datetime(2024, 1, 2, 3, 4, 5)
    assert one(spark, tables.timestamp(F.lit("soon"))) is None
    assert one(spark, tables.unwrapped(F.lit('{"value": "v"}'))) == "v"


@pytest.mark.parametrize("most", [3, 50, 10**6])
def test_ordered_statistics_with_outliers(spark, most):
    """One value far away, one that a third of the rows have, negative ones, and a key of a single value."""
    import random

    r = random.Random(7)
    values = {"a": [r.random() * 100 for _ in range(600)] + [1e9], "b": [5.0] * 200 + [r.gauss(0, 1) for _ in range(300)], "c": [2.5], "d": [7.0] * 99, "e": [1e9 + x for x in range(100)] + [-1e300]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in [*vs, None]], "k string, v double")
    got = {x["k"]: x for x in aggregates.ordered_statistics(df, ["k"], "v", most).collect()}
    for k, vs in values.items():
        vs = sorted(vs)
        assert (got[k]["n"], got[k]["median"], got[k]["p95"]) == (len(vs), vs[len(vs) // 2], vs[max(0, int(0.95 * len(vs)) - 1)]), k
