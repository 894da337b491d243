"""Budgets that are spent in order and runs over papers, against loops that take one paper after the other."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import loop

NOW = dt.datetime(2024, 1, 10)
PAPERS = "paper_id long, open_time timestamp_ntz, hours double, has_candidate boolean, recent_reactive boolean, body string, participated boolean, eligible boolean, recent_verdict boolean, citations boolean, score double, own_score double"


@pytest.mark.parametrize("budget", [0, 1, 2.5, 7, 40, 1000])
def test_granted(spark, budget):
    r = random.Random(budget)
    rows = [(i, r.choice([None, 0.1, 1.0, 1.0, 2.5, 7.0])) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, cost double").repartition(3)
    yes, out = loop.granted(df, F.col("cost"), budget, [-F.col("id")], [F.floor(-F.col("id") / 50)])
    got = {x["id"]: (x["yes"], x["out"]) for x in df.select("id", yes.alias("yes"), out.alias("out")).collect()}
    left = round(budget * 10)
    for i, cost in reversed(rows):
        none_left, fits = left == 0, cost is not None and round(cost * 10) <= left
        assert got[i] == (fits, none_left), i
        left -= round(cost * 10) if fits else 0


def sequential(papers, run):
    """One paper after the other."""
    order = sorted(papers, key=lambda p: (-p["open_time"].timestamp(), p["paper_id"]))[: run.max_papers]
    c = dict.fromkeys(("papers_processed", "reactive_candidates_found", "reactive_drafts_created", "verdicts_eligible", "verdict_drafts_created", "live_reactive_posts", "live_verdict_submissions", "verdict_live_missing_score", "verdict_live_invalid_score", "reactive_dedup_skipped", "reactive_live_eligible", "reactive_live_posted", "live_budget_exhausted", "reactive_live_gate_failed", "skipped", "errors_count"), 0)
    c["papers_seen"], replies, verdicts, said = len(papers), run.reactive_budget, run.verdict_budget, {}
    for p in order:
        body = (p["body"] or "").strip()
        status, reason, posted = "none", "no_candidate", False
        if p["has_candidate"] and p["recent_reactive"]:
            status = reason = "dedup_skipped"
        elif p["has_candidate"]:
            live = run.live_reactive and not run.test_mode and run.live_mode and replies > 0 and run.has_client
            reason = "live_disabled" if not run.live_reactive else "live_gate_failed" if run.test_mode or not run.live_mode else "live_budget_exhausted" if replies <= 0 else "live_gate_failed"
            if body and (not 0 <= p["hours"] <= 48 or run.karma < (0.1 if p["participated"] else 1.0) or "fraud" in body):
                c["errors_count"] += 1
                said[p["paper_id"]] = None
                continue
            if live:
                status, reason, posted = ("live_posted", "live_posted", True) if body else ("skipped", "live_gate_failed", False)
            else:
                status = "dry_run" if body and (run.test_mode or run.live_mode) else "skipped"
        vstatus, vreason, submitted = "ineligible", "no_eligible_verdict", False
        if p["eligible"] and p["recent_verdict"]:
            vstatus = vreason = "dedup_skipped"
        elif p["eligible"]:
            vstatus = "dry_run" if p["citations"] else "skipped"
            score = p["score"] if p["score"] is not None else p["own_score"]
            if not run.live_verdict:
                vreason = "live_disabled"
            elif run.test_mode or not run.live_mode:
                vreason = "live_gate_failed"
            elif not run.allowlisted:
                vreason = "allowlist_required"
            elif verdicts <= 0:
                vreason = "live_budget_exhausted"
            elif not run.has_client:
                vreason = "live_gate_failed"
            elif p["citations"]:
                vreason = "missing_verdict_score" if score is None else "invalid_verdict_score" if not 0 <= score <= 10 else "live_submitted"
                if vreason == "live_submitted":
                    vstatus, submitted = "live_submitted", True
        replies -= posted
        verdicts -= submitted
        said[p["paper_id"]] = (status, reason, vstatus, vreason)
        for name, yes in {
            "papers_processed": True, "reactive_candidates_found": p["has_candidate"], "reactive_drafts_created": status == "dry_run", "verdicts_eligible": p["eligible"], "verdict_drafts_created": vstatus == "dry_run", "live_reactive_posts": posted,
            "reactive_live_posted": posted, "live_verdict_submissions": submitted, "verdict_live_missing_score": vreason == "missing_verdict_score", "verdict_live_invalid_score": vreason == "invalid_verdict_score", "reactive_dedup_skipped": status == "dedup_skipped",
            "reactive_live_eligible": reason in ("live_posted", "live_gate_failed", "live_budget_exhausted"), "live_budget_exhausted": reason == "live_budget_exhausted", "reactive_live_gate_failed": reason == "live_gate_failed", "skipped": status != "dry_run" and vstatus != "dry_run",
        }.items():
            c[name] += yes
    return said, c


LIVE = dict(test_mode=False, live_mode=True, live_reactive=True, live_verdict=True, allowlisted=True)


@pytest.mark.parametrize(
    "run",
    [loop.Run(), loop.Run(test_mode=False), loop.Run(live_reactive=True, live_verdict=True), loop.Run(**LIVE), loop.Run(**LIVE | {"allowlisted": False, "live_reactive": False}), loop.Run(**LIVE, reactive_budget=5, verdict_budget=9, max_papers=120), loop.Run(**LIVE, has_client=False), loop.Run(**LIVE, karma=0.5, reactive_budget=0, verdict_budget=0)],
)
def test_runs(spark, run):
    r = random.Random(2)
    yes = lambda p: r.random() < p
    papers = [
        dict(paper_id=i, open_time=NOW - dt.timedelta(hours=r.randrange(60)), hours=float(r.choice([-1, 0, 10, 20, 48, 49])), has_candidate=yes(0.7), recent_reactive=yes(0.2), body=r.choice([None, " ", "a reply", "a fraud", "more", "text"]), participated=yes(0.5),
             eligible=yes(0.6), recent_verdict=yes(0.2), citations=yes(0.7), score=r.choice([None, None, 5.0, 11.0]), own_score=r.choice([None, 3.5]))
        for i in range(200)
    ]
    df = spark.createDataFrame([tuple(p.values()) for p in papers], PAPERS)
    said, counters = sequential(papers, run)
    got = {x["paper_id"]: None if x["error"] else (x["reactive_status"], x["reactive_live_reason"], x["verdict_status"], x["verdict_live_reason"]) for x in loop.outcomes(df, run).collect()}
    assert got == said
    assert loop.counters(df, run).first().asDict() == counters


def test_runs_over_nothing(spark):
    df = spark.createDataFrame([], PAPERS)
    assert loop.outcomes(df, loop.Run(**LIVE)).count() == 0 and set(loop.counters(df, loop.Run(**LIVE)).first()) == {0}


def test_synced(spark):
    t = dt.datetime
    papers = spark.createDataFrame([(1, "old", t(2024, 1, 1)), (2, "kept", t(2024, 1, 1))], "paper_id long, title string, at timestamp_ntz")
    comments = spark.createDataFrame([("c1", 1, "7", False, t(2024, 1, 1)), ("c2", 2, "8", True, t(2024, 1, 1))], "comment_id string, paper_id long, author_id string, is_ours boolean, at timestamp_ntz")
    active = spark.createDataFrame([(1, "new", t(2024, 1, 2)), (3, "more", t(2024, 1, 2))], papers.schema)
    listed = spark.createDataFrame([("c1", 1, "7", False, t(2024, 1, 2)), ("c3", 3, "9", None, t(2024, 1, 2)), ("c4", 2, "7", False, t(2024, 1, 2))], comments.schema)
    p, c, n = loop.synced(papers, comments, active, listed, "7")
    assert sorted((r["paper_id"], r["title"]) for r in p.collect()) == [(1, "new"), (2, "kept"), (3, "more")]
    assert sorted((r["comment_id"], r["is_ours"], r["at"].day) for r in c.collect()) == [("c1", True, 2), ("c2", True, 1), ("c3", False, 2)]
    assert n.first().asDict() == {"papers": 2, "comments": 2}


def test_ids_order_only_papers_of_one_time(spark):
    """Of two papers of a day the later opened comes first, also where its id is in a later part."""
    rows = [(100_001, 5, 1), (1, 4, 1), (200_002, 4, 1), (7, 3, 1)]
    df = spark.createDataFrame(rows, "id long, hour int, cost int").withColumn("cost", F.when(F.col("id") != 7, F.col("cost")))
    papers = df.select(
        F.col("id").alias("paper_id"), F.make_timestamp_ntz(F.lit(2024), F.lit(1), F.lit(30), F.col("hour"), F.lit(0), F.lit(0)).alias("open_time"), F.lit(1.0).alias("hours"), F.lit(True).alias("has_candidate"), F.lit(False).alias("recent_reactive"), F.lit("body").alias("body"),
        F.lit(False).alias("participated"), F.lit(False).alias("eligible"), F.lit(False).alias("recent_verdict"), F.lit(False).alias("citations"), F.lit(5.0).alias("score"), F.lit(5.0).alias("own_score"),
    )
    run = loop.Run(test_mode=False, live_mode=True, live_reactive=True, allowlisted=True, reactive_budget=2)
    assert {r["paper_id"] for r in loop.outcomes(papers, run).where("reactive_live_posted").collect()} == {100_001, 1}


def test_verdicts_are_granted_by_time_before_id(spark):
    """As above, with the budget of verdicts."""
    rows = spark.createDataFrame([(100_001, 5), (1, 4), (300_000, 4), (2, 3)], "paper_id long, hour int")
    papers = rows.select(
        "paper_id", F.make_timestamp_ntz(F.lit(2024), F.lit(1), F.lit(30), F.col("hour"), F.lit(0), F.lit(0)).alias("open_time"), F.lit(1.0).alias("hours"), F.lit(False).alias("has_candidate"), F.lit(False).alias("recent_reactive"), F.lit("").alias("body"),
        F.lit(False).alias("participated"), F.lit(True).alias("eligible"), F.lit(False).alias("recent_verdict"), F.lit(True).alias("citations"), F.lit(5.0).alias("score"), F.lit(5.0).alias("own_score"),
    )
    run = loop.Run(test_mode=False, live_mode=True, live_verdict=True, allowlisted=True, verdict_budget=2)
    assert {r["paper_id"] for r in loop.outcomes(papers, run).where("verdict_live_submitted").collect()} == {100_001, 1}
