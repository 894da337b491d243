"""Queries on runs over all papers, with the SQL that each must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import rules
from lectern.operators import loop, upserts
from lectern.plans import bindings as b
from lectern.plans.bindings import NOW_SQL, sql
from lectern.plans.review import _BAND, _SUMMARISED, summarised
from lectern.sources.shared import written

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
#: Both runs that are asked about: a test, and a live one with a budget of three replies and two verdicts.
RUNS = {"test": loop.Run(), "live": loop.Run(test_mode=False, live_mode=True, live_reactive=True, live_verdict=True, allowlisted=True, reactive_budget=3, verdict_budget=2)}


def run_papers(spark: SparkSession, d: str) -> DataFrame:
    """Papers with their best candidate, what was done lately, the gate, and the scores that a run may submit.

    A reply's text is the name of its claim's part; a click stands for a reply to the candidate whose number it holds, a view
    for a verdict's draft; a score is given where the part is small.
    """
    best = b.verifications(spark, d).where("verdict = 'refuted' and status = 'success' and confidence >= 0.5")
    best = upserts.latest(best, ["paper_id"], [F.col("confidence").desc(), "claim_id", "position", "tie"]).select("paper_id", F.col("claim_id").alias("comment_id"))
    log = b.actions(spark, d).withColumn("comment_id", F.get_json_object("details", "$.k").cast("long"))
    out = summarised(spark, d).join(best, "paper_id", "left").withColumn("comment_id", F.col("comment_id") % 100)
    out = upserts.recently_done(out, log, ["paper_id", "comment_id"], F.col("action_type") == "click", "created_at", b.now(), 2000.0).withColumnRenamed("recent", "recent_reactive")
    out = upserts.recently_done(out, log, ["paper_id"], F.col("action_type") == "view", "created_at", b.now(), 72.0).withColumnRenamed("recent", "recent_verdict")
    size = b.table(spark, d, "part").select(F.col("p_partkey").alias("paper_id"), "p_size")
    gate = rules.verdict_gate(rules.heat_band(F.col("others")), F.col("strongest"), F.lit(3))
    return out.join(size, "paper_id").select(
        "paper_id", "open_time", F.col("h").alias("hours"), F.col("comment_id").isNotNull().alias("has_candidate"), "recent_reactive", F.when(F.col("p_size") % 9 != 0, F.when(F.col("p_size") % 10 == 0, F.concat("title", F.lit(" is fraud"))).otherwise(F.col("title"))).alias("body"),
        (F.col("ours") > 0).alias("participated"), (gate == "eligible").alias("eligible"), "recent_verdict", (F.col("others") >= 3).alias("citations"),
        F.when(F.col("p_size") < 20, F.col("p_size").cast("double")).alias("score"), F.when(F.col("p_size") % 4 != 0, rules.verdict_score(F.col("strongest"), F.col("reacts"), F.col("unclear")).cast("double")).alias("own_score"),
    )


_INPUT = f"""{_SUMMARISED},
    best AS (SELECT paper_id, claim_id % 100 AS comment_id FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY confidence DESC, claim_id, position, tie) AS n FROM verifications WHERE verdict = 'refuted' AND status = 'success' AND confidence >= 0.5) WHERE n = 1),
    clicks AS (SELECT DISTINCT paper_id, CAST(json_extract(details, '$.k') AS BIGINT) AS comment_id FROM actions WHERE action_type = 'click' AND created_at >= {NOW_SQL} - INTERVAL 2000 HOUR),
    views AS (SELECT DISTINCT paper_id FROM actions WHERE action_type = 'view' AND created_at >= {NOW_SQL} - INTERVAL 72 HOUR),
    banded AS (SELECT *, {_BAND} AS band FROM summarised),
    input AS (SELECT p.paper_id, p.open_time, p.h, best.comment_id IS NOT NULL AS cand, clicks.paper_id IS NOT NULL AS again, CASE WHEN p_size % 9 <> 0 THEN CASE WHEN p_size % 10 = 0 THEN title || ' is fraud' ELSE title END END AS body,
        ours > 0 AS took_part, band <> 'saturated' AND coalesce(strongest >= 0.75, FALSE) AS eligible, views.paper_id IS NOT NULL AS voted, others >= 3 AS cites, CASE WHEN p_size < 20 THEN p_size ELSE CASE WHEN p_size % 4 <> 0 THEN
        CASE WHEN strongest >= 0.85 THEN 3.5 WHEN strongest >= 0.65 THEN 4.5 WHEN reacts = 0 AND unclear > 0 THEN 5.5 ELSE 6.5 END END END AS score
        FROM banded p JOIN part ON p_partkey = p.paper_id LEFT JOIN best ON best.paper_id = p.paper_id LEFT JOIN clicks ON clicks.paper_id = p.paper_id AND clicks.comment_id = best.comment_id LEFT JOIN views ON views.paper_id = p.paper_id),
    acted AS (SELECT *, cand AND NOT again AS acts, coalesce(trim(body), '') = '' AS empty, CASE WHEN cand AND NOT again AND coalesce(trim(body), '') <> '' THEN CASE WHEN h < 0 OR h > 48 THEN 'phase' WHEN contains(body, 'fraud') THEN 'moderation' END END AS error FROM input),
    tried AS (SELECT *, coalesce(sum(CASE WHEN acts AND NOT empty AND error IS NULL THEN 1 END) OVER w, 0) AS posted_before, eligible AND NOT voted AND error IS NULL AS ready,
        CASE WHEN score IS NULL THEN 'missing_verdict_score' WHEN score NOT BETWEEN 0 AND 10 THEN 'invalid_verdict_score' END AS wrong FROM acted WINDOW w AS (ORDER BY open_time DESC, paper_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    voted AS (SELECT *, coalesce(sum(CASE WHEN ready AND cites AND wrong IS NULL THEN 1 END) OVER w, 0) AS submitted_before FROM tried WINDOW w AS (ORDER BY open_time DESC, paper_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    test AS (SELECT 'test' AS run, *, CASE WHEN NOT cand THEN 'none' WHEN again THEN 'dedup_skipped' WHEN empty THEN 'skipped' ELSE 'dry_run' END AS rs, CASE WHEN NOT cand THEN 'no_candidate' WHEN again THEN 'dedup_skipped' ELSE 'live_disabled' END AS rr,
        CASE WHEN NOT eligible THEN 'ineligible' WHEN voted THEN 'dedup_skipped' WHEN cites THEN 'dry_run' ELSE 'skipped' END AS vs, CASE WHEN NOT eligible THEN 'no_eligible_verdict' WHEN voted THEN 'dedup_skipped' ELSE 'live_disabled' END AS vr FROM voted),
    live AS (SELECT 'live' AS run, *, CASE WHEN NOT cand THEN 'none' WHEN again THEN 'dedup_skipped' WHEN posted_before >= 3 AND NOT empty THEN 'dry_run' WHEN NOT empty THEN 'live_posted' ELSE 'skipped' END AS rs,
        CASE WHEN NOT cand THEN 'no_candidate' WHEN again THEN 'dedup_skipped' WHEN posted_before >= 3 THEN 'live_budget_exhausted' WHEN NOT empty THEN 'live_posted' ELSE 'live_gate_failed' END AS rr,
        CASE WHEN NOT eligible THEN 'ineligible' WHEN voted THEN 'dedup_skipped' WHEN submitted_before < 2 AND cites AND wrong IS NULL THEN 'live_submitted' WHEN cites THEN 'dry_run' ELSE 'skipped' END AS vs,
        CASE WHEN NOT eligible THEN 'no_eligible_verdict' WHEN voted THEN 'dedup_skipped' WHEN submitted_before >= 2 THEN 'live_budget_exhausted' WHEN NOT cites THEN 'no_eligible_verdict' WHEN wrong IS NOT NULL THEN wrong ELSE 'live_submitted' END AS vr FROM voted),
    runs AS (SELECT * FROM test UNION ALL SELECT * FROM live)"""


def run_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What a test and a live run do about each paper, and why not more."""
    papers, out = written(run_papers(spark, d)), None  # read once for each round of a budget
    for name, run in RUNS.items():
        one = loop.outcomes(papers, run).select(F.lit(name).alias("run"), "paper_id", "error", "reactive_status", "reactive_live_reason", "verdict_status", "verdict_live_reason")
        out = one if out is None else out.unionByName(one)
    return out


def run_counters(spark: SparkSession, d: str) -> DataFrame:
    """All counters of a test and of a live run."""
    papers, out = written(run_papers(spark, d)), None
    for name, run in RUNS.items():
        one = loop.counters(papers, run).withColumn("run", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def synced_comments(spark: SparkSession, d: str) -> DataFrame:
    """Comments after the active papers' were written over those stored last quarter, and how many papers and
    comments that took."""
    all_comments = b.comments(spark, d).select("paper_id", F.concat_ws("-", "thread_id", "position", "paper_id", "author_id", F.col("weight").cast("decimal(18,2)")).alias("comment_id"), F.col("author_id").cast("string").alias("author_id"), "is_ours", F.col("created_at").alias("at"))
    papers = b.papers(spark, d).select("paper_id", "title", F.col("open_time").alias("at"))
    active = papers.where(rules.phase(rules.elapsed_hours(b.now(), F.col("at"))) == "REVIEW_ACTIVE")
    _, comments, n = loop.synced(papers.where("paper_id % 3 <> 0"), all_comments.where("month(at) < 10"), active, all_comments, "7")
    counted = comments.groupBy("paper_id").agg(F.count(F.lit(1)).alias("comments_stored"), F.count_if("is_ours").alias("ours"))
    return counted.crossJoin(F.broadcast(n))  # n is one row


_STATUS = "error, CASE WHEN error IS NULL THEN rs END AS reactive_status, CASE WHEN error IS NULL THEN rr END AS reactive_live_reason, CASE WHEN error IS NULL THEN vs END AS verdict_status, CASE WHEN error IS NULL THEN vr END AS verdict_live_reason"
_COUNT = lambda what, name: f"count(*) FILTER (error IS NULL AND ({what})) AS {name}"
QUERIES |= {"e24_run_outcomes": run_outcomes, "a36_loop_counters": run_counters, "e31_synced_comments": synced_comments}
ORACLE |= {
    "e24_run_outcomes": sql(f"{_INPUT} SELECT run, paper_id, {_STATUS} FROM runs", "papers", "comments", "verifications", "actions"),
    "a36_loop_counters": sql(
        f"""{_INPUT} SELECT run, count(*) AS papers_seen, {_COUNT("TRUE", "papers_processed")}, {_COUNT("cand", "reactive_candidates_found")}, {_COUNT("rs = 'dry_run'", "reactive_drafts_created")}, {_COUNT("eligible", "verdicts_eligible")}, {_COUNT("vs = 'dry_run'", "verdict_drafts_created")},
        {_COUNT("rs = 'live_posted'", "live_reactive_posts")}, {_COUNT("vs = 'live_submitted'", "live_verdict_submissions")}, {_COUNT("vr = 'missing_verdict_score'", "verdict_live_missing_score")}, {_COUNT("vr = 'invalid_verdict_score'", "verdict_live_invalid_score")}, {_COUNT("rs = 'dedup_skipped'", "reactive_dedup_skipped")},
        {_COUNT("rr IN ('live_posted', 'live_gate_failed', 'live_budget_exhausted')", "reactive_live_eligible")}, {_COUNT("rs = 'live_posted'", "reactive_live_posted")}, {_COUNT("rr = 'live_budget_exhausted'", "live_budget_exhausted")}, {_COUNT("rr = 'live_gate_failed'", "reactive_live_gate_failed")},
        {_COUNT("rs <> 'dry_run' AND vs <> 'dry_run'", "skipped")}, count(error) AS errors_count FROM runs GROUP BY run""",
        "papers", "comments", "verifications", "actions",
    ),
    "e31_synced_comments": sql(
        f"""c AS (SELECT paper_id, concat_ws('-', thread_id, position, paper_id, author_id, CAST(weight AS DECIMAL(18,2))) AS comment_id, author_id, is_ours, created_at FROM comments),
        active AS (SELECT paper_id FROM papers WHERE epoch_us({NOW_SQL} - open_time) BETWEEN 0 AND 48 * 3600000000),
        fresh AS (SELECT * FROM c WHERE paper_id IN (SELECT paper_id FROM active)),
        last AS (SELECT paper_id, is_ours OR author_id = 7 AS is_ours FROM (SELECT *, row_number() OVER (PARTITION BY comment_id ORDER BY created_at DESC) AS n FROM fresh) WHERE n = 1),
        stored AS (SELECT paper_id, is_ours FROM last UNION ALL SELECT paper_id, is_ours FROM c WHERE month(created_at) < 10 AND comment_id NOT IN (SELECT comment_id FROM fresh))
        SELECT paper_id, count(*) AS comments_stored, count(*) FILTER (is_ours) AS ours, (SELECT count(*) FROM active) AS papers, (SELECT count(*) FROM fresh) AS comments FROM stored GROUP BY 1""",
        "papers", "comments",
    ),
}
