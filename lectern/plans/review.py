"""Queries on papers, comments, verifications, actions and experiments, each with the SQL that it must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import rules
from lectern.operators import aggregates, sets, upserts, windows
from lectern.plans import bindings as b
from lectern.plans.bindings import NOW_SQL, sql
from lectern.sources.shared import dealt

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


#: Rule cascades in SQL, on the columns named.
_PHASE = "CASE WHEN h < 0 THEN 'NEW' WHEN h <= 48 THEN 'REVIEW_ACTIVE' WHEN h <= 72 THEN 'VERDICT_ACTIVE' ELSE 'EXPIRED' END"
_MICRO = "CASE WHEN h < 12 THEN 'SEED_WINDOW' WHEN h < 36 THEN 'BUILD_WINDOW' WHEN h < 48 THEN 'LOCK_IN_WINDOW' WHEN h < 60 THEN 'ELIGIBILITY_WINDOW' WHEN h < 72 THEN 'SUBMISSION_WINDOW' ELSE 'EXPIRED' END"
_BAND = "CASE WHEN others <= 0 THEN 'cold' WHEN others = 1 THEN 'warm' WHEN others <= 3 THEN 'goldilocks' WHEN others <= 6 THEN 'crowded' ELSE 'saturated' END"
_HOURS = f"epoch_us({NOW_SQL} - open_time) / 3600000000.0"
_STATS = """stats AS (SELECT paper_id, count(*) AS total, count(*) FILTER (is_ours) AS ours, count(*) FILTER (NOT is_ours AND is_citable) AS citable_other,
        count(DISTINCT CASE WHEN NOT is_ours AND is_citable THEN author_id END) AS others FROM comments GROUP BY 1),
    signal AS (SELECT paper_id, max(confidence) FILTER (verdict IN ('refuted', 'contradicted', 'contradiction')) AS strongest, count(*) AS analyzed,
        count(*) FILTER (verdict = 'refuted' AND confidence >= 0.5) AS reacts, count(*) FILTER (verdict = 'insufficient_evidence') AS unclear FROM verifications WHERE status = 'success' GROUP BY 1)"""


def comment_stats(comments: DataFrame) -> DataFrame:
    """Per paper: all, ours, citable ones of others, and their distinct authors, in one pass."""
    other = ~F.col("is_ours") & F.col("is_citable")
    return comments.groupBy("paper_id").agg(F.count(F.lit(1)).alias("total"), F.count_if("is_ours").alias("ours"), F.count_if(other).alias("citable_other"), F.countDistinct(F.when(other, F.col("author_id"))).alias("others"))


def signals(verifications: DataFrame) -> DataFrame:
    """Per paper: strongest contradiction and counts over successful verifications."""
    contra = rules.is_contradiction(F.col("verdict"))
    return verifications.where("status = 'success'").groupBy("paper_id").agg(
        F.max(F.when(contra, F.col("confidence"))).alias("strongest"), F.count(F.lit(1)).alias("analyzed"),
        F.count_if(contra & (F.col("confidence") >= 0.5)).alias("reacts"), F.count_if(F.col("verdict") == "insufficient_evidence").alias("unclear"),
    )


def summarised(spark: SparkSession, d: str) -> DataFrame:
    """Papers with their counts and hours since opening."""
    out = b.papers(spark, d).join(comment_stats(b.comments(spark, d)), "paper_id", "left").join(signals(b.verifications(spark, d)), "paper_id", "left")
    return out.na.fill(0, ["total", "ours", "citable_other", "others", "analyzed", "reacts", "unclear"]).withColumn("h", rules.elapsed_hours(b.now(), F.col("open_time")))


_SUMMARISED = _STATS + f""", summarised AS (SELECT paper_id, title, venue, open_time, karma, coalesce(total, 0) AS total, coalesce(ours, 0) AS ours, coalesce(citable_other, 0) AS citable_other,
        coalesce(others, 0) AS others, strongest, coalesce(analyzed, 0) AS analyzed, coalesce(reacts, 0) AS reacts, coalesce(unclear, 0) AS unclear, {_HOURS} AS h
    FROM papers LEFT JOIN stats USING (paper_id) LEFT JOIN signal USING (paper_id))"""


@query("e20_run_summary", sql(f"""{_SUMMARISED}, ruled AS (SELECT *, {_PHASE} AS phase, {_MICRO} AS micro_phase, {_BAND} AS band FROM summarised),
    gated AS (SELECT *, CASE WHEN band = 'saturated' THEN 'saturated_low_value_v0' WHEN coalesce(strongest, -1) < 0.75 THEN CASE band WHEN 'cold' THEN 'cold_no_override' WHEN 'crowded' THEN 'crowded_no_override' ELSE 'no_react_signal' END
        WHEN others < 3 THEN 'insufficient_distinct_other_agent_citations' ELSE 'eligible' END AS gate FROM ruled),
    last AS (SELECT paper_id, action_type AS last_action FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY created_at DESC, action_id DESC) AS n FROM actions) WHERE n = 1)
    SELECT paper_id, title, phase, micro_phase, band, total, ours, citable_other, others, strongest, gate, last_action,
        CASE WHEN gate = 'eligible' THEN 'consider_verdict_draft' WHEN reacts > 0 THEN 'consider_reactive_comment' WHEN band = 'saturated' THEN 'skip_too_crowded' WHEN band = 'cold' THEN 'skip_too_cold'
            WHEN citable_other > 0 AND analyzed = 0 THEN 'run_reactive_analysis' ELSE 'skip_no_signal' END AS next_action
    FROM gated LEFT JOIN last USING (paper_id)""", "papers", "comments", "verifications", "actions"))  # fmt: skip
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    """E20-E23 with A2, A4, A5 and W1: one row per paper of counts, phases, gate and next action."""
    last = upserts.latest(b.actions(spark, d), ["paper_id"], [F.col("created_at").desc(), F.col("action_id").desc()]).select("paper_id", F.col("action_type").alias("last_action"))
    out = summarised(spark, d).join(last, "paper_id", "left")
    out = out.withColumns({"phase": rules.phase(F.col("h")), "micro_phase": rules.micro_phase(F.col("h")), "band": rules.heat_band(F.col("others"))})
    out = out.withColumn("gate", rules.verdict_gate(F.col("band"), F.col("strongest"), F.col("others")))
    act = rules.next_action(F.col("gate") == "eligible", F.col("reacts") > 0, F.col("band"), F.col("citable_other"), F.col("analyzed"))
    return out.select("paper_id", "title", "phase", "micro_phase", "band", "total", "ours", "citable_other", "others", "strongest", "gate", "last_action", act.alias("next_action"))


@query("e4_opportunities", sql(f"""{_SUMMARISED}, r AS (SELECT paper_id, ours > 0 AS p, karma - 900 AS k, {_PHASE} AS phase, {_MICRO} AS micro FROM summarised)
    SELECT paper_id, o AS opportunity, o <> 'SKIP' AS actionable FROM (SELECT paper_id, CASE WHEN phase IN ('NEW', 'EXPIRED') THEN 'SKIP' WHEN micro = 'SEED_WINDOW' AND NOT p AND k >= 15 AND k >= 1 THEN 'SEED'
        WHEN micro IN ('BUILD_WINDOW', 'LOCK_IN_WINDOW') AND p AND k >= 0.1 THEN 'FOLLOWUP' WHEN micro IN ('ELIGIBILITY_WINDOW', 'SUBMISSION_WINDOW') AND p THEN 'VERDICT_READY' ELSE 'SKIP' END AS o FROM r)""", "papers", "comments", "verifications"))  # fmt: skip
def opportunities(spark: SparkSession, d: str) -> DataFrame:
    """What can be done about each paper within the budget."""
    o = rules.opportunity(F.col("h"), F.col("ours") > 0, F.col("karma") - 900)
    return summarised(spark, d).select("paper_id", o.alias("opportunity"), (o != "SKIP").alias("actionable"))


@query("e11_eligibility", sql(f"""{_SUMMARISED}, r AS (SELECT paper_id, ours > 0 AS p, others, total % 5 <> 0 AS ready, coalesce(strongest, 0) AS conf, paper_id % 11 = 0 AS done, paper_id % 13 = 0 AS skipped, {_PHASE} AS phase FROM summarised)
    SELECT paper_id, CASE WHEN done THEN 'SUBMITTED' WHEN phase = 'EXPIRED' THEN 'EXPIRED' WHEN skipped THEN 'SKIPPED_BY_POLICY' WHEN NOT p THEN 'NOT_PARTICIPATED' WHEN others < 3 THEN 'PARTICIPATED_BUT_NOT_ENOUGH_OTHERS'
        WHEN phase <> 'VERDICT_ACTIVE' OR NOT ready THEN 'ENOUGH_OTHERS_BUT_NOT_IN_VERDICT_WINDOW' WHEN conf < 0.6 THEN 'ELIGIBLE_LOW_CONFIDENCE' ELSE 'ELIGIBLE_READY' END AS state,
        p AND phase = 'VERDICT_ACTIVE' AND others >= 3 AND ready AND conf >= 0.6 AND NOT done AS can_submit FROM r""", "papers", "comments", "verifications"))  # fmt: skip
def eligibility(spark: SparkSession, d: str) -> DataFrame:
    """E11 and E12."""
    r = summarised(spark, d).select("paper_id", "h", (F.col("ours") > 0).alias("p"), "others", (F.col("total") % 5 != 0).alias("ready"), F.coalesce("strongest", F.lit(0.0)).alias("conf"), (F.col("paper_id") % 11 == 0).alias("done"), (F.col("paper_id") % 13 == 0).alias("skipped"))
    c = {x: F.col(x) for x in r.columns}
    return r.select("paper_id", rules.eligibility(c["h"], c["p"], c["others"], c["ready"], c["conf"], c["done"], c["skipped"]).alias("state"), rules.can_submit(c["h"], c["p"], c["others"], c["ready"], c["conf"], c["done"]).alias("can_submit"))


@query("e14_verdict_scores", sql(f"""{_SUMMARISED} SELECT paper_id, CASE WHEN strongest >= 0.85 THEN 3.5 WHEN strongest >= 0.65 THEN 4.5 WHEN reacts = 0 AND unclear > 0 THEN 5.5 ELSE 6.5 END::DOUBLE AS score,
    round(coalesce(strongest, 0), 4) AS confidence FROM summarised""", "papers", "comments", "verifications"))  # fmt: skip
def verdict_scores(spark: SparkSession, d: str) -> DataFrame:
    """E13, E14."""
    return summarised(spark, d).select("paper_id", rules.verdict_score(F.col("strongest"), F.col("reacts"), F.col("unclear")).cast("double").alias("score"), F.round(F.coalesce("strongest", F.lit(0.0)), 4).alias("confidence"))


@query("r16_crowding_order", sql(f"""{_SUMMARISED}, s AS (SELECT paper_id, others, (CASE least(others, 7) WHEN 0 THEN 0.15 WHEN 1 THEN 0.75 WHEN 2 THEN 1.0 WHEN 3 THEN 0.95 WHEN 4 THEN 0.75 WHEN 5 THEN 0.55 WHEN 6 THEN 0.35 ELSE 0.10 END)::DOUBLE AS crowding FROM summarised)
    SELECT *, CAST(row_number() OVER (PARTITION BY crowding ORDER BY paper_id) AS INT) AS place_in_tie FROM s""", "papers", "comments", "verifications"))  # fmt: skip
def crowding_order(spark: SparkSession, d: str) -> DataFrame:
    """Crowding scores, and the stable order within equal ones."""
    s = summarised(spark, d).select("paper_id", "others", rules.crowding_score(F.col("others")).alias("crowding"))
    return windows.ranked_in_parts(s, ["crowding"], [F.expr("div(paper_id, 100000)")], [F.col("paper_id")], "place_in_tie")


@query("e17_recommendations", sql("""SELECT paper_id, review_id, count(*) AS n, CASE WHEN count(*) FILTER (verdict = 'refuted') > 0 AND max(confidence) FILTER (verdict = 'refuted') >= 0.5 THEN 'react'
    WHEN count(*) FILTER (verdict = 'supported') = count(*) THEN 'skip' ELSE 'unclear' END AS recommendation FROM verifications WHERE status = 'success' GROUP BY 1, 2""", "verifications"))  # fmt: skip
def recommendations(spark: SparkSession, d: str) -> DataFrame:
    """Per comment of a paper."""
    contra = rules.is_contradiction(F.col("verdict"))
    g = b.verifications(spark, d).where("status = 'success'").groupBy("paper_id", "review_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(contra).alias("c"), F.count_if(F.col("verdict") == "supported").alias("s"), F.max(F.when(contra, F.col("confidence"))).alias("m"))
    return g.select("paper_id", "review_id", "n", rules.recommendation(F.col("n"), F.col("c"), F.col("s"), F.coalesce("m", F.lit(0.0))).alias("recommendation"))


@query("r17_best_candidates", sql("""c AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY confidence DESC, claim_id, position, tie) AS n FROM verifications WHERE verdict = 'refuted' AND status = 'success' AND confidence >= 0.5)
    SELECT paper_id, claim_id, confidence FROM c WHERE n = 1""", "verifications"))
def best_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The strongest contradiction of each paper."""
    c = b.verifications(spark, d).where("verdict = 'refuted' and status = 'success' and confidence >= 0.5")
    return upserts.latest(c, ["paper_id"], [F.col("confidence").desc(), "claim_id", "position", "tie"]).select("paper_id", "claim_id", "confidence")


@query("w6_citations", sql("""f AS (SELECT paper_id, author_id, min(created_at) AS created_at FROM comments WHERE NOT is_ours AND is_citable GROUP BY 1, 2), c AS (SELECT *, count(*) OVER (PARTITION BY paper_id) AS authors FROM f)
    SELECT paper_id, author_id, created_at, authors FROM c WHERE authors >= 3""", "comments"))
def citations(spark: SparkSession, d: str) -> DataFrame:
    """The first comment of each other author, for papers with three authors or more."""
    f = b.comments(spark, d).where("not is_ours and is_citable").groupBy("paper_id", "author_id").agg(F.min("created_at").alias("created_at"))
    return f.withColumn("authors", F.count(F.lit(1)).over(Window.partitionBy("paper_id"))).where("authors >= 3")


@query("w2_latest_verifications", sql("""r AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY verified_at DESC, position DESC, tie DESC) AS n FROM verifications WHERE status = 'success' OR trim(status) = '')
    SELECT claim_id, paper_id, verdict, confidence FROM r WHERE n = 1""", "verifications"))
def latest_verifications(spark: SparkSession, d: str) -> DataFrame:
    """W2-W4."""
    order = [F.col(c).desc() for c in ("verified_at", "position", "tie")]
    return upserts.latest(b.verifications(spark, d), ["claim_id"], order, F.expr("status = 'success' or trim(status) = ''")).select("claim_id", "paper_id", "verdict", "confidence")


@query("w5_latest_experiments", sql("SELECT claim_key, max_by(experiment, (started_at, position)) AS experiment FROM extractions GROUP BY 1", "extractions"))
def latest_experiments(spark: SparkSession, d: str) -> DataFrame:
    """W5."""
    return b.extractions(spark, d).groupBy("claim_key").agg(F.max_by("experiment", F.struct("started_at", "position")).alias("experiment"))


@query("w27_live_budget", sql("""d AS (SELECT *, count(*) FILTER (action_type = 'purchase') OVER (PARTITION BY CAST(created_at AS DATE) ORDER BY created_at, action_id) AS so_far FROM actions)
    SELECT action_id, so_far = 1 AND action_type = 'purchase' AS live FROM d""", "actions"))
def live_budget(spark: SparkSession, d: str) -> DataFrame:
    """At most one live action per run (a day)."""
    a = b.actions(spark, d).withColumn("day", F.to_date("created_at"))
    first = a.where("action_type = 'purchase'").groupBy("day").agg(F.min_by("action_id", F.struct("created_at", "action_id")).alias("first_id"))  # a row for each day
    return a.join(first, "day", "left").select("action_id", F.coalesce(F.col("action_id") == F.col("first_id"), F.lit(False)).alias("live"))


@query("a1_budget_spent", sql("SELECT paper_id, round(coalesce(sum(cost) FILTER (action_type = 'purchase'), 0), 4) AS spent, count(*) FILTER (action_type = 'purchase') AS n FROM actions GROUP BY ROLLUP (paper_id)", "actions"))
def budget_spent(spark: SparkSession, d: str) -> DataFrame:
    """A1: per paper and, with a null paper, over all."""
    buys = F.col("action_type") == "purchase"
    return b.actions(spark, d).rollup("paper_id").agg(F.round(F.coalesce(F.sum(F.when(buys, F.col("cost"))), F.lit(0.0)), 4).alias("spent"), F.count_if(buys).alias("n"))


@query("u5_ledger_balance", sql("SELECT action_id, paper_id, round(10000 - sum(cost) OVER (PARTITION BY paper_id ORDER BY created_at, action_id), 4) AS karma_after FROM actions WHERE action_type = 'purchase'", "actions"))
def ledger_balance(spark: SparkSession, d: str) -> DataFrame:
    """Running balances of the ledger."""
    w = Window.partitionBy("paper_id").orderBy("created_at", "action_id").rowsBetween(Window.unboundedPreceding, 0)
    return b.actions(spark, d).where("action_type = 'purchase'").select("action_id", "paper_id", F.round(10000 - F.sum("cost").over(w), 4).alias("karma_after"))


@query("a6_verdict_histogram", sql("SELECT paper_id, verdict, count(*) AS n FROM verifications WHERE status = 'success' GROUP BY 1, 2", "verifications"))
def verdict_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts of successful rows."""
    return aggregates.histogram(b.verifications(spark, d).where("status = 'success'"), ["paper_id"], "verdict")


@query("a3_reactive_stats", sql("""SELECT paper_id, count(DISTINCT review_id) AS comments, count(*) AS verified, count(*) FILTER (verdict = 'refuted') AS contradicted, count(*) FILTER (verdict = 'supported') AS supported,
    count(*) FILTER (verdict NOT IN ('refuted', 'supported')) AS insufficient FROM verifications GROUP BY 1""", "verifications"))  # fmt: skip
def reactive_stats(spark: SparkSession, d: str) -> DataFrame:
    """A3: verdicts folded into three buckets, in one pass."""
    v = F.col("verdict")
    return b.verifications(spark, d).groupBy("paper_id").agg(F.countDistinct("review_id").alias("comments"), F.count(F.lit(1)).alias("verified"), F.count_if(rules.is_contradiction(v)).alias("contradicted"), F.count_if(v == "supported").alias("supported"), F.count_if(~v.isin("supported") & ~rules.is_contradiction(v)).alias("insufficient"))


@query("a7_experiment_overview", sql("""SELECT experiment, min(field) AS field, count(DISTINCT claim_key) AS reviews, count(l_linenumber) AS claims, round(avg(confidence), 6) AS mean_confidence, round(avg(l_discount), 6) AS mean_discount, max(started_at) AS last_started
    FROM extractions LEFT JOIN lineitem ON l_orderkey = position GROUP BY 1""", "extractions"))
def experiment_overview(spark: SparkSession, d: str) -> DataFrame:
    """Per experiment over a left join."""
    lines = b.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("position"), "l_linenumber", "l_discount")
    n = lines.count()  # both sides in as many parts
    g = dealt(b.extractions(spark, d), "position", n).join(dealt(lines, "position", n), "position", "left").groupBy("experiment")
    return g.agg(F.min("field").alias("field"), F.countDistinct("claim_key").alias("reviews"), F.count("l_linenumber").alias("claims"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.round(F.avg("l_discount"), 6).alias("mean_discount"), F.max("started_at").alias("last_started"))


@query("a15_export_policy", sql("""a AS (SELECT paper_id, count(*) AS actions, max(created_at) AS last_at FROM actions GROUP BY 1), s AS (SELECT paper_id, bool_or(is_ours) AS ours FROM comments GROUP BY 1)
    SELECT paper_id, title, coalesce(ours, FALSE) AS participated, coalesce(actions, 0) AS actions, last_at FROM papers LEFT JOIN s USING (paper_id) LEFT JOIN a USING (paper_id)""", "papers", "comments", "actions"))  # fmt: skip
def export_policy(spark: SparkSession, d: str) -> DataFrame:
    """Actions are counted before they are joined."""
    a = b.actions(spark, d).groupBy("paper_id").agg(F.count(F.lit(1)).alias("actions"), F.max("created_at").alias("last_at"))
    s = b.comments(spark, d).groupBy("paper_id").agg(F.bool_or("is_ours").alias("ours"))
    out = b.papers(spark, d).join(s, "paper_id", "left").join(a, "paper_id", "left")
    return out.select("paper_id", "title", F.coalesce("ours", F.lit(False)).alias("participated"), F.coalesce("actions", F.lit(0)).alias("actions"), "last_at")


@query("a17_latency", sql("""v AS (SELECT action_type, cost, row_number() OVER (PARTITION BY action_type ORDER BY cost) - 1 AS i, count(*) OVER (PARTITION BY action_type) AS n FROM actions WHERE cost IS NOT NULL)
    SELECT action_type, max(n) AS n, round(avg(cost), 6) AS mean, max(cost) FILTER (i = n // 2) AS median, max(cost) FILTER (i = greatest(0, n * 95 // 100 - 1)) AS p95 FROM v GROUP BY 1""", "actions"))  # fmt: skip
def latency(spark: SparkSession, d: str) -> DataFrame:
    """Non-interpolated statistics."""
    return aggregates.ordered_statistics(b.actions(spark, d), ["action_type"], "cost").withColumn("mean", F.round("mean", 6))


@query("a21_metrics_by_source", "SELECT source, count(*) AS n, round(avg(n_chars), 3) AS mean, median(n_chars) AS median, min(n_chars) AS least, max(n_chars) AS most, CAST(sum(n_chars) AS BIGINT) AS total, count(*) FILTER (n_chars < 40) AS tiny, round(count(*) FILTER (lang = 'en') / count(*), 3) AS english FROM documents GROUP BY 1")
def metrics_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Length metrics of each source."""
    n = F.col("n_chars")
    return b.table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(n), 3).alias("mean"), F.median(n).alias("median"), F.min(n).alias("least"), F.max(n).alias("most"), F.sum(n).alias("total"), F.count_if(n < 40).alias("tiny"), F.round(F.count_if(F.col("lang") == "en") / F.count(F.lit(1)), 3).alias("english"))


@query("a28_majority", sql("SELECT paper_id, action_type AS majority FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY c DESC, p) AS r FROM (SELECT paper_id, action_type, count(*) AS c, min(action_id) AS p FROM actions GROUP BY 1, 2)) WHERE r = 1", "actions"))
def majority(spark: SparkSession, d: str) -> DataFrame:
    """The mode, the first met on ties."""
    return aggregates.majority(b.actions(spark, d), ["paper_id"], "action_type", "action_id").withColumnRenamed("action_type", "majority")


@query("a10_sections", sql("SELECT paper_id, section, count(*) AS n, min(chunk_index) AS first_chunk, min_by(left(text, 40), chunk_index) AS first_text, max(chunk_index) AS last_chunk FROM chunks GROUP BY 1, 2", "chunks"))
def sections(spark: SparkSession, d: str) -> DataFrame:
    """Each section's count, first chunk and its beginning."""
    return b.chunks(spark, d).groupBy("paper_id", "section").agg(F.count(F.lit(1)).alias("n"), F.min("chunk_index").alias("first_chunk"), F.min_by(F.left("text", F.lit(40)), "chunk_index").alias("first_text"), F.max("chunk_index").alias("last_chunk"))


@query("a40_thread_texts", "SELECT conv_id, count(*) AS turns, sha256(string_agg(text, ' ' ORDER BY turn, role)) AS text_sha256 FROM conversations GROUP BY 1")
def thread_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts of a thread in order."""
    t = aggregates.joined_text(b.table(spark, d, "conversations").withColumn("order", F.struct("turn", "role")), ["conv_id"], "order", "text")
    n = b.table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))
    return t.join(n, "conv_id").select("conv_id", "turns", F.sha2("text", 256).alias("text_sha256"))


@query("a12_table_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("part", "lineitem", "events", "documents")) + " UNION ALL SELECT 'ok verifications', count(*) FROM lineitem WHERE l_linestatus = 'F'")
def table_counts(spark: SparkSession, d: str) -> DataFrame:
    """A9, A12, A14."""
    out = b.verifications(spark, d).where("status = 'success'").agg(F.count(F.lit(1)).alias("n")).select(F.lit("ok verifications").alias("name"), "n")
    for t in ("part", "lineitem", "events", "documents"):
        out = out.union(b.table(spark, d, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t), "n"))
    return out


@query("a22_top_refuted", sql("SELECT review_id, claim_id, confidence, CAST(n AS INT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY confidence DESC, claim_id, position, tie) AS n FROM verifications WHERE verdict = 'refuted') WHERE n <= 3", "verifications"))
def top_refuted(spark: SparkSession, d: str) -> DataFrame:
    """The three strongest contradictions of each review."""
    w = Window.partitionBy("review_id").orderBy(F.col("confidence").desc(), "claim_id", "position", "tie")
    return b.verifications(spark, d).where("verdict = 'refuted'").withColumn("n", F.row_number().over(w)).where("n <= 3").select("review_id", "claim_id", "confidence", "n")


@query("a24_review_overview", sql("""SELECT review_id, count(*) AS claims, count(*) FILTER (status = 'success') AS verified, round(avg(confidence) FILTER (status = 'success'), 6) AS mean, count(*) FILTER (confidence < 0.2) AS very_low,
    count(*) FILTER (confidence >= 0.8) AS very_high FROM verifications GROUP BY 1""", "verifications"))
def review_overview(spark: SparkSession, d: str) -> DataFrame:
    """A24, A34."""
    ok, c = F.col("status") == "success", F.col("confidence")
    return b.verifications(spark, d).groupBy("review_id").agg(F.count(F.lit(1)).alias("claims"), F.count_if(ok).alias("verified"), F.round(F.avg(F.when(ok, c)), 6).alias("mean"), F.count_if(c < 0.2).alias("very_low"), F.count_if(c >= 0.8).alias("very_high"))


@query("j1_verification_rows", """SELECT l_orderkey AS claim_id, l_linenumber AS position, CASE l_returnflag WHEN 'R' THEN 'refuted' WHEN 'A' THEN 'insufficient_evidence' ELSE 'supported' END AS verdict, l_discount AS confidence, o_orderpriority AS experiment,
    c_name AS reviewer, n_name AS venue, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS verdict_order FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey
    WHERE l_linestatus = 'F' AND l_discount >= 0.05""")
def verification_rows(spark: SparkSession, d: str) -> DataFrame:
    """Results with their claims, runs and reviews, in the order of verdicts."""
    lines = b.table(spark, d, "lineitem").where("l_linestatus = 'F' and l_discount >= 0.05")
    out = lines.join(b.table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"), "left").join(b.table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"), "left")
    out = out.join(b.table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    flag = F.col("l_returnflag")
    verdict = F.when(flag == "R", "refuted").when(flag == "A", "insufficient_evidence").otherwise("supported")
    return out.select(F.col("l_orderkey").alias("claim_id"), F.col("l_linenumber").alias("position"), verdict.alias("verdict"), F.col("l_discount").alias("confidence"), F.col("o_orderpriority").alias("experiment"), F.col("c_name").alias("reviewer"), F.col("n_name").alias("venue"), F.when(flag == "R", 0).when(flag == "A", 1).otherwise(2).alias("verdict_order"))


@query("j6_cached_evidence", """r AS (SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events)
    SELECT event_id, user_id, CAST(rank AS INT) AS rank, coalesce(nullif(trim(p_name), ''), s_name, 'none') AS evidence FROM r LEFT JOIN part ON p_partkey = k * 40 LEFT JOIN supplier ON s_suppkey = k WHERE rank <= 5""".replace("r AS", "WITH r AS", 1))
def cached_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Ranked rows with two lookups and a fallback between them."""
    r = b.table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    r = r.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("value").desc(), "event_id"))).where("rank <= 5")
    out = r.join(b.table(spark, d, "part"), F.col("p_partkey") == F.col("k") * 40, "left").join(b.table(spark, d, "supplier"), F.col("s_suppkey") == F.col("k"), "left")
    return out.select("event_id", "user_id", "rank", F.coalesce(F.nullif(F.trim("p_name"), F.lit("")), "s_name", F.lit("none")).alias("evidence"))


@query("u2_partial_upsert", sql("SELECT paper_id, author_id, arg_min(is_citable, (created_at, thread_id, position, weight)) AS first_citable, min(created_at) AS created_at, arg_max(weight, (created_at, thread_id, position, weight)) AS weight, arg_max(is_ours, (created_at, thread_id, position, weight)) AS is_ours FROM comments GROUP BY 1, 2", "comments"))
def partial_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A key's first and last values."""
    rows = b.comments(spark, d).withColumnRenamed("is_citable", "first_citable")
    return upserts.partial_upsert(rows, ["paper_id", "author_id"], ["created_at", "thread_id", "position", "weight"], ["first_citable", "created_at"], ["weight", "is_ours"])


@query("u17_ranked_results", sql("""SELECT claim_id, CASE WHEN verdict = 'supported' AND review_id = position THEN NULL ELSE review_id END AS object_id, CAST(row_number() OVER (PARTITION BY claim_id ORDER BY confidence DESC, position, review_id, tie) AS INT) AS rank, confidence FROM verifications""", "verifications"))
def ranked_results(spark: SparkSession, d: str) -> DataFrame:
    """Ranks by position in the list."""
    w = Window.partitionBy("claim_id").orderBy(F.col("confidence").desc(), "position", "review_id", "tie")
    same = (F.col("verdict") == "supported") & (F.col("review_id") == F.col("position"))
    return b.verifications(spark, d).select("claim_id", F.when(~same, F.col("review_id")).alias("object_id"), F.row_number().over(w).alias("rank"), "confidence")


@query("u22_pending_claims", sql("SELECT DISTINCT claim_id, paper_id FROM verifications v WHERE NOT EXISTS (SELECT 1 FROM verifications w WHERE w.claim_id = v.claim_id AND w.status = 'success' AND w.verdict = 'supported')", "verifications"))
def pending_claims(spark: SparkSession, d: str) -> DataFrame:
    """What isn't done yet."""
    v = dealt(b.verifications(spark, d), "claim_id")
    return upserts.without_keys(v, v.where("status = 'success' and verdict = 'supported'"), ["claim_id"]).select("claim_id", "paper_id").distinct()


@query("u6_cascade_delete", sql("""gone AS (SELECT DISTINCT claim_id FROM verifications WHERE review_id % 10 = 3)
    SELECT 'verifications' AS name, count(*) AS n FROM verifications WHERE claim_id NOT IN (SELECT claim_id FROM gone) UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT claim_id FROM gone)""", "verifications"))
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """What is left after a cascade of deletes."""
    v = b.verifications(spark, d)
    gone = v.where("review_id % 10 = 3").select("claim_id").distinct()
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
    return count(upserts.without_keys(v, gone, ["claim_id"]), "verifications").union(count(upserts.without_keys(b.table(spark, d, "orders").withColumnRenamed("o_orderkey", "claim_id"), gone, ["claim_id"]), "orders"))


@query("u25_ids", sql("""SELECT claim_id, position, tie, sha256(concat_ws(':', claim_id, 'model')) AS verification_id, left(sha256('draft:' || review_id), 16) AS draft_id, sha256(concat_ws('|', review_id, verdict, position, 'v1')) AS claim_hash FROM verifications""", "verifications"))
def ids(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers from what they stand for."""
    s = lambda *c, by=":": F.sha2(F.concat_ws(by, *(x.cast("string") for x in c)), 256)
    c, r = F.col("claim_id"), F.col("review_id")
    return b.verifications(spark, d).select("claim_id", "position", "tie", s(c, F.lit("model")).alias("verification_id"), F.left(F.sha2(F.concat(F.lit("draft:"), r.cast("string")), 256), F.lit(16)).alias("draft_id"), s(r, F.col("verdict"), F.col("position"), F.lit("v1"), by="|").alias("claim_hash"))


@query("u31_indexed", sql("""i AS (SELECT DISTINCT paper_id FROM comments), e AS (SELECT DISTINCT paper_id FROM actions WHERE action_type = 'signup'), f AS (SELECT * FROM e UNION SELECT paper_id FROM i WHERE (SELECT count(*) FROM e) = 0)
    SELECT paper_id, paper_id IN (SELECT paper_id FROM i) AS indexed, paper_id IN (SELECT paper_id FROM f) AS embedded FROM papers""", "papers", "comments", "actions"))
def indexed(spark: SparkSession, d: str) -> DataFrame:
    """Two memberships; the second has a substitute where it is empty altogether."""
    flag = lambda df, name: df.select("paper_id").distinct().withColumn(name, F.lit(True))
    signed_up = b.actions(spark, d).where("action_type = 'signup'").select("paper_id").distinct()
    none = signed_up.agg((F.count(F.lit(1)) == 0).alias("none"))
    embedded = signed_up.union(b.comments(spark, d).select("paper_id").distinct().join(F.broadcast(none.where("none")), how="left_semi"))
    out = b.papers(spark, d).join(flag(b.comments(spark, d), "indexed"), "paper_id", "left").join(flag(embedded, "embedded"), "paper_id", "left")
    return out.select("paper_id", F.coalesce("indexed", F.lit(False)).alias("indexed"), F.coalesce("embedded", F.lit(False)).alias("embedded"))


@query("u32_dedup_gate", sql(f"""done AS (SELECT DISTINCT paper_id, CAST(json_extract_string(details, '$.k') AS BIGINT) AS source FROM actions WHERE action_type IN ('click', 'view') AND created_at >= {NOW_SQL} - INTERVAL 60 HOUR)
    SELECT a.action_id, d.source IS NOT NULL AS recent FROM (SELECT *, CAST(json_extract_string(details, '$.k') AS BIGINT) AS k FROM actions WHERE action_type = 'purchase') a LEFT JOIN done d ON d.paper_id = a.paper_id AND d.source = a.k""", "actions"))
def dedup_gate(spark: SparkSession, d: str) -> DataFrame:
    """Was the same done for the same source within some hours?"""
    a = b.actions(spark, d).withColumn("source", F.get_json_object("details", "$.k").cast("long"))
    out = upserts.recently_done(a.where("action_type = 'purchase'"), a, ["paper_id", "source"], F.col("action_type").isin("click", "view"), "created_at", b.now(), 60)
    return out.select("action_id", "recent")


@query("o1_presence", sql("""SELECT claim_key, count(DISTINCT experiment) AS n_runs, bool_or(experiment = '1-URGENT') AS in_0, bool_or(experiment = '2-HIGH') AS in_1, bool_or(experiment = '5-LOW') AS in_2 FROM extractions WHERE experiment IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY 1""", "extractions"))
def presence(spark: SparkSession, d: str) -> DataFrame:
    """O1, O5, O6."""
    return sets.presence(b.extractions(spark, d), "experiment", ["claim_key"], ["1-URGENT", "2-HIGH", "5-LOW"])


@query("o2_stability", sql("SELECT claim_key, round(count(DISTINCT experiment) / 5.0, 6) AS share, count(DISTINCT experiment) = 5 AS stable FROM extractions GROUP BY 1", "extractions"))
def stability(spark: SparkSession, d: str) -> DataFrame:
    """O2."""
    return sets.stability(b.extractions(spark, d), "experiment", ["claim_key"], 5).withColumn("share", F.round("share", 6))


@query("o3_pairwise_diff", sql("""x AS (SELECT claim_key, bool_or(experiment = '1-URGENT') AS b, bool_or(experiment = '2-HIGH') AS o FROM extractions WHERE experiment IN ('1-URGENT', '2-HIGH') GROUP BY 1)
    SELECT claim_key, CASE WHEN NOT o THEN 'only_base' WHEN NOT b THEN 'only_other' ELSE 'both' END AS bucket FROM x""", "extractions"))
def pairwise_diff(spark: SparkSession, d: str) -> DataFrame:
    """O3."""
    return sets.pairwise_diff(b.extractions(spark, d), "experiment", ["claim_key"], "1-URGENT", "2-HIGH")


@query("o4_best_per_key", sql("SELECT experiment, claim_key, confidence, position FROM (SELECT *, row_number() OVER (PARTITION BY experiment, claim_key ORDER BY confidence DESC, position) AS n FROM extractions) WHERE n = 1", "extractions"))
def best_per_key(spark: SparkSession, d: str) -> DataFrame:
    """O4, O8."""
    return sets.best_per_key(b.extractions(spark, d), "experiment", ["claim_key"], "confidence", [F.col("position")]).select("experiment", "claim_key", "confidence", "position")


@query("o9_fallback", sql("""e AS (SELECT DISTINCT paper_id, author_id AS item, 'evidence' AS kind FROM comments WHERE is_ours AND is_citable AND created_at < TIMESTAMP '1996-03-01'), c AS (SELECT DISTINCT l_partkey AS paper_id, l_suppkey AS item, 'chunk' AS kind FROM lineitem WHERE l_linenumber = 1)
    SELECT * FROM e UNION ALL SELECT * FROM c WHERE paper_id NOT IN (SELECT paper_id FROM e)""", "comments"))
def evidence_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Evidence, or chunks for papers without."""
    e = b.comments(spark, d).where("is_ours and is_citable and created_at < timestamp_ntz'1996-03-01'").select("paper_id", F.col("author_id").alias("item"), F.lit("evidence").alias("kind")).distinct()
    c = b.table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_partkey").alias("paper_id"), F.col("l_suppkey").alias("item"), F.lit("chunk").alias("kind")).distinct()
    return upserts.fallback(e, c, ["paper_id"])


@query("o7_key_mode", sql("""k AS (SELECT DISTINCT CAST(json_extract_string(details, '$.k') AS BIGINT) AS k FROM actions) SELECT CASE WHEN count(*) FILTER (k IN (SELECT p_partkey FROM part)) >= count(*) FILTER (k IN (SELECT s_suppkey FROM supplier)) THEN 'ids' ELSE 'indexes' END AS mode, count(*) AS keys FROM k""", "actions"))
def key_mode(spark: SparkSession, d: str) -> DataFrame:
    """Which of two relations do the keys hit?"""
    k = b.actions(spark, d).select(F.get_json_object("details", "$.k").cast("long").alias("k")).distinct()
    hit = lambda t, c: b.table(spark, d, t).select(F.col(c).alias("k"), F.lit(1).alias(t)).distinct()
    out = k.join(hit("part", "p_partkey"), "k", "left").join(hit("supplier", "s_suppkey"), "k", "left")
    return out.agg(F.when(F.count("part") >= F.count("supplier"), "ids").otherwise("indexes").alias("mode"), F.count(F.lit(1)).alias("keys"))


@query("e27_escalations", sql("""p AS (SELECT claim_id, position, tie, verdict, confidence, lead(verdict) OVER w AS verdict2, lead(confidence) OVER w AS confidence2 FROM verifications WINDOW w AS (PARTITION BY claim_id ORDER BY position, tie))
    SELECT claim_id, position, tie, CASE WHEN verdict <> verdict2 THEN 'verdict_changed' WHEN round(confidence2 - confidence, 6) > 0.05 THEN 'confidence_improved_only' ELSE 'no_change' END AS outcome FROM p WHERE verdict2 IS NOT NULL""", "verifications"))
def escalations(spark: SparkSession, d: str) -> DataFrame:
    """A first pass compared with the second."""
    w = Window.partitionBy("claim_id").orderBy("position", "tie")
    v = b.verifications(spark, d).withColumns({"verdict2": F.lead("verdict").over(w), "confidence2": F.lead("confidence").over(w)}).where("verdict2 is not null")
    gain = F.round(F.col("confidence2") - F.col("confidence"), 6)
    return v.select("claim_id", "position", "tie", rules.escalation_outcome(F.col("verdict"), F.col("verdict2"), F.lit(0.0), gain).alias("outcome"))


@query("r14_caps", sql("""n AS (SELECT *, row_number() OVER (PARTITION BY paper_id, verdict ORDER BY confidence DESC, claim_id, position, tie) AS of_type FROM verifications),
    k AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY confidence DESC, claim_id, position, tie) AS rank FROM n WHERE of_type <= CASE verdict WHEN 'supported' THEN 3 WHEN 'refuted' THEN 2 ELSE 1 END) SELECT paper_id, claim_id, position, verdict, CAST(rank AS INT) AS rank FROM k WHERE rank <= 5""", "verifications"))
def caps(spark: SparkSession, d: str) -> DataFrame:
    """Caps per type, then the first five."""
    from lectern.operators.ranking import capped

    limits = {"supported": 3, "refuted": 2, "insufficient_evidence": 1}
    return capped(b.verifications(spark, d), ["paper_id"], "verdict", limits, [F.col("confidence").desc(), "claim_id", "position", "tie"], 5).select("paper_id", "claim_id", "position", "verdict", "rank")
