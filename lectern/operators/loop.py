"""A run over papers in order, in which live actions spend from budgets: what becomes of each paper, and the run's counters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import rules
from lectern.functions.text import blocked_phrase
from lectern.operators.upserts import latest, without_keys
from lectern.operators.windows import summed_in_parts

MONEY = "decimal(28,6)"


def granted(df: DataFrame, cost: Column, budget: float, order: Sequence[Column], coarse: Sequence[Column]) -> tuple[Column, Column]:
    """Two conditions on rows of df that spend from one budget in order: is its cost granted, and is nothing left before it?

    Each row with a cost (positive; null asks for nothing) gets it if what the rows before it left is enough; else it is passed
    over and later ones may still fit. order: columns that ascend and together are unique; coarse: as in summed_in_parts.

    Costs are summed by parts of the order. Where a sum first exceeds what is left, that row and all later ones that cost more
    than what is left are out for good, so there are no more rounds than different costs, each of which sends one row to the driver.
    """
    names = [f"_k{i}" for i in range(len(order))]
    rows = df.select(*[o.alias(n) for o, n in zip(order, names, strict=True)], *[c.alias(f"_c{i}") for i, c in enumerate(coarse)], cost.cast(MONEY).alias("_cost")).where("_cost > 0")
    key, parts = F.struct(*names), [F.col(f"_c{i}") for i in range(len(coarse))]
    of_row = F.struct(*[o.alias(n) for o, n in zip(order, names, strict=True)])
    at = lambda r: F.struct(*[F.lit(r[n]).cast(rows.schema[n].dataType).alias(n) for n in names])
    left, after, yes, out = Decimal(str(budget)), None, F.lit(False), F.lit(False)
    while left > 0:
        cap = F.lit(left).cast(MONEY)
        live = rows.where(F.col("_cost") <= cap)
        live = live if after is None else live.where(key > at(after))
        sums = summed_in_parts(live, [], parts, [F.col(n) for n in names], {"_spent": F.col("_cost")})
        stop = sums.where(F.col("_spent") > cap).orderBy(*names).limit(1).collect()
        fits = (cost.cast(MONEY) > 0) & (cost.cast(MONEY) <= cap)
        fits = fits if after is None else fits & (of_row > at(after))
        if not stop:  # all that are left fit; the last of them may have taken the rest
            end = sums.agg(F.max("_spent").alias("spent"), F.max(key).alias("last")).first()
            if end["spent"] == left:
                out = of_row > at(end["last"])
            yes = yes | fits
            break
        yes = yes | (fits & (of_row < at(stop[0])))
        left -= stop[0]["_spent"] - stop[0]["_cost"]
        if left == 0:
            last = live.where(key < at(stop[0])).agg(F.max(key).alias("last")).first()["last"]
            out = of_row > at(last)
        after = stop[0]
    if budget <= 0:
        out = F.lit(True)
    return F.coalesce(yes, F.lit(False)), F.coalesce(out, F.lit(False))


@dataclass(frozen=True)
class Run:
    """How a run is made: tests and dry runs post nothing; live ones at most so many of each kind."""

    test_mode: bool = True
    live_mode: bool = False
    live_reactive: bool = False
    live_verdict: bool = False
    has_client: bool = True
    allowlisted: bool = False
    karma: float = 100.0
    reactive_budget: int = 1
    verdict_budget: int = 1
    max_papers: int | None = None


def _refusal(run: Run, wanted: bool, allowlist: bool) -> str | None:
    """Why a run does nothing live whatever the paper, but for its budget and client."""
    if not wanted:
        return "live_disabled"
    if run.test_mode or not run.live_mode:
        return "live_gate_failed"
    return "allowlist_required" if allowlist and not run.allowlisted else None


def outcomes(papers: DataFrame, run: Run) -> DataFrame:
    """papers with reactive_status, reactive_live_reason, verdict_status, verdict_live_reason and error (null, or why its comment
    failed), in the order of open_time descending, then paper_id.

    papers: paper_id (long), open_time, hours, has_candidate, recent_reactive, body (of the reply; null or empty: none),
    participated, eligible, recent_verdict, citations (whether there are enough), score (null: none given) and own_score.
    """
    order = [-F.unix_micros(F.col("open_time").cast("timestamp")), F.col("paper_id")]
    coarse = [F.floor(order[0] / 86_400_000_000), order[0], F.floor(F.col("paper_id") / 100_000)]  # ids only order papers of one time
    if run.max_papers is not None:
        first, _ = granted(papers, F.lit(1), run.max_papers, order, coarse)
        papers = papers.where(first)
    # The reply: what stops it, by the paper alone.
    empty = F.trim(F.coalesce("body", F.lit(""))) == ""
    acts = F.col("has_candidate") & ~F.col("recent_reactive")
    failed = rules.choose(
        (rules.phase(F.col("hours")) != "REVIEW_ACTIVE", "phase"), (F.lit(run.karma) < rules.action_cost(F.lit("comment"), F.col("participated")), "karma"),
        (blocked_phrase(F.col("body")).isNotNull(), "moderation"),
    )
    error = F.when(acts & ~empty, failed)
    refusal = _refusal(run, run.live_reactive, False)
    if refusal is None:
        tries = acts & F.lit(run.has_client)
        posts, spent = granted(papers, F.when(tries & ~empty & error.isNull(), 1), run.reactive_budget, order, coarse)
        why = rules.choose((spent, "live_budget_exhausted"), (F.lit(not run.has_client), "live_gate_failed"), (posts, "live_posted"), other="live_gate_failed")
    else:
        posts, spent, why = F.lit(False), F.lit(True), F.lit(refusal)
    dry = F.lit(run.test_mode or run.live_mode) & ~empty & (spent | F.lit(not run.has_client))  # the stub answers; a dry mode posts nothing
    out = papers.withColumns({
        "error": error, "reactive_live_posted": acts & posts,
        "reactive_status": rules.choose((~F.col("has_candidate"), "none"), (F.col("recent_reactive"), "dedup_skipped"), (posts, "live_posted"), (dry, "dry_run"), other="skipped"),
        "reactive_live_reason": rules.choose((~F.col("has_candidate"), "no_candidate"), (F.col("recent_reactive"), "dedup_skipped"), other=why),
    })
    # The verdict: papers whose reply failed don't come to it.
    ready = F.col("eligible") & ~F.col("recent_verdict") & error.isNull()
    score = F.coalesce("score", "own_score")
    wrong = rules.choose((score.isNull(), "missing_verdict_score"), (~score.between(0.0, 10.0), "invalid_verdict_score"))
    refusal = _refusal(run, run.live_verdict, True)
    if refusal is None:
        submits, spent = granted(papers, F.when(ready & F.col("citations") & wrong.isNull() & F.lit(run.has_client), 1), run.verdict_budget, order, coarse)
        why = rules.choose((spent, "live_budget_exhausted"), (F.lit(not run.has_client), "live_gate_failed"), (~F.col("citations"), "no_eligible_verdict"), (wrong.isNotNull(), wrong), (submits, "live_submitted"), other="live_budget_exhausted")
    else:
        submits, why = F.lit(False), F.lit(refusal)
    out = out.withColumns({
        "verdict_live_submitted": ready & submits,
        "verdict_status": rules.choose((~F.col("eligible"), "ineligible"), (F.col("recent_verdict"), "dedup_skipped"), (submits, "live_submitted"), (F.col("citations"), "dry_run"), other="skipped"),
        "verdict_live_reason": rules.choose((~F.col("eligible"), "no_eligible_verdict"), (F.col("recent_verdict"), "dedup_skipped"), other=why),
    })
    none = {c: F.when(F.col("error").isNull(), F.col(c)) for c in ("reactive_live_posted", "reactive_status", "reactive_live_reason", "verdict_live_submitted", "verdict_status", "verdict_live_reason")}
    return out.withColumns(none)


def counters(papers: DataFrame, run: Run) -> DataFrame:
    """One row: what a run over papers (as in outcomes) has seen, drafted, posted and passed over."""
    done = outcomes(papers, run)
    ok, n = F.col("error").isNull(), F.count_if
    status, reason = F.col("reactive_status"), F.col("reactive_live_reason")
    drafted, planned = status == "dry_run", F.col("verdict_status") == "dry_run"
    seen = papers.agg(F.count(F.lit(1)).alias("papers_seen"))
    return seen.crossJoin(done.agg(  # a row and a row
        n(ok).alias("papers_processed"), n(ok & F.col("has_candidate")).alias("reactive_candidates_found"), n(drafted).alias("reactive_drafts_created"),
        n(ok & F.col("eligible")).alias("verdicts_eligible"), n(planned).alias("verdict_drafts_created"), n("reactive_live_posted").alias("live_reactive_posts"), n("verdict_live_submitted").alias("live_verdict_submissions"),
        n(F.col("verdict_live_reason") == "missing_verdict_score").alias("verdict_live_missing_score"), n(F.col("verdict_live_reason") == "invalid_verdict_score").alias("verdict_live_invalid_score"),
        n(status == "dedup_skipped").alias("reactive_dedup_skipped"), n(reason.isin("live_posted", "live_gate_failed", "live_budget_exhausted")).alias("reactive_live_eligible"), n("reactive_live_posted").alias("reactive_live_posted"),
        n(reason == "live_budget_exhausted").alias("live_budget_exhausted"), n(reason == "live_gate_failed").alias("reactive_live_gate_failed"),
        n(ok & ~F.coalesce(drafted, F.lit(False)) & ~F.coalesce(planned, F.lit(False))).alias("skipped"), n(~ok).alias("errors_count"),
    ))


def synced(papers: DataFrame, comments: DataFrame, active: DataFrame, listed: DataFrame, ours: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The stored papers and comments after all active papers and their listed comments were written over them, and one row with
    the numbers of papers and comments that were.

    Keys are paper_id and comment_id; of rows that repeat a key the last listed (the largest `at`) counts. Comments of papers that
    aren't active are left alone; those whose author is `ours` are marked as such.
    """
    active = latest(active, ["paper_id"], [F.col("at").desc()])
    mine = F.col("is_ours") | (F.col("author_id").cast("string") == F.lit(ours) if ours else F.lit(False))
    fresh = listed.join(active.select("paper_id"), "paper_id", "left_semi")
    n = fresh.agg(F.count(F.lit(1)).alias("comments")).crossJoin(active.agg(F.count(F.lit(1)).alias("papers")))  # a row and a row
    fresh = latest(fresh, ["comment_id"], [F.col("at").desc()]).withColumn("is_ours", F.coalesce(mine, F.lit(False)))
    new_papers = without_keys(papers, active, ["paper_id"]).unionByName(active)
    return new_papers, without_keys(comments, fresh, ["comment_id"]).unionByName(fresh), n.select("papers", "comments")
