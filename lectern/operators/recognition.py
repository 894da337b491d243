"""Audits of what was recognised in figures and of their boxes: distributions in one pass, latencies, samples, sentences, reports.

An audit is made for each scope (such as papers; none: all rows together). Values of a dimension are counted by tasks first, and of
the slowest rows and first messages each task keeps a few, so that a scope with very many rows is never brought together.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.rules import choose
from lectern.operators import aggregates
from lectern.operators import documents as doc
from lectern.operators.reports import said

ACCEPTED, REJECTED, NEVER = "accepted", "rejected_after_inference", "never_attempted"
#: Reasons for which recognition was never tried, and the reason of a failure that has an error's type.
NOT_TRIED = ("caption_only", "no_bbox", "bbox_too_small", "dependency_missing", "render_failed", "disabled", "pymupdf_not_installed", "lightonai_not_installed")
FAILED = "inference_failed"
#: boxes' confidences in the order of a report.
CONFIDENCES = ("high", "inferred", "caption_only", "unknown")
FEW, MESSAGE_LETTERS, DOMINANT = 5, 150, 0.35


def distributions(rows: DataFrame, scope: Sequence[str], dimensions: Mapping[str, Column], sums: Mapping[str, Column], seen: Column) -> DataFrame:
    """scope, dimension, value, place, n and sums: each dimension's values, the most frequent first, then the one seen first.

    Rows are added up by all dimensions at once, and only these sums are grouped by each dimension (grouping sets), so that a row is
    shuffled once at most, not once for each dimension; dimension 'all' holds the totals. A row whose dimension is null has no value in it.
    """
    names = [f"_d_{d}" for d in dimensions]
    keyed = rows.withColumns({n: c.cast("string") for n, c in zip(names, dimensions.values(), strict=True)} | {f"_s_{k}": c for k, c in sums.items()} | {"_seen": seen})
    added = keyed.groupBy(*scope, *names).agg(F.count(F.lit(1)).alias("n"), F.min("_seen").alias("_first"), *[F.sum(f"_s_{k}").alias(k) for k in sums])
    own = [F.col(c) for c in scope]
    sets = [[*own], *([*own, F.col(n)] for n in names)]
    grouped = added.groupingSets(sets, *own, *[F.col(n) for n in names]).agg(
        F.sum("n").alias("n"), F.min("_first").alias("_first"), *[F.sum(k).alias(k) for k in sums], choose(*((F.grouping(F.col(n)) == 0, d) for n, d in zip(names, dimensions, strict=True)), other="all").alias("dimension"),
    )
    value = F.coalesce(*[F.col(n) for n in names])
    found = grouped.withColumn("value", value).where("(dimension = 'all' and n > 0) or value is not null").drop(*names)
    place = F.row_number().over(Window.partitionBy(*scope, "dimension").orderBy(F.col("n").desc(), "_first"))
    return found.withColumn("place", place).drop("_first")


def _one(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("long")


def with_status(figures: DataFrame) -> DataFrame:
    """figures (attempted, text) with status."""
    read = F.trim(F.coalesce("text", F.lit(""))) != ""
    return figures.withColumn("status", choose((~F.coalesce("attempted", F.lit(False)), NEVER), (read, ACCEPTED), other=REJECTED))


def counts(figures: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Distributions of reasons, confidences of boxes and (where inference failed) types of errors, with outcomes.

    figures: scope, position, attempted, text, reason, confidence and error_type.
    """
    named = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other))
    dimensions = {"reason": named("reason", "none"), "confidence": named("confidence", "unknown"), "error_type": F.when(F.col("reason") == FAILED, named("error_type", "unknown"))}
    rows = with_status(figures)
    return distributions(rows, scope, dimensions, {name: _one(F.col("status") == s) for name, s in (("accepted", ACCEPTED), ("rejected", REJECTED), ("never", NEVER))}, F.col("position"))


def samples(figures: DataFrame, scope: Sequence[str], few: int = FEW) -> DataFrame:
    """scope, place and message: the first different messages of failed inferences, cut to a length."""
    message = F.left(F.trim(F.coalesce("error_message", F.lit(""))), F.lit(MESSAGE_LETTERS))
    g = figures.where(F.col("reason") == FAILED).withColumn("message", message).where("message <> ''").groupBy(*scope, "message").agg(F.min("position").alias("_first"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy(*scope).orderBy("_first"))).where(F.col("place") <= few).drop("_first")


def _timed(figures: DataFrame) -> DataFrame:
    return with_status(figures).where(F.coalesce("attempted", F.lit(False)) & F.col("elapsed").isNotNull())


def latencies(figures: DataFrame, scope: Sequence[str]) -> DataFrame:
    """scope, n_timed, total, mean, median and p95 of seconds, to a tenth."""
    timed = _timed(figures).select(*scope, "elapsed") if scope else _timed(figures).select(F.lit(0).alias("_all"), "elapsed")
    keys = list(scope) or ["_all"]
    rows = aggregates.ordered_statistics(timed, keys, "elapsed")
    tenth = lambda c: F.round(c, 1)
    return rows.select(*scope, F.col("n").alias("n_timed"), tenth(F.col("mean") * F.col("n")).alias("total"), *(tenth(F.col(c)).alias(c) for c in ("mean", "median", "p95")))


def slowest(figures: DataFrame, scope: Sequence[str], few: int = FEW) -> DataFrame:
    """scope, place, label, page, elapsed (to a tenth) and outcome of the slowest figures."""
    w = Window.partitionBy(*scope).orderBy(F.col("elapsed").desc(), "position")
    rows = _timed(figures).withColumn("place", F.row_number().over(w)).where(F.col("place") <= few)
    return rows.select(*scope, "place", "label", "page", F.round("elapsed", 1).alias("elapsed"), F.coalesce(F.nullif("outcome", F.lit("")), F.col("status")).alias("outcome"))


def notes(found: DataFrame, scope: Sequence[str]) -> DataFrame:
    """scope, place and note: up to five sentences on `counts`, from its numbers alone. Shares are rounded half to even."""
    d, v = F.col("dimension"), F.col("value")
    only = lambda condition, c: F.coalesce(F.sum(F.when(condition, F.col(c))), F.lit(0))
    every, high = d == "all", (d == "confidence") & (v == "high")
    rejection = F.min_by(v, F.when((d == "reason") & ~v.isin(*NOT_TRIED, "none"), F.col("place")))
    s = found.groupBy(*scope).agg(
        *(only(every, c).alias(c) for c in ("n", "accepted", "rejected", "never")), only((d == "reason") & (v == "caption_only"), "n").alias("captions"), rejection.alias("why"),
        *(only(high, c).alias(f"high_{c}") for c in ("n", "accepted", "never")),
    )
    c = {x: F.col(x) for x in s.columns}
    share = lambda a, b: F.bround(100.0 * a / b, 0).cast("long")
    tried = c["accepted"] + c["rejected"]
    better = F.when(c["high_accepted"] > c["high_never"], "high-confidence bboxes show better OCR coverage.").otherwise("even high-confidence bboxes have significant never-attempted figures.")
    sentences = F.array(
        said(share(c["never"], c["n"]), "% of figures (", c["never"], "/", c["n"], ") were never attempted — OCR did not run, typically due to caption_only bbox or missing dependencies."),
        F.when(tried == 0, "No OCR inference was attempted for any figure in this set.").otherwise(said("Of ", tried, " attempted figures, ", c["accepted"], " were accepted (", share(c["accepted"], F.nullif(tried, F.lit(0))), "% acceptance rate).")),
        F.when(c["captions"] / c["n"] > DOMINANT, said("caption_only is the leading skip reason (", c["captions"], "/", c["n"], " figures) — these figures have no reliable crop region because only a caption span was found.")),
        F.when(c["rejected"] > 0, said(c["rejected"], " figures passed inference but were rejected by quality filter (", share(c["rejected"], F.nullif(tried, F.lit(0))), "% of attempted)", F.coalesce(F.concat(F.lit(" (most common: "), c["why"], F.lit(")")), F.lit("")), ".")),
        F.when(c["high_n"] > 0, said("Figures with 'high' bbox confidence: ", c["high_accepted"], "/", c["high_n"], " accepted, ", c["high_never"], " never attempted — ", better)),
    )
    return s.where("n > 0").select(*scope, F.posexplode(F.filter(sentences, lambda x: x.isNotNull())).alias("place", "note")).withColumn("place", F.col("place") + 1)


def report(scopes: DataFrame, figures: DataFrame, key: str, generated_at: str) -> DataFrame:
    """The audit of each scope (key, one row each in scopes; those without figures too) as a document."""
    scope = [key]
    found, missing = counts(figures, scope), "_No figure evidence objects found._"
    c, place = {x: F.col(x) for x in found.columns}, F.col("place")
    tried = c["accepted"] + c["rejected"]
    row = lambda *cells: said("| ", *[x for i, cell in enumerate(cells) for x in ((" | ",) if i else ()) + (cell,)], " |")
    code = lambda x: F.concat(F.lit("`"), F.coalesce(x.cast("string"), F.lit("")), F.lit("`"))
    table = lambda title, level, *names: ["", f"{'#' * level} {title}", "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    totals = found.where("dimension = 'all'")
    rate = F.when(tried > 0, F.format_string("%.1f%%", 100.0 * c["accepted"] / tried)).otherwise("N/A")
    summary = doc.lines(totals, scope, [1, 0], doc.texts(
        *table("Aggregate Summary", 2, "Metric", "Count"), row("Total figures", c["n"]), row("OCR attempted", tried), row("Accepted", c["accepted"]), row("Rejected after inference", c["rejected"]), row("Never attempted", c["never"]), row("Acceptance rate (among attempted)", rate),
    ))
    head = doc.headed(scopes, summary, scope, [1], *(doc.texts("# Figure OCR Audit Report", "", said("**Paper:** `", F.col(key), "`  "), f"**Generated:** {generated_at}  ", *more) for more in ((), ("", missing))))
    of = lambda name: found.where(F.col("dimension") == name)
    plain = [row(code(c["value"]), c["n"])]
    outcome = [row(code(c["value"]), c["n"], tried, c["accepted"], c["rejected"], c["never"])]
    order = choose(*((c["value"] == v, i) for i, v in enumerate(CONFIDENCES)), other=len(CONFIDENCES))
    timed = latencies(figures, scope)
    t = {x: F.col(x) for x in timed.columns}
    times = [row(name, said(t[x], "" if x == "n_timed" else "s")) for name, x in (("Figures timed", "n_timed"), ("Total elapsed", "total"), ("Mean per figure", "mean"), ("Median per figure", "median"), ("p95 per figure", "p95"))]
    slow = row(code(F.col("label")), F.coalesce(F.col("page").cast("string"), F.lit("")), said(F.col("elapsed"), "s"), F.col("outcome"))
    # Each section: its rows by place, and a heading where it has any.
    sections = [
        (2, doc.lines(of("reason"), scope, [2, place], doc.texts(*plain)), table("Skip Reason Distribution", 2, "Skip Reason", "Count")),
        (3, doc.lines(of("confidence"), scope, [3, place], doc.texts(*plain)), table("BBox Confidence Distribution", 2, "BBox Confidence", "Count")),
        (4, doc.lines(of("confidence"), scope, [4, order, place], doc.texts(*outcome)), table("OCR Outcomes by BBox Confidence", 2, "BBox Confidence", "Total", "Attempted", "Accepted", "Rejected", "Never Attempted")),
        (5, doc.lines(of("error_type"), scope, [5, place], doc.texts(*plain)), ["", "## Inference Failure Diagnostics", *table("Top OCR Error Types", 3, "Error Type", "Count")]),
        (6, doc.lines(samples(figures, scope), scope, [6, place], doc.texts(said("- `", F.col("message"), "`"))), ["", "### Sample Error Messages", ""]),
        (7, doc.lines(timed, scope, [7, 0], doc.texts(*times)), table("Latency Statistics (Attempted Figures)", 2, "Metric", "Value")),
        (8, doc.lines(slowest(figures, scope), scope, [8, place], doc.texts(slow)), table(f"Slowest {FEW} Figures", 3, "Label", "Page", "Elapsed", "Outcome")),
        (9, doc.lines(notes(found, scope), scope, [9, place], doc.texts(said("- ", F.col("note")))), ["", "## Interpretation Notes", ""]),
    ]
    parts = [head, summary]
    for i, body, title in sections:
        untimed = ["", "## Latency Statistics", "", "_No timing data available._"] if i == 7 else []
        parts += [body, doc.headed(totals.select(key), body, scope, [i], doc.texts(*title), doc.texts(*untimed) if untimed else F.array().cast("array<string>"))]
    return doc.document(*parts)


def box_audit(objects: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Distributions of objects by type and by source of their boxes: n, refined and the mean score of those that are refined and have one.

    objects: scope, position, object_type, source, refined and score. Scores are added up as decimals, so that a mean that lies
    between two thousandths is rounded up in any order of rows.
    """
    score = F.when(F.col("refined") & (F.col("score") != 0), F.col("score")).cast("decimal(18,6)")
    sums = {"refined": _one(F.col("refined")), "_score": score, "_scored": _one(score.isNotNull())}
    found = distributions(objects, scope, {"type": F.col("object_type"), "source": F.col("source")}, sums, F.col("position"))
    mean = F.col("_score").cast("decimal(28,6)") / F.nullif(F.col("_scored"), F.lit(0).cast("long")).cast("decimal(20,0)")
    return found.withColumn("mean_score", F.round(mean, 3).cast("double")).drop("_score", "_scored")
