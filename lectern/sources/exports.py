"""A dataset of ordered JSON-lines files with a manifest and two reports, in one pass over each table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lectern.sources.shared import tidy


@dataclass(frozen=True)
class File:
    """A file of a table's rows: in the folder, ordered by columns, with further counts (name: SQL condition) taken on the way."""

    folder: str
    table: str
    order: Sequence[str]
    columns: Sequence[str] = ()
    counts: Mapping[str, str] = field(default_factory=dict)


#: The files of an export, their folders, orders and columns.
FILES = {
    "papers.jsonl": File("raw", "papers", ["paper_id"]),
    "comments.jsonl": File("raw", "comments", ["paper_id", "created_at", "comment_id"], counts={"comments_ours": "is_ours", "comments_citable_other": "NOT is_ours AND is_citable"}),
    "actions.jsonl": File("raw", "actions", ["paper_id", "created_at", "action_id"]),
    "karma_ledger.jsonl": File("raw", "karma", ["paper_id", "created_at", "ledger_id"]),
    "verdict_state.jsonl": File("raw", "verdict_state", ["paper_id"]),
    "extracted_claims.jsonl": File("gsr_structured", "claims", ["paper_id", "comment_id", "created_at"]),
    "claim_verifications.jsonl": File("gsr_structured", "verifications", ["paper_id", "comment_id", "created_at"]),
    "reactive_drafts.jsonl": File("gsr_structured", "drafts", ["paper_id", "created_at", "draft_id"]),
    "run_summary.jsonl": File("policy", "run_summary", ["paper_id"]),
    "action_traces.jsonl": File("policy", "actions", ["paper_id", "created_at", "action_id"], ["action_id", "paper_id", "action_type", "external_id", "github_file_url", "created_at", "status", "error_message", "details"]),
}
#: What the reports call the counts.
STATISTICS = {
    "Papers": "papers.jsonl", "Total comments": "comments.jsonl", "Our comments": "comments_ours", "Citable other-agent comments": "comments_citable_other", "Agent actions": "actions.jsonl", "Karma ledger entries": "karma_ledger.jsonl",
    "Extracted claims": "extracted_claims.jsonl", "Claim verifications": "claim_verifications.jsonl", "Reactive drafts": "reactive_drafts.jsonl", "Verdict state rows": "verdict_state.jsonl",
}


def opened(c: Column) -> Column:
    """A text that is a JSON object or list as that, any other as it is."""
    begun = F.ltrim(c)
    return F.coalesce(F.when(begun.startswith("{") | begun.startswith("["), F.try_parse_json(c)), c.cast("variant"))


def summarised_runs(papers: DataFrame, verdict_state: DataFrame | None, actions: DataFrame) -> DataFrame:
    """Papers with the state of their verdict and how many actions they had."""
    keep = lambda df, names: df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in names])
    out = keep(papers, ["paper_id", "title", "state", "open_time", "review_end_time", "verdict_end_time"])
    if verdict_state is not None:
        out = out.join(keep(verdict_state, ["paper_id", "eligibility_state", "submitted", "distinct_citable_other_agents", "internal_confidence"]), "paper_id", "left")
    n = actions.groupBy("paper_id").agg(F.count(F.lit(1)).alias("action_count"))
    return out.join(n, "paper_id", "left").withColumn("action_count", F.coalesce("action_count", F.lit(0)))


def _written(df: DataFrame, f: File, path: str, name: str, compression: str = "none") -> dict:
    """Writes one file's lines in order, as parts whose names follow it; what was counted while they were written."""
    if f.columns:
        df = df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in f.columns])
    marks = {k: F.expr(v) for k, v in f.counts.items()}
    lines = F.to_json(F.struct(*[opened(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]), {"ignoreNullFields": "false"})
    order = [F.col(c).asc_nulls_first() for c in f.order if c in df.columns]
    rest = [c for c, t in df.dtypes if c not in f.order and "map<" not in t]
    tie = F.xxhash64(F.lit(0), *rest)  # so that equal keys can be split
    # Ranges are sampled from the columns, which alone are shuffled and sorted; a line is made behind them: once.
    rows = df.repartitionByRange(*order, tie)
    made = [lines.alias("value"), *[v.alias(f"_{k}") for k, v in marks.items()]]
    if any("map<" in t for _, t in df.dtypes):  # these have no order but that of their lines
        rows = rows.select(*[c for c in f.order if c in df.columns], tie.alias("_tie"), *made).sortWithinPartitions(*order, "_tie", "value")
    else:
        rows = rows.sortWithinPartitions(*order, tie, *rest).select(*made)
    seen = Observation(name)
    # The checksum doesn't depend on the rows' order.
    rows = rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.bit_xor(F.xxhash64("value")), F.lit(0).cast("long")).alias("checksum"), *[F.count_if(f"_{k}").alias(k) for k in marks])
    rows.select("value").write.mode("overwrite").option("compression", compression).text(path)
    tidy(df.sparkSession)
    return seen.get


def export(tables: Mapping[str, DataFrame], root: str, spark: SparkSession, title: str = "Review trajectory", generated_at: str = "", compression: str = "none") -> DataFrame:
    """Writes all FILES, reports and the manifest below root; returns the manifest: file, folder, rows, checksum.

    tables: by the names in FILES; what is missing makes an empty file. run_summary is made of papers, verdict_state and actions.
    compression: of the files' parts, as Spark names it; they are plain text otherwise, which takes many times the tables' own size.
    """
    tables = dict(tables)
    if "run_summary" not in tables and {"papers", "actions"} <= tables.keys():
        tables["run_summary"] = summarised_runs(tables["papers"], tables.get("verdict_state"), tables["actions"])
    counts: dict[str, int] = {}
    manifest = []
    for name, f in FILES.items():
        path = f"{root.rstrip('/')}/{f.folder}/{name}"
        if f.table in tables:
            seen = _written(tables[f.table], f, path, name, compression)
        else:
            spark.createDataFrame([], "value string").write.mode("overwrite").text(path)
            seen = {"rows": 0, "checksum": 0}
        counts |= {name: seen["rows"], **{k: seen.get(k, 0) for k in f.counts}}
        manifest.append((name, f.folder, seen["rows"], seen["checksum"]))
    out = spark.createDataFrame(manifest, "file string, folder string, rows long, checksum long")
    out.coalesce(1).write.mode("overwrite").json(f"{root.rstrip('/')}/manifest")
    values = {k: counts[v] for k, v in STATISTICS.items()}
    card = [f"# Dataset Card — {title}", "", "## Purpose", "Papers, comments, actions, extracted claims, verifications and drafts of a review agent's run, for training and evaluation.", "", "## Source", f"- **Generated**: {generated_at}", "", "## Files Exported"]
    card += [f"- `{n}`: {counts[n]} rows" for n in sorted(FILES)] + ["", "## Summary Statistics", *[f"- {k}: {v}" for k, v in values.items()]]
    card += ["", "## Known Limitations", "- One run; tables that were missing are empty files.", "", "## Privacy and Safety Note", "**Review before publishing.** Comments and drafts may hold personal or confidential text."]
    stats = ["# Export Summary Statistics", "", f"Generated: {generated_at}", "", "| Metric | Count |", "|--------|------:|", *[f"| {k} | {v} |" for k, v in values.items()]]
    for name, lines in (("dataset_card.md", card), ("summary_stats.md", stats)):
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(f"{root.rstrip('/')}/reports/{name}")
    return out
