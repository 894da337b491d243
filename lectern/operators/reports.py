"""Reports on papers as documents of lines: drafts of verdicts, verified claims, retrieval."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import rules
from lectern.functions.report import stripped
from lectern.functions.rules import choose
from lectern.operators import documents as doc
from lectern.sources.shared import written

KEY = ["paper_id"]
#: Why a paper of a band may have a verdict.
BANDS = {
    "cold": "Cold paper — low activity, but strong reactive signal overrides soft penalty.",
    "warm": "Warm paper — moderate activity; strong reactive signal detected.",
    "goldilocks": "Goldilocks paper — optimal participation level for verdict.",
    "crowded": "Crowded paper — high activity, but strong reactive signal overrides soft penalty.",
}
#: Where a score comes from, and the reasons that go with each score.
SOURCE = "heuristic_v0"
REASONS = {
    3.5: "Strong contradiction signal detected (confidence %.2f); high-confidence evidence challenges core claims — conservative weak-reject.",
    4.5: "Moderate contradiction signal detected (confidence %.2f); evidence challenges claims without conclusive refutation — borderline.",
    5.5: "Ambiguous reviewer signals (%d unclear, 0 refuted); insufficient evidence for a directional verdict — neutral.",
    6.5: "No significant contradicting evidence found in reviewer comments; paper appears generally supported — conservative weak-accept.",
}
#: Badges of verdicts, and the order of a review's fields.
BADGES = {"refuted": "🔴 refuted", "insufficient_evidence": "🟠 insufficient_evidence", "supported": "🟢 supported", "not_verifiable": "⚪ not_verifiable"}
FIELDS = ("summary", "strengths", "weaknesses", "questions", "soundness", "presentation", "contribution", "unknown")

#: How many neighbours of a claim's evidence are one row.
RUN = 64


def said(*parts: Column | str) -> Column:
    return F.concat(*[c.cast("string") if isinstance(c, Column) else F.lit(c) for c in parts])


def verdict_plans(papers: DataFrame) -> DataFrame:
    """papers (citable_other, agents, strongest, reacts, unclear) with heat_band, reason_code, eligible, status, score, confidence and rationale.

    Both gates in turn: crowding and a strong contradiction, then three distinct agents to cite. A plan is a dry run always;
    what is skipped has no score.
    """
    band = rules.heat_band(F.col("citable_other"))
    reason = rules.verdict_gate(band, F.col("strongest"), F.col("agents"))
    score = rules.verdict_score(F.col("strongest"), F.col("reacts"), F.col("unclear"))
    sure = choose((score <= 4.5, F.round("strongest", 4)), (score == 5.5, 0.4), other=0.35)
    why = choose(*((score == s, F.format_string(r, F.col("unclear") if "%d" in r else F.col("strongest")) if "%" in r else F.lit(r)) for s, r in REASONS.items()))
    out = papers.withColumns({"heat_band": band, "reason_code": reason}).withColumn("eligible", F.col("reason_code") == "eligible")
    given = lambda c, t: F.when(F.col("eligible"), c.cast(t))
    return out.withColumns({"status": F.when(F.col("eligible"), "dry_run").otherwise("skipped"), "score": given(score, "double"), "confidence": given(sure, "double"), "rationale": given(why, "string")})


def verdict_drafts(plans: DataFrame, citations: DataFrame, candidates: DataFrame, generated_at: str) -> DataFrame:
    """The drafts of eligible plans (with title) as documents by paper.

    citations: paper_id, comment_id (a number that orders them) and author_id, one for each agent; candidates: paper_id, place
    (from 1), comment_id and confidence of contradicted comments, of which the first three are named.
    """
    plans = plans.where("eligible")
    only = plans.select("paper_id")
    cited = doc.lines(citations.join(only, "paper_id", "left_semi"), KEY, [2, F.col("comment_id")], doc.texts(said("- Comment ", F.col("comment_id"), " by agent ", F.coalesce(F.col("author_id").cast("string"), F.lit("unknown")))))
    named = candidates.where("place <= 3").join(only, "paper_id", "left_semi")
    refuted = doc.lines(named, KEY, [3, F.col("place")], doc.texts(said("- Comment ", F.col("comment_id"), ": refuted claim detected (confidence ", F.format_string("%.2f", "confidence"), ")")))
    head = doc.lines(plans, KEY, [0], doc.texts(
        "# Verdict Draft (DRY-RUN — not submitted)", said("Paper: ", F.col("paper_id"), " — ", F.coalesce("title", F.lit(""))), f"Generated: {generated_at}", said("Heat band: ", F.col("heat_band")),
        said("Distinct citable other agents: ", F.col("citable_other")), "",
    ))
    why = doc.lines(plans, KEY, [1], doc.texts(
        "## Why this paper is eligible", said("- ", F.coalesce(choose(*((F.col("heat_band") == b, t) for b, t in BANDS.items())), F.col("heat_band"))), said("- Strongest contradiction confidence: ", F.format_string("%.2f", "strongest")), "",
    ))
    title = ["", "## Reactive evidence summary"]
    found = doc.headed(plans, refuted, KEY, [3], doc.texts(*title), doc.texts(*title, "- No refuted claims detected."))
    score = doc.lines(plans, KEY, [4], doc.texts(
        "", "## Verdict Score", said("- Score: ", F.format_string("%.1f", "score"), " / 10.0"), f"- Source: {SOURCE}", said("- Confidence: ", F.format_string("%.4f", "confidence")), said("- Rationale: ", F.col("rationale")),
    ))
    end = doc.lines(plans, KEY, [5], doc.texts(
        "", "## Proposed verdict rationale", "- Reactive evidence suggests at least one claim in citable other-agent comments is contradicted by the paper.", "- Manual review and score assignment required before any live submission.",
        "", "## Suggested next step", "- Manual review required before any live verdict submission.",
    ))
    cites = doc.lines(plans, KEY, [2], doc.texts("## Citable other-agent comments (3 minimum required for submission)"))
    return doc.document(head, why, cites, cited, found, refuted, score, end)


def _counted(claims: DataFrame, name: Column, section: int) -> DataFrame:
    """A line for each value, most frequent first, then the one met first."""
    g = claims.groupBy("paper_id", name.alias("_name")).agg(F.count(F.lit(1)).alias("_n"), F.min("_seen").alias("_first"))
    g = g.withColumn("_place", F.row_number().over(Window.partitionBy("paper_id").orderBy(F.col("_n").desc(), "_first")))
    return doc.lines(g, KEY, [section, F.col("_place")], doc.texts(said("- ", F.col("_name"), ": ", F.col("_n"))))


def _top(claims: DataFrame, by: Sequence[str], most: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.coalesce("confidence", F.lit(0.0)).desc(), "_seen")
    return claims.where("_verdict = 'refuted' and status = 'success'").withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= most)


def quoted(text: Column) -> Column:
    """A Markdown quotation of a text's lines."""
    return F.concat(F.lit("> "), F.replace(stripped(F.coalesce(text, F.lit(""))), F.lit("\n"), F.lit("\n> ")))


def verification_report(papers: DataFrame, claims: DataFrame, evidence: DataFrame, generated_at: str, most: int = 1400) -> DataFrame:
    """Papers' verified claims by review and field, each with its evidence, as documents.

    papers: paper_id and title; claims: paper_id, review_id, field, claim_index and claim_id (numbers), status, verdict,
    confidence and text; evidence: claim_id, rank, page, section and text. Papers without claims have a summary only. Evidence
    meets its claim by id, so that a paper with very many rows is no single group.
    """
    name = F.coalesce(F.nullif(F.trim("field"), F.lit("")), F.lit("unknown"))
    review = F.coalesce(F.col("review_id").cast("string"), F.lit("unknown"))
    seen = F.struct("review_id", name, "claim_index", "claim_id")
    rows = claims.withColumns({"field": name, "_rid": review, "_verdict": F.coalesce(F.lower(F.trim("verdict")), F.lit("unknown")), "_seen": seen, "status": F.coalesce("status", F.lit("unknown"))})
    # Places of reviews, and of fields within them: one row for each pair.
    known = choose(*((F.col("field") == f, i) for i, f in enumerate(FIELDS)), other=len(FIELDS))
    fields = rows.groupBy("paper_id", "_rid", "field").agg(F.min("review_id").alias("_id"))
    order = {"_review": F.dense_rank().over(Window.partitionBy("paper_id").orderBy(F.col("_id").asc_nulls_last())), "_field": F.row_number().over(Window.partitionBy("paper_id", "_rid").orderBy(known, "field"))}
    fields = fields.withColumns(order).drop("_id")
    placed = written(rows.join(fields, ["paper_id", "_rid", "field"]))  # what follows reads it nine times
    badge = F.coalesce(choose(*((F.col("_verdict") == v, b) for v, b in BADGES.items())), said("⚫ ", F.col("_verdict")))
    here = [6, F.col("_review"), F.col("_field"), F.col("claim_index"), F.col("claim_id")]
    anchor = said("review-", F.col("_rid"), "-c", F.col("claim_index"))

    shown = stripped(F.coalesce("_text", F.lit("")))
    shown = F.when(F.length(shown) > most, F.concat(F.left(shown, F.lit(most)), F.lit("…"))).otherwise(shown)
    # A claim's evidence meets it by id, as runs of neighbours: a run's lines are one row, the first one's behind the claim's own.
    own = doc.texts(said("**Evidence #", F.col("rank"), "** — page ", F.coalesce(F.col("page").cast("string"), F.lit("None")), ", section=", F.coalesce("section", F.lit("None"))), "", quoted(shown), "")
    own = F.filter(F.transform(own, lambda t, i: F.struct(F.col("rank").alias("rank"), i.alias("i"), t.alias("t"))), lambda x: x["t"].isNotNull())
    runs = evidence.withColumn("_text", F.col("text")).groupBy("claim_id", F.floor(F.coalesce("rank", F.lit(-1)) / RUN).alias("_run")).agg(F.flatten(F.collect_list(own)).alias("_lines"), F.max(F.col("rank").isNotNull()).alias("_some"))
    of_claim = Window.partitionBy("claim_id")
    runs = runs.withColumns({"_first": F.col("_run") == F.min("_run").over(of_claim), "_some": F.max("_some").over(of_claim)})
    card = [
        said('<a id="', anchor, '"></a>'), said("##### C", F.col("claim_index"), " — ", badge), "", said("- status: `", F.col("status"), "`"), said("- verification_confidence: `", F.coalesce(F.col("confidence").cast("string"), F.lit("None")), "`"), "",
        "**Claim**", "", quoted(F.col("text")), "", "**Evidence (paper chunks)**", "",
    ]
    none = F.array().cast("array<string>")
    cited = F.coalesce(F.transform(F.array_sort("_lines"), lambda x: x["t"]), none)
    heading = F.when(~F.coalesce("_first", F.lit(True)), none).when(F.col("_some"), doc.texts(*card)).otherwise(doc.texts(*card, "_No parseable evidence_chunk_ids._", ""))
    cards = doc.lines(placed.join(runs, "claim_id", "left"), KEY, [*here, F.coalesce("_run", F.lit(0))], F.concat(heading, cited))

    # One row for each review and for each paper, counted from the claims.
    count = lambda v: F.count_if((F.col("status") == "success") & (F.col("_verdict") == v)).alias(v)
    fields = placed.select("paper_id", "_review", "_field", "field").distinct()
    heads = doc.lines(fields, KEY, [6, F.col("_review"), F.col("_field")], doc.texts(said("### Field: `", F.col("field"), "`"), "", "#### Claims & Verification", ""))
    reviews = placed.groupBy("paper_id", "_review", "_rid").agg(F.count_if(F.col("status") == "success").alias("n"), *(count(v) for v in BADGES))
    mini = [x for v, b in BADGES.items() for x in (f"{b}: **", F.col(v), "**, ")]
    unknown = F.col("n") - sum((F.col(v) for v in BADGES), F.lit(0))
    reviewed = doc.lines(reviews, KEY, [6, F.col("_review")], doc.texts("---", said("## Review `", F.col("_rid"), "`"), "", "**Mini summary**", "", said("- total verified claims: **", F.col("n"), "** (", *mini, "unknown: **", unknown, "**)"), ""))
    worst = _top(placed, ["paper_id", "_review"], 3)
    worst_lines = doc.lines(worst, KEY, [6, F.col("_review"), 0, F.col("_place")], doc.texts(said("  - C", F.col("claim_index"), " (conf=", F.coalesce(F.col("confidence").cast("string"), F.lit("None")), "): [jump](#", anchor, ")")))
    linked = doc.headed(reviews, worst_lines, KEY, [6, F.col("_review"), 0], doc.texts("### Quick links (top refuted)"), F.array().cast("array<string>"))
    bad = doc.lines(_top(placed, ["paper_id"], 10), KEY, [4, F.col("_place")], doc.texts(said("- ", F.col("_rid"), " / C", F.col("claim_index"), ": [", badge, "](#", anchor, ")")))
    quick = doc.headed(papers, bad, KEY, [4], doc.texts("", "### Quick links (top contradicted)", ""), F.array().cast("array<string>"))
    totals = papers.join(rows.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n")), "paper_id", "left")
    title = said("# Verification Report — ", F.col("paper_id"), F.coalesce(F.concat(F.lit(" — "), F.nullif(F.col("title"), F.lit(""))), F.lit("")))
    head = doc.lines(totals, KEY, [0], doc.texts(title, "", f"- Generated at: {generated_at}", said("- Rows: ", F.coalesce("n", F.lit(0))), said("- Paper title: `", F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("(no title)")), "`"), "", "## Summary", ""))
    counts = [_counted(rows, F.col(c), i) for i, c in ((1, "_verdict"), (2, "status"), (3, "field"))]
    names = [doc.lines(papers, KEY, [i], doc.texts(*([""] if i > 1 else []), f"### {t}", "")) for i, t in ((1, "Verdicts"), (2, "Status"), (3, "Source fields"))]
    start = doc.lines(papers, KEY, [5], doc.texts("", "## Reviews", ""))
    return doc.document(head, *names, *counts, quick, bad, start, reviewed, linked, worst_lines, heads, cards)


#: How many chunks, claims and pieces of evidence a retrieval report shows, and how long a bar or a preview is.
CHUNKS_SHOWN, ROWS_SHOWN, CLAIMS_SHOWN, HITS_SHOWN, BAR, PREVIEW = 3, 5, 3, 5, 30, 80


def _first(df: DataFrame, by: Sequence[str], order: Sequence, most: int, place: str = "_place") -> DataFrame:
    return df.withColumn(place, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(place) <= most)


def _bars(counts: DataFrame, section: int) -> DataFrame:
    """A line with a bar for each name (_name, _n, _place), in a block."""
    bar = F.concat(F.rpad("_name", F.greatest(F.length("_name"), F.lit(20)), F.lit(" ")), F.lit(" "), F.repeat(F.lit("█"), F.least(F.col("_n"), F.lit(BAR)).cast("int")))
    return doc.lines(counts, KEY, [section, F.col("_place")], doc.texts(bar))


def retrieval_report(papers: DataFrame, chunks: DataFrame, embeddings: DataFrame, retrieved: DataFrame, generated_at: str) -> DataFrame:
    """Papers' sections, chunks, embeddings and what was retrieved for their first claims, as documents.

    papers: paper_id and title; chunks: paper_id, chunk_id, chunk_index, section, page and text; embeddings: chunk_id, model and
    at; retrieved: paper_id, claim_id (a number), claim_text, rank, bm25, semantic, combined and chunk_id. Of chunks and claims
    each task keeps the first few; sections are counted by tasks first.
    """
    name, text = F.coalesce("section", F.lit("unknown")), F.coalesce("text", F.lit(""))
    none = F.array().cast("array<string>")
    chunks = chunks.withColumns({"section": name, "text": text})
    sections = written(chunks.groupBy("paper_id", F.col("section").alias("_name")).agg(F.count(F.lit(1)).alias("_n"), F.min("page").alias("_page"), F.min("chunk_index").alias("_at"), F.min_by(F.length("text"), "chunk_index").alias("_letters"), F.max("page").alias("_last")))
    in_order = sections.withColumn("_place", F.row_number().over(Window.partitionBy("paper_id").orderBy("_at")))
    by_count = sections.withColumn("_place", F.row_number().over(Window.partitionBy("paper_id").orderBy(F.col("_n").desc(), "_name")))
    shown = written(_first(chunks, KEY, ["chunk_index"], ROWS_SHOWN))
    models = embeddings.join(chunks.select("paper_id", "chunk_id"), "chunk_id").groupBy("paper_id", "model").agg(F.count(F.lit(1)).alias("embedded"), F.max("at").alias("_at"))
    models = models.groupBy("paper_id").agg(F.max_by(F.struct("model", "embedded"), F.struct("_at", "model")).alias("m")).select("paper_id", "m.*")
    sums = sections.groupBy("paper_id").agg(F.max("_last").alias("pages"), F.count(F.lit(1)).alias("sections"), F.sum("_n").alias("chunks"))
    of = papers.join(sums, "paper_id", "left").join(models, "paper_id", "left").na.fill(0, ["pages", "sections", "chunks", "embedded"])
    title, model = F.nullif(F.trim(F.coalesce("title", F.lit(""))), F.lit("")), F.coalesce("model", F.lit("(none)"))
    indexed = [said("- Indexed chunks: **", F.col("chunks"), "**"), said("- Embedded chunks: **", F.col("embedded"), "**"), said("- Embedding model: **", model, "**"), ""]
    head = doc.lines(of, KEY, [0], doc.texts(
        said("# Retrieval Report — ", F.col("paper_id"), F.coalesce(F.concat(F.lit(" — "), title), F.lit(""))), "", f"- Generated at: {generated_at}", F.concat(F.lit("- Paper title: `"), title, F.lit("`")), "",
        "## Pipeline Summary", "", said("- Pages parsed: **", F.col("pages"), "**"), said("- Sections detected: **", F.col("sections"), "**"), said("- Chunks generated: **", F.col("chunks"), "**"), *indexed, "## 1. Parsing", "",
    ))
    parsed = doc.lines(in_order, KEY, [1, F.col("_place")], doc.texts(said("| ", F.col("_place"), " | `", F.col("_name"), "` | ", F.coalesce(F.col("_page").cast("string"), F.lit("")), " | ", F.col("_letters"), " |")))
    parsing = doc.headed(papers, parsed, KEY, [1], doc.texts("### Detected Sections", "", "| # | Section | Start Page | Length (chars) |", "|---:|---|---:|---:|"), doc.texts("> No parsed sections found."))
    total = doc.lines(of, KEY, [2], doc.texts("", "## 2. Chunking", "", said("- Total chunks: **", F.col("chunks"), "**"), ""))
    spread = doc.lines(by_count, KEY, [3, F.col("_place")], doc.texts(said("| `", F.col("_name"), "` | ", F.col("_n"), " |")))
    spreading = doc.headed(papers, spread, KEY, [3], doc.texts("### Chunk Distribution by Section", "", "| Section | #Chunks |", "|---|---:|"), none)
    bars = _bars(by_count, 4)
    barring = doc.headed(papers, bars, KEY, [4], doc.texts("", "```"), none)
    code = lambda c: said("`", F.coalesce(c.cast("string"), F.lit("None")), "`")
    example = doc.lines(shown.where(F.col("_place") <= CHUNKS_SHOWN), KEY, [5, F.col("_place")], doc.texts(said("#### Chunk #", F.col("chunk_index")), "", said("- chunk_id: ", code(F.col("chunk_id"))), said("- section: ", code(F.col("section"))), said("- page: ", code(F.col("page"))), "", "```", stripped(F.col("text")), "```", ""))
    examples = doc.headed(papers, example, KEY, [5], doc.texts("```", "", "### Example Chunks", ""), none)
    index = doc.lines(of, KEY, [6], doc.texts("## 3. Index / Embedding", "", *indexed))
    known = shown.join(embeddings.select("chunk_id").distinct().withColumn("_known", F.lit(True)), "chunk_id", "left")
    flat = stripped(F.replace("text", F.lit("\n"), F.lit(" ")))
    preview = F.when(F.length(flat) > PREVIEW, F.concat(F.left(flat, F.lit(PREVIEW)), F.lit("…"))).otherwise(flat)
    row = doc.lines(known, KEY, [7, F.col("_place")], doc.texts(said("| ", code(F.col("chunk_id")), " | ", code(F.col("section")), " | ", F.coalesce(F.col("page").cast("string"), F.lit("None")), " | ", F.when(F.col("_known"), "yes").otherwise("no"), " | ", preview, " |")))
    rows = doc.headed(papers, row, KEY, [7], doc.texts("### Indexed Chunk Examples", "", "| Chunk ID | Section | Page | Embedded | Preview |", "|---|---|---:|---|---|"), none)

    asked = _first(retrieved.groupBy("paper_id", "claim_id").agg(F.first("claim_text").alias("claim_text")), KEY, ["claim_id"], CLAIMS_SHOWN, "_query")
    hits = retrieved.drop("claim_text").join(asked.select("paper_id", "claim_id", "_query"), ["paper_id", "claim_id"]).join(chunks.select("chunk_id", "section", "page", "text"), "chunk_id")
    hits = written(_first(hits, ["paper_id", "claim_id"], ["rank"], HITS_SHOWN))
    score = lambda c: F.format_string("%.3f", F.coalesce(c, F.lit(0.0)).cast("double"))
    at = [9, F.col("_query")]
    table = doc.lines(hits, KEY, [*at, 1, F.col("_place")], doc.texts(said("| ", F.col("_place"), " | ", code(F.col("section")), " | ", F.coalesce(F.col("page").cast("string"), F.lit("None")), " | ", score(F.col("bm25")), " | ", score(F.col("semantic")), " | ", score(F.col("combined")), " |")))
    snippet = doc.lines(hits, KEY, [*at, 2, F.col("_place")], doc.texts(said("##### Rank #", F.col("_place")), "", said("- chunk_id: ", code(F.col("chunk_id"))), said("- section: ", code(F.col("section"))), said("- page: ", code(F.col("page"))), "", "```", stripped(F.col("text")), "```", ""))
    query = [said("### Query #", F.col("_query")), "", said("- claim_id: ", code(F.col("claim_id"))), "", "```", stripped(F.coalesce("claim_text", F.lit(""))), "```", ""]
    queries = doc.headed(asked, table, KEY, at, doc.texts(*query, "| Rank | Section | Page | BM25 | Semantic | Score |", "|---:|---|---:|---:|---:|---:|"), doc.texts(*query, "_No retrieval results found._", ""))
    snippets = doc.headed(asked, snippet, KEY, [*at, 2], doc.texts("", "#### Evidence Snippets", ""), none)
    shown_claims = doc.headed(papers, queries, KEY, [9], none, doc.texts("> No retrieval preview rows found."))
    begin = doc.lines(papers, KEY, [8], doc.texts("", "## 4. Retrieval Preview", ""))
    found = hits.groupBy("paper_id", F.col("section").alias("_name")).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("_query", "_place")).alias("_at"))
    found = found.withColumn("_place", F.row_number().over(Window.partitionBy("paper_id").orderBy(F.col("_n").desc(), "_at")))
    cover = doc.lines(found, KEY, [10, F.col("_place")], doc.texts(said("| `", F.col("_name"), "` | ", F.col("_n"), " |")))
    covered = doc.headed(papers, cover, KEY, [10], doc.texts("## 5. Retrieval Coverage", "", "| Section | Retrieved Count |", "|---|---:|"), none)
    return doc.document(head, parsing, parsed, total, spreading, spread, barring, bars, examples, example, index, rows, row, begin, shown_claims, queries, table, snippets, snippet, covered, cover)
