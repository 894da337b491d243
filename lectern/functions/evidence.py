"""Rules on claims, captions, tables, boxes and artifacts, as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.rules import choose
from lectern.functions.text import clean, section_ancestors

#: Words by which a claim asks for tables or figures.
TABLE_WORDS = ("table", "tab.", "ablation", "baseline", "compare", "comparison", "result", "results", "performance", "score", "accuracy", "f1")
FIGURE_WORDS = ("figure", "fig.", "architecture", "pipeline", "framework", "module", "overview", "diagram", "qualitative")
#: Cues of figures in a claim, strong and weak, as patterns on lower-case text with their names.
STRONG_CUES = (
    (r"\bfigures?\b", "figure"), (r"\bfig\b", "fig"), (r"\bfig\.", "fig."), (r"\bplots?\b", "plot"), (r"\bcharts?\b", "chart"), (r"\bgraphs?\b", "graph"), (r"\bcurves?\b", "curve"), (r"\bscatter\b", "scatter"), (r"\bhistogram\b", "histogram"),
    (r"\bheatmap\b", "heatmap"), (r"\bbar\s+chart\b", "bar chart"), (r"\bline\s+chart\b", "line chart"), (r"\bdiagram\b", "diagram"), (r"\barchitecture\b", "architecture"), (r"\bpipeline\b", "pipeline"), (r"\bframework\b", "framework"), (r"\boverview\b", "overview"),
)
WEAK_CUES = (
    (r"\bshown\b", "shown"), (r"\billustrated\b", "illustrated"), (r"\bdepicted\b", "depicted"), (r"\bvisualized\b", "visualized"), (r"\bsee\b", "see"), (r"\bas\s+shown\b", "as shown"), (r"\bin\s+the\s+figure\b", "in the figure"),
    (r"\bin\s+the\s+plot\b", "in the plot"), (r"\bfrom\s+the\s+plot\b", "from the plot"), (r"\bthe\s+curve\b", "the curve"), (r"\bthe\s+graph\b", "the graph"),
)
#: Beginnings of lines that refer to a table or figure in prose and caption nothing.
_LABEL = r"^(?:Table|Tab\.|Figure|Fig\.)\s+\d+(?:\.\d+)?"
INLINE = (
    rf"(?i){_LABEL}\s*,", rf"(?i){_LABEL}.{{0,70}}\brespectively\b", rf"(?i){_LABEL}\s+and\s+(?:Table|Tab\.|Figure|Fig\.)\s+\d+",
    rf"(?i){_LABEL}\s+(?:(?:also|further|additionally|similarly|clearly|notably|explicitly|therefore|thus)\s+)?(?:compares?|shows?|lists?|presents?|summarizes?|summarises?|contains?|depicts?|displays?|reports?|demonstrates?|provides?|includes?|highlights?|reveals?|describes?|details?|illustrates?|gives?|outlines?|plots?|visualizes?|visualises?|indicates?|suggests?)\b",
)
#: Headings, and sentences that open a paragraph.
HEADING = r"^(?:[A-Z]\d*\.)?(?:\d+\.)*\d+\s+[A-Z]|^[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*$"
BLOCK_HEADING = r"^(?:[A-Z]\.?\d*\.)?(?:\d+\.)*\d+\s+[A-Z]|^[A-Z]\.\d+(?:\.\d+)*\b|^Appendix\b"
SECTION_HEADING = (
    r"(?i)^(?:\d+\.?\d*\.?\s+)?(abstract|introduction|related work|background|preliminaries|problem (statement|formulation)|notation|method(?:ology)?s?|approach|model|framework|architecture|experiment(?:s|al (setup|design|results)?)?|evaluation|results?|analysis|ablation|discussion|limitation(?:s)?|future work|conclusion(?:s)?|summary|references?|bibliography|appendix|supplementary|acknowledgments?)\b",
    r"^(?:[A-Z]\.)?(?:\d+)(?:\.\d+)*\.?\s+[A-Z]",
)
OPENERS = r"^(For each domain,|For each prompt,|For each task,|We construct|We evaluate|In this section,|In our experiments,|To this end,|Recent efforts|Finally,|The following sections)\b"
TABLE_LABEL = r"(?i)^(table|tab\.?)\s*\d+"
#: Parts of layout labels.
_IGNORED = ("header", "footer", "footnote", "page number", "pagenumber", "page-number", "section header", "section-header")
_FIGURES = ("figure", "image", "picture", "photo", "illustration", "chart", "graph", "diagram", "plot")
_DETECTED_FIGURES = ("figure", "chart", "graph", "diagram", "plot", "picture", "painting", "drawing", "illustration", "poster", "sign", "artwork", "photo", "photograph", "screen", "monitor", "tv", "television")
#: Detectors by the prefix of their keys.
DETECTORS = (("paddlex_layout", "paddlex_layout"), ("dino", "groundingdino"), ("rtdetr", "rtdetr"))
LONG_LINE = 80


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _prefixed(prefix: str) -> Callable[[Column], Column]:
    return lambda c: F.concat(F.lit(prefix), c)


def _starts(prefix: str) -> Callable[[Column], Column]:
    return lambda c: c.startswith(prefix)


def has_any(c: Column, parts: Sequence[str]) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | F.contains(c, F.lit(p))
    return found


def prefers_table(claim: Column) -> Column:
    return has_any(F.lower(_text(claim)), TABLE_WORDS)


def prefers_figure(claim: Column) -> Column:
    return has_any(F.lower(_text(claim)), FIGURE_WORDS)


def cues(claim: Column, patterns: Sequence[tuple[str, str]]) -> Column:
    low = F.lower(_text(claim))
    return F.array_compact(F.array(*(F.when(low.rlike(p), F.lit(name)) for p, name in patterns)))


def lexical_gate(claim: Column) -> Column:
    return (F.size(cues(claim, STRONG_CUES)) >= 1) | (F.size(cues(claim, WEAK_CUES)) >= 2)


def names_figure(claim: Column) -> Column:
    return _text(claim).rlike(r"(?i)\b(?:Figures?|Fig\.?)\s*\d+\b")


def explicit_labels(claim: Column, kind: str) -> Column:
    """Labels of tables or figures that a claim names by a whole number, in lower case."""
    names = ("table",) if kind == "table" else ("figure", "fig.")
    pattern = r"(?i)\bTable\s*(\d+)\b" if kind == "table" else r"(?i)\b(?:Figure|Fig\.)\s*(\d+)\b"
    numbers = F.regexp_extract_all(_text(claim), F.lit(pattern), F.lit(1))
    return F.array_distinct(F.flatten(F.array(*(F.transform(numbers, _prefixed(name + " ")) for name in names))))


def label_matches(label: Column, candidates: Column) -> Column:
    """candidates: in lower case, without space around them."""
    return F.coalesce(F.array_contains(candidates, F.lower(F.trim(label))), F.lit(False))


def reference_label(kind: str, number: Column) -> Column:
    return F.concat(F.lit(kind.capitalize() + " "), number)


def reference_names(claim: Column) -> Column:
    """What a claim names, as a struct: labels of tables and figures in lower case, sections, and the sections above these."""
    of = lambda p: F.regexp_extract_all(_text(claim), F.lit(rf"(?i)\b(?:{p})\s+(\d+(?:\.\d+)*)\b"), F.lit(1))
    sections = of(r"Section|Sec\.")
    above = F.flatten(F.transform(sections, lambda s: F.slice(section_ancestors(s), 2, 100)))
    return F.struct(F.transform(of(r"Table|Tab\."), _prefixed("table ")).alias("table"), F.transform(of(r"Figure|Fig\."), _prefixed("figure ")).alias("figure"), sections.alias("sections"), above.alias("above"))


def reference_boost(claim: Column, kind: Column, label: Column, section_number: Column, section: Column, names: Column | None = None) -> Column:
    """1.0 where a claim names an object by type and label, 0.9 by label only, 0.7 its section, 0.4 a section above; the most wins.

    names: the claim's `reference_names`, where they were made before the claim met its evidence.
    """
    names = reference_names(claim) if names is None else names
    low, own, number = F.lower(F.trim(_text(label))), F.lower(F.trim(_text(kind))), F.trim(_text(section_number))
    named = {k: F.array_contains(names[k], low) for k in ("table", "figure")}
    titled = F.exists(names["sections"], lambda s: F.contains(F.lower(_text(section)), F.concat(F.lit("section "), s)))
    return choose(
        ((named["table"] & (own == "table")) | (named["figure"] & (own == "figure")), 1.0), (named["table"] | named["figure"], 0.9),
        (((number != "") & F.array_contains(names["sections"], number)) | titled, 0.7), ((number != "") & F.array_contains(names["above"], number), 0.4), other=0.0,
    )


def inline_reference(caption: Column) -> Column:
    t = clean(caption)
    out = F.lit(False)
    for p in INLINE:
        out = out | t.rlike(p)
    return out


def heading_like(line: Column) -> Column:
    t = F.trim(_text(line))
    return (t != "") & (F.length(t) <= 120) & ~t.rlike(r"[.?!,;:]$") & t.rlike(HEADING)


def section_heading(line: Column) -> Column:
    t = _text(line)
    return (t != "") & (F.length(t) <= 80) & (t.rlike(SECTION_HEADING[0]) | t.rlike(SECTION_HEADING[1]))


def caption_heading(line: Column) -> Column:
    """A numbered line, or a short one in capitals."""
    t = clean(line)
    return t.rlike(r"^\d+(?:\.\d+)*\s+[A-Z]") | ((F.upper(t) == t) & (F.lower(t) != t) & (F.length(t) <= 80))


def paragraph_start(line: Column) -> Column:
    return clean(line).rlike(OPENERS)


def lines_of(text: Column) -> Column:
    return F.filter(F.transform(F.split(_text(text), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def prose_preview(text: Column) -> Column:
    """Two long lines, or more than three of which few are short."""
    lines = lines_of(text)
    long = F.size(F.filter(lines, lambda x: F.length(x) > LONG_LINE))
    return (long >= 2) | ((F.size(lines) > 3) & ((F.size(lines) - long) / F.greatest(F.size(lines), F.lit(1)) < 0.6))


def prose_block(lines: Column) -> Column:
    """Lines below a caption that aren't a table's rows."""
    long = F.size(F.filter(lines, lambda x: F.length(x) > LONG_LINE))
    share = (F.size(lines) - long) / F.greatest(F.size(lines), F.lit(1))
    first = F.try_element_at(lines, F.lit(1))
    return (F.size(lines) > 0) & (((F.length(first) <= 120) & first.rlike(BLOCK_HEADING)) | (long >= 2) | (share < 0.6))


def table_text_reason(text: Column, caption: Column) -> Column:
    """Why a recognised table's text isn't better than its caption, or null. Cleaned text has no lines, so these don't count."""
    t, c = clean(text), clean(caption)
    better = F.contains(t, F.lit("|")) | ((c != "") & (F.length(t) > F.length(c) * 1.8))
    return choose((t == "", "empty_text"), (F.length(t) < 80, "too_short"), ((c != "") & (t == c), "identical_to_caption"), (~better, "not_substantially_better_than_caption"))


def parsed_box(c: Column) -> Column:
    """Four numbers out of JSON, or null."""
    box = F.from_json(c, "array<double>")
    return F.when((F.size(box) == 4) & ~F.exists(box, lambda v: v.isNull()), box)


def false_table(kind: Column, label: Column, caption: Column, content: Column, fraction: Column) -> Column:
    """A table that may be plain text: no label of a table, prose, too tall, or no caption of a table."""
    signals = ~F.trim(_text(label)).rlike(TABLE_LABEL) | prose_preview(content) | F.coalesce(fraction > 0.30, F.lit(False)) | ~F.trim(_text(caption)).rlike(TABLE_LABEL)
    return (kind == "table") & signals


def mixed_visual(kind: Column, fraction: Column, spans: Column, content: Column) -> Column:
    return kind.isin("figure", "table") & (F.coalesce(fraction > 0.25, F.lit(False)) | (spans > 15) | prose_preview(content))


def layout_label(raw: Column) -> Column:
    low = F.lower(F.trim(raw))
    caption = F.contains(low, F.lit("caption"))
    return choose((has_any(low, _IGNORED) | F.contains(low, F.lit("note")), F.lit(None).cast("string")), (caption, "caption"), (F.contains(low, F.lit("table")), "table"), (has_any(low, _FIGURES), "figure"))


def detected_label(raw: Column) -> Column:
    low = F.lower(F.trim(raw))
    return choose((F.contains(low, F.lit("table")), "table"), (has_any(low, _DETECTED_FIGURES), "figure"))


def detector(meta: Column) -> Column:
    """The first detector with a key in the metadata (a JSON object)."""
    keys = F.json_object_keys(meta)
    return choose(*((F.exists(keys, _starts(p)), name) for p, name in DETECTORS))


def box_source(meta: Column) -> Column:
    value = lambda k: F.nullif(F.get_json_object(meta, f"$.{k}"), F.lit(""))
    sure = value("object_bbox_confidence")
    return choose(
        (value("bbox_source").isNotNull(), value("bbox_source")), (value("detected_bbox").isNotNull() & (value("detected_bbox") != "[]"), F.coalesce(detector(meta), F.lit("detected_unknown"))),
        (sure.isin("caption_only", "caption"), "caption_only"), (sure == "inferred", "caption_anchor"), (value("highlight_mode").isNotNull(), F.concat(F.lit("highlight_"), value("highlight_mode"))), other="unknown",
    )


def refined(meta: Column, source: Column) -> Column:
    matched = F.lit(False)
    for p, _ in DETECTORS:
        matched = matched | F.coalesce(F.get_json_object(meta, f"$.{p}_matched") == "true", F.lit(False))
    return source.isin(*(name for _, name in DETECTORS)) | parsed_box(F.get_json_object(meta, "$.detected_bbox")).isNotNull() | matched


def detector_score(meta: Column, source: Column) -> Column:
    own = F.coalesce(*(F.when(source == s, F.get_json_object(meta, f"$.{s}_score")) for s in ("paddlex_layout", "groundingdino", "rtdetr")))
    return F.coalesce(own, *(F.get_json_object(meta, f"$.{k}_score") for k in ("dino", "rtdetr", "paddlex_layout"))).cast("double")


def figure_box(meta: Column, own: Column) -> Column:
    """box and source: detected, the object's own, inferred, or else the caption's with eight times its height above it."""
    of = lambda k: parsed_box(F.get_json_object(meta, f"$.{k}"))
    caption = of("caption_bbox")
    height = caption[3] - caption[1]
    above = F.array(caption[0], F.greatest(F.lit(0.0), caption[1] - F.greatest(height * 8.0, F.lit(100.0))), caption[2], caption[3])
    inferred = F.coalesce(of("inferred_bbox"), of("figure_inferred_bbox"))
    source = choose((of("detected_bbox").isNotNull(), "detected_bbox"), (own.isNotNull(), "object_bbox"), (inferred.isNotNull(), "inferred_bbox"), (caption.isNotNull(), "caption_fallback"), other="none")
    return F.struct(F.coalesce(of("detected_bbox"), own, inferred, F.when(caption.isNotNull(), above)).alias("box"), source.alias("source"))


def placeholder(url: Column) -> Column:
    return (_text(url) == "") | _text(url).startswith("TODO:") | _text(url).startswith("test-artifact://")


def artifact_failure(url: Column, mode: Column, repository_url: Column, own: str) -> Column:
    """Why an artifact must not be posted, or null; checks in order. own: the configured owner/name."""
    u = _text(url)
    repo = F.nullif(F.regexp_extract(u, r"^https://github\.com/([^/]+/[^/]+)/blob/", 1), F.lit(""))
    return choose(
        (u == "", "empty"), (u.startswith("TODO:"), "placeholder"), (F.contains(u, F.lit("github.com/test-mode-only/")), "test_mode"), (_text(mode) != "github", "mode"), (_text(repository_url) == "", "no_repository"),
        (F.coalesce(F.lower(repo) != own.lower(), F.lit(True)), "other_repository"),
    )


def verdict_score_failure(score: Column) -> Column:
    return choose((score.isNull(), "missing_verdict_score"), (~score.between(0.0, 10.0), "invalid_verdict_score"))


def comment_failure(phase: Column, karma: Column, cost: Column, url: Column, blocked: Column, body: Column) -> Column:
    """The first check that keeps a comment from being posted."""
    return choose((phase != "REVIEW_ACTIVE", "phase"), (karma < cost, "karma"), (placeholder(url), "url"), (blocked.isNotNull(), "moderation"), (F.trim(_text(body)) == "", "empty"))


def verdict_failure(url: Column, score: Column, cited: Column, eligible: Column) -> Column:
    """The first check that keeps a verdict from being submitted; a score that isn't there is out of range, too."""
    return choose((placeholder(url), "url"), (~F.coalesce(score.between(0.0, 10.0), F.lit(False)), "score"), (cited < 3, "citations"), (~eligible, "eligibility"))


def crowding_note(band: Column) -> Column:
    tier = choose((band == "warm", "neutral"), (band == "goldilocks", "prefer"), other="deprioritize")
    return F.struct(tier.alias("tier"), choose((band == "cold", "too_cold_no_social_proof"), (band.isin("crowded", "saturated"), "too_crowded_low_marginal_value")).alias("reason"))


def score_label(score: Column) -> Column:
    return choose((score == 5, "highly faithful"), (score == 4, "mostly faithful"), (score == 3, "borderline / paraphrase drift"), (score == 2, "substantial drift"), (score == 1, "unsupported / hallucinated"), other="score unavailable")


def score_badge(score: Column) -> Column:
    return choose((score <= 2, "🔴"), (score == 3, "🟠"), (score >= 4, "🟢"), other="⚪")


def tool_summary(name: Column, arguments: Column) -> Column:
    """What a call of a tool was about; arguments: a JSON object."""
    of = lambda k: F.coalesce(F.get_json_object(arguments, f"$.{k}"), F.lit(""))
    found = F.coalesce(F.nullif(of("pattern"), F.lit("")), of("query"))
    return choose((name == "Bash", F.trim(of("command"))), (name == "WebFetch", of("url")), (name.isin("Write", "Edit", "Read"), of("file_path")), (name == "Skill", of("skill")), (name.isin("Grep", "Glob"), found), other=F.left(arguments, F.lit(200)))


def chunk_keys(raw: Column) -> Column:
    """Ids out of a JSON list or a list with commas."""
    listed = F.filter(F.from_json(raw, "array<string>"), lambda x: F.trim(x) != "")
    parts = F.filter(F.transform(F.split(_text(raw), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.trim(_text(raw)).startswith("["), F.coalesce(listed, parts)).otherwise(parts)


def cited_comments(text: Column) -> Column:
    return F.regexp_extract_all(_text(text), F.lit(r"\[\[comment:[^\]]+\]\]"), F.lit(0))


def verdict_artifact(paper: Column, score: Column, body: Column, cited: Column) -> Column:
    """The text of a verdict's file, with the comments that it cites."""
    head = [F.concat(F.lit("- **paper_id**: "), paper), F.concat(F.lit("- **score**: "), score), F.lit(""), F.lit("## Verdict Content"), F.lit(""), body]
    links = F.transform(cited, lambda c: F.concat(F.lit("- [[comment:"), c, F.lit("]]")))
    more = F.when(F.size(cited) > 0, F.concat(F.array(F.lit(""), F.lit("## Cited Comments"), F.lit("")), links)).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.array(*head), more), "\n")


def posted_body(draft: Column) -> Column:
    """A draft without the line that marks it as one, or null."""
    bare = F.regexp_replace(_text(draft), r"^\s*\[DRY-RUN — not posted\]\s*(\n|$)", "")
    return F.nullif(F.regexp_replace(bare, r"^\s+|\s+$", ""), F.lit(""))


def redacted_error(c: Column) -> Column:
    return F.regexp_replace(c, r"'reqId'\s*:\s*'[^']+'", "'reqId':'<redacted>'")


def config_key(tokens: Column, seconds: Column, side: Column, scale: Column) -> Column:
    return F.concat(F.lit("lightonocr2_tok"), tokens, F.lit("_t"), seconds.cast("int"), F.lit("_side"), side, F.lit("_scale"), F.format_string("%.1f", scale))
