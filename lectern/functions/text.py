"""Text, JSON and identifier functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.rules import choose

#: Categories, and other names for them.
CATEGORIES = ("methodology", "results", "comparison", "literature", "scope", "reproducibility")
CATEGORY_ALIASES = {
    "methods": "methodology", "method": "methodology", "experiment": "methodology", "experiments": "methodology", "evaluation": "results", "result": "results", "baselines": "comparison",
    "baseline": "comparison", "related_work": "literature", "related work": "literature", "citations": "literature", "citation": "literature", "dataset": "scope", "datasets": "scope",
    "limitations": "scope", "reproducible": "reproducibility", "reproducibility/replicability": "reproducibility", "code": "reproducibility", "implementation": "reproducibility",
}
#: Review fields by other names, where these differ; which fields are always, sometimes and never worth reading.
FIELD_ALIASES = {
    "review_summary": "summary", "paper_summary": "summary", "summary_of_the_paper": "summary", "summary_of_the_review": "summary", "review": "summary", "strength": "strengths", "weakness": "weaknesses",
    "weaknesses_and_limitations": "weaknesses", "limitations_and_weaknesses": "weaknesses", "question": "questions", "questions_for_authors": "questions", "questions_to_authors": "questions",
    "questions_for_the_authors": "questions", "finaljustification": "final_justification", "overall": "final_justification", "overall_assessment": "final_justification",
    "overall_recommendation": "final_justification", "summary_of_review": "final_justification", "justification": "final_justification", "justification_for_score": "final_justification",
    "limitation": "limitations", "limitations_and_societal_impact": "limitations", "broader_impact": "limitations", "ethics_review": "ethics", "ethical_concerns_review": "ethics", "ethical_review": "ethics",
    "reproducibility_and_replicability": "reproducibility", "contributions": "contribution", "paper_quality": "quality", "score": "rating", "overall_rating": "rating", "reviewer_confidence": "confidence",
}
TIER_A = ("summary", "strengths", "weaknesses", "questions", "final_justification", "limitations")
TIER_B = ("quality", "clarity", "significance", "originality", "soundness", "presentation", "contribution", "ethics", "reproducibility")
TIER_C = ("rating", "confidence", "ethical_concerns", "flag_for_ethics_review", "paper_formatting_concerns", "code_of_conduct_acknowledgement", "responsible_reviewing_acknowledgement", "resubmission", "first_time_reviewer")
#: What comments must not say.
BLOCKED = (
    "fraud", "fabricated", "fabrication", "plagiarism", "plagiarized", "misconduct", "stupid", "idiotic", "incompetent", "worthless", "garbage paper", "trash paper", "fatal flaw", "completely wrong",
    "obviously wrong", "blatantly false",
)


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _mapped(key: Column, table: dict[str, str]) -> Column:
    names = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(F.try_element_at(names, key), key)


def spaced(c: Column) -> Column:
    r"""c with a space for each run of what \s names; most texts have nothing else, which is told without a regular expression."""
    other = [c.contains(x) for x in ("  ", "\n", "\t", "\r", "\x0b", "\f")]
    return F.when(reduce(or_, other), F.regexp_replace(c, r"\s+", " ")).otherwise(c)


def clean(c: Column) -> Column:
    return F.trim(spaced(_text(c)))


def normalized(c: Column) -> Column:
    return F.lower(clean(c))


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a column that is made once, however often f names it."""
    return F.transform(F.array(c), f)[0]


def truncated(c: Column, limit: int) -> Column:
    """Cleaned; what is longer ends in three dots within the limit."""
    return once(clean(c), lambda t: F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.left(t, F.lit(limit - 3))), F.lit("..."))))


def shortened(c: Column, limit: int) -> Column:
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.left(c, F.lit(limit)), F.lit("…")))


def heading(c: Column) -> Column:
    """Without its number, in lower case."""
    return F.lower(F.trim(F.regexp_replace(_text(c), r"^\s*\d+(\.\d+)*\.?\s+", "")))


def section_number(c: Column) -> Column:
    return F.nullif(F.regexp_extract(_text(c), r"^\s*(\d+(\.\d+)*)", 1), F.lit(""))


def section_ancestors(number: Column) -> Column:
    """3.2.1 gives 3.2.1, 3.2 and 3."""
    parts = F.split(number, r"\.")
    return F.transform(F.sequence(F.size(parts), F.lit(1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


def caption_prefix(c: Column) -> Column:
    """kind, label and number of a caption's beginning; nulls if it is none."""
    m = lambda i: F.nullif(F.regexp_extract(_text(c), r"^\s*(?i:(table|tab\.|figure|fig\.))\s*(\d+)", i), F.lit(""))
    kind = F.when(F.lower(m(1)).startswith("tab"), "table").when(m(1).isNotNull(), "figure")
    return F.struct(kind.alias("kind"), F.when(kind.isNotNull(), F.concat(F.initcap(kind), F.lit(" "), m(2))).alias("label"), m(2).cast("int").alias("number"))


def references(c: Column) -> Column:
    """Tables, figures and sections that a text names, in that order, each once."""
    found = lambda p, name: F.transform(F.regexp_extract_all(_text(c), F.lit(p), F.lit(1)), lambda n: F.concat(F.lit(name + " "), n))
    return F.array_distinct(F.concat(found(r"(?i)\btable\s*(\d+(?:\.\d+)*)", "Table"), found(r"(?i)\b(?:figure|fig\.)\s*(\d+(?:\.\d+)*)", "Figure"), found(r"(?i)\b(?:section|sec\.)\s*(\d+(?:\.\d+)*)", "Section")))


def tokens(c: Column, least: int = 3) -> Column:
    """Distinct lower-case words of letters and digits that aren't too short."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(_text(c)), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) >= least))


def jaccard(a: Column, b: Column) -> Column:
    x, y = tokens(a, 1), tokens(b, 1)
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(x, y)))


def best_sentence(raw: Column, claim: Column) -> Column:
    """sentence and score: of equal scores the first; score = shared words / root of the claim's words."""
    words = tokens(claim)
    parts = F.filter(F.transform(F.split(F.trim(_text(raw)), r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s)), lambda s: s != "")
    scored = F.transform(parts, lambda s: F.struct(s.alias("sentence"), F.size(F.array_intersect(tokens(s), words)).alias("hits")))
    start = F.struct(F.lit("").alias("sentence"), F.lit(0).alias("hits"))
    best = F.aggregate(scored, start, lambda x, s: F.when(s["hits"] > x["hits"], s).otherwise(x))
    return F.struct(best["sentence"].alias("sentence"), F.when(F.size(words) > 0, best["hits"] / F.sqrt(F.size(words))).otherwise(0.0).alias("score"))


def first_present(*columns: Column) -> Column:
    """The first that isn't null or empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def category(c: Column) -> Column:
    key = _mapped(F.replace(F.lower(F.trim(c)), F.lit("-"), F.lit("_")), CATEGORY_ALIASES)
    return F.when(key.isin(*CATEGORIES), key)


def field_name(c: Column) -> Column:
    return F.when(_text(c) != "", _mapped(F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_"), FIELD_ALIASES))


def field_policy(field: Column, text: Column) -> Column:
    """include and reason: some fields are always read, some if they are long enough, some never."""
    n = F.length(F.trim(_text(text)))
    reason = choose(
        (field.isin(*TIER_C), "tier_c_metadata_only"), (field.isin(*TIER_A) & (n == 0), "tier_a_empty"), (field.isin(*TIER_A), "tier_a"),
        (field.isin(*TIER_B) & (n >= 100), "tier_b_substantive_text"), (field.isin(*TIER_B), "tier_b_insufficient_text"), (n >= 100, "unknown_substantive_heuristic"), other="unknown_insufficient_text",
    )
    return F.struct(reason.isin("tier_a", "tier_b_substantive_text", "unknown_substantive_heuristic").alias("include"), reason.alias("reason"))


def blocked_phrase(c: Column, phrases: tuple[str, ...] = BLOCKED) -> Column:
    """The first listed phrase that the text contains, or null."""
    low = F.lower(_text(c))
    return F.coalesce(*(F.when(F.contains(low, F.lit(p)), F.lit(p)) for p in phrases))


def page_number(c: Column) -> Column:
    return F.trim(_text(c)).rlike(r"^(?:[-–—]?\s*\d{1,3}\s*[-–—]?|\d{1,3}\s*/\s*\d{1,4}|(?i:page)\s+\d{1,3})$")


def parsed_score(c: Column) -> Column:
    """A score of 1 to 5: alone, after 'score' or 'rating', or anywhere."""
    tries = (r"^\s*([1-5])\s*$", r"(?i)score\s*[:=]?\s*([1-5])", r"(?i)rating\s*[:=]?\s*([1-5])", r"\b([1-5])\b")
    return F.coalesce(*(F.nullif(F.regexp_extract(F.trim(_text(c)), p, 1), F.lit("")) for p in tries)).cast("int")


def score_share(score: Column) -> Column:
    return F.when(score.between(1, 5), F.round((2 * score - 1) / 10.0, 2))


def error_class(c: Column) -> Column:
    low = F.lower(_text(c))
    has = lambda *p: low.rlike("|".join(p))
    return choose((has("429", "rate limit", "too many requests"), "rate_limit"), (has("timeout", "timed out"), "timeout"), (has("401", "403", "unauthorized", "forbidden"), "auth_error"), (has("502", "503", "504", "server error"), "http_error"), other="scoring_exception")


def verdict(c: Column) -> Column:
    v = F.regexp_replace(F.lower(F.trim(_text(c))), r"[\s\-]+", "_")
    return choose((v.isin("supported", "support", "supports"), "supported"), (v.isin("refuted", "contradicted", "contradiction"), "refuted"), (v.isin("insufficient_evidence", "insufficient"), "insufficient_evidence"), (v == "not_verifiable", "not_verifiable"), other="unknown")


def slug(c: Column) -> Column:
    return first_present(F.left(F.trim(F.regexp_replace(_text(c), r"[^A-Za-z0-9._-]+", "-"), F.lit("-")), F.lit(80)), F.lit("run"))


def safe_filename(c: Column) -> Column:
    return F.regexp_replace(_text(c), r'[\\/:*?"<>|]+', "_")


def query_parameter(url: Column, name: str = "id") -> Column:
    return F.nullif(F.regexp_extract(_text(url), rf"[?&]{name}=([^&#]*)", 1), F.lit(""))


def repository(url: Column) -> Column:
    """owner/name from a repository's address or from such a pair itself."""
    path = F.regexp_replace(F.trim(_text(url)), r"^(?:https?://)?(?:www\.)?github\.com/", "")
    return F.nullif(F.regexp_extract(path, r"^([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+?)(?:\.git)?(?:/.*)?$", 1), F.lit(""))


def json_or_null(c: Column, kind: str) -> Column:
    """Parsed if it looks like an object or a list, else null."""
    return F.when(F.ltrim(c).rlike(r"^[\[{]"), F.from_json(c, kind))


def quoted(c: Column) -> Column:
    return F.concat(F.lit("> "), F.regexp_replace(F.trim(_text(c)), "\n", "\n> "))


def usable_ocr(text: Column, confidence: Column, caption: Column) -> Column:
    """Why a recognised text is dropped, or null."""
    t = _text(text)
    plain = F.regexp_replace(t, r"""[^\w\s.,;:!?\-+=%$#@()\[\]/\\"'`~^&*]""", "")
    own, of_caption = tokens(t), tokens(caption)
    repeated = (F.size(own) > 0) & (F.size(of_caption) > 0) & (F.size(F.array_intersect(own, of_caption)) / F.greatest(F.size(own), F.lit(1)) > 0.85)
    return choose((t == "", "empty"), (F.length(t) < 20, "too_short"), (confidence < 0.20, "low_quality"), (F.length(plain) / F.greatest(F.length(t), F.lit(1)) < 0.60, "noisy_text"), (repeated, "caption_duplicate"))
