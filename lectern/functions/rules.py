"""Review-phase, crowding, budget and verdict rules as column expressions. `now` is always given, never read from a clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REVIEW_HOURS, VERDICT_HOURS = 48, 72
MIN_OTHERS, MIN_CONFIDENCE, STRONG, MEDIUM, RESERVE = 3, 0.6, 0.75, 0.65, 15.0
CONTRADICTIONS = ("refuted", "contradicted", "contradiction")
#: Crowding score by number of distinct citable agents; from 7 on the last one holds.
CROWDING = (0.15, 0.75, 1.0, 0.95, 0.75, 0.55, 0.35, 0.10)


def choose(*arms: tuple[Column, object], other: object = None) -> Column:
    """The value of the first arm whose condition holds."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    out = F.when(arms[0][0], lit(arms[0][1]))
    for condition, value in arms[1:]:
        out = out.when(condition, lit(value))
    return out.otherwise(lit(other))


def elapsed_hours(now: Column, opened: Column) -> Column:
    """Hours since opened, exact to the microsecond."""
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    return (micros(now) - micros(opened)) / F.lit(3_600_000_000.0)


def phase(hours: Column) -> Column:
    """Ends are inclusive: 48 h is still review, 72 h still verdict."""
    return choose((hours < 0, "NEW"), (hours <= REVIEW_HOURS, "REVIEW_ACTIVE"), (hours <= VERDICT_HOURS, "VERDICT_ACTIVE"), other="EXPIRED")


def micro_phase(hours: Column) -> Column:
    """Ends are exclusive, and a paper that isn't open yet is in its seed window."""
    ends = ((12, "SEED_WINDOW"), (36, "BUILD_WINDOW"), (48, "LOCK_IN_WINDOW"), (60, "ELIGIBILITY_WINDOW"), (72, "SUBMISSION_WINDOW"))
    return choose(*((hours < h, name) for h, name in ends), other="EXPIRED")


def heat_band(others: Column) -> Column:
    return choose((others <= 0, "cold"), (others == 1, "warm"), (others <= 3, "goldilocks"), (others <= 6, "crowded"), other="saturated")


def crowding_score(others: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, CROWDING)), (F.least(F.greatest(others, F.lit(0)), F.lit(7)) + 1).cast("int"))


def is_contradiction(verdict: Column) -> Column:
    return F.coalesce(F.lower(F.trim(verdict)).isin(*CONTRADICTIONS), F.lit(False))


def action_cost(action: Column, participated: Column) -> Column:
    return choose((action == "verdict", 0.0), (participated, 0.1), other=1.0)


def opportunity(hours: Column, participated: Column, karma: Column) -> Column:
    """SEED, FOLLOWUP, VERDICT_READY or SKIP."""
    micro = micro_phase(hours)
    can_seed = ~participated & (karma >= RESERVE) & (karma >= 1.0)
    return choose(
        (phase(hours).isin("NEW", "EXPIRED"), "SKIP"),
        ((micro == "SEED_WINDOW") & can_seed, "SEED"),
        (micro.isin("BUILD_WINDOW", "LOCK_IN_WINDOW") & participated & (karma >= 0.1), "FOLLOWUP"),
        (micro.isin("ELIGIBILITY_WINDOW", "SUBMISSION_WINDOW") & participated, "VERDICT_READY"),
        other="SKIP",
    )


def eligibility(hours: Column, participated: Column, others: Column, artifact: Column, confidence: Column, submitted: Column, skipped: Column) -> Column:
    """The eight-state cascade, terminal states first."""
    return choose(
        (submitted, "SUBMITTED"),
        (phase(hours) == "EXPIRED", "EXPIRED"),
        (skipped, "SKIPPED_BY_POLICY"),
        (~participated, "NOT_PARTICIPATED"),
        (others < MIN_OTHERS, "PARTICIPATED_BUT_NOT_ENOUGH_OTHERS"),
        ((phase(hours) != "VERDICT_ACTIVE") | ~artifact, "ENOUGH_OTHERS_BUT_NOT_IN_VERDICT_WINDOW"),
        (confidence < MIN_CONFIDENCE, "ELIGIBLE_LOW_CONFIDENCE"),
        other="ELIGIBLE_READY",
    )


def can_submit(hours: Column, participated: Column, others: Column, artifact: Column, confidence: Column, submitted: Column) -> Column:
    return participated & (phase(hours) == "VERDICT_ACTIVE") & (others >= MIN_OTHERS) & artifact & (confidence >= MIN_CONFIDENCE) & ~submitted


def verdict_gate(band: Column, strongest: Column, others: Column) -> Column:
    """Why a verdict is held back, or 'eligible'."""
    weak = strongest.isNull() | (strongest < STRONG)
    return choose(
        (band == "saturated", "saturated_low_value_v0"),
        (weak & (band == "cold"), "cold_no_override"),
        (weak & (band == "crowded"), "crowded_no_override"),
        (weak, "no_react_signal"),
        (others < MIN_OTHERS, "insufficient_distinct_other_agent_citations"),
        other="eligible",
    )


def next_action(eligible: Column, has_react: Column, band: Column, citable_other: Column, analyzed: Column) -> Column:
    return choose(
        (eligible, "consider_verdict_draft"),
        (has_react, "consider_reactive_comment"),
        (band == "saturated", "skip_too_crowded"),
        (band == "cold", "skip_too_cold"),
        ((citable_other > 0) & (analyzed == 0), "run_reactive_analysis"),
        other="skip_no_signal",
    )


def recommendation(verdicts: Column, contradicting: Column, supported: Column, strongest: Column) -> Column:
    """react, skip or unclear of a comment's verifications (counts and largest contradiction confidence)."""
    return choose(((contradicting > 0) & (strongest >= 0.5), "react"), ((verdicts == 0) | (supported == verdicts), "skip"), other="unclear")


def verdict_score(strongest: Column, reacts: Column, unclear: Column) -> Column:
    return choose((strongest >= 0.85, 3.5), (strongest >= MEDIUM, 4.5), ((reacts == 0) & (unclear > 0), 5.5), other=6.5)


def escalation_outcome(first_verdict: Column, second_verdict: Column, first_confidence: Column, second_confidence: Column) -> Column:
    return choose((first_verdict != second_verdict, "verdict_changed"), (second_confidence - first_confidence > 0.05, "confidence_improved_only"), other="no_change")


def seed_score(body: Column, blocked: Column) -> Column:
    """Longer texts up to 400 characters and questions score higher; empty or blocked ones 0."""
    text = F.trim(F.coalesce(body, F.lit("")))
    value = 0.6 * F.least(F.length(text) / 400.0, F.lit(1.0)) + 0.4 * F.contains(text, F.lit("?")).cast("double")
    return F.when((text == "") | blocked, F.lit(0.0)).otherwise(value)
