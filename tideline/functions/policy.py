"""Decision rules of the retention offers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideline.functions.scalars import (
    as_col, integer_request, lookup, null_if_empty, parse_number,
)

# Fixed values.
OFFER_TIERS = ["HIGH", "CRITICAL"]
ESCALATION_TIERS = ["MODERATE", "LOW"]
CLAIMABLE_STATUSES = ["", "PENDING"]
DISCOUNT_CEILINGS = {
    "ENTERPRISE_VIP": 25, "RETAIL_PRO": 20, "STANDARD_LOYALTY": 15, "CASUAL": 12,
}
DEFAULT_CEILING = 15
SEGMENT_ALIASES = {
    "PLATINUM": "RETAIL_PRO", "GOLD": "RETAIL_PRO",
    "SILVER": "STANDARD_LOYALTY", "BRONZE": "STANDARD_LOYALTY",
}
DEFAULT_SEGMENT = "STANDARD_LOYALTY"
COOLDOWN_DAYS = 7
OFFER_VALID_DAYS = 14
OFFER_TTL_DAYS = 90
SESSION_TTL_DAYS = 30
TRACE_TTL_DAYS = 30
COOLDOWN_SCAN_LIMIT = 10
PRICING_SCAN_LIMIT = 5
MAX_FOLLOW_UPS = 1
STEP_DOWN_PERCENT = 5
FOLLOW_UP_FLOOR = 5
MARGIN_FLOOR = 10.0
COMPLAINT_RATING = 2

GATE_JUDGED = "JUDGED"
GATE_NO_COMPLAINT = "NO_COMPLAINT"
GATE_TIER_NOT_CANDIDATE = "TIER_NOT_CANDIDATE"
GATE_JUDGE_UNAVAILABLE = "JUDGE_UNAVAILABLE"
NOTE_TIER = " is outside the escalation allow-list, so no judgement was asked for."
NOTE_UNAVAILABLE = (
    "The escalation judge could not be reached, so the model's own tier stands."
)


def discount_ceiling(segment: Column | str) -> Column:
    """Highest discount of a segment; unknown segments get the default."""
    name = F.upper(F.coalesce(as_col(segment), F.lit("")))
    return lookup(
        DISCOUNT_CEILINGS, F.coalesce(lookup(SEGMENT_ALIASES, name), name), DEFAULT_CEILING
    )


def ceiling_for(
    segment: Column | str, step_down: Column | str | int = 0, margin: Column | str | None = None
) -> Column:
    """Ceiling after the follow-up step-down and, if a margin is known, its headroom."""
    step = F.lit(step_down) if isinstance(step_down, int) else as_col(step_down)
    allowed = discount_ceiling(segment)
    stepped = F.when(
        F.coalesce(step, F.lit(0)) != 0, F.greatest(F.lit(FOLLOW_UP_FLOOR), allowed - step)
    ).otherwise(allowed)
    if margin is None:
        return stepped.cast("bigint")
    gross = as_col(margin)
    headroom = F.floor(F.greatest(F.lit(0.0), gross - MARGIN_FLOOR))
    return F.when(gross.isNull(), stepped).otherwise(F.least(stepped, headroom)).cast("bigint")


def discount_guardrails(
    requested: Column | str,
    segment: Column | str,
    margin: Column | str,
    step_down: Column | str | int = 0,
    from_text: bool = False,
) -> Column:
    """The discount actually granted: the request within 0 and the ceiling."""
    request = integer_request(requested, from_text)
    return F.greatest(F.lit(0), F.least(request, ceiling_for(segment, step_down, margin)))


def gross_margin(percent: Column | str, fraction: Column | str) -> Column:
    """Margin as a percentage; a percentage that cannot be read stays unknown."""
    p, f = as_col(percent).cast("string"), as_col(fraction).cast("string")
    return F.when(p.isNotNull(), parse_number(p)).otherwise(parse_number(f) * 100.0)


def context_segment(*candidates: Column | str) -> Column:
    """First segment that is neither NULL nor empty, in upper case."""
    return F.upper(F.coalesce(*[null_if_empty(c) for c in candidates], F.lit(DEFAULT_SEGMENT)))


def escalation_gate(tier: Column, has_complaint: Column, verdict_available: Column) -> Column:
    return (
        F.when(~F.coalesce(tier.isin(ESCALATION_TIERS), F.lit(False)), GATE_TIER_NOT_CANDIDATE)
        .when(~has_complaint, GATE_NO_COMPLAINT)
        .when(~verdict_available, GATE_JUDGE_UNAVAILABLE)
        .otherwise(GATE_JUDGED)
    )


def gate_note(gate: Column, tier: Column) -> Column:
    """The sentence owed where the judge gave none."""
    named = F.coalesce(null_if_empty(tier), F.lit("This tier"))
    return F.when(gate == GATE_TIER_NOT_CANDIDATE, F.concat(named, F.lit(NOTE_TIER))).when(
        gate == GATE_JUDGE_UNAVAILABLE, NOTE_UNAVAILABLE
    )


def last_four(customer_id: Column | str) -> Column:
    return F.right(as_col(customer_id), F.lit(4))
