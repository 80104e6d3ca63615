"""From pending login sessions to offers or recorded reasons for none.

One batch (nightly, or a micro-batch) of sessions is joined with four
per-customer reductions and goes through one cascade.  ``now`` is an argument.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions import policy
from tideline.functions.scalars import as_col, is_text, iso_text, null_if_empty
from tideline.operators.scoring import risk_tier

PROFILE_SECTIONS = [
    "engagement", "support_metrics", "customer_feedback", "transactional_metrics", "account_state",
]
SESSIONS_COLLECTION = "customer_sessions"
ISSUED = "OFFER_ISSUED"


def at(now: str | Column) -> Column:
    return F.lit(now).cast("timestamp")


def days(count: int) -> Column:
    return F.expr(f"INTERVAL '{count}' DAY")


def pending_sessions(changes: DataFrame) -> DataFrame:
    """Changes that announce a new session waiting for a decision."""
    return changes.where(
        (F.col("collection") == SESSIONS_COLLECTION)
        & (F.col("operation") != "delete")
        & (F.col("agent_processing_status") == "PENDING")
        & null_if_empty("customer_id").isNotNull()
    )


def claimable(status: Column | str) -> Column:
    return F.coalesce(as_col(status), F.lit("")).isin(policy.CLAIMABLE_STATUSES)


def claim_sessions(sessions: DataFrame, now: str, worker: str) -> DataFrame:
    """Take the claimable sessions, each once.

    The batch owns its rows, so no lock is needed; a session delivered twice is
    reduced to its earliest login.
    """
    rest = [c for c in sessions.columns if c != "session_id"]
    return (
        sessions.where(claimable("agent_processing_status"))
        .groupBy("session_id")
        .agg(F.min(F.struct("login_timestamp", *[c for c in rest if c != "login_timestamp"])).alias("s"))
        .select("session_id", *[F.col(f"s.{c}").alias(c) for c in rest])
        .withColumn("agent_processing_status", F.lit("PROCESSING"))
        .withColumn("processing_started_at", at(now))
        .withColumn("agent_worker_id", F.lit(worker))
    )


def flatten_profile(profiles: DataFrame) -> DataFrame:
    """Lift the nested sections to the top level.

    The top-level value comes first, then the later section before the earlier.
    """
    sections = [s for s in PROFILE_SECTIONS if s in profiles.columns]
    top = [c for c in profiles.columns if c not in sections]
    sources: dict[str, list[Column]] = {c: [F.col(c)] for c in top}
    for section in reversed(sections):
        for field in profiles.schema[section].dataType.fieldNames():
            sources.setdefault(field, []).append(F.col(f"{section}.{field}"))
    return profiles.select(
        *[(cols[0] if len(cols) == 1 else F.coalesce(*cols)).alias(n) for n, cols in sources.items()]
    )


def latest_churn_score(scores: DataFrame) -> DataFrame:
    """Newest score row per customer; without a probability it is no score."""
    rest = [c for c in scores.columns if c != "customer_id"]
    newest = (
        scores.groupBy("customer_id")
        .agg(F.max_by(F.struct(*rest), F.struct("calculation_timestamp", "churn_probability")).alias("s"))
        .select("customer_id", "s.*")
    )
    scored = F.col("churn_probability").isNotNull()
    tier = F.coalesce(F.upper(null_if_empty("churn_risk_tier")), risk_tier("churn_probability"))
    return newest.select(
        "customer_id",
        F.when(scored, "OK").otherwise("NOT_SCORED").alias("lookup_status"),
        "churn_probability",
        F.when(scored, tier).alias("churn_tier"),
        F.when(scored, F.col("calculation_timestamp")).alias("scored_at"),
        F.col("total_spend_90d").alias("score_spend_90d"),
        F.col("sentiment_score").alias("score_sentiment"),
        F.col("customer_segment").alias("score_segment"),
    )


def customer_context(customers: DataFrame, profiles: DataFrame, scores: DataFrame) -> DataFrame:
    """What the offer path needs to know: the profile first, the score row second.

    ``profiles`` are flattened profiles, ``scores`` the output of
    ``latest_churn_score``.
    """
    optional = {
        "customer_segment": "string", "loyalty_tier": "string", "total_spend_90d": "double",
        "historical_spend_90d": "double", "sentiment_score": "double", "lifetime_spend": "double",
        "orders_count_last_12m": "bigint", "rating": "bigint", "feedback_rating": "bigint",
        "gross_margin_percent": "string", "profit_margin": "string",
        "primary_complaint_reason": "string",
    }
    missing = [F.lit(None).cast(t).alias(c) for c, t in optional.items() if c not in profiles.columns]
    present = [F.col(c) for c in optional if c in profiles.columns]
    known = profiles.select("customer_id", *present, *missing)
    return (
        customers.select("customer_id")
        .join(known, "customer_id", "left")
        .join(scores, "customer_id", "left")
        .select(
            "customer_id",
            policy.context_segment("customer_segment", "loyalty_tier", "score_segment").alias("segment"),
            "primary_complaint_reason",
            F.coalesce("total_spend_90d", "historical_spend_90d", "score_spend_90d", F.lit(0.0))
            .cast("double").alias("context_spend_90d"),
            F.coalesce("sentiment_score", "score_sentiment", F.lit(0.5)).cast("double").alias("context_sentiment"),
            "lifetime_spend", "orders_count_last_12m",
            F.coalesce("rating", "feedback_rating").alias("usual_rating"),
            policy.gross_margin("gross_margin_percent", "profit_margin").alias("gross_margin_percent"),
            "lookup_status", "churn_probability", "churn_tier", "scored_at",
        )
    )


def recent_offers(
    offers: DataFrame, now: str, cooldown_days: int = policy.COOLDOWN_DAYS,
    limit: int = policy.COOLDOWN_SCAN_LIMIT,
) -> DataFrame:
    """Each customer's newest offers inside the cooldown window.

    The rank filter also runs before the shuffle, so no customer sends more
    than ``limit`` rows per task.
    """
    newest = Window.partitionBy("customer_id").orderBy(F.desc("created_at"), F.desc("offer_id"))
    return (
        offers.where(F.col("created_at") >= at(now) - days(cooldown_days))
        .withColumn("_rank", F.row_number().over(newest))
        .where(F.col("_rank") <= limit)
        .drop("_rank")
    )


def classify_offers(recent: DataFrame, now: str) -> DataFrame:
    """Active, cooling down or spent: one row per customer with recent offers."""
    newest = F.struct("created_at", "offer_id")
    status = F.col("status")
    redeemed = F.coalesce(status == "REDEEMED", F.lit(False))
    active = F.coalesce(status == "ACTIVE", F.lit(False))
    until = F.coalesce("cooldown_until", "valid_until")
    cooling = ~redeemed & F.coalesce(until > at(now), F.lit(False))

    def newest_of(value: Column, condition: Column) -> Column:
        return F.max_by(value, F.when(condition, newest))

    return (
        recent.groupBy("customer_id")
        .agg(
            F.count_if(redeemed).alias("redeemed_count"),
            newest_of(F.col("offer_id"), redeemed).alias("last_redeemed_offer_id"),
            F.bool_or(active).alias("has_active_offer"),
            newest_of(F.col("offer_id"), active).alias("active_offer_id"),
            F.bool_or(cooling).alias("_cooling"),
            newest_of(F.col("cooldown_until"), active).alias("_active_until"),
            newest_of(until, cooling).alias("_cooling_until"),
        )
        .select(
            "customer_id", "redeemed_count", "last_redeemed_offer_id", "has_active_offer",
            "active_offer_id",
            (~F.col("has_active_offer") & F.col("_cooling")).alias("in_cooldown"),
            F.when(F.col("has_active_offer"), F.col("_active_until"))
            .otherwise(F.col("_cooling_until")).alias("cooldown_until"),
        )
    )


def latest_order_doc(orders: DataFrame) -> DataFrame:
    """Each customer's newest order."""
    rest = [c for c in orders.columns if c != "customer_id"]
    return (
        orders.groupBy("customer_id")
        .agg(F.max_by(F.struct(*rest), F.struct("created_at", "order_id")).alias("o"))
        .select("customer_id", "o.*")
    )


def latest_complaint(latest_orders: DataFrame, scores: DataFrame) -> DataFrame:
    """The complaint on the newest order, placed before or after the score.

    Customers whose newest order is no complaint have no row.
    """
    gap = (F.unix_micros("feedback_at") - F.unix_micros("scored_at")) / 3_600_000_000
    return (
        latest_orders.where(F.col("rating") <= policy.COMPLAINT_RATING)
        .join(scores.select("customer_id", "scored_at"), "customer_id", "left")
        .select(
            "customer_id",
            F.struct(
                F.col("order_id"), F.col("rating").cast("bigint").alias("rating"), F.col("reason"),
                F.col("comment"), F.col("feedback_at").alias("submitted_at"), F.col("scored_at"),
                gap.alias("gap_hours"), (gap <= 0).alias("already_scored"),
            ).alias("complaint"),
        )
    )


def _show(value: Column | str, fallback: str = "not recorded") -> Column:
    return F.coalesce(as_col(value).cast("string"), F.lit(fallback))


def _instant(value: Column | str) -> Column:
    ts = as_col(value)
    fraction = F.when(F.unix_micros(ts) % 1_000_000 != 0, F.date_format(ts, ".SSSSSS")).otherwise("")
    return F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), fraction, F.lit("+00:00"))


def one_decimal_text(value: Column) -> Column:
    """A double of at least 1 with one decimal, rounded on its exact binary value.

    The fraction of such a double is a whole number of 2**-52, so the tenths are
    found with integers, and a true tie goes to the even digit.
    """
    unit = F.lit(1 << 52)
    whole = F.floor(value).cast("bigint")
    scaled = ((value - whole) * float(1 << 52)).cast("bigint") * 10
    rest = F.pmod(scaled, unit)
    tenths = whole * 10 + ((scaled - rest) / unit).cast("bigint")
    half = F.lit(1 << 51)
    up = (rest > half) | ((rest == half) & (tenths % 2 == 1))
    rounded = tenths + F.when(up, 1).otherwise(0)
    return F.concat(F.floor(rounded / 10).cast("string"), F.lit("."), (rounded % 10).cast("string"))


def timing_line(gap_hours: Column) -> Column:
    """Which came first, the complaint or the score, and by how much."""
    minutes = F.abs(gap_hours) * 60
    elapsed = F.when(minutes < 60, F.format_string("%.0f minutes", F.rint(minutes))).otherwise(
        F.concat(one_decimal_text(F.abs(gap_hours)), F.lit(" hours"))
    )
    lead = F.lit("  timing:             ")
    return (
        F.when(
            gap_hours.isNull(),
            F.concat(lead, F.lit("unknown -- one of the timestamps is missing, so it cannot be "
                                 "shown whether the model saw this")),
        )
        .when(gap_hours > 0, F.concat(
            lead, elapsed, F.lit(" AFTER the score was calculated, so the model cannot have seen this")))
        .otherwise(F.concat(
            lead, elapsed, F.lit(" BEFORE the score was calculated, so the model had this in "
                                 "front of it and scored anyway")))
    )


def escalation_brief() -> Column:
    """The case as text for a reviewer, from a row with context and complaint."""
    c = F.col("complaint")
    lines = [
        ("OVERNIGHT CHURN SCORE", None, ""),
        ("  probability:        ", _show("churn_probability", "None"), ""),
        ("  risk tier:          ", _show("churn_tier", "None"), ""),
        ("  calculated at:      ", _show(_instant(c["scored_at"])), ""),
        ("", None, ""),
        ("CUSTOMER", None, ""),
        ("  segment:            ", _show("segment"), ""),
        ("  spend, last 90d:    ", _show("context_spend_90d"), ""),
        ("  lifetime spend:     ", _show("lifetime_spend"), ""),
        ("  orders, last 12m:   ", _show("orders_count_last_12m"), ""),
        ("  usual rating:       ", _show("usual_rating"), " out of 5"),
        ("  standing complaint: ", _show("primary_complaint_reason", "none"), ""),
        ("", None, ""),
        ("THE COMPLAINT", None, ""),
        ("  order:              ", _show(c["order_id"]), ""),
        ("  rating given:       ", _show(c["rating"], "None"), " out of 5"),
        ("  reason:             ", _show(c["reason"], "not given"), ""),
        ("  customer wrote:     ", _show(c["comment"], "nothing"), ""),
        ("  submitted:          ", _show(_instant(c["submitted_at"])), ""),
    ]
    rendered = [
        F.lit(label) if value is None else F.concat(F.lit(label), value, F.lit(tail))
        for label, value, tail in lines
    ]
    return F.concat_ws(
        "\n", *rendered, timing_line(c["gap_hours"]), F.lit(""),
        F.lit("Should we send a retention offer now?"),
    )


def apply_verdicts(sessions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Join the reviewers' verdicts; a missing one is unavailable, not a no."""
    one = verdicts.where(F.col("escalate").isNotNull()).groupBy("session_id").agg(
        F.max(F.struct("escalate", "reasoning")).alias("_verdict")
    )
    text = F.trim(F.regexp_replace(F.col("_verdict.reasoning"), r"\s+", " "))
    return sessions.join(one, "session_id", "left").withColumns(
        {
            "verdict_available": F.col("_verdict").isNotNull(),
            "verdict_escalate": F.coalesce(F.col("_verdict.escalate"), F.lit(False)),
            "verdict_reasoning": text,
        }
    ).drop("_verdict")


def _with_gate(cases: DataFrame) -> DataFrame:
    qualifies = F.coalesce(F.col("churn_tier").isin(policy.OFFER_TIERS), F.lit(False))
    gate = policy.escalation_gate(
        F.col("churn_tier"), F.col("complaint").isNotNull(), F.col("verdict_available")
    )
    return cases.withColumn("_qualifies", qualifies).withColumn(
        "escalation_gate", F.when(~qualifies, gate)
    )


def session_cases(
    claimed: DataFrame, scores: DataFrame, offers: DataFrame, profiles: DataFrame,
    orders: DataFrame, verdicts: DataFrame, now: str, cooldown_days: int = policy.COOLDOWN_DAYS,
) -> DataFrame:
    """Claimed sessions with everything the cascade looks at.

    Every reduction is limited to the customers of the batch before it is
    grouped, so a small batch does not regroup whole tables.
    """
    customers = claimed.where(null_if_empty("customer_id").isNotNull()).select("customer_id").distinct()

    def of_batch(df: DataFrame) -> DataFrame:
        return df.join(customers, "customer_id", "left_semi")

    newest_scores = latest_churn_score(of_batch(scores))
    context = customer_context(customers, of_batch(profiles), newest_scores)
    history = classify_offers(recent_offers(of_batch(offers), now, cooldown_days), now)
    complaints = latest_complaint(latest_order_doc(of_batch(orders)), newest_scores)
    per_customer = context.join(history, "customer_id", "left").join(complaints, "customer_id", "left")
    joined = claimed.join(per_customer, "customer_id", "left").withColumn(
        "redeemed_count", F.coalesce("redeemed_count", F.lit(0))
    )
    return _with_gate(apply_verdicts(joined, verdicts))


def _cascade(cases: DataFrame) -> DataFrame:
    """Reason per session as if it were the only one of its customer."""
    qualifies = F.col("_qualifies")
    capped = F.col("redeemed_count") > policy.MAX_FOLLOW_UPS
    judged = F.col("escalation_gate") == policy.GATE_JUDGED
    escalated = ~qualifies & judged & F.col("verdict_escalate")
    no_score = F.coalesce(F.col("lookup_status"), F.lit("NOT_SCORED")) != "OK"
    failed = F.coalesce(F.col("lookup_failed"), F.lit(False)) if "lookup_failed" in cases.columns else F.lit(False)
    reason = (
        F.when(null_if_empty("customer_id").isNull(), "NO_CUSTOMER_ID")
        .when(failed, "CHURN_LOOKUP_FAILED")
        .when(no_score, "CUSTOMER_NOT_SCORED")
        .when(F.coalesce("has_active_offer", F.lit(False)), "ACTIVE_OFFER_ALREADY_EXISTS")
        .when(F.coalesce("in_cooldown", F.lit(False)), "COOLDOWN_ACTIVE")
        .when(capped & ~qualifies, "LOW_CHURN_RISK")
        .when(capped, "FOLLOW_UP_LIMIT_REACHED")
        .when(qualifies | escalated, ISSUED)
        .when(judged, "ESCALATION_DECLINED")
        .otherwise("LOW_CHURN_RISK")
    )
    return cases.withColumn("_capped", capped).withColumn("_escalated", escalated).withColumn("outcome", reason)


def decide_sessions(cases: DataFrame) -> DataFrame:
    """One terminal decision per session.

    Sessions of one customer act as if handled in login order: the first that
    leads to an offer gets it, and those after it find that offer active.  The
    first one is found by a grouped minimum, so a customer with very many
    sessions is never gathered in one task.
    """
    decided = _cascade(cases).withColumn(
        "_position",
        F.struct(F.coalesce("login_timestamp", F.lit(0).cast("timestamp")).alias("t"), F.col("session_id").alias("s")),
    )
    winners = (
        decided.where(F.col("outcome") == ISSUED)
        .groupBy("customer_id")
        .agg(F.min("_position").alias("_winner"))
    )
    early = ["NO_CUSTOMER_ID", "CUSTOMER_NOT_SCORED", "CHURN_LOOKUP_FAILED"]
    beaten = (
        F.col("_winner").isNotNull()
        & (F.col("_position") > F.col("_winner"))
        & ~F.col("outcome").isin(early)
    )
    outcome = F.when(beaten, "ACTIVE_OFFER_ALREADY_EXISTS").otherwise(F.col("outcome"))
    issued = F.col("outcome") == ISSUED
    active = F.col("outcome") == "ACTIVE_OFFER_ALREADY_EXISTS"
    at_gate = F.col("outcome").isin("ESCALATION_DECLINED", "LOW_CHURN_RISK") & ~F.col("_capped")
    tier = F.coalesce(null_if_empty("churn_tier"), F.lit("UNSCORED"))
    capped_note = F.concat(
        F.lit("Model rates "), F.col("customer_id"), F.lit(" "), tier,
        F.lit(f"; the follow-up cap ({policy.MAX_FOLLOW_UPS}) is also reached."),
    )
    detail = F.when(
        at_gate,
        F.coalesce(
            F.when(F.col("escalation_gate") == policy.GATE_JUDGED, null_if_empty("verdict_reasoning")),
            policy.gate_note(F.col("escalation_gate"), F.col("churn_tier")),
        ),
    ).when((F.col("outcome") == "LOW_CHURN_RISK") & F.col("_capped"), capped_note)
    offer = (
        F.when(issued, offer_id_for("session_id"))
        .when(active & F.col("_beaten"), offer_id_for(F.col("_winner.s")))
        .when(active, F.col("active_offer_id"))
    )
    return (
        decided.join(winners, "customer_id", "left")
        .withColumn("_beaten", F.coalesce(beaten, F.lit(False)))
        .withColumn("outcome", outcome)
        .withColumn("linked_offer_id", offer)
        .withColumn("final_status", F.when(issued | active, "PROCESSED").otherwise("SKIPPED"))
        .withColumn("skip_reason", F.when(~issued, F.col("outcome")))
        .withColumn("skip_detail", detail)
        .withColumn(
            "escalation_gate",
            F.when(at_gate | (issued & F.col("_escalated")), F.col("escalation_gate")),
        )
        .withColumn("eligibility_tier", F.when(issued, F.when(F.col("_escalated"), "HIGH").otherwise(F.col("churn_tier"))))
        .withColumn("escalated", issued & F.col("_escalated"))
        .withColumn("escalation_reason", F.when(F.col("escalated"), F.col("verdict_reasoning")))
        .withColumn("step_down_percent", F.col("redeemed_count") * policy.STEP_DOWN_PERCENT)
        .drop("_position", "_winner", "_beaten", "_capped", "_escalated", "_qualifies")
    )


def offer_id_for(session_id: Column | str) -> Column:
    return F.concat(F.lit("off_"), as_col(session_id), F.lit("_retention"))


def escalation_trigger(complaint: Column | str) -> Column:
    """The evidence behind an escalation, as stored on the offer."""
    c = as_col(complaint)
    return F.when(
        c.isNotNull(),
        F.struct(
            c["order_id"].alias("order_id"), c["rating"].alias("rating"), c["reason"].alias("reason"),
            iso_text(c["submitted_at"]).alias("submitted_at"), iso_text(c["scored_at"]).alias("scored_at"),
            F.round(c["gap_hours"], 2).alias("gap_hours"), c["already_scored"].alias("already_scored"),
        ),
    )


def rule_offer(customer_id: Column | str, tier: Column | str, complaint_reason: Column | str) -> Column:
    """The offer made by rules alone, as a struct."""
    critical = as_col(tier) == "CRITICAL"
    return F.struct(
        F.lit("Special Customer Loyalty Incentive").alias("title"),
        F.lit("We appreciate your ongoing business and want to offer you an exclusive discount.")
        .alias("description"),
        F.when(critical, 25).otherwise(15).alias("discount_percent"),
        F.concat(F.lit("RETENTION-DET-"), as_col(tier), F.lit("-"), policy.last_four(customer_id)).alias("promo_code"),
        critical.alias("free_express_shipping"),
        F.array(F.when(critical, "FREE_EXPRESS_SHIPPING").otherwise("FREE_SHIPPING")).alias("perks"),
        F.when(
            null_if_empty(complaint_reason).isNotNull(),
            "We apologize for any past shipping inconveniences.",
        ).alias("personalized_apology"),
    )


# Columns an external copy table may have beside session_id.
COPY_COLUMNS = {
    "title": "string", "description": "string", "discount_percent": "bigint", "promo_code": "string",
    "free_express_shipping": "boolean", "perks": "array<string>", "personalized_apology": "string",
}


def compose_offer(decisions: DataFrame, copy: DataFrame) -> DataFrame:
    """Offer content of the issued sessions: external copy first, else the rules.

    Whatever the copy asks for, the guardrails settle the discount.
    """
    issued = decisions.where(F.col("outcome") == ISSUED)
    from_text = "discount_percent" in copy.columns and is_text(copy, "discount_percent")
    kinds = dict(COPY_COLUMNS, discount_percent="string" if from_text else "bigint")
    given = copy.select(
        "session_id",
        F.struct(*[
            (F.col(c) if c in copy.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()
        ]).alias("_copy"),
    )
    reason = F.coalesce(
        F.when(F.col("escalation_gate").isNotNull(), null_if_empty(F.col("complaint.reason"))),
        F.col("primary_complaint_reason"),
    )
    rules = rule_offer("customer_id", "eligibility_tier", reason)
    has_copy = F.col("_copy").isNotNull()

    def chosen(name: str) -> Column:
        return F.when(has_copy, F.col(f"_copy.{name}")).otherwise(F.col(f"_rules.{name}"))

    request = F.when(
        has_copy, F.coalesce(F.col("_copy.discount_percent"), F.lit(15).cast(kinds["discount_percent"]))
    ).otherwise(F.col("_rules.discount_percent").cast(kinds["discount_percent"]))
    return (
        issued.join(given, "session_id", "left")
        .withColumn("_rules", rules)
        .withColumns({name: chosen(name) for name in COPY_COLUMNS if name != "discount_percent"})
        .withColumn("generation_source", F.when(has_copy, "EXTERNAL_COPY").otherwise("DETERMINISTIC_RULES"))
        .withColumn(
            "discount_percent",
            policy.discount_guardrails(request, "segment", "gross_margin_percent", "step_down_percent", from_text),
        )
        .withColumn("discount_ceiling_applied", policy.ceiling_for("segment", "step_down_percent"))
        .drop("_copy", "_rules")
    )


OFFER_COLUMNS = [
    "offer_id", "customer_id", "session_id", "churn_probability", "churn_risk_tier",
    "eligibility_tier", "escalated", "escalation_reason", "escalation_trigger", "title",
    "description", "promo_code", "discount_percent", "free_express_shipping", "perks",
    "personalized_apology", "offer_sequence", "supersedes_offer_id", "discount_ceiling_applied",
    "status", "created_at", "valid_until", "cooldown_until", "claimed_at", "ttl_expiry_at", "metadata",
]


def offer_documents(composed: DataFrame, now: str, model_version: str = "churn_v1") -> DataFrame:
    """The 26-column offer rows."""
    perks = F.coalesce("perks", F.array().cast("array<string>"))
    tier = F.coalesce("churn_tier", F.lit("HIGH"))
    return composed.select(
        offer_id_for("session_id").alias("offer_id"), "customer_id", "session_id",
        F.coalesce("churn_probability", F.lit(0.75)).alias("churn_probability"),
        tier.alias("churn_risk_tier"),
        F.coalesce("eligibility_tier", tier).alias("eligibility_tier"),
        "escalated", "escalation_reason",
        F.when(F.col("escalated"), escalation_trigger("complaint")).alias("escalation_trigger"),
        F.coalesce(null_if_empty("title"), F.lit("Special Customer Loyalty Incentive")).alias("title"),
        F.coalesce(null_if_empty("description"), F.lit("Exclusive discount on your next order.")).alias("description"),
        F.coalesce(
            null_if_empty("promo_code"), F.concat(F.lit("RETENTION-"), policy.last_four("customer_id"))
        ).alias("promo_code"),
        F.coalesce("discount_percent", F.lit(15)).alias("discount_percent"),
        F.coalesce("free_express_shipping", F.array_contains(perks, "FREE_EXPRESS_SHIPPING")).alias("free_express_shipping"),
        perks.alias("perks"), "personalized_apology",
        (F.col("redeemed_count") + 1).alias("offer_sequence"),
        F.col("last_redeemed_offer_id").alias("supersedes_offer_id"),
        "discount_ceiling_applied", F.lit("ACTIVE").alias("status"),
        at(now).alias("created_at"),
        (at(now) + days(policy.OFFER_VALID_DAYS)).alias("valid_until"),
        (at(now) + days(policy.COOLDOWN_DAYS)).alias("cooldown_until"),
        F.lit(None).cast("timestamp").alias("claimed_at"),
        (at(now) + days(policy.OFFER_TTL_DAYS)).alias("ttl_expiry_at"),
        F.struct(
            F.lit(model_version).alias("ml_model_version"),
            F.concat(F.lit("DISPATCH_"), tier, F.lit("_OFFER")).alias("retention_action"),
            F.col("context_spend_90d").alias("historical_spend_90d"),
            F.col("context_sentiment").alias("support_sentiment_score"),
        ).alias("metadata"),
    )


def close_sessions(decisions: DataFrame, now: str) -> DataFrame:
    """The terminal update of every session of the batch."""
    return decisions.select(
        "session_id", F.col("final_status").alias("agent_processing_status"),
        F.lit("PROCESSED").alias("status"), F.col("linked_offer_id").alias("offer_id"),
        F.col("linked_offer_id").alias("active_offer_id"), "skip_reason", "skip_detail",
        "escalation_gate", at(now).alias("processed_at"),
    )


def decision_traces(decisions: DataFrame, now: str) -> DataFrame:
    """The partial trace a decision adds for its session."""
    return decisions.select(
        "session_id", at(now).alias("recorded_at"),
        F.create_map(
            F.lit("kind"), F.lit("SESSION"),
            F.lit("customer_id"), F.col("customer_id"),
            F.lit("agent_outcome"), F.col("outcome"),
            F.lit("agent_detail"), F.col("skip_detail"),
        ).alias("fields"),
        (at(now) + days(policy.TRACE_TTL_DAYS)).alias("expire_at"),
    )


def session_trace(partials: DataFrame, fields: list[str]) -> DataFrame:
    """Merge the partial traces several writers left for a session.

    ``fields`` of a partial is a map.  For each field the newest partial that
    *has* it wins, an explicit NULL included; an absent field changes nothing.
    """
    position = [F.col(c) for c in ("recorded_at", "event_key") if c in partials.columns]

    def newest(field: str) -> Column:
        has = F.map_contains_key("fields", field)
        holder = F.max_by(F.struct(F.col("fields")[field].alias("v")), F.when(has, F.struct(*position)))
        return holder["v"].alias(field)

    return partials.groupBy("session_id").agg(
        F.max("recorded_at").alias("recorded_at"), *[newest(f) for f in fields]
    )


def invalid_session_errors(sessions: DataFrame, failure: str, now: str) -> DataFrame:
    """Mark the sessions whose processing failed; ``failure`` is the message column."""
    failed = F.col(failure).isNotNull()
    return sessions.withColumns(
        {
            "agent_processing_status": F.when(failed, "ERROR").otherwise(F.col("agent_processing_status")),
            "error_message": F.col(failure),
            "processed_at": F.when(failed, at(now)),
        }
    )
