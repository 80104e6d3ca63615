"""Registered queries: retention decisions and offers issued from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import policy
from tideline.operators import retention as rt
from tideline.plans.fixtures import NOW
from tideline.plans.registry import query

_NOW = f"timestamp '{NOW}'"
_WORKER = "batch-1"


@query("pending_sessions", """
SELECT session_id, customer_id FROM fx_logins
WHERE agent_processing_status = 'PENDING' AND customer_id IS NOT NULL AND event_key % 4 <> 0 AND event_key % 9 <> 0""")
def pending_sessions(t):
    changes = t.fx_logins.withColumn(
        "collection", F.when(F.col("event_key") % 4 == 0, "retail").otherwise("customer_sessions")
    ).withColumn("operation", F.when(F.col("event_key") % 9 == 0, "delete").otherwise("insert"))
    return rt.pending_sessions(changes).select("session_id", "customer_id")


@query("claim_sessions", f"""
SELECT session_id, customer_id, 'PROCESSING' AS agent_processing_status, '{NOW}' AS processing_started_at,
  '{_WORKER}' AS agent_worker_id FROM fx_logins
WHERE agent_processing_status IS NULL OR agent_processing_status IN ('', 'PENDING')""")
def claim_sessions(t):
    twice = t.fx_logins.unionByName(t.fx_logins)
    return rt.claim_sessions(twice, NOW, _WORKER).select(
        "session_id", "customer_id", "agent_processing_status", "processing_started_at", "agent_worker_id"
    )


def _nested_profiles(t):
    """Profiles with their sections, some values also at the top level."""
    return t.fx_profiles.select(
        "customer_id",
        "customer_segment",
        F.when(F.col("order_key") % 4 == 0, F.col("sentiment_score") + 2).alias("sentiment_score"),
        F.struct(F.col("order_key").alias("login_frequency_monthly")).alias("engagement"),
        F.struct(
            "sentiment_score",
            F.when(F.col("order_key") % 3 == 0, "LATE_DELIVERY").alias("primary_complaint_reason"),
            F.lit("support").alias("origin"),
        ).alias("support_metrics"),
        F.struct(F.col("feedback_rating").alias("rating"), F.lit("feedback").alias("origin")).alias("customer_feedback"),
        F.struct(F.col("grand_total").alias("total_spend_90d")).alias("transactional_metrics"),
        F.struct(
            "loyalty_tier",
            F.when(F.col("order_key") % 5 != 0, F.col("profit_margin")).alias("profit_margin"),
            F.when(F.col("order_key") % 7 == 0, "n/a").when(F.col("order_key") % 7 == 1, "23.5").alias("gross_margin_percent"),
        ).alias("account_state"),
    )


_FLAT = """flat AS (
  SELECT customer_id, customer_segment,
    coalesce(CASE WHEN order_key % 4 = 0 THEN sentiment_score + 2 END, sentiment_score) AS sentiment_score,
    loyalty_tier, CASE WHEN order_key % 5 <> 0 THEN profit_margin END AS profit_margin,
    CASE order_key % 7 WHEN 0 THEN 'n/a' WHEN 1 THEN '23.5' END AS gross_margin_percent,
    grand_total AS total_spend_90d, feedback_rating AS rating, 'feedback' AS origin,
    CASE WHEN order_key % 3 = 0 THEN 'LATE_DELIVERY' END AS primary_complaint_reason,
    order_key AS login_frequency_monthly
  FROM fx_profiles)"""


@query("flatten_profile", f"WITH {_FLAT} SELECT * FROM flat")
def flatten_profile(t):
    return rt.flatten_profile(_nested_profiles(t))


_SCORES = """newest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY calculation_timestamp DESC) AS rn FROM fx_scores) q
  WHERE rn = 1),
scored AS (SELECT customer_id, CASE WHEN churn_probability IS NULL THEN 'NOT_SCORED' ELSE 'OK' END AS lookup_status,
    churn_probability, CASE WHEN churn_probability IS NOT NULL THEN coalesce(upper(nullif(churn_risk_tier, '')),
      CASE WHEN churn_probability >= 0.8 THEN 'CRITICAL' WHEN churn_probability >= 0.6 THEN 'HIGH'
           WHEN churn_probability >= 0.4 THEN 'MODERATE' ELSE 'LOW' END) END AS churn_tier,
    CASE WHEN churn_probability IS NOT NULL THEN calculation_timestamp END AS scored_at,
    total_spend_90d AS score_spend_90d, sentiment_score AS score_sentiment, customer_segment AS score_segment
  FROM newest)"""


@query("latest_churn_score", f"""WITH {_SCORES}
SELECT customer_id, lookup_status, churn_probability, churn_tier, cast(scored_at AS varchar) AS scored_at,
  score_spend_90d, score_sentiment, score_segment FROM scored""")
def latest_churn_score(t):
    return rt.latest_churn_score(t.fx_scores)


_MARGIN = """CASE WHEN {p} IS NOT NULL THEN try_cast({p} AS double) ELSE {f} * 100.0e0 END"""


@query("gross_margin", f"WITH {_FLAT} SELECT customer_id, "
       f"round({_MARGIN.format(p='gross_margin_percent', f='profit_margin')}, 6) AS margin FROM flat")
def gross_margin(t):
    flat = rt.flatten_profile(_nested_profiles(t))
    return flat.select("customer_id", policy.gross_margin("gross_margin_percent", "profit_margin").alias("margin"))


_CONTEXT = f"""context AS (
  SELECT c.customer_id, upper(coalesce(nullif(f.customer_segment, ''), nullif(f.loyalty_tier, ''), nullif(s.score_segment, ''), 'STANDARD_LOYALTY')) AS segment,
    f.primary_complaint_reason, coalesce(f.total_spend_90d, s.score_spend_90d, 0) AS context_spend_90d,
    coalesce(f.sentiment_score, s.score_sentiment, 0.5) AS context_sentiment,
    f.rating AS usual_rating, {_MARGIN.format(p='f.gross_margin_percent', f='f.profit_margin')} AS gross_margin_percent,
    s.lookup_status, s.churn_probability, s.churn_tier, s.scored_at
  FROM custs c LEFT JOIN flat f ON f.customer_id = c.customer_id LEFT JOIN scored s ON s.customer_id = c.customer_id)"""

_ALL_CUSTOMERS = """custs AS (SELECT concat('cust_', lpad(concat(c_custkey, ''), 10, '0')) AS customer_id FROM customer
  UNION ALL SELECT 'cust_unknown')"""


@query("customer_context", f"""WITH {_FLAT}, {_SCORES}, {_ALL_CUSTOMERS}, {_CONTEXT}
SELECT customer_id, segment, primary_complaint_reason, round(context_spend_90d, 6) AS context_spend_90d,
  round(context_sentiment, 6) AS context_sentiment, usual_rating, round(gross_margin_percent, 6) AS gross_margin_percent,
  lookup_status, churn_tier FROM context""")
def customer_context(t):
    customers = t.sql(f"WITH {_ALL_CUSTOMERS} SELECT * FROM custs")
    context = rt.customer_context(
        customers, rt.flatten_profile(_nested_profiles(t)), rt.latest_churn_score(t.fx_scores)
    )
    return context.select(
        "customer_id", "segment", "primary_complaint_reason", "context_spend_90d",
        "context_sentiment", "usual_rating", "gross_margin_percent", "lookup_status", "churn_tier",
    )


_RECENT = f"""recent AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY created_at DESC, offer_id DESC) AS rn
    FROM fx_fresh_offers WHERE created_at >= {_NOW} - interval '7' day) q WHERE rn <= 10)"""


@query("recent_offers", f"WITH {_RECENT} SELECT offer_id, customer_id, status, cast(created_at AS varchar) AS created_at FROM recent")
def recent_offers(t):
    return rt.recent_offers(t.fx_fresh_offers, NOW).select("offer_id", "customer_id", "status", "created_at")


_CLASSIFIED = f"""history AS (
  SELECT customer_id, count(*) FILTER (WHERE status = 'REDEEMED') AS redeemed_count,
    min_by(offer_id, rn) FILTER (WHERE status = 'REDEEMED') AS last_redeemed_offer_id,
    count(*) FILTER (WHERE status = 'ACTIVE') > 0 AS has_active_offer,
    min_by(offer_id, rn) FILTER (WHERE status = 'ACTIVE') AS active_offer_id,
    count(*) FILTER (WHERE status = 'ACTIVE') = 0 AND count(*) FILTER (WHERE status <> 'REDEEMED'
      AND coalesce(cooldown_until, valid_until) > {_NOW}) > 0 AS in_cooldown,
    CASE WHEN count(*) FILTER (WHERE status = 'ACTIVE') > 0
      THEN cast(min(CASE WHEN status = 'ACTIVE' THEN rn END) AS bigint)
      ELSE cast(min(CASE WHEN status <> 'REDEEMED' AND coalesce(cooldown_until, valid_until) > {_NOW} THEN rn END) AS bigint) END AS pick
  FROM recent GROUP BY customer_id),
classified AS (SELECT h.customer_id, redeemed_count, last_redeemed_offer_id, has_active_offer, active_offer_id, in_cooldown,
    CASE WHEN has_active_offer THEN r.cooldown_until ELSE coalesce(r.cooldown_until, r.valid_until) END AS cooldown_until
  FROM history h LEFT JOIN recent r ON r.customer_id = h.customer_id AND r.rn = h.pick)"""


@query("classify_offers", f"""WITH {_RECENT}, {_CLASSIFIED}
SELECT customer_id, redeemed_count, last_redeemed_offer_id, has_active_offer, active_offer_id, in_cooldown,
  cast(cooldown_until AS varchar) AS cooldown_until FROM classified""")
def classify_offers(t):
    return rt.classify_offers(rt.recent_offers(t.fx_fresh_offers, NOW), NOW)


_CEILING = """CASE upper(coalesce({s}, '')) WHEN 'ENTERPRISE_VIP' THEN 25 WHEN 'RETAIL_PRO' THEN 20 WHEN 'PLATINUM' THEN 20
  WHEN 'GOLD' THEN 20 WHEN 'CASUAL' THEN 12 ELSE 15 END"""
_SEGMENTS = """SELECT order_id, CASE WHEN order_key % 23 = 0 THEN NULL WHEN order_key % 5 = 0 THEN lower(loyalty_tier)
    WHEN order_key % 5 = 1 THEN 'casual' ELSE customer_segment END AS segment,
  cast(order_key % 4 * 5 AS bigint) AS step, CASE WHEN order_key % 3 = 0 THEN NULL ELSE profit_margin * 100 END AS margin,
  CASE order_key % 6 WHEN 0 THEN 'lots' WHEN 1 THEN NULL ELSE concat(order_key % 60 - 10, '') END AS requested FROM fx_orders"""


@query("discount_ceiling", f"WITH s AS ({_SEGMENTS}) SELECT order_id, cast({_CEILING.format(s='segment')} AS bigint) AS ceiling FROM s")
def discount_ceiling(t):
    return t.sql(_SEGMENTS).select("order_id", policy.discount_ceiling("segment").alias("ceiling"))


_STEPPED = f"CASE WHEN step <> 0 THEN greatest(5, {_CEILING.format(s='segment')} - step) ELSE {_CEILING.format(s='segment')} END"
_CEILING_FOR = f"""CASE WHEN margin IS NULL THEN {_STEPPED}
  ELSE least({_STEPPED}, cast(floor(greatest(0.0e0, margin - 10.0e0)) AS bigint)) END"""


@query("ceiling_for", f"WITH s AS ({_SEGMENTS}) SELECT order_id, cast({_CEILING_FOR} AS bigint) AS ceiling FROM s")
def ceiling_for(t):
    return t.sql(_SEGMENTS).select("order_id", policy.ceiling_for("segment", "step", "margin").alias("ceiling"))


@query("discount_guardrails", f"""WITH s AS ({_SEGMENTS})
SELECT order_id, cast(greatest(0, least(coalesce(try_cast(requested AS bigint), 0), {_CEILING_FOR})) AS bigint) AS granted FROM s""")
def discount_guardrails(t):
    return t.sql(_SEGMENTS).select(
        "order_id",
        policy.discount_guardrails("requested", "segment", "margin", "step", from_text=True).alias("granted"),
    )


_LATEST_DOC = """latest_doc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_id
    ORDER BY created_at DESC, order_id DESC) AS rn FROM fx_feedback) q WHERE rn = 1)"""


@query("latest_order_doc", f"WITH {_LATEST_DOC} SELECT customer_id, order_id, cast(created_at AS varchar) AS created_at, "
       "rating, reason, comment, cast(feedback_at AS varchar) AS feedback_at FROM latest_doc")
def latest_order_doc(t):
    return rt.latest_order_doc(t.fx_feedback)


_COMPLAINTS = """complaints AS (
  SELECT d.customer_id, d.order_id, d.rating, d.reason, d.comment, d.feedback_at AS submitted_at, s.scored_at AS c_scored_at,
    cast(epoch_us(d.feedback_at) - epoch_us(s.scored_at) AS double) / 3600000000 AS gap_hours,
    epoch_us(d.feedback_at) - epoch_us(s.scored_at) <= 0 AS already_scored
  FROM latest_doc d LEFT JOIN scored s ON s.customer_id = d.customer_id WHERE d.rating <= 2)"""


@query("latest_complaint", f"""WITH {_SCORES}, {_LATEST_DOC}, {_COMPLAINTS}
SELECT customer_id, order_id, rating, reason, comment, cast(submitted_at AS varchar) AS submitted_at,
  cast(c_scored_at AS varchar) AS scored_at, round(gap_hours, 6) AS gap_hours, already_scored FROM complaints""")
def latest_complaint(t):
    return rt.latest_complaint(
        rt.latest_order_doc(t.fx_feedback), rt.latest_churn_score(t.fx_scores)
    ).select("customer_id", "complaint.*")


_CASES = f"""{_FLAT}, {_SCORES}, custs AS (SELECT DISTINCT customer_id FROM fx_logins WHERE customer_id IS NOT NULL),
{_CONTEXT}, {_RECENT}, {_CLASSIFIED}, {_LATEST_DOC}, {_COMPLAINTS},
claimed AS (SELECT session_id, customer_id, login_timestamp FROM fx_logins
  WHERE agent_processing_status IS NULL OR agent_processing_status IN ('', 'PENDING')),
cases AS (SELECT l.session_id, l.customer_id, l.login_timestamp, x.segment, x.primary_complaint_reason, x.context_spend_90d,
    x.context_sentiment, x.gross_margin_percent, x.usual_rating, coalesce(x.lookup_status, 'NOT_SCORED') AS lookup_status,
    x.churn_probability, x.churn_tier, h.active_offer_id, h.last_redeemed_offer_id, coalesce(h.has_active_offer, false) AS active,
    coalesce(h.in_cooldown, false) AS cooling, coalesce(h.redeemed_count, 0) AS redeemed, k.order_id AS k_order, k.rating AS k_rating,
    k.reason AS k_reason, k.comment AS k_comment, k.submitted_at AS k_submitted, k.c_scored_at AS k_scored, k.gap_hours, k.already_scored,
    v.escalate, regexp_replace(trim(v.reasoning), '\\s+', ' ', 'g') AS reasoning,
    coalesce(x.churn_tier IN ('HIGH', 'CRITICAL'), false) AS qualifies,
    CASE WHEN x.churn_tier IN ('HIGH', 'CRITICAL') THEN NULL WHEN coalesce(x.churn_tier, '') NOT IN ('MODERATE', 'LOW') THEN 'TIER_NOT_CANDIDATE'
         WHEN k.order_id IS NULL THEN 'NO_COMPLAINT' WHEN v.escalate IS NULL THEN 'JUDGE_UNAVAILABLE' ELSE 'JUDGED' END AS gate
  FROM claimed l LEFT JOIN context x ON x.customer_id = l.customer_id LEFT JOIN classified h ON h.customer_id = l.customer_id
  LEFT JOIN complaints k ON k.customer_id = l.customer_id LEFT JOIN fx_verdicts v ON v.session_id = l.session_id)"""


def _cases(t):
    claimed = rt.claim_sessions(t.fx_logins, NOW, _WORKER)
    return rt.session_cases(
        claimed, t.fx_scores, t.fx_fresh_offers, rt.flatten_profile(_nested_profiles(t)),
        t.fx_feedback, t.fx_verdicts, NOW,
    )


@query("escalation_gate", f"WITH {_CASES} SELECT session_id, churn_tier, gate AS escalation_gate FROM cases")
def escalation_gate(t):
    return _cases(t).select("session_id", "churn_tier", "escalation_gate")


@query("apply_verdicts", """
SELECT l.session_id, v.escalate IS NOT NULL AS verdict_available, coalesce(v.escalate, false) AS verdict_escalate,
  regexp_replace(trim(v.reasoning), '\\s+', ' ', 'g') AS verdict_reasoning
FROM fx_logins l LEFT JOIN fx_verdicts v ON v.session_id = l.session_id""")
def apply_verdicts(t):
    return rt.apply_verdicts(t.fx_logins.select("session_id"), t.fx_verdicts)


_ELAPSED = """CASE WHEN abs(gap_hours) * 60 < 60 THEN printf('%.0f minutes', abs(gap_hours) * 60) ELSE printf('%.1f hours', abs(gap_hours)) END"""


@query("escalation_brief", f"""WITH {_CASES}
SELECT session_id, concat_ws(chr(10), 'OVERNIGHT CHURN SCORE', concat('  probability:        ', churn_probability),
  concat('  risk tier:          ', churn_tier), concat('  calculated at:      ', strftime(k_scored, '%Y-%m-%d %H:%M:%S'), '+00:00'), '',
  'CUSTOMER', concat('  segment:            ', segment), concat('  spend, last 90d:    ', context_spend_90d),
  '  lifetime spend:     not recorded', '  orders, last 12m:   not recorded',
  concat('  usual rating:       ', coalesce(cast(usual_rating AS varchar), 'not recorded'), ' out of 5'),
  concat('  standing complaint: ', coalesce(primary_complaint_reason, 'none')), '', 'THE COMPLAINT',
  concat('  order:              ', k_order), concat('  rating given:       ', k_rating, ' out of 5'),
  concat('  reason:             ', coalesce(k_reason, 'not given')), concat('  customer wrote:     ', k_comment),
  concat('  submitted:          ', coalesce(strftime(k_submitted, '%Y-%m-%d %H:%M:%S') || '+00:00', 'not recorded')),
  concat('  timing:             ', CASE WHEN gap_hours IS NULL
      THEN 'unknown -- one of the timestamps is missing, so it cannot be shown whether the model saw this'
    WHEN gap_hours > 0 THEN {_ELAPSED} || ' AFTER the score was calculated, so the model cannot have seen this'
    ELSE {_ELAPSED} || ' BEFORE the score was calculated, so the model had this in front of it and scored anyway' END),
  '', 'Should we send a retention offer now?') AS brief
FROM cases WHERE gate IN ('JUDGED', 'JUDGE_UNAVAILABLE') AND lookup_status = 'OK'""")
def escalation_brief(t):
    return (
        _cases(t).where("escalation_gate IN ('JUDGED', 'JUDGE_UNAVAILABLE') AND lookup_status = 'OK'")
        .select("session_id", rt.escalation_brief().alias("brief"))
    )


_DECIDED = f"""{_CASES},
alone AS (SELECT *, CASE WHEN nullif(customer_id, '') IS NULL THEN 'NO_CUSTOMER_ID' WHEN lookup_status <> 'OK' THEN 'CUSTOMER_NOT_SCORED'
    WHEN active THEN 'ACTIVE_OFFER_ALREADY_EXISTS' WHEN cooling THEN 'COOLDOWN_ACTIVE'
    WHEN redeemed > 1 AND NOT qualifies THEN 'LOW_CHURN_RISK' WHEN redeemed > 1 THEN 'FOLLOW_UP_LIMIT_REACHED'
    WHEN qualifies OR (gate = 'JUDGED' AND escalate) THEN 'OFFER_ISSUED'
    WHEN gate = 'JUDGED' THEN 'ESCALATION_DECLINED' ELSE 'LOW_CHURN_RISK' END AS own FROM cases),
ranked AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY login_timestamp, session_id) AS pos FROM alone),
winners AS (SELECT customer_id, min(pos) AS win FROM ranked WHERE own = 'OFFER_ISSUED' GROUP BY customer_id),
named AS (SELECT r.*, w.win, s.session_id AS win_session FROM ranked r LEFT JOIN winners w ON w.customer_id = r.customer_id
  LEFT JOIN ranked s ON s.customer_id = r.customer_id AND s.pos = w.win),
decided AS (SELECT *, CASE WHEN pos > win AND own NOT IN ('NO_CUSTOMER_ID', 'CUSTOMER_NOT_SCORED') THEN 'ACTIVE_OFFER_ALREADY_EXISTS' ELSE own END AS outcome
  FROM named),
final AS (SELECT *, outcome = 'OFFER_ISSUED' AND NOT qualifies AS escalated,
    CASE WHEN outcome = 'OFFER_ISSUED' THEN concat('off_', session_id, '_retention')
      WHEN outcome = 'ACTIVE_OFFER_ALREADY_EXISTS' AND pos > win THEN concat('off_', win_session, '_retention')
      WHEN outcome = 'ACTIVE_OFFER_ALREADY_EXISTS' THEN active_offer_id END AS link,
    CASE WHEN outcome IN ('OFFER_ISSUED', 'ACTIVE_OFFER_ALREADY_EXISTS') THEN 'PROCESSED' ELSE 'SKIPPED' END AS final_status,
    CASE WHEN outcome = 'ESCALATION_DECLINED' THEN reasoning
      WHEN outcome = 'LOW_CHURN_RISK' AND redeemed > 1 THEN concat('Model rates ', customer_id, ' ', churn_tier, '; the follow-up cap (1) is also reached.')
      WHEN outcome = 'LOW_CHURN_RISK' AND gate = 'TIER_NOT_CANDIDATE' THEN concat(churn_tier, ' is outside the escalation allow-list, so no judgement was asked for.')
      WHEN outcome = 'LOW_CHURN_RISK' AND gate = 'JUDGE_UNAVAILABLE' THEN 'The escalation judge could not be reached, so the model''s own tier stands.'
    END AS detail,
    CASE WHEN outcome IN ('ESCALATION_DECLINED', 'LOW_CHURN_RISK') AND redeemed <= 1 THEN gate
      WHEN outcome = 'OFFER_ISSUED' AND NOT qualifies THEN gate END AS gate_out,
    CASE WHEN outcome = 'OFFER_ISSUED' THEN CASE WHEN qualifies THEN churn_tier ELSE 'HIGH' END END AS eligibility,
    redeemed * 5 AS step
  FROM decided)"""


@query("decide_sessions", f"""WITH {_DECIDED}
SELECT session_id, customer_id, outcome, final_status, link AS linked_offer_id, detail AS skip_detail,
  gate_out AS escalation_gate, eligibility AS eligibility_tier, escalated FROM final""")
def decide_sessions(t):
    return rt.decide_sessions(_cases(t)).select(
        "session_id", "customer_id", "outcome", "final_status", "linked_offer_id", "skip_detail",
        "escalation_gate", "eligibility_tier", "escalated",
    )


@query("rule_offer", """
SELECT session_id, 'Special Customer Loyalty Incentive' AS title, CASE WHEN tier = 'CRITICAL' THEN 25 ELSE 15 END AS discount_percent,
  concat('RETENTION-DET-', tier, '-', right(customer_id, 4)) AS promo_code, tier = 'CRITICAL' AS free_express_shipping,
  CASE WHEN tier = 'CRITICAL' THEN 'FREE_EXPRESS_SHIPPING' ELSE 'FREE_SHIPPING' END AS perks,
  CASE WHEN reason IS NOT NULL THEN 'We apologize for any past shipping inconveniences.' END AS personalized_apology
FROM (SELECT l.session_id, l.customer_id, CASE WHEN event_key % 2 = 0 THEN 'CRITICAL' ELSE 'HIGH' END AS tier,
    CASE WHEN event_key % 3 = 0 THEN 'LATE_DELIVERY' END AS reason FROM fx_logins l WHERE customer_id IS NOT NULL) q""")
def rule_offer(t):
    tier = F.when(F.col("event_key") % 2 == 0, "CRITICAL").otherwise("HIGH")
    reason = F.when(F.col("event_key") % 3 == 0, "LATE_DELIVERY")
    offered = t.fx_logins.where("customer_id IS NOT NULL").withColumn(
        "o", rt.rule_offer(F.col("customer_id"), tier, reason)
    )
    return offered.select(
        "session_id", "o.title", "o.discount_percent", "o.promo_code", "o.free_express_shipping",
        F.concat_ws(",", "o.perks").alias("perks"), "o.personalized_apology",
    )


_CEIL = _CEILING.format(s="segment")
_STEP = f"CASE WHEN step <> 0 THEN greatest(5, {_CEIL} - step) ELSE {_CEIL} END"
_FINAL_CEILING = f"""CASE WHEN gross_margin_percent IS NULL THEN {_STEP}
  ELSE least({_STEP}, cast(floor(greatest(0.0e0, gross_margin_percent - 10.0e0)) AS bigint)) END"""
_OFFERED = f"""{_DECIDED},
offered AS (SELECT f.*, c.title AS c_title, c.session_id IS NOT NULL AS has_copy,
    cast(greatest(0, least(CASE WHEN c.session_id IS NULL THEN CASE WHEN eligibility = 'CRITICAL' THEN 25 ELSE 15 END
      ELSE coalesce(try_cast(coalesce(c.discount_percent, '15') AS bigint), 0) END, {_FINAL_CEILING})) AS bigint) AS granted,
    cast({_STEP} AS bigint) AS ceiling,
    CASE WHEN gate_out IS NOT NULL THEN coalesce(k_reason, primary_complaint_reason) ELSE primary_complaint_reason END AS reason_out
  FROM final f LEFT JOIN fx_copy c ON c.session_id = f.session_id WHERE outcome = 'OFFER_ISSUED')"""


def _composed(t):
    return rt.compose_offer(rt.decide_sessions(_cases(t)), t.fx_copy)


@query("compose_offer", f"""WITH {_OFFERED}
SELECT session_id, CASE WHEN has_copy THEN 'EXTERNAL_COPY' ELSE 'DETERMINISTIC_RULES' END AS generation_source,
  granted AS discount_percent, ceiling AS discount_ceiling_applied,
  CASE WHEN has_copy THEN c_title ELSE 'Special Customer Loyalty Incentive' END AS title FROM offered""")
def compose_offer(t):
    return _composed(t).select(
        "session_id", "generation_source", "discount_percent", "discount_ceiling_applied", "title"
    )


@query("offer_documents", f"""WITH {_OFFERED}
SELECT concat('off_', session_id, '_retention') AS offer_id, customer_id, session_id, churn_probability, churn_tier AS churn_risk_tier,
  eligibility AS eligibility_tier, escalated, CASE WHEN escalated THEN reasoning END AS escalation_reason,
  CASE WHEN has_copy THEN c_title ELSE 'Special Customer Loyalty Incentive' END AS title,
  CASE WHEN has_copy THEN 'Exclusive discount on your next order.'
    ELSE 'We appreciate your ongoing business and want to offer you an exclusive discount.' END AS description,
  CASE WHEN has_copy THEN concat('RETENTION-', right(customer_id, 4))
    ELSE concat('RETENTION-DET-', eligibility, '-', right(customer_id, 4)) END AS promo_code,
  granted AS discount_percent, NOT has_copy AND eligibility = 'CRITICAL' AS free_express_shipping,
  CASE WHEN has_copy THEN '' WHEN eligibility = 'CRITICAL' THEN 'FREE_EXPRESS_SHIPPING' ELSE 'FREE_SHIPPING' END AS perks,
  CASE WHEN NOT has_copy AND reason_out IS NOT NULL THEN 'We apologize for any past shipping inconveniences.' END AS personalized_apology,
  redeemed + 1 AS offer_sequence, last_redeemed_offer_id AS supersedes_offer_id, ceiling AS discount_ceiling_applied,
  'ACTIVE' AS status, '2001-08-01 00:00:00' AS created_at, '2001-08-15 00:00:00' AS valid_until, '2001-08-08 00:00:00' AS cooldown_until,
  cast(NULL AS varchar) AS claimed_at, '2001-10-30 00:00:00' AS ttl_expiry_at, concat('DISPATCH_', churn_tier, '_OFFER') AS retention_action,
  round(context_spend_90d, 6) AS historical_spend_90d, round(context_sentiment, 6) AS support_sentiment_score
FROM offered""")
def offer_documents(t):
    docs = rt.offer_documents(_composed(t), NOW)
    return docs.select(
        *[c for c in docs.columns if c not in ("perks", "metadata", "escalation_trigger")],
        F.concat_ws(",", "perks").alias("perks"), "metadata.retention_action",
        "metadata.historical_spend_90d", "metadata.support_sentiment_score",
    )


@query("escalation_trigger", f"""WITH {_OFFERED}
SELECT session_id, k_order AS order_id, k_rating AS rating, k_reason AS reason,
  strftime(k_submitted, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS submitted_at,
  strftime(k_scored, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS scored_at, round(gap_hours, 2) AS gap_hours, already_scored
FROM offered WHERE escalated""")
def escalation_trigger(t):
    docs = rt.offer_documents(_composed(t), NOW).where("escalated")
    return docs.select("session_id", "escalation_trigger.*")


@query("close_sessions", f"""WITH {_DECIDED}
SELECT session_id, final_status AS agent_processing_status, 'PROCESSED' AS status, link AS offer_id, link AS active_offer_id,
  CASE WHEN outcome <> 'OFFER_ISSUED' THEN outcome END AS skip_reason, detail AS skip_detail, gate_out AS escalation_gate,
  '{NOW}' AS processed_at FROM final""")
def close_sessions(t):
    return rt.close_sessions(rt.decide_sessions(_cases(t)), NOW)


_TRACE_FIELDS = ["delivery_ms", "agent_claim_ms", "agent_call_ms", "bridge_status"]


def partial_traces(t):
    """Traces as maps; each writer has only its own fields, some explicitly NULL."""
    part = F.col("part")
    empty = F.create_map().cast("map<string,string>")
    return t.fx_traces.select(
        "session_id", "recorded_at", "event_key",
        F.map_concat(
            F.when(part == "RECEIVED", F.create_map(
                F.lit("delivery_ms"), F.col("delivery_ms").cast("string"),
                F.lit("bridge_status"), F.col("bridge_status"))).otherwise(empty),
            F.when(part == "AGENT", F.create_map(
                F.lit("agent_claim_ms"), F.col("agent_claim_ms").cast("string"))).otherwise(empty),
            F.when(part == "RETURNED", F.create_map(
                F.lit("agent_call_ms"), F.col("agent_call_ms").cast("string"),
                F.lit("bridge_status"), F.col("bridge_status"))).otherwise(empty),
        ).alias("fields"),
    )


TRACES_SQL = """merged AS (
  SELECT session_id, max(recorded_at) AS recorded_at,
    max_by(delivery_ms, (recorded_at, event_key)) FILTER (WHERE part = 'RECEIVED') AS delivery_ms,
    max(CASE WHEN part = 'AGENT' THEN agent_claim_ms END) AS agent_claim_ms,
    max_by(agent_call_ms, (recorded_at, event_key)) FILTER (WHERE part = 'RETURNED') AS agent_call_ms,
    max_by(bridge_status, (recorded_at, event_key)) FILTER (WHERE part <> 'AGENT') AS bridge_status
  FROM fx_traces GROUP BY session_id)"""


def merged_traces(t):
    merged = rt.session_trace(partial_traces(t), _TRACE_FIELDS)
    return merged.withColumns({f: F.col(f).cast("double") for f in _TRACE_FIELDS if f.endswith("_ms")})


@query("session_trace", f"""WITH {TRACES_SQL}
SELECT session_id, cast(recorded_at AS varchar) AS recorded_at, round(delivery_ms, 6) AS delivery_ms,
  round(agent_claim_ms, 6) AS agent_claim_ms, round(agent_call_ms, 6) AS agent_call_ms, bridge_status FROM merged""")
def session_trace(t):
    return merged_traces(t)


@query("invalid_session_errors", f"""
SELECT session_id, CASE WHEN event_key % 19 = 0 THEN 'ERROR' ELSE agent_processing_status END AS agent_processing_status,
  CASE WHEN event_key % 19 = 0 THEN concat('bad session ', event_key) END AS error_message,
  CASE WHEN event_key % 19 = 0 THEN '{NOW}' END AS processed_at FROM fx_logins""")
def invalid_session_errors(t):
    failed = t.fx_logins.withColumn(
        "failure", F.when(F.col("event_key") % 19 == 0, F.concat(F.lit("bad session "), F.col("event_key")))
    )
    return rt.invalid_session_errors(failed, "failure", NOW).select(
        "session_id", "agent_processing_status", "error_message", "processed_at"
    )
