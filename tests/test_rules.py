"""Check values of the decision and casting rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tideline.functions import policy
from tideline.functions.scalars import change_sequence_hex, parse_instant, stable_hash
from tideline.functions.values import BRANCHES, coerce_column, plain_fields
from tideline.operators import offers as of
from tideline.operators import catalog, retention, scoring, sessions


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def typed(branch, raw):
    return F.struct(*[F.lit(raw if b == branch else None).cast("string").alias(b) for b in BRANCHES])


@pytest.mark.parametrize("branch, raw, kind, expected", [
    ("integerValue", "42", "INT64", 42), ("doubleValue", "42.9", "INT64", 42),
    ("stringValue", "42.9", "INT64", 42), ("booleanValue", "true", "INT64", 1),
    ("stringValue", "3.5", "FLOAT64", 3.5), ("stringValue", "not-a-number", "INT64", None),
    ("doubleValue", "Infinity", "INT64", None), ("stringValue", "42d", "FLOAT64", None),
    ("stringValue", "true", "BOOL", True), ("stringValue", "no", "BOOL", False),
    ("stringValue", " YES ", "BOOL", True), ("integerValue", "0", "BOOL", False),
    ("booleanValue", "true", "STRING", "True"), ("nullValue", "NULL_VALUE", "STRING", None),
    ("timestampValue", "2026-08-31T10:15:00Z", "INT64", 1788171300000000),
    ("stringValue", "2026-08-31T10:15:00", "TIMESTAMP", dt.datetime(2026, 8, 31, 10, 15)),
    ("integerValue", "1788171300", "TIMESTAMP", dt.datetime(2026, 8, 31, 10, 15)),
    ("integerValue", "1788171300000000", "TIMESTAMP", dt.datetime(2026, 8, 31, 10, 15)),
])
def test_coerce(spark, branch, raw, kind, expected):
    value = one(spark, coerce_column(typed(branch, raw), kind))
    if kind == "TIMESTAMP":
        value = value.astimezone(dt.timezone.utc).replace(tzinfo=None) if value.tzinfo else value
        micros = one(spark, F.unix_micros(coerce_column(typed(branch, raw), kind)))
        assert micros == int(expected.replace(tzinfo=dt.timezone.utc).timestamp() * 1_000_000)
    else:
        assert value == expected


def test_nested_document_is_decoded():
    fields = {
        "a": {"arrayValue": {"values": [{"integerValue": "1"}, {"mapValue": {"fields": {"b": {"stringValue": "x"}}}}]}},
        "when": {"timestampValue": "2026-08-31T10:15:00.123456789Z"}, "odd": {"newValue": 3}, "none": {"nullValue": None},
    }
    assert plain_fields(fields) == {
        "a": [1, {"b": "x"}], "when": "2026-08-31 10:15:00.123456+00:00", "odd": {"newValue": 3}, "none": None,
    }


def test_sequence_and_hash(spark):
    ts = parse_instant(F.lit("2026-08-31T10:15:00Z"))
    assert one(spark, change_sequence_hex(ts)) == format(1788171300000000, "x")
    assert len(one(spark, stable_hash(F.lit("a"), F.lit(1)))) == 16


@pytest.mark.parametrize("p, tier", [(0.8, "CRITICAL"), (0.6, "HIGH"), (0.4, "MODERATE"), (0.39, "LOW"), (None, "LOW")])
def test_tier(spark, p, tier):
    assert one(spark, scoring.risk_tier(F.lit(p).cast("double"))) == tier


@pytest.mark.parametrize("segment, ceiling", [
    ("ENTERPRISE_VIP", 25), ("RETAIL_PRO", 20), ("STANDARD_LOYALTY", 15), ("CASUAL", 12), ("MYSTERY", 15),
    ("PLATINUM", 20), (None, 15), ("CASUAL_SHOPPER", 15), ("gold", 20),
])
def test_ceiling(spark, segment, ceiling):
    assert one(spark, policy.discount_ceiling(F.lit(segment).cast("string"))) == ceiling


@pytest.mark.parametrize("request_, segment, margin, step, granted", [
    ("40", "CASUAL", None, 0, 12), ("lots", "CASUAL", None, 0, 0), ("25", "ENTERPRISE_VIP", 18.0, 0, 8),
    ("25", "ENTERPRISE_VIP", 60.0, 0, 25), ("25", "ENTERPRISE_VIP", 10.0, 0, 0), ("25", "ENTERPRISE_VIP", 4.0, 0, 0),
    ("25", "ENTERPRISE_VIP", None, 40, 5),
])
def test_guardrails(spark, request_, segment, margin, step, granted):
    column = policy.discount_guardrails(
        F.lit(request_), F.lit(segment), F.lit(margin).cast("double"), F.lit(step), from_text=True
    )
    assert one(spark, column) == granted


@pytest.mark.parametrize("gap, text", [(-0.15, "9 minutes BEFORE"), (2.0, "2.0 hours AFTER"), (18.95, "18.9 hours AFTER"), (None, "unknown")])
def test_timing_line(spark, gap, text):
    assert text in one(spark, retention.timing_line(F.lit(gap).cast("double")))


def test_bad_arguments(spark):
    orders = spark.createDataFrame([], "customer_id string, created_at timestamp, order_id string")
    with pytest.raises(ValueError):
        catalog.list_orders(orders, "")
    with pytest.raises(ValueError):
        catalog.newest_orders(orders, 0)
    with pytest.raises(ValueError):
        catalog.list_orders(orders, "c", 101)
    assert sessions.reuse_age("x") == 120 and sessions.reuse_age("-1") == 120 and sessions.reuse_age("5") == 5


def test_one_of_equal_claims_wins(spark):
    columns = "offer_id string, claim_id string, order_id string, claimed_at string"
    claims = [("a", "c1", None, "1"), ("a", "c1", None, "1"), ("a", "c2", None, "2"), ("a", "c3", "o", "3"), ("a", "c3", "o", "3"),
              ("b", "c4", "o", "1"), ("b", "c4", "o", "1"), ("b", "c4", None, "1"), ("x", "c5", None, "1"), (None, "c6", None, "1")]
    offers = spark.createDataFrame([("a", "ACTIVE", None), ("b", "REDEEMED", "")], "offer_id string, status string, order_id string")
    rows = of.claim_offers(spark.createDataFrame(claims, columns).repartition(4), offers).collect()
    assert sorted((r.claim_id, r.order_id or "") for r in rows if r.accepted) == [("c1", ""), ("c3", "o"), ("c4", "o")]
    assert len(rows) == len(claims) and sum(r.rejection == "OFFER_NOT_FOUND" for r in rows) == 2
    assert [c for c in rows[0].asDict()][:4] == ["offer_id", "claim_id", "order_id", "claimed_at"]


NOW = "2026-09-21 12:00:00"


def decide(spark, offers, probability=0.9, tier=None, verdict=None, logins=("2026-09-21 11:00:00",)):
    ts = "timestamp"
    session_rows = [(f"s{i}", "c1", "PENDING", moment) for i, moment in enumerate(logins)]
    claimed = spark.createDataFrame(
        session_rows, "session_id string, customer_id string, agent_processing_status string, login_timestamp string"
    ).withColumn("login_timestamp", F.col("login_timestamp").cast(ts))
    scores = spark.createDataFrame(
        [("c1", probability, tier, "STANDARD_LOYALTY", 10.0, 0.5, "2026-09-21 02:00:00")],
        "customer_id string, churn_probability double, churn_risk_tier string, customer_segment string, "
        "total_spend_90d double, sentiment_score double, calculation_timestamp string",
    ).withColumn("calculation_timestamp", F.col("calculation_timestamp").cast(ts))
    offer_rows = spark.createDataFrame(
        offers, "offer_id string, customer_id string, status string, created_at string, cooldown_until string, valid_until string"
    ).withColumns({c: F.col(c).cast(ts) for c in ("created_at", "cooldown_until", "valid_until")})
    profiles = spark.createDataFrame([("c1", "STANDARD_LOYALTY")], "customer_id string, customer_segment string")
    orders = spark.createDataFrame(
        [("o1", "c1", "2026-09-20 09:00:00", 1, "LATE_DELIVERY", "late", "2026-09-20 09:00:00")],
        "order_id string, customer_id string, created_at string, rating int, reason string, comment string, feedback_at string",
    ).withColumns({c: F.col(c).cast(ts) for c in ("created_at", "feedback_at")})
    verdicts = spark.createDataFrame(
        [] if verdict is None else [("s0", verdict, "because")], "session_id string, escalate boolean, reasoning string"
    )
    cases = retention.session_cases(
        retention.claim_sessions(claimed, NOW, "w"), scores, offer_rows, profiles, orders, verdicts, NOW
    )
    decisions = retention.decide_sessions(cases)
    copy = spark.createDataFrame([], "session_id string, title string")
    docs = retention.offer_documents(retention.compose_offer(decisions, copy), NOW)
    return decisions.orderBy("session_id").collect(), docs.collect()


def offer(status, created, name="off"):
    return (name, "c1", status, created, None, "2026-10-05 00:00:00")


def test_follow_up_steps_down(spark):
    decisions, docs = decide(spark, [offer("REDEEMED", "2026-09-20 12:00:00")])
    assert decisions[0]["outcome"] == "OFFER_ISSUED"
    assert (docs[0]["discount_percent"], docs[0]["offer_sequence"], docs[0]["supersedes_offer_id"]) == (10, 2, "off")


@pytest.mark.parametrize("probability, reason", [(0.9, "FOLLOW_UP_LIMIT_REACHED"), (0.3, "LOW_CHURN_RISK")])
def test_follow_up_cap(spark, probability, reason):
    offers = [offer("REDEEMED", "2026-09-20 12:00:00", "a"), offer("REDEEMED", "2026-09-19 12:00:00", "b")]
    decisions, docs = decide(spark, offers, probability)
    assert decisions[0]["skip_reason"] == reason and not docs


@pytest.mark.parametrize("status, created, reason", [
    ("EXPIRED", "2026-09-19 12:00:00", "COOLDOWN_ACTIVE"), ("ACTIVE", "2026-09-20 12:00:00", "ACTIVE_OFFER_ALREADY_EXISTS"),
    ("ACTIVE", "2026-08-22 12:00:00", None),
])
def test_cooldown(spark, status, created, reason):
    decisions, _ = decide(spark, [offer(status, created)])
    assert decisions[0]["skip_reason"] == reason


@pytest.mark.parametrize("verdict, reason, gate", [
    (True, None, "JUDGED"), (False, "ESCALATION_DECLINED", "JUDGED"), (None, "LOW_CHURN_RISK", "JUDGE_UNAVAILABLE"),
])
def test_escalation(spark, verdict, reason, gate):
    decisions, docs = decide(spark, [], 0.5, verdict=verdict)
    assert (decisions[0]["skip_reason"], decisions[0]["escalation_gate"]) == (reason, gate)
    if verdict:
        assert (docs[0]["churn_risk_tier"], docs[0]["eligibility_tier"], docs[0]["discount_percent"]) == ("MODERATE", "HIGH", 15)


def test_second_session_finds_the_first_ones_offer(spark):
    decisions, docs = decide(spark, [], logins=("2026-09-21 11:30:00", "2026-09-21 11:00:00"))
    assert [d["outcome"] for d in decisions] == ["ACTIVE_OFFER_ALREADY_EXISTS", "OFFER_ISSUED"]
    assert decisions[0]["linked_offer_id"] == docs[0]["offer_id"] == "off_s1_retention"
