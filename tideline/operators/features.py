"""Point-in-time churn features and after-the-cutoff labels.

``as_of`` is always an argument.  Training calls the same function with a past
date that scoring calls with the present one.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.scalars import safe_divide

FACT_COLUMNS = [
    "customer_id", "order_id", "order_date", "created_at", "customer_name",
    "customer_email", "customer_segment", "loyalty_tier", "is_loyalty_member",
    "account_age_days", "order_status", "payment_status", "grand_total",
    "profit_margin", "login_frequency_monthly", "avg_session_duration_minutes",
    "app_engagement_score", "cart_abandonment_count", "abandoned_cart_value_90d",
    "support_tickets_count", "open_support_tickets_count", "complaints_count",
    "return_rate_percent", "sentiment_score", "has_active_complaint",
    "feedback_rating",
]

# Readings taken from the customer's newest visible order.
_LATEST = [
    "customer_name", "customer_email", "customer_segment", "loyalty_tier",
    "is_loyalty_member", "account_age_days", "login_frequency_monthly",
    "avg_session_duration_minutes", "app_engagement_score",
    "cart_abandonment_count", "abandoned_cart_value_90d", "support_tickets_count",
    "open_support_tickets_count", "complaints_count", "return_rate_percent",
]

MODEL_FEATURES = [
    "customer_segment", "loyalty_tier", "is_loyalty_member", "account_age_days",
    "days_since_last_purchase", "tenure_days", "orders_lifetime", "orders_90d",
    "orders_180d", "orders_365d", "spend_lifetime", "spend_90d", "spend_365d",
    "avg_order_value", "stddev_order_value", "avg_profit_margin",
    "avg_interpurchase_days", "recency_vs_cadence", "spend_trend_ratio",
    "order_trend_ratio", "login_frequency_monthly", "avg_session_duration_minutes",
    "app_engagement_score", "cart_abandonment_count", "abandoned_cart_value_90d",
    "support_tickets_count", "open_support_tickets_count", "complaints_count",
    "return_rate_percent", "sentiment_score", "avg_rating_180d",
    "complaint_orders_lifetime",
]

HORIZON_DAYS = 90


def _day(value: dt.date | str) -> dt.date:
    return dt.date.fromisoformat(value) if isinstance(value, str) else value


def order_facts(orders: DataFrame) -> DataFrame:
    """Orders that can enter a per-customer time series."""
    return (
        orders.where(F.col("customer_id").isNotNull() & F.col("created_at").isNotNull())
        .where(F.col("order_status").isNull() | (F.col("order_status") != "CANCELLED"))
        .withColumn("order_date", F.to_date("created_at"))
        .select(*FACT_COLUMNS)
    )


def visible_orders(facts: DataFrame, as_of: dt.date | str) -> DataFrame:
    """Facts knowable at ``as_of``.

    The bound is repeated on ``created_at`` because only a comparison on the
    stored column reaches the parquet scan as a pushed filter.
    """
    day = _day(as_of)
    next_midnight = dt.datetime.combine(day + dt.timedelta(days=1), dt.time())
    bound = F.to_timestamp_ltz(F.lit(next_midnight.isoformat(sep=" ")))
    return facts.where((F.col("created_at") < bound) & (F.col("order_date") <= F.lit(day)))


def _trailing(as_of: dt.date, days: int) -> Column:
    return F.col("order_date") > F.lit(as_of - dt.timedelta(days=days))


def _prior_window(as_of: dt.date) -> Column:
    return (F.col("order_date") <= F.lit(as_of - dt.timedelta(days=90))) & _trailing(as_of, 180)


def aggregate_columns(as_of: dt.date) -> list[Column]:
    spend = F.col("grand_total")

    def spend_where(condition: Column) -> Column:
        return F.sum(F.when(condition, spend).otherwise(F.lit(0.0)))

    return [
        F.count("created_at").alias("orders_lifetime"),
        F.sum(spend).alias("spend_lifetime"),
        F.avg(spend).alias("avg_order_value"),
        F.stddev_samp(spend).alias("stddev_order_value"),
        F.min("order_date").alias("first_order_date"),
        F.max("order_date").alias("last_order_date"),
        F.avg("profit_margin").alias("avg_profit_margin"),
        F.count_if(_trailing(as_of, 90)).alias("orders_90d"),
        F.count_if(_trailing(as_of, 180)).alias("orders_180d"),
        F.count_if(_trailing(as_of, 365)).alias("orders_365d"),
        spend_where(_trailing(as_of, 90)).alias("spend_90d"),
        spend_where(_trailing(as_of, 365)).alias("spend_365d"),
        spend_where(_prior_window(as_of)).alias("spend_prior_90d"),
        F.count_if(_prior_window(as_of)).alias("orders_prior_90d"),
        F.avg(F.when(_trailing(as_of, 180), F.col("sentiment_score"))).alias("avg_sentiment_180d"),
        F.avg(F.when(_trailing(as_of, 180), F.col("feedback_rating"))).alias("avg_rating_180d"),
        F.count_if(F.col("has_active_complaint")).alias("complaint_orders_lifetime"),
    ]


def order_aggregates(facts: DataFrame, as_of: dt.date | str) -> DataFrame:
    """Lifetime and trailing-window measures, one row per customer."""
    day = _day(as_of)
    return visible_orders(facts, day).groupBy("customer_id").agg(*aggregate_columns(day))


def latest_reading(columns: list[str]) -> Column:
    """Aggregate: these columns from the newest order, later order id on a tie."""
    return F.max_by(F.struct(*columns), F.struct("created_at", "order_id"))


def latest_order(facts: DataFrame, as_of: dt.date | str) -> DataFrame:
    """One whole order row per customer: the newest visible one."""
    rest = [c for c in facts.columns if c != "customer_id"]
    return (
        visible_orders(facts, as_of)
        .groupBy("customer_id")
        .agg(latest_reading(rest).alias("latest"))
        .select("customer_id", "latest.*")
    )


def rfm_ratios(aggregates: DataFrame, as_of: dt.date | str) -> DataFrame:
    """Recency, tenure, cadence and trend ratios beside the aggregates."""
    day = F.lit(_day(as_of))
    since_last = F.datediff(day, "last_order_date").cast("bigint")
    span = F.datediff("last_order_date", "first_order_date")
    cadence = safe_divide(span, F.col("orders_lifetime") - 1)
    return aggregates.withColumns(
        {
            "days_since_last_purchase": since_last,
            "tenure_days": F.datediff(day, "first_order_date").cast("bigint"),
            "avg_interpurchase_days": cadence,
            "recency_vs_cadence": safe_divide(since_last, cadence),
            "spend_trend_ratio": safe_divide("spend_90d", "spend_prior_90d"),
            "order_trend_ratio": safe_divide("orders_90d", "orders_prior_90d"),
        }
    )


def customer_features(facts: DataFrame, as_of: dt.date | str) -> DataFrame:
    """The 36-column feature vector of every customer with history at ``as_of``.

    The aggregates and the newest order come out of one grouped aggregation, so
    the orders are shuffled once and, being combined on the map side first, a
    customer with very many orders costs no more than any other.
    """
    day = _day(as_of)
    grouped = (
        visible_orders(facts, day)
        .groupBy("customer_id")
        .agg(*aggregate_columns(day), latest_reading(_LATEST).alias("latest"))
    )
    return _feature_vector(grouped, day)


def _feature_vector(grouped: DataFrame, day: dt.date, *extra: str) -> DataFrame:
    """The feature columns of aggregated customers, and some more."""
    return rfm_ratios(grouped, day).select(
        "customer_id", "latest.customer_name", "latest.customer_email",
        "latest.customer_segment", "latest.loyalty_tier",
        F.coalesce("latest.is_loyalty_member", F.lit(False)).alias("is_loyalty_member"),
        "latest.account_age_days", "days_since_last_purchase", "tenure_days",
        "orders_lifetime", "orders_90d", "orders_180d", "orders_365d",
        "spend_lifetime", "spend_90d", "spend_365d", "avg_order_value",
        F.coalesce("stddev_order_value", F.lit(0.0)).alias("stddev_order_value"),
        "avg_profit_margin", "avg_interpurchase_days", "recency_vs_cadence",
        "spend_trend_ratio", "order_trend_ratio", "latest.login_frequency_monthly",
        "latest.avg_session_duration_minutes", "latest.app_engagement_score",
        "latest.cart_abandonment_count", "latest.abandoned_cart_value_90d",
        "latest.support_tickets_count", "latest.open_support_tickets_count",
        "latest.complaints_count", "latest.return_rate_percent",
        F.col("avg_sentiment_180d").alias("sentiment_score"), "avg_rating_180d",
        "complaint_orders_lifetime", F.lit(day).alias("feature_as_of_date"), *extra,
    )


def churn_labels(facts: DataFrame, as_of: dt.date | str, horizon_days: int = HORIZON_DAYS) -> DataFrame:
    """1 when a customer known at the cutoff bought nothing in the horizon after it.

    Orders after the horizon decide nothing; the bound on the stored column
    keeps them out of the scan.
    """
    day = _day(as_of)
    after = day + dt.timedelta(days=horizon_days + 1)
    facts = facts.where(F.col("created_at") < F.lit(after.isoformat()).cast("timestamp"))
    in_horizon = (F.col("order_date") > F.lit(day)) & (
        F.col("order_date") <= F.lit(day + dt.timedelta(days=horizon_days))
    )
    return (
        facts.groupBy("customer_id")
        .agg(
            F.count_if(in_horizon).alias("orders_in_horizon"),
            F.min("order_date").alias("first_order_date"),
        )
        .where(F.col("first_order_date") <= F.lit(day))
        .select(
            "customer_id",
            F.when(F.col("orders_in_horizon") > 0, 0).otherwise(1).cast("bigint").alias("is_churned"),
            "orders_in_horizon",
        )
    )


def training_set(facts: DataFrame, today: dt.date | str, horizon_days: int = HORIZON_DAYS) -> DataFrame:
    """Features one horizon back from ``today`` with the outcome since then.

    One grouped aggregation has both cutoffs: features see an order's columns only up to
    the cutoff (NULL after it, which every aggregate leaves out), labels count those after.
    """
    day = _day(today) - dt.timedelta(days=horizon_days)
    end = day + dt.timedelta(days=horizon_days)
    bound = F.to_timestamp_ltz(F.lit(dt.datetime.combine(end + dt.timedelta(days=1), dt.time()).isoformat(sep=" ")))
    known = F.col("order_date") <= F.lit(day)
    in_horizon = (F.col("order_date") > F.lit(day)) & (F.col("order_date") <= F.lit(end))
    rows = facts.where(F.col("created_at") < bound).select(
        "customer_id", in_horizon.alias("_after"),
        *[F.when(known, F.col(c)).alias(c) for c in facts.columns if c != "customer_id"])
    grouped = rows.groupBy("customer_id").agg(
        *aggregate_columns(day), latest_reading(_LATEST).alias("latest"), F.count_if("_after").alias("orders_in_horizon"))
    labelled = grouped.where(F.col("first_order_date").isNotNull()).withColumn(
        "is_churned", F.when(F.col("orders_in_horizon") > 0, 0).otherwise(1).cast("bigint"))
    return _feature_vector(labelled, day, "is_churned", "orders_in_horizon")


def live_features(facts: DataFrame, today: dt.date | str) -> DataFrame:
    return customer_features(facts, today)


def order_table_functions(view: str) -> list[str]:
    """SQL for the two table functions over an order-facts view.

    They give SQL users ``SELECT * FROM churn_labels_at(DATE'...', 90)``; the
    feature counterpart of these is ``customer_features``.
    """
    return [
        f"""CREATE OR REPLACE TEMPORARY FUNCTION churn_labels_at(cutoff DATE, horizon INT)
            RETURNS TABLE (customer_id STRING, is_churned INT, orders_in_horizon BIGINT)
            RETURN SELECT customer_id, if(sum(inside) > 0, 0, 1), sum(inside)
                   FROM (SELECT customer_id, order_date <= cutoff AS known,
                                cast(order_date > cutoff AND order_date <= date_add(cutoff, horizon) AS bigint) AS inside
                         FROM {view}) flagged
                   GROUP BY customer_id HAVING bool_or(known)""",
        f"""CREATE OR REPLACE TEMPORARY FUNCTION visible_orders_at(cutoff DATE)
            RETURNS TABLE (customer_id STRING, order_id STRING, order_date DATE, grand_total DOUBLE)
            RETURN SELECT customer_id, order_id, order_date, grand_total
                   FROM {view} WHERE order_date <= cutoff""",
    ]
