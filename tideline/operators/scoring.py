"""From predicted probabilities to the serving table of churn risk."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.scalars import as_col
from tideline.sources import snapshots

RISK_COLUMNS = [
    "customer_id", "customer_name", "customer_email", "customer_segment",
    "loyalty_tier", "predicted_is_churned", "churn_probability", "churn_risk_tier",
    "total_spend_90d", "days_since_last_purchase", "cart_abandonment_count",
    "support_tickets_count", "sentiment_score", "automated_retention_action",
    "calculation_timestamp",
]

# Lowest probability of each tier above LOW.
CRITICAL_FROM = 0.80
HIGH_FROM = 0.60
MODERATE_FROM = 0.40

# An explicit id list beyond this length is joined instead of written into the filter.
MAX_LITERAL_IDS = 1000


def risk_tier(probability: Column | str) -> Column:
    """Tier of a probability; a missing probability ends in LOW."""
    p = as_col(probability)
    return (
        F.when(p >= CRITICAL_FROM, "CRITICAL")
        .when(p >= HIGH_FROM, "HIGH")
        .when(p >= MODERATE_FROM, "MODERATE")
        .otherwise("LOW")
    )


def retention_action(
    probability: Column | str, spend_90d: Column | str, abandoned_carts: Column | str
) -> Column:
    """Suggested intervention, from value as well as risk."""
    p, spend, carts = as_col(probability), as_col(spend_90d), as_col(abandoned_carts)
    return (
        F.when((p >= CRITICAL_FROM) & (spend >= 5000), "EXECUTIVE_OUTREACH_PLUS_TIER_UPGRADE")
        .when(p >= CRITICAL_FROM, "HIGH_VALUE_RETENTION_OFFER")
        .when((p >= HIGH_FROM) & (carts >= 3), "CART_RECOVERY_INCENTIVE")
        .when(p >= HIGH_FROM, "TARGETED_LOYALTY_DISCOUNT")
        .when(p >= MODERATE_FROM, "ENGAGEMENT_CAMPAIGN")
        .otherwise("MONITOR_ONLY")
    )


def score_customers(predictions: DataFrame, calculated_at: Column | str) -> DataFrame:
    """The 15 serving columns.

    ``predictions`` are feature rows with ``churn_probability`` and
    ``predicted_is_churned`` added.  They still hold every feature, so nothing
    has to be joined back.
    """
    stamp = F.lit(calculated_at).cast("timestamp")
    return (
        predictions.withColumn("total_spend_90d", F.col("spend_90d"))
        .withColumn("churn_risk_tier", risk_tier("churn_probability"))
        .withColumn(
            "automated_retention_action",
            retention_action("churn_probability", "total_spend_90d", "cart_abandonment_count"),
        )
        .withColumn("calculation_timestamp", stamp)
        .select(*RISK_COLUMNS)
    )


def merge_actions(target: DataFrame, source: DataFrame, key: str = "customer_id") -> DataFrame:
    """One row per key of either side, tagged INSERT, UPDATE or DELETE."""
    known = target.select(key).withColumn("_in_target", F.lit(True))
    fresh = source.withColumn("_in_source", F.lit(True))
    return (
        known.join(fresh, key, "full_outer")
        .withColumn(
            "merge_action",
            F.when(F.col("_in_source").isNull(), "DELETE")
            .when(F.col("_in_target").isNull(), "INSERT")
            .otherwise("UPDATE"),
        )
        .drop("_in_target", "_in_source")
    )


def merge_churn_risk(target: DataFrame, source: DataFrame, key: str = "customer_id") -> DataFrame:
    """Full-sync merge: the table after updating, inserting and deleting."""
    return (
        merge_actions(target, source, key)
        .where(F.col("merge_action") != "DELETE")
        .select(*source.columns)
    )


def merge_counts(target: DataFrame, source: DataFrame, key: str = "customer_id") -> DataFrame:
    """Rows inserted, updated and deleted by the same merge."""
    return (
        merge_actions(target, source, key)
        .groupBy("merge_action")
        .agg(F.count(F.lit(1)).alias("affected"))
    )


def store_merge(source: DataFrame, root: str, key: str = "customer_id") -> DataFrame:
    """Full-sync merge into the stored table below ``root``: (merge_action, affected).

    The merge is computed once against the newest version and becomes the next one, which
    readers see when it is whole.  What happened to each key is kept beside it
    (``merge_log``).  If another merge came between, this one is taken back and fails.
    """
    spark = source.sparkSession
    before = snapshots.versions(spark, root)
    target = snapshots.read_latest(spark, root, schema=source.schema)
    # Written once with its tags, then read twice.
    tagged = snapshots.staged(spark, merge_actions(target, source, key), root)
    version = snapshots.write_version(tagged.where("merge_action <> 'DELETE'").select(*source.columns), root)
    if [v for v in snapshots.versions(spark, root) if v != version] != before:
        snapshots.delete(spark, f"{root}/version={version}")
        raise RuntimeError(f"{root} has moved on from version {before[-1] if before else 0}")
    tagged.select(key, "merge_action").write.mode("overwrite").parquet(f"{root}/_log/version={version}")
    return merge_log(spark, root, version).groupBy("merge_action").agg(F.count(F.lit(1)).alias("affected"))


def merge_log(spark: SparkSession, root: str, version: int) -> DataFrame:
    """What the merge that made a version did with each key."""
    return spark.read.parquet(f"{root}/_log/version={version}")


def churn_scores_for(scores: DataFrame, customer_ids: Iterable[str] | DataFrame) -> DataFrame:
    """Scores of a given set of customers, in id order.

    A short list is a literal filter that reaches the scan; a DataFrame of ids
    is a semi join whose strategy is left to the optimizer.
    """
    if isinstance(customer_ids, DataFrame):
        chosen = scores.join(customer_ids.select("customer_id"), "customer_id", "left_semi")
    else:
        ids = list(customer_ids)
        if len(ids) > MAX_LITERAL_IDS:
            listed = scores.sparkSession.createDataFrame([(i,) for i in ids], "customer_id string")
            return churn_scores_for(scores, listed)
        chosen = scores.where(F.col("customer_id").isin(ids))
    return chosen.select(
        "customer_id", "churn_probability", "churn_risk_tier", "customer_segment",
        "total_spend_90d", "sentiment_score", "calculation_timestamp",
    ).orderBy("customer_id")


def risk_distribution(scores: DataFrame) -> DataFrame:
    """Customers and mean probability per tier, highest first."""
    return (
        scores.groupBy("churn_risk_tier")
        .agg(
            F.count(F.lit(1)).alias("customers"),
            F.round(F.avg("churn_probability"), 4).alias("avg_probability"),
        )
        .orderBy(F.desc("avg_probability"))
    )


def latest_evaluation(evaluations: DataFrame) -> DataFrame:
    """The newest evaluation row."""
    return evaluations.orderBy(F.desc("evaluated_at")).limit(1)
