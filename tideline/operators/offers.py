"""Which offer prices an order, and what a redemption may do to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.policy import PRICING_SCAN_LIMIT
from tideline.functions.scalars import as_col, null_if_empty
from tideline.operators.retention import at
from tideline.session import work_dir

GUARDED_FIELDS = ["status", "claimed_at", "order_id"]


def offer_spendable(customer_id: Column | str, now: str, prefix: str = "") -> Column:
    """Whether the offer in the row may price an order of this customer."""
    own = F.col(f"{prefix}customer_id") == as_col(customer_id)
    unspent = null_if_empty(f"{prefix}order_id").isNull()
    open_status = F.col(f"{prefix}status").isin("ACTIVE", "REDEEMED")
    valid = F.coalesce(F.col(f"{prefix}valid_until") >= at(now), F.lit(True))
    return F.coalesce(own & unspent & open_status & valid, F.lit(False))


def newest_offers(offers: DataFrame, limit: int = PRICING_SCAN_LIMIT) -> DataFrame:
    newest = Window.partitionBy("customer_id").orderBy(F.desc("created_at"), F.desc("offer_id"))
    return offers.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= limit).drop("_rank")


def find_spendable_offer(offers: DataFrame, now: str, limit: int = PRICING_SCAN_LIMIT) -> DataFrame:
    """Per customer the newest spendable offer among the newest few.

    A spendable offer older than those is not found; that is the rule.
    """
    rest = [c for c in offers.columns if c != "customer_id"]
    return (
        newest_offers(offers, limit)
        .where(offer_spendable("customer_id", now))
        .groupBy("customer_id")
        .agg(F.max_by(F.struct(*rest), F.struct("created_at", "offer_id")).alias("o"))
        .select("customer_id", "o.*")
    )


def resolve_offer(requests: DataFrame, offers: DataFrame, now: str) -> DataFrame:
    """The offer that prices each request.

    A request that names an offer gets that offer or none; only a request
    without a name falls back to the customer's newest spendable one.
    """
    named = offers.select(
        F.col("offer_id").alias("requested_offer_id"),
        F.struct(*offers.columns).alias("_named"),
    )
    found = find_spendable_offer(offers, now)
    listed = found.select("customer_id", F.struct(*[F.col(c) for c in offers.columns]).alias("_found"))
    asks = null_if_empty("requested_offer_id").isNotNull()
    usable = offer_spendable("customer_id", now, "_named.")
    chosen = F.when(asks, F.when(usable, F.col("_named"))).otherwise(F.col("_found"))
    return (
        requests.join(named, "requested_offer_id", "left")
        .join(listed, "customer_id", "left")
        .withColumn("_offer", chosen)
        .select(
            *requests.columns,
            *[F.col(f"_offer.{c}").alias(c) for c in offers.columns if c not in requests.columns],
        )
    )


def claim_offers(claims: DataFrame, offers: DataFrame) -> DataFrame:
    """Accept or reject each claim, as if they were handled in claim order.

    An ACTIVE offer takes its first claim.  A redeemed offer without an order
    still takes the first claim that brings one.  Both are grouped minimums,
    so an offer with very many claims needs no ordered pass over them.  Claims
    come by time, id and order; of equal ones a stored row number makes exactly
    one the first, however often a claim was delivered.
    """
    columns = claims.columns
    path = work_dir(claims.sparkSession, "claims")
    claims.withColumn("_row", F.monotonically_increasing_id()).write.parquet(path)
    claims = claims.sparkSession.read.parquet(path)
    position = F.struct("claimed_at", "claim_id", null_if_empty("order_id").alias("order_id"), "_row")
    brings_order = null_if_empty("order_id").isNotNull()
    firsts = claims.groupBy("offer_id").agg(
        F.min(position).alias("_first"),
        F.min(F.when(brings_order, position)).alias("_first_with_order"),
    )
    state = offers.select(
        "offer_id", F.col("status").alias("_status"),
        null_if_empty("order_id").alias("_spent_on"), F.lit(True).alias("_known"),
    )
    mine = position
    active = F.col("_status") == "ACTIVE"
    unspent = (F.col("_status") == "REDEEMED") & F.col("_spent_on").isNull()
    accepted = F.coalesce(
        (active & (mine == F.col("_first")))
        | ((active | unspent) & brings_order & (mine == F.col("_first_with_order"))),
        F.lit(False),
    )
    status_then = F.when(active, "REDEEMED").otherwise(F.col("_status"))
    return (
        claims.join(state, "offer_id", "left")
        .join(firsts, "offer_id", "left")
        .select(
            *columns,
            accepted.alias("accepted"),
            F.when(F.col("_known").isNull(), "OFFER_NOT_FOUND")
            .when(~accepted, F.concat(F.lit("OFFER_IS_"), F.coalesce(status_then, F.lit("NULL"))))
            .alias("rejection"),
            F.when(accepted, "REDEEMED").alias("new_status"),
        )
    )


def claim_field_guard(before: DataFrame, after: DataFrame) -> DataFrame:
    """Which offer updates are a plain redemption, and what the others touched.

    The comparison is NULL-safe and field by field over the columns of both.
    """
    watched = [c for c in before.columns if c in after.columns and c != "offer_id"]
    old = before.select("offer_id", *[F.col(c).alias(f"_old_{c}") for c in watched])
    joined = after.join(old, "offer_id")
    touched = {c: ~F.col(c).eqNullSafe(F.col(f"_old_{c}")) for c in watched}
    others = [c for c in sorted(watched) if c not in GUARDED_FIELDS]
    violations = F.concat_ws(",", *[F.when(touched[c], F.lit(c)) for c in others])
    allowed = (
        (violations == "")
        & F.coalesce(F.col("_old_status") == "ACTIVE", F.lit(False))
        & F.coalesce(F.col("status") == "REDEEMED", F.lit(False))
    )
    return joined.select(
        "offer_id", allowed.alias("allowed"), violations.alias("violations"),
        F.col("_old_status").alias("old_status"), F.col("status").alias("new_status"),
    )


def offers_for_session(sessions: DataFrame, offers: DataFrame) -> DataFrame:
    """The offers written for each session."""
    extra = [F.col(c) for c in offers.columns if c == "session_id" or c not in sessions.columns]
    return sessions.join(offers.select(*extra), "session_id")
