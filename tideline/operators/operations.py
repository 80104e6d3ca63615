"""Resets, recent views, traces and checks for whoever runs the system."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.scalars import null_if_empty, parse_instant
from tideline.operators.pricing import APP_ORDER_PREFIX
from tideline.operators.retention import at
from tideline.operators.sessions import TERMINAL
from tideline.operators.skew import bucketed_lag

RECENT_LIMIT = 10
APP_ORDERS_LIMIT = 25


# --- purges -------------------------------------------------------------------


def _matches(df: DataFrame, field: str, values: Iterable[str] | DataFrame, how: str) -> DataFrame:
    if isinstance(values, DataFrame):
        return df.join(values.select(F.col(values.columns[0]).alias(field)), field, how)
    hit = F.coalesce(F.col(field).isin(list(values)), F.lit(False))
    return df.where(hit if how == "left_semi" else ~hit)


def purge_by_values(df: DataFrame, field: str, values: Iterable[str] | DataFrame) -> DataFrame:
    """What is left after deleting the rows whose field is one of the values."""
    return _matches(df, field, values, "left_anti")


def purged_by_values(df: DataFrame, field: str, values: Iterable[str] | DataFrame) -> DataFrame:
    """The rows the same purge deletes."""
    return _matches(df, field, values, "left_semi")


def purge_counts(df: DataFrame, gone: DataFrame) -> DataFrame:
    """(deleted, kept) of a purge that deletes the rows ``gone`` of ``df``."""
    return gone.agg(F.count(F.lit(1)).alias("deleted")).join(df.agg(F.count(F.lit(1)).alias("_all"))).select(
        "deleted", (F.col("_all") - F.col("deleted")).alias("kept"))


def _has_prefix(field: str, prefix: str) -> Column:
    return F.coalesce(F.col(field).startswith(prefix), F.lit(False))


def purge_by_prefix(df: DataFrame, field: str, prefix: str) -> DataFrame:
    """What is left after deleting the rows whose id starts with the prefix."""
    return df.where(~_has_prefix(field, prefix))


def purged_by_prefix(df: DataFrame, field: str, prefix: str) -> DataFrame:
    """The rows the same purge deletes."""
    return df.where(_has_prefix(field, prefix))


def remaining_by_prefix(df: DataFrame, field: str, prefix: str) -> DataFrame:
    """How many rows still carry the prefix: zero once replication has drained."""
    return df.where(F.col(field).startswith(prefix)).agg(F.count(F.lit(1)).alias("remaining"))


def reset_plan(
    sessions: DataFrame, offers: DataFrame, traces: DataFrame, orders: DataFrame,
    customer_ids: Iterable[str], legacy_ids: Iterable[str], prefix: str = APP_ORDER_PREFIX,
) -> DataFrame:
    """Rows each of the five sweeps of a reset deletes.

    Each sweep is one filtered count.  The order sweeps run one after the
    other, so an order that matches both is counted by the prefix sweep only.
    """
    ids, legacy = list(customer_ids), list(legacy_ids)
    after_prefix = purge_by_prefix(orders, "order_id", prefix)
    sweeps = {
        "sessions": purged_by_values(sessions, "customer_id", ids),
        "offers": purged_by_values(offers, "customer_id", ids),
        "traces": purged_by_values(traces, "customer_id", ids),
        "app_orders": orders.where(_has_prefix("order_id", prefix)),
        "legacy_orders": purged_by_values(after_prefix, "customer_id", legacy),
    }
    counts = [
        df.agg(F.count(F.lit(1)).alias("deleted")).select(F.lit(name).alias("sweep"), "deleted")
        for name, df in sweeps.items()
    ]
    plan = counts[0]
    for one in counts[1:]:
        plan = plan.unionByName(one)
    return plan


def ttl_expire(df: DataFrame, expiry: str, now: str) -> DataFrame:
    """Documents that have not expired; one without an expiry never does."""
    return df.where(F.col(expiry).isNull() | (F.col(expiry) > at(now)))


# --- recent views --------------------------------------------------------------


def newest(df: DataFrame, moment: str, tie: str, limit: int = RECENT_LIMIT) -> DataFrame:
    """The newest rows; Spark keeps only that many per task."""
    return df.orderBy(F.desc(moment), F.desc(tie)).limit(limit)


def recent_sessions(sessions: DataFrame, limit: int = RECENT_LIMIT) -> DataFrame:
    return newest(sessions, "login_timestamp", "session_id", limit)


def recent_offers_view(offers: DataFrame, limit: int = RECENT_LIMIT) -> DataFrame:
    return newest(offers, "created_at", "offer_id", limit)


def recent_traces(traces: DataFrame, limit: int = RECENT_LIMIT) -> DataFrame:
    return newest(traces, "recorded_at", "session_id", limit)


def recent_app_orders(
    orders: DataFrame, prefix: str = APP_ORDER_PREFIX, limit: int = APP_ORDERS_LIMIT
) -> DataFrame:
    return orders.where(F.col("order_id").startswith(prefix)).orderBy("order_id").limit(limit)


def latest_document(documents: DataFrame, created: str = "create_time", key: str = "id") -> DataFrame:
    """The newest document; one whose creation time cannot be read is the oldest."""
    rest = [c for c in documents.columns]
    return documents.agg(
        F.max_by(F.struct(*rest), F.struct(parse_instant(created).alias("t"), F.col(key))).alias("d")
    ).select("d.*")


def new_revisions(
    deliveries: DataFrame, key: str = "id", update_time: str = "update_time", arrival: str = "arrival",
    bucket: Column | None = None,
) -> DataFrame:
    """Deliveries that show another revision than the one before, per document.

    Documents are scanned in buckets of their deliveries; ``bucket`` maps a row to
    its bucket and must follow the order of arrival.  A NULL key is a document of
    its own, and a NULL arrival comes first.
    """
    stamped = deliveries.withColumn("_stamp", F.coalesce(F.col(update_time).cast("string"), F.lit("")))
    by_bucket = F.floor(F.col(arrival) / 100_000) if bucket is None else bucket
    both = bucketed_lag(stamped, key, by_bucket, [arrival], "_stamp", "_prev")
    return both.where(~F.col("_prev_found") | (F.col("_stamp") != F.col("_prev"))).select(*deliveries.columns)


# --- traces ------------------------------------------------------------------------


def merge_telemetry(measurements: DataFrame, measures: list[str]) -> DataFrame:
    """Per session the last non-NULL value of each measure."""
    tie = [c for c in ("recorded_at", "event_key") if c in measurements.columns]

    def last(measure: str) -> Column:
        given = (F.col("measure") == measure) & F.col("value").isNotNull()
        return F.max_by("value", F.when(given, F.struct(*tie))).alias(measure)

    return measurements.groupBy("session_id").agg(
        *[last(m) for m in measures], F.max("recorded_at").alias("recorded_at")
    )


def correlate_traces(sessions: DataFrame, orders: DataFrame, traces: DataFrame) -> DataFrame:
    """Sessions and orders with the trace that belongs to each.

    Traces are keyed by session id, or by ``order_`` and the order id.
    """
    keyed = traces.select(F.col("trace_id"), F.col("recorded_at").alias("traced_at"))
    subjects = sessions.select(
        F.lit("SESSION").alias("kind"), F.col("session_id").alias("subject_id"), F.col("session_id").alias("trace_id")
    ).unionByName(
        orders.select(
            F.lit("ORDER").alias("kind"), F.col("order_id").alias("subject_id"),
            F.concat(F.lit("order_"), F.col("order_id")).alias("trace_id"),
        )
    )
    return subjects.join(keyed, "trace_id", "left")


# The hops of a login, in order, with the measure each one owns, the states
# of a hop, and what a hop says while nothing more telling is known.
HOP_MEASURES = {
    "client": "login_write_ms", "firestore": "order_write_ms", "eventarc": "delivery_ms", "bridge": "bridge_overhead_ms",
    "agent": "agent_call_ms", "offer": "llm_reasoning_ms", "bigquery": "total_ms",
}
DONE, ACTIVE, IDLE, FAILED, SKIPPED = "done", "active", "idle", "error", "skipped"
WITH_TELEMETRY, LOGIN_ONLY = "login · telemetry", "login write"
ORDER_WRITTEN, SESSION_WRITTEN, NO_LOGIN = "order write", "customer_sessions", "awaiting login"
IN_FLIGHT, PENDING, REPLICATING, NO_ORDER, NO_REASON = "in flight", "pending", "replicating", "no order yet", "no offer"


def _single(df: DataFrame) -> DataFrame:
    """One row per session: of several the greatest, column by column."""
    rest = [c for c in df.columns if c != "session_id"]
    if not rest:
        return df.distinct()
    return df.groupBy("session_id").agg(F.max(F.struct(*rest)).alias("_row")).select("session_id", "_row.*")


def hop_status(
    sessions: DataFrame, traces: DataFrame, offers: DataFrame, telemetry: DataFrame, order_traces: DataFrame
) -> DataFrame:
    """State, latency and detail of each of the seven hops of every login, long form.

    A login that only telemetry knows has no session yet: its client is active and the
    hops behind wait.  Inputs may repeat a session; one row of each is used: merged
    traces; offers; telemetry with login_write_ms and order_write_ms; order traces with
    total_ms.  Columns that only serve details (agent_worker_id, skip_reason, event_time,
    bridge_received_at, discount_percent, tables) may be missing.
    """
    joined = (
        _single(sessions.withColumn("_session", F.lit(True)))
        .join(_single(telemetry.withColumn("_telemetry", F.lit(True))), "session_id", "full_outer")
        .join(_single(traces), "session_id", "left")
        .join(_single(offers.withColumn("_offer", F.lit(True))), "session_id", "left")
        .join(_single(order_traces.withColumn("_ordered", F.lit(True))), "session_id", "left")
    )

    def given(name: str) -> Column:
        return F.col(name) if name in joined.columns else F.lit(None).cast("string")

    def clock(name: str) -> Column:
        return F.date_format(given(name).cast("timestamp"), "HH:mm:ss")

    status, session, ordered = F.col("agent_processing_status"), F.col("_session"), F.col("order_write_ms").isNotNull()
    terminal = F.coalesce(status.isin(TERMINAL), F.lit(False))
    claimed = F.col("agent_claim_ms").isNotNull() | terminal
    delivered = F.col("bridge_status").isNotNull() | claimed
    errored = F.coalesce(status == "ERROR", F.lit(False)) | F.coalesce(F.col("bridge_status") == "AGENT_ERROR", F.lit(False))
    skipped = F.coalesce(status == "SKIPPED", F.lit(False))
    moving = F.when(delivered, DONE).when(session, ACTIVE).otherwise(IDLE)
    travelling = F.when(session, IN_FLIGHT).otherwise(IDLE)
    states = {
        "client": F.when(session, DONE).when(F.col("_telemetry"), ACTIVE).otherwise(IDLE),
        "firestore": F.when(session, DONE).otherwise(IDLE),
        "eventarc": moving,
        "bridge": moving,
        "agent": F.when(errored, FAILED).when(terminal, DONE).when(claimed, ACTIVE).otherwise(IDLE),
        "offer": F.when(F.col("_offer"), DONE).when(skipped, SKIPPED).otherwise(IDLE),
        "bigquery": F.when(F.col("_ordered"), DONE).when(ordered, ACTIVE).otherwise(IDLE),
    }
    details = {
        "client": F.when(F.col("_telemetry"), WITH_TELEMETRY).otherwise(LOGIN_ONLY),
        "firestore": F.when(ordered, ORDER_WRITTEN).when(session, SESSION_WRITTEN).otherwise(NO_LOGIN),
        "eventarc": F.coalesce(clock("event_time"), travelling),
        "bridge": F.coalesce(clock("bridge_received_at"), travelling),
        "agent": F.coalesce(null_if_empty(given("agent_worker_id")), F.lower(status), F.lit(IDLE)),
        "offer": F.when(F.col("_offer"), F.coalesce(F.concat(given("discount_percent").cast("string"), F.lit("%")), F.lit("")))
        .when(skipped, F.concat(F.lit("skipped: "), F.coalesce(given("skip_reason"), F.lit(NO_REASON)))).otherwise(PENDING),
        "bigquery": F.coalesce(null_if_empty(given("tables")), F.when(ordered, REPLICATING).otherwise(NO_ORDER)),
    }
    hops = F.array(*[
        F.struct(
            F.lit(hop).alias("hop"), states[hop].alias("state"),
            (F.col(ms) if ms in joined.columns else F.lit(None)).cast("double").alias("latency_ms"),
            details[hop].alias("detail"),
        )
        for hop, ms in HOP_MEASURES.items()
    ])
    return joined.select("session_id", F.explode(hops).alias("h")).select("session_id", "h.*")


# --- checks -----------------------------------------------------------------------


def new_offers_since(before: DataFrame, after: DataFrame) -> DataFrame:
    """Offers present now that were not there before."""
    return after.join(before.select("offer_id").distinct(), "offer_id", "left_anti")


def verify_outcomes(expected: DataFrame, sessions: DataFrame, new_offers: DataFrame) -> DataFrame:
    """Expected against actual offers per checked session.

    ``sessions`` are the finished check sessions (session_id, customer_id,
    offer_id); ``expected`` has customer_id and expect_offer.
    """
    got_new = new_offers.select("customer_id").distinct().withColumn("_new", F.lit(True))
    got = F.coalesce(F.col("_new"), F.lit(False)) | null_if_empty("offer_id").isNotNull()
    return (
        sessions.join(expected, "customer_id", "left")
        .join(got_new, "customer_id", "left")
        .withColumn("got_offer", got)
        .withColumn(
            "result",
            F.when(F.col("expect_offer").isNull(), "NO_EXPECTATION")
            .when(F.col("expect_offer") == F.col("got_offer"), "PASS")
            .otherwise("FAIL"),
        )
        .drop("_new")
    )
