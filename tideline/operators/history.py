"""Per-order history metrics, looking only at the customer's earlier orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.scalars import as_col, exact_money

DAY_MICROS = 86_400_000_000
SPEND_WINDOW_DAYS = 90
YEAR_DAYS = 365
# Spark's number of shuffle partitions, and the tasks of a scan where no more are named.
DEFAULT_PARTITIONS = 200
SCAN_TASKS = 64

_INPUT = ["order_id", "customer_id", "created_at", "account_age_days", "grand_total"]

METRICS = [
    "order_sequence", "days_since_prior_order", "prior_spend_90d", "prior_orders_12m",
    "running_avg_order_value", "running_lifetime_spend", "purchase_frequency",
]


def _prepare(orders: DataFrame) -> DataFrame:
    """The columns needed; an order without a customer has no history to measure."""
    return orders.where(F.col("customer_id").isNotNull()).select(
        *_INPUT,
        F.unix_micros("created_at").alias("_at"),
        exact_money("grand_total").alias("_total"),
    )


# The day of rows without a time, which come first.
_NO_DAY = -(2**40)


def _day_of(micros: Column | str) -> Column:
    return F.coalesce(F.floor(as_col(micros) / DAY_MICROS), F.lit(_NO_DAY))


def _scan_dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out for an ordered scan over a number of tasks that is not lowered.

    Left to itself, Spark merges partitions until there is one for each core, and what a
    task sorts in memory grows with the input.  Where the session names more partitions
    than Spark does by default, it has sized them for its input.
    """
    named = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(named if named > DEFAULT_PARTITIONS else SCAN_TASKS, *keys)


def _positions(rows: DataFrame) -> DataFrame:
    """Position and running totals of each order, with every customer split by day.

    Totals older than a moving edge are answered by probe rows placed at the
    edge (order time minus the window) into the same day-split scan.  They depend
    on customer and time alone, so that is what they are matched by, and no row
    needs an id.  Orders without a time come first and are older than any edge.
    Days are added up where their orders have been dealt to: few orders share a day, so
    adding up before would hold about all of them in a hash table.
    """
    inside = Window.partitionBy("customer_id", "_day").orderBy("_at", "order_id")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    dated = _scan_dealt(rows.withColumn("_day", _day_of("_at")), "customer_id", "_day")
    scanned = dated.withColumns(
        {
            "_in_count": F.row_number().over(inside).cast("bigint") - 1,
            "_in_total": F.sum("_total").over(before),
            "_in_previous": F.lag("_at").over(inside),
            "_in_first": F.min("_at").over(before),
        }
    )
    per_day = dated.groupBy("customer_id", "_day").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum("_total").alias("_t"),
        F.min("_at").alias("_min"),
        F.max("_at").alias("_max"),
    )
    days = Window.partitionBy("customer_id").orderBy("_day")
    earlier_days = days.rowsBetween(Window.unboundedPreceding, -1)
    carried = _scan_dealt(per_day, "customer_id").select(
        "customer_id", "_day",
        F.sum("_n").over(earlier_days).alias("_off_count"),
        F.sum("_t").over(earlier_days).alias("_off_total"),
        F.lag("_max").over(days).alias("_off_previous"),
        F.min("_min").over(earlier_days).alias("_off_first"),
    )
    zero = F.lit(0)
    positions = scanned.join(carried, ["customer_id", "_day"]).select(
        *rows.columns,
        (F.col("_in_count") + F.coalesce("_off_count", zero)).alias("_earlier"),
        (F.coalesce("_in_total", zero) + F.coalesce("_off_total", zero)).alias("_earlier_total"),
        F.coalesce("_in_previous", "_off_previous").alias("_previous_at"),
        F.coalesce("_off_first", "_in_first").alias("_first_at"),
    )
    # Every order meets the answers of its customer and time.
    both = _scan_dealt(
        positions.unionByName(_totals_before_edges(rows), allowMissingColumns=True), "customer_id", "_at")
    same = Window.partitionBy("customer_id", "_at")

    def answer(span: int, value: str, timeless: str) -> Column:
        found = F.max(F.when(F.col("_span") == span, F.col(value))).over(same)
        return F.when(F.col("_at").isNull(), F.col(timeless)).otherwise(found)

    return both.withColumns({
        "_total_beyond_90d": answer(SPEND_WINDOW_DAYS, "_sum", "_earlier_total"),
        "_count_beyond_365d": answer(YEAR_DAYS, "_count", "_earlier"),
    }).where("_span IS NULL").drop("_span", "_sum", "_count")


def _totals_before_edges(rows: DataFrame) -> DataFrame:
    """Of each order's customer and time: total and count beyond 90 and 365 days."""
    def row(t: Column, kind: int, at: Column, span: int, value: Column, n: int) -> Column:
        return F.struct(
            t.alias("_t"), F.lit(kind).alias("_kind"), at.alias("_at"), F.lit(span).alias("_span"),
            value.alias("_v"), F.lit(n).cast("bigint").alias("_n"))

    at, nothing = F.col("_at"), F.lit(0).cast("decimal(18,2)")
    # A probe sorts before the orders of the same instant: strictly older.
    probes = [
        F.when(at.isNotNull(), row(at - F.lit(span).cast("bigint") * DAY_MICROS, 0, at, span, nothing, 0))
        for span in (SPEND_WINDOW_DAYS, YEAR_DAYS)
    ]
    order = row(at, 1, F.lit(None).cast("bigint"), 0, F.col("_total"), 1)
    mixed = rows.select("customer_id", F.explode(F.array(order, *probes)).alias("_row")).where(
        "_row IS NOT NULL").select("customer_id", "_row.*").withColumn("_day", _day_of("_t"))
    inside = Window.partitionBy("customer_id", "_day").orderBy("_t", "_kind")
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dealt = _scan_dealt(mixed, "customer_id", "_day")
    scanned = dealt.withColumns({"_in_v": F.sum("_v").over(so_far), "_in_n": F.sum("_n").over(so_far)})
    per_day = dealt.groupBy("customer_id", "_day").agg(F.sum("_v").alias("_dv"), F.sum("_n").alias("_dn"))
    earlier = (
        Window.partitionBy("customer_id").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = _scan_dealt(per_day, "customer_id").select(
        "customer_id", "_day",
        F.sum("_dv").over(earlier).alias("_off_v"), F.sum("_dn").over(earlier).alias("_off_n"),
    )
    zero = F.lit(0)
    return scanned.where("_kind = 0").join(carried, ["customer_id", "_day"]).select(
        "customer_id", "_at", "_span",
        (F.col("_in_v") + F.coalesce("_off_v", zero)).alias("_sum"),
        (F.col("_in_n") + F.coalesce("_off_n", zero)).alias("_count"),
    )


def _whole_days(later: Column | str, earlier: Column | str) -> Column:
    return F.floor((as_col(later) - as_col(earlier)) / DAY_MICROS).cast("bigint")


def _metrics(positions: DataFrame) -> DataFrame:
    n = F.col("_earlier")
    has_history = n > 0
    zero = F.lit(0)
    earlier_total = F.coalesce("_earlier_total", zero)
    total = F.col("_total")
    months = F.greatest(_whole_days("_at", "_first_at") / 30.0, F.lit(1.0))
    return positions.select(
        "order_id",
        "customer_id",
        (n + 1).alias("order_sequence"),
        F.when(
            has_history, F.greatest(_whole_days("_at", "_previous_at"), F.lit(0).cast("bigint"))
        ).otherwise(F.least(F.col("account_age_days").cast("bigint"), F.lit(YEAR_DAYS).cast("bigint")))
        .alias("days_since_prior_order"),
        (earlier_total - F.coalesce("_total_beyond_90d", zero)).cast("double").alias("prior_spend_90d"),
        (n - F.coalesce("_count_beyond_365d", zero)).alias("prior_orders_12m"),
        F.when(has_history, F.round(earlier_total / n, 2)).otherwise(total).cast("double")
        .alias("running_avg_order_value"),
        (earlier_total + total).cast("double").alias("running_lifetime_spend"),
        F.when(n >= 2, F.round(n / months, 2)).otherwise(F.lit(0.0)).alias("purchase_frequency"),
    )


def order_history(orders: DataFrame) -> DataFrame:
    """All seven metrics, one row per order that has a customer.

    Ties of time go by order id, NULLs first; repeated orders are orders of their own.
    """
    return _metrics(_positions(_prepare(orders)))


def history_metric(orders: DataFrame, metric: str) -> DataFrame:
    """One of the metrics by name."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; expected one of {', '.join(METRICS)}")
    return order_history(orders).select("order_id", "customer_id", metric)


def customer_rollup(orders: DataFrame, now: str) -> DataFrame:
    """Lifetime and 90-day spend (the low edge counts), order count, recency."""
    at = F.lit(now).cast("timestamp")
    edge = at - F.expr(f"INTERVAL '{SPEND_WINDOW_DAYS}' DAY")
    total = exact_money("grand_total")
    return (
        orders.groupBy("customer_id")
        .agg(
            F.sum(total).cast("double").alias("lifetime_spend"),
            F.coalesce(F.sum(F.when(F.col("created_at") >= edge, total)), F.lit(0))
            .cast("double").alias("total_spend_90d"),
            F.count(F.lit(1)).alias("orders_count"),
            F.max("created_at").alias("last_order_at"),
        )
        .withColumn(
            "days_since_last_purchase",
            F.floor((F.unix_micros(at) - F.unix_micros("last_order_at")) / DAY_MICROS).cast("bigint"),
        )
    )


# Complaint reasons that count as acute.
ACUTE_FRICTION_EVENTS = [
    "REFUND_REQUESTED", "LATE_DELIVERY", "DEFECTIVE_COMPONENT", "ESCALATION",
    "BILLING_DISPUTE", "DAMAGED_SHIPMENT",
]


def acute_friction(recent_event: Column | str, complaint_reason: Column | str) -> Column:
    """Whether the newest event, or else the standing reason, is an acute one."""
    grievance = F.coalesce(
        F.nullif(as_col(recent_event), F.lit("")), as_col(complaint_reason)
    )
    return F.coalesce(grievance.isin(ACUTE_FRICTION_EVENTS), F.lit(False))


def cohort_summary(customers: DataFrame, by: str | None = None) -> DataFrame:
    """Customers, orders, churn and friction shares, overall or per ``by``.

    Expects ``orders_count``, ``is_churned`` (0/1), ``recent_friction_event``
    and ``primary_complaint_reason``.
    """
    acute = acute_friction("recent_friction_event", "primary_complaint_reason")
    n = F.greatest(F.col("customers"), F.lit(1))
    groups = [by] if by else []
    return (
        customers.groupBy(*groups)
        .agg(
            F.count(F.lit(1)).alias("customers"),
            F.coalesce(F.sum("orders_count"), F.lit(0)).alias("orders"),
            F.count_if(F.col("is_churned") == 1).alias("churned"),
            F.count_if(acute).alias("acute_friction"),
        )
        .withColumn("retained", F.col("customers") - F.col("churned"))
        .withColumn("churn_rate", F.round(F.col("churned") / n, 3))
        .withColumn("acute_friction_rate", F.round(F.col("acute_friction") / n, 3))
    )
