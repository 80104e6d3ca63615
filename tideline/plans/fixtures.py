"""Input views for the registered queries, derived from the given tables.

The text below is plain SQL that Spark and a checking engine both run as it is,
so a query and its check start from the same rows.  Every view reads a whole
table; non-order readings are arithmetic on the keys, with NULLs on purpose.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TODAY = "2001-08-01"
NOW = "2001-08-01 00:00:00"
CUTOFF = "2001-05-03"

BASE_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
]

_CUSTOMER_OF = "concat('cust_', lpad(concat({0}, ''), 10, '0'))"
_ORDER_OF = "concat('ORD-', lpad(concat({0}, ''), 10, '0'))"

FIXTURE_SQL: dict[str, str] = {
    "fx_orders": """
SELECT concat('ORD-', lpad(concat(o.o_orderkey, ''), 10, '0'))          AS order_id,
       concat('cust_', lpad(concat(o.o_custkey, ''), 10, '0'))          AS customer_id,
       c.c_name                                                         AS customer_name,
       concat(lower(replace(c.c_name, '#', '.')), '@example.test')      AS customer_email,
       CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 'ENTERPRISE_VIP' WHEN 'BUILDING' THEN 'RETAIL_PRO'
            WHEN 'FURNITURE' THEN 'STANDARD_LOYALTY' WHEN 'HOUSEHOLD' THEN 'CASUAL_SHOPPER'
            ELSE 'PLATINUM' END                                         AS customer_segment,
       CASE c.c_custkey % 6 WHEN 0 THEN 'NONE' WHEN 1 THEN 'BRONZE' WHEN 2 THEN 'SILVER'
            WHEN 3 THEN 'GOLD' WHEN 4 THEN 'PLATINUM' ELSE 'ENTERPRISE_VIP' END AS loyalty_tier,
       CASE WHEN c.c_custkey % 17 = 0 THEN NULL ELSE c.c_custkey % 6 <> 0 END AS is_loyalty_member,
       120 + c.c_custkey % 1781                                         AS account_age_days,
       CASE WHEN o.o_orderkey % 97 = 0 THEN NULL WHEN o.o_orderstatus = 'F' THEN 'DELIVERED'
            WHEN o.o_orderstatus = 'O' THEN 'SHIPPED' ELSE 'CANCELLED' END AS order_status,
       CASE WHEN o.o_orderstatus = 'P' THEN 'REFUNDED' ELSE 'SETTLED' END AS payment_status,
       o.o_totalprice                                                   AS grand_total,
       cast((o.o_orderkey * 37) % 60 - 5 AS double) / 100               AS profit_margin,
       cast(o.o_orderdate AS timestamp) + cast(o.o_orderkey % 86400 AS int) * interval '1' second AS created_at,
       (o.o_orderkey * 7) % 30                                          AS login_frequency_monthly,
       cast((o.o_orderkey * 13) % 180 AS double) / 10                   AS avg_session_duration_minutes,
       cast((o.o_orderkey * 11) % 100 AS double) / 100                  AS app_engagement_score,
       (o.o_orderkey * 3) % 10                                          AS cart_abandonment_count,
       cast((o.o_orderkey * 3) % 10 AS double) * 97.5e0                 AS abandoned_cart_value_90d,
       (o.o_orderkey * 5) % 8                                           AS support_tickets_count,
       least((o.o_orderkey * 5) % 8, o.o_orderkey % 3)                  AS open_support_tickets_count,
       o.o_orderkey % 4                                                 AS complaints_count,
       cast((o.o_orderkey * 17) % 250 AS double) / 10                   AS return_rate_percent,
       CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE 1 + o.o_orderkey % 5 END AS feedback_rating,
       CASE WHEN o.o_orderkey % 11 = 0 THEN NULL
            WHEN 1 + o.o_orderkey % 5 >= 4 THEN cast(60 + o.o_orderkey % 38 AS double) / 100
            WHEN 1 + o.o_orderkey % 5 = 3 THEN cast(o.o_orderkey % 50 - 15 AS double) / 100
            ELSE cast(o.o_orderkey % 55 - 95 AS double) / 100 END       AS sentiment_score,
       CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE 1 + o.o_orderkey % 5 <= 2 END AS has_active_complaint,
       o.o_orderkey                                                     AS order_key
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey""",
    "fx_offers": """
SELECT concat('off_', lpad(concat(o_orderkey, ''), 10, '0'))            AS offer_id,
       concat('cust_', lpad(concat(o_custkey, ''), 10, '0'))            AS customer_id,
       concat('sess_', o_orderkey)                                      AS session_id,
       CASE (o_orderkey * 7919) % 4 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'REDEEMED' WHEN 2 THEN 'EXPIRED' ELSE 'SUPERSEDED' END AS status,
       o_orderkey % 31 - 3                                              AS discount_percent,
       o_orderkey % 2 = 0                                               AS free_express_shipping,
       CASE WHEN o_orderkey % 15 = 0 THEN concat('ORD-', lpad(concat(o_orderkey, ''), 10, '0')) END AS order_id,
       concat('PROMO', o_orderkey)                                      AS promo_code,
       cast(o_orderdate AS timestamp) + cast(o_orderkey % 86400 AS int) * interval '1' second AS created_at,
       cast(o_orderdate AS timestamp) + interval '14' day               AS valid_until,
       cast(o_orderdate AS timestamp) + interval '7' day                AS cooldown_until
FROM orders""",
    # Offers moved close to the fixed clock, so that the seven-day gates are busy.
    "fx_fresh_offers": """
SELECT concat('off_', lpad(concat(o_orderkey, ''), 10, '0'))            AS offer_id,
       concat('cust_', lpad(concat(o_custkey, ''), 10, '0'))            AS customer_id,
       CASE (o_orderkey * 7919) % 6 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'EXPIRED' WHEN 2 THEN 'SUPERSEDED'
            ELSE 'REDEEMED' END                                         AS status,
       cast(timestamp '2001-08-01 00:00:00' AS timestamp)
         - cast((o_orderkey * 31) % 2400 AS int) * interval '1' hour     AS created_at,
       CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE
            cast(timestamp '2001-08-01 00:00:00' AS timestamp)
              - cast((o_orderkey * 31) % 2400 AS int) * interval '1' hour + interval '7' day END AS cooldown_until,
       cast(timestamp '2001-08-01 00:00:00' AS timestamp)
         - cast((o_orderkey * 31) % 2400 AS int) * interval '1' hour + interval '3' day AS valid_until
FROM orders""",
    "fx_logins": """
SELECT concat('sess_', lpad(concat(event_id, ''), 10, '0'))             AS session_id,
       CASE WHEN event_id % 53 = 0 THEN NULL ELSE concat('cust_', lpad(concat(user_id, ''), 10, '0')) END AS customer_id,
       CASE event_id % 7 WHEN 0 THEN 'PROCESSED' WHEN 1 THEN 'PROCESSING' WHEN 2 THEN NULL WHEN 3 THEN '' ELSE 'PENDING' END AS agent_processing_status,
       cast(ts AS timestamp) - interval '8218' day                      AS login_timestamp,
       event_id                                                         AS event_key
FROM events""",
    "fx_scores": """
SELECT concat('cust_', lpad(concat(c_custkey, ''), 10, '0'))            AS customer_id,
       CASE WHEN c_custkey % 41 = 0 THEN NULL ELSE cast((c_custkey * 7919) % 1000 AS double) / 1000 END AS churn_probability,
       CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN (c_custkey * 7919) % 1000 >= 800 THEN 'Critical'
            WHEN (c_custkey * 7919) % 1000 >= 600 THEN 'HIGH' WHEN (c_custkey * 7919) % 1000 >= 400 THEN 'MODERATE' ELSE 'LOW' END AS churn_risk_tier,
       CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 'RETAIL_PRO' END      AS customer_segment,
       cast((c_custkey * 31) % 9000 AS double)                          AS total_spend_90d,
       cast(c_custkey % 100 AS double) / 100                            AS sentiment_score,
       cast(timestamp '2001-07-20 03:00:00' AS timestamp)               AS calculation_timestamp
FROM customer WHERE c_custkey % 19 <> 0
UNION ALL
SELECT concat('cust_', lpad(concat(c_custkey, ''), 10, '0')), 0.99e0, 'CRITICAL', 'ENTERPRISE_VIP',
       1e0, 0.5e0, cast(timestamp '2001-07-01 03:00:00' AS timestamp)
FROM customer WHERE c_custkey % 3 = 0""",
    "fx_line_items": """
SELECT concat('cart_', lpad(concat(l.l_orderkey, ''), 10, '0'))         AS cart_id,
       CASE WHEN l.l_partkey % 29 = 0 THEN concat('SKU-X', l.l_partkey)
            ELSE concat('SKU-', l.l_partkey) END                        AS sku,
       cast(l.l_quantity AS int) - 2                                    AS quantity,
       CASE WHEN l.l_partkey % 58 = 0 THEN NULL
            ELSE cast(l.l_partkey % 500 AS double) + 0.25e0 END          AS unit_price,
       l.l_orderkey                                                     AS order_key
FROM lineitem l""",
    "fx_catalog": """
SELECT concat('SKU-', p_partkey)                                        AS sku,
       p_name                                                           AS name,
       p_brand                                                          AS category,
       p_retailprice                                                    AS unit_price,
       round(p_retailprice * 0.6e0, 2)                                  AS cost
FROM part""",
    # Newest order per customer, re-nested as a profile by the queries.
    "fx_profiles": """
SELECT customer_id, customer_segment, loyalty_tier, grand_total, profit_margin, sentiment_score,
       feedback_rating, has_active_complaint, order_key, account_age_days
FROM (SELECT f.*, row_number() OVER (PARTITION BY customer_id ORDER BY created_at DESC, order_id DESC) AS rn
      FROM fx_orders f) ranked
WHERE rn = 1""",
    "fx_feedback": """
SELECT order_id, customer_id, created_at, feedback_rating AS rating,
       CASE order_key % 4 WHEN 0 THEN 'LATE_DELIVERY' WHEN 1 THEN 'DEFECTIVE_COMPONENT'
            WHEN 2 THEN 'RMA_DELAY' ELSE NULL END                       AS reason,
       concat('note ', order_key)                                       AS comment,
       CASE WHEN order_key % 13 = 0 THEN NULL ELSE
            cast(timestamp '2001-07-20 03:00:00' AS timestamp)
              + cast((order_key * 17) % 4000 - 2000 AS int) * interval '1' minute END AS feedback_at
FROM fx_orders""",
    "fx_verdicts": """
SELECT session_id, event_key % 3 = 0 AS escalate,
       concat('  verdict   for ', session_id, '  ')                     AS reasoning
FROM fx_logins WHERE event_key % 3 <> 2""",
    "fx_copy": """
SELECT session_id, concat('Offer ', event_key) AS title,
       CASE WHEN event_key % 10 = 0 THEN NULL WHEN event_key % 10 = 5 THEN 'lots' ELSE concat(event_key % 40, '') END AS discount_percent
FROM fx_logins WHERE event_key % 5 < 2""",
    "fx_claims": """
SELECT concat('clm_', lpad(concat(l_orderkey, ''), 10, '0'), '_', l_linenumber) AS claim_id,
       concat('off_', lpad(concat(l_orderkey - l_orderkey % 5 + CASE WHEN l_linenumber = 5 THEN 1 ELSE 0 END, ''), 10, '0')) AS offer_id,
       CASE WHEN (l_orderkey + l_linenumber) % 3 = 0 THEN NULL
            ELSE concat('ORD-', lpad(concat(l_orderkey, ''), 10, '0')) END AS order_id,
       cast(l_shipdate AS timestamp)                                    AS claimed_at
FROM lineitem""",
    "fx_telemetry": """
SELECT concat('sess_', user_id)                                         AS session_id,
       event_type                                                       AS measure,
       CASE WHEN event_type = 'error' THEN NULL ELSE value END          AS value,
       cast(ts AS timestamp)                                            AS recorded_at,
       event_id                                                         AS event_key
FROM events""",
    # Three writers send partial traces for a session.
    "fx_traces": """
SELECT concat('sess_', lpad(concat(event_id - event_id % 3, ''), 10, '0')) AS session_id,
       CASE event_id % 3 WHEN 0 THEN 'RECEIVED' WHEN 1 THEN 'AGENT' ELSE 'RETURNED' END AS part,
       CASE WHEN event_id % 3 = 0 THEN value END                        AS delivery_ms,
       CASE WHEN event_id % 3 = 1 AND event_id % 12 <> 1 THEN value * 2 END AS agent_claim_ms,
       CASE WHEN event_id % 3 = 2 THEN value * 3 END                    AS agent_call_ms,
       CASE WHEN event_id % 3 = 2 THEN CASE WHEN event_id % 11 = 0 THEN 'AGENT_ERROR' ELSE 'RETURNED' END
            WHEN event_id % 3 = 0 THEN 'DISPATCHED' END                 AS bridge_status,
       cast(ts AS timestamp)                                            AS recorded_at,
       event_id                                                         AS event_key
FROM events""",
}


def _dependencies(sql: str) -> list[str]:
    return [name for name in FIXTURE_SQL if re.search(rf"\b{name}\b", sql)]


def needed_fixtures(sql: str) -> list[str]:
    """Names of the views a query text needs, dependencies first."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for inner in _dependencies(FIXTURE_SQL[name]):
            visit(inner)
        if name not in ordered:
            ordered.append(name)

    for name in _dependencies(sql):
        visit(name)
    return ordered


def with_fixtures(sql: str) -> str:
    """Prefix a statement with the views it reads, as common table expressions."""
    names = needed_fixtures(sql)
    body = sql.strip()
    if not names:
        return body
    ctes = ",\n".join(f"{name} AS ({FIXTURE_SQL[name]})" for name in names)
    for opening in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(opening):
            return f"{opening}{ctes},\n{body[len(opening):]}"
    return f"WITH {ctes}\n{body}"


class Tables:
    """The given tables of one folder, and the views derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str, dealt: dict[str, list[str]] | None = None,
                 portions: dict[str, str] | None = None):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._dealt = dealt or {}
        self._portions = portions or {}

    def dealt(self, name: str, *by: str) -> Tables:
        """The same tables, one of them dealt out anew by its columns before any view widens it."""
        return Tables(self.spark, self.sf_dir, {**self._dealt, name: list(by)}, self._portions)

    def order_portion(self, number: int, of: int) -> Tables:
        """The same tables, with one of several portions of the orders.

        Rows with the same order id, also those without one, are in the same portion.
        """
        mine = f"pmod(xxhash64({_ORDER_OF.format('o_orderkey')}), {of}) = {number}"
        return Tables(self.spark, self.sf_dir, self._dealt, {**self._portions, "orders": mine})

    def raw(self, name: str) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name in self._portions:
            rows = rows.where(self._portions[name])
        return rows.repartition(*self._dealt[name]) if name in self._dealt else rows

    def sql(self, statement: str) -> DataFrame:
        for name in BASE_TABLES:
            if re.search(rf"\b(FROM|JOIN)\s+{name}\b", with_fixtures(statement)):
                self.raw(name).createOrReplaceTempView(name)
        return self.spark.sql(with_fixtures(statement))

    def __getattr__(self, name: str) -> DataFrame:
        if name in FIXTURE_SQL:
            return self.sql(f"SELECT * FROM {name}")
        raise AttributeError(name)
