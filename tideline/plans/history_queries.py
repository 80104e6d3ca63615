"""Registered queries: order history, rollups, pricing and catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions.scalars import stable_bucket, stable_hash
from tideline.operators import catalog as cat
from tideline.operators import history as hist
from tideline.operators import pricing as pr
from tideline.plans.fixtures import NOW
from tideline.plans.registry import query

# An independent row-by-row formulation: join every order to the earlier ones.
_HIST = """pairs AS (
  SELECT a.order_id, a.customer_id, a.account_age_days, a.created_at,
    cast(round(a.grand_total * 100) AS bigint) AS cents,
    b.created_at AS b_at, cast(round(b.grand_total * 100) AS bigint) AS b_cents, b.order_id AS b_id
  FROM fx_orders a LEFT JOIN fx_orders b ON b.customer_id = a.customer_id
    AND (b.created_at < a.created_at OR (b.created_at = a.created_at AND b.order_id < a.order_id))),
hist AS (
  SELECT order_id, customer_id, account_age_days, created_at, cents, count(b_id) AS n,
    max(b_at) AS last_at, min(b_at) AS first_at, coalesce(sum(b_cents), 0) AS s,
    coalesce(sum(b_cents) FILTER (WHERE b_at >= created_at - interval '90' day), 0) AS s90,
    count(b_id) FILTER (WHERE b_at >= created_at - interval '365' day) AS n365
  FROM pairs GROUP BY order_id, customer_id, account_age_days, created_at, cents)"""

_METRIC_SQL = {
    "order_sequence": "n + 1",
    "days_since_prior_order": "cast(CASE WHEN n > 0 THEN greatest((epoch_us(created_at) - epoch_us(last_at)) // 86400000000, 0) "
                              "ELSE least(account_age_days, 365) END AS bigint)",
    "prior_spend_90d": "cast(s90 AS double) / 100",
    "prior_orders_12m": "n365",
    "running_avg_order_value": "CASE WHEN n > 0 THEN cast((2 * s + n) // (2 * n) AS double) / 100 ELSE cast(cents AS double) / 100 END",
    "running_lifetime_spend": "cast(s + cents AS double) / 100",
    "purchase_frequency": "CASE WHEN n >= 2 THEN round(n / greatest(((epoch_us(created_at) - epoch_us(first_at)) // 86400000000) / 30.0e0, 1.0e0), 2) ELSE 0.0e0 END",
}


def _register_metric(metric: str, expression: str) -> None:
    @query(metric, f"WITH {_HIST} SELECT order_id, customer_id, {expression} AS {metric} FROM hist")
    def run(t):
        return hist.history_metric(t.fx_orders, metric)


for _name, _sql in _METRIC_SQL.items():
    _register_metric(_name, _sql)


_ALL_METRICS = ", ".join(f"{sql} AS {name}" for name, sql in _METRIC_SQL.items())


@query("order_history", f"WITH {_HIST} SELECT order_id, customer_id, {_ALL_METRICS} FROM hist")
def order_history(t):
    return hist.order_history(t.fx_orders)


@query("order_history_split_keys", f"WITH {_HIST} SELECT order_id, customer_id, {_ALL_METRICS} FROM hist")
def order_history_split_keys(t):
    """The same over orders dealt out anew, so that no order of the input helps."""
    return hist.order_history(t.fx_orders.repartition("order_key"))


_GAPS = """SELECT CASE WHEN order_key % 17 = 3 AND order_key % 13 <> 2 THEN NULL ELSE order_id END AS order_id, customer_id,
  CASE WHEN order_key % 13 = 2 THEN NULL ELSE created_at END AS created_at, account_age_days, grand_total, order_key FROM fx_orders
UNION ALL SELECT order_id, customer_id, created_at, account_age_days, grand_total, order_key FROM fx_orders WHERE order_key % 19 = 1 AND order_key % 17 <> 3 AND order_key % 13 <> 2"""


@query("order_history_gaps", f"""
WITH g AS ({_GAPS}),
s AS (SELECT *, cast(round(grand_total * 100) AS bigint) AS cents,
        row_number() OVER (PARTITION BY customer_id ORDER BY created_at NULLS FIRST, order_id NULLS FIRST) AS seq FROM g),
b AS (SELECT s.*, coalesce(sum(cents) OVER (PARTITION BY customer_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
SELECT b.order_id, b.customer_id, b.seq AS order_sequence, cast(b.before + b.cents AS double) / 100 AS running_lifetime_spend,
  CASE WHEN b.created_at IS NULL THEN 0.0e0 ELSE cast(b.before - (SELECT coalesce(sum(e.cents), 0) FROM s AS e WHERE e.customer_id = b.customer_id
    AND (e.created_at IS NULL OR e.created_at < b.created_at - interval '90' day)) AS double) / 100 END AS prior_spend_90d,
  CASE WHEN b.created_at IS NULL THEN 0 ELSE b.seq - 1 - (SELECT count(*) FROM s AS e WHERE e.customer_id = b.customer_id
    AND (e.created_at IS NULL OR e.created_at < b.created_at - interval '365' day)) END AS prior_orders_12m
FROM b""")
def order_history_gaps(t):
    """Orders without time, without id, and repeated ones keep all their rows."""
    return hist.order_history(t.sql(_GAPS)).select(
        "order_id", "customer_id", "order_sequence", "running_lifetime_spend", "prior_spend_90d", "prior_orders_12m")


@query("customer_rollup", f"""
SELECT customer_id, cast(sum(cast(round(grand_total * 100) AS bigint)) AS double) / 100 AS lifetime_spend,
  coalesce(cast(sum(cast(round(grand_total * 100) AS bigint)) FILTER (WHERE created_at >= timestamp '{NOW}' - interval '90' day) AS double) / 100, 0) AS total_spend_90d,
  count(*) AS orders_count, cast(max(created_at) AS varchar) AS last_order_at,
  cast(floor((epoch_us(timestamp '{NOW}') - epoch_us(max(created_at))) / 86400000000) AS bigint) AS days_since_last_purchase
FROM fx_orders GROUP BY customer_id""")
def customer_rollup(t):
    return hist.customer_rollup(t.fx_orders, NOW)


_ACUTE = "('REFUND_REQUESTED', 'LATE_DELIVERY', 'DEFECTIVE_COMPONENT', 'ESCALATION', 'BILLING_DISPUTE', 'DAMAGED_SHIPMENT')"
_COHORT_INPUT = """SELECT p.customer_id, p.customer_segment, n.orders_count,
    cast(p.order_key % 3 = 0 AS int) AS is_churned,
    CASE p.order_key % 5 WHEN 0 THEN 'ESCALATION' WHEN 1 THEN '' WHEN 2 THEN 'RMA_DELAY' ELSE NULL END AS recent_friction_event,
    CASE p.order_key % 4 WHEN 0 THEN 'LATE_DELIVERY' WHEN 1 THEN 'POOR_SUPPORT_RESPONSE' ELSE NULL END AS primary_complaint_reason
  FROM fx_profiles p JOIN (SELECT customer_id, count(*) AS orders_count FROM fx_orders GROUP BY customer_id) n
    ON n.customer_id = p.customer_id"""


@query("cohort_summary", f"""WITH c AS ({_COHORT_INPUT})
SELECT customer_segment, count(*) AS customers, cast(sum(orders_count) AS bigint) AS orders,
  count(*) FILTER (WHERE is_churned = 1) AS churned,
  count(*) FILTER (WHERE coalesce(nullif(recent_friction_event, ''), primary_complaint_reason) IN {_ACUTE}) AS acute_friction,
  count(*) - count(*) FILTER (WHERE is_churned = 1) AS retained,
  round(cast(count(*) FILTER (WHERE is_churned = 1) AS double) / count(*), 3) AS churn_rate,
  round(cast(count(*) FILTER (WHERE coalesce(nullif(recent_friction_event, ''), primary_complaint_reason) IN {_ACUTE}) AS double) / count(*), 3) AS acute_friction_rate
FROM c GROUP BY customer_segment""")
def cohort_summary(t):
    return hist.cohort_summary(t.sql(_COHORT_INPUT), by="customer_segment")


@query("acute_friction", f"""WITH c AS ({_COHORT_INPUT})
SELECT customer_id, coalesce(coalesce(nullif(recent_friction_event, ''), primary_complaint_reason) IN {_ACUTE}, false) AS acute FROM c""")
def acute_friction(t):
    return t.sql(_COHORT_INPUT).select(
        "customer_id",
        hist.acute_friction("recent_friction_event", "primary_complaint_reason").alias("acute"),
    )


@query("sentiment_band", """
SELECT order_id, rating, CASE WHEN rating >= 4 THEN 'POSITIVE' WHEN rating = 3 THEN 'NEUTRAL' ELSE 'NEGATIVE' END AS band,
  CASE WHEN rating >= 4 THEN 0.60e0 WHEN rating = 3 THEN -0.15e0 ELSE -0.95e0 END AS low,
  CASE WHEN rating >= 4 THEN 0.98e0 WHEN rating = 3 THEN 0.35e0 ELSE -0.40e0 END AS high
FROM fx_feedback""")
def sentiment_band(t):
    low, high = pr.sentiment_bounds("rating")
    return t.fx_feedback.select(
        "order_id", "rating", pr.sentiment_band("rating").alias("band"), low.alias("low"), high.alias("high")
    )


@query("complaint_flag", """
SELECT order_id, coalesce(feedback_rating <= 2, false) AS has_active_complaint,
  support_tickets_count + CASE WHEN feedback_rating <= 2 THEN 1 ELSE 0 END AS support_tickets_count,
  open_support_tickets_count + CASE WHEN feedback_rating <= 2 THEN 1 ELSE 0 END AS open_support_tickets_count,
  complaints_count + CASE WHEN feedback_rating <= 2 THEN 1 ELSE 0 END AS complaints_count
FROM fx_orders""")
def complaint_flag(t):
    return pr.with_complaint_counters(t.fx_orders, "feedback_rating").select(
        "order_id", "has_active_complaint", "support_tickets_count",
        "open_support_tickets_count", "complaints_count",
    )


_CART_OFFERS = """SELECT concat('cart_', lpad(concat(o_orderkey, ''), 10, '0')) AS cart_id,
    concat('off_', o_orderkey) AS offer_id, concat('PROMO', o_orderkey) AS promo_code,
    o_orderkey % 2 = 0 AS free_express_shipping,
    CASE WHEN o_orderkey % 35 = 0 THEN 'lots' ELSE concat(o_orderkey % 131 - 10, '') END AS discount_percent
  FROM orders WHERE o_orderkey % 5 < 2"""

_LINES = """lines AS (
  SELECT i.cart_id, i.order_key, i.sku, greatest(i.quantity, 1) AS q,
    coalesce(c.unit_price, i.unit_price, 100.0e0) AS p,
    coalesce(c.cost, coalesce(c.unit_price, i.unit_price, 100.0e0) * 0.6e0) AS cost
  FROM fx_line_items i LEFT JOIN fx_catalog c ON c.sku = i.sku)"""


def _money_sql(totals: str, cost: bool) -> str:
    margin = (", round((cast(grand_total - total_cost - tax_amount AS double)) / greatest(cast(grand_total AS double), 1.0e0), 3) AS profit_margin,"
              " cast(total_cost AS double) AS total_cost_out") if cost else ""
    return f"""offers_in AS ({_CART_OFFERS}), {totals},
rates AS (SELECT t.*, o.offer_id, o.promo_code, o.offer_id IS NOT NULL AS offer_applied,
    CASE WHEN o.offer_id IS NULL THEN 0 ELSE least(greatest(coalesce(try_cast(o.discount_percent AS bigint), 0), 0), 100) END AS pct,
    coalesce(o.free_express_shipping, false) AS free
  FROM totals t LEFT JOIN offers_in o ON o.cart_id = t.cart_id),
parts AS (SELECT *, cast(round(subtotal * cast('0.21' AS decimal(3,2)), 2) AS decimal(18,2)) AS tax_amount,
    cast(round(subtotal * cast(pct AS decimal(3,0)) * cast('0.01' AS decimal(3,2)), 2) AS decimal(18,2)) AS discount_total,
    cast(CASE WHEN free THEN 0 ELSE 45 END AS decimal(18,2)) AS shipping_fee FROM rates),
grand AS (SELECT *, subtotal - discount_total + tax_amount + shipping_fee AS grand_total FROM parts),
money AS (SELECT *{margin} FROM grand)"""


_ENGINE_TOTALS = """totals AS (SELECT cart_id, cast(sum(cast(round(q * p, 2) AS decimal(18,2))) AS decimal(18,2)) AS subtotal,
    cast(sum(cast(round(q * cost, 2) AS decimal(18,2))) AS decimal(18,2)) AS total_cost, cast(sum(q) AS bigint) AS units
  FROM lines GROUP BY cart_id)"""

_MONEY_OUT = """cast(subtotal AS double) AS subtotal, cast(tax_amount AS double) AS tax_amount,
  cast(discount_total AS double) AS discount_total, cast(shipping_fee AS double) AS shipping_fee,
  cast(grand_total AS double) AS grand_total"""


@query("order_financials", f"""WITH {_LINES}, {_money_sql(_ENGINE_TOTALS, True)}
SELECT cart_id, units, {_MONEY_OUT}, profit_margin, total_cost_out AS total_cost, offer_applied,
  offer_id, promo_code, cast(pct AS bigint) AS discount_percent, free AS free_express_shipping FROM money""")
def order_financials(t):
    return pr.order_financials(t.fx_line_items, t.fx_catalog, t.sql(_CART_OFFERS))


@query("priced_lines", f"""WITH {_LINES}
SELECT cart_id, sku, q AS quantity, p AS unit_price, round(q * p, 2) AS total_price, round(q * cost, 2) AS total_cost FROM lines""")
def priced_lines(t):
    return pr.priced_lines(t.fx_line_items, t.fx_catalog).select(
        "cart_id", "sku", "quantity", "unit_price", "total_price", "total_cost"
    )


@query("tier_discount_rate", """
SELECT order_id, CASE loyalty_tier WHEN 'ENTERPRISE_VIP' THEN 0.15e0 WHEN 'PLATINUM' THEN 0.12e0 WHEN 'GOLD' THEN 0.10e0
  WHEN 'SILVER' THEN 0.05e0 WHEN 'BRONZE' THEN 0.02e0 ELSE 0.0e0 END AS rate FROM fx_orders""")
def tier_discount_rate(t):
    return t.fx_orders.select("order_id", pr.tier_discount_rate("loyalty_tier").alias("rate"))


@query("offer_pricing", f"""WITH o AS ({_CART_OFFERS})
SELECT cart_id, offer_id, promo_code, free_express_shipping, true AS offer_applied,
  least(greatest(coalesce(try_cast(discount_percent AS bigint), 0), 0), 100) AS discount_percent FROM o""")
def offer_pricing(t):
    return pr.offer_pricing(t.sql(_CART_OFFERS))


@query("merge_cart_lines", """
SELECT cart_id, sku, cast(sum(quantity) AS bigint) AS quantity, max(unit_price) AS unit_price
FROM fx_line_items GROUP BY cart_id, sku""")
def merge_cart_lines(t):
    return pr.merge_cart_lines(t.fx_line_items)


_CART_TOTALS = """merged AS (SELECT cart_id, sku, sum(quantity) AS q, max(unit_price) AS p FROM fx_line_items GROUP BY cart_id, sku),
totals AS (SELECT cart_id, count(*) AS articles, cast(sum(q) AS bigint) AS units,
    coalesce(cast(sum(cast(round(p * q, 2) AS decimal(18,2))) AS decimal(18,2)), 0) AS subtotal FROM merged GROUP BY cart_id)"""


@query("cart_totals", f"""WITH {_money_sql(_CART_TOTALS, False)}
SELECT cart_id, articles, units, {_MONEY_OUT} FROM money""")
def cart_totals(t):
    return pr.cart_totals(t.fx_line_items, t.sql(_CART_OFFERS))


_APP_PREFIX = "ORD-000000"


@query("prior_app_orders", f"""
SELECT customer_id, count(*) FILTER (WHERE order_id LIKE '{_APP_PREFIX}1%') AS prior_app_orders
FROM fx_orders GROUP BY customer_id""")
def prior_app_orders(t):
    return pr.prior_app_orders(t.fx_orders, f"{_APP_PREFIX}1")


_RECOVERING = ["cust_0000000001", "cust_0000000004", "cust_0000000007", "cust_0000000010"]


@query("recovery_snapshot", f"""
WITH prior AS (SELECT customer_id, count(*) FILTER (WHERE order_id LIKE '{_APP_PREFIX}%') AS n FROM fx_orders GROUP BY customer_id),
x AS (SELECT o.*, coalesce(p.n >= 2 AND o.feedback_rating >= 4 AND o.customer_id IN
    ('cust_0000000001', 'cust_0000000004', 'cust_0000000007', 'cust_0000000010'), false) AS recovered
  FROM fx_orders o JOIN prior p ON p.customer_id = o.customer_id)
SELECT order_id, recovered, CASE WHEN recovered THEN 14 ELSE login_frequency_monthly END AS login_frequency_monthly,
  CASE WHEN recovered THEN 0.68e0 ELSE app_engagement_score END AS app_engagement_score,
  CASE WHEN recovered THEN 1 ELSE cart_abandonment_count END AS cart_abandonment_count,
  CASE WHEN recovered THEN 300.0e0 ELSE abandoned_cart_value_90d END AS abandoned_cart_value_90d,
  CASE WHEN recovered THEN 4.0e0 ELSE return_rate_percent END AS return_rate_percent FROM x""")
def recovery_snapshot(t):
    orders = t.fx_orders.withColumn("rating", F.col("feedback_rating"))
    joined = orders.join(pr.prior_app_orders(orders, _APP_PREFIX), "customer_id")
    return pr.recovery_snapshot(joined, _RECOVERING).select(
        "order_id", "recovered", "login_frequency_monthly", "app_engagement_score",
        "cart_abandonment_count", "abandoned_cart_value_90d", "return_rate_percent",
    )


_HEADERS = """SELECT concat('APP-', order_key) AS order_id, customer_id, created_at, feedback_rating AS rating,
    CASE order_key % 4 WHEN 0 THEN 'LATE_DELIVERY' ELSE 'RMA_DELAY' END AS complaint_reason,
    concat('text ', order_key) AS feedback_text,
    CASE WHEN order_key % 2 = 0 THEN 'NEXT_DAY_AIR' ELSE 'GROUND' END AS service_level,
    CASE WHEN order_key % 3 <> 0 THEN concat('PAY-', order_key % 3) END AS payment_method,
    CASE WHEN order_key % 5 = 0 THEN 'OWN_VAN' END AS carrier_code, CASE WHEN order_key % 7 = 0 THEN 'Lyon' END AS city,
    CASE WHEN order_key % 7 = 0 THEN 'FR' END AS country_code FROM fx_orders"""
_PROFILE_IN = """SELECT p.customer_id, o.customer_name, o.customer_email, p.customer_segment, p.loyalty_tier, p.account_age_days,
    r.total_spend_90d, r.lifetime_spend, r.orders_count_last_12m, o.login_frequency_monthly,
    o.support_tickets_count, o.open_support_tickets_count, o.complaints_count, o.return_rate_percent,
    o.is_loyalty_member, cast(o.order_key % 100 AS double) AS avg_order_value, cast(o.order_key % 9 AS double) AS purchase_frequency_monthly,
    o.order_key % 60 AS days_since_last_purchase, CASE WHEN o.order_key % 2 = 0 THEN 'WH-OWN' END AS default_warehouse,
    CASE WHEN o.order_key % 4 = 0 THEN 'Utrecht' END AS default_city
  FROM fx_profiles p JOIN fx_orders o ON o.order_key = p.order_key
  JOIN (SELECT customer_id, cast(count(*) AS double) AS total_spend_90d, cast(count(*) * 10 AS double) AS lifetime_spend,
          count(*) AS orders_count_last_12m FROM fx_orders GROUP BY customer_id) r ON r.customer_id = p.customer_id"""
_PRICE_TOTALS = _ENGINE_TOTALS


_SENTIMENT_LOW = "CASE WHEN rating >= 4 THEN 0.60e0 WHEN rating = 3 THEN -0.15e0 ELSE -0.95e0 END"
_SENTIMENT_HIGH = "CASE WHEN rating >= 4 THEN 0.98e0 WHEN rating = 3 THEN 0.35e0 ELSE -0.40e0 END"


def _fraction(label: str, key: str = "order_id") -> str:
    return f"(('0x' || substr(md5({key} || ':{label}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


@query("price_orders", f"""WITH {_LINES}, {_money_sql(_PRICE_TOTALS, True)}, headers AS ({_HEADERS}), prof AS ({_PROFILE_IN}),
prior AS (SELECT customer_id, count(*) FILTER (WHERE order_id LIKE '{_APP_PREFIX}%') AS n FROM fx_orders GROUP BY customer_id),
base AS (SELECT h.*, m.*, f.customer_name, f.customer_email, f.customer_segment, f.loyalty_tier, f.account_age_days,
    f.total_spend_90d, f.lifetime_spend AS old_lifetime, f.orders_count_last_12m AS old_orders,
    f.login_frequency_monthly AS lf, f.support_tickets_count AS st, f.open_support_tickets_count AS os,
    f.complaints_count AS cc, f.return_rate_percent AS rr, f.is_loyalty_member, f.avg_order_value, f.purchase_frequency_monthly,
    f.days_since_last_purchase, f.default_warehouse, f.default_city,
    coalesce(p.n >= 2 AND h.rating >= 4 AND h.customer_id IN
      ('cust_0000000001', 'cust_0000000004', 'cust_0000000007', 'cust_0000000010'), false) AS recovered,
    CASE WHEN h.rating <= 2 THEN 1 ELSE 0 END AS extra
  FROM headers h JOIN money m ON concat('APP-', cast(substring(m.cart_id, 6) AS bigint)) = h.order_id
  LEFT JOIN prof f ON f.customer_id = h.customer_id LEFT JOIN prior p ON p.customer_id = h.customer_id)
SELECT order_id, customer_id, customer_name, customer_email, customer_segment, 'PROCESSING' AS order_status,
  'SETTLED' AS payment_status, coalesce(payment_method, 'INVOICE_NET30') AS payment_method, 'EUR' AS currency, {_MONEY_OUT}, profit_margin, offer_applied, offer_id, promo_code,
  cast(pct AS bigint) AS discount_percent, free AS free_express_shipping, total_spend_90d,
  round(old_lifetime + cast(grand_total AS double), 2) AS lifetime_spend, old_orders + 1 AS orders_count_last_12m,
  avg_order_value, purchase_frequency_monthly, days_since_last_purchase, is_loyalty_member,
  round({_SENTIMENT_LOW} + ({_SENTIMENT_HIGH} - {_SENTIMENT_LOW}) * {_fraction('sentiment')}, 2) AS sentiment_score,
  'MOBILE_APP' AS feedback_channel, cast(created_at AS varchar) AS feedback_at, true AS require_signature,
  coalesce(carrier_code, (['DHL_EXPRESS', 'FEDEX_PRIORITY', 'UPS_EXPEDITED', 'POSTNL_CARGO'])[cast(floor({_fraction('carrier')} * 4) AS int) + 1]) AS carrier_code,
  coalesce(default_warehouse, (['WH-ROTTERDAM-1', 'WH-EEMSHAVEN-2', 'WH-EINDHOVEN-3', 'WH-FRANKFURT-1', 'WH-PARIS-2', 'WH-LONDON-1'])[cast(floor({_fraction('hub')} * 6) AS int) + 1]) AS origin_hub,
  'Industrial Ave 1' AS shipping_street_address, coalesce(city, default_city, 'Amsterdam') AS shipping_city, 'North Holland' AS shipping_province,
  '1016 BS' AS shipping_postal_code, coalesce(country_code, 'NL') AS shipping_country_code, cast(created_at AS varchar) AS updated_at,
  CASE WHEN recovered THEN 14 ELSE lf END AS login_frequency_monthly,
  CASE WHEN recovered THEN 1 ELSE st END + extra AS support_tickets_count,
  CASE WHEN recovered THEN 0 ELSE os END + extra AS open_support_tickets_count,
  CASE WHEN recovered THEN 0 ELSE cc END + extra AS complaints_count,
  CASE WHEN recovered THEN 4.0e0 ELSE rr END AS return_rate_percent, recovered, loyalty_tier, account_age_days, rating,
  CASE WHEN rating >= 4 THEN 'POSITIVE' WHEN rating = 3 THEN 'NEUTRAL' ELSE 'NEGATIVE' END AS sentiment_band,
  CASE WHEN rating >= 4 THEN 0.60e0 WHEN rating = 3 THEN -0.15e0 ELSE -0.95e0 END AS sentiment_low,
  CASE WHEN rating >= 4 THEN 0.98e0 WHEN rating = 3 THEN 0.35e0 ELSE -0.40e0 END AS sentiment_high,
  extra = 1 AS has_active_complaint, CASE WHEN extra = 1 THEN complaint_reason END AS primary_complaint_reason,
  feedback_text, service_level, cast(created_at AS varchar) AS created_at,
  cast(created_at + CASE WHEN service_level = 'NEXT_DAY_AIR' THEN interval '2' day ELSE interval '4' day END AS varchar) AS estimated_delivery_at
FROM base""")
def price_orders(t):
    key = F.concat(F.lit("APP-"), F.substring("cart_id", 6, 20).cast("bigint").cast("string"))
    items = t.fx_line_items.withColumn("order_id", key).drop("cart_id")
    offers = t.sql(_CART_OFFERS).withColumn("order_id", key).drop("cart_id")
    return pr.price_orders(
        t.sql(_HEADERS), items, t.fx_catalog, offers, t.sql(_PROFILE_IN), t.fx_orders,
        _RECOVERING, _APP_PREFIX,
    )


@query("allocated_lines", f"""SELECT cart_id, sku, quantity, CASE WHEN quantity % 3 = 0 THEN 'WH-LINE' ELSE
  (['WH-ROTTERDAM-1', 'WH-EEMSHAVEN-2', 'WH-EINDHOVEN-3', 'WH-FRANKFURT-1', 'WH-PARIS-2', 'WH-LONDON-1'])[cast(floor({_fraction('line', "concat_ws(':', cart_id, sku)")} * 6) AS int) + 1]
  END AS allocated_warehouse FROM fx_line_items""")
def allocated_lines(t):
    lines = t.fx_line_items.withColumn("allocated_warehouse", F.when(F.col("quantity") % 3 == 0, "WH-LINE"))
    return pr.allocated_lines(lines, key="cart_id").select("cart_id", "sku", "quantity", "allocated_warehouse")


@query("financial_consistency", f"""WITH {_LINES}, {_money_sql(_ENGINE_TOTALS, True)}
SELECT cart_id, cast(grand_total AS double) + 0.5e0 AS grand_total, cast(grand_total AS double) AS expected_total
FROM money WHERE units % 50 = 0""")
def financial_consistency(t):
    priced = pr.order_financials(t.fx_line_items, t.fx_catalog, t.sql(_CART_OFFERS))
    damaged = priced.withColumn(
        "grand_total",
        F.when(F.col("units") % 50 == 0, F.col("grand_total") + 0.5).otherwise(F.col("grand_total")),
    )
    return pr.financial_consistency(damaged).select("cart_id", "grand_total", "expected_total")


@query("list_orders", """
SELECT order_id, customer_id, cast(created_at AS varchar) AS created_at, grand_total FROM fx_orders
WHERE customer_id = 'cust_0000000001' ORDER BY created_at DESC, order_id DESC LIMIT 30""")
def list_orders(t):
    return cat.list_orders(t.fx_orders, "cust_0000000001").select(
        "order_id", "customer_id", "created_at", "grand_total"
    )


@query("newest_orders", """
SELECT order_id, customer_id, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY customer_id
  ORDER BY created_at DESC, order_id DESC) AS rn FROM fx_orders) q WHERE rn <= 5""")
def newest_orders(t):
    return cat.newest_orders(t.fx_orders, 5).select("order_id", "customer_id", "rank")


@query("catalog_search", """
SELECT sku, name, category, unit_price FROM fx_catalog
WHERE contains(lower(name), '1') OR contains(lower(sku), '1') OR contains(lower(category), '1')""")
def catalog_search(t):
    return cat.catalog_search(t.fx_catalog, "All", "1").select("sku", "name", "category", "unit_price")


@query("catalog_categories", "SELECT DISTINCT category FROM fx_catalog")
def catalog_categories(t):
    return cat.catalog_categories(t.fx_catalog)


@query("segment_for_tier", """
SELECT order_id, loyalty_tier, CASE loyalty_tier WHEN 'ENTERPRISE_VIP' THEN 'ENTERPRISE_VIP' WHEN 'PLATINUM' THEN 'RETAIL_PRO'
  WHEN 'GOLD' THEN 'RETAIL_PRO' WHEN 'SILVER' THEN 'STANDARD_LOYALTY' WHEN 'BRONZE' THEN 'STANDARD_LOYALTY'
  ELSE 'CASUAL_SHOPPER' END AS segment, loyalty_tier <> 'NONE' AS member FROM fx_orders""")
def segment_for_tier(t):
    return t.fx_orders.select(
        "order_id", "loyalty_tier", pr.segment_for_tier("loyalty_tier").alias("segment"),
        pr.is_member("loyalty_tier").alias("member"),
    )


@query("return_frequency", """
SELECT order_id, cast(floor(return_rate_percent / 4) AS bigint) AS return_frequency FROM fx_orders""")
def return_frequency(t):
    return t.fx_orders.select("order_id", pr.return_frequency("return_rate_percent").alias("return_frequency"))


@query("stable_hash", """
SELECT order_id, substring(sha256(concat_ws('|', customer_id, order_id, concat(order_key, ''))), 1, 16) AS digest,
  cast(concat('0x', substring(sha256(concat_ws('|', customer_id, order_id, concat(order_key, ''))), 1, 12)) AS bigint) % 5 AS fifth
FROM fx_orders""")
def stable_hash_query(t):
    parts = ("customer_id", "order_id", "order_key")
    return t.fx_orders.select(
        "order_id", stable_hash(*parts).alias("digest"), stable_bucket(5, *parts).alias("fifth")
    )


@query("schema_parity", """
SELECT 'customerFeedback.rating' AS path, 'number' AS left_kind, 'text' AS right_kind, 'different kind' AS problem FROM fx_orders
  WHERE feedback_rating IS NOT NULL GROUP BY 1
UNION ALL SELECT 'customerFeedback.sentiment_score', 'number', NULL, 'missing on the right' FROM fx_orders WHERE sentiment_score IS NOT NULL GROUP BY 1
UNION ALL SELECT 'logistics.legs[].to.zone', 'number', 'text', 'different kind' FROM fx_orders GROUP BY 1
UNION ALL SELECT 'logistics.legs[].to.stops[]', 'number', NULL, 'missing on the right' FROM fx_orders GROUP BY 1
UNION ALL SELECT 'note', 'text', CASE WHEN count(DISTINCT order_key % 2) = 2 THEN 'number|text' END, 'several kinds' FROM fx_orders""")
def schema_parity(t):
    """Field differences between seeded and app order documents."""
    orders = t.fx_orders
    sections = [
        F.col("order_id").alias("orderId"),
        F.struct("grand_total", "profit_margin").alias("financials"),
        F.struct(F.col("feedback_rating").alias("rating"), "sentiment_score").alias("customerFeedback"),
        F.array(F.struct(F.lit("s").alias("sku"), F.col("order_key").alias("quantity"))).alias("lineItems"),
    ]
    options = {"ignoreNullFields": "false"}

    def legs(zone, stops):
        return F.struct(F.array(F.struct(F.struct(zone.alias("zone"), stops.alias("stops")).alias("to"))).alias("legs")).alias("logistics")

    key, none = F.col("order_key"), F.array().cast("array<bigint>")
    text = F.concat(F.lit('"n'), key, F.lit('"}'))
    seeded = orders.select(F.to_json(F.struct(*sections, legs(key, F.array(key, key + 1))), options).alias("body")).select(
        F.concat(F.expr("substring(body, 1, length(body) - 1)"), F.lit(',"note":"x"}')).alias("body"))
    offer = F.struct(F.concat(F.lit("P"), "order_key").alias("promoCode")).alias("loyaltyOffer")
    rating_as_text = F.struct(F.col("feedback_rating").cast("string").alias("rating"))
    app = orders.select(
        F.to_json(
            F.struct(*sections[:2], rating_as_text.alias("customerFeedback"), sections[3], offer, legs(key.cast("string"), none)),
            options,
        ).alias("body"), "order_key",
    ).select(F.concat(
        F.expr("substring(body, 1, length(body) - 1)"), F.lit(',"note":'),
        F.when(key % 2 == 0, F.concat(key.cast("string"), F.lit("}"))).otherwise(text)).alias("body"))
    return cat.schema_parity(seeded, app)
