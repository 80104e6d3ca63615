"""Registered queries: churn features, labels, model and scoring."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tideline.functions.scalars import safe_divide
from tideline.operators import features as ft
from tideline.operators import model as ml
from tideline.operators import scoring as sc
from tideline.plans.churn_run import ChurnStore, run_churn_pipeline, run_report
from tideline.plans.fixtures import CUTOFF, NOW, TODAY
from tideline.plans.registry import query
from tideline.session import work_dir
from tideline.sources import snapshots

_FACTS = """facts AS (
  SELECT *, cast(created_at AS date) AS order_date FROM fx_orders
  WHERE customer_id IS NOT NULL AND created_at IS NOT NULL
    AND coalesce(order_status, '') <> 'CANCELLED')"""


def _agg(as_of: str) -> str:
    day = f"date '{as_of}'"

    def after(n: int) -> str:
        return f"order_date > {day} - interval '{n}' day"

    prior = f"order_date <= {day} - interval '90' day AND {after(180)}"
    return f"""aggs AS (
  SELECT customer_id, count(*) AS orders_lifetime, sum(grand_total) AS spend_lifetime,
    avg(grand_total) AS avg_order_value, stddev_samp(grand_total) AS stddev_order_value,
    min(order_date) AS first_order_date, max(order_date) AS last_order_date,
    avg(profit_margin) AS avg_profit_margin,
    count(*) FILTER (WHERE {after(90)}) AS orders_90d,
    count(*) FILTER (WHERE {after(180)}) AS orders_180d,
    count(*) FILTER (WHERE {after(365)}) AS orders_365d,
    coalesce(sum(grand_total) FILTER (WHERE {after(90)}), 0) AS spend_90d,
    coalesce(sum(grand_total) FILTER (WHERE {after(365)}), 0) AS spend_365d,
    coalesce(sum(grand_total) FILTER (WHERE {prior}), 0) AS spend_prior_90d,
    count(*) FILTER (WHERE {prior}) AS orders_prior_90d,
    avg(sentiment_score) FILTER (WHERE {after(180)}) AS avg_sentiment_180d,
    avg(feedback_rating) FILTER (WHERE {after(180)}) AS avg_rating_180d,
    count(*) FILTER (WHERE has_active_complaint) AS complaint_orders_lifetime
  FROM facts WHERE order_date <= {day} GROUP BY customer_id)"""


def _latest(as_of: str) -> str:
    return f"""latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_id
      ORDER BY created_at DESC, order_id DESC) AS rn FROM facts WHERE order_date <= date '{as_of}') q
  WHERE rn = 1)"""


def _ratios(as_of: str) -> str:
    day = f"date '{as_of}'"
    cadence = ("cast(datediff('day', first_order_date, last_order_date) AS double)"
               " / nullif(orders_lifetime - 1, 0)")
    return f"""ratios AS (
  SELECT aggs.*, datediff('day', last_order_date, {day}) AS days_since_last_purchase,
    datediff('day', first_order_date, {day}) AS tenure_days,
    {cadence} AS avg_interpurchase_days,
    cast(datediff('day', last_order_date, {day}) AS double) / nullif({cadence}, 0) AS recency_vs_cadence,
    cast(spend_90d AS double) / nullif(spend_prior_90d, 0) AS spend_trend_ratio,
    cast(orders_90d AS double) / nullif(orders_prior_90d, 0) AS order_trend_ratio
  FROM aggs)"""


_FEATURE_SELECT = """
  r.customer_id, l.customer_name, l.customer_email, l.customer_segment, l.loyalty_tier,
  coalesce(l.is_loyalty_member, false) AS is_loyalty_member, l.account_age_days,
  r.days_since_last_purchase, r.tenure_days, r.orders_lifetime, r.orders_90d, r.orders_180d,
  r.orders_365d, round(r.spend_lifetime, 6) AS spend_lifetime, round(r.spend_90d, 6) AS spend_90d,
  round(r.spend_365d, 6) AS spend_365d, round(r.avg_order_value, 6) AS avg_order_value,
  round(coalesce(r.stddev_order_value, 0.0), 6) AS stddev_order_value,
  round(r.avg_profit_margin, 6) AS avg_profit_margin,
  round(r.avg_interpurchase_days, 6) AS avg_interpurchase_days,
  round(r.recency_vs_cadence, 6) AS recency_vs_cadence,
  round(r.spend_trend_ratio, 6) AS spend_trend_ratio,
  round(r.order_trend_ratio, 6) AS order_trend_ratio, l.login_frequency_monthly,
  l.avg_session_duration_minutes, l.app_engagement_score, l.cart_abandonment_count,
  l.abandoned_cart_value_90d, l.support_tickets_count, l.open_support_tickets_count,
  l.complaints_count, l.return_rate_percent, round(r.avg_sentiment_180d, 6) AS sentiment_score,
  round(r.avg_rating_180d, 6) AS avg_rating_180d, r.complaint_orders_lifetime"""


def _features_cte(as_of: str) -> str:
    return (f"{_FACTS}, {_agg(as_of)}, {_latest(as_of)}, {_ratios(as_of)}, feats AS (SELECT "
            f"{_FEATURE_SELECT}, '{as_of}' AS feature_as_of_date "
            "FROM ratios r JOIN latest l ON l.customer_id = r.customer_id)")


_LABELS = f"""labelled AS (
  SELECT customer_id,
    cast(CASE WHEN count(*) FILTER (WHERE order_date > date '{CUTOFF}'
      AND order_date <= date '{CUTOFF}' + interval '90' day) > 0 THEN 0 ELSE 1 END AS bigint) AS is_churned,
    count(*) FILTER (WHERE order_date > date '{CUTOFF}'
      AND order_date <= date '{CUTOFF}' + interval '90' day) AS orders_in_horizon
  FROM facts GROUP BY customer_id
  HAVING count(*) FILTER (WHERE order_date <= date '{CUTOFF}') > 0)"""

_FACT_SELECT = """customer_id, order_id, cast(order_date AS varchar) AS order_date,
  cast(created_at AS varchar) AS created_at, customer_name, customer_email, customer_segment,
  loyalty_tier, is_loyalty_member, account_age_days, order_status, payment_status, grand_total,
  profit_margin, login_frequency_monthly, avg_session_duration_minutes, app_engagement_score,
  cart_abandonment_count, abandoned_cart_value_90d, support_tickets_count,
  open_support_tickets_count, complaints_count, return_rate_percent, sentiment_score,
  has_active_complaint, feedback_rating"""


@query("order_facts", f"WITH {_FACTS} SELECT {_FACT_SELECT} FROM facts")
def order_facts(t):
    return ft.order_facts(t.fx_orders)


@query("visible_orders",
       f"WITH {_FACTS} SELECT {_FACT_SELECT} FROM facts WHERE order_date <= date '{CUTOFF}'")
def visible_orders(t):
    return ft.visible_orders(ft.order_facts(t.fx_orders), CUTOFF)


@query("latest_order", f"WITH {_FACTS}, {_latest(CUTOFF)} SELECT {_FACT_SELECT} FROM latest")
def latest_order(t):
    return ft.latest_order(ft.order_facts(t.fx_orders), CUTOFF)


_AGG_SELECT = """customer_id, orders_lifetime, round(spend_lifetime, 6) AS spend_lifetime,
  round(avg_order_value, 6) AS avg_order_value, round(stddev_order_value, 6) AS stddev_order_value,
  cast(first_order_date AS varchar) AS first_order_date,
  cast(last_order_date AS varchar) AS last_order_date,
  round(avg_profit_margin, 6) AS avg_profit_margin, orders_90d, orders_180d, orders_365d,
  round(spend_90d, 6) AS spend_90d, round(spend_365d, 6) AS spend_365d,
  round(spend_prior_90d, 6) AS spend_prior_90d, orders_prior_90d,
  round(avg_sentiment_180d, 6) AS avg_sentiment_180d, round(avg_rating_180d, 6) AS avg_rating_180d,
  complaint_orders_lifetime"""


@query("order_aggregates", f"WITH {_FACTS}, {_agg(CUTOFF)} SELECT {_AGG_SELECT} FROM aggs")
def order_aggregates(t):
    return ft.order_aggregates(ft.order_facts(t.fx_orders), CUTOFF)


@query("rfm_ratios",
       f"WITH {_FACTS}, {_agg(CUTOFF)}, {_ratios(CUTOFF)} SELECT customer_id, "
       "days_since_last_purchase, tenure_days, round(avg_interpurchase_days, 6) AS avg_interpurchase_days, "
       "round(recency_vs_cadence, 6) AS recency_vs_cadence, round(spend_trend_ratio, 6) AS spend_trend_ratio, "
       "round(order_trend_ratio, 6) AS order_trend_ratio FROM ratios")
def rfm_ratios(t):
    aggregates = ft.order_aggregates(ft.order_facts(t.fx_orders), CUTOFF)
    return ft.rfm_ratios(aggregates, CUTOFF).select(
        "customer_id", "days_since_last_purchase", "tenure_days", "avg_interpurchase_days",
        "recency_vs_cadence", "spend_trend_ratio", "order_trend_ratio",
    )


@query("safe_divide", """
SELECT order_id, round(cast(support_tickets_count AS double) / nullif(complaints_count, 0), 6) AS tickets_per_complaint,
  round(cast(grand_total AS double) / nullif(feedback_rating, 0), 6) AS total_per_star
FROM fx_orders""")
def safe_divide_query(t):
    return t.fx_orders.select(
        "order_id",
        safe_divide("support_tickets_count", "complaints_count").alias("tickets_per_complaint"),
        safe_divide("grand_total", "feedback_rating").alias("total_per_star"),
    )


@query("customer_features", f"WITH {_features_cte(TODAY)} SELECT * FROM feats")
def customer_features(t):
    return ft.customer_features(ft.order_facts(t.fx_orders), TODAY)


@query("live_features",
       f"WITH {_features_cte(TODAY)} SELECT customer_id, days_since_last_purchase, spend_90d, "
       "orders_lifetime, sentiment_score, feature_as_of_date FROM feats")
def live_features(t):
    return ft.live_features(ft.order_facts(t.fx_orders), TODAY).select(
        "customer_id", "days_since_last_purchase", "spend_90d", "orders_lifetime",
        "sentiment_score", "feature_as_of_date",
    )


@query("churn_labels", f"WITH {_FACTS}, {_LABELS} SELECT * FROM labelled")
def churn_labels(t):
    return ft.churn_labels(ft.order_facts(t.fx_orders), CUTOFF)


@query("churn_labels_sql_function", f"WITH {_FACTS}, {_LABELS} SELECT * FROM labelled")
def churn_labels_sql_function(t):
    ft.order_facts(t.fx_orders).createOrReplaceTempView("order_facts_view")
    for statement in ft.order_table_functions("order_facts_view"):
        t.spark.sql(statement)
    return t.spark.sql(f"SELECT * FROM churn_labels_at(DATE'{CUTOFF}', 90)")


@query("training_set",
       f"WITH {_features_cte(CUTOFF)}, {_LABELS} SELECT feats.*, labelled.is_churned, "
       "labelled.orders_in_horizon FROM feats JOIN labelled ON labelled.customer_id = feats.customer_id")
def training_set(t):
    return ft.training_set(ft.order_facts(t.fx_orders), TODAY)


@query("class_weights", f"""WITH {_FACTS}, {_LABELS}
SELECT is_churned, count(*) AS customers,
  round(cast((SELECT count(*) FROM labelled) AS double)
    / ((SELECT count(DISTINCT is_churned) FROM labelled) * count(*)), 6) AS class_weight
FROM labelled GROUP BY is_churned""")
def class_weights(t):
    return ml.class_weights(ft.churn_labels(ft.order_facts(t.fx_orders), CUTOFF))


def _trained(t):
    training = ft.training_set(ft.order_facts(t.fx_orders), TODAY)
    snapshots.write_version(training, root := work_dir(t.spark, "training"))
    training = snapshots.read_latest(t.spark, root)
    return ml.train_churn_model(training), training


_TRAINING = f"WITH {_features_cte(CUTOFF)}, {_LABELS}, training AS (" \
    "SELECT feats.*, cast(concat('0x', substring(sha256(concat_ws('|', feats.customer_id, 'eval')), 1, 12)) AS bigint) % 5 AS fifth " \
    "FROM feats JOIN labelled ON labelled.customer_id = feats.customer_id)"


@query("train_churn_model", f"""{_TRAINING}
SELECT CASE WHEN fifth = 0 THEN 'held_out' ELSE 'fit' END AS part, count(*) AS customers,
  true AS iterated, true AS has_inputs FROM training GROUP BY 1""")
def train_churn_model(t):
    """The rows of both parts, and whether the fit took a sensible number of steps."""
    model, training = _trained(t)
    logistic = model.stages[-1]
    fit_rows, held_out = ml.split_training(training)
    sets = fit_rows.select(F.lit("fit").alias("part")).unionByName(
        held_out.select(F.lit("held_out").alias("part"))
    )
    return (
        sets.groupBy("part").agg(F.count(F.lit(1)).alias("customers"))
        .withColumn("iterated", F.lit(1 <= logistic.summary.totalIterations <= ml.MAX_ITERATIONS))
        .withColumn("has_inputs", F.lit(logistic.numFeatures >= len(ml.NUMERIC)))
    )


@query("evaluate_model", f"SELECT '{NOW}' AS evaluated_at, true AS in_range, true AS f1_agrees, true AS log_loss_finite")
def evaluate_model(t):
    """One row: every rate is within 0 and 1, and F1 follows from precision and recall."""
    model, training = _trained(t)
    rates = ["precision", "recall", "accuracy", "f1_score", "roc_auc"]
    both = F.col("precision") + F.col("recall")
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), both), F.lit(0.0))
    return ml.evaluate_model(model, training, NOW).select(
        "evaluated_at",
        F.forall(F.array(*rates), lambda x: (x >= 0) & (x <= 1)).alias("in_range"),
        (F.abs(F.col("f1_score") - f1) < 1e-9).alias("f1_agrees"),
        ((F.col("log_loss") >= 0) & (F.col("log_loss") < 35)).alias("log_loss_finite"),
    )


_LEVELS = " UNION ALL ".join(
    f"SELECT concat('{c}_onehot_', level) AS feature FROM (SELECT DISTINCT {c} AS level FROM training WHERE fifth <> 0 AND {c} IS NOT NULL) AS l_{c} "
    f"UNION ALL SELECT '{c}_onehot___unknown'" for c in ml.CATEGORICAL)
_NUMBERS = " UNION ALL ".join(f"SELECT '{c}_filled'" for c in ml.NUMERIC)


@query("model_coefficients", f"{_TRAINING} SELECT feature, true AS agrees FROM ({_LEVELS} UNION ALL {_NUMBERS}) AS f")
def model_coefficients(t):
    """The inputs by name; attribution is coefficient times spread."""
    model, training = _trained(t)
    product = F.col("coefficient") * F.col("spread")
    return ml.model_coefficients(model, training).select(
        "feature", (F.abs(F.col("attribution") - product) < 1e-9).alias("agrees"))


@query("predict_churn", f"WITH {_features_cte(TODAY)} SELECT customer_id, true AS in_range, true AS class_agrees FROM feats")
def predict_churn(t):
    """Every live customer has a probability, and the class that follows from it."""
    model, _ = _trained(t)
    live = ft.live_features(ft.order_facts(t.fx_orders), TODAY)
    p = F.col("churn_probability")
    return ml.predict_churn(model, live).select(
        "customer_id", ((p >= 0) & (p <= 1)).alias("in_range"),
        ((p >= 0.5).cast("bigint") == F.col("predicted_is_churned")).alias("class_agrees"),
    )


_TIER = """CASE WHEN {p} >= 0.80 THEN 'CRITICAL' WHEN {p} >= 0.60 THEN 'HIGH'
  WHEN {p} >= 0.40 THEN 'MODERATE' ELSE 'LOW' END"""


@query("risk_tier", f"SELECT customer_id, churn_probability, "
       f"{_TIER.format(p='churn_probability')} AS tier FROM fx_scores")
def risk_tier(t):
    return t.fx_scores.select(
        "customer_id", "churn_probability", sc.risk_tier("churn_probability").alias("tier")
    )


_ACTION = """CASE WHEN {p} >= 0.80 AND {s} >= 5000 THEN 'EXECUTIVE_OUTREACH_PLUS_TIER_UPGRADE'
  WHEN {p} >= 0.80 THEN 'HIGH_VALUE_RETENTION_OFFER'
  WHEN {p} >= 0.60 AND {c} >= 3 THEN 'CART_RECOVERY_INCENTIVE'
  WHEN {p} >= 0.60 THEN 'TARGETED_LOYALTY_DISCOUNT'
  WHEN {p} >= 0.40 THEN 'ENGAGEMENT_CAMPAIGN' ELSE 'MONITOR_ONLY' END"""


@query("retention_action", "SELECT o.order_id, s.churn_probability, " + _ACTION.format(
    p="s.churn_probability", s="s.total_spend_90d", c="o.cart_abandonment_count")
    + " AS action FROM fx_orders o JOIN fx_scores s ON s.customer_id = o.customer_id")
def retention_action(t):
    return t.fx_orders.join(
        t.fx_scores.select("customer_id", "churn_probability", "total_spend_90d"), "customer_id"
    ).select(
        "order_id", "churn_probability",
        sc.retention_action("churn_probability", "total_spend_90d", "cart_abandonment_count").alias("action"),
    )


_STAMP = "2001-08-01 02:00:00"
_FAKE_P = "cast((cast(substring(customer_id, 6) AS bigint) * 7919) % 1000 AS double) / 1000"


def _scored(t):
    """Scores with an arithmetic probability in place of the model's."""
    live = ft.customer_features(ft.order_facts(t.fx_orders), TODAY)
    return sc.score_customers(
        live.withColumn("churn_probability", F.expr(_FAKE_P)).withColumn(
            "predicted_is_churned", (F.col("churn_probability") >= 0.5).cast("bigint")
        ),
        _STAMP,
    )


_SCORED = f"""{_features_cte(TODAY)}, scored AS (
  SELECT customer_id, customer_name, customer_email, customer_segment, loyalty_tier,
    cast(p >= 0.5 AS bigint) AS predicted_is_churned, p AS churn_probability,
    {_TIER.format(p='p')} AS churn_risk_tier, spend_90d AS total_spend_90d,
    days_since_last_purchase, cart_abandonment_count, support_tickets_count, sentiment_score,
    {_ACTION.format(p='p', s='spend_90d', c='cart_abandonment_count')} AS automated_retention_action,
    '{_STAMP}' AS calculation_timestamp
  FROM (SELECT feats.*, {_FAKE_P} AS p FROM feats) q)"""


@query("score_customers", f"WITH {_SCORED} SELECT * FROM scored")
def score_customers(t):
    return _scored(t)


def _stale_target(t):
    """A previous serving table: two thirds of the customers, some of them gone since."""
    return t.sql("""
        SELECT customer_id FROM (
          SELECT DISTINCT customer_id, cast(substring(customer_id, 6) AS bigint) AS k FROM fx_orders) q
        WHERE k % 3 <> 0
        UNION ALL SELECT concat('gone_', c_custkey) AS customer_id FROM customer WHERE c_custkey % 4 = 0""")


_STALE = """stale AS (
  SELECT DISTINCT customer_id FROM fx_orders WHERE cast(substring(customer_id, 6) AS bigint) % 3 <> 0
  UNION ALL SELECT concat('gone_', c_custkey) FROM customer WHERE c_custkey % 4 = 0)"""


def _merged(t):
    """The stale table stored, then the new scores merged into it: (root, counts)."""
    root, source = work_dir(t.spark, "risk"), _scored(t)
    old = [F.col("customer_id") if f.name == "customer_id" else F.lit(None).cast(f.dataType).alias(f.name) for f in source.schema.fields]
    snapshots.write_version(_stale_target(t).select(*old), root)
    return root, sc.store_merge(source, root)


@query("merge_churn_risk", f"""WITH {_SCORED}, {_STALE}
SELECT coalesce(s.customer_id, x.customer_id) AS customer_id, churn_probability, churn_risk_tier, automated_retention_action, calculation_timestamp,
  CASE WHEN s.customer_id IS NULL THEN 'DELETE' WHEN x.customer_id IS NULL THEN 'INSERT' ELSE 'UPDATE' END AS merge_action,
  s.customer_id IS NOT NULL AS present
FROM stale x FULL OUTER JOIN scored s ON s.customer_id = x.customer_id""")
def merge_churn_risk(t):
    """What the merge did with each customer, and the rows read back from the stored table."""
    root, _ = _merged(t)
    now = snapshots.read_latest(t.spark, root).withColumn("present", F.lit(True))
    return sc.merge_log(t.spark, root, snapshots.versions(t.spark, root)[-1]).join(now, "customer_id", "full_outer").select(
        "customer_id", "churn_probability", "churn_risk_tier", "automated_retention_action", "calculation_timestamp",
        "merge_action", F.coalesce("present", F.lit(False)).alias("present"))


@query("merge_churn_risk_counts", f"""WITH {_SCORED}, {_STALE}
SELECT merge_action, count(*) AS affected FROM (
  SELECT CASE WHEN s.customer_id IS NULL THEN 'DELETE' WHEN x.customer_id IS NULL THEN 'INSERT'
    ELSE 'UPDATE' END AS merge_action
  FROM stale x FULL OUTER JOIN scored s ON s.customer_id = x.customer_id) q GROUP BY merge_action""")
def merge_churn_risk_counts(t):
    return _merged(t)[1]


_DEMO = ["cust_0000000001", "cust_0000000004"]


@query("churn_run_report", f"""WITH {_SCORED}, runs AS (
  SELECT cast(o_orderdate AS timestamp) + cast(o_orderkey AS int) * interval '1' second AS evaluated_at,
    cast(o_orderkey % 100 AS double) / 100 AS roc_auc, cast(o_orderkey % 77 AS double) AS accuracy FROM orders),
newest AS (SELECT * FROM runs ORDER BY evaluated_at DESC LIMIT 1),
tiers AS (SELECT churn_risk_tier, count(*) AS customers, round(avg(churn_probability), 4) AS p FROM scored GROUP BY churn_risk_tier)
SELECT 'evaluation' AS section, 0 AS position, 'roc_auc' AS name, roc_auc AS value, CAST(NULL AS BIGINT) AS number, CAST(NULL AS varchar) AS note FROM newest
UNION ALL SELECT 'evaluation', 1, 'accuracy', accuracy, NULL, NULL FROM newest
UNION ALL SELECT 'distribution', row_number() OVER (ORDER BY p DESC, churn_risk_tier) - 1, churn_risk_tier, p, customers, NULL FROM tiers
UNION ALL SELECT 'customers', row_number() OVER (ORDER BY customer_id) - 1, customer_id, round(churn_probability, 4), days_since_last_purchase,
  concat(churn_risk_tier, ' ', automated_retention_action) FROM scored WHERE customer_id IN ('cust_0000000001', 'cust_0000000004')""")
def churn_run_report(t):
    """The report over a stored evaluation and a merged risk table."""
    store = ChurnStore(work_dir(t.spark, "report"))
    sc.store_merge(_scored(t), store.risk)
    snapshots.write_version(t.sql("""SELECT cast(o_orderdate AS timestamp) + cast(o_orderkey AS int) * interval '1' second AS evaluated_at,
        cast(o_orderkey % 100 AS double) / 100 AS roc_auc, cast(o_orderkey % 77 AS double) AS accuracy FROM orders"""), store.evaluation)
    return run_report(store, t.spark, _DEMO)


@query("churn_scores_for", """
SELECT customer_id, churn_probability, churn_risk_tier, customer_segment, total_spend_90d,
  sentiment_score, cast(calculation_timestamp AS varchar) AS calculation_timestamp
FROM fx_scores WHERE customer_id IN (SELECT customer_id FROM fx_logins)""")
def churn_scores_for(t):
    return sc.churn_scores_for(t.fx_scores, t.fx_logins.where("customer_id IS NOT NULL"))


@query("risk_distribution", f"""WITH {_SCORED}
SELECT churn_risk_tier, count(*) AS customers, round(avg(churn_probability), 4) AS avg_probability
FROM scored GROUP BY churn_risk_tier""")
def risk_distribution(t):
    return sc.risk_distribution(_scored(t))


@query("latest_evaluation", """
SELECT cast(max(cast(o_orderdate AS timestamp) + cast(o_orderkey AS int) * interval '1' second) AS varchar) AS evaluated_at,
  max_by(cast(o_orderkey % 100 AS double) / 100, cast(o_orderdate AS timestamp) + cast(o_orderkey AS int) * interval '1' second) AS roc_auc
FROM orders""")
def latest_evaluation(t):
    runs = t.sql("""SELECT cast(o_orderdate AS timestamp) + cast(o_orderkey AS int) * interval '1' second AS evaluated_at,
                    cast(o_orderkey % 100 AS double) / 100 AS roc_auc FROM orders""")
    return sc.latest_evaluation(runs)


_NEXT_DAY = (dt.date.fromisoformat(TODAY) + dt.timedelta(days=1)).isoformat()


@query("run_churn_pipeline", f"""{_TRAINING},
live AS (SELECT * FROM ({"WITH " + _features_cte(TODAY) + " SELECT customer_id FROM feats"}) AS a),
later AS (SELECT * FROM ({"WITH " + _features_cte(_NEXT_DAY) + " SELECT customer_id FROM feats"}) AS b)
SELECT 1 AS step, 'training_set' AS name, 'done' AS status, (SELECT count(*) FROM training) AS affected, 'full' AS mode
UNION ALL SELECT 2, 'train', 'done', NULL, 'full' UNION ALL SELECT 3, 'evaluate', 'done', 1, 'full'
UNION ALL SELECT 4, 'score', 'done', (SELECT count(*) FROM live), 'full'
UNION ALL SELECT 1, 'score', 'done', (SELECT count(*) FROM later FULL JOIN live USING (customer_id)), 'rescore'""")
def churn_run(t):
    """Steps of a full run followed by a rescore on the stored model."""
    store = ChurnStore(work_dir(t.spark, "churn"))
    full = run_churn_pipeline(t.spark, t.fx_orders, store, TODAY, NOW)
    later = (dt.date.fromisoformat(TODAY) + dt.timedelta(days=1)).isoformat()
    again = run_churn_pipeline(t.spark, t.fx_orders, store, later, f"{later} 00:00:00", mode="rescore")
    return full.withColumn("mode", F.lit("full")).unionByName(
        again.withColumn("mode", F.lit("rescore"))
    ).select("step", "name", "status", "affected", "mode")
