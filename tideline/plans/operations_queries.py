"""Registered queries: resets, recent views, traces and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import operations as op
from tideline.plans.fixtures import NOW
from tideline.plans.offers_queries import run_to_parquet
from tideline.plans.registry import query
from tideline.plans.retention_queries import TRACES_SQL, merged_traces
from tideline.session import work_dir
from tideline.streaming.keyed_state import new_revisions_stream

_IDS = ["cust_0000000001", "cust_0000000002"]
_IN_IDS = "('cust_0000000001', 'cust_0000000002')"
_LEGACY = ["cust_0000000004", "cust_0000000007"]
_PREFIX = "ORD-00000001"


@query("purge_by_values", """
SELECT session_id, customer_id FROM fx_logins WHERE customer_id IS NULL
  OR customer_id NOT IN (SELECT customer_id FROM fx_orders WHERE order_key % 10 = 0)""")
def purge_by_values(t):
    gone = t.fx_orders.where("order_key % 10 = 0").select("customer_id")
    return op.purge_by_values(t.fx_logins, "customer_id", gone).select("session_id", "customer_id")


@query("purge_by_values_counts", """
SELECT count(*) FILTER (WHERE hit) AS deleted, count(*) FILTER (WHERE NOT hit) AS kept FROM (
  SELECT coalesce(customer_id IN (SELECT customer_id FROM fx_orders WHERE order_key % 10 = 0), false) AS hit FROM fx_logins) q""")
def purge_by_values_counts(t):
    gone = t.fx_orders.where("order_key % 10 = 0").select("customer_id")
    return op.purge_counts(t.fx_logins, op.purged_by_values(t.fx_logins, "customer_id", gone))


@query("purge_by_prefix_counts", f"""
SELECT count(*) FILTER (WHERE starts_with(order_id, '{_PREFIX}')) AS deleted, count(*) FILTER (WHERE NOT starts_with(order_id, '{_PREFIX}')) AS kept FROM fx_orders""")
def purge_by_prefix_counts(t):
    return op.purge_counts(t.fx_orders, op.purged_by_prefix(t.fx_orders, "order_id", _PREFIX))


@query("purge_by_prefix", f"SELECT order_id FROM fx_orders WHERE NOT starts_with(order_id, '{_PREFIX}')")
def purge_by_prefix(t):
    return op.purge_by_prefix(t.fx_orders, "order_id", _PREFIX).select("order_id")


@query("reset_plan", f"""
SELECT 'sessions' AS sweep, count(*) AS deleted FROM fx_logins WHERE customer_id IN {_IN_IDS}
UNION ALL SELECT 'offers', count(*) FROM fx_offers WHERE customer_id IN {_IN_IDS}
UNION ALL SELECT 'traces', count(*) FROM fx_traces r JOIN fx_logins l ON l.session_id = r.session_id WHERE l.customer_id IN {_IN_IDS}
UNION ALL SELECT 'app_orders', count(*) FROM fx_orders WHERE order_id LIKE '{_PREFIX}%'
UNION ALL SELECT 'legacy_orders', count(*) FROM fx_orders WHERE order_id NOT LIKE '{_PREFIX}%' AND customer_id IN ('cust_0000000004', 'cust_0000000007')""")
def reset_plan(t):
    traces = t.fx_traces.join(t.fx_logins.select("session_id", "customer_id"), "session_id", "left")
    return op.reset_plan(t.fx_logins, t.fx_offers, traces, t.fx_orders, _IDS, _LEGACY, _PREFIX)


@query("remaining_by_prefix", f"SELECT count(*) AS remaining FROM fx_orders WHERE order_id LIKE '{_PREFIX}%'")
def remaining_by_prefix(t):
    return op.remaining_by_prefix(t.fx_orders, "order_id", _PREFIX)


@query("recent_sessions", """SELECT session_id, cast(login_timestamp AS varchar) AS login_timestamp FROM fx_logins
ORDER BY fx_logins.login_timestamp DESC, session_id DESC LIMIT 10""")
def recent_sessions(t):
    return op.recent_sessions(t.fx_logins).select("session_id", "login_timestamp")


@query("recent_offers_view", """SELECT offer_id, cast(created_at AS varchar) AS created_at FROM fx_offers
ORDER BY fx_offers.created_at DESC, offer_id DESC LIMIT 10""")
def recent_offers_view(t):
    return op.recent_offers_view(t.fx_offers).select("offer_id", "created_at")


@query("recent_traces", """SELECT session_id, part, cast(recorded_at AS varchar) AS recorded_at FROM fx_traces
ORDER BY fx_traces.recorded_at DESC, session_id DESC LIMIT 10""")
def recent_traces(t):
    return op.recent_traces(t.fx_traces).select("session_id", "part", "recorded_at")


@query("recent_app_orders", f"SELECT order_id, customer_id FROM fx_orders WHERE order_id LIKE '{_PREFIX}%' ORDER BY order_id LIMIT 25")
def recent_app_orders(t):
    return op.recent_app_orders(t.fx_orders, _PREFIX).select("order_id", "customer_id")


_DOCUMENTS = """SELECT order_id AS id, CASE WHEN order_key % 3 = 0 THEN 'unknown'
  ELSE concat(substring(cast(created_at AS {text}), 1, 10), 'T', substring(cast(created_at AS {text}), 12, 8), 'Z') END AS create_time FROM fx_orders"""


@query("latest_document", f"""WITH d AS ({_DOCUMENTS.format(text='varchar')})
SELECT id, create_time FROM d ORDER BY create_time = 'unknown', create_time DESC, id DESC LIMIT 1""")
def latest_document(t):
    return op.latest_document(t.sql(_DOCUMENTS.format(text="string")))


_DELIVERIES = """SELECT event_id AS arrival, concat('doc_', user_id % 40) AS id,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE cast((event_id * 7 % 3) AS bigint) END AS update_time FROM events"""
_REVISIONS = f"""WITH d AS ({_DELIVERIES}), x AS (SELECT *, coalesce(concat(update_time, ''), '') AS stamp FROM d),
y AS (SELECT *, lag(stamp) OVER (PARTITION BY id ORDER BY arrival) AS prev FROM x)
SELECT arrival, id, update_time FROM y WHERE prev IS NULL OR prev <> stamp"""


@query("new_revisions", _REVISIONS)
def new_revisions(t):
    return op.new_revisions(t.sql(_DELIVERIES))


@query("new_revisions_split_keys", _REVISIONS)
def new_revisions_split_keys(t):
    """The same with narrow buckets."""
    return op.new_revisions(t.sql(_DELIVERIES), bucket=F.floor(F.col("arrival") / 50))


@query("correlate_traces", """
WITH tr AS (SELECT session_id AS trace_id, max(recorded_at) AS traced_at FROM fx_traces GROUP BY session_id
  UNION ALL SELECT concat('order_', order_id), created_at FROM fx_orders WHERE order_key % 3 = 0)
SELECT 'SESSION' AS kind, l.session_id AS subject_id, l.session_id AS trace_id, cast(tr.traced_at AS varchar) AS traced_at
FROM fx_logins l LEFT JOIN tr ON tr.trace_id = l.session_id
UNION ALL SELECT 'ORDER', o.order_id, concat('order_', o.order_id), cast(tr.traced_at AS varchar)
FROM fx_orders o LEFT JOIN tr ON tr.trace_id = concat('order_', o.order_id)""")
def correlate_traces(t):
    sessions = t.fx_traces.groupBy(F.col("session_id").alias("trace_id")).agg(F.max("recorded_at").alias("recorded_at"))
    orders = t.fx_orders.where("order_key % 3 = 0").select(
        F.concat(F.lit("order_"), "order_id").alias("trace_id"), F.col("created_at").alias("recorded_at")
    )
    return op.correlate_traces(t.fx_logins, t.fx_orders, sessions.unionByName(orders))


_STATUS = """CASE event_key % 6 WHEN 0 THEN 'PROCESSED' WHEN 1 THEN 'SKIPPED' WHEN 2 THEN 'ERROR' WHEN 3 THEN 'PROCESSING' WHEN 4 THEN NULL ELSE 'PENDING' END"""


@query("hop_status", f"""WITH {TRACES_SQL},
s AS (SELECT l.session_id, l.event_key, {_STATUS} AS st, m.delivery_ms, m.agent_claim_ms, m.agent_call_ms, m.bridge_status,
    l.event_key % 4 = 0 AS offered, CASE WHEN l.event_key % 5 = 0 THEN 12.5e0 END AS lw, CASE WHEN l.event_key % 10 = 0 THEN 20.5e0 END AS ow, l.event_key % 8 = 0 AS ordered, m.session_id IS NOT NULL AS traced
  FROM fx_logins l LEFT JOIN merged m ON m.session_id = l.session_id),
f AS (SELECT *, coalesce(st IN ('PROCESSED', 'SKIPPED', 'ERROR'), false) AS term FROM s),
g AS (SELECT *, agent_claim_ms IS NOT NULL OR term AS claimed FROM f),
h AS (SELECT *, CASE WHEN claimed OR bridge_status IS NOT NULL THEN 'done' ELSE 'active' END AS moving FROM g)
SELECT session_id, 'client' AS hop, 'done' AS state, lw AS latency_ms, CASE WHEN event_key % 5 = 0 THEN 'login · telemetry' ELSE 'login write' END AS detail FROM h
UNION ALL SELECT session_id, 'firestore', 'done', ow, CASE WHEN ow IS NOT NULL THEN 'order write' ELSE 'customer_sessions' END FROM h
UNION ALL SELECT session_id, 'eventarc', moving, round(delivery_ms, 6), CASE WHEN traced THEN '10:20:30' ELSE 'in flight' END FROM h
UNION ALL SELECT session_id, 'bridge', moving, NULL, 'in flight' FROM h
UNION ALL SELECT session_id, 'agent', CASE WHEN coalesce(st = 'ERROR', false) OR coalesce(bridge_status = 'AGENT_ERROR', false) THEN 'error' WHEN term THEN 'done' WHEN claimed THEN 'active' ELSE 'idle' END, round(agent_call_ms, 6), coalesce(lower(st), 'idle') FROM h
UNION ALL SELECT session_id, 'offer', CASE WHEN offered THEN 'done' WHEN st = 'SKIPPED' THEN 'skipped' ELSE 'idle' END, NULL,
  CASE WHEN offered THEN concat(event_key % 40, '%') WHEN st = 'SKIPPED' THEN 'skipped: no offer' ELSE 'pending' END FROM h
UNION ALL SELECT session_id, 'bigquery', CASE WHEN ordered THEN 'done' WHEN ow IS NOT NULL THEN 'active' ELSE 'idle' END, CASE WHEN ordered THEN 99.0e0 END,
  CASE WHEN ow IS NOT NULL THEN 'replicating' ELSE 'no order yet' END FROM h
UNION ALL SELECT concat('early_', event_key), e.hop, e.state, CASE WHEN e.hop = 'client' THEN 12.5e0 END, e.detail FROM fx_logins,
  (VALUES ('client', 'active', 'login · telemetry'), ('firestore', 'idle', 'awaiting login'), ('eventarc', 'idle', 'idle'), ('bridge', 'idle', 'idle'),
    ('agent', 'idle', 'idle'), ('offer', 'idle', 'pending'), ('bigquery', 'idle', 'no order yet')) AS e(hop, state, detail) WHERE event_key % 15 = 1""")
def hop_status(t):
    """Sessions that come twice, and logins that only telemetry knows."""
    logins = t.fx_logins
    sessions = logins.select("session_id", F.expr(_STATUS).alias("agent_processing_status"))
    offers = logins.where("event_key % 4 = 0").select("session_id", (F.col("event_key") % 40).alias("discount_percent"))
    telemetry = logins.where("event_key % 5 = 0").select(
        "session_id", F.lit(12.5).alias("login_write_ms"), F.when(F.col("event_key") % 10 == 0, 20.5).alias("order_write_ms")
    )
    early = logins.where("event_key % 15 = 1").select(
        F.concat(F.lit("early_"), "event_key").alias("session_id"), F.lit(12.5).alias("login_write_ms"), F.lit(None).cast("double").alias("order_write_ms"))
    order_traces = logins.where("event_key % 8 = 0").select("session_id", F.lit(99.0).alias("total_ms"))
    traces = merged_traces(t).withColumn("event_time", F.lit("2001-07-31T10:20:30"))
    twice = sessions.unionByName(sessions.where("hash(session_id) % 3 = 0"))
    return op.hop_status(twice, traces, offers, telemetry.unionByName(telemetry).unionByName(early), order_traces)


@query("merge_telemetry", """
SELECT session_id, max_by(value, (recorded_at, event_key)) FILTER (WHERE measure = 'click' AND value IS NOT NULL) AS click,
  max_by(value, (recorded_at, event_key)) FILTER (WHERE measure = 'view' AND value IS NOT NULL) AS view,
  max_by(value, (recorded_at, event_key)) FILTER (WHERE measure = 'error' AND value IS NOT NULL) AS error,
  cast(max(recorded_at) AS varchar) AS recorded_at FROM fx_telemetry GROUP BY session_id""")
def merge_telemetry(t):
    return op.merge_telemetry(t.fx_telemetry, ["click", "view", "error"])


@query("ttl_expire", f"""
SELECT offer_id FROM fx_offers WHERE cooldown_until > timestamp '{NOW}' - interval '365' day OR status = 'ACTIVE'""")
def ttl_expire(t):
    dated = t.fx_offers.withColumn(
        "ttl_expiry_at", F.when(F.col("status") != "ACTIVE", F.expr("cooldown_until + INTERVAL '365' DAY"))
    )
    return op.ttl_expire(dated, "ttl_expiry_at", NOW).select("offer_id")


@query("new_offers_since", f"SELECT offer_id, customer_id FROM fx_offers WHERE NOT created_at < timestamp '2000-01-01 00:00:00'")
def new_offers_since(t):
    before = t.fx_offers.where("created_at < timestamp'2000-01-01 00:00:00'")
    return op.new_offers_since(before, t.fx_offers).select("offer_id", "customer_id")


_CHECKED = "SELECT session_id, customer_id, CASE WHEN event_key % 9 = 0 THEN concat('off_', event_key) END AS offer_id FROM fx_logins WHERE customer_id IS NOT NULL"
_EXPECTED = "SELECT concat('cust_', lpad(concat(c_custkey, ''), 10, '0')) AS customer_id, c_custkey % 2 = 0 AS expect_offer FROM customer WHERE c_custkey % 5 <> 0"


@query("verify_outcomes", f"""WITH s AS ({_CHECKED}), e AS ({_EXPECTED}), n AS (SELECT DISTINCT customer_id FROM fx_offers WHERE created_at >= timestamp '2001-01-01 00:00:00'),
x AS (SELECT s.session_id, s.customer_id, s.offer_id, e.expect_offer, n.customer_id IS NOT NULL OR s.offer_id IS NOT NULL AS got_offer
  FROM s LEFT JOIN e ON e.customer_id = s.customer_id LEFT JOIN n ON n.customer_id = s.customer_id)
SELECT *, CASE WHEN expect_offer IS NULL THEN 'NO_EXPECTATION' WHEN expect_offer = got_offer THEN 'PASS' ELSE 'FAIL' END AS result FROM x""")
def verify_outcomes(t):
    fresh = t.fx_offers.where("created_at >= timestamp'2001-01-01 00:00:00'")
    return op.verify_outcomes(t.sql(_EXPECTED), t.sql(_CHECKED), fresh)


@query("stream_new_revisions", _REVISIONS.replace("id, update_time FROM y", "id, cast(update_time AS varchar) AS update_time FROM y"))
def stream_new_revisions(t):
    """Deliveries arrive as files in order and are reduced with keyed state."""
    source = work_dir(t.spark, "deliveries")
    deliveries = t.sql(_DELIVERIES)
    # Two sets of files in order of arrival, parted at the middle of the data; a
    # document is in one file of a set.
    middle = deliveries.approxQuantile("arrival", [0.5], 0.01)[0]
    early = F.col("arrival") < middle
    deliveries.where(early).repartition(3, "id").write.parquet(source)
    deliveries.where(~early).repartition(3, "id").write.mode("append").parquet(source)
    stream = t.spark.readStream.schema(deliveries.schema).option("maxFilesPerTrigger", 1).parquet(source)
    return run_to_parquet(t, new_revisions_stream(stream), "deliveries")
