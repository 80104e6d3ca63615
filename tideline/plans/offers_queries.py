"""Registered queries: login sessions, spendable offers and claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import offers as of
from tideline.operators import sessions as ss
from tideline.plans.fixtures import NOW
from tideline.plans.registry import query
from tideline.session import work_dir
from tideline.streaming.keyed_state import assign_logins_stream

_NOW = f"timestamp '{NOW}'"

_MIXED_TIMES = """SELECT session_id,
    CASE event_key % 5 WHEN 0 THEN NULL WHEN 1 THEN 'not a time' WHEN 2 THEN '2001-07-04T10:15:00Z'
      WHEN 3 THEN '2001-07-04T10:15:00.250+02:00' ELSE '2001-07-04T10:15:00' END AS login_timestamp,
    CASE WHEN event_key % 3 = 0 THEN NULL ELSE '2001-07-05 08:00:00' END AS login_at,
    login_timestamp AS created_at
  FROM fx_logins"""


@query("session_started_at", """
SELECT session_id, CASE event_key % 5 WHEN 2 THEN '2001-07-04 10:15:00' WHEN 3 THEN '2001-07-04 08:15:00.25'
    WHEN 4 THEN '2001-07-04 10:15:00' ELSE CASE WHEN event_key % 3 = 0 THEN cast(login_timestamp AS varchar) ELSE '2001-07-05 08:00:00' END END AS started_at
FROM fx_logins""")
def session_started_at(t):
    mixed = t.sql(_MIXED_TIMES)
    return mixed.select("session_id", ss.session_started_at(mixed).alias("started_at"))


_PRINCIPALS = """SELECT concat('user', c_custkey) AS principal_id,
    concat('cust_', lpad(concat(c_custkey, ''), 10, '0')) AS customer_id,
    concat('user', c_custkey, '@example.test') AS iam_principal, c_name AS customer_name
  FROM customer WHERE c_custkey % 8 <> 0"""
_REQUESTS = "SELECT session_id, concat('user', event_key % 200) AS principal_id, login_timestamp, event_key FROM fx_logins"


@query("session_documents", f"""WITH p AS ({_PRINCIPALS}), r AS ({_REQUESTS})
SELECT r.session_id, p.customer_id, p.principal_id, p.iam_principal, p.customer_name, 'PENDING' AS agent_processing_status,
  'PENDING' AS status, cast(r.login_timestamp AS varchar) AS login_timestamp, cast(r.login_timestamp AS varchar) AS login_at,
  cast(r.login_timestamp AS varchar) AS created_at, cast(r.login_timestamp + interval '30' day AS varchar) AS expire_at,
  'MOBILE_APP' AS channel, cast(NULL AS varchar) AS offer_id, cast(NULL AS varchar) AS active_offer_id, cast(NULL AS varchar) AS skip_reason
FROM r JOIN p ON p.principal_id = r.principal_id""")
def session_documents(t):
    return ss.session_documents(t.sql(_REQUESTS), t.sql(_PRINCIPALS))


@query("resolve_customer", f"""WITH p AS ({_PRINCIPALS}), r AS ({_REQUESTS})
SELECT r.session_id, p.customer_id AS login_customer, CASE WHEN p.customer_id IS NULL THEN 'UNKNOWN_PRINCIPAL' END AS rejection,
  coalesce(p.customer_id, r.principal_id) AS listing_customer
FROM r LEFT JOIN p ON p.principal_id = r.principal_id""")
def resolve_customer(t):
    requests, principals = t.sql(_REQUESTS).select("session_id", "principal_id"), t.sql(_PRINCIPALS)
    strict = ss.resolve_customer(requests, principals, strict=True).select(
        "session_id", F.col("customer_id").alias("login_customer"), "rejection"
    )
    listing = ss.resolve_customer(requests, principals, strict=False).select(
        "session_id", F.col("customer_id").alias("listing_customer")
    )
    return strict.join(listing, "session_id")


_CUSTOMERS = "SELECT concat('cust_', lpad(concat(c_custkey, ''), 10, '0')) AS customer_id FROM customer"
_AT = "2001-07-20 12:00:00"


@query("in_flight_session", f"""
WITH fresh AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY login_timestamp DESC, session_id DESC) AS rn
  FROM fx_logins WHERE agent_processing_status IN ('PENDING', 'PROCESSING') AND login_timestamp >= timestamp '{_AT}' - interval '6' hour)
SELECT c.customer_id, f.session_id, cast(f.login_timestamp AS varchar) AS started_at, f.agent_processing_status AS session_status
FROM ({_CUSTOMERS}) c LEFT JOIN fresh f ON f.customer_id = c.customer_id AND f.rn = 1""")
def in_flight_session(t):
    return ss.in_flight_session(t.sql(_CUSTOMERS), t.fx_logins, _AT, 6 * 3600)


def _replay_sql(seconds: int) -> str:
    """Follow each customer's chain of session starts, one link per step."""
    return f"""
WITH RECURSIVE l AS (SELECT session_id, customer_id, epoch_us(login_timestamp) AS us FROM fx_logins WHERE customer_id IS NOT NULL),
heads AS (SELECT customer_id, us, min(session_id) AS head FROM l GROUP BY customer_id, us),
links AS (SELECT a.customer_id, a.us, min(b.us) AS next_us FROM heads a
  JOIN heads b ON b.customer_id = a.customer_id AND b.us > a.us + {seconds}000000 GROUP BY a.customer_id, a.us),
chain AS (
  SELECT customer_id, min(us) AS start_us FROM heads GROUP BY customer_id
  UNION ALL
  SELECT c.customer_id, n.next_us FROM chain c JOIN links n ON n.customer_id = c.customer_id AND n.us = c.start_us),
starts AS (SELECT c.customer_id, c.start_us, h.head FROM chain c JOIN heads h ON h.customer_id = c.customer_id AND h.us = c.start_us)
SELECT l.session_id, l.customer_id, max_by(s.head, s.start_us) AS assigned_session_id,
  cast(make_timestamp(max(s.start_us)) AS varchar) AS session_started_at, max_by(s.head, s.start_us) <> l.session_id AS reused
FROM l JOIN starts s ON s.customer_id = l.customer_id AND s.start_us <= l.us GROUP BY l.session_id, l.customer_id"""


@query("assign_logins", _replay_sql(120))
def assign_logins(t):
    return ss.assign_logins(t.fx_logins)


@query("assign_logins_6h", _replay_sql(21600))
def assign_logins_6h(t):
    return ss.assign_logins(t.fx_logins, max_age_seconds=21600)


@query("assign_logins_split_keys", _replay_sql(21600))
def assign_logins_split_keys(t):
    """The same with the size limit at zero, so that large customers are cut into blocks."""
    return ss.assign_logins(t.fx_logins, max_age_seconds=21600, min_rows=0, block_seconds=21600)


_SPENDABLE = f"""(nullif(o.order_id, '') IS NULL AND o.status IN ('ACTIVE', 'REDEEMED') AND coalesce(o.valid_until >= {_NOW}, true))"""
# Validity moved near the clock, so that both answers are common.
_OFFERS_IN = """SELECT offer_id, customer_id, session_id, status, discount_percent, free_express_shipping, order_id, promo_code, created_at,
    CASE WHEN cast(substring(offer_id, 5) AS bigint) % 4 = 0 THEN valid_until
         WHEN cast(substring(offer_id, 5) AS bigint) % 4 = 1 THEN NULL
         ELSE cast(timestamp '2001-08-01 00:00:00' AS timestamp) END AS valid_until FROM fx_offers"""


@query("offer_spendable", f"""WITH o AS ({_OFFERS_IN})
SELECT o.offer_id, {_SPENDABLE} AND o.customer_id = concat('cust_', lpad(concat(cast(substring(o.offer_id, 5) AS bigint) % 3, ''), 10, '0')) AS for_other,
  {_SPENDABLE} AS for_owner FROM o""")
def offer_spendable(t):
    other = F.concat(
        F.lit("cust_"), F.lpad((F.substring("offer_id", 5, 20).cast("bigint") % 3).cast("string"), 10, "0")
    )
    return t.sql(_OFFERS_IN).select(
        "offer_id", of.offer_spendable(other, NOW).alias("for_other"),
        of.offer_spendable("customer_id", NOW).alias("for_owner"),
    )


_FOUND = f"""newest AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY created_at DESC, offer_id DESC) AS rn FROM offers_in),
found AS (SELECT * FROM (SELECT o.*, row_number() OVER (PARTITION BY customer_id ORDER BY rn) AS pick
    FROM newest o WHERE rn <= 5 AND {_SPENDABLE}) q WHERE pick = 1)"""


@query("find_spendable_offer", f"""WITH offers_in AS ({_OFFERS_IN}), {_FOUND}
SELECT customer_id, offer_id, status, discount_percent, cast(created_at AS varchar) AS created_at FROM found""")
def find_spendable_offer(t):
    return of.find_spendable_offer(t.sql(_OFFERS_IN), NOW).select(
        "customer_id", "offer_id", "status", "discount_percent", "created_at"
    )


_OFFER_REQUESTS = """SELECT order_id AS request_id, customer_id,
    CASE order_key % 4 WHEN 0 THEN concat('off_', lpad(concat(order_key - order_key % 5, ''), 10, '0'))
      WHEN 1 THEN concat('off_', lpad(concat(order_key, ''), 10, '0')) WHEN 2 THEN '' ELSE NULL END AS requested_offer_id FROM fx_orders"""


@query("resolve_offer", f"""WITH offers_in AS ({_OFFERS_IN}), requests AS ({_OFFER_REQUESTS}), {_FOUND}
SELECT r.request_id, r.customer_id, r.requested_offer_id,
  CASE WHEN nullif(r.requested_offer_id, '') IS NOT NULL THEN CASE WHEN o.customer_id = r.customer_id AND {_SPENDABLE} THEN o.offer_id END ELSE f.offer_id END AS offer_id,
  CASE WHEN nullif(r.requested_offer_id, '') IS NOT NULL THEN CASE WHEN o.customer_id = r.customer_id AND {_SPENDABLE} THEN o.discount_percent END ELSE f.discount_percent END AS discount_percent
FROM requests r LEFT JOIN offers_in o ON o.offer_id = r.requested_offer_id LEFT JOIN found f ON f.customer_id = r.customer_id""")
def resolve_offer(t):
    return of.resolve_offer(t.sql(_OFFER_REQUESTS), t.sql(_OFFERS_IN), NOW).select(
        "request_id", "customer_id", "requested_offer_id", "offer_id", "discount_percent"
    )


@query("claim_offers", """
WITH claims AS (SELECT c.*, o.status, nullif(o.order_id, '') AS spent, o.offer_id IS NOT NULL AS known,
    row_number() OVER (PARTITION BY c.offer_id ORDER BY c.claimed_at, c.claim_id, c.order_id NULLS FIRST) AS pos,
    CASE WHEN c.order_id IS NOT NULL THEN row_number() OVER (PARTITION BY c.offer_id, c.order_id IS NULL ORDER BY c.claimed_at, c.claim_id, c.order_id) END AS order_pos
  FROM fx_claims c LEFT JOIN fx_offers o ON o.offer_id = c.offer_id),
judged AS (SELECT *, coalesce((status = 'ACTIVE' AND pos = 1)
    OR ((status = 'ACTIVE' OR (status = 'REDEEMED' AND spent IS NULL)) AND order_pos = 1), false) AS accepted FROM claims)
SELECT claim_id, offer_id, order_id, accepted,
  CASE WHEN NOT known THEN 'OFFER_NOT_FOUND' WHEN NOT accepted THEN concat('OFFER_IS_', CASE WHEN status = 'ACTIVE' THEN 'REDEEMED' ELSE status END) END AS rejection,
  CASE WHEN accepted THEN 'REDEEMED' END AS new_status FROM judged""")
def claim_offers(t):
    return of.claim_offers(t.fx_claims, t.fx_offers).select(
        "claim_id", "offer_id", "order_id", "accepted", "rejection", "new_status"
    )


@query("claim_field_guard", """
WITH x AS (SELECT offer_id, status, discount_percent, promo_code, cast(substring(offer_id, 5) AS bigint) AS k FROM fx_offers),
y AS (SELECT *, CASE WHEN k % 9 = 0 THEN 'EXPIRED' ELSE 'REDEEMED' END AS new_status,
    concat_ws(',', CASE WHEN k % 7 = 0 AND discount_percent IS NOT NULL THEN 'discount_percent' END,
      CASE WHEN k % 11 = 0 THEN 'promo_code' END) AS violations FROM x)
SELECT offer_id, violations = '' AND status = 'ACTIVE' AND new_status = 'REDEEMED' AS allowed, violations, status AS old_status, new_status FROM y""")
def claim_field_guard(t):
    before = t.fx_offers
    key = F.substring("offer_id", 5, 20).cast("bigint")
    after = before.withColumns(
        {
            "status": F.when(key % 9 == 0, "EXPIRED").otherwise("REDEEMED"),
            "order_id": F.lit("ORD-NEW"),
            "discount_percent": F.when(key % 7 == 0, F.col("discount_percent") + 1).otherwise(F.col("discount_percent")),
            "promo_code": F.when(key % 11 == 0, F.lit(None).cast("string")).otherwise(F.col("promo_code")),
        }
    )
    return of.claim_field_guard(before, after)


@query("offers_for_session", """
SELECT o.session_id, o.offer_id, s.opened FROM fx_offers o JOIN (SELECT concat('sess_', event_id) AS session_id, event_type AS opened FROM events) s
  ON s.session_id = o.session_id""")
def offers_for_session(t):
    sessions = t.sql("SELECT concat('sess_', event_id) AS session_id, event_type AS opened FROM events")
    return of.offers_for_session(sessions, t.fx_offers).select("session_id", "offer_id", "opened")


_FINISHED = """SELECT session_id, CASE event_key % 4 WHEN 0 THEN 'PROCESSED' WHEN 1 THEN 'SKIPPED' WHEN 2 THEN 'ERROR' ELSE 'PROCESSING' END AS agent_processing_status,
    CASE WHEN event_key % 8 = 0 THEN concat('off_', event_key) END AS offer_id, CASE WHEN event_key % 4 = 1 THEN 'COOLDOWN_ACTIVE' END AS skip_reason FROM fx_logins"""


@query("session_outcome", f"""
SELECT session_id, agent_processing_status, CASE WHEN offer_id IS NOT NULL THEN 'OFFER' ELSE coalesce(skip_reason, 'NO_OFFER') END AS outcome
FROM ({_FINISHED}) q WHERE agent_processing_status <> 'PROCESSING'""")
def session_outcome(t):
    return ss.session_outcome(t.sql(_FINISHED)).select("session_id", "agent_processing_status", "outcome")


def run_to_parquet(t, stream, label: str):
    """Run a stream over everything available and read what it wrote."""
    out = work_dir(t.spark, f"{label}-out")
    running = (
        stream.writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", work_dir(t.spark, f"{label}-checkpoint"))
        .outputMode("append").trigger(availableNow=True).start()
    )
    running.awaitTermination()
    return t.spark.read.parquet(out)


@query("stream_assign_logins", _replay_sql(21600))
def stream_assign_logins(t):
    """Logins arrive as files in time order and are replayed with keyed state."""
    source = work_dir(t.spark, "logins")
    logins = t.fx_logins.select("session_id", "customer_id", "login_timestamp")
    # Two sets of files in order of time, parted at the middle of the data; a
    # micro-batch reads one set.
    at = F.unix_micros("login_timestamp")
    middle = logins.select(at.alias("at")).approxQuantile("at", [0.5], 0.01)[0]
    logins.where(at < middle).repartition(3, "customer_id").write.parquet(source)
    logins.where(at >= middle).repartition(3, "customer_id").write.mode("append").parquet(source)
    stream = t.spark.readStream.schema(logins.schema).option("maxFilesPerTrigger", 1).parquet(source)
    return run_to_parquet(t, assign_logins_stream(stream, 21600), "logins")
