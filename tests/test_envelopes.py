"""What envelopes cost to make and to read: documents are parsed and written once."""

from __future__ import annotations

import json

import pandas as pd
import pyarrow as pa

from tideline.functions import values
from tideline.operators import ingest
from tideline.plans import ingest_queries
from tideline.plans.fixtures import Tables
from tideline.session import configure
from tideline.sources import specs
from tideline.sources.events import ENVELOPE_SCHEMA
from tideline.streaming import ingest_stream


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _envelopes(spark):
    fields = {"orderStatus": {"stringValue": "NEW"}, "customerId": {"referenceValue": "c/1"},
              "total": {"doubleValue": 2.5}, "address": {"mapValue": {"fields": {"city": {"mapValue": {"fields": {
                  "name": {"integerValue": "7"}}}}}}}}
    body = {"value": {"name": "projects/p/databases/d/documents/retail/O-1", "updateTime": "2001-01-01T00:00:00Z", "fields": fields}}
    rows = [("e1", "google.cloud.firestore.document.v1.created", "2001-01-01T00:00:00Z", json.dumps(body)),
            ("e2", "google.cloud.firestore.document.v1.created", "2001-01-01T00:00:00Z", '{"value":{"name":"a/documents/retail/O-2"}}')]
    return spark.createDataFrame(rows, ENVELOPE_SCHEMA)


def test_fields_of_a_document_are_read_by_one_parse(spark):
    configure(spark)
    changes = ingest.decode_events(_envelopes(spark), received_at="2001-01-01 00:00:00", with_raw=False)
    found = ingest.document_values(changes, status="orderStatus", customer="customerId", city="address.city", gone="a.b")
    rows = {r["event_id"]: r for r in found.collect()}
    assert [rows["e1"][c] for c in ("status", "customer", "city", "gone")] == ["NEW", "c/1", '{"name": 7}', None]
    assert [rows["e2"][c] for c in ("status", "customer", "city", "gone")] == [None] * 4
    # One for the body and one for the document.
    assert _plan(found).count("from_json(") == 2


def test_decode_document_reads_the_plain_document_once(spark, tmp_path, monkeypatch):
    steps = []
    monkeypatch.setattr(ingest_queries, "by_portions", lambda t, step: steps.append(step(_envelopes(spark))) or steps[0])
    configure(spark)
    out = ingest_queries.decode_document(None)
    assert [(r["status"], r["grand_total"], r["deep"], r["tag"]) for r in out.orderBy("event_id").collect()][0] == ("NEW", None, None, None)
    assert _plan(out).count("get_json_object(") <= 1


def test_an_order_document_is_written_by_few_calls(spark, tmp_path):
    configure(spark)
    spark.createDataFrame([(21, 3, "F", 12.5, None), (22, 4, "O", float("nan"), None)],
                          "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp").write.parquet(
        str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(3, 'A "quoted" \\ name', "BUILDING"), (4, None, None)],
                          "c_custkey long, c_name string, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    made = ingest_queries.build_order_envelopes(Tables(spark, str(tmp_path)))
    assert _plan(made).count("to_json(") <= 3
    documents = ingest_queries._snapshot(Tables(spark, str(tmp_path))).select("fields").collect()
    one = json.loads(documents[0]["fields"])
    assert one["customerEmail"] == {"nullValue": "NULL_VALUE"} and one["createdAt"] == {"nullValue": "NULL_VALUE"}
    assert one["financials"]["mapValue"]["fields"]["grandTotal"] == {"doubleValue": "NaN"}
    assert one["shippingAddress"]["mapValue"]["fields"]["city"] == {"mapValue": {"fields": {"name": {"integerValue": "22"}}}}
    assert one["tags"] == {"arrayValue": {"values": [{"stringValue": "a"}, {"mapValue": {"fields": {"n": {"integerValue": "7"}}}}]}}


def test_usual_instants_need_no_pandas(monkeypatch):
    odd = ["2001-02-30T00:00:00Z", "2001-01-01T23:59:60Z", "2001-01-01T00:00:00.5Z", "2001-01-01", "x", None, 5]
    before = [values._instant_text(x) for x in odd if isinstance(x, str)]
    assert before == [None, None, "2001-01-01 00:00:00.500000+00:00", "2001-01-01 00:00:00+00:00", None]
    usual = ["1800-01-01T00:00:00Z", "2001-07-31T23:59:59Z"]
    want = [str(pd.Timestamp(x).to_pydatetime()) for x in usual]
    monkeypatch.setattr(values.pd, "Timestamp", None)
    assert [values._instant_text(x) for x in usual] == want


def test_only_nested_values_that_are_there_are_read(monkeypatch):
    nested, read = '{"mapValue":{"fields":{"n":{"integerValue":"1"}}}}', []
    plain = values._plain_text
    monkeypatch.setattr(values, "_plain_text", lambda text: read.append(text) or plain(text))
    rows = pa.array([None, [None, nested, None], [], [None, None], ["bad", nested]], pa.list_(pa.string()))
    out = [x for batch in values.plain_texts.func(iter([rows.slice(1), rows[:1], rows[:0]])) for x in batch.to_pylist()]
    assert out == [[None, '{"n": 1}', None], [], [None, None], [None, '{"n": 1}'], None]
    assert read == [nested, "bad", nested]


def test_a_batch_splits_off_malformed_envelopes_by_what_it_stored(spark, tmp_path, monkeypatch):
    configure(spark)
    kind = "google.cloud.firestore.document.v1.created"
    bad = [("b1", kind, None, '{"value": {"name"'), ("b2", "", None, "{}"), ("b3", kind, None, "[1, 2]"), (None, kind, "x", None),
           ("b5", kind, None, '{"value":{},"value":{}}'), ("b6", kind, None, '[{"value":{"name":"a/documents/retail/O-9"}}]')]
    envelopes = _envelopes(spark).unionByName(spark.createDataFrame(bad, ENVELOPE_SCHEMA)).localCheckpoint()
    want = {(r["event_id"], r["body"], r["reason"]) for r in ingest.quarantine_malformed(envelopes)[1].collect()}
    split, given = ingest.quarantine_malformed, []
    monkeypatch.setattr(ingest, "quarantine_malformed", lambda df: given.extend(df.inputFiles()) or split(df))
    ingest_stream.process_batch(envelopes, 0, str(tmp_path))
    assert given and all("/decoded/" in path for path in given)
    found = spark.read.parquet(f"{tmp_path}/quarantine/batch=0")
    assert found.columns == [*envelopes.columns, "reason"]
    assert len(want) == 6 and {(r["event_id"], r["body"], r["reason"]) for r in found.collect()} == want
    ledger = ingest.read_ledger(spark, f"{tmp_path}/{specs.ORDERS_LEDGER.name}")
    assert sorted(r["order_id"] for r in ledger.collect()) == ["O-1", "O-2"]
