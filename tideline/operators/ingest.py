"""From change envelopes to the ledger and the current-state mirrors.

All of it is column expressions over one row per change, so the same functions
serve a replayed batch and each micro-batch of a stream.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.scalars import (
    as_col, change_sequence, change_sequence_hex, null_if_empty, parse_instant,
)
from tideline.functions.values import (
    TEXT_KINDS, coerce_column, decode_document, nested_value, plain_texts, value_schema,
)
from tideline.sources import days, snapshots, specs
from tideline.sources.specs import ROUTES, ColumnSpec, TableSpec

# Event types and the operations they stand for.
OPERATIONS = {
    "google.cloud.firestore.document.v1.created": "insert",
    "google.cloud.firestore.document.v1.updated": "update",
    "google.cloud.firestore.document.v1.deleted": "delete",
}
TRACE_PREFIX = "ORD-26-MOB-"
TRACE_TTL_DAYS = 30

_STRICT_JSON = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "true"}


def all_specs(routes: dict[str, tuple[TableSpec, ...]] = ROUTES) -> list[TableSpec]:
    return [spec for tables in routes.values() for spec in tables]


# --- splitting off what cannot be read ---------------------------------------


def malformed_reason(body: Column | str = "body", event_type: Column | str = "event_type") -> Column:
    """Why an envelope cannot be processed; NULL when it can."""
    text = F.trim(as_col(body))
    is_object = text.startswith("{") & text.endswith("}")
    parsed = F.try_parse_json(text)
    return (
        F.when(null_if_empty(event_type).isNull(), "not a change event")
        .when(F.coalesce(text, F.lit("")) == "", "no document")
        .when(parsed.isNull(), "malformed payload")
        .when(text.startswith("[") & text.endswith("]"), "decode failed")
        .when(~is_object, "malformed payload")
    )


def mark_malformed(envelopes: DataFrame) -> DataFrame:
    """Envelopes with ``_reason``, for ``quarantine_malformed`` to split once they are stored."""
    return envelopes.withColumn("_reason", malformed_reason())


def quarantine_malformed(envelopes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(readable, quarantined)``; the second has the reason and is not retried.

    Envelopes that are marked already are not parsed again.
    """
    marked = (envelopes if "_reason" in envelopes.columns else mark_malformed(envelopes)).drop("reason")
    bad = marked.where("_reason IS NOT NULL").withColumnRenamed("_reason", "reason")
    return marked.where("_reason IS NULL").drop("_reason"), bad


# --- decoding ------------------------------------------------------------------


def fields_schema(columns: Iterable[ColumnSpec]) -> T.StructType:
    """JSON schema of just the document fields that columns are taken from.

    Paths have at most two steps; a section is read through its map value.
    """
    sections: dict[str, T.StructType] = {}
    out: dict[str, T.DataType] = {}
    for column in columns:
        if column.derived:
            continue
        head, _, tail = column.source.partition(".")
        leaf = value_schema(column.kind)
        if tail:
            inner = sections.setdefault(head, T.StructType())
            if tail not in inner.names:
                inner.add(tail, leaf)
            fields = T.StructType([T.StructField("fields", inner)])
            out[head] = T.StructType([T.StructField("mapValue", fields)])
        else:
            out.setdefault(head, leaf)
    return T.StructType([T.StructField(name, kind) for name, kind in out.items()])


def _body_schema() -> T.StructType:
    """The body with its documents left as text: only one side is parsed, later."""
    text = T.StringType()
    document = T.StructType([T.StructField(n, text) for n in ("name", "createTime", "updateTime", "fields")])
    mask = T.StructType([T.StructField("fieldPaths", T.ArrayType(text))])
    return T.StructType(
        [
            T.StructField("value", document),
            T.StructField("oldValue", document),
            T.StructField("updateMask", mask),
        ]
    )


def _path_in(root: Column, path: str) -> Column:
    head, _, tail = path.partition(".")
    return root[head]["mapValue"]["fields"][tail] if tail else root[head]


@lru_cache(maxsize=32)
def _reading(context: SparkContext, columns: tuple[ColumnSpec, ...]) -> tuple[Column, Column | None, tuple[Column, ...]]:
    """The parsed document, its nested values as text and the columns' values, cast.

    Building these many expressions takes longer than planning them, so they are kept
    for the next batch.
    """
    document = F.from_json("document_text", fields_schema(columns), _STRICT_JSON)
    values = [_path_in(F.col("_document"), c.source) for c in columns]
    # Nested values are read in Python, those of all columns in one call; most rows have none.
    texts, plain = [i for i, c in enumerate(columns) if c.kind in TEXT_KINDS], None
    if texts:
        nested = F.array(*[nested_value(values[i]) for i in texts])
        plain = plain_texts(F.when(F.exists(nested, lambda x: x.isNotNull()), nested))
    cast = [coerce_column(value, c.kind, F.get("_nested", F.lit(texts.index(i))) if i in texts else None)
            for i, (value, c) in enumerate(zip(values, columns, strict=True))]
    return F.inline(F.array(F.struct(document.alias("_document")))), plain, tuple(cast)


def _with_values(changes: DataFrame, columns: Iterable[ColumnSpec]) -> tuple[DataFrame, dict[str, Column]]:
    """Changes with what is read from their documents, and the columns' values, cast.

    The document is parsed once, with a schema of only these fields.
    """
    columns = tuple(columns)
    document, plain, cast = _reading(changes.sparkSession.sparkContext, columns)
    parsed = changes.select("*", document)
    if plain is not None:
        parsed = parsed.withColumn("_nested", plain)
    return parsed, {c.name: value for c, value in zip(columns, cast, strict=True)}


def document_values(changes: DataFrame, **paths: str) -> DataFrame:
    """Changes with fields of their documents as text columns; a broken path gives NULL."""
    columns = [ColumnSpec(name, specs.STRING, path) for name, path in paths.items()]
    parsed, values = _with_values(changes, columns)
    return parsed.select(*changes.columns, *[value.alias(name) for name, value in values.items()])


def resolve_operation(event_type: Column | str, has_value: Column, has_old: Column) -> Column:
    """By event type, else by which side of the change is present."""
    kind = as_col(event_type)
    named = None
    for name, operation in OPERATIONS.items():
        named = F.when(kind == name, operation) if named is None else named.when(kind == name, operation)
    return (
        named.when(has_value & ~has_old, "insert")
        .when(has_old & ~has_value, "delete")
        .otherwise("update")
    )


def split_document_name(name: Column | str) -> dict[str, Column]:
    """Database, collection, path and id of a resource name."""
    text = as_col(name)
    parts = F.split(text, "/")
    place = F.array_position(parts, "documents")
    tail = F.when(place > 0, F.slice(parts, place.cast("int") + 1, F.greatest(F.size(parts), F.lit(1))))
    base = F.array_position(parts, "databases")
    empty = F.lit("")
    return {
        "database": F.coalesce(F.when(base > 0, F.get(parts, base.cast("int"))), empty),
        "collection": F.coalesce(F.get(tail, F.lit(0)), empty),
        "document_path": F.coalesce(F.array_join(tail, "/"), empty),
        "document_id": F.coalesce(F.get(tail, F.size(tail) - 1), empty),
        "path_length": F.coalesce(F.size(tail), F.lit(0)),
    }


def resolve_commit_time(value_time: Column, old_time: Column, event_time: Column, now: Column) -> Column:
    return F.coalesce(parse_instant(value_time), parse_instant(old_time), event_time, now)


def _present(document: Column) -> Column:
    """A side counts as present when it has any content."""
    return F.coalesce(
        document["name"].isNotNull() | document["updateTime"].isNotNull()
        | document["createTime"].isNotNull() | document["fields"].isNotNull(),
        F.lit(False),
    )


def decode_events(
    envelopes: DataFrame, received_at: Column | str | None = None, with_raw: bool = True
) -> DataFrame:
    """Envelopes to change rows.

    ``document_text`` is the effective document (the old one for deletes) as
    JSON text of typed values; ``document_json`` is its plain form.
    """
    # Generated rather than projected: a filter on what was decoded is then not
    # pushed below the parse, which would repeat the parse for every column used.
    body = F.from_json("body", _body_schema(), _STRICT_JSON)
    parsed = envelopes.select("*", F.inline(F.array(body)).alias("_value", "_old", "_mask"))
    value, old = F.col("_value"), F.col("_old")
    has_value, has_old = _present(value), _present(old)
    name = F.coalesce(null_if_empty(value["name"]), null_if_empty(old["name"]), F.lit(""))
    event_time = parse_instant("event_time")
    now = F.current_timestamp() if received_at is None else F.lit(received_at).cast("timestamp")
    deleted = F.col("operation") == "delete"
    decoded = (
        parsed.withColumn("operation", resolve_operation("event_type", has_value, has_old))
        .withColumns(split_document_name(name))
        .withColumn("event_at", event_time)
        .withColumn(
            "change_timestamp",
            resolve_commit_time(value["updateTime"], old["updateTime"], event_time, now),
        )
        .withColumn("document_text", F.when(deleted, old["fields"]).otherwise(value["fields"]))
        .withColumn("updated_fields", F.coalesce("_mask.fieldPaths", F.array().cast("array<string>")))
        .withColumn("sequence", change_sequence("change_timestamp"))
        .withColumn("sequence_hex", change_sequence_hex("change_timestamp"))
        .withColumn("is_delete", deleted)
        .drop("body", "_value", "_old", "_mask")
    )
    if with_raw:
        decoded = decoded.withColumn("document_json", decode_document("document_text"))
    return decoded


# --- routing and projecting ------------------------------------------------------


def routed_tables(collection: Column | str, routes: dict[str, tuple[TableSpec, ...]] = ROUTES) -> Column:
    """Names of the tables a collection is replicated into; NULL if none."""
    name = as_col(collection)
    out = None
    for known, tables in routes.items():
        names = F.array(*[F.lit(t.name) for t in tables])
        out = F.when(name == known, names) if out is None else out.when(name == known, names)
    return out


def route_changes(changes: DataFrame, routes: dict[str, tuple[TableSpec, ...]] = ROUTES) -> DataFrame:
    """One row per (change, destination).

    Unknown collections and documents below the top level are left out.
    """
    return changes.where(F.col("path_length") == 2).withColumn(
        "destination", F.explode(routed_tables("collection", routes))
    )


def for_table(changes: DataFrame, spec: TableSpec, routes: dict[str, tuple[TableSpec, ...]] = ROUTES) -> DataFrame:
    """The changes that go to one table, without fanning the others out."""
    sources = [c for c, tables in routes.items() if spec in tables]
    return changes.where((F.col("path_length") == 2) & F.col("collection").isin(sources))


_DERIVED = {
    specs.DOCUMENT_ID: "document_id", specs.OPERATION: "operation",
    specs.CHANGE_TIME: "change_timestamp", specs.RAW: "document_json",
}


def extract_columns(changes: DataFrame, spec: TableSpec, *extra: str) -> DataFrame:
    """Project changes into a table's columns, cast to their types.

    The document is parsed once, with a schema of only this table's fields.
    """
    parsed, values = _with_values(changes, [c for c in spec.columns if not c.derived])
    columns = [F.col(_DERIVED[c.source]) if c.derived else values[c.name] for c in spec.columns]
    return parsed.select(*[col.alias(c.name) for col, c in zip(columns, spec.columns)], *extra)


# --- ledger ------------------------------------------------------------------------


def ledger_rows(changes: DataFrame, spec: TableSpec = specs.ORDERS_LEDGER) -> DataFrame:
    """Every change as a ledger row, deletes with the old document."""
    return extract_columns(for_table(changes, spec), spec)


def ledger_schema(spec: TableSpec = specs.ORDERS_LEDGER) -> T.StructType:
    return T.StructType([*spec.schema.fields, T.StructField("change_date", T.DateType())])


def append_ledger(rows: DataFrame, path: str, batch_id: int, spec: TableSpec = specs.ORDERS_LEDGER,
                  channel: str = days.CHANNELS[0]) -> None:
    """Append a batch to the ledger, whose days hold one folder per batch.

    A batch owns its folders, so repeating it replaces what it wrote.
    """
    dated = rows.withColumn("change_date", F.to_date(spec.partition_by))
    days.write_days(dated, path, batch_id, F.col("change_date"), channel, spec.cluster_by)


def read_ledger(spark: SparkSession, path: str, only: Iterable[str] | None = None,
                spec: TableSpec = specs.ORDERS_LEDGER) -> DataFrame:
    """The ledger's rows; ``only`` names days, and no others are listed."""
    return days.read_days(spark, path, ledger_schema(spec), only)


def fold_ledger(spark: SparkSession, path: str, least: int = 8, spec: TableSpec = specs.ORDERS_LEDGER) -> list[str]:
    """Fold the small files of days that have at least ``least`` folders."""
    return days.fold_days(spark, path, ledger_schema(spec), F.col("change_date"), least, spec.cluster_by)


def dedupe_redelivery(envelopes: DataFrame) -> DataFrame:
    """One delivery of each event id; an event without an id is kept as often as it comes.

    For a stream, ``start_ingest(dedupe=True)`` keeps repeated ids out of the ledger
    alone: dropping events by their lateness would lose changes.
    """
    if envelopes.isStreaming:
        raise ValueError("streams are deduplicated by start_ingest(dedupe=True)")
    named = envelopes.where(F.col("event_id").isNotNull()).dropDuplicates(["event_id"])
    return named.unionByName(envelopes.where(F.col("event_id").isNull()))


# --- mirrors -----------------------------------------------------------------------

CONTROL = ["_sequence", "_is_delete", "_arrival"]


def mirror_changes(changes: DataFrame, spec: TableSpec, arrival: str = "event_id") -> DataFrame:
    """Table columns with what orders the versions of a key.

    A delete carries the commit time of the version it deletes, so at the same
    sequence it comes after the upsert.  A delete keeps the key column only.
    """
    rows = for_table(changes, spec)
    columns = extract_columns(
        rows, spec, "sequence", "is_delete", F.col(arrival).cast("string").alias("_arrival")
    )
    kept = [
        F.col(c.name) if c.name == spec.key else F.when(~F.col("is_delete"), F.col(c.name)).alias(c.name)
        for c in spec.columns
    ]
    return columns.select(
        *kept, F.col("sequence").alias("_sequence"), F.col("is_delete").alias("_is_delete"), "_arrival"
    )


def _newest(rows: DataFrame, key: str, order: Iterable[str]) -> DataFrame:
    """One row per key, the last by ``order``.

    The rank filter runs before the shuffle too, so a key with very many versions
    sends one row per task.
    """
    by = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_place", F.row_number().over(by)).where("_place = 1").drop("_place")


def newest_changes(changes: DataFrame, arrival: str = "event_id") -> DataFrame:
    """Per document the change with the greatest (sequence, delete, arrival), not yet decoded."""
    columns = [c for c in changes.columns if c != "document_json"]
    return _newest(changes.select(*columns), "document_id", ["sequence", "is_delete", arrival])


def upsert_winners(changes: DataFrame, key: str) -> DataFrame:
    """Per key the version with the greatest (sequence, delete, arrival).

    Tombstones stay, so a late older upsert cannot bring a deleted key back.
    """
    return _newest(changes, key, CONTROL)


def live_rows(winners: DataFrame) -> DataFrame:
    """The mirror itself: winners that are not deletes, without control columns."""
    return winners.where(~F.col("_is_delete")).drop(*CONTROL)


def upsert_current(changes: DataFrame, spec: TableSpec, arrival: str = "event_id") -> DataFrame:
    """Current state of a keyed table from any set of changes, in any order.

    The newest change of each document is found before documents are decoded.
    """
    newest = newest_changes(for_table(changes, spec), arrival).where(~F.col("is_delete"))
    return live_rows(mirror_changes(newest, spec, arrival))


def merge_mirror(base: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Winners of a stored state (with tombstones) and a new batch.

    An older sequence never replaces a newer one.
    """
    return upsert_winners(base.unionByName(batch), key)


# --- backfill ------------------------------------------------------------------------


def backfill_changes(snapshot: DataFrame, now: Column | str) -> DataFrame:
    """A full walk of documents as insert changes.

    ``snapshot`` has name, update_time and fields (JSON text of typed values).
    Sequenced by the document's own update time, so replaying it over newer
    changes does nothing, and documents that are gone stay untouched.
    """
    body = F.to_json(
        F.struct(
            F.struct(
                F.col("name"), F.col("update_time").alias("updateTime"),
                F.try_parse_json("fields").alias("fields"),
            ).alias("value")
        )
    )
    envelopes = snapshot.select(
        F.concat(F.lit("backfill:"), F.col("name")).alias("event_id"),
        F.lit(next(iter(OPERATIONS))).alias("event_type"),
        F.lit(None).cast("string").alias("event_time"),
        body.alias("body"),
    )
    return decode_events(envelopes, received_at=now)


def ensure_tables(spark: SparkSession, root: str, tables: Iterable[TableSpec] | None = None) -> DataFrame:
    """Create missing destinations as empty tables; report (table_name, status)."""
    results = []
    for spec in tables if tables is not None else all_specs():
        path = f"{root}/{spec.name}"
        try:
            if not snapshots.exists(spark, path):
                empty = spark.createDataFrame([], spec.schema)
                snapshots.write_version(empty, path)
            results.append((spec.name, "ready"))
        except Exception as err:  # one table's trouble must not hide the others
            results.append((spec.name, f"error: {err}"))
    return spark.createDataFrame(results, "table_name string, status string")


# --- traces ---------------------------------------------------------------------------


def order_trace(
    changes: DataFrame,
    received_at: str = "received_at",
    write_ms: Column | str = "write_ms",
    prefix: str = TRACE_PREFIX,
    routes: dict[str, tuple[TableSpec, ...]] = ROUTES,
) -> DataFrame:
    """How long an order took to be replicated, for ids with the traced prefix."""
    received = F.col(received_at)
    gap = (F.unix_micros(received) - F.unix_micros("event_at")) / 1000.0
    delivery = F.when(F.col("event_at").isNotNull(), F.greatest(gap, F.lit(0.0)))
    written = as_col(write_ms)
    traced = document_values(changes.where(F.col("document_id").startswith(prefix)), _customer="customerId")
    return traced.select(
        F.concat(F.lit("order_"), F.col("document_id")).alias("trace_id"),
        F.lit("ORDER").alias("kind"),
        F.col("document_id").alias("order_id"),
        F.col("_customer").alias("customer_id"),
        "event_id",
        F.col("event_at").alias("event_time"),
        received.alias("received_at"),
        F.round(delivery, 2).alias("delivery_ms"),
        F.round(written, 2).alias("write_ms"),
        F.round(F.coalesce(delivery, F.lit(0.0)) + written, 2).alias("total_ms"),
        F.array_join(F.array_sort(routed_tables("collection", routes)), ",").alias("tables"),
        "operation",
        received.alias("recorded_at"),
        (received + F.expr(f"INTERVAL '{TRACE_TTL_DAYS}' DAY")).alias("expire_at"),
    )
