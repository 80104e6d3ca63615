"""Keyed streaming operators: login reuse and revision dedupe.

State is one small record per key.  A micro-batch's rows of a key arrive in
Arrow chunks; the size of a micro-batch is bounded at the source
(``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``), and with it what one key can
bring to one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tideline.operators.sessions import REUSE_SECONDS

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_ASSIGNED = "session_id string, customer_id string, assigned_session_id string, started_us long"
_REVISIONS = "id string, update_time string, arrival long"


def use_state_store(spark: SparkSession) -> None:
    """Keyed state of this kind needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


class _LoginReuse(StatefulProcessor):
    """Keeps the start and the id of each customer's open session."""

    def __init__(self, age_us: int, ttl_ms: int | None):
        self._age_us = age_us
        self._ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._open = handle.getValueState("open", "at long, id string", self._ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        chunk = pd.concat(list(rows)).sort_values(["at_us", "session_id"], kind="stable")
        times, ids = chunk["at_us"].to_numpy(), chunk["session_id"].to_numpy()
        at, name = self._open.get() if self._open.exists() else (None, None)
        starts, holders = [], []
        for moment, session in zip(times.tolist(), ids.tolist()):
            if at is None or moment > at + self._age_us:
                at, name = moment, session
            starts.append(at)
            holders.append(name)
        self._open.update((at, name))
        yield pd.DataFrame(
            {"session_id": ids, "customer_id": key[0], "assigned_session_id": holders, "started_us": starts}
        )

    def close(self) -> None:
        pass


def assign_logins_stream(
    logins: DataFrame, max_age_seconds: float = REUSE_SECONDS, state_ttl_seconds: int | None = None
) -> DataFrame:
    """Streaming replay of logins: the session each one belongs to.

    Rows of one micro-batch are handled in time order; a login that arrives
    after a later one joins the session that is open then.  With a time to live
    the state of customers that stay away is dropped; such a query runs on
    processing time and does not end by itself.
    """
    use_state_store(logins.sparkSession)
    rows = logins.where(
        F.col("customer_id").isNotNull() & F.col("login_timestamp").isNotNull()
    ).select("session_id", "customer_id", F.unix_micros("login_timestamp").alias("at_us"))
    ttl_ms = state_ttl_seconds * 1000 if state_ttl_seconds else None
    processor = _LoginReuse(int(max_age_seconds * 1_000_000), ttl_ms)
    assigned = rows.groupBy("customer_id").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=_ASSIGNED, outputMode="Append",
        timeMode="ProcessingTime" if ttl_ms else "None",
    )
    return assigned.select(
        "session_id", "customer_id", "assigned_session_id",
        F.timestamp_micros("started_us").alias("session_started_at"),
        (F.col("session_id") != F.col("assigned_session_id")).alias("reused"),
    )


class _RevisionDedupe(StatefulProcessor):
    """Keeps the last revision stamp seen of each document."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._seen = handle.getValueState("seen", "stamp string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        chunk = pd.concat(list(rows)).sort_values("arrival", kind="stable")
        stamps = chunk["update_time"].fillna("")
        first = self._seen.get()[0] if self._seen.exists() else None
        before = stamps.shift(1)
        before.iloc[0] = first
        fresh = chunk[(stamps != before).to_numpy()]
        self._seen.update((stamps.iloc[-1],))
        if len(fresh):
            yield fresh[["id", "update_time", "arrival"]]

    def close(self) -> None:
        pass


def new_revisions_stream(deliveries: DataFrame) -> DataFrame:
    """Streaming form: deliveries that show another revision than the last seen."""
    use_state_store(deliveries.sparkSession)
    return (
        deliveries.select("id", F.col("update_time").cast("string").alias("update_time"), "arrival")
        .groupBy("id")
        .transformWithStateInPandas(
            statefulProcessor=_RevisionDedupe(), outputStructType=_REVISIONS,
            outputMode="Append", timeMode="None",
        )
    )
