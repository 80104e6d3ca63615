"""Login sessions: documents, reuse and outcomes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.policy import SESSION_TTL_DAYS
from tideline.functions.scalars import as_col, null_if_empty, parse_instant
from tideline.operators.retention import at, days
from tideline.operators.skew import split_large

REUSE_SECONDS = 120
IN_FLIGHT = ["PENDING", "PROCESSING"]
TERMINAL = ["PROCESSED", "SKIPPED", "ERROR"]

# A customer with more logins than this is split into time blocks.  Fewer are
# replayed as a stream of sorted rows, which keeps one session in memory.
LARGE_LOGINS = 1_000_000


def reuse_age(setting: str | float | None) -> float:
    """Configured reuse age in seconds; a bad or non-positive one means 120."""
    try:
        value = float(setting)
    except (TypeError, ValueError):
        return float(REUSE_SECONDS)
    return value if value > 0 else float(REUSE_SECONDS)


def _instant(df: DataFrame, column: str) -> Column:
    if df.schema[column].dataType.typeName() == "string":
        return parse_instant(column)
    return F.col(column).cast("timestamp")


def session_started_at(sessions: DataFrame) -> Column:
    """First readable of login_timestamp, login_at and created_at."""
    fields = [c for c in ("login_timestamp", "login_at", "created_at") if c in sessions.columns]
    return F.coalesce(*[_instant(sessions, c) for c in fields])


def resolve_customer(requests: DataFrame, principals: DataFrame, strict: bool) -> DataFrame:
    """Principal short name to customer id.

    ``strict`` (a login) keeps unknown principals with a NULL customer and a
    rejection; otherwise (a listing) the name passes through unchanged.
    """
    known = principals.select("principal_id", F.col("customer_id").alias("_customer"))
    joined = requests.join(known, "principal_id", "left")
    if strict:
        return joined.withColumn(
            "rejection", F.when(F.col("_customer").isNull(), F.lit("UNKNOWN_PRINCIPAL"))
        ).withColumnRenamed("_customer", "customer_id")
    return joined.withColumn("customer_id", F.coalesce("_customer", "principal_id")).drop("_customer")


def session_documents(logins: DataFrame, principals: DataFrame) -> DataFrame:
    """The 15-column PENDING session a login writes.

    ``logins`` has session_id, principal_id and login_timestamp; ``principals``
    has principal_id, customer_id, iam_principal and customer_name.  Logins of
    unknown principals write none.
    """
    moment = F.col("login_timestamp")
    nothing = F.lit(None).cast("string")
    return logins.join(principals, "principal_id").select(
        "session_id", "customer_id", "principal_id", "iam_principal", "customer_name",
        F.lit("PENDING").alias("agent_processing_status"), F.lit("PENDING").alias("status"),
        moment.alias("login_timestamp"), moment.alias("login_at"), moment.alias("created_at"),
        (moment + days(SESSION_TTL_DAYS)).alias("expire_at"), F.lit("MOBILE_APP").alias("channel"),
        nothing.alias("offer_id"), nothing.alias("active_offer_id"), nothing.alias("skip_reason"),
    )


def in_flight_session(
    customers: DataFrame, sessions: DataFrame, now: str, max_age_seconds: float = REUSE_SECONDS
) -> DataFrame:
    """Each customer's freshest unfinished session that is recent enough to reuse."""
    started = session_started_at(sessions)
    edge = F.timestamp_micros(F.unix_micros(at(now)) - int(max_age_seconds * 1_000_000))
    fresh = (
        sessions.where(F.col("agent_processing_status").isin(IN_FLIGHT))
        .withColumn("_started", started)
        .where(F.col("_started") >= edge)
        .groupBy("customer_id")
        .agg(F.max(F.struct("_started", "session_id", "agent_processing_status")).alias("s"))
        .select(
            "customer_id", F.col("s.session_id").alias("session_id"),
            F.col("s._started").alias("started_at"), F.col("s.agent_processing_status").alias("session_status"),
        )
    )
    return customers.join(fresh, "customer_id", "left")


def session_outcome(sessions: DataFrame) -> DataFrame:
    """Outcome of the finished sessions."""
    return sessions.where(F.col("agent_processing_status").isin(TERMINAL)).withColumn(
        "outcome",
        F.when(null_if_empty("offer_id").isNotNull(), "OFFER").otherwise(
            F.coalesce(null_if_empty("skip_reason"), F.lit("NO_OFFER"))
        ),
    )


# --- replaying logins -------------------------------------------------------
#
# A login within the reuse age of the *start* of the customer's session joins
# that session, otherwise it starts one.  Starts depend on earlier starts, so
# rows are visited in order; a task only keeps the running start per customer.

_MARK_SCHEMA = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("customer_id", T.StringType()),
        T.StructField("started_us", T.LongType()),
        T.StructField("assigned_session_id", T.StringType()),
    ]
)


def _mark_sorted(batches: Iterator[pd.DataFrame], age_us: int) -> Iterator[pd.DataFrame]:
    """Mark rows sorted by (customer, block, time); carry the open session over batches.

    A gap longer than the reuse age always starts a session, so a batch falls
    into runs without such gaps.  A run no longer than the reuse age is one
    session; only longer runs, and runs entered with a session still open, are
    stepped through, one step per session.
    """
    key: tuple | None = None
    open_at: int | None = None
    open_id: str | None = None
    for batch in batches:
        n = len(batch)
        if n == 0:
            continue
        customers = batch["customer_id"].to_numpy()
        blocks = batch["_block"].to_numpy()
        times = batch["_at"].to_numpy()
        ids = batch["session_id"].to_numpy()
        entered = batch["_entry_id"].notna().to_numpy()
        entry_at = batch["_entry_at"].to_numpy()
        entry_id = batch["_entry_id"].to_numpy()

        new_key = np.r_[True, (customers[1:] != customers[:-1]) | (blocks[1:] != blocks[:-1])]
        head = new_key | np.r_[True, np.diff(times) > age_us]
        first = np.flatnonzero(head)
        last = np.r_[first[1:], n]
        run_of = np.cumsum(head) - 1
        starts = times[first][run_of]
        holders = ids[first][run_of]

        step = np.zeros(len(first), dtype=bool)
        step[run_of[times > starts + age_us]] = True
        step |= new_key[first] & entered[first]
        continues = key == (customers[0], blocks[0])
        step[0] |= continues
        for r in np.flatnonzero(step):
            i, end = int(first[r]), int(last[r])
            at, name = None, None
            if r == 0 and continues:
                at, name = open_at, open_id
            elif new_key[i] and entered[i]:
                at, name = int(entry_at[i]), entry_id[i]
            while i < end:
                if at is None or times[i] > at + age_us:
                    at, name = int(times[i]), ids[i]
                j = i + int(np.searchsorted(times[i:end], at + age_us, side="right"))
                starts[i:j] = at
                holders[i:j] = name
                i = j
        key = (customers[-1], blocks[-1])
        open_at, open_id = int(starts[-1]), holders[-1]
        yield pd.DataFrame(
            {
                "session_id": ids, "customer_id": customers,
                "started_us": starts, "assigned_session_id": holders,
            }
        )


def _chain_ends(jump: np.ndarray) -> np.ndarray:
    """For each position, the last session start reached when a session starts there.

    ``jump`` names the next start of each position, the position itself where there is none.
    """
    while True:
        further = jump[jump]
        if np.array_equal(further, jump):
            return jump
        jump = further


def _block_exits(rows: pd.DataFrame, age_us: int, block_us: int) -> pd.DataFrame:
    """How each block of each customer maps the open session it is entered with.

    Candidates are the logins near the end of the block before.  The result has
    one row per run of candidates that leads to the same first start, and one
    for entering without an open session.  ``rows`` are sorted by customer, block
    and time; all blocks are searched at once, each in a range of its own.
    """
    customers, blocks = rows["customer_id"].to_numpy(), rows["_block"].to_numpy()
    times, own = rows["_at"].to_numpy(), rows["_own"].to_numpy(dtype=bool)
    new = np.r_[True, (customers[1:] != customers[:-1]) | (blocks[1:] != blocks[:-1])]
    heads, group = np.flatnonzero(new), np.cumsum(new) - 1
    # Own times lie in [0, block), candidates in [-age, 0) of their block's range.
    place = group * (block_us + 2 * age_us) + (times - blocks * block_us)
    mine, at, held = group[own], times[own], place[own]
    begins = np.searchsorted(mine, np.arange(len(heads)), side="left")
    ends = np.searchsorted(mine, np.arange(len(heads)), side="right")
    following = np.searchsorted(held, held + age_us, side="right")
    exits = at[_chain_ends(np.where(following < ends[mine], following, np.arange(len(held))))]

    entry_group, entry_at = group[~own], times[~own]
    first = np.searchsorted(held, place[~own] + age_us, side="right")
    run = np.flatnonzero(np.r_[True, (entry_group[1:] != entry_group[:-1]) | (first[1:] != first[:-1])][:len(first)])
    last = np.r_[run[1:], len(first)][:len(run)] - 1
    of, reached = entry_group[run], first[run]
    covered = reached == ends[of]
    leave = np.where(covered, 0, exits[np.where(covered, 0, reached)])
    none, no = np.zeros(len(heads), dtype=np.int64), np.zeros(len(heads), dtype=bool)
    return pd.DataFrame({
        "customer_id": np.r_[customers[heads], customers[heads[of]]], "_block": np.r_[blocks[heads], blocks[heads[of]]],
        "_fresh": np.r_[~no, np.zeros(len(run), dtype=bool)], "_lo": np.r_[none, entry_at[run]],
        "_hi": np.r_[none, entry_at[last]], "_exit": np.r_[exits[begins], leave], "_covered": np.r_[no, covered],
    })


def _whole_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of sorted batches again, cut between blocks only."""
    kept: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        customers, blocks = batch["customer_id"].to_numpy(), batch["_block"].to_numpy()
        # Where the last block of the batch begins.
        other = np.flatnonzero((customers != customers[-1]) | (blocks != blocks[-1]))
        cut = int(other[-1]) + 1 if len(other) else 0
        if kept and (cut or kept[-1]["customer_id"].iloc[-1] != customers[0] or kept[-1]["_block"].iloc[-1] != blocks[0]):
            yield pd.concat([*kept, batch.iloc[:cut]], ignore_index=True)
            kept = []
        elif cut:
            yield batch.iloc[:cut]
        kept.append(batch.iloc[cut:])
    if kept:
        yield pd.concat(kept, ignore_index=True)


_SEEN = ["customer_id", "_block", "_at", "_own"]
_EXIT_SCHEMA = (
    "customer_id string, _block long, _fresh boolean, _lo long, _hi long, _exit long, _covered boolean"
)
_ENTRY_SCHEMA = "customer_id string, _block long, _entry_at long"


def _fold_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walk each customer's blocks in order; the open session each is entered with.

    Rows come sorted by customer, block, the one without an open session first.
    """
    key: tuple | None = None
    open_start: int | None = None  # the session open where the block of ``key`` begins
    leave: int | None = None  # and where it ends
    entered = False

    def frame(out: list[tuple]) -> pd.DataFrame:
        made = pd.DataFrame(out, columns=["customer_id", "_block", "_entry_at"])
        made["_entry_at"] = made["_entry_at"].astype("Int64")
        return made

    for batch in batches:
        out = []
        for customer, block, fresh, lo, hi, gone, covered in zip(*[batch[c].tolist() for c in (
                "customer_id", "_block", "_fresh", "_lo", "_hi", "_exit", "_covered")]):
            if fresh:
                if key is not None:
                    out.append((*key, open_start if entered else None))
                follows = key is not None and key[0] == customer and key[1] == block - 1
                key, open_start, leave, entered = (customer, block), leave if follows else None, gone, False
            elif open_start is not None and lo <= open_start <= hi:
                entered, leave = True, open_start if covered else gone
        if out:
            yield frame(out)
    if key is not None:
        yield frame([(*key, open_start if entered else None)])


def _entries_of_blocks(hot: DataFrame, age_us: int, block_us: int) -> DataFrame:
    """Per (customer, block) of the split customers: the session open at its start."""
    slim = hot.select("customer_id", "_at", "_block").distinct()
    own = slim.withColumn("_own", F.lit(True))
    into_next = F.pmod(F.col("_at"), F.lit(block_us)) >= block_us - age_us
    tails = slim.where(into_next).select(
        "customer_id", "_at", (F.col("_block") + 1).alias("_block"), F.lit(False).alias("_own")
    )
    # A tail only matters where its next block has logins of its own.
    busy = slim.select("customer_id", "_block").distinct()
    seen = own.unionByName(tails.join(busy, ["customer_id", "_block"], "left_semi"))
    # Blocks are small and many, so a task takes its sorted rows in batches, not by groups.
    exits = (
        seen.select(*_SEEN).repartition("customer_id", "_block").sortWithinPartitions("customer_id", "_block", "_at")
        .mapInPandas(lambda it: (_block_exits(rows, age_us, block_us) for rows in _whole_blocks(it)), _EXIT_SCHEMA)
    )
    walked = exits.repartition("customer_id").sortWithinPartitions("customer_id", "_block", F.desc("_fresh"), "_lo")
    return walked.mapInPandas(_fold_blocks, _ENTRY_SCHEMA)


def assign_logins(
    logins: DataFrame,
    max_age_seconds: float = REUSE_SECONDS,
    min_rows: int = LARGE_LOGINS,
    block_seconds: int | None = None,
) -> DataFrame:
    """Replay logins: the session each one ends up in, and whether it started it.

    Customers with very many logins are cut into time blocks that are replayed
    side by side.  What a block needs from the one before it is the start of
    the session still open, which a small per-block summary provides.
    """
    age_us = int(max_age_seconds * 1_000_000)
    block_us = int((block_seconds or max(900, 2 * max_age_seconds)) * 1_000_000)
    if block_us < age_us:
        raise ValueError("a block must be at least as long as the reuse age")
    rows = logins.where(
        F.col("customer_id").isNotNull() & F.col("login_timestamp").isNotNull()
    ).select("session_id", "customer_id", F.unix_micros("login_timestamp").alias("_at"))
    cold, hot = split_large(rows, "customer_id", min_rows)
    hot = hot.withColumn("_block", F.floor(F.col("_at") / block_us))
    entries = _entries_of_blocks(hot, age_us, block_us)
    # The session holding an entry instant is named by its first login there.
    names = hot.groupBy("customer_id", F.col("_at").alias("_entry_at")).agg(
        F.min("session_id").alias("_entry_id")
    )
    named = entries.join(names, ["customer_id", "_entry_at"], "left")
    hot_rows = hot.join(named, ["customer_id", "_block"], "left")
    cold_rows = cold.select(
        "*", F.lit(0).cast("bigint").alias("_block"),
        F.lit(None).cast("bigint").alias("_entry_at"), F.lit(None).cast("string").alias("_entry_id"),
    )
    columns = ["session_id", "customer_id", "_at", "_block", "_entry_at", "_entry_id"]
    ordered = (
        cold_rows.select(*columns).unionByName(hot_rows.select(*columns))
        .withColumn("_entry_at", F.coalesce("_entry_at", F.lit(0)))
        .repartition("customer_id", "_block")
        .sortWithinPartitions("customer_id", "_block", "_at", "session_id")
    )
    marked = ordered.mapInPandas(lambda it: _mark_sorted(it, age_us), _MARK_SCHEMA)
    return marked.select(
        "session_id", "customer_id", "assigned_session_id",
        F.timestamp_micros("started_us").alias("session_started_at"),
        (F.col("session_id") != F.col("assigned_session_id")).alias("reused"),
    )
