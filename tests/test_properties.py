"""Properties that hold for any data: order of events, skew, retries."""

import datetime as dt
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from tideline.operators import features, history, ingest, operations, scoring, sessions, skew
from tideline.plans import ingest_queries as iq, registry
from tideline.plans.fixtures import CUTOFF, NOW, TODAY, Tables
from tideline.plans.churn_run import ChurnStore, run_churn_pipeline
from tideline.session import work_dir
from tideline.sources import days, events, mirror, snapshots, specs
from tideline.streaming import ingest_stream
from tideline.streaming.ingest_stream import backfill, process_batch

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def one_hot_customer(spark, seed=7, n=3000):
    """A third of all orders belongs to one customer."""
    rng = np.random.default_rng(seed)
    customers = np.where(rng.random(n) < 1 / 3, 0, rng.integers(1, 200, n))
    data = [
        (f"o{i:05d}", f"c{c}", int(s), 500, float(v) / 100)
        for i, (c, s, v) in enumerate(zip(customers, rng.integers(0, 400 * 86400, n), rng.integers(100, 99999, n)))
    ]
    return spark.createDataFrame(
        data, "order_id string, customer_id string, at long, account_age_days int, grand_total double"
    ).withColumn("created_at", F.timestamp_seconds("at")).drop("at")


def test_history_of_a_hot_customer(spark):
    """The large customer's metrics do not depend on how rows are dealt out."""
    orders = one_hot_customer(spark)
    assert rows(history.order_history(orders)) == rows(history.order_history(orders.repartition(7, "order_id")))


def test_history_keeps_rows_with_gaps(spark):
    """Orders without a time, without an id, or given twice all stay."""
    data = [("a", "c", None, 1, 10.0)] * 8 + [(None, "c", f"2001-01-{d:02d} 00:00:00", 1, 5.0) for d in range(1, 25)]
    data += [("b", "c", "2001-05-01 00:00:00", 1, 1.0)] * 2
    orders = spark.createDataFrame(
        data, "order_id string, customer_id string, created_at string, account_age_days int, grand_total double"
    ).withColumn("created_at", F.col("created_at").cast("timestamp"))
    found = history.order_history(orders).collect()
    assert len(found) == len(data)
    assert sorted(r.order_sequence for r in found) == list(range(1, len(data) + 1))
    assert {r.prior_spend_90d for r in found if r.order_id == "a"} == {0.0}


def test_revisions_keep_null_keys_and_arrivals(spark):
    data = [(None, i, f"t{i}") for i in range(30)] + [("k", None, "x")] + [("k", i, f"t{i}") for i in range(10)]
    deliveries = spark.createDataFrame(data, "id string, arrival long, update_time string")
    for bucket in (None, F.floor(F.col("arrival") / 3)):
        assert operations.new_revisions(deliveries, bucket=bucket).count() == len(data)


def test_split_keeps_null_keys(spark):
    df = spark.createDataFrame([(None, i) for i in range(50)] + [("a", 1)], "k string, v int")
    small, large = skew.split_large(df, "k", 10)
    assert (small.count(), large.count()) == (1, 50)


def replay(times, age):
    """Brute force: one login after the other."""
    start, out = None, []
    for moment in times:
        if start is None or moment > start + age:
            start = moment
        out.append(start)
    return out


def test_login_replay_against_brute_force(spark):
    rng = np.random.default_rng(3)
    data = []
    for customer, count in (("hot", 4000), ("warm", 300), ("cold", 5)):
        times = sorted(rng.integers(0, 40_000 if customer == "hot" else 200_000, count).tolist())
        data += [(f"{customer}{i:05d}", customer, t) for i, t in enumerate(times)]
    logins = spark.createDataFrame(data, "session_id string, customer_id string, at long").withColumn(
        "login_timestamp", F.timestamp_seconds("at")
    )
    want = {}
    for customer in ("hot", "warm", "cold"):
        mine = [(s, t) for s, c, t in data if c == customer]
        want.update({s: start for (s, _), start in zip(mine, replay([t for _, t in mine], 120))})
    for limit, block in ((10_000, None), (100, 240), (100, 900)):
        marked = sessions.assign_logins(logins, 120, min_rows=limit, block_seconds=block)
        got = {r[0]: r[1] for r in marked.select("session_id", F.unix_seconds("session_started_at")).collect()}
        assert got == want


def test_blocks_are_walked_in_batches_of_any_size(spark):
    """Blocks and customers that are cut by batches; no Python call per block or customer."""
    rng = np.random.default_rng(11)
    data = [(f"{c}-{i:03d}", c, t) for c in ("a", "b", "c")
            for i, t in enumerate(sorted(rng.integers(0, 9_000, 150).tolist()))]
    logins = spark.createDataFrame(data, "session_id string, customer_id string, at long").withColumn(
        "login_timestamp", F.timestamp_seconds("at")
    )
    want = {}
    for customer in ("a", "b", "c"):
        mine = [(s, t) for s, c, t in data if c == customer]
        want.update({s: start for (s, _), start in zip(mine, replay([t for _, t in mine], 120))})
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for size in (1, 7, 10_000):
            spark.conf.set(name, size)
            marked = sessions.assign_logins(logins, 120, min_rows=0, block_seconds=120)
            assert {r[0]: r[1] for r in marked.select("session_id", F.unix_seconds("session_started_at")).collect()} == want
    finally:
        spark.conf.set(name, before)
    plan = marked._jdf.queryExecution().toString()
    assert "FlatMapGroupsIn" not in plan and "MapInPandas" in plan


def test_history_scans_keep_their_tasks(spark):
    """What a task sorts does not grow to the input's share of a core; odd rows keep their places."""
    rng = np.random.default_rng(5)
    day = 86_400
    at = [None if i % 11 == 0 else int(rng.integers(0, 500)) * day + int(rng.integers(0, 3)) for i in range(120)]
    data = [(None if i % 13 == 0 else f"o{i:03d}", "ab"[i % 2], a, 400, None if i % 17 == 5 else i * 1.25) for i, a in enumerate(at)]
    data += data[10:20]
    orders = spark.createDataFrame(data, "order_id string, customer_id string, at long, account_age_days int, grand_total double")
    got = history.order_history(orders.withColumn("created_at", F.timestamp_seconds("at")))
    assert got.rdd.getNumPartitions() == history.SCAN_TASKS
    want = []
    for customer in "ab":
        mine = sorted((r for r in data if r[1] == customer), key=lambda r: (r[2] is not None, r[2] or 0, r[0] is not None, r[0] or ""))
        for n, (name, _, t, _, _) in enumerate(mine):
            def since(days, mine=mine, n=n, t=t):
                return [r for r in mine[:n] if t is not None and r[2] is not None and r[2] >= t - days * day]
            want.append((name or "", customer, n + 1, round(sum(r[4] or 0 for r in since(90)), 2), len(since(365))))
    found = got.select("order_id", "customer_id", "order_sequence", "prior_spend_90d", "prior_orders_12m").collect()
    assert sorted((r[0] or "", *r[1:3], round(r[3], 2), r[4]) for r in found) == sorted(want)


def test_envelopes_are_packed_and_dealt_out(spark, tmp_path):
    """Stored envelopes take a fraction of their text, in files of bounded size."""
    t = Tables(spark, SF)
    made = iq.build_order_envelopes(t)
    assert "REPARTITION_BY_COL" in made._jdf.queryExecution().executedPlan().toString()
    stored = iq.order_envelopes(t)
    folder = stored.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    size = sum(f.stat().st_size for f in Path(folder).iterdir())
    assert size * 8 < made.agg(F.sum(F.length("body"))).first()[0]
    path = str(tmp_path / "some")
    events.write_envelopes(spark.range(2 * events.ENVELOPES_PER_FILE + 1, numPartitions=1).select(
        F.col("id").cast("string").alias("event_id"), F.lit("{}").alias("body")), path)
    back = events.read_change_events(spark, path)
    assert back.count() == back.distinct().count() == 2 * events.ENVELOPES_PER_FILE + 1
    assert len(back.inputFiles()) == 3


def test_orders_are_dealt_before_they_grow(spark, tmp_path):
    """No view of orders and no body is shuffled: the given columns are, and one row an event."""
    t = Tables(spark, SF)
    plan = plan_of(iq.build_order_envelopes(t))
    assert "hashpartitioning(o_orderkey" in plan and "hashpartitioning(order_key" not in plan
    made = iq.build_order_envelopes(t)
    dealt = iq.build_order_envelopes(t, 3)
    assert rows(made) == rows(dealt) and dealt.rdd.getNumPartitions() == 3
    # Bodies are made above the shuffle (plans are printed from the top).
    plan = plan_of(dealt)
    assert plan.index("Generate explode(array(") < plan.index("REPARTITION_BY_NUM")
    # The events of an order are dealt apart.
    place = dealt.select(F.split("event_id", "-")[1].alias("key"), F.spark_partition_id().alias("p"))
    assert place.groupBy("key").agg(F.countDistinct("p").alias("n")).where("n > 1").count() > 0


def test_batch_keeps_decoded_changes_in_packed_files(spark, tmp_path, monkeypatch):
    """A batch and a walk hold no documents in memory and leave no working files behind."""
    def refuse(*_):
        raise AssertionError("documents are kept in memory")

    monkeypatch.setattr(DataFrame, "persist", refuse)
    t, root = Tables(spark, SF), str(tmp_path / "tables")
    process_batch(iq.order_envelopes(t).where("event_id LIKE '%7-_'"), 0, root)
    backfill(iq._snapshot(t).where("name LIKE '%2'"), root, 0, NOW)
    assert not list((tmp_path / "tables" / "decoded").iterdir())
    assert ingest.read_ledger(spark, f"{root}/{specs.ORDERS_LEDGER.name}").where("order_status = 'WALKED'").count() > 0


def test_upsert_ignores_order_and_repeats(spark):
    t = Tables(spark, SF)
    readable = ingest.quarantine_malformed(iq.order_envelopes(t))[0]
    changes = ingest.decode_events(readable, received_at=NOW, with_raw=False)
    spec = specs.ORDERS_CURRENT
    once = ingest.upsert_current(changes, spec)
    shuffled = changes.unionByName(changes.where("hash(event_id) % 3 = 0")).orderBy(F.xxhash64("event_id"))
    assert rows(once) == rows(ingest.upsert_current(shuffled, spec))


def test_repeated_batch_changes_nothing(spark):
    t = Tables(spark, SF)
    root, spec = work_dir(spark, "mirror"), specs.ORDERS_CURRENT
    readable = ingest.quarantine_malformed(iq.order_envelopes(t))[0]
    changes = ingest.mirror_changes(ingest.decode_events(readable, received_at=NOW, with_raw=False), spec)
    winners = ingest.upsert_winners(changes, spec.key)
    mirror.write_batch(winners, root, spec, 0)
    first = rows(mirror.read_current(spark, root, spec))
    mirror.write_batch(winners, root, spec, 0)
    assert rows(mirror.read_current(spark, root, spec)) == first
    mirror.compact(spark, root, spec)
    mirror.write_batch(winners.where("_is_delete = false"), root, spec, 1)
    assert rows(mirror.read_current(spark, root, spec)) == first


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_mirror_buckets(spark):
    """Compacted buckets are read without a shuffle, others keep their files, old tombstones can go."""
    t = Tables(spark, SF)
    root, spec = work_dir(spark, "buckets"), specs.CUSTOMERS_CURRENT
    changes = ingest.decode_events(iq.customer_envelopes(t), received_at=NOW, with_raw=False)
    winners = ingest.mirror_changes(ingest.newest_changes(ingest.for_table(changes, spec)), spec)
    mirror.write_batch(winners, root, spec, 0, buckets=4)
    assert "Exchange" in plan_of(mirror.read_current(spark, root, spec))
    assert mirror.compact(spark, root, spec) == [0, 1, 2, 3]
    whole = mirror.read_current(spark, root, spec)
    first = rows(whole)
    assert len(first) == winners.count()
    assert "Exchange" not in plan_of(whole) and "Sort" not in plan_of(whole)
    # A delete of one key touches one bucket.
    key = winners.agg(F.min("customer_id")).first()[0]
    rest = rows(whole.where(F.col("customer_id") != key))
    gone = winners.where(F.col("customer_id") == key).withColumns({"_is_delete": F.lit(True), "_sequence": F.col("_sequence") + 1})
    mirror.write_batch(gone, root, spec, 1)
    mirror.write_batch(winners.where(F.col("customer_id") == key), root, spec, 2)
    assert mirror.compact(spark, root, spec, least=3) == []
    assert rows(mirror.read_current(spark, root, spec)) == rest
    moment = gone.first()["_sequence"]
    assert len(mirror.compact(spark, root, spec, forget_before=moment)) == 1
    assert mirror.read_winners(spark, root, spec).where("_is_delete").count() == 1
    mirror.write_batch(winners.limit(0), root, spec, 3, channel="walk")
    assert mirror.compact(spark, root, spec, forget_before=moment + 1) == []
    mirror.write_batch(gone, root, spec, 0, channel="walk")
    assert len(mirror.compact(spark, root, spec, forget_before=moment + 1)) == 1
    assert mirror.read_winners(spark, root, spec).where("_is_delete").count() == 0
    assert rows(mirror.read_current(spark, root, spec)) == rest


def test_newest_changes_are_found_before_documents_are_decoded(spark):
    t = Tables(spark, SF)
    changes = ingest.decode_events(iq.order_envelopes(t), received_at=NOW, with_raw=False)
    plan = plan_of(ingest.upsert_current(changes, specs.ORDERS_CURRENT))
    assert "SortAggregate" not in plan and plan.count("Exchange hashpartitioning") == 1
    # Plans are printed from the top: documents are decoded above the shuffle.
    assert plan.index("plain_texts") < plan.index("Exchange hashpartitioning")


def test_ledger_days(spark):
    """A day's rows come from that day's folders; folding and repeating change nothing."""
    t = Tables(spark, SF)
    path = work_dir(spark, "ledger")
    changes = ingest.decode_events(iq.order_envelopes(t), received_at=NOW, with_raw=True)
    ledger = ingest.ledger_rows(changes.where("change_timestamp < '1995-03-01'"))
    for batch, channel in ((0, "batch"), (1, "batch"), (0, "walk"), (1, "batch")):
        part = ledger.where(F.pmod(F.xxhash64("order_id"), F.lit(3)) == batch + 2 * (channel == "walk"))
        ingest.append_ledger(part, path, batch, channel=channel)
    want = rows(ledger.withColumn("change_date", F.to_date("change_timestamp")))
    assert rows(ingest.read_ledger(spark, path)) == want
    day = next(d for d, names in sorted(days.writers_of(spark, path).items()) if len(names) > 1)
    one = ingest.read_ledger(spark, path, [day])
    assert {f"/_day={day}/" in f for f in one.inputFiles()} == {True}
    assert day in ingest.fold_ledger(spark, path, least=2)
    assert len(days.writers_of(spark, path, [day])[day]) == 1
    assert rows(ingest.read_ledger(spark, path)) == want
    ingest.append_ledger(ledger.where(F.to_date("change_timestamp") == day).limit(1), path, 7)
    assert len(days.writers_of(spark, path, [day])[day]) == 2 and ingest.read_ledger(spark, path).count() == len(want) + 1
    last = days.days_of(spark, path)[-1]
    days.drop_days(spark, path, last)
    assert days.days_of(spark, path) == [last]


def test_redelivery_is_dropped_from_the_ledger_alone(spark):
    """A repeated event, batches later, reads only the ids of its own days."""
    t = Tables(spark, SF)
    root = work_dir(spark, "redelivered")
    envelopes = iq.order_envelopes(t).where("event_id LIKE '%7-1'")
    old = envelopes.where(F.col("event_time") < "1996")
    process_batch(envelopes, 0, root, dedupe=True)
    process_batch(envelopes.where(F.col("event_time") > "2000"), 1, root, dedupe=True)
    process_batch(old, 2, root, dedupe=True)
    path = f"{root}/{specs.ORDERS_LEDGER.name}"
    assert ingest.read_ledger(spark, path).count() == envelopes.select("event_id").distinct().count()
    process_batch(envelopes, 0, root, dedupe=True)
    assert ingest.read_ledger(spark, path).count() == envelopes.select("event_id").distinct().count()
    touched = {r[0] for r in old.select(F.substring("event_time", 1, 10)).distinct().collect()}
    ids = days.read_days(spark, f"{root}/ledger_ids", ingest_stream._IDS, touched)
    assert {any(f"_day={d}/" in f for d in touched) for f in ids.inputFiles()} == {True}


def test_features_do_not_see_the_future(spark):
    facts = features.order_facts(Tables(spark, SF).fx_orders)
    past = facts.where(F.col("order_date") <= F.lit(CUTOFF).cast("date"))
    assert rows(features.customer_features(facts, CUTOFF)) == rows(features.customer_features(past, CUTOFF))


def test_features_shuffle_orders_once(spark):
    facts = features.order_facts(one_plain_orders(spark))
    plan = features.customer_features(facts, TODAY)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_training_set_shuffles_orders_once(spark):
    facts = features.order_facts(one_plain_orders(spark))
    train = features.training_set(facts, TODAY)
    plan = plan_of(train)
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    cutoff = features._day(TODAY) - dt.timedelta(days=features.HORIZON_DAYS)
    want = features.customer_features(facts, cutoff).join(features.churn_labels(facts, cutoff), "customer_id")
    assert train.columns == want.columns
    got, same = (df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]) for df in (train, want))
    assert rows(got) == rows(same)


def test_a_merge_depends_on_its_target_and_fails_if_that_moved(spark, monkeypatch):
    root = work_dir(spark, "merge")
    table = lambda *ids: spark.createDataFrame([(i, f"new-{i}") for i in ids], "customer_id string, tier string")
    counts = lambda df: {r.merge_action: r.affected for r in df.collect()}
    assert counts(scoring.store_merge(table("a", "b"), root)) == {"INSERT": 2}
    assert counts(scoring.store_merge(table("b", "c", "d"), root)) == {"INSERT": 2, "UPDATE": 1, "DELETE": 1}
    assert rows(snapshots.read_latest(spark, root)) == rows(table("b", "c", "d"))
    assert {(r.customer_id, r.merge_action) for r in scoring.merge_log(spark, root, 2).collect()} == {
        ("a", "DELETE"), ("b", "UPDATE"), ("c", "INSERT"), ("d", "INSERT")}
    write = snapshots.write_version

    def overtaken(df, path, *args):
        write(table("x"), path)
        return write(df, path, *args)

    monkeypatch.setattr(scoring.snapshots, "write_version", overtaken)
    with pytest.raises(RuntimeError):
        scoring.store_merge(table("e"), root)
    assert rows(snapshots.read_latest(spark, root)) == rows(table("x"))


def one_plain_orders(spark):
    path = work_dir(spark, "orders")
    Tables(spark, SF).fx_orders.write.parquet(path)
    return spark.read.parquet(path)


def test_point_in_time_filter_reaches_the_scan(spark):
    facts = features.order_facts(one_plain_orders(spark))
    # The list of pushed filters is cut off in a plan's text beyond this length.
    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)
    for df in (features.visible_orders(facts, CUTOFF), features.churn_labels(facts, CUTOFF)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        pushed = plan[plan.index("PushedFilters"):plan.index("ReadSchema")]
        assert "LessThan(created_at" in pushed and "order_status" in pushed
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_churn_run_reports_errors(spark):
    t = Tables(spark, SF)
    store = ChurnStore(work_dir(spark, "churn"))
    bad = run_churn_pipeline(spark, t.fx_orders, store, TODAY, NOW, mode="other").collect()
    assert [r["status"] for r in bad] == ["failed"]
    early = run_churn_pipeline(spark, t.fx_orders, store, TODAY, NOW, mode="rescore").collect()
    assert early[-1]["status"] == "failed"


def test_envelopes_are_taken_up_by_portions(spark, tmp_path, monkeypatch):
    """Only one portion lies on disk; results are those of all envelopes, also with repeats and nulls."""
    for table in ("orders", "customer"):
        given = spark.read.parquet(f"{SF}/{table}.parquet").where("o_orderkey <= 300" if table == "orders" else "true")
        if table == "orders":
            again = given.where("o_orderkey % 5 = 0")
            nulls = given.where("o_orderkey % 20 = 1").withColumn("o_orderkey", F.lit(None).cast("bigint"))
            dateless = given.where("o_orderkey % 20 = 2").withColumn("o_orderdate", F.lit(None).cast("timestamp"))
            given = given.unionByName(again).unionByName(nulls).unionByName(dateless)
        given.write.parquet(str(tmp_path / f"{table}.parquet"))
    root, delivered = tmp_path / "work", []
    monkeypatch.setattr(iq, "work_dir", lambda _, label: str(root / f"{label}-{len(list(root.glob('*')))}-{len(delivered)}"))
    write = iq.write_envelopes

    def watched(envelopes, path, **options):
        assert not list(root.glob("envelopes*"))
        write(envelopes, path, **options)
        delivered.append(spark.read.text(path).count())

    monkeypatch.setattr(iq, "write_envelopes", watched)
    whole = iq.build_order_envelopes(Tables(spark, str(tmp_path))).count()
    for name in ("read_change_events", "late_change_guard", "dedupe_redelivery"):
        found = {}
        for most, each in ((1, 100_000), (3, 150)):
            monkeypatch.setattr(iq, "_ORDERS_PER_PORTION", each)
            delivered.clear()
            found[most] = rows(registry.QUERIES[name](spark, str(tmp_path)))
            assert len(delivered) == most and sum(delivered) == whole
            assert not list(root.glob("envelopes*"))
        assert found[1] and found[1] == found[3], name


def test_parts_of_a_version_are_read_when_all_are_written(spark, tmp_path):
    root = str(tmp_path / "table")
    first = snapshots.write_version(spark.range(3), root)
    begun = snapshots.write_version(spark.range(5), root, last=False)
    assert snapshots.versions(spark, root) == [first]
    assert snapshots.write_version(spark.range(2), root, begun=begun) == begun
    assert snapshots.read_latest(spark, root).count() == 7


def _orders_and_customers(spark, path, orders, customers=50):
    spark.range(orders).selectExpr(
        "id AS o_orderkey", f"id % {customers} AS o_custkey", "'F' AS o_orderstatus", "id * 1.25D AS o_totalprice",
        "timestamp'1996-01-01 00:00:00' AS o_orderdate").write.parquet(f"{path}/orders.parquet")
    spark.range(customers).selectExpr(
        "id AS c_custkey", "concat('Customer#', id) AS c_name", "'BUILDING' AS c_mktsegment").write.parquet(
        f"{path}/customer.parquet")
    return Tables(spark, str(path))


def test_a_portion_is_a_small_part_of_many_orders(spark, tmp_path, monkeypatch):
    """Where orders are many, a portion holds a thirtieth of them, and all are taken up once."""
    t = _orders_and_customers(spark, tmp_path, 10_000)
    sizes = []

    def counted(orders, path, **options):
        sizes.append(orders.count())
        spark.range(1).select(F.lit("{}").alias("body")).write.json(path)

    monkeypatch.setattr(iq, "_ORDERS_PER_PORTION", 100)
    monkeypatch.setattr(iq, "build_order_envelopes", lambda t: t.raw("orders"))
    monkeypatch.setattr(iq, "write_envelopes", counted)
    last = [last for _, last in iq.envelope_portions(t)]
    assert sum(sizes) == 10_000 and max(sizes) * 20 < 10_000
    assert last == [False] * (len(sizes) - 1) + [True]


def test_a_small_portion_keeps_all_cores_busy(spark, tmp_path, monkeypatch):
    """Orders of a portion are few bytes, of which one task would make all documents."""
    monkeypatch.setattr(iq, "_ORDERS_PER_PORTION", 100_000)
    t = _orders_and_customers(spark, tmp_path, 12_000)
    threshold, least = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    before = spark.conf.get(threshold), spark.conf.get(least)
    spark.conf.set(threshold, "-1")
    try:
        for envelopes, _ in iq.envelope_portions(t):
            assert len(envelopes.inputFiles()) >= 6
            assert spark.conf.get(least) == before[1]
    finally:
        spark.conf.set(threshold, before[0])
