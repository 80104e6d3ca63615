"""Poisson replication: shares, determinism, odd rows."""

import math

from pyspark.sql import functions as F

from tideline.llm import mixing

SCHEMA = "doc_id long, source string, copies int"


def test_shares_and_size(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "big").otherwise(
        F.concat(F.lit("s"), (F.col("id") % 4).cast("string"))).alias("source"))
    mixed = mixing.mix(docs, {"big": 1.0}, 1.0, "t", rows=20_000)
    counts = {r["source"]: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert abs(sum(counts.values()) - 20_000) < 5 * math.sqrt(20_000)
    assert all(abs(n - 4000) < 5 * math.sqrt(4000) for n in counts.values())
    again = mixing.mix(docs.repartition(5), {"big": 1.0}, 1.0, "t", rows=20_000)
    key = ["doc_id", "copy", "shuffle_key"]
    assert mixed.select(key).exceptAll(again.select(key)).count() == 0
    order = [r.shuffle_key for r in mixed.select("shuffle_key").collect()]
    assert order == sorted(order)


def test_table_is_the_poisson_distribution(spark):
    for rate in (0.0, 0.3, 7.0, 900.0):
        sums = spark.range(1).select(mixing.poisson_table(F.lit(rate)).alias("t")).first()["t"]
        if not rate:
            assert sums == [1.0]
            continue
        term = [math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) for k in range(len(sums))]
        assert all(abs(s - w) < 1e-9 for s, w in zip(sums, (sum(term[:k + 1]) for k in range(len(term))), strict=True))
        assert abs(sums[-1] - 1) < 1e-9


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 9), (1, None, 9), (None, "a", 9), (2, "off", 9)], SCHEMA)
    mixed = mixing.mix(docs, {"off": 0.0}, 1.0, "t", rows=40).collect()
    assert {r.source for r in mixed} <= {None, "a"}
    assert len([r for r in mixed if r.doc_id == 1]) % 2 == 0
    assert mixing.mix(spark.createDataFrame([], SCHEMA), {}, 1.0).count() == 0


def test_large_rates_against_sql(spark):
    """A source of three rows that is raised to half of the mixture: a rate of 1000."""
    import duckdb

    docs = spark.range(6003).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3, "tiny").otherwise("big").alias("source"))
    got = mixing.mix(docs, {}, 1.0, "t").select("doc_id", "source", F.round("rate", 6).alias("rate"), "copies", "copy",
                                                 F.round("shuffle_key", 9).alias("shuffle_key"))
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = con.execute(mixing.poisson_sql("t", {}, 1.0)).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert max(r[3] for r in want) > 900
