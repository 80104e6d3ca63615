"""Mixing sources to target weights by Poisson replication.

Each document is repeated Poisson(rate) times, where a source's rate is its target
number of rows over its rows.  The Poisson draw inverts the distribution at a
number hashed from the seed and the document, so any engine and any rerun, on any
partitioning, repeats each document as often.  Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import stored, unit_hash

# Sources whose rates are broadcast (about 1 KB each); more are joined by a shuffle
# that the adaptive join splits.
BROADCAST_SOURCES = 20_000

# The table of a rate ends where less than this is left of the distribution; the
# hashed numbers have 52 bits.
TAIL = 2.0 ** -54


def _top(rate: Column) -> Column:
    """A count that a Poisson draw at 52 bits never exceeds."""
    return F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")


def poisson_table(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... as an array, for X of mean ``rate``.

    Terms are summed from their logarithms, so that large rates do not underflow.
    """
    terms = F.aggregate(
        F.sequence(F.lit(1), _top(rate)),
        F.struct((-rate).alias("log"), F.array(F.exp(-rate)).alias("sums")),
        lambda acc, k: F.struct(
            (acc["log"] + F.ln(rate) - F.ln(k.cast("double"))).alias("log"),
            F.concat(acc["sums"], F.array(
                F.element_at(acc["sums"], -1) + F.exp(acc["log"] + F.ln(rate) - F.ln(k.cast("double"))))).alias("sums"),
        ),
    )["sums"]
    return F.when(rate > 0, terms).otherwise(F.array(F.lit(1.0)))


def source_rates(docs: DataFrame, weights: Mapping[str, float], other_weight: float, rows: float | None) -> DataFrame:
    """(source, n_source, rate, sums) per source of ``docs``.

    Sources in ``weights`` get that weight, all others ``other_weight`` each; shares
    are weights over the sum of the weights of the sources present.  ``rows`` is the
    expected size of the mixture; None keeps the number of rows.
    """
    weight: Column = F.lit(float(other_weight))
    for name, value in weights.items():
        weight = F.when(F.col("source") == name, F.lit(float(value))).otherwise(weight)
    counts = stored(docs.groupBy("source").agg(F.count("*").alias("n_source")).withColumn("weight", weight), "mix-counts")
    all_weight, all_rows = counts.agg(F.sum("weight"), F.sum("n_source")).first()
    if not all_weight or all_weight <= 0:
        rate = F.lit(0.0)
    else:
        wanted = float(all_rows) if rows is None else float(rows)
        rate = F.col("weight") / F.lit(float(all_weight)) * F.lit(wanted) / F.col("n_source")
    rated = counts.select("source", "n_source", rate.alias("rate"))
    return rated.withColumn("sums", poisson_table(F.col("rate")))


def mix(docs: DataFrame, weights: Mapping[str, float], other_weight: float = 1.0, seed: str = "mix",
        rows: float | None = None, key: str = "doc_id", shuffle: bool = True) -> DataFrame:
    """``docs`` with each row repeated by its Poisson count, in a global random order.

    Adds rate, copies (the row's count), copy (from 0) and shuffle_key, a hash of
    seed, key and copy by which rows are ordered across all partitions; ties go by
    key.  A null source is a source of its own, a null key counts as empty text,
    and rows with equal keys are drawn alike.  A weight of 0 drops a source; an
    empty table gives no rows.  A column of the input named like an added one is
    replaced.  The shuffle moves each copy once; partitions are ranges of the
    hash, so they are even whatever the sources' sizes.
    """
    added = ["rate", "copies", "copy", "shuffle_key"]
    docs = docs.drop(*[c for c in added if c in docs.columns])
    rates = stored(source_rates(docs, weights, other_weight, rows), "mix-rates")
    n = rates.count()
    few = rates.select(F.col("source").alias("_source"), "rate", F.col("sums").alias("_sums"))
    joined = docs.join(F.broadcast(few) if n <= BROADCAST_SOURCES else few,
                       docs["source"].eqNullSafe(F.col("_source")), "inner")
    u = unit_hash(F.col(key), seed=f"{seed}-count")
    # Both sides are handed to the lambda: the optimizer overlooks a column that only stands
    # inside one and would push the filter below to the side without it.  A hash beyond the
    # table's last sum cannot occur but for rounding of the sum.
    drawn = F.transform(F.array(F.struct(u.alias("u"), F.col("_sums").alias("sums"))), lambda d: F.least(
        F.size(F.filter(d["sums"], lambda c: c <= d["u"])), F.size(d["sums"]) - 1))
    copies = F.element_at(drawn, 1)
    counted = joined.withColumn("copies", copies.cast("long")).where(F.col("copies") > 0)
    spread = counted.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    order = unit_hash(F.col(key), F.col("copy"), seed=f"{seed}-order")
    out = spread.select(*[F.col(f"`{c}`") for c in docs.columns], "rate", "copies", "copy", order.alias("shuffle_key"))
    return out.orderBy("shuffle_key", key) if shuffle else out


def poisson_sql(seed: str, weights: Mapping[str, float], other_weight: float, relation: str = "documents") -> str:
    """The same mixture, without its order, in SQL for a checking engine."""
    cases = " ".join(f"WHEN source = '{name}' THEN {float(value)}" for name, value in weights.items())
    weight = f"CASE {cases} ELSE {float(other_weight)} END" if cases else f"{float(other_weight)}"
    u = "('0x' || substr(md5('{0}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"
    return f"""
WITH counts AS (SELECT source, count(*) AS n_source, {weight} AS weight FROM {relation} GROUP BY source),
rates AS (SELECT source, CAST(weight AS DOUBLE) / sum(weight) OVER () * sum(n_source) OVER () / n_source AS rate FROM counts),
terms AS (SELECT source, rate, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p
          FROM (SELECT source, rate, unnest(generate_series(0, CAST(ceil(rate + 12 * sqrt(rate) + 40) AS BIGINT))) AS k
                FROM rates WHERE rate > 0) AS r),
sums AS (SELECT source, rate, list(total ORDER BY k) AS sums FROM (
           SELECT source, rate, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS total FROM terms) AS t GROUP BY source, rate),
drawn AS (SELECT d.doc_id, d.source, s.rate,
                 least(len(list_filter(s.sums, lambda c: c <= {u.format(seed + '-count')})), len(s.sums) - 1) AS copies
          FROM {relation} AS d JOIN sums AS s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, source, round(rate, 6) AS rate, copies, copy,
       round(('0x' || substr(md5('{seed}-order:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || copy), 1, 13))::BIGINT
             / 4503599627370496.0::DOUBLE, 9) AS shuffle_key
FROM (SELECT *, unnest(generate_series(0, copies - 1)) AS copy FROM drawn WHERE copies > 0) AS spread"""
