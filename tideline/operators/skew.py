"""Ordered scans that survive a key holding a large share of all rows.

A window partition is one task.  Keys are therefore split by a time bucket: rows are
scanned inside (key, bucket), one summary row per bucket is scanned inside the key,
and the two are added up.  Every key takes this path, whatever its size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_large(df: DataFrame, key: str, min_rows: int) -> tuple[DataFrame, DataFrame]:
    """``(small, large)`` rows by the size of their key; together ``df``, NULL keys included.

    The large keys are joined without a hint: how many there are follows the data.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    large = counts.where(F.col("_rows") > min_rows).select(
        F.col(key).alias("_large_key"), F.lit(True).alias("_is_large"))
    tagged = df.join(large, F.col(key).eqNullSafe(F.col("_large_key")), "left")
    small = tagged.where(F.col("_is_large").isNull()).select(*df.columns)
    return small, tagged.where(F.col("_is_large")).select(*df.columns)


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on ``keys`` in which NULL equals NULL; the keys come from the left."""
    named = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(named[f"_r_{k}"]) for k in keys])
    return left.join(named, on).drop(*[f"_r_{k}" for k in keys])


def bucketed_lag(
    df: DataFrame, key: str, bucket: Column, order: list[str], value: str, name: str
) -> DataFrame:
    """The previous row's ``value`` in key order, with keys split by bucket."""
    rows = df.withColumn("_bucket", bucket)
    inside = Window.partitionBy(key, "_bucket").orderBy(*order)
    # The wrapping struct keeps "no previous row" apart from "previous was NULL".
    scanned = rows.withColumn("_in_prev", F.lag(F.struct(F.col(value).alias("v"))).over(inside))
    last_of = rows.groupBy(key, "_bucket").agg(
        F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_last")
    )
    carried = last_of.select(
        key, "_bucket",
        F.lag("_last").over(Window.partitionBy(key).orderBy("_bucket")).alias("_carried"),
    )
    joined = join_null_safe(scanned, carried, [key, "_bucket"])
    previous = F.coalesce("_in_prev", "_carried")
    return joined.select(*df.columns, previous["v"].alias(name), previous.isNotNull().alias(f"{name}_found"))
