"""Helpers the text operators share: intermediate tables, ids, safe column names."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.session import configure, work_dir

# An Arrow batch is cut at this size, so that a Python worker's memory does not
# follow the number of rows or the length of the texts in a partition.
ARROW_BATCH_BYTES = 4 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of the text operators."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written below the shared folder and read back.

    It cuts the lineage: rows computed once survive a lost executor and are not
    computed again by the next consumer.
    """
    spark = df.sparkSession
    path = work_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents_columns(docs: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The named columns of ``docs``; a missing one is an error, others are ignored."""
    return docs.select(*[F.col(f"`{name}`") for name in columns])


def output_schema(rows: DataFrame, keys: Iterable[str], added: str) -> T.StructType:
    """Fields ``keys`` of ``rows``, whatever their names and types, then those of ``added``."""
    return T.StructType([*(rows.schema[k] for k in keys), *T.StructType.fromDDL(added).fields])


def crc_remainder(key: str | Column, modulus: int) -> Column:
    """crc32 of the key written as text, modulo ``modulus``; a null key counts as empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def unit_hash(*columns: Column, seed: str) -> Column:
    """A number in [0, 1) from the md5 of the columns' texts; the same in any engine."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    digest = F.md5(F.concat_ws(":", F.lit(seed), *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


# Texts longer than this are read match by match, so many at once.
LONG_TEXT = 1 << 20
MATCHES_AT_ONCE = 200_000


def matches(pattern: re.Pattern, text: str | bytes) -> Iterator[list]:
    """All matches of a text in lists of bounded length."""
    if len(text) < LONG_TEXT:
        yield pattern.findall(text)
        return
    found = (m.group() for m in pattern.finditer(text))
    while part := list(islice(found, MATCHES_AT_ONCE)):
        yield part
