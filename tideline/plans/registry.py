"""Register queries together with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.plans.fixtures import Tables, with_fixtures
from tideline.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame, digits: int = 6) -> DataFrame:
    """Portable result types: bigint, double (rounded), string, boolean.

    Dates and timestamps become text and floats are rounded, so that a result
    compares equal whatever engine computed it.
    """
    columns = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        kind = field.dataType
        if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            col = col.cast("string")
        elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
            col = col.cast("bigint")
        elif isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
            col = F.round(col.cast("double"), digits)
        columns.append(col.alias(field.name))
    return df.select(*columns)


def query(name: str, sql: str | None = None, digits: int = 6):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return plain(fn(Tables(spark, sf_dir)), digits)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_fixtures(sql)
        return fn

    return register


MODULES = ("ingest", "churn", "history", "retention", "offers", "operations")


def load_all() -> None:
    """Import every module that registers queries."""
    import importlib

    for module in MODULES:
        importlib.import_module(f"tideline.plans.{module}_queries")
