"""Order lists, catalog browsing and schema comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.session import work_dir

MIN_LIMIT, DEFAULT_LIMIT, MAX_LIMIT = 1, 30, 100


def _checked_limit(limit: int) -> int:
    if not MIN_LIMIT <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be {MIN_LIMIT}..{MAX_LIMIT}, got {limit}")
    return limit


def list_orders(orders: DataFrame, customer_id: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """A customer's newest orders; the customer has to be named."""
    if not customer_id:
        raise ValueError("customer_id is required")
    return (
        orders.where(F.col("customer_id") == customer_id)
        .orderBy(F.desc("created_at"), F.desc("order_id"))
        .limit(_checked_limit(limit))
    )


def newest_orders(orders: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The same list for every customer at once, of any length.

    The rank filter is applied before the shuffle as well, so a customer with
    very many orders sends at most ``limit`` rows per task.
    """
    if limit < MIN_LIMIT:
        raise ValueError(f"limit must be at least {MIN_LIMIT}, got {limit}")
    newest = Window.partitionBy("customer_id").orderBy(F.desc("created_at"), F.desc("order_id"))
    return orders.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= limit)


def catalog_search(catalog: DataFrame, category: str = "All", text: str = "") -> DataFrame:
    """Items of a category whose name, sku or category contains the text."""
    needle = F.lit(text.lower())
    hit = F.lit(False)
    for column in ("name", "sku", "category"):
        hit = hit | F.coalesce(F.lower(column).contains(needle), F.lit(False))
    found = catalog.where(hit)
    return found if category == "All" else found.where(F.col("category") == category)


def catalog_categories(catalog: DataFrame) -> DataFrame:
    return catalog.select("category").distinct().orderBy("category")


def _kind(type_name: Column) -> Column:
    """Type class of a variant type name; booleans count as numbers."""
    return (
        F.when(type_name.startswith("OBJECT"), "object")
        .when(type_name.startswith("ARRAY"), "array")
        .when(
            type_name.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL|BOOLEAN)"), "number"
        )
        .when(type_name == "VOID", "null")
        .otherwise("text")
    )


def document_paths(feed: DataFrame, body: str = "body") -> DataFrame:
    """(path, kinds) of every field of JSON documents, at any depth.

    ``kinds`` are the type classes that occur at the path, sorted; nulls are none.
    Members of arrays have paths that end in ``[]``.  Each round opens the objects and
    arrays of the one before, until there are none; rounds are stored, so a
    document is parsed once.
    """
    spark = feed.sparkSession
    found = []
    level = feed.select(F.lit("").alias("path"), F.expr(f"parse_json({body})").alias("value"))
    while True:
        opened = level.lateralJoin(spark.tvf.variant_explode(F.col("value").outer()).select(
            F.col("key"), F.col("value").alias("inner")))
        step = F.when(F.col("key").isNull(), "[]").when(F.col("path") == "", F.col("key")).otherwise(F.concat(F.lit("."), "key"))
        inner = opened.select(F.concat("path", step).alias("path"), F.col("inner").alias("value"))
        folder = work_dir(spark, "document-paths")
        inner.withColumn("kind", _kind(F.expr("schema_of_variant(value)"))).write.parquet(folder)
        stored = spark.read.parquet(folder)
        found.append(stored.select("path", "kind").distinct())
        level = stored.where(F.col("kind").isin("object", "array")).select("path", "value")
        if not level.limit(1).count():
            break
    every = reduce(DataFrame.unionByName, found)
    return every.groupBy("path").agg(
        F.array_sort(F.collect_set(F.when(F.col("kind") != "null", F.col("kind")))).alias("kinds"))


def schema_parity(
    left: DataFrame, right: DataFrame, allowed_extra: tuple[str, ...] = ("loyaltyOffer",), body: str = "body"
) -> DataFrame:
    """Differences between the fields of two JSON document feeds, at any depth.

    No row means parity.  ``right`` may have the ``allowed_extra`` sections.  A path with
    several kinds inside one feed is a row, even if both feeds have the same ones; a path
    that is always null agrees with any kind.
    """
    a = document_paths(left, body).select("path", F.col("kinds").alias("_left"), F.lit(True).alias("_l"))
    b = document_paths(right, body).select("path", F.col("kinds").alias("_right"), F.lit(True).alias("_r"))
    several = (F.size("_left") > 1) | (F.size("_right") > 1)
    problem = (
        F.when(F.col("_l").isNull(), "missing on the left")
        .when(F.col("_r").isNull(), "missing on the right")
        .when(several, "several kinds")
        .when((F.size("_left") > 0) & (F.size("_right") > 0) & (F.col("_left") != F.col("_right")), "different kind")
    )
    section = F.split_part("path", F.lit("."), F.lit(1))

    def spelled(kinds: str) -> Column:
        return F.when(F.size(kinds) > 0, F.array_join(kinds, "|"))

    return (
        a.join(b, "path", "full_outer")
        .withColumn("problem", problem)
        .where(F.col("problem").isNotNull())
        .where(~(F.col("_l").isNull() & F.regexp_replace(section, r"\[\].*$", "").isin(list(allowed_extra))))
        .select("path", spelled("_left").alias("left_kind"), spelled("_right").alias("right_kind"), "problem")
    )
