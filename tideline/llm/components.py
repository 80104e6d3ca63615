"""Connected components of an edge table by repeated minimum labels and shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import stored


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable from each node of ``edges``.

    Every round takes the smallest label among a node and its neighbours, then
    replaces it by that label's own label, so long chains shorten by half or
    more.  Labels are grouped minimums (combined before the shuffle) and joins
    on a node (split by the adaptive skew join), so a node with very many edges
    is no single task's work.  Null ends are no edges.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    both = stored(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "cc-edges")
    labels = stored(both.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("node"), F.least("u", "m").alias("label")), "cc-labels")
    while True:
        heard = (
            both.join(labels, both["v"] == labels["node"])
            .groupBy("u").agg(F.min("label").alias("heard"))
        )
        lower = labels.join(heard, labels["node"] == heard["u"]).select(
            "node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        lower = stored(lower, "cc-lower")
        of = lower.select(F.col("node").alias("of"), F.col("label").alias("of_label"))
        fresh = lower.join(of, lower["label"] == of["of"]).select("node", "old", F.col("of_label").alias("label"))
        fresh = stored(fresh, "cc-labels")
        moved = fresh.where("label <> old").limit(1).count()
        labels = fresh.select("node", "label")
        if not moved:
            return labels.withColumnRenamed("label", "component")
