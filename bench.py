"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR   input folder (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_QUERIES  comma-separated names instead of the default list
BENCH_DETAIL   with any value, also print rows and shuffle bytes per query to stderr
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F

from tideline.plans import registry
from tideline.session import local_session

HEADLINE = [
    "customer_features", "churn_labels", "training_set", "score_customers", "merge_churn_risk",
    "order_history", "customer_rollup", "order_financials", "price_orders", "cart_totals",
    "classify_offers", "decide_sessions", "offer_documents", "claim_offers", "resolve_offer",
    "assign_logins", "session_trace", "hop_status", "new_revisions", "orders_current",
    "run_churn_pipeline",
]


def shuffle_bytes(spark) -> int:
    """Shuffle bytes written so far, from the executors' status."""
    store = spark.sparkContext._jsc.sc().statusStore()
    return sum(e.totalShuffleWrite() for e in _iterate(store.executorList(True)))


def _iterate(seq):
    return [seq.apply(i) for i in range(seq.size())]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = os.environ.get("BENCH_QUERIES")
    chosen = names.split(",") if names else HEADLINE
    detail = bool(os.environ.get("BENCH_DETAIL"))
    spark = local_session(cpus, shuffle_partitions=cpus)
    registry.load_all()
    # Start the JVM's and Python's workers outside the measured time.
    spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().collect()
    seconds: dict[str, float] = {}
    for name in chosen:
        before = shuffle_bytes(spark) if detail else 0
        start = time.perf_counter()
        result = registry.QUERIES[name](spark, sf_dir)
        result.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        if detail:
            moved = shuffle_bytes(spark) - before
            print(f"{name:24} {seconds[name]:8.2f}s shuffle={moved:>12}", file=sys.stderr, flush=True)
        spark.catalog.clearCache()
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": total, "unit": "sec",
                "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
