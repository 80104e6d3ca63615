"""Exact top-k inner products with block-at-a-time pruning.

Rows are cut into blocks by ranges of their id.  A block keeps the largest and
smallest value of every component; the sum over components of the larger of
query * largest and query * smallest bounds every score in the block.  Each query
visits its blocks from the highest bound on, scores a block's rows, and stops at
the first bound below its k-th best score.

Blocks and queries meet in cells: a cell holds at most CELL_QUERIES queries and a
bounded number of rows, whatever the size of the tables, and one partial result
of k rows per query and cell is merged by query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.llm.common import stored

BLOCK_ROWS = 64
CELL_QUERIES = 2048
CELL_ROWS = 16_384
SCALE = 256

_LONG_MAX = (1 << 63) - 1
_SCHEMA = "query_uid long, query_id long, vec_id long, uid long, score long"


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(uid, vec_id, dims, values) of the rows that take part, values floor(scale * x).

    Rows whose vector is null or has a null or non-finite component take no part.
    Values beyond a long are held at its ends.
    """
    x = F.transform("embedding", lambda v: v.cast("double"))
    fine = F.col("embedding").isNotNull() & F.forall(
        "embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    whole = F.transform(x, lambda v: F.floor(F.least(F.greatest(v * float(scale), F.lit(-9.2e18)), F.lit(9.2e18))))
    rows = vectors.select("vec_id", "embedding").withColumn("uid", F.monotonically_increasing_id())
    return rows.where(fine & F.col("vec_id").isNotNull()).select(
        "uid", "vec_id", F.size("embedding").alias("dims"), whole.cast("array<bigint>").alias("values"))


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(flat)
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, -1) if n else np.zeros((0, 0), np.int64)


def _exact(values: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Arrays in which products and sums of these values are exact."""
    high = max((int(abs(int(x))) for m in (values, queries) if m.size for x in (m.min(), m.max())), default=0)
    if high * high * max(1, values.shape[1]) < 1 << 53:
        return np.float64
    if high * high * max(1, values.shape[1]) < 1 << 63:
        return np.int64
    return object


def _search(k: int):
    """The k best rows of a cell for each of its queries."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: dict[str, list[int]] = {n: [] for n in ("query_uid", "query_id", "vec_id", "uid", "score")}
        if len(rows) and len(queries):
            values, wanted = _matrix(rows.column("values")), _matrix(queries.column("values"))
            kind = _exact(values, wanted)
            ids, uids = rows.column("vec_id").to_numpy(), rows.column("uid").to_numpy()
            order = np.lexsort((uids, ids))
            ids, uids, values = ids[order], uids[order], values[order].astype(kind)
            wanted = wanted.astype(kind)
            starts = np.arange(0, len(ids), BLOCK_ROWS)
            dims = values.shape[1]
            if dims:
                top, low = np.maximum.reduceat(values, starts), np.minimum.reduceat(values, starts)
                positive, negative = np.where(wanted > 0, wanted, 0 * wanted), np.where(wanted < 0, wanted, 0 * wanted)
                bounds = positive @ top.T + negative @ low.T
            else:
                bounds = np.zeros((len(wanted), len(starts)), dtype=kind)
            for q, (quid, qid) in enumerate(zip(queries.column("uid").to_pylist(), queries.column("vec_id").to_pylist(), strict=True)):
                best: list[tuple[object, int, int]] = []
                for b in np.argsort(-bounds[q], kind="stable").tolist():
                    if len(best) == k and bounds[q, b] < -best[-1][0]:
                        break
                    a, z = starts[b], min(starts[b] + BLOCK_ROWS, len(ids))
                    scores = values[a:z] @ wanted[q] if dims else np.zeros(z - a, dtype=kind)
                    # Equal scores can still win by a smaller id.
                    hits = np.arange(z - a) if len(best) < k else np.flatnonzero(scores >= -best[-1][0])
                    if len(hits) > 4 * k and kind is not object:
                        cut = np.partition(scores[hits], len(hits) - k - 1)[len(hits) - k - 1]
                        hits = hits[scores[hits] >= cut]
                    best.extend((-scores[h], int(ids[a + h]), int(uids[a + h])) for h in hits.tolist() if uids[a + h] != quid)
                    best = sorted(best)[:k]
                for score, vec_id, uid in best:
                    out["query_uid"].append(quid)
                    out["query_id"].append(qid)
                    out["vec_id"].append(vec_id)
                    out["uid"].append(uid)
                    out["score"].append(max(-_LONG_MAX - 1, min(_LONG_MAX, -int(score))))
        return pa.table({n: pa.array(v, pa.int64()) for n, v in out.items()})

    return run


def top_inner_products(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` rows of highest inner product with each query, its own row left out.

    Both have uid, vec_id, dims and values as ``quantised`` makes them; queries are
    rows of ``vectors`` and are known by uid, so repeated rows are candidates of each
    other.  Only vectors of the same length are compared.  Ties go to the smaller
    vec_id, then to the earlier row.  Returns query_id, rank (from 1), vec_id and
    score; a query without candidates has no row.
    """
    counts = stored(queries.groupBy("dims").agg(F.count("*").alias("n")), "topk-counts")
    n_queries = counts.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    n_rows = vectors.count()
    slices = max(1, -(-n_queries // CELL_QUERIES))
    ranges = max(1, -(-n_rows // CELL_ROWS))
    # Blocks are ranges of the id: rows are dealt to cells by range, queries by hash.
    edges = vectors.approxQuantile("vec_id", [i / ranges for i in range(1, ranges)], 0.001) if ranges > 1 else []
    place = F.lit(0)
    if edges:
        place = F.size(F.filter(F.array(*[F.lit(int(e)) for e in edges]), lambda e: e <= F.col("vec_id")))
    spread_rows = vectors.withColumn("range", place).withColumn(
        "slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    spread_queries = queries.withColumn("slice", F.pmod(F.xxhash64("uid"), F.lit(slices)).cast("int")).withColumn(
        "range", F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))))
    cells = spread_rows.groupBy("dims", "slice", "range").cogroup(spread_queries.groupBy("dims", "slice", "range"))
    found = cells.applyInArrow(_search(k), _SCHEMA)
    order = Window.partitionBy("query_uid").orderBy(F.col("score").desc(), "vec_id", "uid")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
