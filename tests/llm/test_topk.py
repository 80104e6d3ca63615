"""Exact top-k against all products."""

import math
import random

from tideline.llm import topk

SCHEMA = "vec_id long, embedding array<double>, label int, score string"


def brute(rows, every, k):
    usable = [(n, i, [math.floor(256 * x) for x in v]) for n, (i, v) in enumerate(rows)
              if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, q in usable:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j, m) for m, j, v in usable if m != n and len(v) == len(q))
        out += [(i, r + 1, j, -s) for r, (s, j, _) in enumerate(scored[:k])]
    return sorted(out)


def found(spark, rows, every, k):
    vectors = topk.quantised(spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA).coalesce(1))
    got = topk.top_inner_products(vectors, vectors.where(f"vec_id % {every} = 0"), k)
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect())


def vectors(seed, n=400, dims=6):
    rng = random.Random(seed)
    rows = [(i, [rng.choice((-0.5, 0.0, 0.25, rng.gauss(0, 1))) for _ in range(dims)]) for i in range(n)]
    rows[20:25] = [(20 + i, rows[10][1]) for i in range(5)]
    return rows


def test_matches_all_products(spark):
    rows = vectors(1)
    assert found(spark, rows, 10, 5) == brute(rows, 10, 5)


def test_many_cells_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(topk, "CELL_QUERIES", 7)
    monkeypatch.setattr(topk, "CELL_ROWS", 50)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 8)
    rows = vectors(2)
    assert found(spark, rows, 10, 5) == brute(rows, 10, 5)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]),
            (6, [1.0]), (None, [1.0, 1.0]), (8, [-1.0, -3.0]), (10, []), (20, []), (30, [1.0, 2.0])]
    assert found(spark, rows, 10, 5) == brute(rows, 10, 5)


def test_large_values_are_exact(spark):
    rows = [(i, [1e6 + i / 256, -1e6]) for i in range(20)]
    assert found(spark, rows, 10, 3) == brute(rows, 10, 3)
    huge = found(spark, [(0, [1e300]), (1, [1e300]), (2, [-1e300])], 10, 2)
    assert [(q, v) for q, _, v, _ in huge] == [(0, 1), (0, 2)]


def test_nothing_to_search(spark):
    assert found(spark, [], 10, 5) == [] and found(spark, [(0, [1.0])], 10, 5) == []
