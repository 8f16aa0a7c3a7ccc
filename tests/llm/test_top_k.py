import math
import random

import numpy as np
from pyspark.sql import functions as F

from stratus.llm import top_k as T


def brute(rows, k=20):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.setdefault((i, tuple(max(min(math.floor(64 * x), 2 ** 63 - 1), -2 ** 63) for x in v)), None)
    out = []
    for q in sorted({i for i, _ in good if i % 20 == 0}):
        best = {}
        for a, va in good:
            for i, v in good:
                if a == q and i != q and len(v) == len(va):
                    s = max(min(sum(x * y for x, y in zip(va, v)), 2 ** 63 - 1), -2 ** 63)
                    best[i] = max(best.get(i, s), s)
        for r, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]):
            out.append((q, r + 1, i, s))
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    found = T.top_k(df.withColumn("label", F.lit(1)), F.col("vec_id") % 20 == 0, **options)
    return sorted(tuple(r) for r in found.collect())


def f32(x):
    return None if x is None else float(np.float32(x))


def some_rows():
    rng = random.Random(7)
    rows = [(i, [f32(rng.gauss(0, 1)) for _ in range(6)]) for i in range(130)]
    rows += [(200 + i, rows[3][1]) for i in range(30)]  # ties
    rows += [(40, rows[40][1]), (300, None), (320, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (340, [float("nan")] * 6), (360, [float("inf")] * 6),
             (None, rows[5][1]), (400, [1.0, 2.0]), (401, [0.5, 2.0]), (420, []), (60, rows[7][1]), (-20, rows[9][1])]
    return rows


def test_equals_brute_force(spark):
    assert run(spark, some_rows()) == brute(some_rows())


def test_many_shards_and_blocks(spark):
    assert run(spark, some_rows(), shard_rows=40, block_rows=3) == brute(some_rows())


def test_many_strong_vectors_of_one_id(spark):
    rng = random.Random(11)
    rows = [(i, [f32(abs(rng.gauss(0, 1))) for _ in range(4)]) for i in range(100)]
    rows += [(7, [f32(50 + n)] * 4) for n in range(25)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, shard_rows=30, block_rows=3) == brute(rows)


def test_queries_with_several_vectors(spark):
    rng = random.Random(12)
    rows = [(i, [f32(rng.gauss(0, 1)) for _ in range(4)]) for i in range(200)]
    rows += [(i, [f32(x + 0.1 * n) for x in v]) for i, v in rows if i % 20 == 0 for n in range(1, 10)]
    assert run(spark, rows, shard_rows=50, block_rows=4) == brute(rows)


def test_huge_components_and_empty_table(spark):
    rows = [(0, [f32(3e30), 1.0]), (1, [f32(2e30), -1.0]), (2, [f32(-1e30), 1.0]), (3, [0.0, 0.0])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_search_prunes_and_stays_exact():
    rng = np.random.default_rng(8)
    centers = rng.integers(-400, 400, (12, 8))
    vectors = (centers[rng.integers(0, 12, 3000)] + rng.integers(-9, 9, (3000, 8))).astype(np.int64)
    ids, q = np.arange(3000), vectors[::60]
    rows = T.search(vectors, ids, q, ids[::60], np.full(len(q), -2 ** 63), 10)
    full = q @ vectors.T
    for n in range(len(q)):
        want = sorted(((-full[n, i], i) for i in range(3000) if i != 60 * n))[:10]
        assert sorted((-s, i) for a, i, s in rows.T.tolist() if a == n) == want


def test_tree_bounds_hold():
    rng = np.random.default_rng(9)
    vectors = rng.integers(-50, 50, (500, 5))
    tree = T.BallTree(vectors, 16)
    assert sorted(tree.order.tolist()) == list(range(500))
    for (lo, hi), c, r in zip(tree.spans, tree.centers, tree.radii):
        assert (np.sqrt(((vectors[tree.order[lo:hi]] - c) ** 2).sum(1)) <= r + 1e-9).all()
