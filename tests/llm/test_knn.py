from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from voxcohort.llm import knn


def brute(rows, k):
    ok = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, v) in enumerate(ok):
        if q % 20 == 0:
            scores = [(max(min(sum(a * b for a, b in zip(v, x, strict=False)), 2**63 - 1), -(2**63) + 1), i) for m, (i, x) in enumerate(ok) if m != n]
            out += [(q, r + 1, i, s) for r, (s, i) in enumerate(sorted(scores, key=lambda x: (-x[0], x[1]))[:k])]
    return sorted(out)


def answered(spark, rows, k=knn.K, **parameters):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "0 AS row", "'x' AS cell")
    got = knn.top_k(df, F.col("vec_id") % 20 == 0, k, **parameters)
    return sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect())


def test_against_all_pairs(spark):
    rng = random.Random(3)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.1) for c in rng.choice(centres)]) for i in range(300)]
    rows = [(i, [float(f"{x:.3f}") for x in v]) for i, v in rows]
    import numpy as np

    exact = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert answered(spark, rows, pivots=6) == brute(exact, knn.K)
    assert answered(spark, rows, pivots=6, block=11) == brute(exact, knn.K)


def test_ties_nulls_and_repeats(spark):
    rows = [(i, [0.5, 0.25]) for i in range(60)] + [(100, None), (101, [float("nan"), 1.0]), (102, [None, 1.0]), (103, [float("inf"), 0.0]), (21, [0.5, 0.5]), (40, [0.5, 0.75]), (61, [0.5]), (None, [1.0, 1.0])]
    assert answered(spark, rows, pivots=3, block=13) == brute(rows, knn.K)
    few = rows[:5]
    assert answered(spark, few) == brute(few, knn.K)
    assert answered(spark, []) == []
    assert answered(spark, [(0, [1.0])]) == []


def test_bounds_never_leave_out_a_cell():
    import numpy as np

    rng = np.random.default_rng(1)
    centres = rng.normal(size=(9, 6))
    x, p = np.floor(64 * (centres[np.arange(400) % 9] + 0.05 * rng.normal(size=(400, 6)))), np.floor(64 * centres)
    d = knn._distances(x, p)
    cell = d.argmin(1)
    far, norm = d[np.arange(400), cell], (x * x).sum(1)
    summary = np.array([[c, (cell == c).sum(), far[cell == c].max(), norm[cell == c].min(), norm[cell == c].max()] for c in np.unique(cell)])
    use = knn.needed(x[:50], p, summary, 10)
    for i in range(50):
        s = x @ x[i]
        s[i] = -np.inf
        for j in np.argsort(-s)[:10]:
            assert use[i, list(summary[:, 0]).index(cell[j])]
    assert use.mean() < 1


def test_large_components_are_exact(spark):
    rows = [(0, [2.0**24, 1.0]), (1, [2.0**24, 3.0]), (2, [2.0**24, 2.0]), (3, [-(2.0**24), 2.0]), (20, [2.0**60, 1.0]), (4, [2.0**30, 1.0])]
    assert answered(spark, rows) == brute(rows, knn.K)


def test_vectors_go_only_where_they_are_needed(spark):
    """On clustered vectors each goes to the queries of few cells; the answers stay exact."""
    rng = random.Random(5)
    centres = [[rng.gauss(0, 4) for _ in range(6)] for _ in range(12)]
    rows = [(i, [round(c + rng.gauss(0, 0.02), 2) for c in centres[i % 12]]) for i in range(1200)]
    rows = [(i, [float(x) for x in v]) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    sent, kept, _ = knn.routed(df, F.col("vec_id") % 20 == 0, 5, "vec_id", "embedding", knn.SCALE, 24, 4)
    groups = sent.select("asking").distinct().count()
    assert groups >= 12 and kept.count() < 0.5 * len(rows) * groups
    got = knn.top_k(df, F.col("vec_id") % 20 == 0, 5, pivots=24, block=4)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == brute(rows, 5)


def test_query_blocks_are_filled():
    import numpy as np

    pivots = np.array([[0.0], [10.0], [1.0], [11.0], [2.0]])
    begin, many, total = knn.query_blocks(pivots, {0: 3, 1: 25, 2: 4, 3: 2, 4: 0}, 10)
    assert begin[0] == begin[2] == begin[4] == 0 and many == {0: 1, 1: 3, 2: 1, 3: 1, 4: 1} and total == 5
    assert begin[1] == 1 and begin[3] == 4
    assert knn.query_blocks(pivots, {c: 2 for c in range(5)}, 10)[2] == 1
