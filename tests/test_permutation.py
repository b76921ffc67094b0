from __future__ import annotations

import numpy as np
import pytest

from voxcohort.operators import permutation
from voxcohort.operators.evaluate import stratified_folds

SCHEMA = "id long, cls string, x double, y double"


def cohort(n: int, seed: int = 0) -> list[tuple]:
    r = np.random.default_rng(seed)
    kinds = r.choice(["a", "b", "c"], n, p=[0.6, 0.3, 0.1])
    return [(int(i), str(c), float(r.normal() + (c == "b")), float(1e6 + r.normal())) for i, c in enumerate(kinds)]


def dealt(spark, rows, b, width=permutation.WIDTH, parts=3):
    df = stratified_folds(spark.createDataFrame(rows, SCHEMA).repartition(parts), "id", "cls", 5, 42)
    keyed, names, sizes = permutation.keyed(df, "id", "cls", ["x", "y"])
    at = permutation.cuts(keyed, sizes, b, 42, width)
    return df, keyed, names, sizes, permutation.salts(b, 42), at


@pytest.mark.parametrize("width", [permutation.WIDTH, 0.01])
def test_each_permutation_deals_as_many_of_each_class(spark, width):
    _, keyed, _, sizes, salt, at = dealt(spark, cohort(700), 40, width)
    pdf = keyed.toPandas()
    h = permutation.hashes(pdf["_k1"].to_numpy(), pdf["_k2"].to_numpy(), salt)
    labels = sum((h >= at[:, j]).astype(int) for j in range(at.shape[1]))
    assert [np.bincount(labels[:, i], minlength=3).tolist() for i in range(40)] == [sizes] * 40
    assert len({labels[:, i].tobytes() for i in range(40)}) == 40
    own = pdf["_class"].to_numpy()
    expected = sum((s / 700) ** 2 for s in sizes)
    assert abs((labels == own[:, None]).mean() - expected) < 0.03


def brute(pdf, names, labels):
    """Macro F1 per permutation by plain loops."""
    x, fold, out = pdf[["x", "y"]].to_numpy(), pdf["fold"].to_numpy(), []
    for own in labels.T:
        each = []
        for f in range(5):
            train, test = fold != f, fold == f
            centre = {c: x[train & (own == c)].mean(axis=0) for c in range(len(names)) if (train & (own == c)).any()}
            guess = np.array([min(centre, key=lambda c: (((r - centre[c]) ** 2).sum(), c)) for r in x[test]])
            f1 = [2 * ((own[test] == c) & (guess == c)).sum() / n for c in range(len(names)) if (n := (own[test] == c).sum() + (guess == c).sum())]
            each.append(np.mean(f1))
        out.append(np.mean(each))
    return out


def test_scores_equal_plain_loops_for_any_partitions(spark):
    rows, b = cohort(120, 3), 12
    df, _, names, _, salt, at = dealt(spark, rows, b)
    pdf = df.toPandas().sort_values("id")
    digests = [permutation.hashlib.md5(str(i).encode()).hexdigest() for i in pdf["id"]]
    h = permutation.hashes(*(np.array([int(d[i : i + 8], 16) for d in digests]) for i in (0, 8)), salt)
    labels = np.concatenate([np.array([names.index(c) for c in pdf["cls"]])[:, None], sum((h >= at[:, j]).astype(int) for j in range(2))], axis=1)
    want = brute(pdf, names, labels)
    for parts in (1, 7):
        got = permutation.scores(spark.createDataFrame(rows, SCHEMA).repartition(parts), "id", "cls", ["x", "y"], b)
        assert [r.score for r in got.orderBy("b").collect()] == pytest.approx(want, abs=1e-12)


def test_a_signal_is_told_from_chance(spark):
    rows = [(i, "ab"[i % 2], float(i % 2) + (i * 37 % 11) / 20, 0.0) for i in range(200)]
    r = permutation.permutation_test(spark.createDataFrame(rows, SCHEMA), "id", "cls", ["x"], 99).first()
    assert r.observed > 0.95 and r.p_value == pytest.approx(0.01) and r.permutation_n == 99 and 0.35 < r.perm_mean < 0.6


def test_edges(spark):
    rows = cohort(60) + [(1000, None, 1.0, 1.0), (1001, "a", None, 1.0), (1002, "a", float("nan"), 1.0), (1003, "b", float("inf"), 1.0)]
    with_bad = permutation.scores(spark.createDataFrame(rows, SCHEMA), "id", "cls", ["x", "y"], 3).orderBy("b").collect()
    assert with_bad == permutation.scores(spark.createDataFrame(cohort(60), SCHEMA), "id", "cls", ["x", "y"], 3).orderBy("b").collect()
    one = permutation.scores(spark.createDataFrame([(i, "a", 1.0, 2.0) for i in range(9)], SCHEMA), "id", "cls", ["x", "y"], 2)
    assert [r.score for r in one.orderBy("b").collect()] == [1.0, 1.0, 1.0]
    none = spark.createDataFrame([], SCHEMA)
    assert permutation.scores(none, "id", "cls", ["x"], 2).count() == 0
    assert permutation.permutation_test(none, "id", "cls", ["x"], 2).first().permutation_n == 0
    lonely = permutation.scores(spark.createDataFrame([(1, "a", 1.0, 2.0), (2, "b", 2.0, 2.0)], SCHEMA), "id", "cls", ["x"], 2).collect()
    assert len(lonely) == 3
    twice = permutation.scores(spark.createDataFrame(cohort(40) * 2, SCHEMA), "id", "cls", ["x"], 2)
    assert twice.count() == 3
