from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxcohort.operators import evaluate, models, summary

SF = "/root/testdata/sf0.001"
FEATURES = [f"x{i}" for i in range(4)]


@pytest.fixture(scope="module")
def table(spark):
    """150 rows of three classes that x0 and x1 tell apart; x2 is noise and x3 a copy of x0."""
    rng = np.random.default_rng(4)
    rows = [(i, str(i % 3), float((i % 3 == 0) * 2 + rng.normal()), float((i % 3 == 1) * 2 + rng.normal()), float(rng.normal())) for i in range(150)]
    return spark.createDataFrame(rows, "id long, class string, x0 double, x1 double, x2 double").withColumn("x3", F.col("x0") * 2 + 1).withColumn("flat", F.lit(1.0)).cache()


def test_boosted_trees_go_through_the_selecting_arms(table, monkeypatch):
    monkeypatch.setattr(models, "probe", lambda factory: {"maxIter": 2, "maxDepth": 2})
    got = models.nested_cv(table, ("full", "attribution"), FEATURES, "id", "class", outer=2, inner=2, n_iter=1, grid={"maxIter": (2,), "maxDepth": (2,)}, factory=models.boosted, top=2, tops=(2,))
    kept = {}
    for r in got.features.collect():
        kept.setdefault((r.arm, r.fold), set()).add(r.feature)
    assert all(len(kept["full", k]) == len(kept["attribution", k]) == 2 for k in (0, 1))
    assert got.predictions.count() == 300


def test_boosted_attributions_add_up_to_the_margin(spark, table):
    rows = models.assembled(evaluate.balanced_weights(models.labelled(table, "class"), "class"), FEATURES)
    model = models.boosted(maxIter=3, maxDepth=2).fit(rows)
    trees = models.saved_trees(model, rows)
    x = np.array([r["features"].toArray() for r in rows.select("features").limit(40).collect()])
    got = models.row_attributions(trees, x, 4).sum(2)
    for c, m in enumerate(model.models):
        margin = np.array([sum(w * t.predict(r) for t, w in zip(m.trees, m.treeWeights)) for r in rows.select("features").limit(40).toPandas()["features"]])
        apart = margin - got[:, c]
        assert np.ptp(apart) < 1e-9  # what is left is the margin's mean over the cover


def folded(table, outer=2, inner=2):
    base = evaluate.stratified_folds(models.labelled(table, "class"), "id", "class", outer, 1)
    return evaluate.stratified_folds(base, "id", "class", inner, 2, ["fold"], "inner_fold").withColumn("true_label", F.col("class")).cache()


def test_inner_search_tries_its_sets(table):
    folds = models.Folds(folded(table), FEATURES, ["0", "1", "2"], 2, 2, models.forest, 30)
    assert folds.search("none", 0, [{"numTrees": 5, "maxDepth": 0}, {"numTrees": 5, "maxDepth": 4}], 2) == {"numTrees": 5, "maxDepth": 4}
    sets = [{"numTrees": 5, "maxDepth": 4, "top": 1}, {"numTrees": 5, "maxDepth": 4, "top": 3}]
    assert folds.search("full", 1, sets, 2)["top"] in (1, 3)
    assert len(models.drawn(models.GRID, 25, 42)) == 25 and len(models.drawn({"a": (1, 2)}, 25, 42)) == 2


def with_gaps(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(240):
        x = [float(v) for v in rng.normal(size=4) * (1, 10, 0.1, 1000) + (0, 5, 100, -3)]
        x.append(x[0] * 3 + rng.normal() * 0.2)
        gone = rng.random(5) < 0.15
        gone[4] = gone[0]  # e follows a, with its gaps
        rows.append((i, str(i % 3), *(None if g else v + (i % 3) * 0.3 for g, v in zip(gone, x, strict=True)), 4.0, None))
    return spark.createDataFrame(rows, "id long, class string, a double, b double, c double, d double, e double, flat double, empty double")


def test_fold_sums_give_what_a_fit_on_the_rows_gives(spark):
    names = ["a", "b", "c", "d", "e", "flat", "empty"]
    base = folded(with_gaps(spark), 3, 2)
    folds = models.Folds(base, names, ["0", "1", "2"], 3, 2, models.forest, 30)
    for k, j in ((0, None), (1, 0), (2, 1)):
        train = folds.rows(k, j)
        want = models.build_arm(train, "correlation", names, "class")
        got = folds.prepared("correlation", k, j)
        assert got.features == want.features and not {"a", "e"} <= set(got.features)
        assert got.steps[0].fill == pytest.approx(want.steps[0].fill)
        for c in names:
            assert got.steps[1].centre[c] == pytest.approx(want.steps[1].centre[c], abs=1e-9)
        weights = {r["label"]: r["weight"] for r in folds.rows(k).select("label", "weight").distinct().collect()}
        assert weights == pytest.approx({r["label"]: r["weight"] for r in evaluate.balanced_weights(folds.rows(k).drop("weight"), "class").select("label", "weight").distinct().collect()})


def test_no_left_out_row_enters_a_fit(spark):
    """Other values, gaps and a feature that gives the class away in the left-out rows change nothing that is fitted without them."""
    names = ["a", "b", "c", "d", "e"]
    base = folded(with_gaps(spark), 3, 2)
    fitted = models.Folds(base, names, ["0", "1", "2"], 3, 2, models.forest, 30)
    for k, j in ((1, 0), (2, None)):
        out = (F.col("fold") == k) if j is None else (F.col("fold") == k) | (F.col("inner_fold") == j)
        leak = base.withColumns({"a": F.when(out, F.col("label") * 1000).otherwise(F.col("a")), "b": F.when(out, None).otherwise(F.col("b")), "c": F.when(out, F.col("e") * 7).otherwise(F.col("c"))})
        other = models.Folds(leak, names, ["0", "1", "2"], 3, 2, models.forest, 30)
        for arm in ("none", "correlation"):
            x, y = fitted.prepared(arm, k, j), other.prepared(arm, k, j)
            assert x.features == y.features and x.steps[0].fill == y.steps[0].fill
            for c in names:
                assert x.steps[1].centre[c] == pytest.approx(y.steps[1].centre[c], abs=1e-8)
        assert fitted.ranking("full", fitted.prepared("full", k, j), fitted.rows(k, j)) == other.ranking("full", other.prepared("full", k, j), other.rows(k, j))


def test_fold_metrics_name_the_parameters(table):
    got = models.nested_cv(table, ("none",), FEATURES, "id", "class", outer=2, inner=2, n_iter=2, grid={"numTrees": (3,), "maxDepth": (2, 3)})
    rows = got.fold_metrics(["0", "1", "2"]).collect()
    assert len(rows) == 2 and sum(r.n_test for r in rows) == 150 and all("maxDepth=" in r.best_params and r.f1_macro > 0.3 for r in rows)


def test_groups_without_features_have_null_metrics(table):
    groups = {"all": FEATURES, "none": [], "constant": ["flat"]}
    how = {"k": 2, "numTrees": 3, "maxDepth": 2}
    got = {r["arm"]: r for r in models.ablation(table, groups, "id", "class", ["0", "1", "2"], **how).collect()}
    assert set(got) == set(groups)
    value = [c for c in got["all"].asDict() if c.startswith("accuracy")][0]
    assert got["all"][value] > 0.4 and got["none"][value] is None and got["constant"][value] is None
    sets = {r["arm"]: r for r in models.model_set_comparison(table, groups, "id", "class", ["0", "1", "2"], **how).collect()}
    assert sets["all"]["auc_ovr"] > 0.6 and sets["none"]["auc_ovr"] is None
    assert models.ablation(table, {"none": []}, "id", "class", ["0", "1", "2"], **how).count() == 1


def test_sensitivity_folds_are_scaled_and_selected(table):
    rows = evaluate.balanced_weights(models.labelled(table, "class"), "class")
    fitted = models.scaled_fold(rows, [*FEATURES, "flat"], "class", top=2)
    assert len(fitted.features) == 2 and "x2" not in fitted.features and not {"x0", "x3"} <= set(fitted.features)
    now = fitted.transform(rows).agg(*(F.avg(f).alias(f) for f in fitted.features)).first()
    assert all(abs(v) < 1e-9 for v in now)


def test_regression_p(spark):
    rows = [("a", 1.5, 60.0), ("a", 4.5, 55.0), ("a", 7.5, 57.0), ("a", 10.5, 50.0), ("a", 13.5, 51.0), ("b", 1.0, 2.0), ("b", 2.0, 5.0), ("c", 1.0, 2.0), ("c", 2.0, 2.0), ("c", 3.0, 2.0), ("d", 1.0, 1.0), ("d", 1.0, 2.0)]
    got = {r["g"]: r for r in summary.linregress(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "x", "y").collect()}
    x, y = np.array([r[1:] for r in rows if r[0] == "a"]).T
    r = np.corrcoef(x, y)[0, 1]
    t = abs(r) * math.sqrt(3 / (1 - r * r))
    want = 1 - 2 / math.pi * (math.atan(t / math.sqrt(3)) + t * math.sqrt(3) / (3 + t * t))  # Student's t with three degrees of freedom
    assert got["a"]["p"] == pytest.approx(want, rel=1e-9)
    assert got["b"]["p"] == 0 and (got["c"]["r"], got["c"]["p"]) == (0, 1) and got["d"]["p"] is None
