"""Helpers against brute force: geometry, tails, filters, attributions, components, volumes."""

from __future__ import annotations

import gzip
import itertools
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxcohort.functions import geometry, tails
from voxcohort.operators import evaluate, features, models, prep, ranks, summary
from voxcohort.operators import voxels as vx
from voxcohort.plans.graph import connected_components
from voxcohort.sources import volumes

rng = np.random.default_rng(7)


def test_distances_against_all_pairs():
    mask = rng.random((5, 6, 7)) < 0.4
    spacing = (2.5, 0.8, 1.1)
    inside, outside = geometry.signed_distances(mask, spacing)
    padded = np.pad(mask, 1)
    faces = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
    points = list(np.ndindex(mask.shape))
    near = lambda p: [padded[p[0] + 1 + a, p[1] + 1 + b, p[2] + 1 + c] for a, b, c in faces]
    edge = [p for p in points if mask[p] and not all(near(p))]
    first = [p for p in points if not mask[p] and any(near(p))]
    for p in points:
        d = min(math.dist(np.multiply(p, spacing), np.multiply(q, spacing)) for q in (edge if mask[p] else first))
        assert math.isclose((inside if mask[p] else outside)[p], d, abs_tol=1e-9)
        assert (outside if mask[p] else inside)[p] == 0
    empty = geometry.signed_distances(np.zeros((2, 2, 2), bool), spacing)
    assert not empty[0].any() and np.isnan(empty[1]).all()


def test_components_and_fields():
    two = np.zeros((4, 4, 4), bool)
    two[0, 0, 0] = two[1, 1, 1] = two[3, 3, 3] = True
    assert geometry.components(two).max() == 2
    assert geometry.components(np.zeros((2, 2, 2), bool)).max() == 0
    z, y, x = np.indices((9, 9, 9)).astype(float)
    ramp = 3 * x * 0.8 + 2 * y
    assert np.allclose(geometry.gradient_magnitude(ramp, (1.0, 1.0, 0.8))[4, 4, 4], math.hypot(3, 2))
    assert np.allclose(geometry.local_deviation(np.full((5, 5, 5), 7.0), (1, 1, 1)), 0)
    a = rng.random((6, 6, 6))
    k = geometry._kernel(5 / 2.355, 1.0, 0)
    r = len(k) // 2
    p = np.pad(a, r, mode="edge")
    w = k[:, None, None] * k[None, :, None] * k[None, None, :]
    block = p[2 : 2 + 2 * r + 1, 3 : 3 + 2 * r + 1, 1 : 1 + 2 * r + 1]
    want = math.sqrt((w * block**2).sum() - (w * block).sum() ** 2)
    assert math.isclose(geometry.local_deviation(a, (1, 1, 1))[2, 3, 1], want, rel_tol=1e-9)


def test_tails():
    for x in (0.1, 1.0, 7.5, 60.0):
        assert math.isclose(tails.gamma_upper(1.0, x / 2), math.exp(-x / 2), rel_tol=1e-12)
        assert math.isclose(tails.gamma_upper(0.5, x / 2), math.erfc(math.sqrt(x / 2)), rel_tol=1e-10)
    assert math.isclose(tails.t_two_sided(1.0, 1), 0.5, rel_tol=1e-12)
    assert math.isclose(tails.t_two_sided(2.0, 2), 1 - 2 / math.sqrt(6), rel_tol=1e-12)
    for m, n in ((3, 4), (2, 5), (4, 4)):
        values = range(m + n)
        us = [sum(a > b for a in s for b in set(values) - set(s)) for s in itertools.combinations(values, m)]
        for u in range(m * n + 1):
            p = 2 * sum(v >= max(u, m * n - u) for v in us) / len(us)
            assert math.isclose(tails.mwu_exact(u, m, n), min(1, p), rel_tol=1e-12)


def test_correlation_rules():
    names, f = ["a", "b", "c"], {"a": 1.0, "b": 2.0, "c": 0.5}
    linked = {("a", "b"), ("a", "c")}
    assert prep.drop_correlated(names, linked, f, "fscore") == ["b"]  # a goes for b, and still drops c
    assert prep.drop_correlated(names, linked, f, "fscore_break") == ["b", "c"]
    assert prep.drop_correlated(names, linked, f, "later") == ["a"]
    assert prep.drop_correlated(names, {("a", "b"), ("b", "c")}, None, "later") == ["a"]
    assert prep.drop_correlated(names, {("a", "b"), ("b", "c")}, None, "fscore") == ["a", "c"]
    assert prep.drop_correlated(names, {("a", "b")}, {"a": 1.0, "b": 1.0}, "fscore") == ["a", "c"]


def test_attributions_against_all_coalitions():
    nodes = [
        {"id": 0, "left": 1, "right": 2, "stats": [6.0, 4.0], "feature": 0, "threshold": 0.5},
        {"id": 1, "left": 3, "right": 4, "stats": [5.0, 1.0], "feature": 2, "threshold": 0.3},
        {"id": 2, "left": -1, "right": -1, "stats": [1.0, 3.0], "feature": -1, "threshold": None},
        {"id": 3, "left": 5, "right": 6, "stats": [2.0, 1.0], "feature": 0, "threshold": 0.2},
        {"id": 4, "left": -1, "right": -1, "stats": [3.0, 0.0], "feature": -1, "threshold": None},
        {"id": 5, "left": -1, "right": -1, "stats": [0.0, 1.0], "feature": -1, "threshold": None},
        {"id": 6, "left": -1, "right": -1, "stats": [2.0, 0.0], "feature": -1, "threshold": None},
    ]
    by = {n["id"]: n for n in nodes}

    def value(i, x, known):
        n = by[i]
        if n["left"] < 0:
            return np.array(n["stats"]) / sum(n["stats"])
        if n["feature"] in known:
            return value(n["left"] if x[n["feature"]] <= n["threshold"] else n["right"], x, known)
        a, b = sum(by[n["left"]]["stats"]), sum(by[n["right"]]["stats"])
        return (a * value(n["left"], x, known) + b * value(n["right"], x, known)) / (a + b)

    trees = [models.leaves(nodes)]
    xs = rng.random((20, 3))
    got = models.row_attributions(trees, xs, 3)
    for x, phi in zip(xs, got, strict=True):
        for i in range(3):
            want = 0
            for s in itertools.chain.from_iterable(itertools.combinations([j for j in range(3) if j != i], k) for k in range(3)):
                want = want + math.factorial(len(s)) * math.factorial(2 - len(s)) / 6 * (value(0, x, {*s, i}) - value(0, x, set(s)))
            assert np.allclose(phi[:, i], want)
        assert np.allclose(phi.sum(1), value(0, x, {0, 1, 2}) - value(0, x, set()))


def test_attributions_add_up_on_a_fitted_forest(spark):
    rows = spark.range(120).selectExpr("id", "cast(id % 7 AS double) AS a", "cast(id * 13 % 11 AS double) AS b", "cast(id % 3 AS string) AS class")
    fitted, model = models.refit(rows, "none", ["a", "b"], "class", {"numTrees": 3, "maxDepth": 3})
    ready = models.assembled(fitted.transform(rows), fitted.features)
    x = np.array([r.features.toArray() for r in ready.collect()])
    phi = models.row_attributions(models.saved_trees(model, ready), x, 2)
    p = np.array([r.probability.toArray() for r in model.transform(ready).collect()])
    base = p - phi.sum(2)
    assert np.allclose(base, base[0])


def test_components_of_random_graphs(spark):
    r = random.Random(3)
    for n, m in ((60, 40), (200, 150), (30, 0)):
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(300, 340)] * (m > 0)
        top = {}

        def find(a, top=top):
            while top.setdefault(a, a) != a:
                a = top[a]
            return a

        for a, b in edges:
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
        got = {q.node: q.component for q in connected_components(spark.createDataFrame(edges or [(None, None)], "a long, b long")).collect()}
        assert got == {a: find(a) for e in edges for a in e}


def test_small_statistics(spark):
    rows = [("f", "a", 1.0), ("f", "a", 2.0), ("f", "a", 2.0), ("f", "b", 3.0), ("f", "b", 4.0), ("f", "b", 2.0), ("f", "c", 9.0), ("f", "c", 8.0), ("f", "b", None), ("g", "a", 1.0), ("g", "b", 1.0), *[("h", c, 5.0) for c in "aaabbb"]]
    long = spark.createDataFrame(rows, "feature string, class string, value double")
    k = ranks.kruskal(long, "class").collect()
    assert [(r.feature, r.k, r.n) for r in k] == [("f", 2, 6)]  # c has two values, g too few, h never varies
    p = spark.createDataFrame([(i, v) for i, v in enumerate([0.01, 0.04, 0.03, None, 1.0, 0.03])], "i int, p double")
    q = {r.i: r.q for r in ranks.benjamini_hochberg(p, "p").collect()}
    assert q[3] is None and math.isclose(q[0], 0.05) and math.isclose(q[2], 0.05) and math.isclose(q[1], 0.05) and q[4] == 1.0
    pairs = [(i, float(i), i + (0.5 if i % 2 else -0.5)) for i in range(10)]
    icc = lambda n: summary.icc2(spark.createDataFrame(pairs[:n], "i int, a double, b double"), [], "a", "b").first()
    assert icc(9).icc is None and icc(9).low is None and 0.9 < icc(10).icc < 1
    mw = spark.createDataFrame([("f", "a", float(i)) for i in (1, 4, 6)] + [("f", "b", float(i)) for i in (2, 7, 8, 9)], "feature string, class string, value double")
    r = ranks.mannwhitney_pairs(mw, "class", [("a", "b")], 3).first()
    assert r.u == 2 and math.isclose(r.p, tails.mwu_exact(2, 3, 4)) and math.isclose(r.p_bonf, min(1, 3 * r.p))


def test_folds_and_partitions(spark):
    df = spark.range(101).selectExpr("id", "if(id < 20, 'x', if(id < 50, 'y', 'z')) AS class")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(sorted(map(tuple, evaluate.stratified_folds(df, "id", "class", 5).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", was)
    assert seen[0] == seen[1]
    for c in "xyz":
        sizes = [sum(r[1] == c and r[2] == k for r in seen[0]) for k in range(5)]
        assert max(sizes) - min(sizes) <= 1


def test_fits_see_the_training_rows_only(spark):
    df = spark.createDataFrame([(float(i), None if i % 3 == 0 else float(i * i)) for i in range(30)], "a double, b double")
    train = df.filter("a < 20")
    one, two = (prep.median_imputer(x, ["a", "b"]).fill for x in (train, train.union(df.filter("a >= 20").limit(0))))
    assert one == two and one["a"] == 9.5
    assert prep.standardizer(spark.createDataFrame([(1.0,), (1.0,)], "a double"), ["a"]).centre == {"a": (1.0, 1.0)}


def test_name_rules():
    shift, remove = features.classify_location_features(["C1_enh_median", "C1_boundary_boundary_grad_median", "C1_boundary_gradient_median", "C1_tlr_liver_ref_median", "C1_tlr_liver_ref_mad", "n_lesions", "P_zone_1_p90", "C2_rim_core_ratio_median"])
    assert shift == ["C1_enh_median", "C1_boundary_boundary_grad_median", "P_zone_1_p90"] and remove == ["C1_tlr_liver_ref_median"]


def test_balls_and_bands(spark):
    assert len(vx.ball(1.0, (1.0, 1.0, 1.0))) == 19 and len(vx.ball(2.0, (1.0, 1.0, 1.0))) == 81
    d = spark.createDataFrame([(0.0, 1), (0.0, 0), (3.0, 0), (4.0, 0), (16.0, 0)], "dist_out double, mask int")
    assert sorted((r.dist_out, r.inner) for r in vx.assign_bands(d, vx.BANDS).collect()) == [(0.0, 0.0), (3.0, 0.0), (3.0, 3.0), (4.0, 3.0)]
    own = spark.createDataFrame([("p", "a", 0.0, 3.0), ("p", "b", 3.0, 3.0), ("p", "c", -2.0, 0.0), ("p", "d", 5.0, 4.0), ("q", "e", 0.0, 99.0), (None, "f", 0.0, 9.0), ("p", "g", None, 9.0)], "patient_id string, band string, inner double, outer double")
    rows = d.withColumn("patient_id", F.lit("p"))
    assert sorted((r.dist_out, r.band) for r in vx.join_bands(rows, own).collect()) == [(0.0, "a"), (0.0, "c"), (3.0, "a"), (3.0, "b")]


@pytest.mark.parametrize("zipped", [False, True])
def test_volume_reader(spark, tmp_path, zipped):
    a = np.arange(2 * 3 * 4, dtype="<i2").reshape(2, 3, 4)  # z, y, x
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 4, 4, 3, 2, 2, 1, 1, 1)
    struct.pack_into("<2h", head, 70, 4, 16)
    struct.pack_into("<8f", head, 76, 1, 0.5, 0.75, 2.0, 1, 1, 1, 1)
    struct.pack_into("<3f", head, 108, 352, 2.0, 1.0)
    struct.pack_into("<3f", head, 268, 10, 20, 30)
    data = bytes(head) + a.tobytes() + (a + 2).tobytes()  # two frames, averaged
    ending = "nii.gz" if zipped else "nii"
    for name in ("p1_C1", "p1_mask_C1"):
        (tmp_path / f"{name}.{ending}").write_bytes(gzip.compress(data) if zipped else data)
    manifest = spark.createDataFrame([("p1", "C1", f"{tmp_path}/p1_C1.{ending}", f"{tmp_path}/p1_mask_C1.{ending}")], "patient_id string, phase string, ct_path string, mask_path string")
    got = volumes.read_voxels(spark, manifest, str(tmp_path)).filter("kind = 'ct'").collect()
    assert {(r.z, r.y, r.x): r.value for r in got} == {p: (a[p] + 1) * 2.0 + 1 for p in np.ndindex(a.shape)}
    assert {(r.sz, r.sy, r.sx, r.oz, r.oy, r.ox) for r in got} == {(2.0, 0.75, 0.5, 30.0, 20.0, 10.0)}


def test_clinical_table(spark, tmp_path):
    (tmp_path / "c.csv").write_text("cancer_type,patient_id,extra\nHCC, 007 ,1\n,8,2\n")
    got = [tuple(r) for r in volumes.read_clinical(spark, str(tmp_path / "c.csv")).collect()]
    assert got == [("007", "HCC", None, None, None), ("8", None, None, None, None)]
    volumes.write_table(spark.createDataFrame(got, volumes.CLINICAL), str(tmp_path / "out"), ["cancer_type"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
