"""Registered voxel queries without SQL against brute force."""

from __future__ import annotations

import numpy as np

from voxcohort.operators import voxels as vx
from voxcohort.plans import queries_voxels as qv
from voxcohort.plans import registry

SF = "/root/testdata/sf0.001"


def test_signed_distances_of_all_volumes(spark):
    want = qv.voxels(spark, SF).toPandas()
    got = registry.QUERIES["signed_distances_all"](spark, SF).toPandas()
    keys = ["patient_id", "phase", "z", "y", "x"]
    n = spark.read.parquet(f"{SF}/supplier.parquet").count()
    assert n > 4 and got[keys[:2]].drop_duplicates().shape[0] == 3 * n
    assert len(got) == len(want) == 3 * n * qv.NZ * qv.NY * qv.NX
    both = want.merge(got, on=keys)
    assert len(both) == len(want)
    scale = np.array([qv.SPACING["sz"], qv.SPACING["sy"], qv.SPACING["sx"]])
    for _, volume in both.groupby(keys[:2]):
        volume = volume.sort_values(["z", "y", "x"])
        mask = volume["mask"].to_numpy().reshape(qv.NZ, qv.NY, qv.NX) > 0
        padded = np.pad(mask, 1)
        beside = np.stack([np.roll(padded, s, a)[1:-1, 1:-1, 1:-1] for a in range(3) for s in (-1, 1)])
        for side, column, edge in ((mask, "dist_in", mask & ~beside.all(0)), (~mask, "dist_out", ~mask & beside.any(0))):
            p, q = np.argwhere(side) * scale, np.argwhere(edge) * scale
            apart = np.sqrt(((p[:, None] - q[None]) ** 2).sum(-1)).min(1)
            whole = np.zeros(mask.shape)
            whole[side] = apart
            assert np.allclose(volume[column].to_numpy().reshape(mask.shape), whole, atol=1e-5)


def test_boundary_and_local_blocks_against_arrays(spark):
    """What the blocks make of gradient and local deviation, in all volumes, by arrays."""
    v, _ = qv.fields(spark, SF)
    volumes = {k: g.sort_values(["z", "y", "x"]) for k, g in v.toPandas().groupby(["patient_id", "phase"])}
    spread = lambda x: np.median(np.abs(x - np.median(x)))
    edge = {(r.patient_id, r.phase): r for r in vx.boundary(v).collect()}
    local = {(r.patient_id, r.phase): r for r in vx.local_heterogeneity(v).collect()}
    assert set(edge) == set(local) == set(volumes)
    for key, g in volumes.items():  # the gradient and deviation themselves are compared in test_helpers.py
        near = ((g["dist_in"] > 0) & (g["dist_in"] <= 1)) | ((g["dist_out"] > 0) & (g["dist_out"] <= 1))
        band = g[near]
        r = edge[key]
        assert np.isclose(r.boundary_grad_median, band["grad"].median()) and np.isclose(r.boundary_grad_mad, spread(band["grad"]))
        assert np.isclose(r.boundary_irregularity_3d, spread(band["grad"]) / (band["grad"].median() + 1e-5))
        sides = [band["hu"][band["mask"] == m] for m in (1, 0)]
        if all(len(s) for s in sides):
            assert np.isclose(r.boundary_gradient, sides[0].median() - sides[1].median())
        inside = g["local_std"][g["mask"] > 0]
        r = local[key]
        assert np.isclose(r.local_hetero_median, inside.median()) and np.isclose(r.local_hetero_mad, spread(inside)) and np.isclose(r.local_hetero_p90, inside.quantile(0.9))
        assert np.isclose(r.high_hetero_fraction, (inside > inside.quantile(0.75)).mean())
