from __future__ import annotations

import struct

import numpy as np
import pytest

from voxcohort.operators import grids
from voxcohort.operators import voxels as vx
from voxcohort.sources import volumes

COLUMNS = "patient_id string, phase string, z int, y int, x int, hu double, mask int, sz double, sy double, sx double, oz double, oy double, ox double, axes array<double>"
#: A quarter turn in the plane: the voxel axis y runs along -x of space, x along y.
QUARTER = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, -1.0, 0.0]


def header(shape, spacing=(1, 1, 1), quaternion=None, rows=None, offset=(0, 0, 0), flip=1.0) -> bytes:
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, *shape[::-1], 1, 1, 1, 1)
    struct.pack_into("<2h", head, 70, 16, 32)
    struct.pack_into("<8f", head, 76, flip, *spacing, 1, 1, 1, 1)
    struct.pack_into("<3f", head, 108, 352, 1, 0)
    struct.pack_into("<2h", head, 252, int(quaternion is not None), int(rows is not None))
    struct.pack_into("<6f", head, 256, *(quaternion or (0, 0, 0)), *offset)
    struct.pack_into("<12f", head, 280, *np.ravel(rows if rows is not None else np.zeros(12)))
    return bytes(head)


def test_orientation_of_matrix_and_quaternion():
    turned = np.array([[0, -2, 0, 7], [3, 0, 0, 8], [0, 0, 4, 9]], float)  # x of the file along y of space, y along -x
    a, spacing, origin, axes = volumes.decode_nifti(header((1, 1, 1), rows=turned) + bytes(4))
    assert (spacing, origin) == ((4.0, 2.0, 3.0), (9.0, 8.0, 7.0)) and axes == QUARTER
    half = 2**-0.5  # the same quarter turn about z
    _, spacing, origin, axes = volumes.decode_nifti(header((1, 1, 1), (3, 2, 4), (0, 0, half), offset=(7, 8, 9)) + bytes(4))
    assert (spacing, origin) == ((4.0, 2.0, 3.0), (9.0, 8.0, 7.0)) and axes == pytest.approx(QUARTER, abs=1e-6)
    _, _, _, axes = volumes.decode_nifti(header((1, 1, 1), quaternion=(0, 0, 0), flip=-1.0) + bytes(4))
    assert axes == [-1, 0, 0, 0, 1, 0, 0, 0, 1]
    assert volumes.decode_nifti(header((1, 1, 1)) + bytes(4))[3] == np.eye(3).ravel().tolist()


def rows(a, phase="C1", patient="p", spacing=(1.0, 1.0, 1.0), origin=(0.0, 0.0, 0.0), axes=None, mask=0):
    return [(patient, phase, *map(int, i), float(a[i]), mask if np.isscalar(mask) else int(mask[i]), *spacing, *origin, axes) for i in np.ndindex(a.shape)]


def test_a_turned_mask_resamples_as_by_hand(spark):
    mask = np.zeros((2, 3, 4), int)
    mask[0, 2, 1] = mask[1, 0, 3] = 1
    source = spark.createDataFrame(rows(mask, axes=QUARTER, mask=mask), COLUMNS).drop("hu")
    # Source voxel (z, y, x) lies at space (z, x, -y): the grid of 4 x 3 starts at x = -2.
    grid = spark.createDataFrame(rows(np.zeros((2, 4, 3)), origin=(0.0, 0.0, -2.0)), COLUMNS).drop("mask", "hu")
    got = {(r.z, r.y, r.x) for r in vx.resample_nearest(grid, source).collect() if r.mask}
    assert got == {(0, 1, 0), (1, 3, 2)}
    back = vx.resample_nearest(source.drop("mask"), spark.createDataFrame(rows(np.zeros((2, 4, 3)), origin=(0.0, 0.0, -2.0), mask=mask.transpose(0, 2, 1)[:, :, ::-1]), COLUMNS))
    assert {(r.z, r.y, r.x) for r in back.collect() if r.mask} == {(0, 2, 1), (1, 0, 3)}


def test_linear_values_on_tilted_axes(spark):
    c, s = np.cos(0.3), np.sin(0.3)
    axes = [1.0, 0.0, 0.0, 0.0, float(c), float(-s), 0.0, float(s), float(c)]
    plane = lambda z, y, x: 2 * z + 3 * y - x + 5
    source = np.fromfunction(lambda z, y, x: plane(z, c * y - s * x, s * y + c * x), (3, 12, 12))
    src = spark.createDataFrame(rows(source, axes=axes), COLUMNS)
    grid = spark.createDataFrame(rows(np.zeros((2, 3, 3)), origin=(0.5, 5.0, 5.0), axes=np.eye(3).ravel().tolist()), COLUMNS).drop("hu", "mask")
    got = vx.resample_linear(grid, src).collect()
    assert len(got) == 18
    for r in got:
        assert r.hu == pytest.approx(plane(r.z + 0.5, r.y + 5, r.x + 5), abs=1e-6)


def test_masks_of_other_sizes_are_resampled(spark):
    def read(a, kind, phase, **k):
        return [(r[0], r[1], kind, *r[2:5], r[5], *r[7:]) for r in rows(np.asarray(a, float), phase, **k)]

    image, half = np.arange(16.0).reshape(1, 4, 4), np.array([[[0, 1], [0, 0]]])
    data = read(image, "ct", "C1") + read(half, "mask", "C1", spacing=(1.0, 2.0, 2.0), origin=(0.0, 0.5, 0.5)) + read(image, "ct", "C2") + read(image > 9, "mask", "C2", origin=(5.0, 5.0, 5.0)) + read(image, "ct", "P") + read(half, "mask", "X")
    got = grids.with_masks(spark.createDataFrame(data, volumes.VOXELS)).collect()
    assert len(got) == 48
    assert {(r.y, r.x) for r in got if r.phase == "C1" and r["mask"]} == {(0, 2), (0, 3), (1, 2), (1, 3)}
    assert {r.hu for r in got if r.phase == "C2" and r["mask"]} == set(range(10, 16))  # of one size: by index
    assert {r["mask"] for r in got if r.phase == "P"} == {None}
    assert grids.with_masks(spark.createDataFrame([], volumes.VOXELS)).count() == 0


def test_enhancement_on_other_grids_and_failures(spark):
    ramp = np.fromfunction(lambda z, y, x: 10 * z + y + 100 * x, (3, 3, 3))
    post = np.full((2, 2, 2), 30.0)
    data = rows(ramp, "P") + rows(post, "C1", origin=(0.5, 0.5, 0.5), mask=1) + rows(ramp + 7, "C2", mask=1) + rows(post, "C3", spacing=(1.0, 0.0, 1.0), mask=1) + rows(post, "C1", "q", mask=1)
    out = grids.enhancement_on(spark.createDataFrame(data, COLUMNS))
    got = {(r.patient_id, r.phase, r.z, r.y, r.x): r for r in out.collect()}
    assert len(got) == 8 + 27 + 8 + 8
    for z, y, x in np.ndindex(2, 2, 2):
        pre = 10 * (z + 0.5) + y + 0.5 + 100 * (x + 0.5)
        assert got["p", "C1", z, y, x].enhancement == pytest.approx(30 - pre)
        assert got["p", "C3", z, y, x].enhancement is None and got["p", "C3", z, y, x].pre_failed
        assert got["q", "C1", z, y, x].enhancement is None and not got["q", "C1", z, y, x].pre_failed
    assert got["p", "C2", 2, 2, 2].enhancement == pytest.approx(ramp[2, 2, 2] + 7 - 200) and got["p", "C2", 0, 0, 1].enhancement == 7
    from pyspark.sql import functions as F

    rule = {(r.patient_id, r.phase): r.necrosis_qc_method for r in vx.necrosis(out.withColumn("dist_in", F.lit(1.0))).collect()}
    assert rule == {("p", "C1"): "hybrid_hu_band_plus_enhancement", ("p", "C2"): "hybrid_hu_band_plus_enhancement", ("p", "C3"): "hu_band_only_resample_failed", ("q", "C1"): "hu_band_only"}
