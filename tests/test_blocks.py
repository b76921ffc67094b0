from __future__ import annotations

import numpy as np
import pytest

from voxcohort.functions import geometry
from voxcohort.operators import blocks
from voxcohort.sources import batches

BOX = "patient_id string, z int, y int, x int, mask int"


def table(spark, volumes: dict, shift: int = 0):
    rows = [(p, *(int(i) + shift for i in at), int(m[at])) for p, m in volumes.items() for at in np.ndindex(m.shape)]
    return spark.createDataFrame(rows, BOX)


@pytest.mark.parametrize("block", [2, 3, 64])
def test_components_over_blocks(spark, block):
    """Masks that cross borders at faces, edges and corners, a spiral, noise, and an empty mask."""
    rng = np.random.default_rng(3)
    corner = np.zeros((6, 6, 6), bool)
    corner[np.arange(6), np.arange(6), np.arange(6)] = True
    corner[5, 0, 0] = corner[4, 1, 0] = True
    spiral = np.zeros((1, 7, 7), bool)
    for k in range(0, 7, 2):
        spiral[0, k, :] = True
        if k < 6:
            spiral[0, k + 1, 0 if k % 4 else 6] = True
    volumes = {"corner": corner, "spiral": spiral, "noise": rng.random((7, 6, 5)) < 0.12, "none": np.zeros((2, 2, 2), bool)}
    got = blocks.components(table(spark, volumes, -2), ["patient_id"], block).collect()
    want = {}
    for p, m in volumes.items():
        labels = geometry.components(m)
        want |= {(p, *(int(i) - 2 for i in at)): int(labels[at]) for at in np.ndindex(m.shape) if m[at]}
    assert {(r.patient_id, r.z, r.y, r.x): r.component for r in got} == want and len(got) == len(want)


def test_distances_by_lines(spark):
    rng = np.random.default_rng(5)
    volumes = {"a": rng.random((4, 5, 6)) < 0.05, "b": rng.random((3, 3, 9)) < 0.3, "none": np.zeros((2, 3, 2), bool)}
    volumes["a"][0, 0, 0] = True
    got = {(r.patient_id, r.z, r.y, r.x): r.distance for r in blocks.distances(table(spark, volumes), (2.5, 1.0, 0.7), ["patient_id"], "mask = 1").collect()}
    for p, m in volumes.items():
        want = geometry.distance_to(m, (2.5, 1.0, 0.7))
        for at in np.ndindex(m.shape):
            assert got[p, *at] is None if p == "none" else got[p, *at] == pytest.approx(want[at])


def test_a_batch_that_died_is_written_once(spark, tmp_path):
    path, calls = str(tmp_path / "features"), []
    ids = spark.range(45).selectExpr("cast(id AS string) AS patient_id")

    def work(some):
        calls.append(some.count())
        if len(calls) == 2:
            raise RuntimeError("killed")
        return some.selectExpr("patient_id", "length(patient_id) AS n")

    with pytest.raises(RuntimeError, match="killed"):
        batches.resume(ids, "patient_id", work, path)
    # A folder without a row in the log is not part of the table.
    ids.selectExpr("patient_id", "1 AS n").write.parquet(f"{path}/rows/b00000002")
    assert batches.read_batches(spark, path).count() == 20
    assert batches.resume(ids, "patient_id", work, path) == 2
    assert batches.resume(ids, "patient_id", work, path) == 0
    rows = batches.read_batches(spark, path)
    assert rows.count() == 45 and rows.select("patient_id").distinct().count() == 45
    assert {(r.batch, r.n) for r in batches.committed(spark, path).collect()} == {("b00000000", 20), ("b00000001", 20), ("b00000002", 5)}
    assert not batches.append_batch(ids, path, "b00000001")
    assert batches.read_batches(spark, str(tmp_path / "nothing"), "a int").columns == ["a"]
