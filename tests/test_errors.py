from __future__ import annotations

import struct

import numpy as np
import pytest

from voxcohort.operators import errors
from voxcohort.operators import voxels as vx
from voxcohort.operators.cohort import error_summary
from voxcohort.sources import volumes

MANIFEST = "patient_id string, phase string, ct_path string, mask_path string"


def nifti(a: np.ndarray) -> bytes:
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, *a.shape[::-1], 1, 1, 1, 1)
    struct.pack_into("<2h", head, 70, 16, 32)
    struct.pack_into("<8f", head, 76, 1, 0.5, 0.75, 2, 1, 1, 1, 1)
    struct.pack_into("<3f", head, 108, 352, 1, 0)
    return bytes(head) + a.astype("<f4").tobytes()


@pytest.fixture()
def folder(tmp_path):
    """Two patients whose files have the same names in two folders, a broken file, a file of no one."""
    for k, name in enumerate(("a", "b", "c")):
        (tmp_path / name).mkdir()
        for kind in ("ct", "mask"):
            (tmp_path / name / f"{kind}_C1.nii").write_bytes(nifti(np.full((3, 2, 2), float(k + 10 * (kind == "mask")))))
    (tmp_path / "c" / "ct_C1.nii").write_bytes(b"not a volume at all" * 30)
    (tmp_path / "a" / "other.nii").write_bytes(b"")
    return tmp_path


def manifest(spark, folder):
    rows = [(n, "C1", f"{folder}/{n}/ct_C1.nii", f"file://{folder}/{n}/mask_C1.nii") for n in "abc"] + [("d", "C1", f"{folder}/d/ct_C1.nii", None), ("a", "P", f"{folder}/a/other.nii", None)]
    return spark.createDataFrame(rows, MANIFEST)


def test_files_go_by_their_whole_path(spark, folder, monkeypatch):
    monkeypatch.setattr(volumes, "SLAB", 4)
    good = manifest(spark, folder).filter("patient_id IN ('a', 'b')")
    got = volumes.read_voxels(spark, good, f"{folder}/*/*.nii", phases=["C1"]).collect()
    assert len(got) == 4 * 12
    assert {(r.patient_id, r.kind): r.value for r in got} == {("a", "ct"): 0.0, ("b", "ct"): 1.0, ("a", "mask"): 10.0, ("b", "mask"): 11.0}
    assert sorted((r.z, r.y, r.x) for r in got if (r.patient_id, r.kind) == ("a", "ct")) == sorted(np.ndindex(3, 2, 2))
    assert {r.kind for r in volumes.read_voxels(spark, good, f"{folder}/*/*.nii", ["C1"], ["mask"]).collect()} == {"mask"}


def test_scan_goes_on_past_broken_and_missing_files(spark, folder):
    rows, failed = volumes.scan_volumes(spark, manifest(spark, folder), f"{folder}/*/*.nii")
    assert {(r.patient_id, r.kind): r["count"] for r in rows.groupBy("patient_id", "kind").count().collect()} == {(p, k): 12 for p, k in (("a", "ct"), ("a", "mask"), ("b", "ct"), ("b", "mask"), ("c", "mask"))}
    assert rows.columns == [f.split()[0] for f in volumes.VOXELS.split(", ")]
    got = {(r.patient_id, r.phase, r.kind): r for r in failed.collect()}
    assert set(got) == {("c", "C1", "ct"), ("d", "C1", "ct"), ("a", "P", "ct")}
    assert got["d", "C1", "ct"].error_type == "FileNotFoundError" and all(r.traceback_short and r.feature_block == "read" for r in got.values())
    with pytest.raises(RuntimeError, match="2 x FileNotFoundError in read; 1 x"):
        errors.raise_on(failed)
    assert {(r.error_type, r["n"]) for r in error_summary(failed).collect()} >= {("FileNotFoundError", 2)}
    with pytest.raises(Exception, match="FileNotFoundError|not a volume|unpack|unsupported"):
        volumes.read_voxels(spark, manifest(spark, folder), f"{folder}/*/*.nii").collect()


def test_a_broken_volume_gives_an_error_row_and_the_others_finish(spark):
    box = [(str(p), "C1", z, y, x, float(x), int(z == y == 1), None) for p in range(5) for z in range(3) for y in range(3) for x in range(4)]
    box.append(("1", "C1", 0, 0, 0, 1.0, 0, None))  # twice in one place
    box.append(("2", "C1", 0, 0, None, 1.0, 0, None))
    v = spark.createDataFrame(box, "patient_id string, phase string, z int, y int, x int, hu double, mask int, liver int")
    meta = spark.createDataFrame([(str(p), "C1", 0.0 if p == 4 else 1.0, 1.0, 1.0) for p in range(5) if p != 3], "patient_id string, phase string, sz double, sy double, sx double")
    rows, failed = vx.fields_or_errors(v, meta)
    assert {r.patient_id for r in rows.select("patient_id").distinct().collect()} == {"0"}
    want = vx.with_fields(v.filter("patient_id = '0'"), meta)
    assert sorted(map(str, rows.collect())) == sorted(map(str, want.collect())) and rows.columns == want.columns
    got = {r.patient_id: (r.feature_block, r.error_type, r.message) for r in failed.collect()}
    assert got == {"1": ("fields", "ValueError", "two voxels in one place"), "2": ("fields", "ValueError", "voxels without place, intensity or mask"), "3": ("fields", "ValueError", "no spacing above 0"), "4": ("fields", "ValueError", "no spacing above 0")}
    errors.raise_on(failed.limit(0))
    empty = vx.fields_or_errors(v.limit(0), meta)
    assert empty[0].count() == empty[1].count() == 0
