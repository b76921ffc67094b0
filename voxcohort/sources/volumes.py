"""Readers and writers: clinical tables, NIfTI volumes as voxel tables, result tables."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxcohort.operators.errors import ERROR, described, split
from voxcohort.plans.storage import stored

CLINICAL = "patient_id string, cancer_type string, phase string, liver_mask_path string, scanner string"
#: Sample types of the format by their code.
TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}


def read_clinical(spark: SparkSession, path: str, schema: str = CLINICAL, id_col: str = "patient_id") -> DataFrame:
    """A CSV with a header (columns by name, others left out), ids as trimmed strings."""
    fields = [f.split()[0] for f in schema.split(", ")]
    df = spark.read.option("header", True).csv(path)
    kinds = dict(f.rsplit(" ", 1) for f in schema.split(", "))
    return df.select(*((F.trim(F.col(c).cast("string")) if c == id_col else F.col(c).cast(kinds[c])).alias(c) if c in df.columns else F.lit(None).cast(kinds[c]).alias(c) for c in fields))


def orientation(data: bytes, end: str) -> tuple[tuple[float, ...], tuple[float, ...], list[float]]:
    """Spacing, origin (z, y, x) and axes of a header.

    axes: nine numbers, for each of the directions z, y, x of space the share of the voxel axes z, y, x. The matrix (sform) if
    its code is positive, else the quaternion (qform) if its is, else axes parallel to space.
    """
    pix = struct.unpack(f"{end}8f", data[76:108])
    qform, sform = struct.unpack(f"{end}2h", data[252:256])
    b, c, d, *offset = struct.unpack(f"{end}6f", data[256:280])
    spacing, turn = np.array(pix[1:4]), np.eye(3)
    if sform > 0:
        rows = np.array(struct.unpack(f"{end}12f", data[280:328])).reshape(3, 4)
        offset, spacing = rows[:, 3], np.linalg.norm(rows[:, :3], axis=0)
        turn = rows[:, :3] / np.where(spacing > 0, spacing, 1.0)
    elif qform > 0:
        a = max(0.0, 1 - b * b - c * c - d * d) ** 0.5
        i, j, k = np.array([[0, -d, c], [d, 0, -b], [-c, b, 0]])  # the cross product with (b, c, d)
        cross = np.array([i, j, k])
        turn = np.eye(3) + 2 * a * cross + 2 * cross @ cross
        turn[:, 2] *= -1 if pix[0] < 0 else 1
    zyx = slice(None, None, -1)
    return tuple(map(float, spacing[zyx])), tuple(float(o) for o in offset[zyx]), (turn[zyx, zyx] + 0.0).ravel().tolist()


def decode_nifti(data: bytes) -> tuple[np.ndarray, tuple[float, ...], tuple[float, ...], list[float]]:
    """Values as [z, y, x] doubles (a fourth axis averaged), spacing, origin (z, y, x) and axes of an uncompressed or gzipped single file."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    end = "<" if struct.unpack("<i", data[:4])[0] == 348 else ">"
    dims = struct.unpack(f"{end}8h", data[40:56])
    kind, _ = struct.unpack(f"{end}2h", data[70:74])
    start, slope, inter = struct.unpack(f"{end}3f", data[108:120])
    if kind not in TYPES:
        raise ValueError(f"unsupported sample type {kind}")
    shape = [max(1, d) for d in dims[1 : 1 + max(3, dims[0])]]
    raw = np.frombuffer(data, np.dtype(end + TYPES[kind]), int(np.prod(shape)), int(start)).reshape(shape[::-1]).astype(float)
    if slope not in (0.0, 1.0) or inter:
        raw = raw * (slope or 1.0) + inter
    while raw.ndim > 3:
        raw = raw.mean(0)
    return raw, *orientation(data, end)


VOXELS = "patient_id string, phase string, kind string, z int, y int, x int, value double, sz double, sy double, sx double, oz double, oy double, ox double, axes array<double>"
#: Voxels of a slab that a task hands on at once.
SLAB = 1 << 20


def _plain(path: Column) -> Column:
    """A path as it is compared: local ones without their scheme."""
    return F.regexp_replace(path, "^file:/+", "/")


def _named(manifest: DataFrame, phases: Sequence[str] | None, kinds: Sequence[str]) -> DataFrame:
    """patient_id, phase, kind, path of the files to be read; only those of the phases and kinds asked for."""
    each = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"{k}_path").alias("path")) for k in kinds))
    out = manifest.select("patient_id", "phase", F.explode(each).alias("f")).select("patient_id", "phase", "f.kind", _plain(F.col("f.path")).alias("path")).filter("path IS NOT NULL")
    return out.filter(F.col("phase").isin(*phases)) if phases else out


def _content(spark: SparkSession, named: DataFrame, files: str | Sequence[str]) -> DataFrame:
    """named with the content of each file that is there (null if not); no other file is opened."""
    listed = spark.read.format("binaryFile").load(files).select(F.col("path").alias("_full"), _plain(F.col("path")).alias("_path"))  # paths only
    there = named.select("path").distinct().join(listed, F.col("path") == F.col("_path")).select("_full")
    paths = [r["_full"] for r in there.toLocalIterator()]  # as many as Spark lists of them
    if not paths:
        return named.withColumn("content", F.lit(None).cast("binary"))
    content = spark.read.format("binaryFile").load(paths).select(_plain(F.col("path")).alias("_path"), "content")
    return named.join(content, F.col("path") == F.col("_path"), "left").drop("_path")


def _decoded(r) -> Iterator[pd.DataFrame]:
    if r.content is None:
        raise FileNotFoundError(f"missing or empty: {r.path}")
    a, spacing, origin, axes = decode_nifti(r.content)
    step = max(1, SLAB // max(1, a.shape[1] * a.shape[2]))
    for at in range(0, a.shape[0], step):
        part = a[at : at + step]
        z, y, x = (i.ravel() for i in np.indices(part.shape, dtype=np.int32))
        yield pd.DataFrame({"patient_id": r.patient_id, "phase": r.phase, "kind": r.kind, "z": z + at, "y": y, "x": x, "value": part.ravel(), **dict(zip(("sz", "sy", "sx"), spacing, strict=True)), **dict(zip(("oz", "oy", "ox"), origin, strict=True)), "axes": [axes] * part.size})


def read_voxels(spark: SparkSession, manifest: DataFrame, files: str | Sequence[str], phases: Sequence[str] | None = None, kinds: Sequence[str] = ("ct", "mask")) -> DataFrame:
    """patient_id, phase, kind (ct, mask), z, y, x, value, and spacing, origin and axes sz .. ox, axes, of the files the manifest names.

    files: paths or globs to list; files go by their whole path, only those named (of the phases and kinds) are opened, and each is
    decoded in one task, slab by slab. A file that is missing or broken ends the job; scan_volumes goes on past it.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                yield from _decoded(r)

    return _content(spark, _named(manifest, phases, kinds), files).mapInPandas(run, VOXELS)


def scan_volumes(spark: SparkSession, manifest: DataFrame, files: str | Sequence[str], phases: Sequence[str] | None = None, kinds: Sequence[str] = ("ct", "mask")) -> tuple[DataFrame, DataFrame]:
    """read_voxels' rows of the files that can be read, and patient_id, phase, kind, feature_block, error_type, message, traceback_short of the others.

    Both come from one pass that is written once. A file is decoded before its first row is handed on, so none is there in part.
    """
    names = [f.split()[0] for f in VOXELS.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                slabs = _decoded(r)
                try:
                    first = next(slabs)
                except Exception as e:
                    row = {c: None for c in names} | {"patient_id": r.patient_id, "phase": r.phase, "kind": r.kind} | {f"_{c}": v for c, v in zip(ERROR, described(e), strict=True)}
                    yield pd.DataFrame([row])
                    continue
                for slab in chain([first], slabs):
                    yield slab.assign(**{f"_{c}": None for c in ERROR})

    tagged = _content(spark, _named(manifest, phases, kinds), files).mapInPandas(run, VOXELS + "".join(f", _{c} string" for c in ERROR))
    return split(stored(tagged, "volumes"), ["patient_id", "phase", "kind"], "read")


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite", format: str = "parquet") -> None:
    """A result table as Parquet (or CSV with a header), in folders by the given columns."""
    w = df.write.mode(mode).format(format)
    w = w.option("header", True) if format == "csv" else w
    (w.partitionBy(*partition_by) if partition_by else w).save(path)
