"""Volumes on one grid: masks brought to their image where sizes differ, the phase before contrast to each other phase.

A volume's grid is its size, spacing, origin and axes. Only volumes whose grids differ are resampled; the others meet by index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxcohort.operators.summary import _meet
from voxcohort.operators.voxels import VOLUME, _turned, determinant, resample_linear, resample_nearest
from voxcohort.plans.storage import broadcast_or_merge, stored

PLACE = ("sz", "sy", "sx", "oz", "oy", "ox")


def with_masks(voxels: DataFrame) -> DataFrame:
    """patient_id, phase, z, y, x, hu, mask, spacing, origin and axes: read_voxels' images with their masks as columns.

    A mask of the image's size meets it by index, any other is resampled to it (nearest voxel, 0 outside). mask is null
    for an image without one; a mask without its image gives no rows.
    """
    ends = F.struct(*(F.max(a).alias(a) for a in "zyx"))
    size = voxels.groupBy(*VOLUME, "kind").agg(ends.alias("end"))
    both = size.groupBy(*VOLUME).agg(*(F.max(F.when(F.col("kind") == k, F.col("end"))).alias(f"_{k}") for k in ("ct", "mask")))
    both = both.select(*VOLUME, F.col("_mask").isNotNull().alias("_masked"), F.coalesce(F.col("_ct") != F.col("_mask"), F.lit(False)).alias("_moved"))
    all_ = _meet(voxels, broadcast_or_merge(stored(both, "volume-sizes")), VOLUME).withColumn("axes", _turned(F.col("axes")))
    # An image's voxel and its mask's meet in a window of one place.
    here = F.max(F.when(F.col("kind") == "mask", F.col("value").cast("int"))).over(Window.partitionBy(*VOLUME, "z", "y", "x"))
    same = all_.filter("NOT _moved").withColumn("mask", here).filter("kind = 'ct'").withColumnRenamed("value", "hu").drop("kind")
    ct = all_.filter("kind = 'ct'").withColumnRenamed("value", "hu").drop("kind")
    mask = all_.filter("kind = 'mask'").withColumn("mask", F.col("value").cast("int")).drop("kind", "value")
    same = same.withColumn("mask", F.when(F.col("_masked"), F.coalesce("mask", F.lit(0))))
    moved = resample_nearest(ct.filter("_moved"), mask.filter("_moved"))
    return same.unionByName(moved).select(*VOLUME, "z", "y", "x", "hu", "mask", *PLACE, "axes")


def _usable(prefix: str) -> Column:
    """Whether the grid places voxels: positive spacing, an origin, axes that span space."""
    out = F.abs(determinant(F.col(f"{prefix}axes"))) > 1e-6
    for c in PLACE:
        out = out & F.col(f"{prefix}{c}").isNotNull() & ~F.isnan(f"{prefix}{c}")
    for c in PLACE[:3]:
        out = out & (F.col(f"{prefix}{c}") > 0)
    return F.coalesce(out, F.lit(False))


def enhancement_on(voxels: DataFrame, pre: str = "P") -> DataFrame:
    """Voxels of the other phases with enhancement, and pre_failed: whether the phase before contrast can't be brought to their grid.

    voxels: with_masks' columns. Enhancement is hu less the clipped hu before contrast at the same point (linear between voxels, 0
    outside); null where the patient has no such phase or it failed, since a grid has no spacing above 0, origin or independent axes.
    """
    df = voxels.withColumn("axes", _turned(F.col("axes"))) if "axes" in voxels.columns else voxels.withColumn("axes", _turned(F.lit(None)))
    grid = df.groupBy(*VOLUME).agg(F.struct(*(F.max(a).alias(a) for a in "zyx")).alias("end"), *(F.first(c).alias(c) for c in (*PLACE, "axes")))
    before = grid.filter(F.col("phase") == pre).select(F.col("patient_id").alias("_p"), *(F.col(c).alias(f"_{c}") for c in ("end", *PLACE, "axes")))
    pair = grid.filter(F.col("phase") != pre).join(before, F.col("patient_id") == F.col("_p"), "left")
    equal = F.col("end") == F.col("_end")
    for c in (*PLACE, "axes"):
        equal = equal & F.col(c).eqNullSafe(F.col(f"_{c}"))
    way = F.when(F.col("_p").isNull(), "none").when(~(_usable("") & _usable("_")), "failed").when(equal, "same").otherwise("moved")
    ways = broadcast_or_merge(stored(pair.select(*VOLUME, way.alias("_way")), "ways"))
    # On one grid the phases of a place meet in its window; elsewhere the phase before contrast is resampled.
    here = F.max(F.when(F.col("phase") == pre, F.col("hu"))).over(Window.partitionBy("patient_id", "z", "y", "x"))
    rest = df.filter(F.col("phase") != pre)
    source = df.filter(F.col("phase") == pre).select("patient_id", "z", "y", "x", "hu", *PLACE, "axes")
    clipped = F.greatest(F.lit(-200.0), F.least(F.lit(200.0), F.col("_pre")))
    moved = _meet(rest, ways, VOLUME).filter("_way = 'moved'").withColumnRenamed("hu", "_own")
    moved = resample_linear(moved, source, ["patient_id"]).withColumnRenamed("hu", "_pre").withColumnRenamed("_own", "hu")
    others = _meet(df.withColumn("_pre", here).filter(F.col("phase") != pre), ways, VOLUME).filter("_way <> 'moved'")
    others = others.withColumn("_pre", F.when(F.col("_way") == "same", F.col("_pre")))
    out = others.unionByName(moved)
    return out.select(*voxels.columns, F.when(F.col("_pre").isNotNull(), F.col("hu") - clipped).alias("enhancement"), (F.col("_way") == "failed").alias("pre_failed"))
