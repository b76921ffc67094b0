"""Robustness of features under a dilated and an eroded mask."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxcohort.functions.columns import bucket_label
from voxcohort.operators import voxels as vx
from voxcohort.operators.ranks import spearman
from voxcohort.operators.summary import icc2, mean_pct_change

VARIANTS = ("orig", "dil", "ero")
#: Fixed names: the feature, the phase that it is taken in, and its block.
FEATURES = {
    "C1_tlr_liver_ref_median": ("C1", "ring_median"),
    "C1_peri_10mm_peri_p90": ("C1", "peri_10_p90"),
    "C1_peri_5mm_peri_p90": ("C1", "peri_5_p90"),
    "C1_rim_median": ("C1", "rim_median"),
    "P_enh_p10": ("P", "p10"),
}


def variants(voxels: DataFrame, meta: DataFrame | tuple[float, float, float], offsets: Sequence[tuple[int, int, int]]) -> DataFrame:
    """Volume by volume the voxels three times: keys, hu, variant orig, dil or ero, its mask, and its dist_in, dist_out and deepest;
    eroded masks that became too small have no rows. meta: as in with_fields."""
    keys, fields = list(vx.VOLUME), ("dist_in", "dist_out", "deepest")
    kinds = dict(voxels.dtypes)
    one = meta if isinstance(meta, tuple) else None
    joined, _ = vx._with_spacing(voxels.select(*keys, "z", "y", "x", "hu", "mask"), None if one else meta, keys, fields)

    def run(t: pa.Table) -> pa.Table:
        spacing = one or tuple(float(t[c][0].as_py()) for c in ("sz", "sy", "sx"))
        at = [t[c].to_numpy() for c in "zyx"]
        own = pc.fill_null(pc.greater(t["mask"], 0), False).to_numpy().astype(bool)
        out = []
        for name, mask in zip(VARIANTS, (own, *vx.moved_masks(at, own, offsets, 50)), strict=True):
            if mask is not None:
                new = vx._worked(at, None, mask, spacing, fields)
                columns = [*(t[k] for k in keys), t["hu"], pa.array([name] * len(mask)), pa.array(mask.astype(np.int32)), *(pa.array(new[f]) for f in fields)]
                out.append(pa.table(columns, [*keys, "hu", "variant", "mask", *fields]))
        return pa.concat_tables(out)

    schema = ", ".join(f"{k} {kinds[k]}" for k in (*keys, "hu")) + ", variant string, mask int, dist_in double, dist_out double, deepest double"
    return joined.groupBy(*keys).applyInArrow(run, schema)


def blocks(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, ring_median (20 to 30 mm outside, 50 voxels or more), peri_10_p90, peri_5_p90 (plausible intensities), rim_median
    (the outer fifth of a mask 3 mm deep or more), p10 (of the mask); each null where its voxels are missing."""
    hu, v, n = F.col("hu"), F.col("v"), F.col("n")
    plausible = (hu > -50) & (hu < 200) & (F.col("dist_out") > 0)
    parts = {
        "_ring": vx.shell(20.0, 30.0),
        **{f"_peri_{mm}": plausible & (F.col("dist_out") <= mm) for mm in (10, 5)},
        "_rim": (F.col("mask") > 0) & (F.col("deepest") >= 3) & (F.col("dist_in") <= F.col("deepest") * 0.2),
        "_mask": F.col("mask") > 0,
    }
    parts = {k: F.coalesce(c, F.lit(False)) for k, c in parts.items()}
    # Distinct values with the parts that they lie in; those of no part leave their volume a row.
    value = F.when(reduce(or_, parts.values()), hu.cast("double"))
    counts = vx._deep(df, keys).groupBy(*keys, *(c.alias(k) for k, c in parts.items()), value.alias("v")).agg(F.count(F.lit(1)).alias("n"))

    def share(where: str, q: float) -> Column:
        return F.percentile(F.when(F.col(where), v), F.lit(q), n)

    return counts.groupBy(*keys).agg(
        F.when(F.sum(F.when(F.col("_ring"), n)) >= 50, share("_ring", 0.5)).alias("ring_median"),
        *(share(f"_peri_{mm}", 0.9).alias(f"peri_{mm}_p90") for mm in (10, 5)),
        share("_rim", 0.5).alias("rim_median"),
        share("_mask", 0.1).alias("p10"),
    )


def robustness(voxels: DataFrame, meta: DataFrame | tuple[float, float, float], offsets: Sequence[tuple[int, int, int]]) -> DataFrame:
    """patient_id, feature, orig, dil, ero: FEATURES in their phases under each variant of the mask, null where there is none."""
    keys = [*vx.VOLUME, "variant"]
    phases = sorted({p for p, _ in FEATURES.values()})
    v = variants(voxels.filter(F.col("phase").isin(phases)), meta, offsets)
    each = F.array(*(F.struct(F.lit(f).alias("feature"), F.lit(p).alias("of"), F.col(b).alias("value")) for f, (p, b) in FEATURES.items()))
    long = blocks(v, keys).select("patient_id", "phase", "variant", F.explode(each).alias("x")).filter("x.of = phase")
    return long.groupBy("patient_id", F.col("x.feature").alias("feature")).pivot("variant", list(VARIANTS)).agg(F.first("x.value"))


def robustness_summary(per_patient: DataFrame) -> DataFrame:
    """feature, and for dil and ero: n, icc, low, high, pct_change, spearman_r, spearman_p, interp."""
    keys = ["feature"]
    out = per_patient.select(*keys).distinct()
    for v in VARIANTS[1:]:
        icc = icc2(per_patient, keys, "orig", v).select(*keys, *(F.col(c).alias(f"{c}_{v}") for c in ("n", "icc", "low", "high")))
        pct = mean_pct_change(per_patient, keys, "orig", v).withColumnRenamed("pct_change", f"pct_change_{v}")
        rho = spearman(per_patient, keys, "orig", v).select(*keys, F.col("rho").alias(f"spearman_r_{v}"), F.col("p").alias(f"spearman_p_{v}"))
        out = out.join(icc, keys, "left").join(pct, keys, "left").join(rho, keys, "left")
        out = out.withColumn(f"interp_{v}", bucket_label(F.col(f"icc_{v}"), (0.50, 0.75, 0.90), ("poor", "moderate", "good", "excellent")))
    return out
