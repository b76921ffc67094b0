"""Feature blocks of voxel tables.

A voxel table has patient_id, phase, z, y, x, hu, mask and liver (null where there is no reference mask);
meta has patient_id, phase and spacing sz, sy, sx in mm. Distances, gradient, local deviation and components
are added once per volume by one grouped helper; everything else is grouped aggregation that reuses that
partitioning by (patient_id, phase)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from voxcohort.functions import geometry
from voxcohort.operators.errors import apply_guarded
from voxcohort.operators.summary import _meet, line_of, line_sums, value_table
from voxcohort.plans.storage import broadcast_or_merge, stored

VOLUME = ("patient_id", "phase")
FIELDS = ("dist_in", "dist_out", "grad", "local_std", "component")


def _worked(at: Sequence[np.ndarray], hu: np.ndarray | None, own: np.ndarray, spacing: tuple[float, float, float], fields: Sequence[str]) -> dict[str, np.ndarray]:
    """The fields of one volume's voxels; hu is only read for grad and local_std."""
    at = tuple(i - i.min() for i in at)
    shape = tuple(int(i.max()) + 1 for i in at)
    mask, out = np.zeros(shape, bool), {}
    mask[at] = own
    if {"grad", "local_std"} & set(fields):
        whole = np.full(shape, float(np.nanmin(hu)))
        whole[at] = hu
    if {"dist_in", "dist_out", "deepest"} & set(fields):
        inside, outside = geometry.signed_distances(mask, spacing)
        out |= {"dist_in": inside[at], "dist_out": outside[at], "deepest": np.full(len(own), inside.max())}
    if "grad" in fields:
        out["grad"] = geometry.gradient_magnitude(whole, spacing)[at]
    if "local_std" in fields:
        out["local_std"] = geometry.local_deviation(whole, spacing)[at]
    if "component" in fields:
        out["component"] = geometry.components(mask)[at]
    return {f: out[f] for f in fields}


def _fields(columns: Sequence[str], fields: Sequence[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        spacing = tuple(float(pdf[c].iloc[0]) for c in ("sz", "sy", "sx"))
        at = [pdf[c].to_numpy() for c in ("z", "y", "x")]
        return pdf[list(columns)].assign(**_worked(at, pdf["hu"].to_numpy(float), (pdf["mask"] > 0).to_numpy(), spacing, fields))[[*columns, *fields]]

    return run


def _with_spacing(voxels: DataFrame, meta: DataFrame | None, keys: Sequence[str], fields: Sequence[str], how: str = "inner") -> tuple[DataFrame, str]:
    """The voxels with their spacing, and the schema of voxels with fields."""
    # Sorted by the keys that the groups need anyhow; derived voxels look small to the planner, which would broadcast them.
    joined = voxels if meta is None else voxels.join(meta.select(*keys, "sz", "sy", "sx").hint("merge"), list(keys), how)
    kind = {"component": "int"}
    return joined, ", ".join(f"{c} {t}" for c, t in voxels.dtypes) + "".join(f", {f} {kind.get(f, 'double')}" for f in fields)


def with_fields(voxels: DataFrame, meta: DataFrame | tuple[float, float, float], keys: Sequence[str] = VOLUME, fields: Sequence[str] = FIELDS, keep: Sequence[str] | None = None) -> DataFrame:
    """voxels with dist_in and dist_out (mm, signed by side), grad, local_std and component, volume by volume; also deepest, the volume's largest dist_in.

    One task holds a volume, so volumes should be cropped to the mask's surroundings before; missing voxels
    of the box count as background with the volume's least intensity. With one spacing of all volumes for meta,
    voxels that are dealt by (some of) the keys are not shuffled. keep: the columns of the voxels that are given out, else all.
    """
    kept = list(voxels.columns if keep is None else keep)
    one = meta if isinstance(meta, tuple) else None
    joined, _ = _with_spacing(voxels, None if one else meta, keys, fields)
    needed = {*kept, *keys, "z", "y", "x", "mask", *(() if one else ("sz", "sy", "sx"))} | ({"hu"} if {"grad", "local_std"} & set(fields) else set())
    joined = joined.select(*(c for c in joined.columns if c in needed))

    def run(t: pa.Table) -> pa.Table:
        spacing = one or tuple(float(t[c][0].as_py()) for c in ("sz", "sy", "sx"))
        hu = t["hu"].to_numpy().astype(float) if "hu" in t.column_names else None
        own = pc.fill_null(pc.greater(t["mask"], 0), False).to_numpy().astype(bool)
        new = _worked([t[c].to_numpy() for c in "zyx"], hu, own, spacing, fields)
        return pa.table([*(t[c] for c in kept), *(pa.array(new[f]) for f in fields)], [*kept, *fields])

    _, schema = _with_spacing(voxels.select(*kept), None, keys, fields)
    return joined.groupBy(*keys).applyInArrow(run, schema)


def fields_or_errors(voxels: DataFrame, meta: DataFrame, keys: Sequence[str] = VOLUME, fields: Sequence[str] = FIELDS, block: str = "fields") -> tuple[DataFrame, DataFrame]:
    """with_fields' rows, and keys, feature_block, error_type, message, traceback_short of the volumes that failed.

    A volume without spacing, with nulls or two voxels in one place, or that a field can't be worked out for is an error; the others finish.
    """
    joined, schema = _with_spacing(voxels, meta, keys, fields, "left")
    own = _fields(voxels.columns, fields)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf[["sz", "sy", "sx"]].isna().any(axis=None) or (pdf[["sz", "sy", "sx"]] <= 0).any(axis=None):
            raise ValueError("no spacing above 0")
        if pdf[["z", "y", "x", "hu", "mask"]].isna().any(axis=None):
            raise ValueError("voxels without place, intensity or mask")
        if pdf.duplicated(["z", "y", "x"]).any():
            raise ValueError("two voxels in one place")
        return own(pdf)

    return apply_guarded(joined, keys, run, schema, block)


def median(value: Column, where: Column) -> Column:
    return F.percentile(F.when(where, value), F.lit(0.5))


def _deepest(keys: Sequence[str]) -> Column:
    return F.max("dist_in").over(Window.partitionBy(*keys))


def _deep(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df with deepest, the largest dist_in of its volume, where it isn't there yet."""
    return df if "deepest" in df.columns else df.withColumn("deepest", _deepest(keys))


def regions(counts: DataFrame, keys: Sequence[str], bins: int = 0) -> DataFrame:
    """keys, n, median, mad, and with bins entropy, from distinct values v and their numbers n (value_table) of parts of volumes.

    One shuffle, of the distinct values: a task holds those of a part of one volume. For groups of any size see summary.
    """
    own, n = Window.partitionBy(*keys), F.col("n")
    df = counts.withColumn("_m", F.percentile("v", F.lit(0.5), n).over(own))
    new = [F.sum("n").alias("n"), F.first("_m").alias("median"), F.percentile(F.abs(F.col("v") - F.col("_m")), F.lit(0.5), n).alias("mad")]
    if bins:
        df = df.withColumns({"_lo": F.min("v").over(own), "_hi": F.max("v").over(own), "_all": F.sum("n").over(own)})
        at = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))).otherwise(F.lit(0))
        df = df.withColumn("_bin", at).withColumn("_in", F.sum("n").over(Window.partitionBy(*keys, "_bin")))
        # A value's share of its bin's term.
        new.append((-F.sum(n / F.col("_all") * F.log2(F.col("_in") / F.col("_all")))).alias("entropy"))
    return df.groupBy(*keys).agg(*new)


def shell(inner: Column | float, outer: Column | float, distance: str = "dist_out", mask: str = "mask") -> Column:
    """Whether a voxel lies outside the mask with inner <= distance <= outer; the first layer outside has distance 0."""
    return (F.col(mask) == 0) & (F.col(distance) >= inner) & (F.col(distance) <= outer)


def assign_bands(df: DataFrame, bands: Sequence[tuple[float, float]], distance: str = "dist_out") -> DataFrame:
    """Rows outside the mask with each band (inner, outer) that the distance lies in, both ends closed: a shared edge is in two bands."""
    hit = F.array_compact(F.array(*(F.when(shell(float(a), float(b), distance), F.struct(F.lit(float(a)).alias("inner"), F.lit(float(b)).alias("outer"))) for a, b in bands)))
    return df.select("*", F.explode(hit).alias("_b")).select(*df.columns, "_b.inner", "_b.outer")


def join_bands(df: DataFrame, bands: DataFrame, keys: Sequence[str] = ("patient_id",), width: float = 1.0, distance: str = "dist_out") -> DataFrame:
    """Rows outside the mask with each of their key's own bands (keys, band, inner, outer) that the distance lies in.

    Both ends are closed; bands may touch, overlap and differ by key. Distances and bands meet in bins of width mm: a band stands in every
    bin that it reaches, so the join is on equal keys and bins, and a row meets bands of its own bin only. Bands without
    an end, with inner above outer, or with nulls match nothing.
    """
    own = bands.filter("inner <= outer AND outer < double('infinity')").withColumn("_bin", F.explode(F.sequence(F.floor(F.greatest(F.col("inner"), F.lit(0.0)) / width), F.greatest(F.floor(F.col("outer") / width), F.floor(F.greatest(F.col("inner"), F.lit(0.0)) / width)))))
    own = own.filter("outer >= 0").select(*(F.col(k).alias(f"_k_{k}") for k in keys), "_bin", "band", "inner", "outer")
    rows = df.filter((F.col("mask") == 0) & (F.col(distance) >= 0)).withColumn("_at", F.floor(F.col(distance) / width))
    on = (F.col("_at") == F.col("_bin")) & (F.col(distance) >= F.col("inner")) & (F.col(distance) <= F.col("outer"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_k_{k}"))
    own = broadcast_or_merge(stored(own, "own-bands"))
    return rows.join(own, on).select(*df.columns, "band", "inner", "outer")


#: The columns of robust_stats.
STATS = ("median", "iqr", "mad", "entropy", "skewness", "kurtosis", "p10", "p90")


def region_stats(counts: DataFrame, keys: Sequence[str], bins: int = 32) -> DataFrame:
    """keys, n, STATS, and above_p75, the share of values above the 75th percentile, of parts of volumes in one shuffle (see regions)."""
    own, n, v, q = Window.partitionBy(*keys), F.col("n"), F.col("v"), F.col("_q")
    df = counts.withColumns({"_q": F.percentile("v", F.array(*map(F.lit, (0.1, 0.25, 0.5, 0.75, 0.9))), n).over(own), "_lo": F.min("v").over(own), "_hi": F.max("v").over(own), "_all": F.sum("n").over(own), "_mean": F.sum(v * n).over(own) / F.sum("n").over(own)})
    at = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((v - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))).otherwise(F.lit(0))
    df = df.withColumn("_bin", at).withColumn("_in", F.sum("n").over(Window.partitionBy(*keys, "_bin")))
    d = v - F.col("_mean")
    out = df.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.first("_q").alias("_q"),
        F.percentile(F.abs(v - q[2]), F.lit(0.5), n).alias("mad"),
        (-F.sum(n / F.col("_all") * F.log2(F.col("_in") / F.col("_all")))).alias("entropy"),
        *((F.sum(F.pow(d, F.lit(i)) * n) / F.sum("n")).alias(f"_m{i}") for i in (2, 3, 4)),
        (F.sum(F.when(v > q[3], n).otherwise(0)) / F.sum("n")).alias("above_p75"),
    )
    spread = F.col("_m2") > 0
    moments = F.when(spread, F.col("_m3") / F.pow("_m2", F.lit(1.5))).alias("skewness"), F.when(spread, F.col("_m4") / (F.col("_m2") * F.col("_m2")) - 3).alias("kurtosis")
    return out.select(*keys, "n", q[2].alias("median"), (q[3] - q[1]).alias("iqr"), "mad", "entropy", *moments, q[0].alias("p10"), q[4].alias("p90"), "above_p75")


def radial_zone(df: DataFrame, keys: Sequence[str] = VOLUME, n: int = 5) -> DataFrame:
    """Voxels inside (dist_in > 0) with zone 0 .. n-1 by their share of the volume's largest distance, which is 0.001 mm or more.

    A share on an edge of n equal parts of [0, 1] belongs to the zone above; edges are those of numpy's linspace.
    """
    inside = _deep(df.filter("dist_in > 0"), keys).filter("deepest >= 1e-3")
    share = F.col("dist_in") / F.col("deepest")
    zone = sum((F.when(share >= float(e), 1).otherwise(0) for e in np.linspace(0, 1, n + 1)[1:-1]), F.lit(0))
    return inside.select(*df.columns, zone.cast("int").alias("zone"))


def radial_profile(df: DataFrame, keys: Sequence[str] = VOLUME, n: int = 5) -> DataFrame:
    """keys, zone_<i>_median and _mad, radial_gradient (last zone less first), radial_slope, radial_r_squared (two zones or more)."""
    zones = regions(value_table(radial_zone(df, keys, n), [*keys, "zone"], "hu"), [*keys, "zone"])
    wide = [F.max(F.when(F.col("zone") == i, F.col(c))).alias(f"zone_{i}_{c}") for i in range(n) for c in ("median", "mad")]
    out = zones.groupBy(*keys).agg(*wide, F.when(F.count(F.lit(1)) >= 2, F.max_by("median", "zone") - F.min_by("median", "zone")).alias("radial_gradient"), *line_sums("zone", "median"))
    return line_of(out).select(*keys, *(f"zone_{i}_{c}" for i in range(n) for c in ("median", "mad")), "radial_gradient", F.col("slope").alias("radial_slope"), (F.col("r") * F.col("r")).alias("radial_r_squared"))


def rim_core(df: DataFrame, keys: Sequence[str] = VOLUME) -> DataFrame:
    """Core (deeper than half of the largest depth) against rim (mask up to a fifth of it); volumes 3 mm deep or more with both sides."""
    v = _deep(df, keys).filter("mask > 0 AND deepest >= 3")
    part = F.when(F.col("dist_in") > F.col("deepest") * 0.5, "core").when(F.col("dist_in") <= F.col("deepest") * 0.2, "rim")
    parts = regions(value_table(v.withColumn("_part", part).filter("_part IS NOT NULL"), [*keys, "_part"], "hu"), [*keys, "_part"], 32)
    wide = parts.groupBy(*keys).agg(*(F.max(F.when(F.col("_part") == p, F.col(c))).alias(f"{p}_{c}") for p in ("core", "rim") for c in ("median", "mad", "entropy")))
    c, r = F.col("core_median"), F.col("rim_median")
    return wide.filter(c.isNotNull() & r.isNotNull()).select(*keys, c, r, (r - c).alias("rim_core_diff"), (r / (c + 1e-5)).alias("rim_core_ratio"), (r > c * 1.1).cast("int").alias("ring_enhancement"), "core_mad", "rim_mad", "core_entropy", "rim_entropy")


def _spaced(df: DataFrame, meta: DataFrame | tuple[float, float, float], keys: Sequence[str]) -> DataFrame:
    """df with sz, sy, sx of meta, or one spacing of all volumes."""
    if isinstance(meta, tuple):
        return df.withColumns({c: F.lit(s) for c, s in zip(("sz", "sy", "sx"), meta, strict=True)})
    return _meet(df.drop("sz", "sy", "sx"), broadcast_or_merge(stored(meta.select(*keys, "sz", "sy", "sx"), "spacing")), keys)


def angular_heterogeneity(df: DataFrame, meta: DataFrame | tuple[float, float, float], keys: Sequence[str] = VOLUME, azimuths: int = 8) -> DataFrame:
    """Medians of spherical sectors about the mask's centre, and their spread: angular_median_cv, _range, _entropy, _mad, n_sectors.

    A volume's means and largest values come by windows over its own voxels, so voxels dealt by volume stay where they are.
    """
    own = Window.partitionBy(*keys)
    v = _spaced(df.filter("mask > 0"), meta, keys)
    v = v.select(*keys, "hu", *((F.col(c) * F.col(f"s{c}")).alias(f"_{c}") for c in "zyx"))
    v = v.select(*keys, "hu", *((F.col(f"_{c}") - F.avg(f"_{c}").over(own)).alias(f"d{c}") for c in "zyx"))
    v = v.withColumn("r", F.sqrt(F.col("dz") * F.col("dz") + F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx")))
    far = v.withColumn("_rmax", F.max("r").over(own)).filter((F.col("_rmax") >= 1e-3) & (F.col("r") > 0.1 * F.col("_rmax")))
    pi = F.lit(np.pi)
    azimuth = F.greatest(F.lit(0), F.least(F.lit(azimuths - 1), F.floor((F.atan2("dy", "dx") + pi) / (2 * pi / azimuths))))
    polar = F.when(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("dz") / F.col("r")))) < pi / 2, 0).otherwise(1)
    sectors = far.groupBy(*keys, azimuth.alias("_a"), polar.alias("_p")).agg(F.count(F.lit(1)).alias("_n"), F.median("hu").alias("m"))
    sectors = sectors.withColumn("_total", F.sum("_n").over(own)).filter("_total >= 10 AND _n >= 3")
    sectors = sectors.withColumns({"_k": F.count(F.lit(1)).over(own), "_lo": F.min("m").over(own), "_sum": F.sum("m").over(own), "_mid": F.median("m").over(own)})
    p = (F.col("m") - F.col("_lo") + 1) / (F.col("_sum") - F.col("_k") * F.col("_lo") + F.col("_k"))
    s = sectors.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_sectors"), (F.stddev_pop("m") / (F.avg("m") + 1e-5)).alias("angular_median_cv"), (F.max("m") - F.min("m")).alias("angular_range"), (-F.sum(p * F.log(p))).alias("angular_entropy"), F.median(F.abs(F.col("m") - F.col("_mid"))).alias("angular_mad"))
    return s.filter("n_sectors >= 4")


def local_heterogeneity(df: DataFrame, keys: Sequence[str] = VOLUME) -> DataFrame:
    """robust_stats of local_std inside the mask, and the share above its own 75th percentile."""
    s = region_stats(value_table(df.filter("mask > 0"), keys, "local_std"), keys)
    return s.select(*keys, *(F.col(c).alias(f"local_hetero_{c}") for c in STATS), F.col("above_p75").alias("high_hetero_fraction"))


def enhancement(voxels: DataFrame, pre: str = "P") -> DataFrame:
    """Voxels of the other phases with enhancement: hu less the clipped hu of the same place before contrast; null without one.

    The phases of a place meet in a window of its own, so voxels dealt by patient are not shuffled.
    """
    place = Window.partitionBy("patient_id", "z", "y", "x")
    placed = F.col("patient_id").isNotNull() & F.col("z").isNotNull() & F.col("y").isNotNull() & F.col("x").isNotNull()
    before = F.max(F.when(placed & (F.col("phase") == pre), F.greatest(F.lit(-200.0), F.least(F.lit(200.0), F.col("hu"))))).over(place)
    return voxels.withColumn("_pre", before).filter(F.col("phase") != pre).select(*voxels.columns, (F.col("hu") - F.col("_pre")).alias("enhancement"))


def necrosis(df: DataFrame, keys: Sequence[str] = VOLUME) -> DataFrame:
    """Share of mask voxels with 10 <= hu <= 40 and enhancement below 15, the rule used, and their mean depth by the largest.

    df is what enhancement or grids.enhancement_on gives; a patient without the phase before contrast goes by intensity alone,
    and so does a volume onto whose grid that phase can't be brought (pre_failed). A volume's sums are taken by both rules, and
    one of them is chosen after.
    """
    failed = F.coalesce(F.col("pre_failed"), F.lit(False)) if "pre_failed" in df.columns else F.lit(False)
    inside, band = F.col("mask") > 0, F.col("hu").between(10, 40)
    rules = {"_hu": band, "_both": band & (F.coalesce("enhancement", F.col("hu")) < 15)}
    sums = [x for r, dead in rules.items() for x in (F.avg(F.when(inside, dead.cast("double"))).alias(f"{r}_f"), F.avg(F.when(inside & dead, F.col("dist_in"))).alias(f"{r}_d"))]
    each = df.groupBy(*keys).agg(*sums, F.max(F.when(inside, F.col("dist_in"))).alias("_m"), F.count("enhancement").alias("_e"), F.count_if(inside).alias("_n"), F.first(F.when(inside, failed), ignorenulls=True).alias("_failed"))
    has = (F.sum("_e").over(Window.partitionBy("patient_id")) > 0) & ~F.coalesce("_failed", F.lit(False))
    each = each.withColumn("_has", has).filter("_n > 0")
    chosen = {c: F.when(F.col("_has"), F.col(f"_both_{c}")).otherwise(F.col(f"_hu_{c}")) for c in "fd"}
    method = F.when(F.col("_has"), "hybrid_hu_band_plus_enhancement").when(F.col("_failed"), "hu_band_only_resample_failed").otherwise("hu_band_only")
    return each.select(*keys, chosen["f"].alias("necrosis_fraction"), method.alias("necrosis_qc_method"), F.when(F.col("_m") > 0, chosen["d"] / F.col("_m")).alias("necrosis_centrality"))


def enhancement_stats(df: DataFrame, keys: Sequence[str] = VOLUME) -> DataFrame:
    """robust_stats of hu inside the mask, prefixed enh_."""
    s = region_stats(value_table(df.filter("mask > 0"), keys, "hu"), keys)
    return s.select(*keys, *(F.col(c).alias(f"enh_{c}") for c in STATS))


def multifocality(df: DataFrame, order: Sequence[str] = ("C1", "C2", "C3", "P")) -> DataFrame:
    """patient_id, n_lesions, is_multifocal, largest_lesion_fraction and the phase they come from: the first with a mask in the order."""
    from voxcohort.functions.columns import phase_rank

    sizes = df.filter("component > 0").groupBy("patient_id", "phase", "component").agg(F.count(F.lit(1)).alias("n"))
    each = sizes.groupBy("patient_id", "phase").agg(F.count(F.lit(1)).alias("c"), (F.max("n") / F.sum("n")).alias("f"))
    best = each.groupBy("patient_id").agg(F.min(F.struct(phase_rank(F.col("phase"), order).alias("r"), "phase", "c", "f")).alias("b"))
    return best.select("patient_id", F.col("b.c").alias("n_lesions"), (F.col("b.c") > 1).cast("int").alias("is_multifocal"), F.col("b.f").alias("largest_lesion_fraction"), F.col("b.phase").alias("multifocal_auth_phase"))


def peritumoral(df: DataFrame, meta: DataFrame | tuple[float, float, float], mm: float, keys: Sequence[str] = VOLUME) -> DataFrame:
    """Shell of 0 < dist_out <= mm with plausible intensity: robust_stats, contrast with the mask's median, volume in mm^3."""
    shell = (F.col("dist_out") > 0) & (F.col("dist_out") <= mm) & (F.col("hu") > -50) & (F.col("hu") < 200)
    parts = df.select(*keys, "hu", F.explode(F.array_compact(F.array(F.when(shell, "peri"), F.when(F.col("mask") > 0, "mask")))).alias("_part"))
    parts = region_stats(value_table(parts, [*keys, "_part"], "hu"), [*keys, "_part"])
    at = lambda p, c: F.max(F.when(F.col("_part") == p, F.col(c)))
    out = parts.groupBy(*keys).agg(*(at("peri", c).alias(c) for c in ("n", *STATS)), at("mask", "median").alias("_t")).filter("n IS NOT NULL AND _t IS NOT NULL")
    out = _spaced(out, meta, keys).withColumn("_vol", F.col("sz") * F.col("sy") * F.col("sx"))
    m, p = F.col("_t"), F.col("median")
    return out.select(*keys, *(F.col(c).alias(f"peri_{c}") for c in STATS), (m - p).alias("tumor_peri_diff"), (m / (p + 1e-5)).alias("tumor_peri_ratio"), ((m - p) / (F.abs(m) + F.abs(p) + 1e-5)).alias("tumor_peri_contrast"), (F.col("n") * F.col("_vol")).alias("peri_volume_mm3"))


def boundary(df: DataFrame, keys: Sequence[str] = VOLUME) -> DataFrame:
    """Gradient in the band of 0 < distance <= 1 mm on either side: median, deviation, their ratio; inner less outer median intensity."""
    inner, outer = (F.col("dist_in") > 0) & (F.col("dist_in") <= 1), (F.col("dist_out") > 0) & (F.col("dist_out") <= 1)
    band = df.filter(inner | outer).select(*keys, "mask", "hu", "grad").withColumn("_m", F.median("grad").over(Window.partitionBy(*keys)))
    spread = F.median(F.abs(F.col("grad") - F.col("_m")))
    out = band.groupBy(*keys).agg(F.first("_m").alias("boundary_grad_median"), spread.alias("boundary_grad_mad"), (median(F.col("hu"), F.col("mask") > 0) - median(F.col("hu"), F.col("mask") == 0)).alias("boundary_gradient"))
    return out.filter("boundary_grad_median IS NOT NULL").select(*keys, "boundary_grad_median", "boundary_grad_mad", (F.col("boundary_grad_mad") / (F.col("boundary_grad_median") + 1e-5)).alias("boundary_irregularity_3d"), "boundary_gradient")


def capsule(df: DataFrame, keys: Sequence[str] = VOLUME, phases: Sequence[str] = ("C2", "C3")) -> DataFrame:
    """Shell of 0 to 3 mm (its first layer too) against the core deeper than 5 mm: difference, ratio, continuity, flag; all null in other phases or without a side."""
    near, core = F.coalesce(shell(0.0, 3.0), F.lit(False)), F.coalesce((F.col("dist_in") > 5) & (F.col("mask") > 0), F.lit(False))
    # Every volume keeps a row: the voxels of neither side count under a null value.
    counts = df.groupBy(*keys, near.alias("_near"), core.alias("_core"), F.when(near | core, F.col("hu").cast("double")).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    n, v, side = F.col("n"), F.col("v"), lambda where: F.percentile(F.when(F.col(where), F.col("v")), F.lit(0.5), F.col("n"))
    above = F.col("_near") & (v > F.col("_c") + 15).isNotNull()
    k = F.sum(F.when(above, F.when(v > F.col("_c") + 15, n).otherwise(0))) / F.sum(F.when(above, n))
    out = counts.withColumn("_c", side("_core").over(Window.partitionBy(*keys))).groupBy(*keys).agg(side("_near").alias("_s"), F.first("_c").alias("_c"), k.alias("_k"))
    use = F.col("phase").isin(*phases) & F.col("_s").isNotNull() & F.col("_c").isNotNull()
    diff, ratio = F.col("_s") - F.col("_c"), F.col("_s") / (F.col("_c") + 1e-5)
    return out.select(*keys, F.when(use, diff).alias("capsule_hu_diff"), F.when(use, ratio).alias("capsule_enh_ratio"), F.when(use, F.col("_k")).alias("capsule_continuity"), F.when(use, ((diff > 15) & (ratio > 1.15) & (F.col("_k") > 0.30)).cast("int")).alias("has_capsule"))


BANDS = ((0, 3), (3, 6), (6, 9), (9, 12), (12, 15))


def invasion_profile(df: DataFrame, keys: Sequence[str] = VOLUME) -> DataFrame:
    """Median and deviation of five closed 3 mm bands, and the line of medians over band middles: invasion_slope, invasion_r, invasion_p."""
    # Voxels of one volume, distance and intensity are counted before they are dealt to bands.
    alike = df.filter("mask = 0 AND hu > -50 AND hu < 200").groupBy(*keys, "mask", "dist_out", F.col("hu").cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    counts = assign_bands(alike, BANDS).groupBy(*keys, "inner", "v").agg(F.sum("n").alias("n"))
    rings = regions(counts, [*keys, "inner"]).withColumn("_mid", F.col("inner") + 1.5)
    names = [f"ring_{a}_{b}mm_{c}" for a, b in BANDS for c in ("median", "mad")]
    wide = (F.max(F.when(F.col("inner") == a, F.col(c))).alias(f"ring_{a}_{b}mm_{c}") for a, b in BANDS for c in ("median", "mad"))
    out = line_of(rings.groupBy(*keys).agg(*wide, *line_sums("_mid", "median")))
    return out.select(*keys, *names, F.col("slope").alias("invasion_slope"), F.col("r").alias("invasion_r"), F.col("p").alias("invasion_p"))


def lesion_reference(df: DataFrame, keys: Sequence[str] = VOLUME, ring_only: bool = False) -> DataFrame:
    """Mask median against a reference: liver voxels 30 mm away or more, or without a liver mask the ring of 20 to 30 mm; 50 voxels or more."""
    far = (F.col("liver") > 0) & (F.col("dist_out") >= 30) & (F.col("mask") == 0)
    sides = {"_mask": F.col("mask") > 0, "_far": F.lit(False) if ring_only else far, "_ring": shell(20.0, 30.0)}
    sides = {k: F.coalesce(c, F.lit(False)) for k, c in sides.items()}
    with_liver = F.lit(False) if ring_only else F.col("liver").isNotNull()
    # Voxels of no side only tell whether there is a liver mask; they count under a null value.
    value = F.when(sides["_mask"] | sides["_far"] | sides["_ring"], F.col("hu").cast("double"))
    counts = df.groupBy(*keys, *(c.alias(k) for k, c in sides.items()), with_liver.alias("_liver"), value.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    own, v, n = Window.partitionBy(*keys), F.col("v"), F.col("n")
    ref = F.when(F.col("_has"), F.col("_far")).otherwise(F.col("_ring"))
    part = lambda where, x: F.percentile(F.when(where, x), F.lit(0.5), n)
    v_ = counts.withColumn("_has", F.max("_liver").over(own)).withColumn("_ref", ref).withColumn("_r", part(F.col("_ref"), v).over(own))
    out = v_.groupBy(*keys).agg(part(F.col("_mask"), v).alias("_t"), F.first("_r").alias("r"), part(F.col("_ref"), F.abs(v - F.col("_r"))).alias("mad"), F.sum(F.when(F.col("_ref"), n)).alias("_n"), F.first("_has").alias("_has"))
    out = out.filter("_n >= 50 AND _t IS NOT NULL AND r IS NOT NULL")
    t, r = F.col("_t"), F.col("r")
    return out.select(*keys, (t / (r + 1e-5)).alias("tumor_liver_ratio"), (t - r).alias("tumor_liver_diff"), r.alias("liver_ref_median"), F.col("mad").alias("liver_ref_mad"), F.when(F.col("_has"), "liver_mask").otherwise("ring_fallback").alias("tlr_ref_source"), F.col("_has").cast("int").alias("tlr_liver_mask_available"))


def _turned(axes: Column) -> Column:
    """Axes, or those of space where there are none."""
    return F.coalesce(axes, F.array(*(F.lit(float(i == j)) for i in range(3) for j in range(3))))


def determinant(axes: Column) -> Column:
    return sum((axes[i] * (axes[3 + (i + 1) % 3] * axes[6 + (i + 2) % 3] - axes[3 + (i + 2) % 3] * axes[6 + (i + 1) % 3]) for i in range(3)), F.lit(0.0))


def _placed(grid: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """grid with _pz, _py, _px, where its voxels' centres lie among the source's voxels; null without a source.

    Spacing and origin sz .. ox stand on every row of both; axes (orientation) on those of either, else they are space's.
    """
    turned = "axes" in grid.columns or "axes" in source.columns
    own = [c for c in (*(f"{t}{a}" for a in "zyx" for t in "so"), "axes") if c in source.columns]
    where = stored(source.select(*keys, *own).distinct().select(*(F.col(k).alias(f"_{k}") for k in keys), *(F.col(c).alias(f"_{c}") for c in own)), "grids")
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    placed = grid.join(broadcast_or_merge(where), on, "left")  # a row for a volume
    if not turned:
        return placed.withColumns({f"_p{a}": (F.col(a) * F.col(f"s{a}") + F.col(f"o{a}") - F.col(f"_o{a}")) / F.col(f"_s{a}") for a in "zyx"})
    here = _turned(F.col("axes") if "axes" in grid.columns else F.lit(None))
    there = _turned(F.col("_axes") if "axes" in source.columns else F.lit(None))
    space = {f"_g{r}": sum((here[3 * i + j] * F.col(c) * F.col(f"s{c}") for j, c in enumerate("zyx")), F.lit(0.0)) + F.col(f"o{r}") - F.col(f"_o{r}") for i, r in enumerate("zyx")}
    placed = placed.withColumns(space)

    def inverse(i: int, j: int) -> Column:  # the cofactor of (j, i)
        rows, columns = [(j + n) % 3 for n in (1, 2)], [(i + n) % 3 for n in (1, 2)]
        return there[3 * rows[0] + columns[0]] * there[3 * rows[1] + columns[1]] - there[3 * rows[0] + columns[1]] * there[3 * rows[1] + columns[0]]

    # Rounded at 1e-9, as products of turned axes miss a voxel's edge by the last digits.
    index = {f"_p{r}": F.round(F.try_divide(sum((inverse(i, j) * F.col(f"_g{c}") for j, c in enumerate("zyx")), F.lit(0.0)), determinant(there) * F.col(f"_s{r}")), 9) for i, r in enumerate("zyx")}
    return placed.withColumns(index)


#: Places a side of the bricks that volumes are resampled by.
BRICK = 64


def _sampled(grid: DataFrame, source: DataFrame, keys: Sequence[str], value: str, kind: str, pick: Callable[[list[np.ndarray], np.ndarray, np.ndarray, list[int]], np.ndarray]) -> DataFrame:
    """grid with value, worked out by pick where its voxels lie in the source; both are dealt by bricks of the source, so a task
    holds a brick and what lies in it, whatever the size of a volume. Voxels at a brick's low border stand in the brick before too.

    pick: places among the source's voxels (nan without a source), the values of a box, which of them are there, its first place.
    """
    brick = lambda at: F.greatest(F.lit(0), F.least(F.lit((1 << 20) - 1), F.floor(at / BRICK)))
    named = lambda z, y, x: (z * (1 << 20) + y) * (1 << 20) + x
    placed = _placed(grid, source, keys)
    placed = placed.select(*grid.columns, "_pz", "_py", "_px", F.coalesce(named(*(brick(F.floor(f"_p{a}")) for a in "zyx")), F.lit(0)).cast("long").alias("_brick"))
    # The source's columns have names of their own, as both sides may come from one table.
    there = source.filter("z IS NOT NULL AND y IS NOT NULL AND x IS NOT NULL").select(*keys, "z", "y", "x", F.col(value).alias("_v"), *(F.array_distinct(F.array(brick(F.col(a)), brick(F.col(a) - 1))).alias(f"_b{a}") for a in "zyx"))
    for a in "zyx":
        there = there.withColumn(f"_b{a}", F.explode(f"_b{a}"))
    there = there.select(*(F.col(c).alias(f"_s_{c}") for c in (*keys, "z", "y", "x")), "_v", named(*(F.col(f"_b{a}") for a in "zyx")).cast("long").alias("_brick"))
    names, to = [*grid.columns, value], pa.float64() if kind == "double" else pa.int32()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = np.zeros(left.num_rows)
        if left.num_rows and right.num_rows:
            own = [right[f"_s_{a}"].to_numpy() for a in "zyx"]
            low = [int(i.min()) for i in own]
            at = tuple(i - m for i, m in zip(own, low, strict=True))
            values = np.full([int(i.max()) + 1 for i in at], np.nan)
            values[at] = right["_v"].to_numpy().astype(float)
            found = pick([left[f"_p{a}"].to_numpy().astype(float) for a in "zyx"], values, ~np.isnan(values), low)
        return pa.table([*(left[c] for c in grid_columns), pa.array(found).cast(to)], names)

    grid_columns = grid.columns
    schema = StructType([*grid.schema.fields, StructField(value, DoubleType() if kind == "double" else IntegerType())])
    return placed.groupBy(*keys, "_brick").cogroup(there.groupBy(*(f"_s_{k}" for k in keys), "_brick")).applyInArrow(run, schema)


def _at(index: Sequence[np.ndarray], values: np.ndarray, there: np.ndarray, low: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """The values at places (whole numbers or nan), and whether there is one."""
    index = [np.nan_to_num(i, nan=-1e9, posinf=1e9, neginf=-1e9) - m for i, m in zip(index, low, strict=True)]
    inside = np.logical_and.reduce([(i >= 0) & (i < n) for i, n in zip(index, values.shape, strict=True)])
    at = tuple(np.where(inside, i, 0).astype(np.int64) for i in index)
    return values[at], inside & there[at]


def resample_nearest(grid: DataFrame, source: DataFrame, keys: Sequence[str] = VOLUME) -> DataFrame:
    """grid (keys, z, y, x, and spacing and origin sz .. ox) with the source's mask at the nearest voxel, 0 outside.

    source: keys, z, y, x, mask and its spacing and origin on every row; axes (see sources.volumes) on either, else parallel.
    """

    def pick(p: list[np.ndarray], values: np.ndarray, there: np.ndarray, low: list[int]) -> np.ndarray:
        # Halves go away from zero.
        index = [np.where(np.abs(i - np.trunc(i)) == 0.5, np.trunc(i) + np.sign(i), np.rint(i)) for i in p]
        v, ok = _at(index, values, there, low)
        return np.where(ok, v, 0.0)

    return _sampled(grid, source, keys, "mask", "int", pick)


def resample_linear(grid: DataFrame, source: DataFrame, keys: Sequence[str] = VOLUME) -> DataFrame:
    """grid with hu, the source's trilinear value, 0 outside its voxel centres; columns as in resample_nearest."""

    def pick(p: list[np.ndarray], values: np.ndarray, there: np.ndarray, low: list[int]) -> np.ndarray:
        total, whole = np.zeros(len(p[0])), np.isfinite(p).all(axis=0)
        for n in range(8):
            cell = [np.floor(i) + (n >> k & 1) for k, i in enumerate(p)]
            weight = np.prod([1 - np.abs(i - c) for i, c in zip(p, cell, strict=True)], axis=0)
            v, ok = _at(cell, values, there, low)
            used = weight > 0
            whole &= ok | ~used
            total += np.where(used & ok, weight * v, 0.0)
        return np.where(whole, total, 0.0)

    return _sampled(grid, source, keys, "hu", "double", pick)


def ball(mm: float, spacing: tuple[float, float, float]) -> list[tuple[int, int, int]]:
    """Offsets (z, y, x) of a ball of max(1, round(mm / spacing)) voxels per axis: those with sum((d / (r + 0.5))^2) <= 1."""
    r = [max(1, round(mm / s)) for s in spacing]
    axis = [range(-k, k + 1) for k in r]
    return [(z, y, x) for z in axis[0] for y in axis[1] for x in axis[2] if sum((d / (k + 0.5)) ** 2 for d, k in zip((z, y, x), r, strict=True)) <= 1]


def _shifted(padded: np.ndarray, offset: tuple[int, int, int], room: Sequence[int], shape: tuple[int, ...]) -> np.ndarray:
    return padded[tuple(slice(r + d, r + d + n) for d, r, n in zip(offset, room, shape, strict=True))]


def moved_masks(at: Sequence[np.ndarray], own: np.ndarray, offsets: Sequence[tuple[int, int, int]], least: int) -> tuple[np.ndarray, np.ndarray | None]:
    """One volume's mask grown and shrunk by the offsets, at its voxels; None for a shrunk one of less than least voxels."""
    room = [max((abs(o[i]) for o in offsets), default=0) for i in range(3)]
    at = tuple(i.astype(np.int64) - i.min() for i in at)
    shape = tuple(int(i.max()) + 1 for i in at)
    padded = np.zeros([n + 2 * r for n, r in zip(shape, room, strict=True)], bool)
    padded[tuple(i + r for i, r in zip(at, room, strict=True))] = own
    grown, shrunk = np.zeros(shape, bool), _shifted(padded, (0, 0, 0), room, shape).copy()
    for o in offsets:
        grown |= _shifted(padded, tuple(-d for d in o), room, shape)
        shrunk &= _shifted(padded, o, room, shape)
    eroded = shrunk[at]
    return grown[at], eroded if eroded.sum() >= least else None


def perturbed(voxels: DataFrame, offsets: Sequence[tuple[int, int, int]], keys: Sequence[str] = VOLUME, least: int = 50) -> DataFrame:
    """voxels with dilated and eroded, the mask grown and shrunk by the offsets, volume by volume: one shuffle by volume.

    Outside the grid, and in voxels that are missing, is background; eroded is null where less than least voxels are left.
    """
    names = voxels.columns

    def run(t: pa.Table) -> pa.Table:
        own = pc.fill_null(pc.greater(t["mask"], 0), False).to_numpy().astype(bool)
        grown, eroded = moved_masks([t[c].to_numpy() for c in "zyx"], own, offsets, least)
        new = [pa.array(grown.astype(np.int32)), pa.nulls(len(own), pa.int32()) if eroded is None else pa.array(eroded.astype(np.int32))]
        return pa.table([*(t[c] for c in names), *new], [*names, "dilated", "eroded"])

    schema = ", ".join(f"`{c}` {k}" for c, k in voxels.dtypes) + ", dilated int, eroded int"
    return voxels.groupBy(*keys).applyInArrow(run, schema)


def dilate(voxels: DataFrame, offsets: Sequence[tuple[int, int, int]], keys: Sequence[str] = VOLUME) -> DataFrame:
    """voxels with the mask grown by the offsets, within the grid."""
    return perturbed(voxels, offsets, keys).select(*(F.col("dilated").alias("mask") if c == "mask" else F.col(c) for c in voxels.columns))


def erode(voxels: DataFrame, offsets: Sequence[tuple[int, int, int]], keys: Sequence[str] = VOLUME, least: int = 50) -> DataFrame:
    """voxels with the mask shrunk to where all offsets are foreground; outside the grid is background; a mask below least voxels becomes null."""
    return perturbed(voxels, offsets, keys, least).select(*(F.col("eroded").alias("mask") if c == "mask" else F.col(c) for c in voxels.columns))
