"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Name fragments of feature regions, first match wins.
REGIONS = (
    ("peri_10mm", "peri_10mm"),
    ("peri_5mm", "peri_5mm"),
    ("capsule", "capsule"),
    ("boundary", "boundary"),
    ("invasion", "invasion"),
    ("tlr", "tlr"),
    ("zone_", "radial_zone"),
    ("radial_", "radial_profile"),
    ("ring_enhancement", "ring_core"),
    ("rim_", "ring_core"),
    ("core_", "ring_core"),
    ("angular_", "angular"),
    ("high_hetero_fraction", "local_hetero"),
    ("local_hetero", "local_hetero"),
    ("necrosis", "necrosis"),
    ("enh_", "enh"),
)
PHASES = ("P", "C1", "C2", "C3")


def phase_rank(phase: Column, order: Sequence[str]) -> Column:
    """0, 1, ... in the given order; 99 for other values and null."""
    out = F.lit(99)
    for i in reversed(range(len(order))):
        out = F.when(phase == order[i], i).otherwise(out)
    return out


def bucket_label(value: Column, cuts: Sequence[float], labels: Sequence[str], missing: str = "–") -> Column:
    """labels[i] for the first cut above value, the last label beyond all cuts, missing for null."""
    out = F.lit(labels[-1])
    for cut, label in reversed(list(zip(cuts, labels, strict=False))):
        out = F.when(value < cut, label).otherwise(out)
    return F.when(value.isNull(), missing).otherwise(out)


def digitize(value: Column, low: float, high: float, bins: int) -> Column:
    """Index of the equal bin of [low, high] that value lies in, clipped to 0 .. bins - 1."""
    at = F.floor((value - low) / ((high - low) / bins)).cast("int")
    return F.when(value.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(bins - 1), at)))


def safe_ratio(a: Column, b: Column) -> Column:
    return a / (b + F.lit(1e-5))


def clip(value: Column, low: float, high: float) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def in_range(value: Column, low: float, high: float) -> Column:
    return (value > low) & (value < high)


def parse_feature(name: Column) -> dict[str, Column]:
    """phase, region, stat_type and family_key of a feature's name."""
    first = F.split(name, "_")[0]
    phase = F.when(first.isin(*PHASES), first).otherwise("patient_level")
    region = F.lit("other")
    for fragment, label in reversed(REGIONS):
        region = F.when(F.contains(name, F.lit(fragment)), label).otherwise(region)
    return {"phase": phase, "region": region, "stat_type": name, "family_key": F.concat_ws("_", phase, region)}


def median_text(median: Column, q1: Column, q3: Column) -> Column:
    """median [q1–q3] with three decimals, N/A for none."""
    return F.coalesce(F.when(median.isNotNull(), F.format_string("%.3f [%.3f–%.3f]", median, q1, q3)), F.lit("N/A"))
