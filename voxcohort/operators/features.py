"""Feature names, selections, stability and families. Tables here have a row per feature: small beside the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxcohort.functions.columns import PHASES, parse_feature
from voxcohort.operators.ranks import correlation_pairs
from voxcohort.plans.graph import connected_components

PATIENT_LEVEL = ("is_multifocal", "n_lesions", "largest_lesion_fraction")
#: Endings of location statistics, and fragments of names that are never shifted.
LOCATION_ENDINGS = ("_median", "_mean", "_p10", "_p25", "_p75", "_p90", "_mean_hu")
NOT_SHIFTED = ("ratio", "diff", "_std", "_iqr", "_mad", "_range_", "_skew", "_kurt", "_entropy", "_cv_", "gradient", "local_entropy", "_fraction", "_count", "_flag", "_hybrid", "tlr_liver_ref", "of_sectors")
REFERENCE = "{phase}_tlr_liver_ref_median"


def feature_groups(features: DataFrame, name: str = "feature") -> DataFrame:
    """group, feature: all, imaging, intratumoral, peritumoral, background and the unions of two."""
    f = F.col(name)
    imaging = ~f.isin(*PATIENT_LEVEL)
    background = imaging & (F.contains(f, F.lit("_tlr_")) | F.contains(f, F.lit("liver_ref")))
    peri = imaging & (F.contains(f, F.lit("_peri_")) | F.contains(f, F.lit("_boundary_")) | F.contains(f, F.lit("_invasion_")) | F.contains(f, F.lit("_capsule_")))
    intra = imaging & ~background & ~peri
    groups = {"all_features": F.lit(True), "imaging_features": imaging, "intratumoral_only": intra, "peritumoral_only": peri, "background_liver_only": background, "intra_plus_peri": intra | peri, "intra_plus_background": intra | background, "peri_plus_background": peri | background}
    listed = F.array_compact(F.array(*(F.when(v, F.lit(k)) for k, v in groups.items())))
    return features.select(F.explode(listed).alias("group"), f.alias("feature"))


def classify_location_features(columns: Sequence[str]) -> tuple[list[str], list[str]]:
    """Names to shift by their phase's reference, and reference locations to remove."""
    shift, remove = [], []
    for c in columns:
        if c.split("_")[0] not in PHASES or not c.endswith(LOCATION_ENDINGS):
            continue
        if "tlr_liver_ref" in c:
            remove.append(c)
        elif not any(k in c for k in NOT_SHIFTED):
            shift.append(c)
    return shift, remove


def normalize_to_reference(df: DataFrame) -> DataFrame:
    """Location columns minus the reference median of their phase, where there is one; reference locations go."""
    shift, remove = classify_location_features(df.columns)
    ref = {c: REFERENCE.format(phase=c.split("_")[0]) for c in shift}
    return df.select(*((F.col(c) - F.col(ref[c])).alias(c) if c in ref and ref[c] in df.columns else F.col(c) for c in df.columns if c not in remove))


def top_features(df: DataFrame, by: str, n: int, ascending: bool = False, name: str = "feature") -> DataFrame:
    """The n best rows, ties by name; null last."""
    order = F.col(by).asc_nulls_last() if ascending else F.col(by).desc_nulls_last()
    return df.orderBy(order, name).limit(n)


def feature_stability(fold_features: DataFrame, n_folds: int) -> DataFrame:
    """feature, n_folds_selected, selection_rate, phase, region, stat_type, family_key."""
    out = fold_features.groupBy("feature").agg(F.count_distinct("fold").alias("n_folds_selected"))
    return out.select("feature", "n_folds_selected", (F.col("n_folds_selected") / n_folds).alias("selection_rate"), *(c.alias(k) for k, c in parse_feature(F.col("feature")).items()))


def family_stability(fold_features: DataFrame, n_folds: int) -> DataFrame:
    """family_key, n_members, n_folds_any_member, family_selection_rate, top_member (ties by name), top_member_rate."""
    named = fold_features.select("fold", "feature", parse_feature(F.col("feature"))["family_key"].alias("family_key"))
    folds = named.groupBy("family_key").agg(F.count_distinct("feature").alias("n_members"), F.count_distinct("fold").alias("n_folds_any_member"))
    each = named.groupBy("family_key", "feature").agg(F.count_distinct("fold").alias("_n"))
    top = each.groupBy("family_key").agg(F.min(F.struct((-F.col("_n")).alias("n"), "feature")).alias("_t"))
    out = folds.join(top, "family_key")
    return out.select("family_key", "n_members", "n_folds_any_member", (F.col("n_folds_any_member") / n_folds).alias("family_selection_rate"), F.col("_t.feature").alias("top_member"), (-F.col("_t.n") / n_folds).alias("top_member_rate"))


def rank_shift(a: DataFrame, b: DataFrame, value: str = "value") -> DataFrame:
    """feature, value_a, value_b (0 where absent), rank_a, rank_b (1 is the largest, ties get the least), rank_shift."""
    from pyspark.sql import Window

    both = a.select("feature", F.col(value).alias("value_a")).join(b.select("feature", F.col(value).alias("value_b")), "feature", "full_outer").fillna(0.0, ["value_a", "value_b"])
    down = lambda c: F.rank().over(Window.orderBy(F.col(c).desc()))
    return both.withColumn("rank_a", down("value_a")).withColumn("rank_b", down("value_b")).withColumn("rank_shift", F.col("rank_b") - F.col("rank_a"))


def correlation_families(df: DataFrame, stats: DataFrame, least: float = 0.90, effect: str = "eta_squared", score: str | None = None) -> DataFrame:
    """family_id, representative_feature, representative_effect, family_size, members (joined by ;): features linked by abs(r) >= least.

    Families are numbered by their largest effect, then its feature, and come largest family first.
    The representative has the largest (effect, score), then the last name. Features without links are families of one.
    """
    names = [c for c in df.columns]
    edges = correlation_pairs(df, names).filter(F.abs("r") >= least).select("a", "b")
    linked = connected_components(edges).withColumnRenamed("node", "feature")
    best = F.struct(F.col(effect).alias("e"), (F.col(score) if score else F.lit(0.0)).alias("s"), F.col("feature").alias("f"))
    rows = stats.filter(F.col("feature").isin(*names)).join(linked, "feature", "left").withColumn("_family", F.coalesce("component", "feature"))
    out = rows.groupBy("_family").agg(F.max(best).alias("_b"), F.count(F.lit(1)).alias("family_size"), F.array_join(F.array_sort(F.collect_set("feature")), ";").alias("members"))
    order = Window.orderBy(F.col("_b.e").desc_nulls_last(), F.col("_b.f").desc())  # one row per family of features
    out = out.select(F.row_number().over(order).alias("family_id"), F.col("_b.f").alias("representative_feature"), F.col("_b.e").alias("representative_effect"), "family_size", "members")
    return out.orderBy(F.col("family_size").desc(), F.col("representative_effect").desc_nulls_last(), "family_id")
