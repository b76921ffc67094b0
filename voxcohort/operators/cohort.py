"""Cohort tables: manifests, completeness, merging, collapsing and error tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxcohort.functions.columns import phase_rank

CT_NAMES = ("{id}_{phase}.nii.gz", "{id}_{phase}.nii", "{id}_ct_{phase}.nii.gz")
MASK_NAMES = ("{id}_mask_{phase}.nii.gz", "{id}_mask_{phase}.nii")


def filter_classes(df: DataFrame, class_col: str, classes: Sequence[str]) -> DataFrame:
    return df.filter(F.col(class_col).isin(*classes))


def numeric_features(df: DataFrame, exclude: Sequence[str]) -> list[str]:
    """Names of the numeric columns but those excluded, in order."""
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return [c for c, kind in df.dtypes if c not in exclude and (kind in kinds or kind.startswith("decimal"))]


def encode_labels(df: DataFrame, class_col: str, out: str = "label") -> DataFrame:
    """df with the class's place among the sorted classes (from 0); null for null. Classes are few."""
    codes = df.filter(F.col(class_col).isNotNull()).select(F.col(class_col).alias("_c")).distinct().withColumn(out, F.dense_rank().over(Window.orderBy("_c")) - 1)
    return df.join(F.broadcast(codes), F.col(class_col) == F.col("_c"), "left").drop("_c")


def collapse_by_priority(df: DataFrame, id_col: str, rank: Column, columns: Sequence[str]) -> DataFrame:
    """One row per id: of each column, the first value that isn't null in the order of rank (then by value)."""
    r = df.withColumn("_rank", rank)
    return r.groupBy(id_col).agg(*(F.min(F.when(F.col(c).isNotNull(), F.struct(F.col("_rank").alias("r"), F.col(c).alias("v"))))["v"].alias(c) for c in columns))


def volume_manifest(cohort: DataFrame, files: DataFrame, phases: Sequence[str], ct_names: Sequence[str] = CT_NAMES, mask_names: Sequence[str] = MASK_NAMES, id_col: str = "patient_id") -> DataFrame:
    """id, phase, ct_path, mask_path: of each id and phase the first name of each kind that is among files (name, path); both must be there."""

    def found(names: Sequence[str], out: str) -> DataFrame:
        wanted = cohort.select(F.col(id_col).cast("string").alias("_id")).distinct().withColumn("phase", F.explode(F.array(*map(F.lit, phases))))
        tries = F.array(*(F.struct(F.lit(i).alias("i"), F.replace(F.replace(F.lit(n), F.lit("{id}"), F.col("_id")), F.lit("{phase}"), F.col("phase")).alias("name")) for i, n in enumerate(names)))
        tried = wanted.select("_id", "phase", F.explode(tries).alias("t")).select("_id", "phase", "t.i", "t.name")
        # Names made of a few columns look few to the planner, which would broadcast them or the files.
        return tried.join(files.select(F.col("name"), "path").hint("merge"), "name").groupBy("_id", "phase").agg(F.min(F.struct("i", "path"))["path"].alias(out))

    return found(ct_names, "ct_path").join(found(mask_names, "mask_path").hint("merge"), ["_id", "phase"]).withColumnRenamed("_id", id_col)


def complete_cases(manifest: DataFrame, required: Sequence[str], id_col: str = "patient_id", phase_col: str = "phase") -> DataFrame:
    """id, missing (the required phases it lacks, in order), complete."""
    need = F.array(*map(F.lit, required))
    return manifest.groupBy(id_col).agg(F.collect_set(phase_col).alias("_has")).select(id_col, F.array_except(need, "_has").alias("missing")).withColumn("complete", F.size("missing") == 0)


def geometry_qc(meta: DataFrame, id_col: str = "patient_id", most: float = 0.20) -> DataFrame:
    """id, n_mismatch (phases whose sizes differ between kinds), spacing_cv (population deviation of sz over phases by mean), spacing_flag."""
    size = F.struct("nx", "ny", "nz")
    phase = meta.groupBy(id_col, "phase").agg((F.count_distinct(size) > 1).alias("_bad"), F.first(F.when(F.col("kind") == "ct", F.col("sz")), ignorenulls=True).alias("_sz"))
    out = phase.groupBy(id_col).agg(F.count_if("_bad").alias("n_mismatch"), F.try_divide(F.stddev_pop("_sz"), F.avg("_sz")).alias("spacing_cv"))
    return out.withColumn("spacing_flag", (F.col("spacing_cv") > most).cast("int"))


def merge_features(a: DataFrame, b: DataFrame, on: Sequence[str], suffix: str = "_peri") -> DataFrame:
    """Full outer join on the keys; columns of b with a name of a's get the suffix."""
    clash = {c for c in b.columns if c in a.columns and c not in on}
    return a.join(b.select(*(F.col(c).alias(c + suffix) if c in clash else F.col(c) for c in b.columns)), list(on), "full_outer")


def attach_reference_mask(df: DataFrame, listed: DataFrame, found: DataFrame, keys: Sequence[str] = ("patient_id", "phase"), order: str = "row") -> DataFrame:
    """df with liver_mask_path: the listed path (the last row of a key, blanks don't count), else the found one, else null."""
    keys = list(keys)
    last = listed.groupBy(*keys).agg(F.max_by("path", order).alias("_listed"))
    by_name = found.groupBy(*keys).agg(F.min("path").alias("_found"))
    path = F.coalesce(F.when(F.trim("_listed") != "", F.trim("_listed")), F.col("_found"))
    return df.join(last, keys, "left").join(by_name, keys, "left").withColumn("liver_mask_path", path).drop("_listed", "_found")


def attach_batch(df: DataFrame, batches: DataFrame, id_col: str, batch: str) -> DataFrame:
    """df with the batch of each id; one batch per id (the least of several)."""
    return df.join(batches.groupBy(id_col).agg(F.min(batch).alias(batch)), id_col, "left")


def pending(todo: DataFrame, done: DataFrame, id_col: str) -> DataFrame:
    """Rows of todo whose id isn't among done's."""
    return todo.join(done.select(id_col).distinct(), id_col, "left_anti")


def error_summary(errors: DataFrame) -> DataFrame:
    """error_type, feature_block, n; most frequent first."""
    return errors.groupBy("error_type", "feature_block").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "error_type", "feature_block")


def distinct_subjects(df: DataFrame, id_col: str, class_col: str) -> DataFrame:
    return df.select(id_col, class_col).dropDuplicates()


def pivot_phases(long: DataFrame, ids: Sequence[str], names: Sequence[str], phase_col: str = "phase", feature_col: str = "feature", value_col: str = "value") -> DataFrame:
    """One row per ids with the columns names, each <phase>_<feature>; a list given in full keeps the pivot to one pass."""
    named = long.withColumn("_name", F.concat_ws("_", phase_col, feature_col))
    return named.groupBy(*ids).pivot("_name", list(names)).agg(F.first(value_col, ignorenulls=True))


def harmonize(df: DataFrame, batch: str, columns: Sequence[str]) -> DataFrame:
    """Each column's z-score within its batch, rescaled to the mean and deviation of all rows (sample deviations; zero counts as 1).

    A null batch leaves values as they are; a batch of one row has no deviation and gives null.
    """
    sd = lambda c: F.stddev_samp(c)
    own = df.groupBy(F.col(batch).alias("_b")).agg(*(f(c).alias(f"_{t}_{c}") for c in columns for t, f in (("m", F.avg), ("s", sd))))
    all_ = df.agg(*(f(c).alias(f"_{t}_{c}") for c in columns for t, f in (("all_m", F.avg), ("all_s", sd))))
    one = lambda name: F.when(F.col(name) == 0, 1.0).otherwise(F.col(name))
    out = df.join(own, F.col(batch) == F.col("_b"), "left").join(F.broadcast(all_), F.lit(True), "left")  # one row
    new = {c: F.when(F.col(batch).isNull(), F.col(c)).otherwise((F.col(c) - F.col(f"_m_{c}")) / one(f"_s_{c}") * one(f"_all_s_{c}") + F.col(f"_all_m_{c}")) for c in columns}
    return out.select(*(new[c].alias(c) if c in new else F.col(c) for c in df.columns))


def ranked_phases(df: DataFrame, order: Sequence[str], phase_col: str = "phase") -> DataFrame:
    return df.withColumn("phase_rank", phase_rank(F.col(phase_col), order))
