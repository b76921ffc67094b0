"""Folds, permutations, and metrics of out-of-fold predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxcohort.operators.ranks import PIECES, ranked_counts
from voxcohort.operators.summary import _meet
from voxcohort.plans.storage import stored


def _shuffled(id_col: str, *salt: object) -> Column:
    return F.md5(F.concat_ws("|", F.col(id_col).cast("string"), *(x if isinstance(x, Column) else F.lit(str(x)) for x in salt)))


#: Parts that a group is numbered in; no task sorts a whole group.
PARTS = 256


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], part: Column, name: str) -> DataFrame:
    """df with name: the place from 1 in order of each row among the rows of keys.

    part must grow with the order: rows are sorted inside their part only, and parts start after the rows before them.
    """
    rows = df.withColumn("_part", part)
    sizes = rows.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)))
    return _meet(inside, starts, [*keys, "_part"]).withColumn(name, F.col("_start") + F.col("_i")).drop("_part", "_start", "_i")


def _by_hash(df: DataFrame, keys: Sequence[str], id_col: str, *salt: object) -> DataFrame:
    """df with _place, the place among the rows of keys in the order of the md5 of id and salt; its first two digits are the part."""
    rows = df.withColumn("_h", _shuffled(id_col, *salt))
    return numbered(rows, keys, [F.col("_h"), F.col(id_col)], F.substring("_h", 1, 2), "_place").drop("_h")


def stratified_folds(df: DataFrame, id_col: str, class_col: str, k: int, seed: int = 42, within: Sequence[str] = (), name: str = "fold") -> DataFrame:
    """df with fold 0 .. k-1: classes (within groups) are dealt in the order of md5(id|seed), so each class is spread evenly."""
    return _by_hash(df, [class_col, *within], id_col, seed).withColumn(name, ((F.col("_place") - 1) % k).cast("int")).drop("_place")


def _by_id(ids: DataFrame, id_col: str) -> DataFrame:
    """ids with _place, in the order of id_col: parts are ranges between ids drawn by hash, the count of those at or below an id."""
    total = max(1, ids.count())
    drawn = ids.filter(F.pmod(F.xxhash64(id_col), F.lit(total)) < 8 * PARTS).groupBy(F.lit(1)).agg(F.array_sort(F.collect_set(id_col)).alias("_drawn"))
    cuts = drawn.select(F.filter("_drawn", lambda x, i: i % 8 == 7).alias("_cuts"))  # one row of about PARTS ids
    parted = ids.join(F.broadcast(cuts), F.lit(True), "left")
    part = F.when(F.col(id_col).isNotNull(), F.size(F.filter(F.coalesce("_cuts", F.array().cast(f"array<{dict(ids.dtypes)[id_col]}>")), lambda c: c < F.col(id_col)))).otherwise(-1)
    return numbered(parted.withColumn("_at", part).drop("_cuts"), [], [F.col(id_col)], F.col("_at"), "_place").drop("_at")


def permute_labels(df: DataFrame, id_col: str, class_col: str, b: int, seed: int = 42) -> DataFrame:
    """b, id, class for b = 1 .. B: the class of the row with the same place in the order of md5(id|b|seed).

    Places by id are numbered once, in parts cut at a sample's quantiles.
    """
    own = df.select(id_col, class_col)
    each = F.explode(F.sequence(F.lit(1), F.lit(b)))
    left = _by_id(own.select(id_col), id_col).withColumn("b", each)
    right = _by_hash(own.withColumn("b", each), ["b"], id_col, F.col("b").cast("string"), seed).select("b", "_place", class_col)
    return left.join(right, ["b", "_place"]).select("b", id_col, class_col)


def balanced_weights(df: DataFrame, class_col: str) -> DataFrame:
    """df with weight n / (k n_class); null class, null weight."""
    c = df.filter(F.col(class_col).isNotNull()).groupBy(F.col(class_col).alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(F.lit(1))
    c = c.withColumn("weight", F.sum("_n").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("_n"))).drop("_n")
    return df.join(F.broadcast(c), F.col(class_col) == F.col("_c"), "left").drop("_c")  # one row per class


def class_metrics(pred: DataFrame, keys: Sequence[str], true: str = "true_label", guess: str = "pred_label") -> DataFrame:
    """keys, class, precision, recall, f1, support; 0 where undefined."""
    cells = pred.groupBy(*keys, F.col(true).alias("t"), F.col(guess).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    both = cells.select(*keys, F.explode(F.array(F.struct(F.col("t").alias("class"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"), F.lit(0).cast("long").alias("hit")))).alias("e"))
    c = both.groupBy(*keys, F.col("e.class").alias("class")).agg(F.sum("e.t").alias("support"), F.sum("e.p").alias("_p"), F.sum("e.hit").alias("_hit"))
    part = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return c.select(*keys, "class", part(F.col("_hit"), F.col("_p")).alias("precision"), part(F.col("_hit"), F.col("support")).alias("recall"), part(2 * F.col("_hit"), F.col("_p") + F.col("support")).alias("f1"), "support", F.col("_hit").alias("hits"))


def classification_metrics(pred: DataFrame, keys: Sequence[str], true: str = "true_label", guess: str = "pred_label") -> DataFrame:
    """keys, n, accuracy, f1_macro, f1_weighted."""
    c = class_metrics(pred, keys, true, guess)
    return c.groupBy(*keys).agg(F.sum("support").alias("n"), (F.sum("hits") / F.sum("support")).alias("accuracy"), F.avg("f1").alias("f1_macro"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"))


def auc_ovr(pred: DataFrame, keys: Sequence[str], classes: Sequence[str], true: str = "true_label", prefix: str = "prob_") -> DataFrame:
    """keys, auc_ovr: the mean over classes of the rank-sum AUC of one against the rest; null if a class is absent or alone."""
    long = pred.select(*keys, true, *(F.col(prefix + c).cast("double").alias(c) for c in classes)).unpivot([*keys, true], list(classes), "_class", "_score")
    long = long.withColumn("_own", F.col(true) == F.col("_class"))
    cells = ranked_counts(long, [*keys, "_class"], "_score", ["_own"])
    m, n = F.col("_m"), F.col("_n")
    c = cells.groupBy(*keys, "_class").agg(F.sum(F.when(F.col("_own"), F.col("n")).otherwise(0)).alias("_m"), F.sum(F.when(F.col("_own"), 0).otherwise(F.col("n"))).alias("_n"), F.sum(F.when(F.col("_own"), F.col("n") * F.col("rank")).otherwise(0.0)).alias("_r"))
    auc = F.when((m > 0) & (n > 0), (F.col("_r") - m * (m + 1) / 2) / (m * n))
    return c.groupBy(*keys).agg(F.when(F.count(auc) == len(classes), F.avg(auc)).alias("auc_ovr"))


def roc_points(pred: DataFrame, classes: Sequence[str], true: str = "true_label", prefix: str = "prob_") -> DataFrame:
    """class, threshold, tpr, fpr: one point per distinct score, largest first.

    Scores of a class are cut at approximate quantiles; sums run inside a piece and start from the pieces above it.
    """
    long = pred.select(true, *(F.col(prefix + c).cast("double").alias(c) for c in classes)).unpivot([true], list(classes), "class", "threshold")
    cells = stored(long.groupBy("class", "threshold").agg(F.count_if(F.col(true) == F.col("class")).alias("_tp"), F.count_if(F.col(true) != F.col("class")).alias("_fp")), "scores")
    cuts = cells.groupBy("class").agg(F.percentile_approx("threshold", [i / PIECES for i in range(1, PIECES)], 1000).alias("_cuts"))
    cells = _meet(cells, cuts, ["class"])
    cells = cells.withColumn("_piece", F.when(F.col("threshold").isNull(), -1).otherwise(F.size(F.filter("_cuts", lambda c: c < F.col("threshold"))))).drop("_cuts")
    above = Window.partitionBy("class").orderBy(F.col("_piece").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("class")
    sums = cells.groupBy("class", "_piece").agg(F.sum("_tp").alias("_t"), F.sum("_fp").alias("_f"))
    sums = sums.select("class", "_piece", *(x for c in ("_t", "_f") for x in (F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above"), F.sum(c).over(whole).alias(f"{c}_all"))))
    inside = Window.partitionBy("class", "_piece").orderBy(F.col("threshold").desc()).rowsBetween(Window.unboundedPreceding, 0)
    run = cells.select("class", "_piece", "threshold", F.sum("_tp").over(inside).alias("_tp"), F.sum("_fp").over(inside).alias("_fp"))
    rate = lambda c, s: F.try_divide(F.col(c) + F.col(f"{s}_above"), F.col(f"{s}_all"))
    return _meet(run, sums, ["class", "_piece"]).select("class", "threshold", rate("_tp", "_t").alias("tpr"), rate("_fp", "_f").alias("fpr"))


def confusion(pred: DataFrame, classes: Sequence[str], true: str = "true_label", guess: str = "pred_label") -> DataFrame:
    """true label, one column of counts per predicted class; zeros filled in."""
    return pred.groupBy(true).pivot(guess, list(classes)).count().fillna(0)


def weighted_importance(df: DataFrame, value: str = "shap_mean_abs", weight: str = "n_test") -> DataFrame:
    """feature, importance: the mean over folds weighted by their sizes, largest first."""
    return df.groupBy("feature").agg(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias("importance")).orderBy(F.col("importance").desc(), "feature")


def arm_summary(folds: DataFrame, metrics: Sequence[str], count: str = "n_features") -> DataFrame:
    """arm, n_folds, <metric>_mean and _std (sample), mean and population deviation of the number of features."""
    return folds.groupBy("arm").agg(F.count(F.lit(1)).alias("n_folds"), *(f(m).alias(f"{m}_{t}") for m in metrics for t, f in (("mean", F.avg), ("std", F.stddev_samp))), F.avg(count).alias(f"mean_{count}"), F.stddev_pop(count).alias(f"std_{count}"))


def best_arm(summary: DataFrame, by: str) -> DataFrame:
    """The row of the arm with the largest value, ties by name: one row."""
    return summary.filter(F.col(by).isNotNull()).orderBy(F.col(by).desc(), "arm").limit(1)


def permutation_p(scores: DataFrame, observed: float | Column, score: str = "score") -> DataFrame:
    """n, p_value = (scores at least as large + 1) / (n + 1), mean and population deviation of the scores."""
    n = F.count(score)
    return scores.agg(n.alias("permutation_n"), ((F.count_if(F.col(score) >= observed) + 1) / (n + 1)).alias("p_value"), F.avg(score).alias("perm_mean"), F.stddev_pop(score).alias("perm_std"))


def attach_ids(pred: DataFrame, subjects: DataFrame, row_id: str, columns: Sequence[str]) -> DataFrame:
    """Predictions with columns of the subjects, by row id, never by position."""
    return pred.join(subjects.select(row_id, *columns), row_id, "left")


def error_table(pred: DataFrame, features: DataFrame, id_col: str, key_feature: str, confused: tuple[str, str], true: str = "true_label", guess: str = "pred_label") -> DataFrame:
    """Misclassified subjects with their key feature and whether the error is the given one (true, predicted)."""
    wrong = pred.filter(F.col(true) != F.col(guess)).join(features.select(id_col, key_feature), id_col, "left")
    return wrong.select(id_col, true, guess, key_feature, F.when((F.col(true) == confused[0]) & (F.col(guess) == confused[1]), f"{confused[0]}->{confused[1]}").otherwise("other").alias("error_group"))


def nearest_centroid(df: DataFrame, keys: Sequence[str], id_col: str, class_col: str, features: Sequence[str], fold: str = "fold") -> DataFrame:
    """keys, fold, id, class, pred: the class whose mean over the other folds is nearest.

    Fold sums add up, so the means over all but one fold are the whole sums less that fold's: one pass.
    """
    keys = list(keys)
    own = df.groupBy(*keys, fold, class_col).agg(F.count(F.lit(1)).alias("_n"), *(F.sum(c).alias(f"_s_{c}") for c in features))
    whole = own.groupBy(*keys, F.col(class_col).alias("_c")).agg(F.sum("_n").alias("_whole_n"), *(F.sum(f"_s_{c}").alias(f"_t_{c}") for c in features))
    folds = own.select(*keys, fold).distinct()
    grid = _meet(folds, whole, keys) if keys else folds.join(F.broadcast(whole), F.lit(True), "left")
    part = own.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col(fold).alias("_f"), F.col(class_col).alias("_d"), "_n", *(f"_s_{c}" for c in features))
    on = (F.col(fold) == F.col("_f")) & (F.col("_c") == F.col("_d"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_k_{k}"))
    left = F.col("_whole_n") - F.coalesce("_n", F.lit(0))
    centre = grid.join(part, on, "left").filter(left > 0).select(*keys, fold, "_c", *((F.col(f"_t_{c}") - F.coalesce(f"_s_{c}", F.lit(0.0))).__truediv__(left).alias(f"_m_{c}") for c in features))
    distance = sum((F.pow(F.col(c) - F.col(f"_m_{c}"), F.lit(2)) for c in features), F.lit(0.0))
    return _meet(df, centre, [*keys, fold]).groupBy(*keys, fold, id_col, class_col).agg(F.min(F.struct(distance.alias("d"), F.col("_c").alias("c")))["c"].alias("pred"))
