"""Grouped summaries. Values are reduced to (group, value, count) first, so exact percentiles, deviations and
histograms work on distinct values, and every shuffle carries partial counts; quantiles are found by selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxcohort.functions.columns import median_text
from voxcohort.functions.tails import t_sf2
from voxcohort.operators.quantiles import percentiles
from voxcohort.plans.storage import small_or_not, stored

Keys = Sequence[str]


def value_table(df: DataFrame, keys: Keys, value: str) -> DataFrame:
    """keys, v, n: each distinct non-null value with its number."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))


def _same(keys: Keys, other: DataFrame, name: str) -> tuple[DataFrame, object]:
    renamed = other.select(*(F.col(k).alias(f"{name}{k}") for k in keys), *(c for c in other.columns if c not in keys))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{name}{k}"))
    return renamed, on


def _meet(left: DataFrame, right: DataFrame, keys: Keys) -> DataFrame:
    """Inner join on keys where null equals null; right's keys are dropped."""
    renamed, on = _same(keys, right, "_r_")
    return left.join(renamed, on).drop(*(f"_r_{k}" for k in keys))


def hist_entropy(counts: DataFrame, keys: Keys, bins: int = 32) -> DataFrame:
    """keys, entropy: in bits, of the histogram of equal bins over [min, max], the last one closed."""
    ends = counts.groupBy(*keys).agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"), F.sum("n").alias("_all"))
    at = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))).otherwise(F.lit(0))
    share = _meet(counts, ends, keys).groupBy(*keys, at.alias("_bin")).agg((F.sum("n") / F.first("_all")).alias("_p"))
    return share.groupBy(*keys).agg((-F.sum(F.col("_p") * F.log2("_p"))).alias("entropy"))


def mad(counts: DataFrame, keys: Keys) -> DataFrame:
    """keys, mad: the median of absolute deviations from the median, unscaled."""
    return _deviation(counts, percentiles(counts, keys, [0.5]).select(*keys, F.col("q")[0].alias("_m")), keys)


def _deviation(counts: DataFrame, middle: DataFrame, keys: Keys) -> DataFrame:
    """keys, mad, from the medians _m by keys."""
    away = _meet(counts, small_or_not(middle), keys).groupBy(*keys, F.abs(F.col("v") - F.col("_m")).alias("v")).agg(F.sum("n").alias("n"))
    return percentiles(away, keys, [0.5]).select(*keys, F.col("q")[0].alias("mad"))


def robust_stats(df: DataFrame, keys: Keys, value: str, bins: int = 32) -> DataFrame:
    """keys, n, median, iqr, mad, entropy, skewness, kurtosis (population, excess), p10, p90; nulls are left out."""
    counts = stored(value_table(df, keys, value), "distinct-values")
    q = stored(percentiles(counts, keys, (0.1, 0.25, 0.5, 0.75, 0.9)), "quantiles")
    mean = counts.groupBy(*keys).agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("_mean"))
    first = q.select(*keys, F.col("total").alias("N"), F.col("q")[2].alias("median"), (F.col("q")[3] - F.col("q")[1]).alias("iqr"), F.col("q")[0].alias("p10"), F.col("q")[4].alias("p90"))
    d = F.col("v") - F.col("_mean")
    m = [F.sum(F.pow(d, F.lit(i)) * F.col("n")) / F.sum("n") for i in (2, 3, 4)]
    second = _meet(counts, small_or_not(stored(mean, "means")), keys).groupBy(*keys).agg(*(x.alias(f"_m{i}") for i, x in zip((2, 3, 4), m, strict=True)))
    spread = F.col("_m2") > 0
    second = second.select(*keys, F.when(spread, F.col("_m3") / F.pow("_m2", F.lit(1.5))).alias("skewness"), F.when(spread, F.col("_m4") / (F.col("_m2") * F.col("_m2")) - 3).alias("kurtosis"))
    second = _meet(second, _deviation(counts, q.select(*keys, F.col("q")[2].alias("_m")), keys), keys)
    out = _meet(_meet(first, second, keys), hist_entropy(counts, keys, bins), keys)
    return out.select(*keys, F.col("N").alias("n"), "median", "iqr", "mad", "entropy", "skewness", "kurtosis", "p10", "p90")


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    """columns, n; most frequent first."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), *columns)


def line_sums(x: str, y: str) -> list[Column]:
    """The sums over complete pairs that line_of works from, for a grouped aggregation."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    return [F.count(a).alias("_pairs"), F.covar_pop(a, b).alias("_c"), F.var_pop(a).alias("_vx"), F.var_pop(b).alias("_vy"), F.avg(a).alias("_mx"), F.avg(b).alias("_my")]


def line_of(out: DataFrame) -> DataFrame:
    """out, which has line_sums, with n, slope, intercept, r, df, p; all but n null below two pairs."""
    two = F.col("_pairs") >= 2
    out = out.withColumn("slope", F.when(two & (F.col("_vx") > 0), F.col("_c") / F.col("_vx")))
    r = F.when((F.col("_vx") > 0) & (F.col("_vy") > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_c") / F.sqrt(F.col("_vx") * F.col("_vy"))))).when(F.col("_vx") > 0, 0.0)
    out = out.withColumns({"intercept": F.col("_my") - F.col("slope") * F.col("_mx"), "r": F.when(two, r), "df": F.when(two, F.col("_pairs") - 2)})
    out = out.withColumn("_t", F.when(F.abs("r") < 1, F.col("r") * F.sqrt(F.col("df") / (1 - F.col("r") * F.col("r")))))
    p = F.when(F.abs("r") == 1, 0.0).when(F.col("r") == 0, 1.0).otherwise(F.when(F.col("df") > 0, t_sf2(F.col("_t"), F.col("df").cast("double"))).when(F.col("r").isNotNull(), 0.0))
    return out.withColumn("p", p).withColumnRenamed("_pairs", "n").drop("_c", "_vx", "_vy", "_mx", "_my", "_t")


def linregress(df: DataFrame, keys: Keys, x: str, y: str) -> DataFrame:
    """keys, n, slope, intercept, r, r2, df, p (two-sided, of a slope of zero) of the simple regression of y on x over complete pairs.

    With two pairs or more; r is 0 and p 1 for a constant y, all but n and df are null for a constant x. On two
    pairs p is 0, or 1 for a constant y.
    """
    out = line_of(df.groupBy(*keys).agg(*line_sums(x, y))).filter("n >= 2")
    return out.select(*keys, "n", "slope", "intercept", "r", (F.col("r") * F.col("r")).alias("r2"), "df", "p")


def long_form(df: DataFrame, ids: Sequence[str], features: Sequence[str]) -> DataFrame:
    """ids, feature, value."""
    return df.select(*ids, *(F.col(c).cast("double") for c in features)).unpivot(list(ids), list(features), "feature", "value")


def descriptive_table(long: DataFrame, class_col: str, classes: Sequence[str]) -> DataFrame:
    """feature, <class>_median_iqr (text), <class>_n."""
    counts = value_table(long, ["feature", class_col], "value")
    cell = percentiles(counts, ["feature", class_col], (0.25, 0.5, 0.75))
    cell = cell.select("feature", class_col, median_text(F.col("q")[1], F.col("q")[0], F.col("q")[2]).alias("t"), F.col("total").alias("n"))
    wide = long.select("feature").distinct().join(cell.groupBy("feature").pivot(class_col, list(classes)).agg(F.first("t").alias("median_iqr"), F.first("n").alias("n")), "feature", "left")
    return wide.select("feature", *(c for k in classes for c in (F.coalesce(F.col(f"{k}_median_iqr"), F.lit("N/A")).alias(f"{k}_median_iqr"), F.coalesce(F.col(f"{k}_n"), F.lit(0)).alias(f"{k}_n"))))


def profile_means(long: DataFrame, keys: Keys) -> DataFrame:
    """keys, n, mean, se (sample deviation over the root of n)."""
    return long.filter("value IS NOT NULL").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), (F.stddev_samp("value") / F.sqrt(F.count(F.lit(1)))).alias("se"))


def icc2(df: DataFrame, keys: Keys, a: str, b: str, least: int = 10) -> DataFrame:
    """keys, n, icc, low, high: two-way random, absolute agreement, single rater, over complete pairs; null below least pairs.

    The sums of squares of two raters follow from five sums: rows differ by (a + b) / 2 from the grand mean,
    raters by (sum a - sum b) / 2n.
    """
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    s = df.filter(x.isNotNull() & y.isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.var_pop(x + y).alias("_vs"), F.var_pop(x - y).alias("_vd"), (F.avg(x) - F.avg(y)).alias("_d"))
    n = F.col("n")
    free = F.when(n > 1, n - 1)
    rows, raters, rest = n * F.col("_vs") / 2 / free, n * F.pow("_d", F.lit(2)) / 2, n * F.col("_vd") / 2 / free
    denom = rows + rest + F.lit(2) / n * (raters - rest)
    s = s.withColumn("_icc", F.when((n >= least) & (denom >= 1e-10), (rows - rest) / denom))
    i = F.col("_icc")
    se = F.sqrt(4 * F.pow(1 - i, F.lit(2)) * F.pow(1 + i, F.lit(2)) / (2 * free * F.pow(2 * i + n * (1 - i), F.lit(2)) + 1e-10))
    z = F.when(i.isNotNull(), F.atanh(F.greatest(F.lit(-0.9999), F.least(F.lit(0.9999), i))))
    return s.select(*keys, "n", F.when(i.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), i))).alias("icc"), F.round(F.tanh(z - 1.96 * se), 3).alias("low"), F.round(F.tanh(z + 1.96 * se), 3).alias("high"))


def mean_pct_change(df: DataFrame, keys: Keys, before: str, after: str) -> DataFrame:
    """keys, pct_change: mean absolute change in per cent where both are present and before isn't about zero."""
    ok = F.col(before).isNotNull() & F.col(after).isNotNull() & (F.abs(before) > 1e-6)
    return df.groupBy(*keys).agg((F.avg(F.when(ok, F.abs(F.col(after) - F.col(before)) / F.abs(before))) * 100).alias("pct_change"))
