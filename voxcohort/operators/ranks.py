"""Rank statistics and group tests.

Ranks come from distinct values with their counts. A feature may have very many rows and even distinct values,
so no window runs over a whole feature: its values are cut at approximate quantiles, the pieces' totals are
summed along the feature (PIECES rows), and rows are sorted within a piece only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxcohort.functions import tails
from voxcohort.operators.quantiles import percentiles
from voxcohort.operators.summary import _meet, value_table
from voxcohort.plans.storage import attach, stored

PIECES = 64


def ranked_counts(df: DataFrame, keys: Sequence[str], value: str, by: Sequence[str] = ()) -> DataFrame:
    """keys, v, total (rows of the value), rank (average rank of ties), and for by: by, n (rows of the value in by)."""
    rows = df.filter(F.col(value).isNotNull())
    # Written once: the cuts, the pieces and the ranks below all start from the distinct values.
    cells = stored(rows.groupBy(*keys, *by, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n")), "distinct-values")
    values = cells.groupBy(*keys, "v").agg(F.sum("n").alias("total"))
    cuts = values.groupBy(*keys).agg(F.percentile_approx("v", [i / PIECES for i in range(1, PIECES)], 1000).alias("_cuts"))
    values = _meet(values, cuts, keys).withColumn("_piece", F.size(F.filter("_cuts", lambda c: c < F.col("v")))).drop("_cuts")
    along = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = values.groupBy(*keys, "_piece").agg(F.sum("total").alias("_in")).withColumn("_base", F.coalesce(F.sum("_in").over(along), F.lit(0))).drop("_in")
    inside = Window.partitionBy(*keys, "_piece").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    values = values.withColumn("_upto", F.sum("total").over(inside))
    values = _meet(values, pieces, [*keys, "_piece"]).select(*keys, "v", "total", (F.col("_base") + F.col("_upto") - (F.col("total") - 1) / 2).alias("rank"))
    return _meet(cells, values, [*keys, "v"]) if by else values


def average_rank(df: DataFrame, keys: Sequence[str], value: str, ties: str = "average") -> DataFrame:
    """df with rank, the average rank of value among the rows of keys (ties "least": the least rank of equal values); null for null."""
    # A row's group and value in one key, so that rows of a value that very many share are spread out.
    key = F.sha2(F.to_json(F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.col(value).cast("double").alias("v"))), 256)
    ranks = ranked_counts(df, keys, value)
    named = F.sha2(F.to_json(F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.col("v").alias("v"))), 256)
    rank = F.col("rank") if ties == "average" else F.col("rank") - (F.col("total") - 1) / 2
    ranks = stored(ranks.select(named.alias("_value"), F.col("total").alias("_total"), rank.alias("rank")), "value-ranks")
    rows = df.withColumn("_value", F.when(F.col(value).isNotNull(), key))
    return attach(rows, ranks, "_value", "_total", df.count()).drop("_value", "_total")


def kruskal(long: DataFrame, class_col: str, least: int = 3) -> DataFrame:
    """feature, n, k, kw_h, kw_p, eta_squared over classes of least values or more; features with two such classes whose values vary."""
    sizes = long.filter("value IS NOT NULL").groupBy("feature", class_col).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).drop("_n")
    kept = _meet(long, sizes, ["feature", class_col])
    cells = ranked_counts(kept, ["feature"], "value", [class_col])
    tied = F.col("total").cast("double")
    per_class = cells.groupBy("feature", class_col).agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("rank")).alias("r"), F.sum(F.col("n") * (tied * tied - 1)).alias("t"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    out = per_class.groupBy("feature").agg(F.sum("m").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("r") * F.col("r") / F.col("m")).alias("s"), F.sum("t").alias("t"), (F.max("hi") - F.min("lo")).alias("_range")).filter("k >= 2 AND _range >= 2e-10")
    n = F.col("n").cast("double")
    h = (F.lit(12) / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / (1 - F.col("t") / (F.pow(n, F.lit(3)) - n))
    out = out.select("feature", "n", "k", h.alias("kw_h"))
    return out.select("feature", "n", "k", "kw_h", tails.chi2_sf("kw_h", (F.col("k") - 1).cast("double")).alias("kw_p"), F.greatest(F.lit(0.0), (F.col("kw_h") - F.col("k") + 1) / (F.col("n") - F.col("k"))).alias("eta_squared"))


def mannwhitney_pairs(long: DataFrame, class_col: str, pairs: Sequence[tuple[str, str]], correction: int | None = None) -> DataFrame:
    """feature, class_a, class_b, n_a, n_b, u, z, p, p_bonf (p times the number of pairs, at most 1).

    p is exact where a side has 8 values or fewer and there are no ties; else normal, with corrections for
    ties and continuity.
    """
    listed = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs)))
    rows = long.filter("value IS NOT NULL").select("feature", F.col(class_col).alias("_c"), "value", listed.alias("_p")).filter("_c = _p.a OR _c = _p.b")
    rows = rows.select("feature", F.col("_p.a").alias("class_a"), F.col("_p.b").alias("class_b"), "value", (F.col("_c") == F.col("_p.a")).alias("_first"))
    keys = ["feature", "class_a", "class_b"]
    cells = ranked_counts(rows, keys, "value", ["_first"])
    sums = cells.groupBy(*keys).agg(
        F.sum(F.when(F.col("_first"), F.col("n")).otherwise(0)).alias("n_a"),
        F.sum(F.when(F.col("_first"), 0).otherwise(F.col("n"))).alias("n_b"),
        F.sum(F.when(F.col("_first"), F.col("n") * F.col("rank")).otherwise(0.0)).alias("_r"),
        F.sum(F.col("n") * (F.col("total").cast("double") * F.col("total") - 1)).alias("_t"),
    )
    out = sums.filter("n_a > 0 AND n_b > 0")
    a, b, n = F.col("n_a").cast("double"), F.col("n_b").cast("double"), (F.col("n_a") + F.col("n_b")).cast("double")
    out = out.withColumn("u", F.col("_r") - a * (a + 1) / 2)
    sd = F.sqrt(a * b / 12 * (n + 1 - F.col("_t") / (n * (n - 1))))
    z = (F.greatest(F.col("u"), a * b - F.col("u")) - a * b / 2 - 0.5) / sd
    out = out.withColumn("z", F.when(sd > 0, z))
    few = (F.least("n_a", "n_b") <= 8) & (F.col("_t") == 0)
    exact = tails.mwu_exact_sf(F.when(few, F.col("u")), a, b)
    normal = F.when(F.col("z") < 0, F.lit(1.0)).otherwise(tails.norm_sf2("z"))
    p = F.coalesce(exact, normal, F.lit(1.0))
    return out.select(*keys, "n_a", "n_b", "u", "z", p.alias("p")).withColumn("p_bonf", F.least(F.lit(1.0), F.col("p") * (correction or len(pairs))))


def benjamini_hochberg(df: DataFrame, p: str, keys: Sequence[str] = (), q: str = "q") -> DataFrame:
    """df with q: the smallest p n / rank from the row's rank on, at most 1; null p is not counted. One row per test: a small table."""
    part = Window.partitionBy(*keys, F.col(p).isNull())
    ranked = df.withColumn("_r", F.row_number().over(part.orderBy(p))).withColumn("_n", F.count(F.lit(1)).over(part))
    rest = part.orderBy("_r").rowsBetween(0, Window.unboundedFollowing)
    return ranked.withColumn(q, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min(F.col(p) * F.col("_n") / F.col("_r")).over(rest)))).drop("_r", "_n")


def anova_f(long: DataFrame, class_col: str) -> DataFrame:
    """feature, f: one-way analysis of variance; null where a class leaves no freedom or nothing varies inside."""
    c = long.filter("value IS NOT NULL").groupBy("feature", class_col).agg(F.count(F.lit(1)).alias("m"), F.avg("value").alias("a"), F.var_pop("value").alias("v"))
    w = c.groupBy("feature").agg(F.sum("m").alias("n"), F.count(F.lit(1)).alias("k"), (F.sum(F.col("m") * F.col("a")) / F.sum("m")).alias("g"), F.sum(F.col("m") * F.col("v")).alias("inside"))
    between = _meet(c, w.select("feature", "g"), ["feature"]).groupBy("feature").agg(F.sum(F.col("m") * F.pow(F.col("a") - F.col("g"), F.lit(2))).alias("between"))
    n, k = F.col("n"), F.col("k")
    return w.join(between, "feature").select("feature", F.when((k > 1) & (n > k) & (F.col("inside") > 0), (F.col("between") / (k - 1)) / (F.col("inside") / (n - k))).alias("f"))


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, ties: str = "average") -> DataFrame:
    """keys, n, rho, p over complete pairs; ties as in average_rank."""
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"))
    both = average_rank(average_rank(pairs, keys, "_x", ties).withColumnRenamed("rank", "_rx"), keys, "_y", ties).withColumnRenamed("rank", "_ry")
    out = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.covar_pop("_rx", "_ry"), F.stddev_pop("_rx") * F.stddev_pop("_ry")).alias("_rho"))
    out = out.withColumn("rho", F.when(F.col("_rho").isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_rho"))))).drop("_rho")
    t = F.when(F.abs("rho") < 1, F.col("rho") * F.sqrt((F.col("n") - 2) / (1 - F.col("rho") * F.col("rho")))).when(F.col("rho").isNotNull(), F.lit(float("inf")))
    return out.withColumn("p", F.when(F.col("n") > 2, tails.t_sf2(t, (F.col("n") - 2).cast("double"))))


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b, n, r for each pair a before b in the list, over rows where both are present.

    One pass: each partition sums products per pair and only those sums are shuffled.
    """
    import numpy as np
    import pandas as pd

    cols = list(columns)
    i, j = np.triu_indices(len(cols), 1)

    def run(batches):
        total = np.zeros((6, len(i)))
        for pdf in batches:
            x = pdf.to_numpy(dtype=float)
            ok = np.isfinite(x)
            z, w = np.where(ok, x, 0.0), ok.astype(float)
            for row, m in enumerate((w.T @ w, z.T @ w, w.T @ z, (z * z).T @ w, w.T @ (z * z), z.T @ z)):
                total[row] += m[i, j]
        yield pd.DataFrame({"i": i, "j": j, **{f"s{k}": total[k] for k in range(6)}})

    # Shifting by a rough centre keeps the sums of squares from cancelling.
    centre = df.agg(*(F.avg(F.col(c).cast("double")).alias(c) for c in cols)).first()
    shifted = df.select(*((F.col(c).cast("double") - F.lit(float(centre[c] or 0.0))).alias(c) for c in cols))
    s = shifted.mapInPandas(run, "i int, j int, s0 double, s1 double, s2 double, s3 double, s4 double, s5 double").groupBy("i", "j").agg(*(F.sum(f"s{k}").alias(f"s{k}") for k in range(6)))
    n, sx, sy, sxx, syy, sxy = (F.col(f"s{k}") for k in range(6))
    vx, vy = sxx - sx * sx / n, syy - sy * sy / n
    r = F.when((n > 1) & (vx > 0) & (vy > 0), (sxy - sx * sy / n) / F.sqrt(vx * vy))
    names = F.array(*map(F.lit, cols))
    return s.select(F.element_at(names, F.col("i") + 1).alias("a"), F.element_at(names, F.col("j") + 1).alias("b"), n.cast("long").alias("n"), r.alias("r"))


def group_comparison(long: DataFrame, class_col: str, classes: Sequence[str]) -> DataFrame:
    """kruskal with q and each class's median, iqr and n."""
    cell = percentiles(value_table(long, ["feature", class_col], "value"), ["feature", class_col], (0.25, 0.5, 0.75))
    cell = cell.select("feature", class_col, F.col("q")[1].alias("median"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"), F.col("total").alias("n"))
    wide = cell.groupBy("feature").pivot(class_col, list(classes)).agg(F.first("median").alias("median"), F.first("iqr").alias("iqr"), F.first("n").alias("n"))
    return benjamini_hochberg(kruskal(long, class_col), "kw_p", q="kw_q").join(wide, "feature")


def significant(stats: DataFrame, alpha: float = 0.05, q: str = "kw_q", by: str = "eta_squared") -> DataFrame:
    """Rows with q below alpha, largest effect first."""
    return stats.filter(F.col(q) < alpha).orderBy(F.col(by).desc(), "feature")


def concordance(stats: DataFrame, attribution: DataFrame, effect: str = "eta_squared", score: str = "shap_weighted_mean_abs", ties: str = "average") -> DataFrame:
    """Rows of both tables by trimmed feature name, with Spearman's rho and p of effect and score on each row; ties as in average_rank."""
    a = stats.select(F.trim("feature").alias("feature"), *(c for c in stats.columns if c != "feature"))
    both = stored(a.join(attribution.select(F.trim("feature").alias("feature"), score), "feature").dropna(), "concordance")
    rho = spearman(both.withColumn("_all", F.lit(1)), ["_all"], effect, score, ties).select(F.col("rho").alias("spearman_rho"), F.col("p").alias("spearman_p"))
    return both.join(F.broadcast(rho), F.lit(True), "left")  # one row
