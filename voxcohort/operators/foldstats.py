"""Preparation of every training set of a nested cross-validation from statistics that add up over folds.

Rows lie in cells, one for each outer and inner fold. One pass sums, per cell, the products of all pairs of features,
of their presence and of the classes. A training set is all rows but those of one outer fold, or of one outer and one
inner fold, so its sums are the whole sums less those of the cells left out, and its means, deviations, variances,
correlations and F values follow from them, with its own medians in place of missing values. Medians come from the
numbers of the distinct values per cell. No row of a left-out cell enters a training set's numbers.

What reaches the driver is the square of the number of features and classes for each cell, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxcohort.operators import prep
from voxcohort.operators.quantiles import percentiles
from voxcohort.operators.summary import long_form
from voxcohort.plans.storage import stored


@dataclass
class FoldSums:
    """Sums per cell [outer, inner] of products of the columns: values (less centre, missing ones 0), presence, classes."""

    features: list[str]
    classes: int
    centre: np.ndarray
    sums: np.ndarray
    medians: dict[tuple[int, int | None], np.ndarray]

    def training(self, outer: int, inner: int | None = None) -> np.ndarray:
        """The sums of all rows but those of the outer fold (and of the inner one)."""
        out = self.sums.sum(axis=(0, 1)) - self.sums[outer].sum(axis=0)
        return out if inner is None else out - (self.sums[:, inner].sum(axis=0) - self.sums[outer, inner])


def gather(df: DataFrame, features: Sequence[str], label: str = "label", classes: int = 2, outer: int = 5, inner: int = 3) -> FoldSums:
    """One pass over df (label 0 .. classes - 1, fold, inner_fold, and the features) for the sums, one for the medians."""
    cols, d = list(features), len(features)
    width = 2 * d + classes
    # A shift by a rough centre keeps squares from cancelling; it falls out of every result.
    row = df.agg(*(F.avg(F.col(c).cast("double")).alias(f"c{i}") for i, c in enumerate(cols))).first()
    centre = np.array([v or 0.0 for v in row])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((outer * inner, width, width))
        for pdf in frames:
            x = pdf[cols].to_numpy(dtype=float)
            there = np.isfinite(x)
            m = np.concatenate((np.where(there, x - centre, 0.0), there, pdf[label].to_numpy()[:, None] == np.arange(classes)), axis=1).astype(float)
            cell = pdf["fold"].to_numpy() * inner + pdf["inner_fold"].to_numpy()
            for c in np.unique(cell):
                own = m[cell == c]
                total[c] += own.T @ own
        yield pd.DataFrame({"cell": np.repeat(np.arange(outer * inner), width), "i": np.tile(np.arange(width), outer * inner), "s": list(total.reshape(-1, width))})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cell": pdf["cell"].iloc[:1], "i": pdf["i"].iloc[:1], "s": [np.sum(pdf["s"].tolist(), axis=0)]})

    schema = "cell int, i int, s array<double>"
    narrow = df.select(*(F.col(c).cast("double").alias(c) for c in cols), label, "fold", "inner_fold")
    parts = narrow.mapInPandas(run, schema).groupBy("cell", "i").applyInPandas(added, schema)
    sums = np.zeros((outer * inner, width, width))
    for r in parts.toLocalIterator():
        sums[r["cell"], r["i"]] = r["s"]
    return FoldSums(cols, classes, centre, sums.reshape(outer, inner, width, width), medians(df, cols, outer, inner))


def medians(df: DataFrame, features: Sequence[str], outer: int, inner: int) -> dict[tuple[int, int | None], np.ndarray]:
    """The exact medians of every training set, (outer, None) or (outer, inner); 0 for a feature without values.

    Distinct values are counted per cell first; each count goes to the training sets that hold its cell.
    """
    long = long_form(df, ["fold", "inner_fold"], features).filter("value IS NOT NULL")
    cells = stored(long.groupBy("feature", "fold", "inner_fold", F.col("value").alias("v")).agg(F.count(F.lit(1)).alias("n")), "fold-values")
    sets = F.sequence(F.lit(0), F.lit(outer * (inner + 1) - 1))
    held = F.filter(sets, lambda s: (F.floor(s / (inner + 1)) != F.col("fold")) & (s % (inner + 1) != F.col("inner_fold")))
    counts = cells.select("feature", F.explode(held).alias("set"), "v", "n").groupBy("feature", "set", "v").agg(F.sum("n").alias("n"))
    out = {(k, None if j == inner else j): np.zeros(len(features)) for k in range(outer) for j in range(inner + 1)}
    place = {f: i for i, f in enumerate(features)}
    for r in percentiles(counts, ["feature", "set"], [0.5]).select("feature", "set", F.col("q")[0].alias("m")).toLocalIterator():
        k, j = divmod(r["set"], inner + 1)
        out[k, None if j == inner else j][place[r["feature"]]] = r["m"]
    return out


@dataclass
class Moments:
    """Of a training set with missing values filled in: n, means, population deviations, correlations and F values."""

    n: float
    fill: np.ndarray
    mean: np.ndarray
    std: np.ndarray
    r: np.ndarray
    f: np.ndarray


def moments(held: FoldSums, outer: int, inner: int | None = None) -> Moments:
    d, k = len(held.features), held.classes
    s = held.training(outer, inner)
    n_class = np.diag(s)[2 * d :]
    n = n_class.sum()
    fill = held.medians[outer, inner]
    m = fill - held.centre
    value, there = slice(0, d), slice(d, 2 * d)
    of_class = s[value, 2 * d :] + m[:, None] * (n_class - s[there, 2 * d :])  # sums per class, filled in
    total, present = np.diag(s[value, there]), np.diag(s[there, there])
    alone = total[:, None] - s[value, there]  # of a feature where another is missing
    neither = n - present[:, None] - present[None, :] + s[there, there]
    square = s[value, value] + alone * m[None, :] + alone.T * m[:, None] + neither * np.outer(m, m)
    sums = of_class.sum(axis=1)
    cov = square / n - np.outer(sums, sums) / n**2
    var = np.maximum(np.diag(cov), 0.0)
    flat = var <= 1e-12 * np.maximum(np.diag(square) / n, 1e-300)
    std = np.where(flat, 0.0, np.sqrt(var))
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.where(std[:, None] * std[None, :] > 0, cov / (std[:, None] * std[None, :]), 0.0)
        used = n_class > 0
        between = (of_class[:, used] ** 2 / n_class[used]).sum(axis=1) - sums**2 / n
        f = (between / (used.sum() - 1)) / ((n * var - between) / (n - used.sum()))
    return Moments(n, fill, sums / n + held.centre, std, r, np.where(std > 0, np.nan_to_num(f, nan=0.0, posinf=np.inf), 0.0))


def prepared(held: FoldSums, outer: int, inner: int | None, correlated: float | None = 0.90, least: float = 0.01) -> tuple[list[prep.Columnwise], list[str]]:
    """Steps fitted on a training set, and the features they leave: medians, scaling, the variance filter (after scaling), and with
    correlated the filter of correlated features by F."""
    x, names = moments(held, outer, inner), held.features
    steps = [prep.Columnwise(fill=dict(zip(names, x.fill.tolist(), strict=True)))]
    steps.append(prep.Columnwise(centre={c: (float(x.mean[i]), float(x.std[i]) or 1.0) for i, c in enumerate(names)}))
    kept = [c for i, c in enumerate(names) if (1.0 if x.std[i] > 0 else 0.0) >= least]
    steps.append(prep.Columnwise(keep=kept, features=list(names)))
    if correlated is not None:
        at = {c: i for i, c in enumerate(names)}
        linked = {(a, b) for i, a in enumerate(kept) for b in kept[i + 1 :] if abs(x.r[at[a], at[b]]) > correlated}
        left = prep.drop_correlated(kept, linked, {c: float(x.f[at[c]]) for c in kept}, "fscore")
        steps.append(prep.Columnwise(keep=left, features=kept))
        kept = left
    return steps, kept
