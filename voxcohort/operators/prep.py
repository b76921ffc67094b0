"""Fold-local preparation: every fit reads only the rows it is given and returns a model to apply anywhere."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxcohort.operators.quantiles import percentiles
from voxcohort.operators.ranks import anova_f, correlation_pairs
from voxcohort.operators.summary import long_form, value_table


@dataclass
class Columnwise:
    """A fitted shift and scale, fill value or selection of columns: one number per feature, whatever the rows."""

    fill: dict[str, float] | None = None
    centre: dict[str, tuple[float, float]] | None = None
    keep: list[str] | None = None
    features: list[str] | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        if self.fill is not None:
            out = out.select(*(F.coalesce(F.col(c), F.lit(self.fill[c])).alias(c) if c in self.fill else F.col(c) for c in out.columns))
        if self.centre is not None:
            out = out.select(*(((F.col(c) - self.centre[c][0]) / self.centre[c][1]).alias(c) if c in self.centre else F.col(c) for c in out.columns))
        if self.keep is not None:
            gone = set(self.features or ()) - set(self.keep)
            out = out.select(*(c for c in out.columns if c not in gone))
        return out


def median_imputer(train: DataFrame, features: Sequence[str]) -> Columnwise:
    """Exact medians; a feature without values is filled with 0."""
    counts = value_table(long_form(train, [], features), ["feature"], "value")
    found = {r["feature"]: r["m"] for r in percentiles(counts, ["feature"], [0.5]).select("feature", F.col("q")[0].alias("m")).collect()}  # one row per feature
    return Columnwise(fill={c: found.get(c, 0.0) for c in features})


def standardizer(train: DataFrame, features: Sequence[str]) -> Columnwise:
    """Mean and population deviation; a deviation of zero counts as 1."""
    row = train.agg(*(f(c).alias(f"{t}{c}") for c in features for t, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    return Columnwise(centre={c: (row[f"m{c}"] or 0.0, row[f"s{c}"] or 1.0) for c in features})


def variance_filter(train: DataFrame, features: Sequence[str], least: float = 0.01, strict: bool = False) -> Columnwise:
    """Features whose population variance is at least (strict: above) the threshold."""
    row = train.agg(*(F.var_pop(c).alias(c) for c in features)).first()
    keep = [c for c in features if row[c] is not None and (row[c] > least if strict else row[c] >= least)]
    return Columnwise(keep=keep, features=list(features))


def drop_correlated(features: Sequence[str], linked: set[tuple[str, str]], f: dict[str, float] | None, rule: str) -> list[str]:
    """What is left of features (in order) under a rule; linked: pairs (earlier, later) above the threshold.

    later: a feature linked to any earlier one goes, whether that one stays or not. fscore: of a linked pair
    the lower F goes (a tie keeps the earlier); a feature that goes still settles its later pairs.
    fscore_break: the same, but it settles none after it goes. Without f the later of a pair goes.
    """
    if rule not in ("later", "fscore", "fscore_break"):
        raise ValueError(f"unknown rule {rule!r}")
    gone: set[str] = set()
    for i, a in enumerate(features):
        if rule != "later" and a in gone:
            continue
        for b in features[i + 1 :]:
            if (a, b) not in linked or (rule != "later" and b in gone):
                continue
            if rule == "later" or f is None or f.get(a, 0.0) >= f.get(b, 0.0):
                gone.add(b)
            else:
                gone.add(a)
                if rule == "fscore_break":
                    break
    return [c for c in features if c not in gone]


def correlation_filter(train: DataFrame, features: Sequence[str], class_col: str | None = None, most: float = 0.90, rule: str = "fscore") -> Columnwise:
    """Drops features by pairs with abs(r) above most; the pass over the small table of such pairs is on the driver."""
    pairs = {(r["a"], r["b"]) for r in correlation_pairs(train, features).filter(F.abs("r") > most).collect()}
    f = None
    if class_col is not None and rule != "later":
        f = {r["feature"]: r["f"] or 0.0 for r in anova_f(long_form(train, [class_col], features), class_col).collect()}
    return Columnwise(keep=drop_correlated(list(features), pairs, f, rule), features=list(features))
