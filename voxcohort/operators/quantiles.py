"""Exact quantiles of groups of any size, by selection.

A group's distinct values, with their numbers, are cut at approximate quantiles of a sketch of fixed size. The numbers of the
pieces, added up, tell which pieces hold the places asked for; the values of all others are left out and the pieces
that stay are cut again, until each has few enough values to be sorted in one task. So no task holds a group, and each
round leaves about a sixty-fourth of the values for each place. Small groups are sorted at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxcohort.plans.storage import small_or_not, stored

PIECES = 64
#: Distinct values of a group, or of a piece of it, that are sorted in one task.
SORTED = 65_536


def _on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys where null equals null; right's keys are dropped."""
    names = {k: f"_on{i}" for i, k in enumerate(keys)}
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(names[k]))
    return left.join(right.select(*(F.col(k).alias(names[k]) for k in keys), *(c for c in right.columns if c not in keys)), on).drop(*names.values())


def percentiles(counts: DataFrame, keys: Sequence[str], shares: Sequence[float], most: int = SORTED) -> DataFrame:
    """keys, total, q: the number of rows, and the array of the values at shares of the way, linear between neighbours.

    counts: keys, v, n: distinct values (any without null) and how often each occurs. most: values that a task sorts.
    """
    keys = list(keys)
    counts = stored(counts.select(*keys, "v", "n"), "quantile-values")
    ends = stored(counts.groupBy(*keys).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("_m")), "quantile-groups")
    largest = ends.agg(F.max("_m")).first()[0] or 0
    rows = _on(counts, small_or_not(ends), keys).withColumns({"_path": F.lit(0).cast("long"), "_base": F.lit(0).cast("long")})
    places = [F.lit(float(s)) * (F.col("total") - 1) for s in shares]
    wanted = F.array(*(p for x in places for p in (F.floor(x), F.ceil(x))))
    done = rows.filter(F.col("_m") <= most)
    while largest > most:
        group = [*keys, "_path"]
        rows = stored(rows.filter(F.col("_m") > most), "quantile-open")
        cuts = rows.groupBy(*group).agg(F.percentile_approx("v", [i / PIECES for i in range(1, PIECES)], 2000).alias("_cuts"))
        pieced = _on(rows, small_or_not(stored(cuts, "quantile-cuts")), group).withColumn("_piece", F.size(F.filter("_cuts", lambda c: c < F.col("v")))).drop("_cuts", "_m")
        sizes = pieced.groupBy(*group, "_piece").agg(F.sum("n").alias("_in"), F.count(F.lit(1)).alias("_m"), F.first("total").alias("total"), F.first("_base").alias("_base"))
        before = Window.partitionBy(*group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)  # 64 rows
        sizes = sizes.withColumn("_from", F.col("_base") + F.coalesce(F.sum("_in").over(before), F.lit(0)))
        held = sizes.filter(F.exists(wanted, lambda i: (i >= F.col("_from")) & (i < F.col("_from") + F.col("_in"))))
        held = stored(held.select(*group, "_piece", "_m", "_from"), "quantile-pieces")
        largest = held.agg(F.max("_m")).first()[0]
        rows = _on(pieced.drop("_base"), small_or_not(held), [*group, "_piece"])
        rows = rows.select(*keys, "v", "n", "total", "_m", (F.col("_path") * PIECES + F.col("_piece")).alias("_path"), F.col("_from").alias("_base"))
        done = done.unionByName(rows.filter(F.col("_m") <= most))
    upto = F.col("_base") + F.sum("n").over(Window.partitionBy(*keys, "_path").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    done = done.withColumn("_upto", upto)
    here = lambda i: F.max(F.when((i < F.col("_upto")) & (i >= F.col("_upto") - F.col("n")), F.col("v")))
    out = done.groupBy(*keys).agg(F.first("total").alias("total"), *(here(r(x)).alias(f"_{t}{k}") for k, x in enumerate(places) for t, r in (("a", F.floor), ("b", F.ceil))))
    q = []
    for k, x in enumerate(places):
        a, b, part = F.col(f"_a{k}"), F.col(f"_b{k}"), x - F.floor(x)
        q.append(F.when(a == b, a).otherwise((1 - part) * a + part * b))
    return out.select(*keys, "total", F.array(*q).alias("q"))
