"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key, divided by its quality weight; a source's documents are taken in
key order until their words fill the source's budget. Whole epochs (each document once) come before the
fractional one. The budgets are weights of the sources applied to a total, cut at a number of epochs and
the excess reshared (water filling), worked out on the table of sources.

The prefix sum of a source runs in two levels, since one source may hold a third of all rows: the key's
range is cut into buckets, at least one for each BUCKET rows, whose totals are summed first; rows are sorted
only inside a bucket. With weights from 1/2 to 2 no bucket expects more than three times its even part.

Nulls: a null text has no words and takes none; null sources form one source, ordered last; a row without an
id draws its key by its text. Documents without words are taken 0 times. Repeated rows have the same key and
follow each other. An empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxcohort.llm.grouped import HELD, ROW, with_row_key
from voxcohort.plans.storage import small_or_not, stored

WORD = r"[^\x20\x09-\x0D]+"
SOURCE_WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2
#: Least number of buckets, and rows for which there is one at least.
BUCKETS, BUCKET = 1024, 16_384
#: Quality weights by label; documents without one weigh 1.
LABEL_WEIGHTS = {1: 2.0, 0: 0.5}


def quality_weights(labels: DataFrame) -> DataFrame:
    """doc_id, weight of the labelled documents; the best label counts if there are several."""
    q = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("q"))
    return q.select(F.col("doc_id").alias("_id"), F.when(F.col("q") == 1, LABEL_WEIGHTS[1]).when(F.col("q") == 0, LABEL_WEIGHTS[0]).alias("_weight"))


def budgets(sizes: DataFrame, weights=SOURCE_WEIGHTS, share: float = SHARE, epochs: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size, target per source, from (source, source_size); one row per source throughout.

    With sources in order of cap / weight, the level at source k is what is left by the caps before it, per
    unit of weight from it on. The first level that its own source can hold is the final one.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    whole = Window.partitionBy(F.lit(1))
    s = sizes.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1))
    s = s.withColumn("_cap", F.lit(epochs) * F.col("source_size")).withColumn("_all", F.lit(share) * F.sum("source_size").over(whole))
    rising = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    s = s.withColumn("_k", F.row_number().over(rising))
    s = s.withColumn("_before", F.sum("_cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)))
    s = s.withColumn("_rest_w", F.sum("_w").over(rising.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("_level", (F.col("_all") - F.coalesce("_before", F.lit(0))) / F.col("_rest_w"))
    s = s.withColumn("_level", F.min_by("_level", F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_k"))).over(whole))
    return s.select("source", "source_size", F.least(F.col("_cap").cast("double"), F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap").cast("double"))).alias("target"))


def keyed(docs: DataFrame, weights: DataFrame | None, seed: int, id_col: str, text_col: str, source_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size and the sampling key of each row, and docs' columns named in keep."""
    own = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), F.coalesce(F.md5(F.col(text_col)), F.lit(""))))
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), own.alias("_own"), *keep)
    name = F.concat_ws(":", F.lit(str(seed)), F.col("_own"))
    u = (F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(2**48))
    w = F.lit(1.0)
    if weights is not None:
        rows = rows.join(weights, F.col("doc_id") == F.col("_id"), "left")
        w = F.coalesce(F.col("_weight"), w)
    return rows.select("doc_id", "source", "size", (-F.log(u) / w).alias("key"), *keep)


def mix(docs: DataFrame, weights: DataFrame | None = None, seed: int = 42, source_weights=SOURCE_WEIGHTS, share: float = SHARE, epochs: int = MOST_EPOCHS, buckets: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row, and docs' columns named in keep.

    taken = size times whole epochs, plus size again for the documents of the fractional epoch: those whose
    middle lies within what is left of the target, so a source ends within half a document of it.
    """
    rows = stored(keyed(docs, weights, seed, id_col, text_col, source_col, keep), "mix-rows")
    buckets = buckets or max(BUCKETS, rows.count() // BUCKET)
    # A document of weight w has exp(-key) <= x with probability x^w: the mean of x^2, x and x^(1/2) spreads those of 2, 1 and 1/2.
    x = F.exp(-F.col("key"))
    rows = rows.withColumn("bucket", F.floor((x * x + x + F.sqrt(x)) / 3 * buckets).cast("int"))
    parts = rows.groupBy("source", "bucket").agg(F.sum("size").alias("_in_bucket"))
    plan = budgets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), source_weights, share, epochs)
    down = Window.partitionBy("source").orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_start", F.coalesce(F.sum("_in_bucket").over(down), F.lit(0)))
    parts = parts.join(plan.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    parts = parts.select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), "_start", "source_size", "target")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(parts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("target") - whole * F.col("source_size")
    again = F.when(F.col("_start") + F.col("_before") + F.col("size") / 2 <= rest, F.lit(1)).otherwise(F.lit(0))
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.least(whole + again, F.lit(epochs))).cast("long").alias("taken"), *keep)


def repeated(docs: DataFrame, weights: DataFrame | None = None, **parameters) -> DataFrame:
    """The rows of docs that mix takes, each as often as it is taken; docs' columns only.

    A key written with the rows tells those of one id, or of none, apart.
    """
    keyed_rows = with_row_key(docs)
    at = {"id_col": "doc_id", "text_col": "text", "source_col": "source"}
    names = {k: parameters.pop(k, v) for k, v in at.items()}
    narrow = keyed_rows.select(F.col(ROW), *(F.col(f"{HELD}.`{names[k]}`").alias(v) for k, v in at.items()))
    times = mix(narrow, weights, keep=(ROW,), **parameters).filter("taken > 0")
    times = stored(times.select(F.col(ROW).alias("_taken"), F.expr("cast(taken div size as int)").alias("_times")), "mix-times")
    out = keyed_rows.join(small_or_not(times), F.col(ROW) == F.col("_taken"))
    return out.select(HELD, F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_n")).select(f"{HELD}.*")
