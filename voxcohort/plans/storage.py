"""Tables kept in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few numbers each that may be broadcast after they were counted (about 40 MB as a hash table).
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; on a local master without one a new temporary folder, set for the session."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="spark-voxcohort-")
        spark.sparkContext.setCheckpointDir(where)
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, computed once, written to the shared folder and read back: a cut of the lineage that outlives executors.

    The table stays until that folder is cleared, as results are read from it after the call.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_or_not(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows (counted); else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() <= rows else df


def broadcast_or_merge(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """As small_or_not, but beyond so many rows for a join of sorted rows: the planner doesn't choose, as it takes derived rows for few."""
    return F.broadcast(df) if df.count() <= rows else df.hint("merge")


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, share: int = 4096) -> DataFrame:
    """Left join of rows with one row per group, safe when a group holds a large part of all rows.

    groups: key, size (its number of rows) and columns to attach; sizes add up to total at most.
    A group of more than total / share rows is hot. There are fewer than share of them, so they are
    broadcast; the rest join by a shuffle in which no key has more than total / share rows. Rows already
    matched by a hot group, and rows whose key is null, get a key of their own in it, so they are spread out.
    """
    new = [c for c in groups.columns if c != key]
    line = max(1, total // share)
    hot = groups.filter(F.col(size) > line).select(F.col(key).alias("_hk"), *(F.col(c).alias(f"_h_{c}") for c in new))
    cold = groups.filter(F.col(size) <= line).select(F.col(key).alias("_ck"), *(F.col(c).alias(f"_c_{c}") for c in new))
    found: Column = F.col("_hk").isNotNull()
    out = rows.join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left").withColumn("_k", F.when(found | F.col(key).isNull(), F.concat(F.lit("\x00"), F.xxhash64(*rows.columns).cast("string"))).otherwise(F.col(key)))
    out = out.join(cold, F.col("_k") == F.col("_ck"), "left")
    return out.select(*rows.columns, *(F.when(found, F.col(f"_h_{c}")).otherwise(F.col(f"_c_{c}")).alias(c) for c in new))
