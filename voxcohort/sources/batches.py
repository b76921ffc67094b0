"""Result tables that grow by batches: a batch is there as a whole or not at all, and may be written again.

A batch's rows go to a folder of its own; a row in the log, written after it, makes it part of the table. A batch whose writer
died has no row in the log: it is not read, and the next try replaces its folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxcohort.operators.evaluate import numbered

#: Subjects of a batch.
BATCH = 20


def committed(spark: SparkSession, path: str) -> DataFrame:
    """batch, n: the batches of the table at path and their rows; none if there is no table."""
    try:
        return spark.read.schema("batch string, n long").parquet(f"{path}/log/*")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], "batch string, n long")
        raise


def append_batch(df: DataFrame, path: str, batch: str) -> bool:
    """Adds df as a batch, if the table doesn't have it; whether it was added."""
    spark = df.sparkSession
    if not committed(spark, path).filter(F.col("batch") == batch).isEmpty():
        return False
    folder = f"{path}/rows/{batch}"
    df.write.mode("overwrite").parquet(folder)
    n = spark.read.schema(df.schema).parquet(folder).count()
    spark.createDataFrame([(batch, n)], "batch string, n long").coalesce(1).write.mode("overwrite").parquet(f"{path}/log/{batch}")
    return True


def read_batches(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The rows of all batches in the log; schema is needed only for a table without batches."""
    names = [r["batch"] for r in committed(spark, path).select("batch").distinct().orderBy("batch").collect()]  # one name per batch
    if not names:
        return spark.createDataFrame([], schema or "batch string")
    return spark.read.parquet(*(f"{path}/rows/{n}" for n in names))


def in_batches(ids: DataFrame, id_col: str, size: int = BATCH) -> DataFrame:
    """Distinct ids with batch, a text: size ids each, by the order of their md5."""
    rows = ids.select(id_col).filter(F.col(id_col).isNotNull()).distinct().withColumn("_h", F.md5(F.col(id_col).cast("string")))
    placed = numbered(rows, [], [F.col("_h"), F.col(id_col)], F.substring("_h", 1, 2), "_place")
    return placed.select(id_col, F.format_string("b%08d", F.floor((F.col("_place") - 1) / size).cast("long")).alias("batch"))


def resume(ids: DataFrame, id_col: str, work: Callable[[DataFrame], DataFrame], path: str, size: int = BATCH) -> int:
    """Works through the ids in batches and appends what work gives for each; batches that are there are left out. How many were added.

    The ids must be those of the first run; what is new goes into another table.
    """
    spark = ids.sparkSession
    named = in_batches(ids, id_col, size).cache()
    open_ = named.select("batch").distinct().join(committed(spark, path).select("batch"), "batch", "left_anti")
    done = 0
    for r in open_.orderBy("batch").collect():  # one name per batch
        done += append_batch(work(named.filter(F.col("batch") == r["batch"]).select(id_col)), path, r["batch"])
    named.unpersist()
    return done
