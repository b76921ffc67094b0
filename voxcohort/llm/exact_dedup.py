"""Exact deduplication by progressive refinement: length, then a hash of the first characters, then the full hash.

Each step counts what the step before it left (combined on the map side) and only groups of two or more go
on, so the full content is hashed only for rows whose length and prefix occur more than once. Texts are
compared without white space ([\\x20\\x09-\\x0D]). Equality is decided by SHA-256 of the whole text.

Nulls: a null text counts as empty, and empty texts form a group like any other. A null id sorts first.
Ties: of rows equal in text, length and id, one stays; deduplicated tells rows apart by a key written with
them, so a row goes only for its own text, whatever ids repeat. An empty table gives an empty result. Other
columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxcohort.llm.grouped import HELD, ROW, with_row_key
from voxcohort.plans.storage import attach, small_or_not, stored

BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
PREFIX = 64


def bare(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def survivors(rows: DataFrame) -> DataFrame:
    """n_bare, prefix_hash of the groups that have two rows or more after both cheap steps."""
    lengths = rows.groupBy("n_bare").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("n_bare")
    left = rows.join(small_or_not(lengths), "n_bare", "left_semi")
    return left.groupBy("n_bare", "prefix_hash").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX, all_hashes: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_text, text_sha256, keep_id, group_size, kept for every row, and docs' columns named in keep.

    The row with the most code points, then the smallest id, stays. text_sha256 is null for rows that no
    other row can equal, unless all_hashes.
    """
    text = F.col(text_col)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.length(F.coalesce(text, F.lit(""))).alias("n_text"), bare(text).alias("_bare"), *keep)
    narrow = narrow.select("doc_id", "n_text", F.length("_bare").alias("n_bare"), F.xxhash64(F.substring("_bare", 1, prefix)).alias("prefix_hash"), "_bare", *keep)
    # The cheap keys are written once, so that the steps don't read and strip the texts again.
    again = survivors(stored(narrow.select("n_bare", "prefix_hash"), "exact-keys")).withColumn("_again", F.lit(True))
    # A small list of surviving keys goes to the rows; a large one meets them by a shuffle, which AQE splits.
    rows = narrow.join(small_or_not(again), ["n_bare", "prefix_hash"], "left")
    digest = F.sha2(F.col("_bare").cast("binary"), 256)
    rows = rows.select("doc_id", "n_text", (digest if all_hashes else F.when(F.col("_again"), digest)).alias("text_sha256"), F.coalesce("_again", F.lit(False)).alias("_again"), *keep)
    rows = stored(rows.withColumn("_tag", F.monotonically_increasing_id()), "exact-rows")
    best = F.struct((-F.col("n_text")).alias("n"), F.col("doc_id").alias("id"), F.col("_tag").alias("tag"))
    groups = rows.filter("_again").groupBy("text_sha256").agg(F.min(best).alias("_best"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    out = attach(rows, groups, "text_sha256", "group_size", rows.count())
    return out.select(
        "doc_id",
        "n_text",
        "text_sha256",
        F.when(F.col("_best").isNull(), F.col("doc_id")).otherwise(F.col("_best.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("_best.tag") == F.col("_tag"), F.lit(True)).alias("kept"),
        *keep,
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with docs' columns; only the keys of rows that go are joined to the texts."""
    keyed = with_row_key(docs)
    found = exact_dedup(keyed.select(F.col(ROW), F.col(f"{HELD}.`{id_col}`").alias("id"), F.col(f"{HELD}.`{text_col}`").alias("text")), "id", "text", keep=(ROW,))
    gone = stored(found.filter(~F.col("kept")).select(F.col(ROW).alias("_llm_gone")), "exact-gone")
    return keyed.join(small_or_not(gone), F.col(ROW) == F.col("_llm_gone"), "left_anti").select(f"{HELD}.*")
