"""Grouped work that goes on past a group that fails: rows and errors come out of one pass, are written once and then split."""

from __future__ import annotations

import traceback
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxcohort.plans.storage import stored

#: What is recorded of an exception, as strings.
ERROR = ("error_type", "message", "traceback_short")


def described(e: BaseException) -> tuple[str, str, str]:
    """The type, the message, and the last three lines of the traceback."""
    lines = "".join(traceback.format_exception(e)).strip().split("\n")
    return type(e).__name__, str(e), " | ".join(x.strip() for x in lines[-3:])


def tagged(run: Callable[[pd.DataFrame], pd.DataFrame], keys: Sequence[str], columns: Sequence[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """run for applyInPandas with the columns _error_type, ... added: null on its rows; a group that raises gives one row of its keys and the error."""
    names = [f"_{c}" for c in ERROR]

    def guarded(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            out = run(pdf)[list(columns)].copy()
            for c in names:
                out[c] = None
            return out
        except Exception as e:
            row = {c: None for c in columns} | {k: pdf[k].iloc[0] for k in keys} | dict(zip(names, described(e), strict=True))
            return pd.DataFrame([row], columns=[*columns, *names])

    return guarded


def split(held: DataFrame, keys: Sequence[str], block: str) -> tuple[DataFrame, DataFrame]:
    """From stored rows tagged by tagged(): the rows, and keys, feature_block, error_type, message, traceback_short of what failed."""
    failed = F.col(f"_{ERROR[0]}").isNotNull()
    rows = held.filter(~failed).drop(*(f"_{c}" for c in ERROR))
    return rows, held.filter(failed).select(*keys, F.lit(block).alias("feature_block"), *(F.col(f"_{c}").alias(c) for c in ERROR))


def apply_guarded(df: DataFrame, keys: Sequence[str], run: Callable[[pd.DataFrame], pd.DataFrame], schema: str, block: str) -> tuple[DataFrame, DataFrame]:
    """Rows and errors of run over the groups of df; every group is worked on once, and the others finish if one fails."""
    columns = [f.strip().rsplit(" ", 1)[0] for f in schema.split(",")]
    whole = schema + "".join(f", _{c} string" for c in ERROR)
    return split(stored(df.groupBy(*keys).applyInPandas(tagged(run, keys, columns), whole), f"guarded-{block}"), keys, block)


def raise_on(errors: DataFrame) -> None:
    """Raises if there are errors, with their number and the most frequent kinds."""
    kinds = errors.groupBy("error_type", "feature_block").count().orderBy(F.col("count").desc(), "error_type", "feature_block").limit(20).collect()
    if kinds:
        raise RuntimeError("; ".join(f"{r['count']} x {r['error_type']} in {r['feature_block']}" for r in kinds))
