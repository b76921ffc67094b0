"""Groups of a partition that is sorted by key, streamed from Arrow batches; keys for rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxcohort.plans.storage import small_or_not, stored

#: Names in with_row_key's table: the key, and a table's own columns in one, whatever they are called.
ROW, HELD = "row", "held"


def _is_scan(docs: DataFrame) -> bool:
    """Whether docs are the rows of files as they are, each once."""
    return docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation" and "_metadata" not in docs.columns


def with_row_key(docs: DataFrame) -> DataFrame:
    """row, held: a key for each row, and all its columns as a struct, so that no name can clash.

    Rows of files are told apart by their file and place in it, which any later reading gives again, so no copy is written; other
    rows get a number and are written with it.
    """
    held = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(HELD)
    if not _is_scan(docs):
        return stored(docs.select(F.monotonically_increasing_id().alias(ROW), held), "row-keys")
    placed = docs.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place"), held)
    files = docs.select(F.col("_metadata.file_path").alias("_path")).distinct()
    files = stored(files.select("_path", (F.row_number().over(Window.orderBy("_path")) - 1).alias("_number")), "row-files")  # a row per file
    return placed.join(small_or_not(files), F.col("_file") == F.col("_path")).select((F.shiftleft(F.col("_number").cast("long"), 40) + F.col("_place")).alias(ROW), HELD)


def groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], columns: tuple[str, ...]) -> Iterator[tuple[tuple, list]]:
    """(key values, [values of each column]) per group; only the group at hand is held.

    Key columns become integer arrays; other columns numpy arrays where they are numeric without nulls, else Arrow arrays.
    """
    held: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        if not held.num_rows:
            continue
        k = [held[c].to_numpy() for c in keys]
        change = np.zeros(held.num_rows - 1, bool)
        for x in k:
            change |= x[1:] != x[:-1]
        cuts = np.concatenate(([0], np.flatnonzero(change) + 1))
        if len(cuts) > 1:
            yield from _cut(held, k, cuts, columns)
            held = held.slice(int(cuts[-1])).combine_chunks()
    if held is not None and held.num_rows:
        k = [held[c].to_numpy() for c in keys]
        yield from _cut(held, k, np.array([0, held.num_rows]), columns)


def _cut(t: pa.Table, k: list[np.ndarray], cuts: np.ndarray, columns: tuple[str, ...]) -> Iterator[tuple[tuple, list]]:
    cols = [t[c].to_numpy() if pa.types.is_primitive(t.schema.field(c).type) and not t[c].null_count else t[c].combine_chunks() for c in columns]
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield tuple(x[i] for x in k), [c[i:j] for c in cols]


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose values of a string or binary column have about so many bytes; a longer value stands alone."""
    ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one after another."""
    sizes = sizes.astype(np.int64)
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
