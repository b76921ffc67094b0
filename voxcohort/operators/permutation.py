"""Permutation test of nearest centroids over folds, for any number of permutations in three passes over the rows.

A permutation deals the classes, as many of each as there are, to the rows in the order of a hash of (id, b, seed):
with the classes in order of their names, a row's class is told by the cuts of the order that its hash has reached.
So no row is sorted or joined for a permutation: a row's labels are an array, worked out where the row stands.

1. The cuts. A hash is uniform, so the one at a given place is known to a few deviations of a binomial. Hashes below that
   bracket are counted, those inside it (some 12 sqrt(n)) are sorted, and the one at the place is the cut, exactly.
   A bracket that misses its place is widened.
2. The sums of all rows of each (permutation, fold, class), by products of matrices.
3. The predictions against the permuted labels, counted by (permutation, fold, label, prediction).

Passes 2 and 3 give tables whose size goes by permutations, folds, classes and features alone; so does what is sent to
the tasks: cuts, and centroids of b x folds x classes x features numbers (8 MB for 1000, 5, 3 and 64).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxcohort.operators.evaluate import stratified_folds
from voxcohort.plans.storage import stored

#: Rows whose labels are worked out at once, as a share of this many numbers.
CELLS = 1 << 21
#: Half the width of a bracket, in deviations.
WIDTH = 6.0
TOP = 1 << 62


def _mixed(x: np.ndarray) -> np.ndarray:
    """32 bits to 32 bits, one to one."""
    for _ in range(2):
        x = ((x ^ (x >> np.uint64(16))) * np.uint64(73244475)) & np.uint64(0xFFFFFFFF)
    return x ^ (x >> np.uint64(16))


def salts(b: int, seed: int) -> np.ndarray:
    """Two salts of 32 bits for each of permutations 1 .. b, from md5(b|seed)."""
    digests = [hashlib.md5(f"{i}|{seed}".encode()).hexdigest() for i in range(1, b + 1)]
    return np.array([[int(d[:8], 16), int(d[8:16], 16)] for d in digests], np.uint64).reshape(b, 2)


def hashes(k1: np.ndarray, k2: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """62 bits for each row (by two halves of its key) and permutation."""
    u, v = k1.astype(np.uint64)[:, None], k2.astype(np.uint64)[:, None]
    return ((_mixed(u ^ salt[:, 0]) << np.uint64(30)) | (_mixed(v ^ salt[:, 1]) >> np.uint64(2))).astype(np.int64)


def keyed(df: DataFrame, id_col: str, class_col: str, features: Sequence[str]) -> tuple[DataFrame, list, list[int]]:
    """_k1, _k2, _class (place among the classes' names), _x (features) and fold of the rows used, the classes, their sizes."""
    sizes = {r[0]: r[1] for r in df.groupBy(class_col).agg(F.count(F.lit(1))).collect()}  # one row per class
    names = sorted(sizes)
    digest = F.md5(F.col(id_col).cast("string"))
    halves = (F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9))
    rows = df.select(*(h.alias(n) for h, n in zip(halves, ("_k1", "_k2"), strict=True)), (F.array_position(F.array(*map(F.lit, names)), F.col(class_col)) - 1).cast("int").alias("_class"), F.array(*(F.col(f).cast("double") for f in features)).alias("_x"), F.col("fold").cast("int").alias("_fold"))
    return rows, names, [sizes[n] for n in names]


def _blocks(batches: Iterator[pa.RecordBatch], b: int) -> Iterator[pa.RecordBatch]:
    step = max(1, CELLS // max(1, b))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def _keys(block: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return block.column("_k1").to_numpy(), block.column("_k2").to_numpy()


def cuts(rows: DataFrame, sizes: Sequence[int], b: int, seed: int, width: float = WIDTH) -> np.ndarray:
    """For each permutation and each class but the last the least hash that the class and those before it don't reach."""
    n, salt, places = sum(sizes), salts(b, seed), np.cumsum(sizes)[:-1].tolist()
    if not places or not b:
        return np.zeros((b, len(places)), np.int64)

    def bracket(place: int) -> tuple[int, int]:
        share = place / n
        off = (width * math.sqrt(n * share * (1 - share)) + width) / n
        return max(0, int((share - off) * TOP)), min(TOP, int((share + off) * TOP))

    ranges = [bracket(p) for p in places]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below = np.zeros((b, len(places)), np.int64)

        def out(which: np.ndarray, j: int, number: np.ndarray, kind: str) -> pa.RecordBatch:
            none = pa.nulls(len(which), pa.int64())
            columns = [pa.array(which + 1, pa.int32()), pa.array(np.full(len(which), j), pa.int32())]
            return pa.RecordBatch.from_arrays([*columns, *((pa.array(number), none) if kind == "below" else (none, pa.array(number)))], ["b", "cut", "below", "inside"])

        for block in _blocks(batches, b):
            h = hashes(*_keys(block), salt)
            for j, (lo, hi) in enumerate(ranges):
                below[:, j] += (h < lo).sum(axis=0)
                i, which = np.nonzero((h >= lo) & (h < hi))
                yield out(which, j, h[i, which], "inside")
        for j in range(len(places)):
            yield out(np.arange(b), j, below[:, j], "below")

    found = rows.select("_k1", "_k2").mapInArrow(run, "b int, cut int, below long, inside long")
    found = found.groupBy("b", "cut").agg(F.sum("below").alias("below"), F.array_sort(F.collect_list("inside")).alias("inside"))
    at = F.element_at(F.array(*map(F.lit, places)), F.col("cut") + 1) - F.col("below")
    ends = F.element_at(F.array(*(F.lit(hi) for _, hi in ranges)), F.col("cut") + 1)
    chosen = F.when((at >= 0) & (at < F.size("inside")), F.get("inside", at.cast("int"))).when(at == F.size("inside"), ends)
    answer = np.full((b, len(places)), -1, np.int64)
    for r in found.select("b", "cut", chosen.alias("value")).toLocalIterator():  # b x classes numbers
        if r["value"] is None:
            return cuts(rows, sizes, b, seed, 2 * width)
        answer[r["b"] - 1, r["cut"]] = r["value"]
    return answer


def _labels(block: pa.RecordBatch, salt: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The class of each row in permutation 0 (its own) .. b."""
    h = hashes(*_keys(block), salt)
    dealt = np.zeros(h.shape, np.int8)
    for j in range(at.shape[1]):
        dealt += h >= at[:, j]
    return np.concatenate([block.column("_class").to_numpy()[:, None].astype(np.int8), dealt], axis=1)


def _matrix(block: pa.RecordBatch, d: int) -> np.ndarray:
    return block.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _sums(rows: DataFrame, salt: np.ndarray, at: np.ndarray, k: int, c: int, d: int) -> np.ndarray:
    """[permutation, fold, class]: the number of rows, and the sum of each feature."""
    b = len(salt) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, c, b, d + 1))
        for block in _blocks(batches, b):
            labels, fold = _labels(block, salt, at), block.column("_fold").to_numpy()
            x = np.concatenate([np.ones((block.num_rows, 1)), _matrix(block, d)], axis=1)
            for f in np.unique(fold):
                own = fold == f
                for j in range(c):
                    total[f, j] += (labels[own] == j).astype(float).T @ x[own]
        for f, j in np.ndindex(k, c):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b, f), pa.int32()), pa.array(np.full(b, j), pa.int32()), pa.array(np.arange(b), pa.int32()), *(pa.array(total[f, j, :, i]) for i in range(d + 1))], ["f", "c", "b", *names])

    names = [f"s{i}" for i in range(d + 1)]
    parts = rows.mapInArrow(run, "f int, c int, b int, " + ", ".join(f"{n} double" for n in names))
    answer = np.zeros((b, k, c, d + 1))
    for r in parts.groupBy("f", "c", "b").agg(*(F.sum(n).alias(n) for n in names)).toLocalIterator():
        answer[r["b"], r["f"], r["c"]] = r[3:]
    return answer


def counted(rows: DataFrame, salt: np.ndarray, at: np.ndarray, k: int, c: int, d: int) -> DataFrame:
    """b, fold, label, guess (c if no class has rows in other folds), n: predictions by the nearest mean of the other folds' rows."""
    sums = _sums(rows, salt, at, k, c, d)
    left = sums.sum(axis=1, keepdims=True) - sums
    with np.errstate(invalid="ignore", divide="ignore"):
        centre = left[..., 1:] / left[..., :1]
        middle = sums[0].sum(axis=(0, 1))[1:] / max(1.0, sums[0, ..., 0].sum())
    there = left[..., 0] > 0.5
    centre = np.where(there[..., None], centre - middle, 0.0)
    far = np.where(there, (centre**2).sum(axis=-1), np.inf)
    spark, b = rows.sparkSession, len(salt) + 1
    sent = spark.sparkContext.broadcast((centre, far, middle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, far, middle = sent.value
        total = np.zeros((b, k, c, c + 1), np.int64)
        for block in _blocks(batches, b * c):
            labels, fold, x = _labels(block, salt, at), block.column("_fold").to_numpy(), _matrix(block, d) - middle
            for f in np.unique(fold):
                own = fold == f
                score = far[:, f].reshape(1, -1) - 2 * (x[own] @ centre[:, f].reshape(b * c, d).T)
                score = score.reshape(-1, b, c)
                guess = np.where(np.isfinite(score.min(axis=2)), score.argmin(axis=2), c)
                cell = (np.arange(b) * c + labels[own]) * (c + 1) + guess
                total[:, f] += np.bincount(cell.ravel(), minlength=b * c * (c + 1)).reshape(b, c, c + 1)
        place = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([*(pa.array(p, pa.int32()) for p in place), pa.array(total[place])], ["b", "fold", "label", "guess", "n"])

    parts = rows.mapInArrow(run, "b int, fold int, label int, guess int, n long")
    return parts.groupBy("b", "fold", "label", "guess").agg(F.sum("n").alias("n"))


def scores(df: DataFrame, id_col: str, class_col: str, features: Sequence[str], b: int = 1000, k: int = 5, seed: int = 42) -> DataFrame:
    """b (0: the labels as they are), score: macro F1 of nearest centroids, the mean over k folds.

    Rows without a class or with a null, NaN or infinite feature are left out. Folds are dealt by the true classes. Ids
    should differ: rows with the same id get the same labels. An empty table gives no rows.
    """
    usable = F.col(class_col).isNotNull()
    for f in features:
        x = F.col(f).cast("double")
        usable = usable & x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    used = df.filter(usable).select(id_col, class_col, *(f for f in features if f not in (id_col, class_col)))
    folds = stored(stratified_folds(used, id_col, class_col, k, seed), "permutation-folds")
    rows, names, sizes = keyed(folds, id_col, class_col, features)
    if not names:
        return df.sparkSession.createDataFrame([], "b int, score double")
    salt, at = salts(b, seed), cuts(rows, sizes, b, seed)
    cells = stored(counted(rows, salt, at, k, len(names), len(features)), "permutation-counts")
    support = cells.select("b", "fold", F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).alias("p"), F.when(F.col("label") == F.col("guess"), F.col("n")).otherwise(0).alias("hits"))
    guessed = cells.filter(F.col("guess") < len(names)).select("b", "fold", F.col("guess").alias("class"), F.lit(0).alias("support"), F.col("n").alias("p"), F.lit(0).alias("hits"))
    each = support.unionByName(guessed).groupBy("b", "fold", "class").agg(F.try_divide(2 * F.sum("hits"), F.sum("p") + F.sum("support")).alias("f1"))
    return each.groupBy("b", "fold").agg(F.avg("f1").alias("f")).groupBy("b").agg(F.avg("f").alias("score"))


def permutation_test(df: DataFrame, id_col: str, class_col: str, features: Sequence[str], b: int = 1000, k: int = 5, seed: int = 42) -> DataFrame:
    """One row: observed (score of the labels as they are), permutation_n, p_value, mean and deviation of the permuted scores."""
    own = F.max(F.when(F.col("b") == 0, F.col("score")))
    all_ = scores(df, id_col, class_col, features, b, k, seed).agg(own.alias("observed"), F.collect_list(F.when(F.col("b") > 0, F.col("score"))).alias("_s"))  # b numbers
    each = all_.select("observed", F.explode("_s").alias("_s"))
    n = F.count("_s")
    return each.agg(F.first("observed").alias("observed"), n.alias("permutation_n"), ((F.count_if(F.col("_s") >= F.col("observed")) + 1) / (n + 1)).alias("p_value"), F.avg("_s").alias("perm_mean"), F.stddev_pop("_s").alias("perm_std"))
