"""Exact top-k search by inner product: a Voronoi kNN join.

Vectors belong to the cell of their nearest pivot. Per cell, a summary holds the number of vectors, their
largest distance from the pivot and the range of their norms. Since 2<q,x> = |q|^2 + |x|^2 - |q-x|^2 and
the triangle inequality bounds |q-x| by the distance of q from the pivot and the cell's radius, a summary
bounds the scores in a cell from above and below. The lower bounds give each query a score that k vectors
are sure to reach; the query goes only to cells whose upper bound reaches it. Cells are solved locally and
the best k of the local lists are the result, with ties to the smaller id.

Queries are grouped by their own cell (small cells with those near them), so a group's queries need much the same cells, and a vector is sent only to the
groups of which a query needs its cell. Large cells (many equal vectors, say) are cut into blocks, each solved by
itself, and so are the queries of a cell: a task holds one block of each. Pivots are PIVOTS at most and so are the summaries, which go to the
driver; nothing else does.

Components become floor(scale * x), as doubles; beyond 63 bits they and the scores stop at the largest long.
Vectors that are null or hold a null, NaN or infinity, and rows without an id, take no part. Shorter vectors
count as padded with zeros. A row is not its own candidate; other rows with its id are. Each row of a repeated
query id is a query. With fewer than k candidates all are returned; an empty table gives an empty result.
Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxcohort.llm.grouped import groups
from voxcohort.plans.storage import small_or_not, stored

K = 20
SCALE = 64
EVERY = 20
PIVOTS = 64
#: Vectors, and queries, that one block holds; scores computed at once.
BLOCK, SCORES = 32_768, 1 << 21


def scaled(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE, keep: tuple[str, ...] = ()) -> DataFrame:
    """vec_id, v (array of doubles with whole values) of the vectors that take part, and the columns named in keep."""
    x = F.col(vec_col).cast("array<double>")
    ok = x.isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf"))))
    return vectors.filter(ok & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * scale).cast("double")).alias("v"), *keep)


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """Rows padded with zeros to dims."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy()
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * x @ p.T, 0))


def in_cells(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """row, vec_id, asks, v, cell, far (distance from the pivot), norm (squared)."""
    dims = pivots.shape[1]
    same = ("row", "vec_id", "asks", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("v"), dims)
            d = _distances(x, pivots)
            cell = d.argmin(1) if len(x) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in same), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(x)), cell]), pa.array((x * x).sum(1))], [*same, "cell", "far", "norm"])

    return vectors.mapInArrow(run, "row long, vec_id long, asks boolean, v array<double>, cell int, far double, norm double")


def needed(x: np.ndarray, pivots: np.ndarray, summary: np.ndarray, k: int) -> np.ndarray:
    """For each query and row of summary (cell, n, radius, least norm, largest norm): can the cell hold one of its k best?

    The query itself may be among the n, so k + 1 vectors are counted. A margin covers rounding.
    """
    cell, n, radius, low, high = summary.T
    d = _distances(x, pivots[cell.astype(int)])
    own = (x * x).sum(1)[:, None]
    most = (own + high[None] - np.maximum(d - radius[None], 0) ** 2) / 2
    least = (own + low[None] - (d + radius[None]) ** 2) / 2
    order = np.argsort(-least, axis=1)
    held = np.cumsum(n[order], axis=1)
    at = np.minimum((held < k + 1).sum(1), len(cell) - 1)
    sure = np.take_along_axis(least, order, 1)[np.arange(len(x)), at]
    sure = np.where(held[:, -1] < k + 1, -np.inf, sure)
    return most >= (sure - 1e-6 * (1 + np.abs(sure)))[:, None]


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products, exactly: in floats where they hold all whole numbers met, else in Python's."""
    most = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * x.shape[1] * 2
    if most < 2**24:
        return np.rint(q.astype(np.float32) @ x.astype(np.float32).T).astype(np.int64)
    if most < 2**53:
        return np.rint(q @ x.T).astype(np.int64)
    whole = lambda m: np.array([[int(e) for e in r] for r in m], object).reshape(m.shape)
    exact = whole(q) @ whole(x).T
    return np.clip(exact, -(2**63) + 1, 2**63 - 1).astype(np.int64)


def local_best(qrow: np.ndarray, q: np.ndarray, xrow: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries, places of vectors, scores of the k best of x for each query; x in the order of its ids."""
    out: list[tuple] = []
    step = max(1, SCORES // len(x))
    for at in range(0, len(q), step):
        score = _scores(q[at : at + step], x)
        own = qrow[at : at + step, None] == xrow[None]
        if len(x) > k + 1:
            # The k + 1 best by score, and of those that tie with the last of them the ones with the smallest ids.
            least = -np.partition(-score, k, axis=1)[:, k]
            rows, cols = np.nonzero(score >= least[:, None])
        else:
            rows, cols = np.nonzero(np.ones(score.shape, bool))
        use = ~own[rows, cols]
        rows, cols = rows[use], cols[use]
        order = np.lexsort((cols, -score[rows, cols], rows))
        rows, cols = rows[order], cols[order]
        n = np.bincount(rows, minlength=len(score))
        top = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n) < k
        rows, cols = rows[top], cols[top]
        out.append((rows + at, cols, score[rows, cols]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))  # type: ignore[return-value]


def query_blocks(pivots: np.ndarray, queries: dict[int, int], block: int) -> tuple[dict[int, int], dict[int, int], int]:
    """Per cell its first block of queries and its number of blocks, and the number of all blocks.

    A cell of more queries than block has blocks of its own; smaller ones share a block with cells near them, so there are no more
    blocks, and no more copies of vectors, than the queries fill.
    """
    order, rest = [], set(range(len(pivots)))
    while rest:
        near = min(rest, key=lambda c: (float(((pivots[c] - pivots[order[-1]]) ** 2).sum()) if order else 0.0, c))
        order.append(near)
        rest.remove(near)
    begin, many, at, held = {}, {}, 0, 0
    for c in order:
        q = queries.get(c, 0)
        if held and held + q > block:
            at, held = at + 1, 0
        begin[c], many[c] = at, max(1, -(-q // block))
        if q > block:
            at, held = at + many[c], 0
        else:
            held += q
    return begin, many, at + 1


def routed(vectors: DataFrame, asks: Column, k: int, id_col: str, vec_col: str, scale: int, pivots: int, block: int) -> tuple[DataFrame, DataFrame, int] | None:
    """Queries and vectors where they meet: cell, part, asking, side (0, 1), row, vec_id, v of each, and the number of components.

    Queries stand in blocks of their own cell, or of cells near each other. A vector goes to the blocks of which a query needs its cell, and to no other.
    """
    data = scaled(vectors.withColumn("asks", F.coalesce(asks, F.lit(False))), id_col, vec_col, scale, ("asks",))
    # The vectors with the smallest hashes of ids, then distinct ones: as many whatever the size of the table.
    first = data.select(F.xxhash64("vec_id").alias("_h"), "v").orderBy("_h", "v").limit(4 * pivots).collect()
    sample = list(dict.fromkeys(tuple(r["v"]) for r in first))[:pivots]
    if not sample:
        return None
    dims = max(data.agg(F.max(F.size("v"))).first()[0], 1)
    p = np.zeros((len(sample), dims))
    for i, r in enumerate(sample):
        p[i, : len(r)] = r
    placed = stored(in_cells(data.withColumn("row", F.monotonically_increasing_id()), p), "voronoi")
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far"), F.min("norm"), F.max("norm"), F.count_if("asks").alias("q")).orderBy("cell").collect()
    summary = np.array([tuple(r)[:5] for r in cells], float)
    blocks = {r["cell"]: -(-r["n"] // block) for r in cells}
    begin, asking, total = query_blocks(p, {r["cell"]: r["q"] for r in cells}, block)

    def of_cell(values: dict[int, int]) -> Column:
        return F.element_at(F.array(*(F.lit(values.get(c, 1)) for c in range(len(p)))), F.col("cell") + 1)

    own = (of_cell(begin) + F.pmod(F.xxhash64("row"), of_cell(asking))).cast("int").alias("asking")
    queries = placed.filter("asks").select(own, F.lit(0).alias("side"), "row", "vec_id", "v")

    def needs(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return np.nonzero(needed(_matrix(b.column("v"), dims), p, summary, k)) if b.num_rows else (np.zeros(0, int), np.zeros(0, int))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros((total, len(summary)), bool)
        for b in batches:
            q, s = needs(b)
            met[b.column("asking").to_numpy()[q], s] = True
        a, s = np.nonzero(met)
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(summary[s, 0].astype(np.int32))], ["asking", "cell"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = np.array([blocks[int(c)] for c in summary[:, 0]])
        for b in batches:
            q, s = needs(b)
            times = parts[s]
            q, s = np.repeat(q, times), np.repeat(s, times)
            part = np.arange(len(q)) - np.repeat(np.cumsum(times) - times, times)
            take = pa.array(q)
            yield pa.RecordBatch.from_arrays([pa.array(summary[s, 0].astype(np.int32)), pa.array(part.astype(np.int32)), *(b.column(c).take(take) for c in ("asking", "side", "row", "vec_id", "v"))], ["cell", "part", "asking", "side", "row", "vec_id", "v"])

    # Blocks of queries times cells at most.
    wanted = stored(queries.mapInArrow(named, "asking int, cell int").distinct(), "voronoi-needs")
    sent = queries.mapInArrow(route, "cell int, part int, asking int, side int, row long, vec_id long, v array<double>")
    kept = placed.select("cell", F.pmod(F.xxhash64("row"), of_cell(blocks)).cast("int").alias("part"), F.lit(1).alias("side"), "row", "vec_id", "v")
    return sent, kept.join(small_or_not(wanted), "cell").select(*sent.columns), dims


def top_k(vectors: DataFrame, asks: Column, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest inner products of each row for which asks holds with all others."""
    spark = vectors.sparkSession
    found = routed(vectors, asks, k, id_col, vec_col, scale, pivots, block)
    if found is None:
        return spark.range(0).select(F.col("id").alias("query_id"), F.col("id").cast("int").alias("rank"), F.col("id").alias("vec_id"), F.col("id").alias("score"))
    sent, kept, dims = found

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (side, row, ids, v) in groups(batches, ("cell", "part", "asking"), ("side", "row", "vec_id", "v")):
            m = int(np.searchsorted(side, 1))
            if 0 < m < len(side):
                x = _matrix(v, dims)
                q, j, score = local_best(row[:m], x[:m], row[m:], x[m:], k)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (row[q], ids[q], ids[m:][j], row[m:][j], score)], ["asker", "query_id", "vec_id", "row", "score"])

    met = sent.unionByName(kept).repartition("cell", "part", "asking").sortWithinPartitions("cell", "part", "asking", "side", "vec_id", "row").mapInArrow(solve, "asker long, query_id long, vec_id long, row long, score long")
    best = Window.partitionBy("asker").orderBy(F.col("score").desc(), "vec_id", "row")
    return met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
