"""Near duplicates by SimHash and a segment-popcount embedding.

A text's fingerprint has a bit set where more than half of its word shingles' hashes have it. Two texts are
linked if their fingerprints differ in at most three bits. The search maps a fingerprint to the bit counts
of its segments: the Manhattan distance of two such vectors never exceeds the Hamming distance, and with
the 32 segments of two bits laid in four zones, a Manhattan distance of at most three leaves one zone with
distance zero. So every link lies inside a grid cell, a cell being the eight bit counts of one zone (3^8
cells a zone, 26,244 in all, whatever the data). Inside a cell the Manhattan distance over the whole vector
is taken first, and pairs within the bound are verified by their exact Hamming distance.

The search runs on distinct fingerprints. A large cell is cut into blocks, and pairs of blocks are separate
tasks' work, so no cell is held whole; a block pair returns a spanning forest of its links, never the pairs.

Nulls: a null or blank text has fingerprint zero, linked like any other. A null id never is a component's
id unless all ids of it are null. Repeated rows have one fingerprint. An empty table gives an empty result.
Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxcohort.llm.grouped import groups
from voxcohort.plans.graph import connected_components
from voxcohort.plans.storage import attach, small_or_not, stored

SHINGLE = 3
SEED = 42
BITS = 3
#: Fingerprints of a cell that one block holds.
BLOCK = 2048
#: Shingle hashes whose bits are spread out at once.
HASHES = 65536
ZONES, SEGMENTS = 4, 8


def hashes(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The hashes of a text's shingles in order, repeats included; lower case for A-Z, words split at ASCII white space."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    return np.concatenate([np.array([digest(joined[i:j], seed) for i, j in zip(starts[at : at + HASHES], ends[at : at + HASHES], strict=True)], np.uint64) for at in range(0, n, HASHES)])


def majority(found: np.ndarray) -> int:
    """The bits that over half of the hashes have, unsigned; zero without hashes."""
    set_in = np.zeros(64, np.int64)
    for at in range(0, len(found), HASHES):
        set_in += np.add.reduce(np.unpackbits(found[at : at + HASHES].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.uint32)
    return int(np.packbits(2 * set_in > len(found), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of a text in UTF-8, unsigned."""
    return majority(hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp (as a signed long) of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle, seed) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, fp long")


def _cells() -> list:
    """For each zone, the number of the grid cell that a fingerprint lies in."""
    out = []
    for z in range(ZONES):
        code = F.lit(z * 3**SEGMENTS)
        for s in range(SEGMENTS):
            code = code + F.bit_count(F.shiftrightunsigned("fp", 16 * z + 2 * s).bitwiseAND(F.lit(3))) * 3**s
        out.append(code.cast("int"))
    return out


def _forest(a: np.ndarray, b: np.ndarray | None, bits: int, own: bool = False) -> np.ndarray:
    """Links within a, or between a and b, reduced to trees: rows of two fingerprints. own: the trees consist of links themselves."""
    f = a if b is None else np.concatenate((a, b))
    rest = f if b is None else b
    shift = 0 if b is None else len(a)
    label, kept = np.arange(len(f)), [np.zeros((0, 2), np.uint64)]
    counts = np.bitwise_count(f.view(np.uint8)).reshape(-1, 8).view(np.int8)
    for at in range(0, len(a), 512):
        mine = counts[at : at + 512]
        apart = np.zeros((len(mine), len(rest)), np.int8)
        for s in range(8):
            apart += np.abs(mine[:, s, None] - counts[None, shift:, s])
        i, j = np.nonzero(apart <= bits)
        i, j = i + at, j + shift
        if b is None:
            i, j = i[i < j], j[i < j]
        near = np.bitwise_count(f[i] ^ f[j]) <= bits
        i, j = i[near], j[near]
        open_ = label[i] != label[j]
        i, j = i[open_], j[open_]
        while len(i):
            high, low = np.maximum(label[i], label[j]), np.minimum(label[i], label[j])
            if own:  # one link for each tree that is hung below another
                root, at_link = np.unique(high, return_index=True)
                label[root] = low[at_link]
                kept.append(np.stack((f[i[at_link]], f[j[at_link]]), axis=1))
            else:
                np.minimum.at(label, high, low)
            while (label[label] != label).any():
                label = label[label]
            open_ = label[i] != label[j]
            i, j = i[open_], j[open_]
    if own:
        return np.concatenate(kept)
    order = np.argsort(label, kind="stable")
    sizes = np.unique(label, return_counts=True)[1]
    place = np.arange(len(f)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    child = np.flatnonzero(place > 0)
    parent = child - place[child] + (place[child] - 1) // 8  # trees of eight branches: no node of high degree
    return np.stack((f[order[child]], f[order[parent]]), axis=1)


def links(fps: DataFrame, bits: int = BITS, block: int = BLOCK, own: bool = False) -> DataFrame:
    """a, b: pairs that connect the distinct fingerprints fp exactly as all links within the bound do; own: each is such a link itself."""
    if not 0 <= bits < ZONES:
        raise ValueError(f"with {ZONES} zones at most {ZONES - 1} bits can differ")
    at = fps.select("fp", F.explode(F.array(*_cells())).alias("cell"))
    sizes = at.groupBy("cell").agg(F.count(F.lit(1)).alias("_n"))  # 4 * 3^8 rows at most
    at = at.join(F.broadcast(sizes), "cell").filter("_n > 1").withColumn("_blocks", F.ceil(F.col("_n") / block).cast("int"))
    at = at.withColumn("_block", F.pmod(F.xxhash64("fp"), F.col("_blocks")).cast("int"))
    at = at.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    at = at.select("cell", F.least("_block", "_other").alias("lo"), F.greatest("_block", "_other").alias("hi"), F.col("_block").alias("block"), "fp")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = [], 0
        for (_, lo, hi), (part, fp) in groups(batches, ("cell", "lo", "hi"), ("block", "fp")):
            f = fp.view(np.uint64)
            found = _forest(f, None, bits, own) if lo == hi else _forest(f[part == lo], f[part == hi], bits, own)
            out.append(found)
            n += len(found)
            if n > 100_000:
                yield _pairs(out)
                out, n = [], 0
        if n:
            yield _pairs(out)

    return at.repartition("cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi", "block", "fp").mapInArrow(solve, "a long, b long").distinct()


def _pairs(found: list[np.ndarray]) -> pa.RecordBatch:
    x = np.concatenate(found).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[:, 0])), pa.array(np.ascontiguousarray(x[:, 1]))], ["a", "b"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest id reachable by links) of every row."""
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    rows = stored(fingerprints(docs, id_col, text_col, shingle, seed).withColumn("fingerprint", hexed), "simhash")
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "simhash-classes")
    found = stored(connected_components(stored(links(classes, bits), "simhash-links")), "simhash-components")
    joined = classes.join(small_or_not(found.withColumnRenamed("node", "fp")), "fp")
    least = joined.groupBy("component").agg(F.min("first_id").alias("component_id"))
    linked = joined.join(small_or_not(least), "component").select(F.col("fp").alias("_fp"), "component_id")
    classes = classes.join(small_or_not(stored(linked, "simhash-linked")), F.col("fp") == F.col("_fp"), "left")
    classes = classes.select(hexed.alias("fingerprint"), F.coalesce("component_id", "first_id").alias("component_id"), "n")
    return attach(rows.select("doc_id", "fingerprint"), classes, "fingerprint", "n", rows.count()).select("doc_id", "fingerprint", "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """The rows of docs whose id is their component's; docs' columns. Components without any id stay whole."""
    found = near_duplicates(docs, id_col, text_col, **parameters)
    gone = stored(found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_llm_id")).distinct(), "simhash-gone")
    return docs.join(small_or_not(gone), F.col(id_col).eqNullSafe(F.col("_llm_id")), "left_anti")
