"""Near copies by the Jaccard similarity of word shingles, for whole rows.

Two texts are linked if the sets of their shingles (five words, A-Z lower-cased, split at ASCII white space)
have a Jaccard similarity of at least 0.8. Every candidate pair is decided by its exact similarity, so nothing
below the bound is linked. Candidates come in three steps:

1. The popcount grid of simhash.py, on fingerprints of these shingles: its links (three differing bits at most), reduced to
   trees of links, and texts of equal fingerprints. Stars make components of those that are similar.
2. A SimHash of 64 bits differs in about 10 bits at 0.8, and a grid for those has cells of a large share of all texts. So texts
   that share one of 24 bands of five minhashes each are candidates, too (120 minhashes of two bytes): a pair at 0.8 shares
   one with probability 0.9999, a pair at 0.9 with 1 - 1e-9. Buckets of a band whose texts the grid has put into one
   component are closed. In the others each text is held against the one that shares bands with most texts. In a group of
   copies that is the text they were made from, if it is there, and most are linked to it by that, however large the group is.
3. Where a band's bucket still holds texts of several components, their minhashes are compared across components:
   a bucket is cut into blocks, pairs of blocks are separate tasks' work. These texts get 512 minhashes more; pairs that agree in
   0.74 of all or more (nearly four deviations below 0.8) are candidates, once for all bands.

Texts are sent to the pairs that are decided, once for each step and side; nothing else of them is. Batches are
limited in bytes, so a very long text takes the room of its own words only.

Rows are told apart by a key written with them, so a row goes only for its own text. Of a component's rows the
one with the smallest id stays; a null id comes last, of equal ids any one stays. Null and blank texts are equal
to each other. An empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxcohort.llm import simhash
from voxcohort.llm.grouped import HELD, ROW, groups, slices, with_row_key
from voxcohort.plans.graph import connected_components
from voxcohort.plans.storage import attach, small_or_not, stored

SHINGLE = 5
SIMILAR = 0.8
SEED = 42
BANDS, ROWS = 24, 5
#: Further minhashes of texts whose buckets are still open, one byte each.
FINE = 512
#: Shares of equal minhashes, of the first and of all, from which a pair's similarity is worked out.
MAYBE, LIKELY = 0.62, 0.74
#: Texts of a bucket that one block holds.
BLOCK = 2048
#: Shingles whose minhashes are taken at once.
HASHES = 8192


def _distinct(found: np.ndarray, seed: int) -> np.ndarray:
    return np.unique(found) if len(found) else np.array([xxhash.xxh64_intdigest(b"", seed)], np.uint64)


def shingles(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The distinct hashes of a text's shingles in order; a shorter text is one shingle, also a blank one."""
    return _distinct(simhash.hashes(text, shingle, seed), seed)


def _mixers(seed: int, n: int = BANDS * ROWS) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(0, 2**64, n, np.uint64), r.integers(0, 2**64, n, np.uint64) | np.uint64(1)


def minhashes(found: np.ndarray, mixers: tuple[np.ndarray, np.ndarray], kind: type = np.uint16) -> np.ndarray:
    """The last bytes of the least of the mixed hashes, for each mixer."""
    flip, factor = mixers
    least = np.full(len(flip), 2**64 - 1, np.uint64)
    step = max(1, HASHES * BANDS * ROWS // len(flip))
    for at in range(0, len(found), step):
        x = (found[at : at + step, None] ^ flip) * factor
        least = np.minimum(least, ((x >> np.uint64(32)) ^ x).min(axis=0))
    return least.astype(kind)


def signatures(rows: DataFrame, shingle: int, seed: int) -> DataFrame:
    """_row, fp (the fingerprint as a signed long), sig (the first minhashes) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixers = _mixers(seed)
        for batch in batches:
            for b in slices(batch, "text"):
                fp, sig = [], []
                for t in b.column("text"):
                    found = simhash.hashes(t.as_py(), shingle, seed)
                    fp.append(simhash.majority(found))
                    sig.append(minhashes(_distinct(found, seed), mixers).tobytes())
                yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(sig, pa.binary())], ["_row", "fp", "sig"])

    return rows.mapInArrow(run, "_row long, fp long, sig binary")


def further(rows: DataFrame, shingle: int, seed: int) -> DataFrame:
    """_row, fine (the further minhashes) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixers = _mixers(seed + 1, FINE)
        for batch in batches:
            for b in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array([minhashes(shingles(t.as_py(), shingle, seed), mixers, np.uint8).tobytes() for t in b.column("text")], pa.binary())], ["_row", "fine"])

    return rows.mapInArrow(run, "_row long, fine binary")


def on_grid(sigs: DataFrame) -> DataFrame:
    """a > b: pairs of rows whose fingerprints the popcount grid links, reduced to trees, and each row with the first of equal fingerprint."""
    fps = sigs.select("_row", "fp")
    classes = stored(fps.groupBy("fp").agg(F.min("_row").alias("first"), F.count(F.lit(1)).alias("n")), "near-classes")
    found = stored(simhash.links(classes, own=True), "near-grid")
    ends = [classes.select(F.col("fp").alias(c), F.col("first").alias(f"_{c}")) for c in ("a", "b")]
    across = found.join(ends[0], "a").join(ends[1], "b").select(F.greatest("_a", "_b").alias("a"), F.least("_a", "_b").alias("b")).distinct()
    several = classes.filter("n > 1").select(F.hex("fp").alias("fingerprint"), "first", "n")
    equal = attach(fps.select("_row", F.hex("fp").alias("fingerprint")), several, "fingerprint", "n", fps.count())
    return across.unionByName(equal.filter("first < _row").select(F.col("_row").alias("a"), F.col("first").alias("b")))


def band_keys() -> Column:
    """The bucket of each band of sig."""
    width = 2 * ROWS
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(F.substring("sig", k * width + 1, F.lit(width)), k))


def buckets(sigs: DataFrame) -> DataFrame:
    """_row, key, n: the buckets that hold several texts, of those that hold the same the one of the least key, and their sizes."""
    at = sigs.select("_row", F.explode(band_keys()).alias("key"))
    mark = (F.bit_xor(F.xxhash64("_row")).alias("_m0"), F.bit_xor(F.xxhash64(F.lit(1), "_row")).alias("_m1"))
    several = at.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *mark).filter("n > 1")
    several = stored(several.groupBy("n", "_m0", "_m1").agg(F.min("key").alias("key")).select("key", "n"), "near-several")
    return at.join(small_or_not(several), "key").select("_row", "key", "n")


def still_open(at: DataFrame, parts: DataFrame) -> DataFrame:
    """_row, key, n, component (by parts: node, component; else the row itself): the buckets that hold several components."""
    at = at.join(small_or_not(parts.withColumnRenamed("node", "_node")), F.col("_row") == F.col("_node"), "left")
    at = at.select("_row", "key", "n", F.coalesce("component", "_row").alias("component"))
    mixed = at.groupBy("key").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).filter("_lo < _hi").select("key")
    return stored(at.join(small_or_not(stored(mixed, "near-mixed")), "key"), "near-open")


def pivots(at: DataFrame) -> DataFrame:
    """a, b: for each row (a) of buckets the row that meets most others, among the best of its buckets; each pair of different components once."""
    weight = stored(at.groupBy(F.col("_row").alias("_met")).agg(F.sum("n").alias("_weight")), "near-weights")
    at = at.join(small_or_not(weight), F.col("_row") == F.col("_met"))
    order = F.struct("_weight", (-F.col("_row")).alias("_back"), F.col("component").alias("_part"))
    best = stored(at.groupBy(F.col("key").alias("_key")).agg(F.max(order).alias("_best")), "near-pivots")
    chosen = at.join(small_or_not(best), F.col("key") == F.col("_key")).filter(F.col("_best._back") != -F.col("_row"))
    chosen = chosen.groupBy("_row", "component").agg(F.max("_best").alias("_best")).filter(F.col("_best._part") != F.col("component")).select("_row", (-F.col("_best._back")).alias("_pivot"))
    return chosen.select(F.greatest("_row", "_pivot").alias("a"), F.least("_row", "_pivot").alias("b")).distinct()


def verified(pairs: DataFrame, rows: DataFrame, shingle: int, similar: float, seed: int) -> DataFrame:
    """a, b: the distinct pairs (a, b) of rows whose texts are similar."""
    some = stored(pairs.select(F.explode(F.array("a", "b")).alias("_some")).distinct(), "near-some")
    texts = rows.join(small_or_not(some), F.col("_row") == F.col("_some"), "left_semi")
    both = pairs.join(texts.select(F.col("_row").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("_row").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = None, None  # neighbouring pairs often share b
        for batch in batches:
            keep = []
            for b, ta, tb in zip(batch.column("b").to_pylist(), batch.column("ta"), batch.column("tb"), strict=True):
                if b != held:
                    held, own = b, shingles(tb.as_py(), shingle, seed)
                other = shingles(ta.as_py(), shingle, seed)
                common = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(common >= similar * (len(own) + len(other) - common) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def likely(at: DataFrame, sigs: DataFrame, rows: DataFrame, shingle: int, seed: int, block: int = BLOCK) -> DataFrame:
    """a > b: distinct pairs of different components (_row, key, n, component) that meet in a bucket and agree in enough minhashes."""
    some = stored(at.select(F.col("_row").alias("_some")).distinct(), "near-open-rows")
    texts = rows.join(small_or_not(some), F.col("_row") == F.col("_some"), "left_semi")
    sigs = sigs.withColumn("keys", band_keys()).join(stored(further(texts, shingle, seed), "near-fine"), "_row")
    at = at.withColumn("_blocks", F.ceil(F.col("n") / block).cast("int"))
    at = at.withColumn("block", F.pmod(F.xxhash64("_row", "key"), F.col("_blocks")).cast("int"))
    at = at.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    at = at.select("key", F.least("block", "_other").alias("lo"), F.greatest("block", "_other").alias("hi"), "block", "_row", "component").join(sigs, "_row")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, lo, hi), (own, row, component, sig, fine, keys) in groups(batches, ("key", "lo", "hi"), ("block", "_row", "component", "sig", "fine", "keys")):
            all_keys = np.concatenate([k.values.to_numpy() for k in keys]).reshape(len(row), -1)
            s = np.frombuffer(b"".join(x.as_py() for x in sig), np.uint16).reshape(len(row), -1)
            f = np.frombuffer(b"".join(x.as_py() for x in fine), np.uint8).reshape(len(row), -1)
            for i in range(len(row) - 1):
                j = np.flatnonzero((component[i + 1 :] != component[i]) & ((own[i + 1 :] != own[i]) | (lo == hi))) + i + 1
                equal = (s[j] == s[i]).sum(axis=1)
                j, equal = j[equal >= MAYBE * s.shape[1]], equal[equal >= MAYBE * s.shape[1]]
                j = j[equal + (f[j] == f[i]).sum(axis=1) >= LIKELY * (s.shape[1] + f.shape[1])]
                # A pair may meet in many buckets; it is named in that of the least key, which buckets() keeps.
                j = j[np.where(all_keys[j] == all_keys[i], all_keys[j], np.iinfo(np.int64).max).min(axis=1) == key]
                if len(j):
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(row[j], row[i])), pa.array(np.minimum(row[j], row[i]))], ["a", "b"])

    at = at.select("key", "lo", "hi", "block", "_row", "component", "sig", "fine", "keys").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "block", "_row")
    return at.mapInArrow(solve, "a long, b long").distinct()


def links(rows: DataFrame, shingle: int = SHINGLE, similar: float = SIMILAR, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """a, b: links that connect rows (_row, text) as all links among candidates do."""
    sigs = stored(signatures(rows, shingle, seed), "near-signatures")
    found = stored(verified(stored(on_grid(sigs), "near-on-grid"), rows, shingle, similar, seed), "near-by-grid")
    at = still_open(stored(buckets(sigs), "near-buckets"), stored(connected_components(found), "near-parts"))
    star = stored(verified(stored(pivots(at), "near-first"), rows, shingle, similar, seed), "near-star")
    found = found.unionByName(star)
    at = still_open(at.select("_row", "key", "n"), stored(connected_components(found), "near-parts"))
    rest = stored(likely(at, sigs, rows, shingle, seed, block), "near-likely")
    return found.unionByName(verified(rest, rows, shingle, similar, seed))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similar: float = SIMILAR, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """One row of docs for each component of near copies, with docs' columns."""
    keyed = with_row_key(docs)
    rows = keyed.select(F.col(ROW).alias("_row"), F.col(f"{HELD}.`{text_col}`").cast("binary").alias("text"))
    found = stored(connected_components(stored(links(rows, shingle, similar, seed, block), "near-links")), "near-components")
    ids = keyed.select(F.col(ROW).alias("node"), F.col(f"{HELD}.`{id_col}`").alias("_id"))
    found = stored(ids.join(small_or_not(found), "node"), "near-linked")
    order = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("node").alias("row"))
    stay = found.groupBy("component").agg(F.min(order).alias("o")).select(F.col("o.row").alias("node"))
    gone = stored(found.join(stay, "node", "left_anti").select(F.col("node").alias("_llm_gone")), "near-gone")
    return keyed.join(small_or_not(gone), F.col(ROW) == F.col("_llm_gone"), "left_anti").select(f"{HELD}.*")
