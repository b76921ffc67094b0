"""Sharding by fixed virtual slots.

Records hash into a fixed number of slots; bytes are summed per slot; a versioned map says which shard
holds which slot. Only the map changes when shards are added or loads drift, so a record moves only if
its slot does. The map has one row per slot (4,096 by default, whatever the data), which bounds what the
driver sees; the rows themselves never leave the executors.

The map of version 0 deals the slots out in turn, before any record is known. shard() reads the latest version
from the shared folder, edits it for the loads it has summed, stores the next version and places the records
by that.

Nulls: a null text has 8 bytes and the checksum of the empty text; a null id is hashed like any value.
Repeated rows get a position each and share a slot, unless there are more of them than of an even slot: those
are spread over all slots. An empty table gives an empty result and leaves the map as it is. Columns of the input other than id and text play no part.
"""

from __future__ import annotations

import heapq
import uuid
from bisect import bisect_left
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxcohort.plans.storage import shared_dir, stored

SLOTS = 4096
#: Bytes of a record besides its text.
RECORD_BYTES = 8


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot of each row; the text itself is left behind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(RECORD_BYTES)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = stored(out.withColumn("_hash", F.xxhash64("doc_id", "text_crc32")).withColumn("_row", F.monotonically_increasing_id()), "shard-records")
    line = max(1, out.count() // slots)
    often = out.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max(line, 64)).select(F.col("_hash").alias("_often"))  # fewer than there are slots
    out = out.join(F.broadcast(often), F.col("_hash") == F.col("_often"), "left")
    slot = F.pmod(F.when(F.col("_often").isNull(), F.col("_hash")).otherwise(F.xxhash64("_row")), F.lit(slots)).cast("int")
    return out.select("doc_id", "size", "text_crc32", slot.alias("virtual_slot"))


def slot_loads(recs: DataFrame) -> DataFrame:
    """virtual_slot, bytes, n: combined on the map side, one row per slot."""
    return recs.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))


def new_map(loads: Mapping[int, int], shards: int, slots: int = SLOTS) -> list[int]:
    """Shard of each slot: largest slot first, to the shard with the fewest bytes (then the lowest number)."""
    heap = [(0, s) for s in range(shards)]
    out = [0] * slots
    for slot in sorted(range(slots), key=lambda i: (-loads.get(i, 0), i)):
        held, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (held + loads.get(slot, 0) + 1, shard))  # the 1 deals empty slots out too
    return out


def rebalanced(current: list[int], loads: Mapping[int, int], shards: int, slack: float = 0.0005) -> list[int]:
    """The next version of a map for these loads and number of shards, by moving few slots.

    Slots of shards that are gone move first. Then slots move from the fullest shard to the emptiest, each
    time the largest that narrows the gap, or else two slots change places, until every shard is within slack of
    the mean or no move helps.
    """
    out, held = list(current), [0] * shards
    homeless = [i for i, s in enumerate(out) if s >= shards]
    own: list[dict[int, int]] = [{} for _ in range(shards)]
    for i, s in enumerate(out):
        if s < shards:
            own[s][i] = loads.get(i, 0)
            held[s] += loads.get(i, 0)
    for i in sorted(homeless, key=lambda i: (-loads.get(i, 0), i)):
        s = min(range(shards), key=lambda k: (held[k], k))
        out[i], own[s][i] = s, loads.get(i, 0)
        held[s] += loads.get(i, 0)
    mean = sum(held) / shards
    for _ in range(len(out)):
        a, b = max(range(shards), key=lambda k: (held[k], -k)), min(range(shards), key=lambda k: (held[k], k))
        if held[a] <= mean * (1 + slack) and held[b] >= mean * (1 - slack):
            break
        fit = [(n, -i) for i, n in own[a].items() if 0 < n < held[a] - held[b] and n <= max(held[a] - mean, mean - held[b])]
        if fit:
            n, i = max(fit)
            pair = (-i, None)
        else:
            half = (held[a] - held[b]) / 2
            here, there = sorted((n, i) for i, n in own[a].items()), sorted((n, i) for i, n in own[b].items())
            near = [(abs(n - m - half), i, j) for n, i in here for m, j in there[max(0, bisect_left(there, (n - half, -1)) - 1) :][:2] if 0 < n - m < 2 * half]
            if not near:
                break
            pair = min(near)[1:]
        for i, to, source in ((pair[0], b, a), (pair[1], a, b)):
            if i is not None:
                n = own[source].pop(i)
                out[i], own[to][i] = to, n
                held[source] -= n
                held[to] += n
    return out


def _listed(values: list[int], kind: str = "int") -> Column:
    """A constant array; as one string, since thousands of literals are slow to build."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def map_table(spark: SparkSession, versions: list[list[int]]) -> DataFrame:
    """version, virtual_slot, shard: what is stored of each version."""
    return spark.range(len(versions)).select(F.col("id").cast("int").alias("version"), F.posexplode(F.element_at(F.array(*map(_listed, versions)), (F.col("id") + 1).cast("int"))).alias("virtual_slot", "shard"))


def write_map(spark: SparkSession, slot_map: list[int], version: int, path: str) -> None:
    """Adds a version; earlier ones stay readable."""
    map_table(spark, [slot_map]).withColumn("version", F.lit(version)).coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def last_version(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(path).agg(F.max("version")).first()[0]


def read_map(spark: SparkSession, path: str, version: int | None = None) -> list[int]:
    """The shards of all slots in a version, the latest by default."""
    held = spark.read.parquet(path)
    version = last_version(spark, path) if version is None else version
    return [r["shard"] for r in held.filter(F.col("version") == version).orderBy("virtual_slot").collect()]


def _of_slot(values: list[int], kind: str) -> Column:
    return F.element_at(_listed(values, kind), F.col("virtual_slot") + 1)


def place(recs: DataFrame, slot_map: list[int], counts: Mapping[int, int]) -> DataFrame:
    """Adds shard and slot, the position of a record in its shard (0, 1, 2, ... without a gap).

    A shard's records are numbered slot by slot: where a slot begins follows from the counts of slots, so
    only the records of one slot are sorted together, never those of a shard.
    """
    start, at = [0] * len(slot_map), Totals()
    for i, s in enumerate(slot_map):
        start[i] = at.take(s, counts.get(i, 0))
    order = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return recs.select("*", _of_slot(slot_map, "int").alias("shard"), (_of_slot(start, "bigint") + F.row_number().over(order) - 1).alias("slot"))


class Totals(dict):
    """Running totals per key."""

    def take(self, key: int, n: int) -> int:
        before = self.get(key, 0)
        self[key] = before + n
        return before


def first_map(shards: int, slots: int = SLOTS) -> list[int]:
    return [i % shards for i in range(slots)]


def shard(docs: DataFrame, shards: int = 24, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """All rows with their shard: doc_id, size, text_crc32, virtual_slot, shard, slot, map_version.

    The latest map at path (without one, a new map in the shared folder) is edited so that shards have near
    equal bytes, and kept as the next version.
    """
    spark = docs.sparkSession
    if path is None:
        path = f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
        write_map(spark, first_map(shards, slots), 0, path)
    recs = records(docs, id_col, text_col, slots)
    loads = {r[0]: (r[1], r[2]) for r in slot_loads(recs).collect()}  # one row per slot at most
    version = last_version(spark, path)
    edited = rebalanced(read_map(spark, path, version), {k: b for k, (b, _) in loads.items()}, shards)
    write_map(spark, edited, version + 1, path)
    placed = place(recs, read_map(spark, path, version + 1), {k: n for k, (_, n) in loads.items()})
    return placed.withColumn("map_version", F.lit(version + 1))
