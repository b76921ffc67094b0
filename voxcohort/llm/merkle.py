"""A Merkle manifest of a dataset: every record's digest, a tree per source, a tree of sources, and proofs.

A record's digest is the SHA-256 of its fields. A source's records, by id, are the leaves of its tree; every three
consecutive nodes (the last ones may be fewer) have the hash of their digests as parent, until one is left: the
subroot. The subroots, by source, are the leaves of the tree that ends in the root.

Levels are kept as strings: an aligned block of 243 nodes has its digests one after another in one string, so a
parent is the hash of a substring of fixed width, and the siblings of a node are the substrings beside it. Five
levels of a block are made in one row; the blocks' tops are the nodes of the next round (a thousand million leaves
take four rounds). Then the rounds are gone down again: each block hands the siblings above it to its nodes.
No row holds more than a block, whatever the size of a source, and all trees climb in the same rounds.

Positions come from a sort by range: the place within a sorted partition and the rows of those before it. Equal
rows are told apart by a key, so a hot source, or one record a million times, is cut like any other.

Nulls: a null field is written as -, and so differs from an empty one; the null source is a tree of its own, before
the others; null ids come first. Rows equal in source and id are ordered by their digest. A row without an id
is not tampered with. An empty table gives an empty result. Columns other than those of the record play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxcohort.plans.storage import attach, small_or_not, stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY, ROUND = 3, 5
BLOCK = ARITY**ROUND
#: Characters of a digest, and of the digests of siblings.
ONE = 64
RUN = ARITY * ONE
#: Rows of a partition when rows are sorted.
SORTED_ROWS = 1 << 18


def record_digest(fields: list[Column]) -> Column:
    """SHA-256 of the fields, each with its length in bytes before it, so that no two lists of fields look alike."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with at, the position in its tree (from 0), and n, the tree's number of rows."""
    rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "merkle-rows")
    total = rows.count()
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // SORTED_ROWS)
    keys = ["tree", *order, "_row"]
    placed = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id())
    placed = stored(placed.withColumn("_part", F.shiftright("_place", 33)).withColumn("_place", F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))), "merkle-sorted")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # One narrow row per partition.
    before = sizes.select("_part", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    placed = placed.join(small_or_not(before), "_part", "left").withColumn("_place", F.col("_place") + F.coalesce("_before", F.lit(0))).drop("_part", "_before", "_row")
    trees = stored(placed.groupBy("tree").agg(F.count(F.lit(1)).alias("n"), F.min("_place").alias("_first")), "merkle-trees")
    return attach(placed, trees, "tree", "n", total).withColumn("at", F.col("_place") - F.col("_first")).drop("_place", "_first")


def parents(level: Column) -> Column:
    """The level above: the hash of every three digests (the last may be fewer) of a string of digests."""
    runs = F.ceil(F.length(level) / F.lit(RUN)).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(0), runs - 1), lambda i: F.sha2(F.substring(level, i * RUN + 1, F.lit(RUN)), 256)), "")


def beside(level: Column, node: Column) -> Column:
    """left, right: the digests of a node's siblings before and after it."""
    first = F.floor(node / ARITY).cast("int") * RUN
    left = F.substring(level, first + 1, node * ONE - first)
    return F.struct(left.alias("left"), F.substring(level, node * ONE + ONE + 1, first + RUN - ONE - node * ONE).alias("right"))


def blocks(nodes: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """tree, block, n, climbed, levels, top, held: one row per aligned block of nodes (tree, at, n, digest).

    levels are the strings of the levels climbed here and top what stands above them; held has the carried columns
    by position.
    """
    here = nodes.withColumn("block", F.floor(F.col("at") / BLOCK)).withColumn("_slot", (F.col("at") % BLOCK).cast("int"))
    nodes_held = F.struct("_slot", "digest", *(c for c in carried if c != "digest"))
    out = here.groupBy("tree", "block").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(nodes_held)).alias("held"))
    out = out.withColumn("climbed", sum((F.when(F.col("n") > ARITY**k, 1).otherwise(0) for k in range(ROUND)), F.lit(0)))
    out = out.withColumn("_0", F.array_join(F.transform("held", lambda x: x["digest"]), ""))
    for k in range(ROUND):
        out = out.withColumn(f"_{k + 1}", F.when(F.col("climbed") > k, parents(F.col(f"_{k}"))).otherwise(F.col(f"_{k}")))
    held = F.transform("held", lambda x: F.struct(*(x[c].alias(c) for c in ("_slot", *carried))))
    return out.select("tree", "block", "n", "climbed", F.slice(F.array(*(f"_{k}" for k in range(ROUND))), F.lit(1), F.col("climbed")).alias("levels"), F.col(f"_{ROUND}").alias("top"), held.alias("held"))


def siblings(slot: Column) -> Column:
    """What stands beside a node, level by level through its block."""
    return F.transform("levels", lambda level, k: beside(level, F.floor(slot / F.pow(F.lit(ARITY), k)).cast("int")))


def climb(nodes: DataFrame, carried: tuple[str, ...] = ()) -> list[DataFrame]:
    """The blocks of every round, from the leaves to the round in which every tree has one node."""
    rounds = []
    while True:
        held = stored(blocks(nodes, () if rounds else carried), "merkle-blocks")
        rounds.append(held)
        most = held.agg(F.max("n")).first()[0]
        if most is None or most <= BLOCK:
            return rounds
        nodes = held.select("tree", F.col("block").alias("at"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("top").alias("digest"))


def paths(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """tree, block, _path and above's other columns: what stands beside the ways from the first round's blocks to the root.

    above: tree, _path of the roots of the trees, and columns to carry down.
    """
    more = [c for c in above.columns if c not in ("tree", "_path")]
    path = above.withColumn("block", F.lit(0).cast("long"))
    for held in reversed(rounds[1:]):
        met = held.join(path, ["tree", "block"])
        ways = F.transform(F.sequence(F.lit(0), F.size("held") - 1), lambda i: F.concat(siblings(i), F.col("_path")))
        path = met.select("tree", *more, "block", F.posexplode(ways).alias("_slot", "_path")).withColumn("block", F.col("block") * BLOCK + F.col("_slot")).drop("_slot")
    return path


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", source_col: str = "source", tampered: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, source, leaf, subroot, root, proof (left and right siblings), proof_sha256, folded_root, verified of every row.

    tampered: other contents of fields, from which folded_root is made with the original siblings; by default the
    records are verified as they are.
    """
    other = tampered or {}
    tree = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit(""))  # before all others if null
    leaves = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        tree.alias("tree"),
        record_digest([F.col(f) for f in fields]).alias("digest"),
        record_digest([other.get(f, F.col(f)) for f in fields]).alias("_seen"),
    )
    lower = climb(numbered(leaves, ["doc_id", "digest"]), ("doc_id", "source", "digest", "_seen"))
    subroots = lower[-1].select(F.lit("").alias("tree"), F.col("tree").alias("_name"), F.col("top").alias("digest"))
    upper = climb(numbered(subroots, ["_name"]), ("_name", "digest"))
    root = F.lit((upper[-1].select("top").first() or [None])[0]).cast("string")  # one digest
    none = F.array().cast("array<struct<left:string,right:string>>")
    above = upper[0].join(paths(upper, docs.sparkSession.range(1).select(F.lit("").alias("tree"), none.alias("_path"))), ["tree", "block"])
    named = F.transform("held", lambda x: F.struct(x["_name"].alias("tree"), x["digest"].alias("subroot"), F.concat(siblings(x["_slot"]), F.col("_path")).alias("_path")))
    below = paths(lower, stored(above.select(F.explode(named).alias("x")).select("x.*"), "merkle-sources"))

    def proved(x: Column) -> Column:
        path = F.concat(siblings(x["_slot"]), F.col("_path"))
        folded = F.aggregate(path, x["_seen"], lambda digest, s: F.sha2(F.concat(s["left"], digest, s["right"]), 256))
        proof = F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")
        parts = {"doc_id": x["doc_id"], "source": x["source"], "leaf": x["digest"], "subroot": F.col("subroot"), "root": root, "proof": path, "proof_sha256": F.sha2(proof, 256), "folded_root": folded, "verified": folded == root}
        return F.struct(*(c.alias(name) for name, c in parts.items()))

    return lower[0].join(below, ["tree", "block"]).select(F.explode(F.transform("held", proved)).alias("x")).select("x.*")


def without_line_feeds(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The text, without its line feeds where the checksum of the id is even."""
    even = F.crc32(F.col(id_col).cast("string")) % 2 == 0
    return F.when(even, F.translate(F.col(text_col), "\n", "")).otherwise(F.col(text_col))
