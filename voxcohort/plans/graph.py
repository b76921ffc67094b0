"""Connected components of an edge table by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxcohort.plans.storage import stored


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links the neighbours of each node to its smallest one: those above it (large), or those below and itself."""
    around = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    # The minima are combined on the map side and written, so the join has two plain inputs that AQE can split at a hub.
    least = stored(around.groupBy(F.col("a").alias("_n")).agg(F.min("b").alias("_m")), "star-min")
    met = around.join(least, F.col("a") == F.col("_n"))
    if large:
        met = met.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.least("a", "_m").alias("b"))
    else:
        met = met.select(F.explode(F.array(F.struct(F.col("b").alias("x"), F.col("_m").alias("y")), F.struct(F.col("a").alias("x"), F.col("_m").alias("y")))).alias("e")).select(F.col("e.x").alias("a"), F.col("e.y").alias("b"))
    return met.filter(F.col("a") > F.col("b")).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """node, component (the smallest node reachable) for every node of an edge, by alternating large and small stars.

    Self loops and nulls are left out; edges may repeat and have any direction. Each half round is written to
    the shared folder. Nothing but a count and a checksum reaches the driver.
    """
    now = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    loops = now.filter("a = b").select("a").distinct()
    now = stored(now.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    was = None
    for _ in range(rounds):
        is_now = _mark(now)
        if is_now == was or not is_now[0]:
            break
        was = is_now
        now = stored(_star(stored(_star(now, True), "large"), False), "small")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    tops = now.select(F.col("b").alias("node")).union(loops.select(F.col("a").alias("node"))).distinct()
    tops = tops.join(now.select(F.col("a").alias("node")), "node", "left_anti")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(tops.select("node", F.col("node").alias("component")))
