"""Fields of volumes that are larger than a task: blocks of voxels are worked on side by side and joined at their borders."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxcohort.functions import geometry
from voxcohort.operators.summary import _meet
from voxcohort.plans.graph import connected_components
from voxcohort.plans.storage import broadcast_or_merge, stored

AXES = ("z", "y", "x")
#: Places a side of the box whose blocks are labelled together, where they are smaller.
TOGETHER = 64
#: Steps to the neighbours that come after a voxel, across faces, edges and corners.
AFTER = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) > (0, 0, 0)]


def components(voxels: DataFrame, keys: Sequence[str] = ("patient_id", "phase"), block: int = 64) -> DataFrame:
    """keys, z, y, x, component of the voxels with mask > 0: components across faces, edges and corners, numbered from 1 by their first voxel.

    Voxels are labelled inside blocks of block^3 places; a part is named by its first voxel. Parts that touch across a border are
    edges of a graph, whose components are found by joins. A task holds one block, or a box of small ones, whatever the size of a
    volume; it tells which parts touch inside the box, and only voxels at boxes' borders are joined with their neighbours.
    Voxels with a null place take no part.
    """
    keys = list(keys)
    own = voxels.filter("mask > 0 AND z IS NOT NULL AND y IS NOT NULL AND x IS NOT NULL").select(*keys, *(F.col(a).cast("int").alias(a) for a in AXES)).distinct()
    # A task labels the blocks of a box of up to TOGETHER^3 places in one go.
    side = block * max(1, TOGETHER // block)
    own = own.withColumns({f"_b{a}": F.floor(F.col(a) / side).cast("int") for a in AXES})
    kinds = dict(own.dtypes)

    names = [*keys, *AXES, *(f"_f{a}" for a in AXES), *(f"_t{a}" for a in AXES)]

    def label(t: pa.Table) -> pa.Table:
        at = [t[a].to_numpy() for a in AXES]
        # Blocks stand a place apart, so that no part of one touches another's.
        here = [i + i // block for i in at]
        here = tuple(i - i.min() for i in here)
        mask = np.zeros([int(i.max()) + 1 for i in here], bool)
        mask[here] = True
        part = geometry.components(mask)[here]
        order = np.lexsort((np.ravel_multi_index(here, mask.shape), part))
        first = order[np.searchsorted(part[order], np.arange(part.max() + 1))]  # the first voxel of each part
        whole = np.zeros([int(i.max() - i.min()) + 3 for i in at], part.dtype)
        whole[tuple(i - i.min() + 1 for i in at)] = part
        inner = whole[1:-1, 1:-1, 1:-1]
        met = []
        for step in AFTER:
            there = whole[tuple(slice(1 + d, n - 1 + d) for d, n in zip(step, whole.shape, strict=True))]
            met.append(np.stack([x[(inner > 0) & (there > 0) & (inner != there)] for x in (inner, there)], 1))
        link = first[np.unique(np.concatenate(met), axis=0)]
        own = first[part]
        none, rows = pa.nulls(len(own), pa.int32()), len(link)
        voxel = pa.table([*(t[k] for k in keys), *(t[a] for a in AXES), *(pa.array(i[own]) for i in at), none, none, none], names)
        ends = [pa.array(i[link[:, side]]) for side in (0, 1) for i in at]
        return pa.concat_tables([voxel, pa.table([*(t[k].take(np.zeros(rows, np.int64)) for k in keys), *[pa.nulls(rows, pa.int32())] * 3, *ends], names)])

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", z int, y int, x int, _fz int, _fy int, _fx int, _tz int, _ty int, _tx int"
    # Voxels with their part, and parts that touch each other inside a box.
    held = stored(own.groupBy(*keys, *(f"_b{a}" for a in AXES)).applyInArrow(label, schema), "block-parts")
    parts = held.filter("_tz IS NULL").drop("_tz", "_ty", "_tx")

    def node(t: str) -> Column:
        """A part's name. Keys may be of any type and null, so it is a text; places may be negative."""
        return F.concat_ws("|", F.to_json(F.struct(*keys)) if keys else F.lit(""), *(F.lpad((F.col(f"{t}{a}").cast("long") + (1 << 31)).cast("string"), 10, "0") for a in AXES))

    border = F.lit(False)
    for a in AXES:
        border = border | F.pmod(F.col(a), F.lit(side)).isin(0, side - 1)
    edge = parts.filter(border)
    steps = F.array(*(F.struct(*(F.lit(d).alias(a) for a, d in zip(AXES, s, strict=True))) for s in AFTER))
    # Only steps that leave the box are looked up.
    leaving = F.filter(steps, lambda s: reduce(or_, (F.floor((F.col(a) + s[a]) / side) != F.floor(F.col(a) / side) for a in AXES)))
    near = edge.withColumn("_s", F.explode(leaving)).select(*keys, *((F.col(a) + F.col(f"_s.{a}")).alias(a) for a in AXES), *(F.col(f"_f{a}").alias(f"_t{a}") for a in AXES))
    across = _meet(near.hint("merge"), edge, [*keys, *AXES])
    links = held.filter("_tz IS NOT NULL").select(node("_f").alias("a"), node("_t").alias("b")).union(across.select(node("_t").alias("a"), node("_f").alias("b"))).distinct()
    joined = stored(connected_components(links), "block-components")
    firsts = [f"_f{a}" for a in AXES]
    each = parts.select(*keys, *firsts).distinct().withColumn("_node", node("_f"))
    each = each.join(broadcast_or_merge(joined), F.col("_node") == F.col("node"), "left").select(*keys, *firsts, F.coalesce("component", "_node").alias("_top"))
    each = stored(each, "block-tops")
    # The name of a component is that of its least part, which is not always that of its first voxel.
    tops = each.groupBy(*keys, "_top").agg(F.min(F.struct(*firsts)).alias("_first"))
    tops = tops.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_first", "_top"))).alias("_all"))  # one entry per component
    numbers = tops.select(*keys, F.posexplode("_all").alias("_n", "_c")).select(*keys, F.col("_c._top").alias("_top"), (F.col("_n") + 1).alias("component"))
    numbers = stored(_meet(each, numbers.hint("merge"), [*keys, "_top"]).select(*keys, *firsts, "component"), "block-numbers")
    return _meet(parts, broadcast_or_merge(numbers), [*keys, *firsts]).select(*keys, *AXES, "component")


def _along(axes: Sequence[tuple[str, str, float]], plane: str, names: list[str]) -> Callable[[pa.Table], pa.Table]:
    """Over planes side by side, axis after axis: the least of the squared distances that a line's voxels hand to each of its places."""

    def run(t: pa.Table) -> pa.Table:
        d = pc.fill_null(t["_d"], geometry.FAR).to_numpy()
        at = {a: np.unique(t[a].to_numpy(), return_inverse=True) for a in AXES}
        for axis, other, step in axes:
            place = at[axis][0] * step
            index = at[plane][1], at[other][1], at[axis][1]
            held = np.full((len(at[plane][0]), len(at[other][0]), len(place)), geometry.FAR)
            held[index] = d
            d = geometry.least_along(held, place)[index]
        new = pa.array(d, mask=d >= geometry.FAR)
        return pa.table([new if c == "_d" else t[c] for c in names], names)

    return run


def distances(voxels: DataFrame, spacing: tuple[float, float, float], keys: Sequence[str] = ("patient_id", "phase"), where: str = "seed", most: int = 65_536) -> DataFrame:
    """voxels with distance: in mm to the nearest voxel of its volume for which where holds; null in a volume without one.

    Plane by plane: along x and y in the planes of one z, then along z in the planes of one y. A task holds a plane, whatever the
    size of a volume, or as many neighbouring planes as have about most places together. Exact where every place of the volume's
    box has one row.
    """
    keys, out = list(keys), voxels.withColumn("_d", F.when(F.expr(where), 0.0))
    ends = voxels.groupBy(*keys).agg(*(f(a).alias(f"_{n}{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))))
    span = {a: F.col(f"_hi{a}") - F.col(f"_lo{a}") + 1 for a in AXES}
    several = lambda a, b: F.greatest(F.lit(1), F.floor(F.lit(most) / (span[a].cast("double") * span[b])))
    ends = stored(ends.select(*keys, "_loz", "_loy", several("y", "x").alias("_nz"), several("z", "x").alias("_ny")), "plane-ends")
    out = _meet(out, broadcast_or_merge(ends), keys)
    out = out.withColumns({f"_p{a}": F.floor((F.col(a) - F.col(f"_lo{a}")) / F.col(f"_n{a}")) for a in "zy"}).drop("_loz", "_loy", "_nz", "_ny")
    schema = ", ".join(f"`{c}` {k}" for c, k in out.dtypes)
    passes = ("z", (("x", "y", spacing[2]), ("y", "x", spacing[1]))), ("y", (("z", "x", spacing[0]),))
    for plane, axes in passes:
        out = out.groupBy(*keys, f"_p{plane}").applyInArrow(_along(axes, plane, out.columns), schema)
    return out.withColumn("distance", F.sqrt("_d")).drop("_d", "_pz", "_py")
