"""Joins of voxels with their neighbours.

A grid is a long table (by..., z, y, x, columns). A neighbour join explodes a small constant array of
offsets and joins on shifted coordinates by equality, so the planner hashes or sorts; it never loops.
Cost is offsets times voxels; only labelled voxels are kept before the explode. The planner takes an exploded
table to be as small as the one before, so the joins say that they sort and merge: neither side is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.registry import anatomy_of, same_anatomy, valid_id

Offsets = list[tuple[int, int, int]]


def axis_offsets(distance: int = 1) -> Offsets:
    return [(distance, 0, 0), (0, distance, 0), (0, 0, distance)]


def forward_offsets() -> Offsets:
    """Half of the 26 neighbours: those after a voxel in raster order."""
    return [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) > (0, 0, 0)]


def all26() -> Offsets:
    return [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) != (0, 0, 0)]


def ball_offsets(radius: float, spacing=(1.0, 1.0, 1.0), half: bool = False) -> Offsets:
    """Offsets within a radius (in units of spacing); half: only those after (0, 0, 0)."""
    r = [int(radius // s) for s in spacing]
    found = [(a, b, c) for a in range(-r[0], r[0] + 1) for b in range(-r[1], r[1] + 1) for c in range(-r[2], r[2] + 1) if (a * spacing[0]) ** 2 + (b * spacing[1]) ** 2 + (c * spacing[2]) ** 2 <= radius**2]
    return [o for o in found if o > (0, 0, 0)] if half else [o for o in found if o != (0, 0, 0)]


def offset_array(offsets: Offsets) -> Column:
    return F.array(*[F.struct(F.lit(a).cast("long").alias("dz"), F.lit(b).cast("long").alias("dy"), F.lit(c).cast("long").alias("dx"), F.lit(k).alias("k")) for k, (a, b, c) in enumerate(offsets)])


def shifted(grid: DataFrame, offsets: Offsets) -> DataFrame:
    """grid with its offsets' targets: columns tz, ty, tx and the offset's number k."""
    e = grid.withColumn("_o", F.explode(offset_array(offsets)))
    return e.withColumns({"tz": F.col("z") + F.col("_o.dz"), "ty": F.col("y") + F.col("_o.dy"), "tx": F.col("x") + F.col("_o.dx"), "k": F.col("_o.k")}).drop("_o")


def neighbor_pairs(grid: DataFrame, offsets: Offsets, value: str, by: list[str] | None = None, left: bool = False) -> DataFrame:
    """Pairs of a voxel and its neighbour, with the neighbour's value as other; left: also voxels without one."""
    by = by or []
    other = grid.select(*by, F.col("z").alias("tz"), F.col("y").alias("ty"), F.col("x").alias("tx"), F.col(value).alias("other"))
    return shifted(grid, offsets).join(other.hint("merge"), [*by, "tz", "ty", "tx"], "left" if left else "inner")


def affinity_pairs(grid: DataFrame, label: str, affinities: list[str], offsets: Offsets, by: list[str] | None = None) -> DataFrame:
    """(by, k, p, same) of labelled voxels and their labelled neighbours: channel k at the voxel that offset k starts from, and whether
    the labels are equal. The channel is chosen where the offsets are exploded: a row that is joined carries one of them."""
    by = by or []
    kept = grid.where(F.col(label) > 0)
    ends = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col("z") + a).alias("tz"), (F.col("y") + b).alias("ty"), (F.col("x") + c).alias("tx"), F.col(v).alias("p")) for k, ((a, b, c), v) in enumerate(zip(offsets, affinities, strict=True))]))
    starts = kept.select(*by, F.col(label).alias("_own"), ends.alias("_e")).select(*by, "_own", "_e.*")
    other = kept.select(*by, F.col("z").alias("tz"), F.col("y").alias("ty"), F.col("x").alias("tx"), F.col(label).alias("_other"))
    return starts.join(other.hint("merge"), [*by, "tz", "ty", "tx"]).select(*by, "k", "p", (F.col("_own") == F.col("_other")).alias("same"))


def pair_evidence(grid: DataFrame, label: str, affinities: list[str], offsets: Offsets, by: list[str] | None = None) -> DataFrame:
    """(by, lo, hi, weight, n): of touching different labels, the mean of 1 - affinity and the count over the offsets.

    Channel k belongs to offset k and is read at the voxel that the offset starts from.
    """
    by = by or []
    kept = grid.where(F.col(label) > 0)
    chosen = F.element_at(F.array(*[F.col(a) for a in affinities]), F.col("k") + 1)
    pairs = neighbor_pairs(kept.select(*by, "z", "y", "x", label, *affinities), offsets, label, by).where(F.col(label) != F.col("other"))
    return pairs.groupBy(*by, F.least(label, "other").alias("lo"), F.greatest(label, "other").alias("hi")).agg(F.avg(1.0 - chosen).alias("weight"), F.count(F.lit(1)).alias("n"))


def pair_affinity(grid: DataFrame, label: str, affinities: list[str], offsets: Offsets, wanted: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Evidence of given pairs (by, lo, hi): mean raw affinity, or null with n = 0 where they don't touch."""
    by = by or []
    found = pair_evidence(grid, label, affinities, offsets, by)
    return wanted.join(found, [*by, "lo", "hi"], "left").select(*by, "lo", "hi", (1.0 - F.col("weight")).alias("affinity"), F.coalesce("n", F.lit(0)).alias("n"))


def adjacent_pairs(grid: DataFrame, label: str, radius: float, by: list[str] | None = None) -> DataFrame:
    """Distinct unordered pairs of labels within a ball."""
    by = by or []
    kept = grid.where(F.col(label) > 0).select(*by, "z", "y", "x", label)
    return neighbor_pairs(kept, ball_offsets(radius, half=True), label, by).where(F.col(label) != F.col("other")).select(*by, F.least(label, "other").alias("lo"), F.greatest(label, "other").alias("hi")).distinct()


def label_boxes(grid: DataFrame, label: str, by: list[str] | None = None, pad: int = 0, extent: tuple[int, int, int] | None = None) -> DataFrame:
    """Half-open box of each label, padded, and clamped to the grid if its extent (z, y, x) is given; a label without voxels has no row."""
    edges = []
    for k, a in enumerate("zyx"):
        low, high = F.min(a) - pad, F.max(a) + 1 + pad
        if extent is not None:
            low, high = F.greatest(low, F.lit(0)), F.least(high, F.lit(extent[k]))
        edges += [low.alias(f"{a}0"), high.alias(f"{a}1")]
    return grid.where(F.col(label) > 0).groupBy(*(by or []), label).agg(*edges)


def interior_counts(grid: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """(by, label, n, interior): voxels of each label, and those whose six face neighbours have it too; beyond the grid there are none."""
    by = by or []
    faces = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
    cells = grid.select(*by, "z", "y", "x", label)
    inner = erode(cells, faces, [*by, label]).groupBy(*by, label).agg(F.count(F.lit(1)).alias("interior"))
    return cells.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n")).join(inner, [*by, label], "left").withColumn("interior", F.coalesce("interior", F.lit(0)))


def dilate(cells: DataFrame, offsets: Offsets, keys: list[str]) -> DataFrame:
    """The cells and all their neighbours, distinct by (keys, z, y, x)."""
    grown = shifted(cells.select(*keys, "z", "y", "x"), [*offsets, (0, 0, 0)])
    return grown.select(*keys, F.col("tz").alias("z"), F.col("ty").alias("y"), F.col("tx").alias("x")).distinct()


def erode(cells: DataFrame, offsets: Offsets, keys: list[str]) -> DataFrame:
    """The cells all of whose neighbours are cells; beyond the grid there are none."""
    grown = shifted(cells.select(*keys, "z", "y", "x"), [*offsets, (0, 0, 0)]).groupBy(*keys, "tz", "ty", "tx").count()
    return grown.where(F.col("count") == len(offsets) + 1).select(*keys, F.col("tz").alias("z"), F.col("ty").alias("y"), F.col("tx").alias("x"))


def candidate_interface(grid: DataFrame, label: str, adjacency: int, interface: int, by: list[str] | None = None) -> DataFrame:
    """(by, lo, hi, voxels): size of the meeting of both labels' dilations, of labels within the adjacency radius.

    The pairs come first and prune the dilation to labels that have a neighbour.
    """
    by = by or []
    pairs = adjacent_pairs(grid, label, adjacency, by)
    both = pairs.select(*by, F.col("lo").alias(label)).unionAll(pairs.select(*by, F.col("hi").alias(label))).distinct()
    cells = grid.where(F.col(label) > 0).join(both, [*by, label], "left_semi")
    grown = dilate(cells, ball_offsets(interface), [*by, label])
    a, b = grown.withColumnRenamed(label, "lo"), grown.withColumnRenamed(label, "hi")
    meet = a.join(b, [*by, "z", "y", "x"]).where("lo < hi")
    return meet.groupBy(*by, "lo", "hi").agg(F.count(F.lit(1)).alias("voxels")).join(pairs, [*by, "lo", "hi"], "left_semi")


def contact_voxels(grid: DataFrame, label: str, offsets: Offsets, same_block=None, by: list[str] | None = None) -> DataFrame:
    """Both ends of pairs of different labels (in the same block, if a test is given), distinct."""
    by = by or []
    kept = grid.where(F.col(label) > 0).select(*by, "z", "y", "x", label)
    pairs = neighbor_pairs(kept, offsets, label, by).where(F.col(label) != F.col("other"))
    if same_block is not None:
        pairs = pairs.where(same_block(F.col(label), F.col("other")))
    ends = F.explode(F.array(F.struct("z", "y", "x"), F.struct(F.col("tz").alias("z"), F.col("ty").alias("y"), F.col("tx").alias("x"))))
    return pairs.select(*by, ends.alias("c")).select(*by, "c.z", "c.y", "c.x").distinct()


def affinity_targets(grid: DataFrame, label: str, offsets: Offsets, by: list[str] | None = None) -> DataFrame:
    """(by, z, y, x, k, same, both): of each voxel and offset inside the grid, whether the labels are equal, and both positive."""
    pairs = neighbor_pairs(grid.select(*(by or []), "z", "y", "x", label), offsets, label, by)
    return pairs.select(*(by or []), "z", "y", "x", "k", ((F.col(label) == F.col("other")) & (F.col(label) > 0)).alias("same"), ((F.col(label) > 0) & (F.col("other") > 0)).alias("both"))


def surface_fraction(grid: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """(by, label, n, surface, fraction): voxels with fewer than 26 neighbours of their label."""
    by = by or []
    kept = grid.where(F.col(label) > 0).select(*by, "z", "y", "x", label)
    inner = erode(kept, all26(), [*by, label]).groupBy(*by, label).count()
    n = kept.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    out = n.join(inner, [*by, label], "left").withColumn("surface", F.col("n") - F.coalesce("count", F.lit(0)))
    return out.select(*by, label, "n", "surface", (F.col("surface") / F.col("n")).alias("fraction"))


def edge_breaks(grid: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """(by, axis, valid, breaks): along each axis, pairs of labelled neighbours and those between different labels."""
    kept = grid.where(F.col(label) > 0).select(*(by or []), "z", "y", "x", label)
    return neighbor_pairs(kept, axis_offsets(), label, by).groupBy(*(by or []), F.col("k").alias("axis")).agg(F.count(F.lit(1)).alias("valid"), F.count_if(F.col(label) != F.col("other")).alias("breaks"))


def edge_break_targets(grid: DataFrame, label: str, shapes: DataFrame, by: list[str], radius: int = 1) -> DataFrame:
    """(by, axis, z, y, x) of the edges, each from a voxel to the next along an axis, that a target marks as breaks.

    Edges between different valid labels of one anatomy, grown by a cube of so many voxels, but only among edges that touch a
    label at either end. Edges lie inside the volume; shapes: (by, nz, ny, nx). Voxels that aren't in grid have no label.
    """
    kept = grid.where(valid_id(F.col(label))).select(*by, "z", "y", "x", label)
    other = kept.select(*by, F.col("z").alias("tz"), F.col("y").alias("ty"), F.col("x").alias("tx"), F.col(label).alias("other"))
    ahead = shifted(kept, axis_offsets()).join(other, [*by, "tz", "ty", "tx"])
    edge = [*by, F.col("k").alias("axis")]
    breaks = ahead.where((F.col(label) != F.col("other")) & same_anatomy(F.col(label), F.col("other"))).select(*edge, "z", "y", "x")
    if radius < 1:
        return breaks
    near = range(-radius, radius + 1)
    grown = dilate(breaks, [(a, b, c) for a in near for b in near for c in near if (a, b, c) != (0, 0, 0)], [*by, "axis"])
    # an edge touches a label at its start, or at the voxel that it leads to
    starts = kept.select(*by, F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("axis"), "z", "y", "x")
    leads = shifted(kept, [(-a, -b, -c) for a, b, c in axis_offsets()]).select(*edge, F.col("tz").alias("z"), F.col("ty").alias("y"), F.col("tx").alias("x"))
    place = [*by, "axis", "z", "y", "x"]
    inside = grown.join(shapes.select(*by, "nz", "ny", "nx"), by)
    for k, a in enumerate("zyx"):
        inside = inside.where((F.col(a) >= 0) & (F.col(a) < F.col(f"n{a}") - F.when(F.col("axis") == k, 1).otherwise(0)))
    return inside.select(*place).join(starts.unionByName(leads).distinct(), place, "left_semi")


def touching(grid: DataFrame, label: str, by: list[str]) -> DataFrame:
    """(by, z, y, x) of voxels with a neighbour (of 26) of another label of their anatomy."""
    kept = grid.where(valid_id(F.col(label))).select(*by, "z", "y", "x", label, anatomy_of(F.col(label)).alias("_a"))
    near = [*all26(), (0, 0, 0)]
    own = F.when(F.col("k") == len(near) - 1, F.col(label))
    met = shifted(kept, near).groupBy(*by, "tz", "ty", "tx", "_a").agg(F.min(label).alias("_lo"), F.max(label).alias("_hi"), F.max(own).alias("_own"))
    return met.where("_own IS NOT NULL AND _lo < _hi").select(*by, F.col("tz").alias("z"), F.col("ty").alias("y"), F.col("tx").alias("x"))


def class_target(grid: DataFrame, label: str, by: list[str], grow: int = 1, shrink: int = 1) -> DataFrame:
    """grid (by, z, y, x, label, ...) with cls: 0 outside, 2 within `grow` voxels of where fragments of one anatomy touch, 3 further than
    `shrink` from any voxel outside, 1 between; distances go along all axes at once (cubes), and beyond the grid there is nothing."""
    place = [*by, "z", "y", "x"]
    cube = lambda r: [o for o in ((a, b, c) for a in range(-r, r + 1) for b in range(-r, r + 1) for c in range(-r, r + 1)) if o != (0, 0, 0)]
    # exploded rows meet in partial sums before they are shuffled, unlike those of a join
    touch = touching(grid, label, by)
    boundary = (dilate(touch, cube(grow), by) if grow else touch).withColumn("_b", F.lit(True))
    outside = grid.where(F.coalesce(F.col(label), F.lit(0)) <= 0).select(*place)
    rim = dilate(outside, cube(shrink), by) if shrink else outside.limit(0)
    out = grid.join(boundary.hint("merge"), place, "left").join(rim.withColumn("_r", F.lit(True)).hint("merge"), place, "left")
    cls = F.when(F.coalesce(F.col(label), F.lit(0)) <= 0, 0).when(F.col("_b"), 2).when(F.col("_r"), 1).otherwise(3)
    return out.withColumn("cls", cls.cast("long")).select(*grid.columns, "cls")


def distance_to_other(grid: DataFrame, label: str, radius: float, same_block=None, spacing=(1.0, 1.0, 1.0), by: list[str] | None = None) -> DataFrame:
    """(by, z, y, x, label, distance): of each labelled voxel, to the nearest one of another label within the radius; null beyond."""
    by = by or []
    kept = grid.where(F.col(label) > 0).select(*by, "z", "y", "x", label)
    pairs = neighbor_pairs(kept, ball_offsets(radius, spacing), label, by).where(F.col(label) != F.col("other"))
    if same_block is not None:
        pairs = pairs.where(same_block(F.col(label), F.col("other")))
    d = F.sqrt(sum(F.pow((F.col(f"t{a}") - F.col(a)) * s, 2) for a, s in zip("zyx", spacing)))
    near = pairs.groupBy(*by, "z", "y", "x").agg(F.min(d).alias("distance"))
    return kept.join(near.hint("merge"), [*by, "z", "y", "x"], "left")
