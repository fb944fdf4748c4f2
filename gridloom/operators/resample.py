"""Resampling of label maps and values to another shape, and their return into the whole: interpolation as joins.

An output voxel takes from two inputs along each axis (order 1) or from one (order 0). The takes of an axis are a
table of its length, and an input voxel meets those of its three coordinates; weights multiply and sum. No task holds a volume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = "zyx"


def takes(n_in: Column, n_out: Column, order: int, corners: bool = False) -> Column:
    """An array of (out, in, weight) along an axis: centres of the output voxels among the inputs, the ends repeated.

    With corners the first and the last voxels of both lie upon each other; a single output voxel is the first.
    """

    def of(o: Column) -> Column:
        c = o * (n_in - 1) / F.greatest(n_out - 1, F.lit(1)) if corners else (o + 0.5) * n_in / n_out - 0.5
        inside = lambda i: F.least(F.greatest(i, F.lit(0)), n_in - 1).cast("long")
        one = lambda i, w: F.struct(o.cast("long").alias("out"), inside(i).alias("in"), w.alias("w"))
        if order == 0:
            return F.array(one(F.floor(c + 0.5), F.lit(1.0)))
        return F.array(one(F.floor(c), 1.0 - (c - F.floor(c))), one(F.floor(c) + 1, c - F.floor(c)))

    return F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), n_out - 1), of))


def spread(grid: DataFrame, shapes: DataFrame, by: list[str], orders: tuple[int, int, int], corners: bool = False) -> DataFrame:
    """grid with z, y, x of the output and `weight`: a row for each output voxel that takes from an input one.

    shapes: (by, nz, ny, nx, mz, my, mx), input and output. orders are 0 or 1, by axis.
    """
    if not set(orders) <= {0, 1}:
        raise ValueError(f"orders must be 0 or 1: {orders}")
    out = grid.withColumn("weight", F.lit(1.0))
    for a, order in zip(AXES, orders, strict=True):
        table = shapes.select(*by, F.explode(takes(F.col(f"n{a}"), F.col(f"m{a}"), order, corners)).alias("t")).select(*by, F.col("t.in").alias(a), F.col("t.out").alias("_out"), F.col("t.w").alias("_w")).where("_w > 0")
        # the takes of one input voxel meet it together, so that the voxels are joined and not repeated for the join
        packed = table.groupBy(*by, a).agg(F.collect_list(F.struct("_out", "_w")).alias("_t"))  # as many as the factor
        met = out.join(packed, [*by, a]).withColumn("_e", F.explode("_t"))
        out = met.withColumns({a: F.col("_e._out"), "weight": F.col("weight") * F.col("_e._w")}).drop("_t", "_e")
    return out


def labels(grid: DataFrame, shapes: DataFrame, by: list[str], orders=(1, 1, 1), label: str = "label") -> DataFrame:
    """(by, z, y, x, label) of output voxels where a label over 0 holds half of the weight or more, of two that do the higher.

    grid: labelled voxels; those that aren't there count as 0. With orders of 0 this is the nearest voxel's label.
    """
    inside = spread(grid.where(F.col(label) > 0).select(*by, *AXES, label), shapes, by, orders)
    held = inside.groupBy(*by, *AXES, label).agg(F.round(F.sum("weight"), 9).alias("weight")).where("weight >= 0.5")
    return held.groupBy(*by, *AXES).agg(F.max(label).alias(label))


def values(grid: DataFrame, shapes: DataFrame, by: list[str], columns: list[str], orders=(1, 1, 1), corners: bool = False) -> DataFrame:
    """(by, z, y, x, columns): interpolated values of a whole grid."""
    inside = spread(grid.select(*by, *AXES, *columns), shapes, by, orders, corners)
    return inside.groupBy(*by, *AXES).agg(*[F.sum(F.col(c) * F.col("weight")).alias(c) for c in columns])


def reinserted(grid: DataFrame, boxes: DataFrame, by: list[str], backward: tuple[int, int, int] = (0, 1, 2)) -> DataFrame:
    """grid moved by its box's start (by, z0, y0, x0), then its axes transposed: axis k of the result is axis backward[k] of the box."""
    if sorted(backward) != [0, 1, 2]:
        raise ValueError(f"no permutation of the axes: {backward}")
    moved = grid.join(boxes.select(*by, "z0", "y0", "x0"), by).withColumns({a: F.col(a) + F.col(f"{a}0") for a in AXES}).drop("z0", "y0", "x0")
    rest = [c for c in moved.columns if c not in (*by, *AXES)]
    return moved.select(*by, *[F.col(AXES[b]).alias(a) for a, b in zip(AXES, backward, strict=True)], *rest)


def label_map_to_original(grid: DataFrame, shapes: DataFrame, boxes: DataFrame, by: list[str], orders=(1, 1, 1), backward=(0, 1, 2), label: str = "label") -> DataFrame:
    """A label map on a model's grid, back on the scan's: resampled to the cropped shape, put at its box, axes in their old order."""
    return reinserted(labels(grid, shapes, by, orders, label), boxes, by, backward)
