"""Components of edge tables, and labelling of volumes that are larger than a task, in tiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import in_groups, written
from . import kernels as K
from .neighbors import Offsets, shifted


def components(edges: DataFrame, merge: bool = False) -> DataFrame:
    """edges (a, b) of any ordered type to (node, root): the least node reachable, of nodes that aren't their own root.

    Every round hangs each node's larger neighbours on its least one, then its smaller ones; the rounds
    needed grow about with the logarithm of the longest path, and each is written before the next. A node of very many
    neighbours is no task of its own: its minimum comes from partial sums, and the joins with minima are splittable.
    merge: nothing is broadcast. Files of numbers are many times smaller than their rows, which the driver would gather.
    """
    side = lambda df: df.hint("merge") if merge else df
    now = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # minima are written before they are joined: a join of two read tables can be broadcast, or its skewed keys split
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        hung = written(both.where("a < b").join(side(least), "a").select(F.col("m").alias("a"), "b").distinct())
        low = written(hung.groupBy("b").agg(F.min("a").alias("m")))
        nxt = written(hung.join(side(low), "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a < b").distinct())
        n, leaves = nxt.agg(F.count(F.lit(1)), F.count_distinct("b")).first()
        if n == leaves and nxt.join(side(nxt.select(F.col("b").alias("a"))), "a", "left_semi").isEmpty():
            return nxt.select(F.col("b").alias("node"), F.col("a").alias("root"))
        now = nxt


def tiled_components(grid: DataFrame, by: str, mask: str, planes: int, extent: tuple[int, int], connectivity: int = 1) -> DataFrame:
    """(by, z, y, x, root): components of masked voxels of volumes cut into tiles of so many planes.

    root is the raster number (with the extent in y and x) of the component's first voxel. A tile is one
    task's memory; tiles are stitched by the pairs of roots that touch across their borders.
    """
    ny, nx = extent
    raster = lambda z, y, x: (z * ny + y) * nx + x

    def label(table: pa.Table, starts: np.ndarray) -> pa.Table:
        cells = np.stack([table.column(c).to_numpy() for c in "zyx"], 1)
        tile = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(cells))))
        parts = K.components_of_cells(tile, cells, connectivity)
        first = np.full(len(cells), np.iinfo(np.int64).max)
        np.minimum.at(first, parts, raster(*cells.T))
        return table.select([by, "z", "y", "x"]).append_column("root", pa.array(first[parts]))

    inside = grid.where(mask).select(by, "z", "y", "x", F.expr(f"z div {planes}").alias("tile"))
    inside = inside.select(*[F.col(c).cast("long") for c in inside.columns])
    local = written(in_groups(inside, [by, "tile"], label, f"{by} long, z long, y long, x long, root long"))
    across: Offsets = [(1, b, c) for b in (-1, 0, 1) for c in (-1, 0, 1) if 1 + abs(b) + abs(c) <= connectivity]
    top = local.where(F.col("z") % planes == planes - 1)
    low = local.where(F.col("z") % planes == 0).select(by, F.col("z").alias("tz"), F.col("y").alias("ty"), F.col("x").alias("tx"), F.col("root").alias("other"))
    node = lambda c: F.struct(F.col(by).alias("vol"), F.col(c).alias("root"))
    joins = components(shifted(top, across).join(low.hint("merge"), [by, "tz", "ty", "tx"]).select(node("root").alias("a"), node("other").alias("b")), merge=True)
    to = joins.select(F.col("node.vol").alias(by), F.col("node.root").alias("root"), F.col("root.root").alias("first"))
    return local.join(to.hint("merge"), [by, "root"], "left").select(by, "z", "y", "x", F.coalesce("first", "root").alias("root"))
