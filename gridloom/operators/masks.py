"""Exclusive masks from channel probabilities: each voxel's winner, opened by a cube, without small parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from .graph import tiled_components
from .neighbors import Offsets, shifted

CUBE: Offsets = [(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)]


def opened(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The cells (keys, z, y, x; each once) that lie in some 2 x 2 x 2 cube of cells; beyond the grid there are none."""
    at = [F.col(f"t{a}").alias(a) for a in "zyx"]
    # a cube is known by its first corner: a cell counts for the eight corners whose cubes it lies in
    first = shifted(cells.select(*keys, "z", "y", "x"), [(-a, -b, -c) for a, b, c in CUBE])
    full = first.groupBy(*keys, "tz", "ty", "tx").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(CUBE)).select(*keys, *at)
    return shifted(full, CUBE).select(*keys, *at).distinct()


def argmax_masks(grid: DataFrame, channels: list[str], planes: int, extent: tuple[int, int], least: int = 500) -> DataFrame:
    """grid (vol, z, y, x, channels; background first) to (vol, anatomy, z, y, x).

    The first of equal channels wins; a winner's cells are opened, and 26-connected parts of fewer than
    least voxels go. Volumes are labelled in tiles of so many planes; extent is the grid's in y and x.
    """
    n = len(channels)
    won = grid.select("vol", "z", "y", "x", S.argmax(F.array(*channels)).alias("anatomy")).where("anatomy > 0")
    cells = opened(won, ["vol", "anatomy"]).select((F.col("vol") * n + F.col("anatomy")).alias("part"), "z", "y", "x")
    parts = tiled_components(cells, "part", "true", planes, extent, connectivity=3)
    large = parts.groupBy("part", "root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    kept = parts.join(large, ["part", "root"], "left_semi")
    return kept.select(F.expr(f"part div {n}").alias("vol"), (F.col("part") % n).alias("anatomy"), "z", "y", "x")
