"""Nearest seeds by paths inside a support, for volumes cut into tiles.

A tile's task finds the shortest paths inside it, and hands on what its border offers to cells of other tiles. Only
tiles with an offer that betters a cell of theirs work in the next round; rounds grow with the number of tiles that a path
crosses, not with its length. Lengths are whole millionths, so that sums don't depend on the order of steps.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import dealt, shipped, written

UNIT = 1_000_000
FAR = 1 << 62
CELL = ["z", "y", "x"]
TILE = ["tz", "ty", "tx"]


def steps(spacing=(1.0, 1.0, 1.0), connectivity: int = 3) -> list[tuple[tuple[int, int, int], int]]:
    """The neighbours of a voxel (by faces, edges or corners) and the lengths of the ways to them."""
    near = [o for o in itertools.product((-1, 0, 1), repeat=3) if 0 < sum(map(abs, o)) <= connectivity]
    return [(o, round(UNIT * sum((a * s) ** 2 for a, s in zip(o, spacing, strict=True)) ** 0.5)) for o in near]


def relax(length: np.ndarray, label: np.ndarray, support: np.ndarray, ways) -> None:
    """Lengths and labels of a block, improved in place until no step betters any cell: shorter first, then the lower label."""
    size = length.shape
    while True:
        moved = False
        for o, w in ways:
            to = tuple(slice(max(a, 0), n + min(a, 0)) for a, n in zip(o, size, strict=True))
            of = tuple(slice(max(-a, 0), n + min(-a, 0)) for a, n in zip(o, size, strict=True))
            offer = length[of] + w
            better = support[to] & (label[of] > 0) & ((offer < length[to]) | ((offer == length[to]) & (label[of] < label[to])))
            if better.any():
                moved = True
                length[to] = np.where(better, offer, length[to])
                label[to] = np.where(better, label[of], label[to])
        if not moved:
            return


def assign(cells: DataFrame, by: list[str], spacing=(1.0, 1.0, 1.0), connectivity: int = 3, edge: int = 64, most: float | None = None) -> DataFrame:
    """cells (by, z, y, x, seed), the support, with `label` and `distance`: the seed (over 0) that is nearest by paths inside the support.

    Of equally near seeds the lowest wins. A cell that no seed reaches (within most, if given) has label 0 and no distance. A
    null seed is none. Tiles have so many voxels a side.
    """
    ways, limit = steps(spacing, connectivity), FAR - 1 if most is None else round(most * UNIT)
    tile = {t: F.floor(F.col(c) / edge).cast("long") for t, c in zip(TILE, CELL, strict=True)}
    key, place = [*by, *TILE], [*by, *CELL]
    kinds = dict(cells.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in by), *(f"{c} long" for c in (*TILE, *CELL, "length", "label"))]) + ", offer boolean"

    def work(own: pd.DataFrame, offers: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame(columns=[*key, *CELL, "length", "label", "offer"])
        first = own[CELL].to_numpy().min(0)
        at = tuple((own[CELL].to_numpy() - first).T)
        size = tuple(int(a.max()) + 1 for a in at)
        length, label, support = np.full(size, FAR), np.zeros(size, np.int64), np.zeros(size, bool)
        length[at], label[at], support[at] = own["length"], own["label"], True
        before = length.copy(), label.copy()
        into = tuple((offers[CELL].to_numpy() - first).T)
        length[into], label[into] = offers["length"], offers["label"]
        relax(length, label, support, ways)
        out = own[[*key, *CELL]].assign(length=length[at], label=label[at], offer=False)

        moved = np.argwhere(support & ((length != before[0]) | (label != before[1])))
        low = np.floor_divide(first, edge) * edge
        handed = []
        for o, w in ways:
            to = moved + first + o
            leaves = ((to < low) | (to >= low + edge)).any(1)
            source = tuple(moved[leaves].T)
            handed.append(pd.DataFrame(to[leaves], columns=CELL).assign(length=length[source] + w, label=label[source]))
        given = pd.concat(handed, ignore_index=True)
        given = given[given["length"] <= limit].sort_values(["length", "label"]).drop_duplicates(CELL)
        for k in by:
            given[k] = own[k].iloc[0]
        for t, c in zip(TILE, CELL, strict=True):
            given[t] = given[c] // edge
        return pd.concat([out, given.assign(offer=True)[out.columns]], ignore_index=True)

    seeds = F.coalesce(F.col("seed"), F.lit(0)).cast("long")
    start = written(cells.select(*place, seeds.alias("seed")).withColumns(tile))
    state = start.select(*key, *CELL, F.lit(FAR).alias("length"), F.lit(0).cast("long").alias("label"))
    offers = written(start.where("seed > 0").select(*key, *CELL, F.lit(0).cast("long").alias("length"), F.col("seed").alias("label")))
    while not offers.isEmpty():
        active = offers.select(*key).distinct()
        done = written(dealt(state.join(active, key, "left_semi"), *key).groupBy(*key).cogroup(dealt(offers, *key).groupBy(*key)).applyInPandas(shipped(cells, work), schema))
        state = written(state.join(active, key, "left_anti").unionByName(done.where("NOT offer").drop("offer")))
        best = dealt(done.where("offer"), *key, *CELL).groupBy(*key, *CELL).agg(F.min(F.struct("length", "label")).alias("o"))
        now = state.select(*key, *CELL, F.struct("length", F.when(F.col("label") > 0, F.col("label")).otherwise(F.lit(FAR)).alias("label")).alias("now"))
        # dealt: a task sorts its share of the cells, not what fills a partition of compressed bytes
        offers = written(best.join(dealt(now, *key, *CELL).hint("merge"), [*key, *CELL]).where("o < now").select(*key, *CELL, "o.length", "o.label"))
    reached = (F.col("label") > 0) & (F.col("length") <= limit)
    return state.select(*place, F.when(reached, F.col("label")).otherwise(0).cast("long").alias("label"), F.when(reached, F.col("length") / UNIT).alias("distance"))
