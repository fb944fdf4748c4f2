"""Sliding-window prediction with an injected model: half-overlapping patches, blended by gaussian weights.

Voxels are dealt to the patches that hold them by their coordinates, a patch is a task's block, and what patches say of a
voxel meets as partial sums. A volume smaller than a patch along an axis is padded with zeros on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import shipped

AXES = "zyx"


def origins(extent: Column, patch: int, step: float = 0.5) -> Column:
    """Where the patches along an axis begin: as few as step allows, spread evenly from the start to the end; negative where padded."""
    room = F.greatest(extent - patch, F.lit(0))
    n = (F.ceil(room / (patch * step)) + 1).cast("int")
    apart = F.when(n > 1, room / (n - 1)).otherwise(0.0)
    before = F.floor(F.greatest(F.lit(patch) - extent, F.lit(0)) / 2)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: (F.bround(apart * k) - before).cast("long"))


def gaussian(patch: tuple[int, int, int], scale: float = 0.125, top: float = 10.0) -> np.ndarray:
    """Weights of a patch: a gaussian around its centre with a sigma of scale times its side, of the given maximum, nowhere 0."""
    line = [np.exp(-0.5 * ((np.arange(n) - n // 2) / (n * scale)) ** 2) for n in patch]
    w = line[0][:, None, None] * line[1][None, :, None] * line[2][None, None, :]
    w *= top / w.max()
    return np.maximum(w, w[w > 0].min())


def dealt(grid: DataFrame, shapes: DataFrame, by: list[str], patch: tuple[int, int, int], step: float = 0.5) -> DataFrame:
    """grid with o_z, o_y, o_x: a row for each patch that holds the voxel. shapes: (by, nz, ny, nx)."""
    places = shapes.select(*by, *[origins(F.col(f"n{a}"), p, step).alias(f"_{a}") for a, p in zip(AXES, patch, strict=True)])
    out = grid.join(places, by)
    for a, p in zip(AXES, patch, strict=True):
        out = out.withColumn(f"o_{a}", F.explode(_holding(a, p))).drop(f"_{a}")
    return out


def _holding(axis: str, patch: int) -> Column:
    """Of the patches along an axis those that hold the voxel."""
    return F.filter(f"_{axis}", lambda o: (F.col(axis) >= o) & (F.col(axis) < o + patch))


def predict(grid: DataFrame, shapes: DataFrame, by: list[str], channels: list[str], outputs: int, model: Callable[[np.ndarray], np.ndarray], patch: tuple[int, int, int], step: float = 0.5, weights: np.ndarray | None = None) -> DataFrame:
    """(by, z, y, x, p0, p1 ...): the model's blended outputs at every voxel of grid.

    model takes a patch (channels, *patch) and returns (outputs, *patch); anything else fails by name, as do values that aren't finite.
    """
    w = gaussian(patch) if weights is None else weights
    names = [f"p{k}" for k in range(outputs)]
    kinds = dict(grid.dtypes)

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        at = tuple((pdf[a] - pdf[f"o_{a}"]).to_numpy() for a in AXES)
        data = np.zeros((len(channels), *patch), np.float64)
        for k, c in enumerate(channels):
            data[k][at] = pdf[c]
        out = np.asarray(model(data), float)
        if out.shape != (outputs, *patch):
            raise ValueError(f"the model returned {out.shape}, not {(outputs, *patch)}")
        own = out[(slice(None), *at)]
        if not np.isfinite(own).all():
            raise ValueError("the model returned values that aren't finite")
        return pdf[[*by, *AXES]].assign(weight=w[at], **{n: own[k] * w[at] for k, n in enumerate(names)})

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in by), *(f"{a} long" for a in AXES), "weight double", *(f"{n} double" for n in names)])
    tiles = dealt(grid.select(*by, *AXES, *channels), shapes, by, patch, step).groupBy(*by, *[f"o_{a}" for a in AXES])
    said = tiles.applyInPandas(shipped(grid, block), schema)
    return said.groupBy(*by, *AXES).agg(*[(F.sum(n) / F.sum("weight")).alias(n) for n in names])
