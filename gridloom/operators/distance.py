"""Exact Euclidean distances and surface metrics of volumes that are larger than a task.

The squared distance to the nearest of a set of voxels separates by axes. One shuffle gathers the seeds of each plane of z,
where the distances along x and then y are made; another gathers, for each y, the lines of all planes with the voxels that ask, and
takes the least along z. So a task holds one plane at a time: a group is (job, z) and then (job, y).

A job is any set of seeds and queries of its own, such as a pair of fragments; its key columns are named in `by`. Only the box that
the job's seeds and queries span along x and y is worked on, and only planes that hold seeds. Groups are dealt out to all shuffle
partitions, as they take long for their bytes.

A group costs a call, whatever its size. So jobs whose boxes and rows are few go whole, many in a call, by the same passes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import dealt, in_groups, shipped, written
from .neighbors import Offsets, erode

AXES = ("z", "y", "x")
FACES: Offsets = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
#: Numbers in a block of a plane's pass along y.
BLOCK = 1 << 22
#: Voxels of a box, and rows, of a job that goes whole.
SMALL = 1 << 16


def along_line(seeds: np.ndarray) -> np.ndarray:
    """Of rows of marks, the place of each place's nearest mark in its row, the first of equally near ones; -1 in a row without."""
    at = np.arange(seeds.shape[1])
    before = np.maximum.accumulate(np.where(seeds, at, -1), axis=1)
    after = np.minimum.accumulate(np.where(seeds, at, len(at))[:, ::-1], axis=1)[:, ::-1]
    left = (before >= 0) & ((after == len(at)) | (at - before <= after - at))
    return np.where(left, before, np.where(after < len(at), after, -1))


def least_sums(values: np.ndarray, places: np.ndarray, wanted: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray]:
    """For each wanted place the least, over the rows of values (at their rising places), of the row plus the squared distance to
    it, and that row's number, the first of equal ones."""
    shape = (len(wanted), values.shape[1])
    best, row = np.full(shape, np.inf), np.zeros(shape, np.int64)
    size = max(1, BLOCK // max(values.size, 1))
    for k in range(0, len(wanted), size):
        apart = ((wanted[k : k + size, None] - places[None, :]) * step) ** 2
        sums = values[None] + apart[:, :, None]
        row[k : k + size] = sums.argmin(1)
        best[k : k + size] = np.take_along_axis(sums, row[k : k + size, None], 1)[:, 0]
    return best, row


def nearest_of_job(asked: np.ndarray, seeds: np.ndarray, spacing) -> tuple[np.ndarray, np.ndarray]:
    """The squared distance of each place (z, y, x) to the nearest seed, and that seed's number; of equally near ones the first by z, y, x."""
    sz, sy, sx = spacing
    low = np.minimum(asked.min(0), seeds.min(0))
    ny, nx = np.maximum(asked.max(0), seeds.max(0))[1:] - low[1:] + 1
    zs, plane = np.unique(seeds[:, 0], return_inverse=True)
    marks, number = (np.zeros((ny, len(zs), nx), t) for t in (bool, np.int64))
    at = seeds[:, 1] - low[1], plane, seeds[:, 2] - low[2]
    marks[at], number[at] = True, np.arange(len(seeds))
    mark = along_line(marks.reshape(-1, nx)).reshape(marks.shape)
    lines = np.where(mark >= 0, ((np.arange(nx) - mark) * sx) ** 2, np.inf)
    best, row = least_sums(lines.reshape(ny, -1), np.arange(ny), np.arange(ny), sy)
    wanted, own = np.unique(asked[:, 0], return_inverse=True)
    y, x = asked[:, 1] - low[1], asked[:, 2] - low[2]
    best, of = least_sums(best.reshape(ny, len(zs), nx).swapaxes(0, 1).reshape(len(zs), -1), zs, wanted, sz)
    place = own, y * nx + x
    of = of[place]
    seed_y = row.reshape(ny, len(zs), nx)[y, of, x]
    return best[place], number[seed_y, of, mark[seed_y, of, x]]


def to_nearest(queries: DataFrame, seeds: DataFrame, by: list[str], spacing=(1.0, 1.0, 1.0), value: str | None = None) -> DataFrame:
    """queries (by, z, y, x, ...) with `distance` to the nearest seed (by, z, y, x) of their job, in units of spacing; null without one.

    With value, a whole number of the seeds, `nearest` is that of the nearest seed, of equally near ones the first by z, y, x.
    """
    sz, sy, sx = spacing
    kinds, names = dict(queries.dtypes), queries.columns
    key = ", ".join(f"{k} {kinds[k]}" for k in by)
    named = seeds.select(*by, *AXES, (F.col(value) if value else F.lit(0)).cast("long").alias("_value"))
    # one table of both, so that what makes them runs once
    both = written(queries.withColumn("_asks", F.lit(True)).unionByName(named.withColumn("_asks", F.lit(False)), allowMissingColumns=True))
    ends = [(g(a), f"_{a}{k}") for a in AXES for k, g in enumerate((F.min, F.max))]
    box = written(both.groupBy(*by).agg(*[e.alias(n) for e, n in ends], F.count(F.lit(1)).alias("_n"), F.count_if(~F.col("_asks")).alias("_seeds")))
    voxels = F.lit(1.0)
    for a in AXES:
        voxels = voxels * (F.col(f"_{a}1") - F.col(f"_{a}0") + 1)
    small = box.where((voxels <= SMALL) & (F.col("_n") <= SMALL) & (F.col("_seeds") > 0)).select(*by)
    apart = both.join(small, by, "left_anti")
    queries, named = apart.where("_asks").select(queries.columns), apart.where("NOT _asks").select(named.columns)

    def plane(pdf: pd.DataFrame) -> pd.DataFrame:
        y0, y1, x0, x1 = (int(pdf[c].iloc[0]) for c in ("_y0", "_y1", "_x0", "_x1"))
        ys = np.unique(pdf["y"].to_numpy())
        marks, carried = (np.zeros((len(ys), x1 - x0 + 1), t) for t in (bool, np.int64))
        at = np.searchsorted(ys, pdf["y"]), (pdf["x"] - x0).to_numpy()
        marks[at], carried[at] = True, pdf["_value"]
        mark = along_line(marks)  # every row has one
        wanted = np.arange(y0, y1 + 1)
        lines, row = least_sums(((np.arange(marks.shape[1]) - mark) * sx) ** 2, ys, wanted, sy)
        values = list(np.take_along_axis(np.take_along_axis(carried, mark, 1), row, 0)) if value else None
        return pd.DataFrame({**{k: np.repeat(pdf[k].to_numpy()[:1], len(wanted)) for k in (*by, "z")}, "y": wanted, "_x0": x0, "_line": list(lines), "_values": values})

    def column(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return right.assign(distance=None, nearest=None)
        rise = np.argsort(left["z"].to_numpy())
        lines = np.stack(left["_line"].to_numpy()[rise])
        x = right["x"].to_numpy() - int(left["_x0"].iloc[0])
        zs, own = np.unique(right["z"].to_numpy(), return_inverse=True)
        xs, place = np.unique(x, return_inverse=True)
        best, row = least_sums(lines[:, xs], left["z"].to_numpy()[rise], zs, sz)
        nearest = np.stack(left["_values"].to_numpy()[rise])[row[own, place], x] if value else None
        return right.assign(distance=np.sqrt(best[own, place]), nearest=nearest)

    def whole(table: pa.Table, starts: np.ndarray) -> pa.Table:
        cells = np.stack([table.column(a).to_numpy() for a in AXES], 1)
        asks, carried = table.column("_asks").to_numpy(), table.column("_value").to_numpy()
        distance, nearest = np.zeros(len(cells)), np.zeros(len(cells), np.int64)
        for a, b in zip(starts, np.append(starts[1:], len(cells)), strict=True):
            q, s = a + np.flatnonzero(asks[a:b]), a + np.flatnonzero(~asks[a:b])
            if len(q):
                squares, of = nearest_of_job(cells[q], cells[s], spacing)
                distance[q], nearest[q] = np.sqrt(squares), carried[s[of]] if value else 0
        asked = table.column("_asks")
        out = table.select(names).append_column("distance", pa.array(distance)).append_column("nearest", pa.array(nearest))
        return out.filter(asked)

    boxed = named.join(box, by)
    lines = dealt(boxed, *by, "z").groupBy(*by, "z").applyInPandas(shipped(seeds, plane), f"{key}, z long, y long, _x0 long, _line array<double>, _values array<long>")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema) + ", distance double, nearest long"
    out = dealt(lines, *by, "y").groupBy(*by, "y").cogroup(dealt(queries, *by, "y").groupBy(*by, "y")).applyInPandas(column, schema)
    out = out.unionByName(in_groups(both.join(small, by, "left_semi"), by, whole, schema))
    return out if value else out.drop("nearest")


def signed_distances(grid: DataFrame, by: list[str], inside: str, spacing=(1.0, 1.0, 1.0), limit: float = 40.0) -> DataFrame:
    """(by, z, y, x, signed): of every voxel, the distance to the other side of the mask `inside`, negative outside, clipped and scaled
    to [-1, 1]. Without an inside all are 0; without an outside all are 1."""
    cell = lambda c: grid.where(c).select(*by, "z", "y", "x")
    mask = F.coalesce(F.col(inside), F.lit(False))
    scaled = F.when(F.col("distance").isNotNull(), F.least("distance", F.lit(limit)) / limit)  # least skips nulls
    within = to_nearest(cell(mask), cell(~mask), by, spacing).withColumn("signed", F.coalesce(scaled, F.lit(1.0)))
    beyond = to_nearest(cell(~mask), cell(mask), by, spacing).withColumn("signed", F.coalesce(-scaled, F.lit(0.0)))
    return within.unionByName(beyond).drop("distance")


def borders(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells with a face neighbour that is none of their own; beyond the grid there are none."""
    inner = erode(cells, FACES, keys)
    return cells.select(*keys, "z", "y", "x").join(inner, [*keys, "z", "y", "x"], "left_anti")


def surface_metrics(a: DataFrame, b: DataFrame, by: list[str], spacing=(1.0, 1.0, 1.0), tolerance: float = 2.0) -> DataFrame:
    """(by, hd95, assd, nsd) of jobs of which both a and b (by, z, y, x) hold cells: of the distances between their borders,
    both ways together, the 95th percentile (linear between values), the mean, and the share within the tolerance.

    Percentiles keep one entry for each different distance of a job: sums of three squares, however large the borders.
    """
    edge_a, edge_b = borders(a, by), borders(b, by)
    both = edge_a.select(*by).distinct().join(edge_b.select(*by).distinct(), by)
    edge_a, edge_b = edge_a.join(both, by, "left_semi"), edge_b.join(both, by, "left_semi")
    d = to_nearest(edge_a, edge_b, by, spacing).unionByName(to_nearest(edge_b, edge_a, by, spacing))
    return d.groupBy(*by).agg(F.percentile("distance", F.lit(0.95)).alias("hd95"), F.avg("distance").alias("assd"), F.avg((F.col("distance") <= tolerance).cast("int")).alias("nsd"))
