"""Queries of sliding-window prediction and of resampling back to a scan's grid. Volumes are slabs of 50 x 8 x 8 voxels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import resample as R
from ..operators import windows as W
from ..sources import fixtures as X
from .base import INST_B, VOX, query

#: A patch, and where its copies begin on 50 x 8 x 8 voxels at half steps.
PATCH, STARTS = (16, 8, 6), ((0, 7, 14, 20, 27, 34), (0,), (0, 2))


def less_mean(data):
    """Stands for a model: what it says of a voxel depends on its patch."""
    return data * 2 - data.mean()


_STARTS = ", ".join(f"(SELECT unnest([{', '.join(map(str, s))}]) AS o{a}) AS s{a}" for a, s in zip("zyx", STARTS, strict=True))
_W = " * ".join(f"exp(-0.5 * pow(({a} - o{a} - {p // 2}) / {p * 0.125}, 2))" for a, p in zip("zyx", PATCH, strict=True))


@query("window_prediction", "slab:l z:l y:l x:l value:d", f"""
    WITH {VOX}, v AS (SELECT slab, z - slab * 50 AS z, y, x, v FROM vox),
    t AS (SELECT * FROM v, {_STARTS} WHERE {' AND '.join(f'{a} >= o{a} AND {a} < o{a} + {p}' for a, p in zip('zyx', PATCH, strict=True))}),
    m AS (SELECT slab, oz, oy, ox, sum(v) / {PATCH[0] * PATCH[1] * PATCH[2]} AS mean FROM t GROUP BY ALL)
    SELECT t.slab, z, y, x, sum((2 * v - mean) * {_W.replace('oz', 't.oz').replace('oy', 't.oy').replace('ox', 't.ox')}) / sum({_W.replace('oz', 't.oz').replace('oy', 't.oy').replace('ox', 't.ox')}) AS value
    FROM t JOIN m ON m.slab = t.slab AND m.oz = t.oz AND m.oy = t.oy AND m.ox = t.ox GROUP BY ALL""")
def window_prediction(spark, sf):
    v = X.vox(spark, sf).withColumn("z", F.col("z") - F.col("slab") * 50)
    shapes = v.select("slab").distinct().selectExpr("slab", "50L nz", "8L ny", "8L nx")
    return W.predict(v, shapes, ["slab"], ["v"], 1, less_mean, PATCH).withColumnRenamed("p0", "value")


SHAPE, BOX = (35, 12, 6), (3, 2, 1)


def _takes(name: str, n: int, m: int) -> str:
    c = f"((o + 0.5) * {n} / {m} - 0.5)"
    return f"""{name} AS (SELECT o, i, sum(w) AS w FROM (SELECT o, greatest(least(floor({c}), {n - 1}), 0) AS i, 1 - ({c} - floor({c})) AS w FROM (SELECT unnest(range(0, {m})) AS o)
        UNION ALL SELECT o, greatest(least(floor({c}) + 1, {n - 1}), 0), {c} - floor({c}) FROM (SELECT unnest(range(0, {m})) AS o)) GROUP BY 1, 2)"""


_RESAMPLED = f"""WITH {VOX}, {INST_B}, {_takes('tz', 50, SHAPE[0])}, {_takes('ty', 8, SHAPE[1])}, {_takes('tx', 8, SHAPE[2])}"""


@query("labels_to_original", "slab:l z:l y:l x:l label:l", f"""
    {_RESAMPLED}, h AS (SELECT slab, tz.o AS z, ty.o AS y, tx.o AS x, gt, round(sum(tz.w * ty.w * tx.w), 9) AS w FROM inst JOIN tz ON tz.i = z - slab * 50 JOIN ty ON ty.i = y JOIN tx ON tx.i = x WHERE gt > 0 GROUP BY 1, 2, 3, 4, 5)
    SELECT slab, x + {BOX[2]} AS z, z + {BOX[0]} AS y, y + {BOX[1]} AS x, max(gt) AS label FROM h WHERE w >= 0.5 GROUP BY 1, 2, 3, 4""")
def labels_to_original(spark, sf):
    """A label map resampled to another shape, at its place in the scan, with the axes in their old order."""
    g = X.instances_b(spark, sf).select("slab", (F.col("z") - F.col("slab") * 50).alias("z"), "y", "x", F.col("gt").alias("label"))
    of = g.select("slab").distinct()
    shapes = of.selectExpr("slab", "50L nz", "8L ny", "8L nx", *[f"{m}L m{a}" for a, m in zip("zyx", SHAPE, strict=True)])
    boxes = of.selectExpr("slab", *[f"{b}L {a}0" for a, b in zip("zyx", BOX, strict=True)])
    return R.label_map_to_original(g, shapes, boxes, ["slab"], backward=(2, 0, 1))


@query("resized_values", "slab:l n:l total:d most:d", f"""
    {_RESAMPLED}, h AS (SELECT slab, tz.o AS z, ty.o AS y, tx.o AS x, sum(v * tz.w * ty.w * tx.w) AS v FROM vox JOIN tz ON tz.i = z - slab * 50 JOIN ty ON ty.i = y JOIN tx ON tx.i = x GROUP BY 1, 2, 3, 4)
    SELECT slab, count(*) AS n, sum(v) AS total, max(v) AS most FROM h GROUP BY 1""")
def resized_values(spark, sf):
    v = X.vox(spark, sf).withColumn("z", F.col("z") - F.col("slab") * 50)
    shapes = v.select("slab").distinct().selectExpr("slab", "50L nz", "8L ny", "8L nx", *[f"{m}L m{a}" for a, m in zip("zyx", SHAPE, strict=True)])
    return R.values(v, shapes, ["slab"], ["v"]).groupBy("slab").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"), F.max("v").alias("most"))
