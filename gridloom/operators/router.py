"""Features by which a scan is routed to a family: geometry, intensities, and bone on a strided grid; and evidence by voxels.

The stride follows each scan's own extents inside the plan, so scans of any size are one query; bone components are
labelled in tiles of the strided grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import robust_percentiles
from .graph import tiled_components

AXES = "zyx"
#: Names by which stored models ask for features, in their order.
GEOMETRY = (*(f"{k}_{a}" for k in ("shape", "spacing", "fov") for a in AXES), "fov_z_over_x", "fov_x_over_z", "fov_y_over_x")
INTENSITY = ("hu_p00_5", "hu_p01", "hu_p05", "hu_p25", "hu_p50", "hu_p75", "hu_p95", "hu_p99", "hu_p99_5")
BONE = (*(f"sample_stride_{a}" for a in AXES), "bone_frac_sampled", *(f"bone_{k}_{a}" for k in ("bbox_frac", "bbox_mm", "centroid_frac") for a in AXES), "bone_cc_count", "bone_largest_cc_frac", "bone_second_cc_frac")
FEATURES = (*GEOMETRY, *INTENSITY, *BONE)


def geometry(scans: DataFrame) -> DataFrame:
    """scans (scan, nz, ny, nx, sz, sy, sx) to (scan, GEOMETRY): voxels, spacing, field of view and its ratios."""
    fov = {a: F.col(f"n{a}") * F.col(f"s{a}") for a in AXES}
    over = lambda a, b: fov[a] / F.greatest(fov[b], F.lit(1e-6))
    cols = [*(F.col(f"n{a}") for a in AXES), *(F.col(f"s{a}") for a in AXES), *fov.values(), over("z", "x"), over("x", "z"), over("y", "x")]
    return scans.select("scan", *[c.cast("double").alias(n) for n, c in zip(GEOMETRY, cols, strict=True)])


def strided(volume: DataFrame, scans: DataFrame, most: int = 96) -> DataFrame:
    """volume's voxels at every stride-th place, numbered anew, with the strides dz, dy, dx and the sampled extents mz, my, mx."""
    step = {a: F.greatest(F.ceil(F.col(f"n{a}") / most), F.lit(1)).cast("long") for a in AXES}
    plan = scans.select("scan", *[step[a].alias(f"d{a}") for a in AXES], *[F.ceil(F.col(f"n{a}") / step[a]).cast("long").alias(f"m{a}") for a in AXES])
    on = volume.join(plan, "scan")
    for a in AXES:
        on = on.where(F.col(a) % F.col(f"d{a}") == 0)
    return on.withColumns({a: F.expr(f"{a} div d{a}") for a in AXES})


def bone_features(volume: DataFrame, scans: DataFrame, value: str = "v", above: float = 200.0, most: int = 96, planes: int = 32) -> DataFrame:
    """(scan, BONE): strides, the share of bone, its box and centre as shares and in mm, and its components (26 neighbours)."""
    sampled = strided(volume, scans, most).withColumn("bone", F.coalesce(F.col(value) > above, F.lit(False)))
    at = lambda a: F.when(F.col("bone"), F.col(a))
    ends = [f(at(a)).alias(f"{n}{a}") for a in AXES for n, f in (("low_", F.min), ("high_", F.max), ("mean_", F.avg))]
    per = sampled.groupBy("scan").agg(*[F.first(f"{k}{a}").alias(f"{k}{a}") for k in "dm" for a in AXES], F.avg(F.col("bone").cast("int")).alias("share"), F.count_if("bone").alias("n"), *ends)
    extent = scans.agg(F.coalesce(F.max("ny"), F.lit(1)), F.coalesce(F.max("nx"), F.lit(1))).first()
    parts = tiled_components(sampled, "scan", "bone", planes, tuple(extent), connectivity=3).groupBy("scan", "root").agg(F.count(F.lit(1)).alias("size"))
    order = Window.partitionBy("scan").orderBy(F.desc("size"), "root")
    top = parts.withColumn("k", F.row_number().over(order)).groupBy("scan").agg(F.count(F.lit(1)).alias("parts"), F.max(F.when(F.col("k") == 1, F.col("size"))).alias("first"), F.max(F.when(F.col("k") == 2, F.col("size"))).alias("second"))
    out = scans.select("scan", *[f"s{a}" for a in AXES]).join(per, "scan").join(top, "scan", "left")
    box = {a: F.col(f"high_{a}") + 1 - F.col(f"low_{a}") for a in AXES}
    cols = [
        *(F.col(f"d{a}") for a in AXES), F.col("share"), *(box[a] / F.col(f"m{a}") for a in AXES), *(box[a] * F.col(f"d{a}") * F.col(f"s{a}") for a in AXES),
        *(F.col(f"mean_{a}") / F.greatest(F.col(f"m{a}") - 1, F.lit(1)) for a in AXES), F.col("parts"), F.col("first") / F.greatest("n", F.lit(1)), F.col("second") / F.greatest("n", F.lit(1)),
    ]
    return out.select("scan", *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in zip(BONE, cols, strict=True)])


def image_features(volume: DataFrame, scans: DataFrame, value: str = "v", above: float = 200.0, most: int = 96, planes: int = 32) -> DataFrame:
    """(scan, FEATURES) of each scan with voxels; volume (scan, z, y, x, value)."""
    hu = robust_percentiles(volume, value, ["scan"])
    hu = hu.select("scan", *[F.col(c).alias(n) for c, n in zip(hu.columns[1:], INTENSITY, strict=True)])
    return geometry(scans).join(hu, "scan").join(bone_features(volume, scans, value, above, most, planes), "scan").select("scan", *FEATURES)


def family_by_voxels(counts: DataFrame, anatomy: str = "anatomy", n: str = "n") -> DataFrame:
    """counts (scan, anatomy 1 to 4, n) to (scan, family, femur_share): femur from half of the voxels on; null without any."""
    femur = F.sum(F.when(F.col(anatomy) == 4, F.col(n)).otherwise(0))
    per = counts.groupBy("scan").agg(femur.alias("_f"), F.sum(F.when(F.col(anatomy).between(1, 4), F.col(n)).otherwise(0)).alias("_n"))
    share: Column = F.when(F.col("_n") > 0, F.col("_f") / F.col("_n"))
    return per.select("scan", F.when(share >= 0.5, "femur").when(share < 0.5, "pelvic").alias("family"), share.alias("femur_share"))
