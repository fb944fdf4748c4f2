"""Scans prepared for a model: turned to LPS, clipped, written, with an audit from the pass that writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from . import volumes


def turned(volume: DataFrame, geometry: DataFrame) -> DataFrame:
    """volume (scan, z, y, x, ...) with axes permuted and flipped to run toward L, P and S.

    geometry: (scan, size array<bigint>, direction array<double>), x first.
    """
    code = S.orientation_code([F.col("direction")[k] for k in range(9)])
    g = geometry.select("scan", code.alias("_code"), F.col("size").alias("_size"))
    out = volume.join(g, "scan")
    x, y, z = S.to_lps(F.col("_code"), [F.col("x"), F.col("y"), F.col("z")], [F.col("_size")[k] for k in range(3)])
    return out.withColumns({"x": x, "y": y, "z": z}).drop("_code", "_size")


def after_turn(geometry: DataFrame) -> DataFrame:
    """geometry (scan, size, spacing, origin, direction) before and after the turn, as structs source and output with their codes.

    After it the directions are those of the axes that now run toward L, P and S, and the origin is the corner where all begin.
    """
    code = S.orientation_code([F.col("direction")[k] for k in range(9)])
    axes, flips = [], []
    for letter, opposite in (("L", "R"), ("P", "A"), ("S", "I")):
        found = [F.when(F.substring("code", k + 1, 1).isin(letter, opposite), F.lit(k)) for k in range(3)]
        axes.append(F.coalesce(*found))
        flips.append(F.instr("code", opposite) > 0)
    g = geometry.withColumn("code", code).withColumns({f"_a{k}": a for k, a in enumerate(axes)}).withColumns({f"_f{k}": f for k, f in enumerate(flips)})
    at = lambda c, k: F.element_at(c, F.col(f"_a{k}") + 1)
    toward = lambda r, k: F.element_at("direction", 3 * r + F.col(f"_a{k}") + 1)
    sign = lambda k: F.when(F.col(f"_f{k}"), -1.0).otherwise(1.0)
    moved = [F.col("origin")[r] + sum(F.when(F.col(f"_f{k}"), toward(r, k) * at("spacing", k) * (at("size", k) - 1)).otherwise(0.0) for k in range(3)) for r in range(3)]
    struct = lambda c, size, spacing, origin, direction: F.struct(c.alias("orientation"), size.alias("size"), spacing.alias("spacing"), origin.alias("origin"), direction.alias("direction"))
    source = struct(F.col("code"), F.col("size"), F.col("spacing"), F.col("origin"), F.col("direction"))
    output = struct(F.lit("LPS"), F.array(*[at("size", k) for k in range(3)]), F.array(*[at("spacing", k) for k in range(3)]), F.array(*moved), F.array(*[toward(r, k) * sign(k) for r in range(3) for k in range(3)]))
    return g.select("scan", source.alias("source"), output.alias("output"))


def read_lps(spark: SparkSession, folder: str, pattern: str = "*.mha") -> tuple[DataFrame, DataFrame]:
    """(voxels, geometry) of image files: (scan, z, y, x, v) turned to LPS, scan being the file's path, and (scan, source, output) as after_turn."""
    voxels, files = volumes.read_mha(spark, folder, pattern)
    n, s = (F.array(*[F.col(f"{k}{a}") for a in "xyz"]) for k in ("n", "s"))
    geometry = files.select(F.col("path").alias("scan"), n.alias("size"), s.alias("spacing"), "origin", "direction")
    return turned(voxels.withColumnsRenamed({"path": "scan", "value": "v"}), geometry), after_turn(geometry)


def write_clipped(volume: DataFrame, geometry: DataFrame, path: str, value: str = "v", low: float = S.HU_RANGE[0], high: float = S.HU_RANGE[1]) -> dict:
    """Writes the turned volume, its values clipped, to path/voxels by scan and the geometry before and after to path/geometry.

    Returns voxels, the least and the largest written value and how many were clipped, counted by the job that wrote them.
    """
    seen = Observation()
    clipped = S.clip(F.col(value), low, high)
    out = turned(volume, geometry).withColumn("_was", F.col(value)).withColumn(value, clipped)
    watched = out.observe(seen, F.count(F.lit(1)).alias("voxels"), F.min(value).alias("least"), F.max(value).alias("most"), F.count_if(F.col("_was") != F.col(value)).alias("clipped")).drop("_was")
    watched.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scan").parquet(f"{path}/voxels")
    after_turn(geometry).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scan").parquet(f"{path}/geometry")
    return {"range": (low, high), **seen.get}
