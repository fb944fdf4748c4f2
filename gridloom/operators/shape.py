"""Features of a split candidate's shape and intensities, by relations: no task holds a source.

Moments of both sides come from one aggregate by (volume, source, proposal), whatever the number of candidates. Components,
surfaces and the interface need the cells of each candidate's sides, which stand as rows: (candidate, piece or not, z, y, x).
Candidates and sources grow with the volumes, so no table of them is broadcast through the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import written
from .graph import tiled_components
from .neighbors import all26, erode, shifted
from .ranking import ranked
from .surfaces import SHAPE_FEATURES

SOURCE = ["vol", "source_id"]
CANDIDATE = [*SOURCE, "proposal_id"]
AXES = "zyx"


def _parts(cells: DataFrame, key: str, extent: tuple[int, int], planes: int) -> DataFrame:
    """(key, parts): components by all 26 neighbours."""
    found = tiled_components(cells.select(key, "z", "y", "x"), key, "true", planes, extent, connectivity=3)
    return found.groupBy(key).agg(F.count_distinct("root").alias("parts"))


def shape_features(grid: DataFrame, found: DataFrame, spacing=(1.0, 1.0, 1.0), planes: int = 64) -> DataFrame:
    """found (vol, source_id, proposal_id, invert) to (vol, source_id, proposal_id, SHAPE_FEATURES).

    grid (vol, z, y, x, base, proposal, ct). A candidate's piece is its proposal inside the source, or what is left of it if inverted.
    """
    named = written(ranked(found.select(*CANDIDATE, "invert"), "cand", *CANDIDATE))
    sources = written(ranked(named.select(*SOURCE).distinct(), "src", *SOURCE))
    held = grid.where("base > 0").withColumnRenamed("base", "source_id").join(sources.hint("merge"), SOURCE)
    ct = F.col("ct").cast("double")
    sums = [F.count(F.lit(1)).alias("n"), *[F.sum(a).alias(f"s_{a}") for a in AXES], F.sum(ct).alias("v"), F.sum(ct * ct).alias("vv")]
    names = ["n", *[f"s_{a}" for a in AXES], "v", "vv"]
    per = written(held.groupBy(*SOURCE, "src", F.col("proposal").alias("proposal_id")).agg(*sums, *[g(a).alias(f"{g.__name__}_{a}") for a in AXES for g in (F.min, F.max)]))
    whole = per.groupBy(*SOURCE, "src").agg(*[F.sum(c).alias(f"t_{c}") for c in names], *[g(f"{g.__name__}_{a}").alias(f"{g.__name__}_{a}") for a in AXES for g in (F.min, F.max)])
    two = named.join(per.select(*CANDIDATE, *names).hint("merge"), CANDIDATE).join(whole.hint("merge"), SOURCE)
    own = lambda c: F.when(F.col("invert"), F.col(f"t_{c}") - F.col(c)).otherwise(F.col(c))
    two = two.withColumns({f"p_{c}": own(c) for c in names}).withColumns({f"r_{c}": F.col(f"t_{c}") - F.col(f"p_{c}") for c in names})

    rows = held.join(named.hint("merge"), SOURCE).withColumn("side", F.col("cand") * 2 + ((F.col("proposal") == F.col("proposal_id")) != F.col("invert")).cast("long"))
    cells = written(rows.select("cand", "side", "z", "y", "x"))
    extent = tuple(grid.agg(F.coalesce(F.max("y"), F.lit(0)) + 1, F.coalesce(F.max("x"), F.lit(0)) + 1).first())
    inner = erode(cells, all26(), ["side"]).groupBy("side").agg(F.count(F.lit(1)).alias("inner"))
    sides = _parts(cells, "side", extent, planes).join(inner.hint("merge"), "side", "left").select(F.expr("side div 2").alias("cand"), (F.col("side") % 2).alias("of"), "parts", F.coalesce("inner", F.lit(0)).alias("inner"))
    by_side = sides.groupBy("cand").agg(*[F.max(F.when(F.col("of") == k, F.col(c))).alias(f"{p}_{c}") for k, p in ((1, "p"), (0, "r")) for c in ("parts", "inner")])
    whole_parts = _parts(held, "src", extent, planes).withColumnRenamed("parts", "t_parts")
    beside = shifted(cells.where("side % 2 = 1").select("cand", "z", "y", "x"), all26()).select("cand", F.col("tz").alias("z"), F.col("ty").alias("y"), F.col("tx").alias("x")).distinct()
    meet = cells.where("side % 2 = 0").join(beside.hint("merge"), ["cand", "z", "y", "x"], "left_semi").groupBy("cand").agg(F.count(F.lit(1)).alias("meet"))

    out = two.join(by_side.hint("merge"), "cand", "left").join(whole_parts.hint("merge"), "src", "left").join(meet.hint("merge"), "cand", "left").na.fill(0, ["meet", "p_parts", "r_parts", "t_parts", "p_inner", "r_inner"])
    voxel, least = math.prod(spacing), F.lit(1e-6)
    n = {p: F.col(f"{p}_n").cast("double") for p in "prt"}
    one = {p: F.greatest(n[p], F.lit(1.0)) for p in "prt"}
    mean = {p: F.col(f"{p}_v") / one[p] for p in "pr"}
    std = {p: F.sqrt(F.greatest(F.col(f"{p}_vv") / one[p] - mean[p] * mean[p], F.lit(0.0))) for p in "pr"}
    span = F.array_sort(F.array(*[(F.col(f"max_{a}") - F.col(f"min_{a}") + 1) * s for a, s in zip(AXES, spacing, strict=True)]))
    apart = F.sqrt(sum(F.pow((F.col(f"p_s_{a}") / one["p"] - F.col(f"r_s_{a}") / one["r"]) * s, 2) for a, s in zip(AXES, spacing, strict=True)))
    gap, few, many = F.abs(mean["p"] - mean["r"]), F.least(n["p"], n["r"]), F.greatest(n["p"], n["r"])
    surface = lambda p: 1.0 - F.col(f"{p}_inner") / one[p]
    values = {
        "source_log_volume_cm3": F.log1p(n["t"] * voxel / 1000), "source_component_count": F.col("t_parts"), "source_bbox_short_mm": span[0], "source_bbox_mid_mm": span[1], "source_bbox_long_mm": span[2], "source_bbox_elongation": span[2] / F.greatest(span[0], least),
        "piece_small_volume_cm3": few * voxel / 1000, "piece_large_volume_cm3": many * voxel / 1000, "piece_small_large_ratio": few / F.greatest(many, F.lit(1.0)), "isolated_piece_fraction": n["p"] / one["t"],
        "piece_component_count": F.col("p_parts"), "remainder_component_count": F.col("r_parts"), "piece_surface_fraction": surface("p"), "remainder_surface_fraction": surface("r"), "interface_voxels": F.col("meet"), "interface_source_fraction": F.col("meet") / one["t"],
        "centroid_distance_mm": apart, "centroid_distance_radius_ratio": apart / F.greatest(F.pow(3 * n["t"] * voxel / (4 * math.pi), 1 / 3), least), "ct_piece_mean": mean["p"], "ct_remainder_mean": mean["r"], "ct_absolute_mean_difference": gap,
        "ct_standardized_mean_difference": gap / F.greatest(F.sqrt((std["p"] * std["p"] + std["r"] * std["r"]) / 2), least), "ct_piece_std": std["p"], "ct_remainder_std": std["r"],
    }
    return out.select(*CANDIDATE, *[values[k].cast("double").alias(k) for k in SHAPE_FEATURES])
