"""Evaluation drivers as plans: held-out samples of a fold, and boundary targets against the truth, with their reports.

What a model said is a table, and decoding is a function from tables to tables, so the drivers hold for any model.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import written
from ..functions.registry import BLOCK, anatomy_of
from . import matching
from .aggregates import fbeta
from .distance import surface_metrics
from .official import MEANS, SUMS, Limits, official_metrics
from .resample import reinserted, values
from .scan_plan import Rules, boxes

AXES = "zyx"


def held_out(samples: DataFrame, truth: DataFrame, scans: DataFrame, said: DataFrame, channels: list[str], decode: Callable[[DataFrame], DataFrame], spacing=(1.0, 1.0, 1.0), limits: Limits = Limits(), pad: int = 24, background: float = 0.5, most_support: float = 6.0, shape: tuple[int, int, int] | None = None) -> DataFrame:  # noqa: B008
    """samples (sample, scan, anatomy) scored one by one against their anatomy's fragments.

    truth (scan, z, y, x, gt), scans (scan, nz, ny, nx). said (sample, z, y, x, channels): probabilities on the model's own grid, background
    first; they are brought to the sample's region (the anatomy's box, padded), corner on corner, and scaled to a sum of 1. shape is that
    grid's extent (z, y, x); without it, it ends at the sample's last voxels.
    decode takes (sample, anatomy, z, y, x, channels) of regions and returns (sample, z, y, x, piece). A sample is decoded if voxels with a
    background under the limit are at most most_support times its true ones; else, or without what the model said, nothing of it is predicted.

    Returns (sample, anatomy, support, decoded, MEANS, SUMS); means are null for a sample none of whose fragments counts.
    """
    own = truth.where("gt > 0").withColumn("anatomy", anatomy_of(F.col("gt"))).join(samples, ["scan", "anatomy"])
    cells = written(own.select("sample", "scan", "anatomy", "z", "y", "x", "gt"))
    box = boxes(cells.select("scan", "anatomy", "z", "y", "x"), scans, Rules(pad=pad)).drop("box_share", "eta")
    regions = samples.join(box, ["scan", "anatomy"])
    true = cells.groupBy("sample").agg(F.count(F.lit(1)).alias("n"))
    loose = said.groupBy("sample").agg(F.count_if(F.col(channels[0]) < background).alias("loose"), *[(F.lit(shape[k]).cast("long") if shape else F.max(a) + 1).alias(f"n{a}") for k, a in enumerate(AXES)])
    plan = samples.join(true, "sample", "left").join(loose, "sample", "left").withColumn("support", F.col("loose") / F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)))
    plan = written(plan.withColumn("decoded", F.coalesce((F.col("support") <= most_support) & (F.col("n") > 0), F.lit(False))))

    mine = regions.join(plan.where("decoded").select("sample", *[f"n{a}" for a in AXES]), "sample")
    shapes = mine.select("sample", *[f"n{a}" for a in AXES], *[(F.col(f"{a}1") - F.col(f"{a}0")).alias(f"m{a}") for a in AXES])
    sized = values(said.join(mine.select("sample"), "sample", "left_semi"), shapes, ["sample"], channels, corners=True)
    total = F.greatest(sum(F.col(c) for c in channels), F.lit(1e-8))
    scaled = sized.withColumns({c: F.col(c) / total for c in channels}).join(samples.select("sample", "anatomy"), "sample")
    pieces = decode(scaled.select("sample", "anatomy", "z", "y", "x", *channels)).where(F.col("piece").between(1, BLOCK))
    placed = reinserted(pieces.select("sample", "z", "y", "x", "piece"), mine, ["sample"]).join(samples.select("sample", "anatomy"), "sample")
    pred = placed.select("sample", "z", "y", "x", ((F.col("anatomy") - 1) * BLOCK + F.col("piece")).alias("pred"))

    both = cells.select("sample", "z", "y", "x", "gt").join(pred, ["sample", "z", "y", "x"], "full_outer").na.fill(0, ["gt", "pred"])
    scores = official_metrics(written(both.withColumnRenamed("sample", "scan")), spacing, limits).select(F.col("scan").alias("sample"), *MEANS, *SUMS)
    out = plan.select("sample", "anatomy", "support", "decoded").join(scores, "sample", "left")
    return out.na.fill(0, SUMS)


def boundary(grid: DataFrame, spacing=(1.0, 1.0, 1.0), support=(2, 3, 4), barrier: int = 2, core: int = 4, tolerance: float = 2.0) -> DataFrame:
    """grid (scan, z, y, x, gt, target, pred, decoded) of every voxel, one row a scan: decoded instances against true ones, and predicted
    labels against the target's.

    (scan, iou_f, least_iou, unmatched, merged, split, support_dice, support_hd95, support_nsd, barrier_precision, barrier_recall, barrier_fbeta,
    barrier_ratio, seeds): merged counts true fragments that share their best decoded one, split the decoded ones beyond one that meet a fragment.
    """
    over = matching.overlaps(grid, "gt", "decoded", ["scan"])
    best = matching.best_matches(over, 0.0, within_anatomy=False, by=["scan"])
    met = over.where("gt > 0 AND pred > 0").groupBy("scan", "gt").agg(F.count(F.lit(1)).alias("met"))
    shares = best.where("best_pred IS NOT NULL").groupBy("scan", F.col("best_pred")).agg(F.count(F.lit(1)).alias("k")).groupBy("scan").agg(F.sum(F.when(F.col("k") > 1, F.col("k")).otherwise(0)).alias("merged"))
    iou = best.join(met, ["scan", "gt"], "left").groupBy("scan").agg(F.avg("iou").alias("iou_f"), F.min("iou").alias("least_iou"), F.count_if(F.col("iou") == 0).alias("unmatched"), F.sum(F.greatest(F.coalesce("met", F.lit(0)) - 1, F.lit(0))).alias("split"))
    on = lambda c: F.col(c).isin(*support)
    counts = grid.groupBy("scan").agg(F.count_if(on("pred") & on("target")).alias("both"), F.count_if(on("pred")).alias("np"), F.count_if(on("target")).alias("nt"), F.count_if((F.col("pred") == barrier) & (F.col("target") == barrier)).alias("tp"), F.count_if((F.col("pred") == barrier) & (F.col("target") != barrier)).alias("fp"), F.count_if((F.col("pred") != barrier) & (F.col("target") == barrier)).alias("fn"), F.count_if(F.col("target") == core).alias("seeds"))
    dice = F.when(F.col("np") + F.col("nt") == 0, 1.0).otherwise(2.0 * F.col("both") / (F.col("np") + F.col("nt")))
    surface = surface_metrics(grid.where(on("pred")), grid.where(on("target")), ["scan"], spacing, tolerance)
    told = fbeta(counts, 0.5).withColumn("support_dice", dice).join(surface, "scan", "left")
    # two empty supports are equal
    same = F.when((F.col("np") == 0) & (F.col("nt") == 0), F.lit(0.0)).otherwise(F.col("hd95"))
    near = F.when((F.col("np") == 0) & (F.col("nt") == 0), F.lit(1.0)).otherwise(F.col("nsd"))
    out = told.join(iou, "scan", "left").join(shares, "scan", "left")
    return out.select("scan", "iou_f", "least_iou", F.coalesce("unmatched", F.lit(0)).alias("unmatched"), F.coalesce("merged", F.lit(0)).alias("merged"), F.coalesce("split", F.lit(0)).alias("split"), "support_dice", same.alias("support_hd95"), near.alias("support_nsd"), F.col("precision").alias("barrier_precision"), F.col("recall").alias("barrier_recall"), F.col("fbeta").alias("barrier_fbeta"), F.col("ratio").alias("barrier_ratio"), "seeds")


def boundary_summary(rows: DataFrame) -> DataFrame:
    """One row: means over scans (distances without null), the least IoU of a scan, and the scans whose target has no core."""
    return rows.agg(F.count(F.lit(1)).alias("scans"), F.avg("iou_f").alias("iou_f_mean"), F.min("iou_f").alias("iou_f_min"), F.avg("support_dice").alias("support_dice_mean"), F.avg("support_hd95").alias("support_hd95_mean"), F.avg("barrier_precision").alias("barrier_precision_mean"), F.avg("barrier_recall").alias("barrier_recall_mean"), F.avg("barrier_ratio").alias("barrier_ratio_mean"), F.count_if(F.col("seeds") == 0).alias("missing_seeds"))


def write_report(rows: DataFrame, summary: DataFrame, path: str) -> None:
    """A report as two JSON tables: path/rows and path/summary."""
    rows.write.mode("overwrite").json(f"{path}/rows")
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
