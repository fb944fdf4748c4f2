"""Case metrics as the challenge defines them, for all scans at once: eleven for each anatomy, and their macro means.

Small true fragments and small components go first, by volume in mm3. Then fragments are matched within their anatomy, and
matched pairs get their surface distances, each pair being a job of `distance`. No task holds a volume.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import written
from ..functions.registry import anatomy_of, clip_to_valid
from . import matching
from .distance import borders, surface_metrics, to_nearest
from .graph import tiled_components

MEANS = ["iou", "dice", "local_dice", "hd95", "assd", "recall", "precision", "f1", "topology"]
SUMS = ["merge_error", "split_error"]


class Limits(NamedTuple):
    """True fragments under least_fragment mm3 and components under least_component mm3 go; a match has an IoU of threshold
    or more; local Dice looks radius mm around an anatomy's true fragments. Components are labelled in tiles of so many planes."""

    least_fragment: float = 500.0
    least_component: float = 1000.0
    threshold: float = 0.1
    radius: float = 20.0
    planes: int = 64


def voxels_of(mm3: float, spacing) -> int:
    """Voxels that hold a volume, one at least."""
    return max(1, math.ceil(mm3 / math.prod(spacing)))


def pruned(cells: DataFrame, least: int, extent: tuple[int, int], planes: int) -> DataFrame:
    """cells (scan, id, z, y, x) of components, by faces within an id, of at least so many voxels."""
    if least <= 1:
        return cells
    many = 1 << 20
    found = tiled_components(cells.select((F.col("scan") * many + F.col("id")).alias("_of"), "z", "y", "x"), "_of", "true", planes, extent)
    large = found.groupBy("_of", "root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    kept = found.join(large, ["_of", "root"], "left_semi")
    return kept.select(F.expr(f"_of div {many}").alias("scan"), (F.col("_of") % many).alias("id"), "z", "y", "x")


def cleaned(grid: DataFrame, spacing, extent: tuple[int, int], limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """The true and the predicted cells (scan, id, z, y, x) that count, of grid (scan, z, y, x, gt, pred)."""
    cell = lambda c: grid.where(c > 0).select("scan", c.cast("long").alias("id"), "z", "y", "x")
    true, predicted = cell(clip_to_valid(F.col("gt"))), cell(F.col("pred"))
    if limits.least_fragment > 0:
        sizes = true.groupBy("scan", "id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= voxels_of(limits.least_fragment, spacing))
        true = true.join(sizes, ["scan", "id"], "left_semi")
    least = voxels_of(limits.least_component, spacing) if limits.least_component > 0 else 1
    return written(pruned(true, least, extent, limits.planes)), written(pruned(predicted, least, extent, limits.planes))


def local_voxels(true: DataFrame, predicted: DataFrame, pairs: DataFrame, spacing, radius: float) -> DataFrame:
    """(scan, pred, near): of matched predicted ids, the voxels within the radius of any true fragment of the anatomy."""
    keys = ["scan", "anatomy"]
    part = true.withColumn("anatomy", anatomy_of(F.col("id")))
    wanted = pairs.select("scan", F.col("pred").alias("id")).distinct()
    asked = predicted.join(wanted, ["scan", "id"], "left_semi").withColumn("anatomy", anatomy_of(F.col("id")))
    inside = part.select(*keys, "z", "y", "x").withColumn("inside", F.lit(True))
    split = asked.join(inside, [*keys, "z", "y", "x"], "left")
    # the nearest true voxel of one outside lies on the border
    far = to_nearest(split.where("inside IS NULL").select(*keys, "id", "z", "y", "x"), borders(part.select(*keys, "z", "y", "x"), keys), keys, spacing).where(F.col("distance") <= radius)
    near = split.where("inside").select("scan", "id").unionByName(far.select("scan", "id"))
    return near.groupBy("scan", F.col("id").alias("pred")).agg(F.count(F.lit(1)).alias("near"))


def fragment_scores(true: DataFrame, predicted: DataFrame, spacing, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """matching.fragments_of with hd95, assd (null where unmatched) and local_dice added; and the counts of pairs of ids."""
    place = ["scan", "z", "y", "x"]
    both = true.withColumnRenamed("id", "gt").join(predicted.withColumnRenamed("id", "pred"), place, "full_outer").na.fill(0, ["gt", "pred"])
    over = written(matching.overlaps(both, by=["scan"]))
    rows = written(matching.fragments_of(over, limits.threshold, ["scan"]))
    pairs = rows.where("matched").select("scan", "gt", F.col("matched_pred").alias("pred"))
    job = ["scan", "gt", "pred"]
    a = true.withColumnRenamed("id", "gt").join(pairs, ["scan", "gt"]).select(*job, "z", "y", "x")
    b = predicted.withColumnRenamed("id", "pred").join(pairs, ["scan", "pred"]).select(*job, "z", "y", "x")
    surface = surface_metrics(a, b, job, spacing).select("scan", "gt", "hd95", "assd")
    near = local_voxels(true, predicted, pairs, spacing, limits.radius).withColumnRenamed("pred", "matched_pred")
    out = rows.join(surface, ["scan", "gt"], "left").join(near, ["scan", "matched_pred"], "left")
    local = F.when(F.col("matched"), 2.0 * F.col("both") / (F.col("n_gt") + F.coalesce("near", F.lit(0)))).otherwise(0.0)
    return out.withColumn("local_dice", local).drop("near"), over


def official_metrics(grid: DataFrame, spacing=(1.0, 1.0, 1.0), limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """grid (scan, z, y, x, gt, pred) to (scan, anatomy, n_gt, n_pred, tp, fp, fn, MEANS, SUMS): a row for each anatomy with true fragments
    that count. Distances are null where nothing of an anatomy is matched."""
    top = grid.agg(F.coalesce(F.max("y"), F.lit(0)) + 1, F.coalesce(F.max("x"), F.lit(0)) + 1).first()
    true, predicted = cleaned(grid, spacing, tuple(top), limits)
    rows, over = fragment_scores(true, predicted, spacing, limits)
    cases = matching.cases_of(rows, over.select("scan", "pred"), ["scan"])
    more = rows.groupBy("scan", "anatomy").agg(F.avg("hd95").alias("hd95"), F.avg("assd").alias("assd"), F.avg("local_dice").alias("local_dice"))
    out = cases.join(more, ["scan", "anatomy"]).withColumns({"fp": F.col("n_pred") - F.col("used"), "fn": F.col("n_gt") - F.col("tp")})
    return out.select("scan", "anatomy", "n_gt", "n_pred", "tp", "fp", "fn", *MEANS, *SUMS)


def official_macro(cases: DataFrame) -> DataFrame:
    """(scan, anatomies, MEANS, SUMS): means over a scan's present anatomies, without null, and sums."""
    return cases.groupBy("scan").agg(F.count(F.lit(1)).alias("anatomies"), *[F.avg(c).alias(c) for c in MEANS], *[F.sum(c).alias(c) for c in SUMS])


def official_summary(cases: DataFrame) -> DataFrame:
    """(anatomy, samples, MEANS, SUMS): overall (anatomy null) and by anatomy, each (scan, anatomy) being a sample."""
    return cases.rollup("anatomy").agg(F.count(F.lit(1)).alias("samples"), *[F.avg(c).alias(c) for c in MEANS], *[F.sum(c).alias(c) for c in SUMS])
