"""Overlap matching of predicted to true objects, and the metrics on it.

One pass counts voxels by (true, predicted), with map-side partial sums; all else works on that small
table, which has a row for each overlapping pair, not for each voxel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import shipped
from ..functions.registry import anatomy_of


def overlaps(grid: DataFrame, gt: str = "gt", pred: str = "pred", by: list[str] | None = None) -> DataFrame:
    """(by, gt, pred, both): counts of voxel pairs, zeros included."""
    return grid.groupBy(*(by or []), F.col(gt).alias("gt"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("both"))


def iou_pairs(over: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, gt, pred, both, n_gt, n_pred, iou) of pairs of positive ids that overlap. The windows see pairs, not voxels."""
    by = by or []
    sized = over.withColumn("n_gt", F.sum("both").over(Window.partitionBy(*by, "gt"))).withColumn("n_pred", F.sum("both").over(Window.partitionBy(*by, "pred")))
    return sized.where("gt > 0 AND pred > 0").withColumn("iou", F.col("both") / (F.col("n_gt") + F.col("n_pred") - F.col("both")))


def best_matches(over: DataFrame, threshold: float = 0.1, within_anatomy: bool = True, by: list[str] | None = None) -> DataFrame:
    """One row for each true id: its best predicted id (the lowest of equal ones), IoU and whether it reaches the threshold.

    An unmatched id keeps its IoU, with a null predicted id in `matched_pred`.
    """
    by = by or []
    pairs = iou_pairs(over, by)
    if within_anatomy:
        pairs = pairs.where(anatomy_of(F.col("gt")) == anatomy_of(F.col("pred")))
    best = pairs.groupBy(*by, "gt").agg(F.max_by(F.struct("pred", "both", "n_pred", "iou"), F.struct("iou", -F.col("pred"))).alias("b"))
    sizes = over.where("gt > 0").groupBy(*by, "gt").agg(F.sum("both").alias("n_gt"))
    out = sizes.join(best, [*by, "gt"], "left").withColumn("iou", F.coalesce("b.iou", F.lit(0.0))).withColumn("matched", F.col("iou") >= threshold)
    return out.select(*by, "gt", "n_gt", F.col("b.pred").alias("best_pred"), F.when(F.col("matched"), F.col("b.pred")).alias("matched_pred"), F.col("b.both").alias("both"), F.col("b.n_pred").alias("n_pred"), "iou", "matched")


def fragment_rows(grid: DataFrame, threshold: float = 0.1, by: list[str] | None = None) -> DataFrame:
    """One row for each true fragment with its anatomy, scores and split, merge and topology evidence.

    An unmatched fragment counts 0 in IoU and Dice.
    """
    return fragments_of(overlaps(grid, by=by), threshold, by)


def fragments_of(over: DataFrame, threshold: float = 0.1, by: list[str] | None = None) -> DataFrame:
    """fragment_rows from counts of pairs."""
    by = by or []
    best = best_matches(over, threshold, by=by).withColumn("anatomy", anatomy_of(F.col("gt")))
    touching = over.where((F.col("gt") > 0) & (F.col("pred") > 0) & (anatomy_of(F.col("gt")) == anatomy_of(F.col("pred")))).groupBy(*by, "gt").agg(F.count(F.lit(1)).alias("n_touching"))
    uses = Window.partitionBy(*by, "matched_pred")
    out = best.join(touching, [*by, "gt"], "left").withColumn("n_touching", F.coalesce("n_touching", F.lit(0)))
    out = out.withColumn("pred_uses", F.when(F.col("matched"), F.count(F.when(F.col("matched"), 1)).over(uses)))
    return out.withColumns({
        "iou_score": F.when(F.col("matched"), F.col("iou")).otherwise(0.0),
        "dice_score": F.when(F.col("matched"), 2.0 * F.col("both") / (F.col("n_gt") + F.col("n_pred"))).otherwise(0.0),
        "split": F.greatest(F.col("n_touching") - 1, F.lit(0)),
        "clean": (F.col("matched") & (F.col("pred_uses") == 1) & (F.col("n_touching") <= 1)).cast("int"),
    })


def case_metrics(grid: DataFrame, threshold: float = 0.1, by: list[str] | None = None) -> DataFrame:
    """One row for each anatomy with true fragments: the case-level metrics."""
    return cases_of(fragment_rows(grid, threshold, by), grid.select(*(by or []), "pred"), by)


def cases_of(rows: DataFrame, predicted: DataFrame, by: list[str] | None = None) -> DataFrame:
    """case_metrics from fragment rows, and the predicted ids (by, pred) with or without repeats."""
    keys = [*(by or []), "anatomy"]
    # each matched prediction beyond its first true fragment is a merge: assignments less distinct predictions
    agg = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_gt"), F.count_if("matched").alias("tp"), F.count_distinct("matched_pred").alias("used"), F.avg("iou_score").alias("iou"), F.avg("dice_score").alias("dice"), F.sum("split").alias("split_error"), F.avg("clean").alias("topology"))
    preds = predicted.where("pred > 0").select(*(by or []), anatomy_of(F.col("pred")).alias("anatomy"), "pred").groupBy(*keys).agg(F.count_distinct("pred").alias("n_pred"))
    out = agg.join(preds, keys, "left").withColumn("n_pred", F.coalesce("n_pred", F.lit(0)))
    out = out.withColumns({"merge_error": F.col("tp") - F.col("used"), "precision": F.col("tp") / F.greatest(F.col("tp") + F.col("n_pred") - F.col("used"), F.lit(1)), "recall": F.col("tp") / F.greatest(F.col("n_gt"), F.lit(1))})
    return out.withColumn("f1", 2.0 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-8)))


def macro(rows: DataFrame, key: str, means: list[str], sums: list[str]) -> DataFrame:
    """Means that skip null and NaN, and sums, overall (key null) and by key."""
    return rows.rollup(key).agg(*[F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None))).alias(c) for c in means], *[F.sum(c).alias(c) for c in sums])


def many_to_many(over: DataFrame, top: int = 5, low: float = 0.90) -> DataFrame:
    """(gt, best_pred, iou, n_overlaps, merged_with, is_low, largest): the overlaps of each true id as text of the largest ones."""
    pairs = iou_pairs(over)
    best = pairs.groupBy("gt").agg(F.max_by(F.struct("pred", "iou"), F.struct("iou", -F.col("pred"))).alias("b"), F.count(F.lit(1)).alias("n_overlaps"))
    order = Window.partitionBy("gt").orderBy(F.desc("both"), "pred")
    first = pairs.select("gt", "pred", "both").withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= top)  # only these are gathered
    listed = first.groupBy("gt").agg(F.array_sort(F.collect_list(F.struct("_k", F.concat(F.col("pred").cast("string"), F.lit(":"), F.col("both").cast("string")).alias("said")))).alias("l"))
    shares = Window.partitionBy("b.pred")
    shared = best.join(listed, "gt").withColumn("merged_with", F.count(F.lit(1)).over(shares) - 1)
    return shared.select("gt", F.col("b.pred").alias("best_pred"), F.col("b.iou").alias("iou"), "n_overlaps", "merged_with", (F.col("b.iou") < low).alias("is_low"), F.concat_ws(",", F.col("l.said")).alias("largest"))


def majority(over: DataFrame, key: str, vote: str) -> DataFrame:
    """Of each key the vote with most voxels, the lowest of equal ones. over: key, vote, both."""
    return over.groupBy(key).agg(F.max_by(F.struct(vote, "both"), F.struct("both", -F.col(vote))).alias("m")).select(key, f"m.{vote}", "m.both")


def assignment(over: DataFrame, by: str) -> DataFrame:
    """(by, gt, pred, iou): the one-to-one assignment of the largest total IoU in each group, pairs of IoU 0 dropped.

    A group is one case's overlap table: rows are pairs of ids, at most 200 x 200.
    """
    from .kernels import assign

    def solve(pdf):
        g, p = sorted(pdf["gt"].unique()), sorted(pdf["pred"].unique())
        import numpy as np

        m = np.zeros((len(g), len(p)))
        m[np.searchsorted(g, pdf["gt"]), np.searchsorted(p, pdf["pred"])] = pdf["iou"]
        rows = [(pdf[by].iloc[0], g[i], p[j], m[i, j]) for i, j in assign(-m) if m[i, j] > 0]
        import pandas as pd

        return pd.DataFrame(rows, columns=[by, "gt", "pred", "iou"])

    return iou_pairs(over, [by]).select(by, "gt", "pred", "iou").groupBy(by).applyInPandas(shipped(over, solve), f"{by} long, gt long, pred long, iou double")
