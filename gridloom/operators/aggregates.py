"""Aggregations: percentiles, overlap scores, weights, features, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.registry import anatomy_name, anatomy_of

PERCENTS = (0.5, 1, 5, 25, 50, 75, 95, 99, 99.5)


def robust_percentiles(df: DataFrame, value: str, by: list[str] | None = None, percents=PERCENTS) -> DataFrame:
    """Exact percentiles with linear interpolation, one row a group, as columns p1 to pN."""
    arr = df.groupBy(*(by or [])).agg(F.percentile(F.col(value), F.array(*[F.lit(q / 100) for q in percents])).alias("p"))
    return arr.select(*(by or []), *[F.col("p")[k].alias(f"p{k + 1}") for k in range(len(percents))])


def confusion(pred: Column, target: Column) -> list[Column]:
    """tp, fp, fn as aggregates."""
    return [F.count_if(pred & target).alias("tp"), F.count_if(pred & ~target).alias("fp"), F.count_if(~pred & target).alias("fn")]


def ratio(num: Column, den: Column, empty: float | None = 1.0) -> Column:
    return F.when(den == 0, F.lit(empty)).otherwise(num / den)


def mask_scores(counts: DataFrame) -> DataFrame:
    """Adds Dice, IoU, precision and recall to tp, fp, fn; an empty denominator gives 1."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({"dice": ratio(2 * tp, 2 * tp + fp + fn), "iou": ratio(tp, tp + fp + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "dice_distance": 1 - ratio(2 * tp, 2 * tp + fp + fn)})


def fbeta(counts: DataFrame, beta: float = 1.0) -> DataFrame:
    """Adds precision and recall with denominators of 1 at least, F-beta with 1e-8, and predicted over target."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r, b = tp / F.greatest(tp + fp, F.lit(1)), tp / F.greatest(tp + fn, F.lit(1)), beta * beta
    return counts.withColumns({"precision": p, "recall": r, "fbeta": (1 + b) * p * r / F.greatest(b * p + r, F.lit(1e-8)), "ratio": (tp + fp) / F.greatest(tp + fn, F.lit(1))})


def inverse_weights(df: DataFrame, cls: str, low: float = 0.5, high: float = 2.0, smoothing: float = 1.0) -> DataFrame:
    """(cls, n, weight): smoothed inverse frequencies over their mean, clipped. The window sees one row a class."""
    n = df.groupBy(cls).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()
    inv = n.withColumn("inv", F.sum(F.col("n") + smoothing).over(every) / (F.col("n") + smoothing))
    return inv.select(cls, "n", F.greatest(F.least(F.col("inv") / F.avg("inv").over(every), F.lit(high)), F.lit(low)).alias("weight"))


def median_weights(df: DataFrame, cls: str, low: float = 0.5, high: float = 2.0, smoothing: float = 1.0) -> DataFrame:
    """(cls, n, weight): the median frequency over a class's own, clipped."""
    n = df.groupBy(cls).agg(F.count(F.lit(1)).alias("n"))
    f = n.withColumn("f", F.col("n") + smoothing)
    return f.select(cls, "n", F.greatest(F.least(F.median("f").over(Window.partitionBy()) / F.col("f"), F.lit(high)), F.lit(low)).alias("weight"))


def centroids(grid: DataFrame, label: str, spacing=(1.0, 1.0, 1.0)) -> DataFrame:
    """(label, n, cz, cy, cx) in units of spacing."""
    return grid.where(F.col(label) > 0).groupBy(label).agg(F.count(F.lit(1)).alias("n"), *[(F.avg(a) * s).alias(f"c{a}") for a, s in zip("zyx", spacing)])


def fragments(grid: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """(by, label, name, n, z0 to x1): voxels and half-open box of each positive id, with its anatomy's name or Unknown."""
    edges = [e for a in "zyx" for e in (F.min(a).alias(f"{a}0"), (F.max(a) + 1).alias(f"{a}1"))]
    rows = grid.where(F.col(label) > 0).groupBy(*(by or []), label).agg(F.count(F.lit(1)).alias("n"), *edges)
    return rows.withColumn("name", F.coalesce(anatomy_name(anatomy_of(F.col(label))), F.lit("Unknown")))


def every_id(spark, stats: DataFrame, label: str, last: int = 200) -> DataFrame:
    """stats with a row for each id from 0 to last: absent ones have n = 0 and null places."""
    return spark.range(last + 1).select(F.col("id").alias(label)).join(stats, label, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def mean_skip(value: Column) -> Column:
    """Mean without null and NaN; null if nothing is left."""
    return F.avg(F.when(~F.isnan(value), value))


def ray_winner(grid: DataFrame, label: str, ray: list[str]) -> DataFrame:
    """(ray, top, main): the largest id along a ray, and its most frequent positive one (the lowest of equal ones)."""
    n = grid.groupBy(*ray, label).agg(F.count(F.lit(1)).alias("n"))
    main = F.max_by(F.when(F.col(label) > 0, F.col(label)), F.when(F.col(label) > 0, F.struct("n", -F.col(label))))
    return n.groupBy(*ray).agg(F.max(label).alias("top"), F.coalesce(main, F.lit(0)).alias("main"))


def separation_evidence(grid: DataFrame, mask: Column, affinities: list[list[str]]) -> list[Column]:
    """For each range the mean over the mask of the largest 1 - affinity; 0 for an empty mask."""
    return [F.coalesce(F.avg(F.when(mask, F.greatest(*[1.0 - F.col(c) for c in group]))), F.lit(0.0)) for group in affinities]
