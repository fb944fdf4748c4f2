"""Forward values of losses as aggregates over (voxel, class) rows; gradients are out of scope."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def class_sums(rows: DataFrame, probs: list[str], target: str) -> DataFrame:
    """(cls, inter, pp, tt, p2): sums over voxels for each class: p * t, p, t and p * p."""
    one = F.explode(F.array(*[F.struct(F.lit(k).alias("cls"), F.col(c).cast("double").alias("p"), (F.col(target) == k).cast("double").alias("t")) for k, c in enumerate(probs)]))
    e = rows.select(one.alias("r")).select("r.*")
    return e.groupBy("cls").agg(F.sum(F.col("p") * F.col("t")).alias("inter"), F.sum("p").alias("pp"), F.sum("t").alias("tt"), F.sum(F.col("p") * F.col("p")).alias("p2"))


def tversky(sums: DataFrame, alpha: float = 0.3, beta: float = 0.7, smooth: float = 1.0) -> DataFrame:
    """(cls, loss): 1 - (TP + s) / (TP + alpha FP + beta FN + s)."""
    i, fp, fn = F.col("inter"), F.col("pp") - F.col("inter"), F.col("tt") - F.col("inter")
    return sums.withColumn("loss", 1 - (i + smooth) / (i + alpha * fp + beta * fn + smooth))


def boundary_overlap(sums: DataFrame, interior: DataFrame, smooth: float = 1e-5) -> DataFrame:
    """(cls, alpha, loss): (z + y - 2i + s) / (z + y - (1 + a) i + s). interior: (cls, n, interior).

    a is 2 * interior / (n + s) - 1, 0.8 at most, and 0 for a class without voxels; classes without
    voxels and with a sum of probabilities below s are left out.
    """
    alpha = F.when(F.col("tt") == 0, F.lit(0.0)).otherwise(F.least(2 * F.coalesce("interior", F.lit(0)) / (F.col("n") + smooth) - 1, F.lit(0.8)))
    j = sums.join(interior, "cls", "left").where((F.col("tt") > 0) | (F.col("pp") >= smooth)).withColumn("alpha", alpha)
    i, zy = F.col("inter"), F.col("p2") + F.col("tt")
    return j.withColumn("loss", (zy - 2 * i + smooth) / (zy - (1 + F.col("alpha")) * i + smooth))


def soft_dice(sums: DataFrame, smooth: float = 1e-5) -> DataFrame:
    return sums.withColumn("dice", (2 * F.col("inter") + smooth) / (F.col("pp") + F.col("tt") + smooth))


def cross_entropy(probs: list[str], target: str, weights: list[float] | None = None) -> Column:
    """Weighted mean of -log p of the true class."""
    chosen = F.element_at(F.array(*[F.col(c).cast("double") for c in probs]), (F.col(target) + 1).cast("int"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in (weights or [1.0] * len(probs))]), (F.col(target) + 1).cast("int"))
    return F.sum(-F.log(F.greatest(chosen, F.lit(1e-12))) * w) / F.sum(w)


def binary_entropy(p: Column, y: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - 1e-7)), F.lit(1e-7))
    return F.when(y, -F.log(q)).otherwise(-F.log(1 - q))


def affinity_loss(rows: DataFrame, p: str, same: str) -> Column:
    """Half the mean over same pairs and half over different ones; a kind without pairs counts 0."""
    e = binary_entropy(F.col(p), F.col(same))
    return 0.5 * (F.coalesce(F.avg(F.when(F.col(same), e)), F.lit(0.0)) + F.coalesce(F.avg(F.when(~F.col(same), e)), F.lit(0.0)))


def marginal_nll(logits: list[str], target: str, labelled: Column) -> Column:
    """-log p of the true class, after unlabelled classes joined the background by logsumexp. labelled: an array of booleans, background first."""
    x = F.array(*[F.col(c).cast("double") for c in logits])
    top = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    folded = F.aggregate(F.zip_with(e, labelled, lambda v, l: F.when(l, 0.0).otherwise(v)), F.lit(0.0), lambda a, v: a + v) + F.when(labelled[0], e[0]).otherwise(F.lit(0.0))
    own = F.element_at(e, (F.col(target) + 1).cast("int"))
    true = F.when((F.col(target) == 0) | ~F.element_at(labelled, (F.col(target) + 1).cast("int")), folded).otherwise(own)
    return -F.log(true / total)


# ------------------------------------------------------------- whole losses, one row for each group


def sums_by(rows: DataFrame, by: list[str], probs: list[str], target: str) -> DataFrame:
    """class_sums for each group (by)."""
    one = F.explode(F.array(*[F.struct(F.lit(k).alias("cls"), F.col(c).cast("double").alias("p"), (F.col(target) == k).cast("double").alias("t")) for k, c in enumerate(probs)]))
    e = rows.select(*by, one.alias("r")).select(*by, "r.*")
    return e.groupBy(*by, "cls").agg(F.sum(F.col("p") * F.col("t")).alias("inter"), F.sum("p").alias("pp"), F.sum("t").alias("tt"), F.sum(F.col("p") * F.col("p")).alias("p2"))


def _own(probs: list[str], target: str) -> Column:
    return F.element_at(F.array(*[F.col(c).cast("double") for c in probs]), (F.col(target) + 1).cast("int"))


def masked_dice_ce(rows: DataFrame, by: list[str], probs: list[str], target: str, valid: str, weights: list[float]) -> DataFrame:
    """(by, ce, dice_loss, loss) over valid rows: the mean of the weighted -log p of the true class (0 without a row), and 1 less the mean
    soft Dice of the classes after the first. The weights scale, they don't divide."""
    ok = rows.where(valid)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col(target) + 1).cast("int"))
    ce = ok.groupBy(*by).agg(F.avg(-F.log(F.greatest(_own(probs, target), F.lit(1e-300))) * w).alias("ce"))
    dice = soft_dice(sums_by(ok, by, probs, target)).where("cls > 0").groupBy(*by).agg((1 - F.avg("dice")).alias("dice_loss"))
    out = rows.select(*by).distinct().join(ce, by, "left").join(dice, by, "left")
    out = out.withColumn("ce", F.coalesce("ce", F.lit(0.0))).withColumn("dice_loss", F.coalesce("dice_loss", F.lit(0.0)))  # empty sums have a Dice of 1
    return out.withColumn("loss", F.col("ce") + F.col("dice_loss"))


def with_affinity(base: DataFrame, pairs: DataFrame, by: list[str], p: str, same: str, weight: float = 1.0) -> DataFrame:
    """base (by, loss) with `affinity`, half the mean over all same pairs and half over all different ones of a group, and `total`."""
    a = pairs.groupBy(*by).agg(affinity_loss(pairs, p, same).alias("affinity"))
    return base.join(a, by, "left").withColumn("affinity", F.coalesce("affinity", F.lit(0.0))).withColumn("total", F.col("loss") + weight * F.col("affinity"))


def compound(sums: DataFrame, by: list[str], ce: DataFrame, interior: DataFrame | None = None, weights=(1.0, 0.0, 0.0), alpha: float = 0.3, beta: float = 0.7, active: list[int] | None = None, class_weights: dict[int, float] | None = None, smooth: float = 1e-5) -> DataFrame:
    """(by, dc_ce, tversky, boundary, loss): weights times cross entropy less mean Dice, Tversky, and the boundary overlap.

    sums: (by, cls, inter, pp, tt, p2), ce: (by, ce), interior: (by, cls, n, interior). Dice and the boundary take the classes after the first,
    Tversky the active ones (by default the same), weighted; classes without voxels and with hardly any probability are left out of both.
    """
    fg, there = F.col("cls") > 0, (F.col("tt") > 0) | (F.col("pp") >= smooth)
    dice = soft_dice(sums, smooth).where(fg).groupBy(*by).agg(F.avg("dice").alias("dice"))
    w = reduce(lambda c, x: c.when(F.col("cls") == x[0], F.lit(float(x[1]))), (class_weights or {}).items(), F.when(F.lit(False), F.lit(1.0))).otherwise(1.0)
    chosen = tversky(sums, alpha, beta, smooth).where((F.col("cls").isin(active) if active is not None else fg) & there)
    tv = chosen.groupBy(*by).agg((F.sum(F.col("loss") * w) / F.sum(w)).alias("tversky"))
    out = ce.join(dice, by, "left").join(tv, by, "left").withColumn("dc_ce", F.col("ce") - F.col("dice")).withColumn("tversky", F.coalesce("tversky", F.lit(0.0)))
    if interior is not None:
        share = F.when(F.col("tt") == 0, F.lit(0.0)).otherwise(F.least(2 * F.coalesce("interior", F.lit(0)) / (F.col("n") + smooth) - 1, F.lit(0.8)))
        i, zy = F.col("inter"), F.col("p2") + F.col("tt")
        bd = sums.where(fg & there).join(interior, [*by, "cls"], "left").withColumn("l", (zy - 2 * i + smooth) / (zy - (1 + share) * i + smooth)).groupBy(*by).agg(F.avg("l").alias("boundary"))
        out = out.join(bd, by, "left")
    out = out.withColumn("boundary", F.coalesce("boundary", F.lit(0.0))) if interior is not None else out.withColumn("boundary", F.lit(0.0))
    return out.select(*by, "dc_ce", "tversky", "boundary", (weights[0] * F.col("dc_ce") + weights[1] * F.col("tversky") + weights[2] * F.col("boundary")).alias("loss"))


def marginal_loss(rows: DataFrame, sample: str, logits: list[str], target: str, labelled: str, smooth: float = 1e-5) -> DataFrame:
    """One row (ce, dice, loss): cross entropy with a sample's unlabelled classes folded into the background, less the mean Dice of the
    labelled classes after the first, each sample counting for itself. labelled: an array of booleans, background first."""
    x = [F.col(c).cast("double") for c in logits]
    top = F.greatest(*x)
    total = reduce(lambda a, b: a + b, [F.exp(v - top) for v in x])
    soft = rows.withColumns({f"_p{k}": F.exp(v - top) / total for k, v in enumerate(x)})
    ce = soft.agg(F.avg(marginal_nll(logits, target, F.col(labelled))).alias("ce"))
    named = sums_by(soft, [sample], [f"_p{k}" for k in range(len(logits))], target).join(rows.groupBy(sample).agg(F.first(labelled).alias("_l")), sample)
    dice = soft_dice(named, smooth).where((F.col("cls") > 0) & F.element_at("_l", (F.col("cls") + 1).cast("int"))).agg(F.coalesce(F.avg("dice"), F.lit(0.0)).alias("dice"))
    return ce.join(dice).withColumn("loss", F.col("ce") - F.col("dice"))  # one row each


def patch_scores(patches: DataFrame) -> DataFrame:
    """One row (iou_f, recall, precision, f1) of patches' scores: means, and the F1 of the means."""
    m = patches.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("iou_f", "recall", "precision")])
    return m.withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-8)))
