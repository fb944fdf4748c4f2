"""Queries of evaluation drivers, validation rounds, expert folds and selection modes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.registry import anatomy_of
from ..operators import decode_targets as DT
from ..operators import losses as LO
from ..operators import matching as M
from ..operators import ranking as R
from ..operators import surfaces as SU
from ..operators import targets as T
from ..operators.decode import dense
from ..operators import evaluation as EV
from ..operators import official as O
from ..session import load
from ..sources import fixtures as X
from .base import INST_B, VOX, query
from .match_queries import _OVER, _PAIRS
from .official_queries import _edge, _scores


@query("component_modes", "anatomy:l largest:l floor:l union_:l", """
    WITH s AS (SELECT l_suppkey % 4 AS anatomy, l_partkey AS id, count(*) AS n FROM lineitem GROUP BY 1, 2), m AS (SELECT anatomy, max(n) AS m, sum(n) AS u, sum(n) FILTER (n >= 12) AS f FROM s GROUP BY 1)
    SELECT anatomy, m AS largest, COALESCE(f, m) AS floor, u AS union_ FROM m""")
def component_modes(spark, sf):
    """Voxels kept of each anatomy's components: the largest one; those over a floor, or the largest; all."""
    s = load(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 4).alias("anatomy"), "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return s.groupBy("anatomy").agg(F.max("n").alias("largest"), F.coalesce(F.sum(F.when(F.col("n") >= 12, F.col("n"))), F.max("n")).alias("floor"), F.sum("n").alias("union_"))


@query("expert_folds", "fold:l side:s n:l patients:l", """
    SELECT f AS fold, CASE WHEN c % 5 = f THEN 'val' ELSE 'train' END AS side, count(*) AS n, count(DISTINCT c) AS patients
    FROM (SELECT c_custkey * 7919 AS c FROM customer WHERE c_nationkey % 4 IN (1, 2)), (SELECT unnest(range(0, 5)) AS f) GROUP BY 1, 2""")
def expert_folds(spark, sf):
    """Both sides of every fold, kept to one expert's samples by their names."""
    c = load(spark, sf, "customer").selectExpr("c_custkey", "concat('CASE_', c_custkey, '_', element_at(array('Sacrum', 'LeftHip', 'RightHip', 'Femur'), c_nationkey % 4 + 1)) name")
    s = R.splits(c, R.folds(c, "c_custkey"), "c_custkey").where(S.is_expert(F.col("name"), ("LeftHip", "RightHip")))
    return s.groupBy("fold", "side").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("c_custkey").alias("patients"))


_PATCHES = f"""
    WITH {VOX}, {INST_B.replace('inst AS', 'i0 AS')}, inst AS (SELECT * FROM i0), per AS (SELECT slab, gt, pred, count(*) AS overlap FROM inst GROUP BY 1, 2, 3),
    g AS (SELECT slab, gt, sum(overlap) AS n FROM per WHERE gt > 0 GROUP BY 1, 2), p AS (SELECT slab, pred, sum(overlap) AS n FROM per WHERE pred > 0 GROUP BY 1, 2),
    b AS (SELECT g.slab, g.gt, per.pred, COALESCE(per.overlap / CAST(g.n + p.n - per.overlap AS DOUBLE), 0) AS iou, row_number() OVER (PARTITION BY g.slab, g.gt ORDER BY COALESCE(per.overlap / CAST(g.n + p.n - per.overlap AS DOUBLE), 0) DESC, per.pred) AS r
        FROM g LEFT JOIN per ON per.slab = g.slab AND per.gt = g.gt AND per.pred > 0 LEFT JOIN p ON p.slab = per.slab AND p.pred = per.pred),
    s AS (SELECT slab, avg(iou) AS iou_f, avg(CASE WHEN iou >= 0.5 THEN 1.0 ELSE 0.0 END) AS recall, count(DISTINCT CASE WHEN iou >= 0.5 THEN pred END) AS used FROM b WHERE r = 1 GROUP BY 1)
    SELECT s.slab AS patch, iou_f, recall, used / CAST(greatest(k, 1) AS DOUBLE) AS precision FROM s LEFT JOIN (SELECT slab, count(*) AS k FROM p GROUP BY 1) k ON k.slab = s.slab"""


@query("patch_validation", "patch:l iou_f:d recall:d precision:d", _PATCHES)
def patch_validation(spark, sf):
    """Of each patch: mean best IoU, the share of true ids over 0.5, and distinct predictions so matched over all predictions."""
    over = M.overlaps(X.instances_b(spark, sf), by=["slab"])
    best = M.best_matches(over, 0.5, within_anatomy=False, by=["slab"])
    preds = over.where("pred > 0").groupBy("slab").agg(F.count_distinct("pred").alias("k"))
    s = best.groupBy("slab").agg(F.avg("iou").alias("iou_f"), F.avg(F.col("matched").cast("int")).alias("recall"), F.count_distinct("matched_pred").alias("used"))
    return s.join(preds, "slab", "left").select(F.col("slab").alias("patch"), "iou_f", "recall", (F.col("used") / F.greatest(F.coalesce("k", F.lit(0)), F.lit(1))).alias("precision"))


@query("greedy_iou_summary", "mean:d least:d missing:l tiny:l", f"""
    WITH {VOX}, {INST_B}, {_OVER}, {_PAIRS}, ids AS (SELECT gt, sum(overlap) AS n FROM over_ WHERE gt > 0 GROUP BY 1), b AS (SELECT ids.gt, ids.n, COALESCE(max(iou), 0) AS iou FROM ids LEFT JOIN pairs ON pairs.gt = ids.gt GROUP BY 1, 2)
    SELECT avg(iou) AS mean, min(iou) AS least, count(*) FILTER (iou = 0) AS missing, count(*) FILTER (n < 1000) AS tiny FROM b""")
def greedy_iou_summary(spark, sf):
    b = M.best_matches(M.overlaps(X.instances_b(spark, sf)), 0.0, within_anatomy=False)
    return b.agg(F.avg("iou").alias("mean"), F.min("iou").alias("least"), F.count_if(F.col("iou") == 0).alias("missing"), F.count_if(F.col("n_gt") < 1000).alias("tiny"))


@query("barrier_oracle_eval", "slab:l fragments:l decoded:l iou:d missing_barrier:l extra_barrier:l")
def barrier_oracle_eval(spark, sf):
    """The decoder on targets made of the truth: how much of it comes back, and barrier voxels outside the true contact."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c, _ = dense(pdf, ["gt"])
        inst = T.valid(c[0].astype(np.int64))
        target, audit = T.barrier_target(inst, shell=1.5)
        out = DT.barrier(target)
        ious = []
        for g in np.unique(inst[inst > 0]):
            own = inst == g
            ious.append(max((float((own & (out == p)).sum() / (own | (out == p)).sum()) for p in np.unique(out[own & (out > 0)])), default=0.0))
        contact = T.touching(inst, [(1, 0, 0), (0, 1, 0), (0, 0, 1)], False)
        return pd.DataFrame([(pdf["slab"].iloc[0], audit["fragments"], int(len(np.unique(out[out > 0]))), float(np.mean(ious)) if ious else None, int((contact & (target != 2)).sum()), int((~contact & (target == 2)).sum()))], columns=["slab", "fragments", "decoded", "iou", "missing_barrier", "extra_barrier"])

    return X.instances_b(spark, sf).groupBy("slab").applyInPandas(run, "slab long, fragments long, decoded long, iou double, missing_barrier long, extra_barrier long")


@query("volume_sink", "anatomy:l ids:l voxels:l", f"WITH {VOX}, {INST_B} SELECT CASE WHEN gt BETWEEN 1 AND 200 THEN (gt - 1) // 50 + 1 ELSE 0 END AS anatomy, count(DISTINCT gt) AS ids, count(*) AS voxels FROM inst GROUP BY 1")
def volume_sink(spark, sf):
    """A whole volume written and read back."""
    from ..cluster import written

    g = X.instances_b(spark, sf).select("z", "y", "x", "gt", anatomy_of(F.col("gt")).alias("anatomy"))
    return written(g).groupBy("anatomy").agg(F.count_distinct("gt").alias("ids"), F.count(F.lit(1)).alias("voxels"))


@query("surface_prune_pipeline", "slab:l before:l after:l")
def surface_prune_pipeline(spark, sf):
    """Predicted voxels before and after components under five voxels go."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c, _ = dense(pdf, ["pred"])
        p = c[0].astype(np.int64)
        return pd.DataFrame([(pdf["slab"].iloc[0], int((p > 0).sum()), int((SU.prune_components(p, 5) > 0).sum()))], columns=["slab", "before", "after"])

    return X.instances_b(spark, sf).groupBy("slab").applyInPandas(run, "slab long, before long, after long")


#: What a model said of a sample: 10 planes of 8 x 8 voxels, each fifth plane's values.
_SAID = (10, 8, 8)
SPACING = (0.8, 1.0, 1.5)


def _region_takes(axis: str, n: int) -> str:
    """Of each sample's region, along an axis: output place, input place, weight, corner on corner."""
    c = f"(o * {n - 1} / CAST(greatest({axis}1 - {axis}0 - 1, 1) AS DOUBLE))"
    return f"""t{axis} AS (SELECT sample, o, least(i, {n - 1}) AS i, sum(w) AS w FROM (SELECT sample, o, floor({c}) AS i, 1 - ({c} - floor({c})) AS w FROM (SELECT *, unnest(range(0, {axis}1 - {axis}0)) AS o FROM box) UNION ALL SELECT sample, o, floor({c}) + 1, {c} - floor({c}) FROM (SELECT *, unnest(range(0, {axis}1 - {axis}0)) AS o FROM box)) GROUP BY 1, 2, 3)"""


_HELD_OUT = f"""WITH {VOX}, {INST_B}, i AS (SELECT slab, z - slab * 50 AS z, y, x, v, gt, (gt - 1) // 50 + 1 AS anatomy, slab * 5 + (gt - 1) // 50 + 1 AS sample FROM inst),
    g AS (SELECT sample AS scan, gt AS id, slab, z, y, x FROM i WHERE gt > 0), box AS (SELECT scan AS sample, any_value(slab) AS slab, count(*) AS n, {', '.join(f'greatest(min({a}) - 2, 0) AS {a}0, least(max({a}) + 3, {n}) AS {a}1' for a, n in zip('zyx', (50, 8, 8), strict=True))} FROM g GROUP BY 1),
    said AS (SELECT box.sample, i.z // 5 AS z, i.y, i.x, 0.5 - i.v + (box.sample % 5) * 0.02 AS p0, 0.5 + i.v AS p1 FROM box JOIN i ON i.slab = box.slab WHERE i.z % 5 = 0 AND box.sample % 7 <> 6),
    plan AS (SELECT box.sample, count(*) FILTER (p0 < 0.5) / CAST(any_value(n) AS DOUBLE) AS support FROM box JOIN said ON said.sample = box.sample GROUP BY 1),
    {', '.join(_region_takes(a, n) for a, n in zip('zyx', _SAID, strict=True))},
    r AS (SELECT said.sample, tz.o AS z, ty.o AS y, tx.o AS x, sum(p0 * tz.w * ty.w * tx.w) AS p0, sum(p1 * tz.w * ty.w * tx.w) AS p1 FROM said JOIN plan ON plan.sample = said.sample AND support <= 0.55 JOIN tz ON tz.sample = said.sample AND tz.i = said.z JOIN ty ON ty.sample = said.sample AND ty.i = said.y JOIN tx ON tx.sample = said.sample AND tx.i = said.x GROUP BY 1, 2, 3, 4),
    p AS (SELECT r.sample AS scan, (r.sample % 5 - 1) * 50 + 1 + r.z // 12 AS id, r.z + z0 AS z, r.y + y0 AS y, r.x + x0 AS x FROM r JOIN box ON box.sample = r.sample WHERE round(p1 / greatest(p0 + p1, 1e-8), 9) > 0.5),
    {_scores(2.5)}"""


@query("held_out_evaluation", "sample:l anatomy:l support:d decoded:b " + " ".join(f"{c}:d" for c in O.MEANS) + " merge_error:l split_error:l", f"""
    {_HELD_OUT} SELECT box.sample, box.sample % 5 AS anatomy, support, COALESCE(support <= 0.55, false) AS decoded, {', '.join(O.MEANS)}, COALESCE(merge_error, 0) AS merge_error, COALESCE(split_error, 0) AS split_error FROM box LEFT JOIN plan ON plan.sample = box.sample LEFT JOIN cases ON cases.scan = box.sample""")
def held_out_evaluation(spark, sf):
    """Samples of a fold, each scored alone; one in seven has no prediction, and some are too loose to decode."""
    g = X.instances_b(spark, sf).withColumn("scan", F.col("slab")).withColumn("z", F.col("z") - F.col("slab") * 50).withColumn("anatomy", anatomy_of(F.col("gt")))
    samples = g.where("gt > 0").select("scan", "anatomy").distinct().withColumn("sample", F.col("scan") * 5 + F.col("anatomy"))
    scans = g.select("scan").distinct().selectExpr("scan", "50L nz", "8L ny", "8L nx")
    said = g.where("z % 5 = 0").select("scan", F.expr("z div 5").alias("z"), "y", "x", "v").join(samples.where("sample % 7 <> 6"), "scan").selectExpr("sample", "z", "y", "x", "0.5D - v + (sample % 5) * 0.02D p0", "0.5D + v p1")
    decode = lambda r: r.where("round(p1, 9) > 0.5D").selectExpr("sample", "z", "y", "x", "1 + z div 12 piece")
    return EV.held_out(samples, g.select("scan", "z", "y", "x", "gt"), scans, said, ["p0", "p1"], decode, SPACING, O.Limits(0.0, 0.0, 0.1, 2.5), pad=2, most_support=0.55, shape=_SAID)


_TARGET = "CASE WHEN {v} > 0.2 THEN 4 WHEN {v} > 0.05 THEN 3 WHEN {v} > 0 THEN 2 WHEN {v} > -0.1 THEN 1 ELSE 0 END"
_BOUNDARY = f"""WITH {VOX}, {INST_B}, i AS (SELECT slab AS scan, z - slab * 50 AS z, y, x, gt, pred AS decoded, {_TARGET.format(v='v')} AS target, {_TARGET.format(v='(v - (x - 3) * 0.01)')} AS label FROM inst),
    over_ AS (SELECT scan, gt, decoded, count(*) AS n FROM i GROUP BY ALL), gn AS (SELECT scan, gt, sum(n) AS n FROM over_ WHERE gt > 0 GROUP BY ALL), dn AS (SELECT scan, decoded, sum(n) AS n FROM over_ WHERE decoded > 0 GROUP BY ALL),
    u AS (SELECT o.scan, o.gt, o.decoded, o.n / CAST(gn.n + dn.n - o.n AS DOUBLE) AS iou FROM over_ o JOIN gn ON gn.scan = o.scan AND gn.gt = o.gt JOIN dn ON dn.scan = o.scan AND dn.decoded = o.decoded),
    b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY scan, gt ORDER BY iou DESC, decoded) = 1), k AS (SELECT scan, sum(CASE WHEN c > 1 THEN c ELSE 0 END) AS merged FROM (SELECT scan, decoded, count(*) AS c FROM b GROUP BY 1, 2) GROUP BY 1),
    f AS (SELECT gn.scan, avg(COALESCE(iou, 0)) AS iou_f, min(COALESCE(iou, 0)) AS least_iou, count(*) FILTER (COALESCE(iou, 0) = 0) AS unmatched, sum(greatest((SELECT count(*) FROM u WHERE u.scan = gn.scan AND u.gt = gn.gt) - 1, 0)) AS split FROM gn LEFT JOIN b ON b.scan = gn.scan AND b.gt = gn.gt GROUP BY 1),
    sa AS (SELECT scan, z, y, x FROM i WHERE label >= 2), sb AS (SELECT scan, z, y, x FROM i WHERE target >= 2), ea AS ({_edge('sa', 'scan')}), eb AS ({_edge('sb', 'scan')}),
    d AS (SELECT a.scan, sqrt(min(0.64 * (a.z - b.z) ** 2 + (a.y - b.y) ** 2 + 2.25 * (a.x - b.x) ** 2)) AS d FROM ea a JOIN eb b ON b.scan = a.scan GROUP BY a.scan, a.z, a.y, a.x UNION ALL SELECT a.scan, sqrt(min(0.64 * (a.z - b.z) ** 2 + (a.y - b.y) ** 2 + 2.25 * (a.x - b.x) ** 2)) FROM eb a JOIN ea b ON b.scan = a.scan GROUP BY a.scan, a.z, a.y, a.x),
    h AS (SELECT scan, quantile_cont(d, 0.95) AS support_hd95, avg(CASE WHEN d <= 2 THEN 1 ELSE 0 END) AS support_nsd FROM d GROUP BY 1),
    c AS (SELECT scan, count(*) FILTER (label >= 2 AND target >= 2) AS both_, count(*) FILTER (label >= 2) AS np, count(*) FILTER (target >= 2) AS nt, count(*) FILTER (label = 2 AND target = 2) AS tp, count(*) FILTER (label = 2) AS p2, count(*) FILTER (target = 2) AS t2, count(*) FILTER (target = 4) AS seeds FROM i GROUP BY 1),
    e AS (SELECT c.scan, iou_f, least_iou, unmatched, COALESCE(merged, 0) AS merged, split, 2.0 * both_ / (np + nt) AS support_dice, support_hd95, support_nsd, tp / CAST(greatest(p2, 1) AS DOUBLE) AS barrier_precision, tp / CAST(greatest(t2, 1) AS DOUBLE) AS barrier_recall, p2 / CAST(greatest(t2, 1) AS DOUBLE) AS barrier_ratio, seeds
        FROM c LEFT JOIN f ON f.scan = c.scan LEFT JOIN k ON k.scan = c.scan LEFT JOIN h ON h.scan = c.scan)"""


def _boundary(spark, sf):
    t, p = _TARGET.format(v="v").replace("0.2 ", "0.2D ").replace("0.05", "0.05D").replace("0.1 ", "0.1D "), _TARGET.format(v="(v - (x - 3) * 0.01D)").replace("0.2 ", "0.2D ").replace("0.05", "0.05D").replace("0.1 ", "0.1D ")
    return EV.boundary(X.instances_b(spark, sf).selectExpr("slab scan", "z - slab * 50 z", "y", "x", "gt", "pred decoded", f"{t} target", f"{p} pred"), SPACING)


@query("boundary_evaluation", "scan:l iou_f:d least_iou:d unmatched:l merged:l split:l support_dice:d support_hd95:d support_nsd:d barrier_precision:d barrier_recall:d barrier_fbeta:d barrier_ratio:d seeds:l", f"""
    {_BOUNDARY} SELECT *, 1.25 * barrier_precision * barrier_recall / greatest(0.25 * barrier_precision + barrier_recall, 1e-8) AS barrier_fbeta FROM e""")
def boundary_evaluation(spark, sf):
    return _boundary(spark, sf)


@query("boundary_summary", "scans:l iou_f_mean:d iou_f_min:d support_dice_mean:d support_hd95_mean:d barrier_precision_mean:d barrier_recall_mean:d barrier_ratio_mean:d missing_seeds:l", f"""
    {_BOUNDARY} SELECT count(*) AS scans, avg(iou_f) AS iou_f_mean, min(iou_f) AS iou_f_min, avg(support_dice) AS support_dice_mean, avg(support_hd95) AS support_hd95_mean, avg(barrier_precision) AS barrier_precision_mean, avg(barrier_recall) AS barrier_recall_mean, avg(barrier_ratio) AS barrier_ratio_mean, count(*) FILTER (seeds = 0) AS missing_seeds FROM e""")
def boundary_summary(spark, sf):
    return EV.boundary_summary(_boundary(spark, sf))


@query("patch_scores", "iou_f:d recall:d precision:d f1:d", f"SELECT iou_f, recall, precision, 2 * precision * recall / greatest(precision + recall, 1e-8) AS f1 FROM (SELECT avg(iou_f) AS iou_f, avg(recall) AS recall, avg(precision) AS precision FROM ({_PATCHES}) AS p) AS m")
def patch_scores(spark, sf):
    """Validation of an epoch: means over patches, and the F1 of the means."""
    return LO.patch_scores(patch_validation(spark, sf))
