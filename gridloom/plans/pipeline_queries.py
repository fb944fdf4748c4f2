"""Queries of composed plans: the scan pipeline, held-out evaluation, the split gate, routing by an injected model."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.registry import anatomy_of
from ..operators import decode as D
from ..operators import heal as H
from ..operators import gate as G
from ..operators import scans as P
from ..sources import fixtures as X
from .base import INST_B, VOX, query
from .block_queries import _affinities, _classes, _sizes


def _regions(spark, sf):
    """Scan and anatomy regions: the true anatomy's voxels of a slab, and their values."""
    g = X.instances_b(spark, sf).where("gt > 0")
    return g.select(F.col("slab").alias("scan"), anatomy_of(F.col("gt")).alias("anatomy"), "z", "y", "x", "v", "gt")


@query("scan_pipeline", "scan:l anatomy:l ids:l voxels:l")
def scan_pipeline(spark, sf):
    out = P.instance_map(_regions(spark, sf), ["v"], lambda c: np.where(c[0] > 0, D.core_seed(_classes(c), least=3), 0), 3)
    return out.groupBy("scan", anatomy_of(F.col("id")).alias("anatomy")).agg(F.count_distinct("id").alias("ids"), F.count(F.lit(1)).alias("voxels"))


@query("held_out_scores", "scan:l anatomy:l n_gt:l tp:l iou:d split_error:l")
def held_out_scores(spark, sf):
    r = _regions(spark, sf)
    return P.held_out_scores(r, r.select("scan", "z", "y", "x", "gt"), ["v"], lambda c: (c[0] > 0).astype(int))


class _Line:
    """A regressor by rule: stands for a forest, which isn't available."""

    def __init__(self, at: float, slope: float = 0.0):
        self.at, self.slope = at, slope

    def predict(self, x):
        return self.at + self.slope * np.asarray(x)[:, 0]


_PAYLOAD = {"models": {"delta_merge": _Line(-0.8, 0.1), "delta_split": _Line(1.0), "delta_dice": _Line(0.01), "delta_f1": _Line(0.0), "delta_precision": _Line(0.0)}, "feature_names": ["isolated_piece_fraction", "centroid_distance_mm"], "policy": {"action": "select", "merge_max": -0.55, "split_max": 2.25}, "quality_guards": {"delta_dice_min": -0.01, "delta_f1_min": -0.05, "delta_precision_min": -0.10}}


#: The rule's best candidate is the smallest share that a piece has of its source.
_SPLIT_GATE = f"""
    WITH {VOX}, {INST_B},
    g AS (SELECT slab AS vol, z, y, x, gt AS base, pred AS proposal, (gt - 1) // 50 AS a FROM inst WHERE gt > 0),
    p AS (SELECT vol, a, base, proposal, count(*) AS n, sum(z) AS sz, sum(y) AS sy, sum(x) AS sx FROM g WHERE proposal > 0 AND (proposal - 1) // 50 = a GROUP BY ALL),
    t AS (SELECT vol, base, count(*) AS t_n, sum(z) AS tz, sum(y) AS ty, sum(x) AS tx FROM g GROUP BY ALL),
    r AS (SELECT *, count(*) OVER (PARTITION BY vol, base) AS k, row_number() OVER (PARTITION BY vol, base ORDER BY n, proposal) AS nth FROM p JOIN t USING (vol, base)),
    c AS (SELECT *, n > t_n - n AS inv, least(n, t_n - n) AS piece FROM r WHERE k > 2 OR (k = 2 AND nth = 1)),
    d AS (SELECT *, row_number() OVER (PARTITION BY vol, base, piece, CASE WHEN inv THEN tz - sz ELSE sz END, CASE WHEN inv THEN ty - sy ELSE sy END, CASE WHEN inv THEN tx - sx ELSE sx END ORDER BY n DESC, proposal) AS copy FROM c WHERE piece >= 20 AND t_n - piece >= 20),
    s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vol, base ORDER BY -0.8 + 0.1 * (piece / t_n), proposal) AS best FROM d WHERE copy = 1) WHERE best = 1),
    f AS (SELECT v.vol, (i - 1) // 50 AS a, i AS id, row_number() OVER (PARTITION BY v.vol, (i - 1) // 50 ORDER BY i) AS k FROM (SELECT DISTINCT vol FROM s) AS v, (SELECT unnest(range(1, 201)) AS i) WHERE (v.vol, i) NOT IN (SELECT vol, base FROM g)),
    w AS (SELECT s.vol, s.base, s.proposal, s.inv, f.id FROM (SELECT *, row_number() OVER (PARTITION BY vol, a ORDER BY base) AS k2 FROM s) AS s JOIN f ON f.vol = s.vol AND f.a = s.a AND f.k = s.k2)
    SELECT vol, base, count(*) AS n FROM (SELECT g.vol, CASE WHEN w.id IS NOT NULL AND (g.proposal = w.proposal) <> w.inv THEN w.id ELSE g.base END AS base FROM g LEFT JOIN w ON w.vol = g.vol AND w.base = g.base) GROUP BY ALL"""


@query("split_gate", "vol:l base:l n:l", _SPLIT_GATE)
def split_gate(spark, sf):
    g = X.instances_b(spark, sf).where("gt > 0").selectExpr("slab vol", "z", "y", "x", "gt base", "pred proposal", "v ct")
    return G.run_gate(g, _PAYLOAD, 20).groupBy("vol", "base").agg(F.count(F.lit(1)).alias("n"))


class _Family:
    def predict_proba(self, x):
        p = 1 / (1 + np.exp(-40 * x[:, 0]))
        return np.stack([1 - p, p], 1)


@query("family_by_model", "slab:l family:s p_femur:d routed:s why:s")
def family_by_model(spark, sf):
    f = X.vox(spark, sf).groupBy("slab").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("spread"))
    p = G.predict_family(f, {"model": _Family(), "feature_names": ["mean", "spread"], "labels": ["pelvic", "femur"]})
    rule = F.when(F.col("slab") % 2 == 0, "pelvic").otherwise("femur")
    return p.withColumn("r", S.routed_family(rule, F.col("family"), F.col("p_femur"))).select("slab", "family", "p_femur", F.col("r.family").alias("routed"), "r.why")


@query("conservative_split", "slab:l instance:l n:l")
def conservative_split(spark, sf):
    return _sizes(D.per_block(X.vox(spark, sf), "slab", ["v"], lambda c: H.conservative_split(D.core_seed(_classes(c), least=20), _classes(c), _affinities(c), least_mm3=10.0, least_core=2, cut_radius=1)[0]))


@query("fill_mask", "slab:l instance:l n:l")
def fill_mask(spark, sf):
    return _sizes(D.per_block(X.vox(spark, sf), "slab", ["v"], lambda c: H.fill_mask(np.where(c[0] > 0.25, 1 + (np.arange(c[0].size).reshape(c[0].shape) > c[0].size // 2), 0), c[0] > 0.05)[0]))
