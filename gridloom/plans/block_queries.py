"""Queries of kernels on blocks: components, distances, decoders, targets."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions.registry import anatomy_of
from ..operators import decode as D
from ..operators import distance as DI
from ..operators import gate as G
from ..operators import heal as H
from ..operators import masks as MK
from ..operators import neighbors as N
from ..operators import decode_targets as DT
from ..operators import surfaces as SU
from ..operators import targets as T
from ..operators.graph import tiled_components
from ..sources import fixtures as X
from .base import INST_B, VOX, query

#: Components by label propagation to the least raster number, inside slabs: small ones, so recursion ends soon.
_CC = f"""WITH RECURSIVE {VOX}, m AS (SELECT slab, z, y, x, (z - slab * 50) * 64 + y * 8 + x AS id FROM vox WHERE v > 0.15),
    e AS (SELECT a.slab, a.id AS a, b.id AS b FROM m a JOIN m b ON b.slab = a.slab AND abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x) = 1 AND b.z BETWEEN a.z - 1 AND a.z + 1),
    r AS (SELECT slab, id AS a, id AS root FROM m UNION SELECT e.slab, e.b, r.root FROM r JOIN e ON e.slab = r.slab AND e.a = r.a),
    c AS (SELECT slab, a AS id, min(root) AS root FROM r GROUP BY 1, 2)"""


@query("components_6", "slab:l parts:l largest:l", f"{_CC} SELECT slab, count(*) AS parts, max(n) AS largest FROM (SELECT slab, root, count(*) AS n FROM c GROUP BY 1, 2) GROUP BY 1")
def components_6(spark, sf):
    c = SU.component_table(X.vox(spark, sf).withColumn("m", F.col("v") > 0.15), "slab", "m")
    return c.groupBy("slab", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("slab").agg(F.count(F.lit(1)).alias("parts"), F.max("n").alias("largest"))


@query("prune_components", "slab:l kept:l voxels:l", f"{_CC} SELECT slab, count(*) AS kept, sum(n) AS voxels FROM (SELECT slab, root, count(*) AS n FROM c GROUP BY 1, 2 HAVING count(*) >= 3) GROUP BY 1")
def prune_components(spark, sf):
    cells = X.vox(spark, sf).withColumn("z", F.col("z") - F.col("slab") * 50)
    n = tiled_components(cells, "slab", "v > 0.15", 16, (8, 8)).groupBy("slab", "root").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    return n.groupBy("slab").agg(F.count(F.lit(1)).alias("kept"), F.sum("n").alias("voxels"))


_OPEN = f"""WITH RECURSIVE {VOX}, won AS (SELECT slab, z - slab * 50 AS z, y, x, CASE WHEN x < 4 THEN 1 ELSE 2 END AS anatomy FROM vox WHERE v > -0.03),
    o AS (SELECT a AS dz, b AS dy, c AS dx FROM (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b), (SELECT unnest([0, 1]) AS c)),
    cube AS (SELECT slab, anatomy, z - dz AS z, y - dy AS y, x - dx AS x FROM won, o GROUP BY ALL HAVING count(*) = 8),
    m AS (SELECT DISTINCT slab, anatomy, z + dz AS z, y + dy AS y, x + dx AS x, (z + dz) * 64 + (y + dy) * 8 + x + dx AS id FROM cube, o),
    e AS (SELECT a.slab, a.anatomy, a.id AS a, b.id AS b FROM m a JOIN m b ON b.slab = a.slab AND b.anatomy = a.anatomy AND abs(a.z - b.z) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND a.id <> b.id),
    r AS (SELECT slab, anatomy, id AS a, id AS root FROM m UNION SELECT e.slab, e.anatomy, e.b, r.root FROM r JOIN e ON e.slab = r.slab AND e.anatomy = r.anatomy AND e.a = r.a),
    c AS (SELECT slab, anatomy, a AS id, min(root) AS root FROM r GROUP BY 1, 2, 3)"""


@query("argmax_masks", "slab:l anatomy:l n:l sz:l sy:l sx:l", f"""
    {_OPEN} SELECT slab, anatomy, count(*) AS n, sum(id // 64) AS sz, sum(id // 8 % 8) AS sy, sum(id % 8) AS sx
    FROM (SELECT *, count(*) OVER (PARTITION BY slab, anatomy, root) AS size FROM c) WHERE size >= 12 GROUP BY 1, 2""")
def argmax_masks(spark, sf):
    # parts stay small on these grids, so fewer voxels make a part than on a scan
    v = F.col("v") + 0.03
    g = X.vox(spark, sf).select(F.col("slab").alias("vol"), (F.col("z") - F.col("slab") * 50).alias("z"), "y", "x", F.lit(0.0).alias("c0"), F.when(F.col("x") < 4, v).otherwise(-1.0).alias("c1"), F.when(F.col("x") >= 4, v).otherwise(-1.0).alias("c2"))
    m = MK.argmax_masks(g, ["c0", "c1", "c2"], planes=16, extent=(8, 8), least=12)
    return m.groupBy(F.col("vol").alias("slab"), "anatomy").agg(F.count(F.lit(1)).alias("n"), F.sum("z").alias("sz"), F.sum("y").alias("sy"), F.sum("x").alias("sx"))


_NEAR = f"""WITH {VOX}, l AS (SELECT slab, z, y, x, (z - slab * 50) * 64 + y * 8 + x AS id, label % 4 + 1 AS label FROM vox WHERE v > 0.25), w AS (SELECT slab, z, y, x FROM vox WHERE v BETWEEN 0.1 AND 0.25),
    d AS (SELECT w.*, l.id, l.label, (w.z - l.z) * (w.z - l.z) * 0.64 + (w.y - l.y) * (w.y - l.y) + (w.x - l.x) * (w.x - l.x) * 2.25 AS d2 FROM w JOIN l ON l.slab = w.slab), n AS (SELECT slab, z, y, x, min(d2) AS d2 FROM d GROUP BY ALL)"""


def _near_sides(spark, sf):
    """Voxels that ask and voxels with a label."""
    v = X.vox(spark, sf).withColumn("label", F.col("label") % 4 + 1)
    return v.where("v BETWEEN 0.1 AND 0.25").select("slab", "z", "y", "x"), v.where("v > 0.25").select("slab", "z", "y", "x", "label")


@query("edt", "slab:l n:l total:d most:d", f"{_NEAR} SELECT slab, count(*) AS n, sum(sqrt(d2)) AS total, max(sqrt(d2)) AS most FROM n GROUP BY 1")
def edt(spark, sf):
    queries, seeds = _near_sides(spark, sf)
    return DI.to_nearest(queries, seeds, ["slab"], (0.8, 1.0, 1.5)).groupBy("slab").agg(F.count("distance").alias("n"), F.sum("distance").alias("total"), F.max("distance").alias("most"))


@query("nearest_fill", "slab:l filled:l n:l", f"{_NEAR.replace('* 0.64', '').replace('* 2.25', '')} , f AS (SELECT d.slab, d.z, d.y, d.x, arg_min(d.label, d.id) AS filled FROM d JOIN n ON n.slab = d.slab AND n.z = d.z AND n.y = d.y AND n.x = d.x AND n.d2 = d.d2 GROUP BY ALL) SELECT slab, filled, count(*) AS n FROM f GROUP BY 1, 2")
def nearest_fill(spark, sf):
    queries, seeds = _near_sides(spark, sf)
    return DI.to_nearest(queries, seeds, ["slab"], value="label").groupBy("slab", F.col("nearest").alias("filled")).agg(F.count(F.lit(1)).alias("n"))


_HALF_MASK = "vox WHERE v > {0} AND x < 4"
_SURF = f"""WITH {VOX}, a AS (SELECT slab, z, y, x FROM vox WHERE v > 0.05 AND y < 5), b AS (SELECT slab, z, y, x FROM vox WHERE v > 0.1 AND y > 2),
    sa AS (SELECT a.* FROM a LEFT JOIN a n ON n.slab = a.slab AND abs(n.z - a.z) + abs(n.y - a.y) + abs(n.x - a.x) = 1 AND n.z BETWEEN a.z - 1 AND a.z + 1 GROUP BY ALL HAVING count(n.z) < 6),
    sb AS (SELECT b.* FROM b LEFT JOIN b n ON n.slab = b.slab AND abs(n.z - b.z) + abs(n.y - b.y) + abs(n.x - b.x) = 1 AND n.z BETWEEN b.z - 1 AND b.z + 1 GROUP BY ALL HAVING count(n.z) < 6),
    p AS (SELECT sa.slab, sa.z AS z1, sa.y AS y1, sa.x AS x1, sb.z AS z2, sb.y AS y2, sb.x AS x2, sqrt((sa.z - sb.z) ** 2 + (sa.y - sb.y) ** 2 + (sa.x - sb.x) ** 2) AS d FROM sa JOIN sb ON sb.slab = sa.slab),
    d AS (SELECT slab, min(d) AS d FROM p GROUP BY slab, z1, y1, x1 UNION ALL SELECT slab, min(d) FROM p GROUP BY slab, z2, y2, x2)"""


@query("hd95_assd", "slab:l hd95:d assd:d nsd:d", f"{_SURF} SELECT slab, quantile_cont(d, 0.95) AS hd95, avg(d) AS assd, avg(CASE WHEN d <= 2 THEN 1.0 ELSE 0.0 END) AS nsd FROM d GROUP BY 1")
def hd95_assd(spark, sf):
    v = X.vox(spark, sf)
    return DI.surface_metrics(v.where("v > 0.05 AND y < 5"), v.where("v > 0.1 AND y > 2"), ["slab"])


@query("local_dice", "slab:l dice:d", f"""
    WITH {VOX}, g AS (SELECT slab, z, y, x, v > 0.2 AS gt, v > 0.1 AS p FROM vox), band AS (SELECT DISTINCT a.slab, a.z, a.y, a.x FROM g a JOIN g b ON b.slab = a.slab AND b.gt AND abs(a.z - b.z) <= 2 AND (a.z - b.z) ** 2 + (a.y - b.y) ** 2 + (a.x - b.x) ** 2 <= 4)
    SELECT g.slab, 2.0 * count(*) FILTER (gt AND p) / greatest(count(*) FILTER (gt) + count(*) FILTER (p), 1) AS dice FROM g JOIN band USING (slab, z, y, x) GROUP BY 1""")
def local_dice(spark, sf):
    g = X.vox(spark, sf).select("slab", "z", "y", "x", (F.col("v") > 0.2).alias("gt"), (F.col("v") > 0.1).alias("p"))
    band = N.dilate(g.where("gt"), N.ball_offsets(2), ["slab"])
    inside = g.join(band, ["slab", "z", "y", "x"], "left_semi")
    return inside.groupBy("slab").agg((2.0 * F.count_if(F.col("gt") & F.col("p")) / F.greatest(F.count_if("gt") + F.count_if("p"), F.lit(1))).alias("dice"))


@query("abbc_class_target", "slab:l cls:l n:l", f"""
    WITH {VOX}, {INST_B}, o AS (SELECT a.i AS dz, b.i AS dy, c.i AS dx FROM (SELECT unnest(range(-1, 2)) AS i) a, (SELECT unnest(range(-1, 2)) AS i) b, (SELECT unnest(range(-1, 2)) AS i) c),
    s AS (SELECT DISTINCT a.slab, a.z, a.y, a.x FROM inst a, o JOIN inst b ON b.slab = a.slab AND b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx WHERE a.gt > 0 AND b.gt > 0 AND a.gt <> b.gt AND (a.gt - 1) // 50 = (b.gt - 1) // 50),
    bd AS (SELECT DISTINCT slab, z + dz AS z, y + dy AS y, x + dx AS x FROM s, o), e AS (SELECT DISTINCT slab, z + dz AS z, y + dy AS y, x + dx AS x FROM inst, o WHERE gt = 0)
    SELECT slab, CASE WHEN gt = 0 THEN 0 WHEN bd.z IS NOT NULL THEN 2 WHEN e.z IS NULL THEN 3 ELSE 1 END AS cls, count(*) AS n FROM inst LEFT JOIN bd USING (slab, z, y, x) LEFT JOIN e USING (slab, z, y, x) GROUP BY 1, 2""")
def abbc_class_target(spark, sf):
    return N.class_target(X.instances_b(spark, sf), "gt", ["slab"]).groupBy("slab", "cls").agg(F.count(F.lit(1)).alias("n"))


def _classes(c: np.ndarray) -> np.ndarray:
    """Four class probabilities of a block of values by rule."""
    e = np.exp(np.stack([-25 * c[0], 4 * c[0], 6 * np.sin(9 * c[0]), 20 * c[0] - 1]))
    return e / e.sum(0)


def _affinities(c: np.ndarray) -> np.ndarray:
    return np.stack([1 / (1 + np.exp(-(10 * c[0] + (k - 4) / 4))) for k in range(9)])


def _sizes(df):
    return df.groupBy("slab", "instance").agg(F.count(F.lit(1)).alias("n"))


_DECODERS = {
    "decode_core_seed": lambda c: D.core_seed(_classes(c), least=20),
    "decode_agglo": lambda c: D.agglomerate(_classes(c), least=20),
    "decode_affinity": lambda c: D.affinity_agglomerate(_classes(c), _affinities(c), least=20),
    "decode_multirange": lambda c: D.multirange(_classes(c), _affinities(c), least=20)[0],
    "decode_fusion": lambda c: D.fuse(D.core_seed(_classes(c), least=20), _classes(c), _affinities(c), least=10, least_ridge=15),
    "heal_split": lambda c: H.split_heal(D.core_seed(_classes(c), least=20), np.argmax(_classes(c), 0), _classes(c)[2], least_piece=20, cut_radius=1)[0],
    "heal_merge": lambda c: H.merge_heal(D.core_seed(_classes(c), least=20), np.argmax(_classes(c), 0))[0],
    "heal_full": lambda c: H.refine(D.core_seed(_classes(c), least=20), _classes(c), least_piece=20, cut_radius=1)[0],
    "soft_merge": lambda c: H.soft_merge(D.core_seed(_classes(c), least=20), _classes(c), _affinities(c))[0],
    "progressive_merge": lambda c: H.progressive_merge(D.core_seed(_classes(c), least=20), _classes(c), _affinities(c), least_mm3=10.0, small_mm3=200.0)[0],
    "merge_small_components": lambda c: D.merge_small_by_component(D.core_seed(_classes(c), least=1), 40),
}
for _name, _f in _DECODERS.items():
    query(_name, "slab:l instance:l n:l")(lambda spark, sf, f=_f: _sizes(D.per_block(X.vox(spark, sf), "slab", ["v"], f)))

_TARGETS = {
    "target_barrier": lambda i: T.barrier_target(i, shell=1.5)[0],
    "target_v5": lambda i: T.v5_target(i, profile="v5_core_body_contact_band", body=1.5),
    "target_official": lambda i: T.official_target(i)[0],
    "target_official_dynamic": lambda i: T.official_target(i, dynamic=(2, 12))[0],
    "fracture_regions": lambda i: T.fracture_regions(i, 2).astype(int),
    "thin_ridge": lambda i: T.thin_ridge(i, (1.0, 1.0, 1.0), same_block=True).astype(int),
    "decode_barrier": lambda i: DT.barrier(T.barrier_target(i, shell=1.5)[0]),
    "decode_barrier_geodesic": lambda i: DT.barrier(T.barrier_target(i, shell=1.5)[0], "geodesic_marker_v2"),
    "decode_v5": lambda i: DT.markers_v5(T.v5_target(i))[0],
    "decode_v5_healed": lambda i: DT.markers_v5(T.v5_target(i), healed=True, least_core=4)[0],
    "decode_official": lambda i: DT.official(np.where(i > 0, (i - 1) // 50 + 1, 0) % 4, T.official_target(i)[0], least_core=1, least=20),
}
for _name, _f in _TARGETS.items():
    query(_name, "slab:l instance:l n:l")(lambda spark, sf, f=_f: _sizes(D.per_block(X.instances_b(spark, sf), "slab", ["gt"], lambda c: f(c[0].astype(np.int64)))))


@query("decode_contact_heads", "slab:l instance:l n:l")
def decode_contact_heads(spark, sf):
    s = lambda a: 1 / (1 + np.exp(-a))
    return _sizes(D.per_block(X.vox(spark, sf).withColumn("s", F.col("label") % 4), "slab", ["v", "s"], lambda c: DT.contact_heads(c[1].astype(int), s(8 * c[0] + 1), s(20 * c[0] - 1), s(-15 * c[0] - 2), s(-15 * c[0] - 2))))


def _features_sql() -> str:
    """Candidates as the gate finds them, and their features by counting; components spread over neighbours inside a side."""
    near = "abs(a.z - b.z) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND (a.z <> b.z OR a.y <> b.y OR a.x <> b.x)"
    moments = lambda piece: f"max(n) FILTER ({piece}) AS n, max(mz) FILTER ({piece}) AS mz, max(my) FILTER ({piece}) AS my, max(mx) FILTER ({piece}) AS mx, max(mean) FILTER ({piece}) AS mean, max(dev) FILTER ({piece}) AS dev, COALESCE(max(inner_) FILTER ({piece}), 0) AS inner_, max(parts) FILTER ({piece}) AS parts"
    rename = lambda text, p: re.sub(r" AS (\w+)", rf" AS {p}\1", text)
    shape = {
        "source_log_volume_cm3": "ln(1 + t_n / 1000)", "source_component_count": "t_parts", "source_bbox_short_mm": "span[1]", "source_bbox_mid_mm": "span[2]", "source_bbox_long_mm": "span[3]", "source_bbox_elongation": "span[3] / greatest(span[1], 1e-6)", "piece_small_volume_cm3": "least(p_n, r_n) / 1000", "piece_large_volume_cm3": "greatest(p_n, r_n) / 1000",
        "piece_small_large_ratio": "least(p_n, r_n) / CAST(greatest(p_n, r_n) AS DOUBLE)", "isolated_piece_fraction": "p_n / CAST(t_n AS DOUBLE)", "piece_component_count": "p_parts", "remainder_component_count": "r_parts", "piece_surface_fraction": "1 - p_inner_ / CAST(p_n AS DOUBLE)", "remainder_surface_fraction": "1 - r_inner_ / CAST(r_n AS DOUBLE)",
        "interface_voxels": "meet", "interface_source_fraction": "meet / CAST(t_n AS DOUBLE)", "centroid_distance_mm": "apart", "centroid_distance_radius_ratio": "apart / pow(3 * t_n / (4 * pi()), 1.0 / 3)", "ct_piece_mean": "p_mean", "ct_remainder_mean": "r_mean", "ct_absolute_mean_difference": "abs(p_mean - r_mean)",
        "ct_standardized_mean_difference": "abs(p_mean - r_mean) / greatest(sqrt((p_dev ** 2 + r_dev ** 2) / 2), 1e-6)", "ct_piece_std": "p_dev", "ct_remainder_std": "r_dev",
        "is_sacrum": "CAST(a = 0 AS INT)", "is_left_hip": "CAST(a = 1 AS INT)", "is_right_hip": "CAST(a = 2 AS INT)", "is_femur": "CAST(a = 3 AS INT)", "anatomy_v35_fragment_count": "fragments", "isolated_is_complement": "CAST(inv AS INT)", "proposal_ids_in_source": "k", "proposal_foreground_coverage": "covered / CAST(t_n AS DOUBLE)", "proposal_label_leakage_fraction": "(everywhere - n) / CAST(everywhere AS DOUBLE)",
    } | dict.fromkeys(G.CONTEXT_FEATURES, "0")
    return f"""WITH RECURSIVE {VOX}, {INST_B}, g AS (SELECT slab AS vol, z, y, x, v, gt AS base, pred AS proposal, (gt - 1) // 50 AS a FROM inst WHERE gt > 0),
        p AS (SELECT vol, a, base, proposal, count(*) AS n, sum(z) AS sz, sum(y) AS sy, sum(x) AS sx FROM g WHERE proposal > 0 AND (proposal - 1) // 50 = a GROUP BY ALL),
        t AS (SELECT vol, a, base, count(*) AS t_n, sum(z) AS tz, sum(y) AS ty, sum(x) AS tx, list_sort([max(z) - min(z) + 1.0, max(y) - min(y) + 1.0, max(x) - min(x) + 1.0]) AS span FROM g GROUP BY ALL),
        w AS (SELECT vol, proposal, count(*) AS everywhere FROM g WHERE proposal > 0 GROUP BY ALL), q AS (SELECT vol, a, count(*) AS fragments FROM t GROUP BY ALL),
        r AS (SELECT p.*, t_n, tz, ty, tx, span, count(*) OVER s AS k, sum(n) OVER s AS covered, row_number() OVER (PARTITION BY p.vol, p.base ORDER BY n, proposal) AS nth FROM p JOIN t ON t.vol = p.vol AND t.base = p.base WINDOW s AS (PARTITION BY p.vol, p.base)),
        c AS (SELECT *, n > t_n - n AS inv, least(n, t_n - n) AS piece FROM r WHERE k > 2 OR (k = 2 AND nth = 1)),
        d AS (SELECT *, row_number() OVER (PARTITION BY vol, base, piece, CASE WHEN inv THEN tz - sz ELSE sz END, CASE WHEN inv THEN ty - sy ELSE sy END, CASE WHEN inv THEN tx - sx ELSE sx END ORDER BY n DESC, proposal) AS copy FROM c WHERE piece >= 20 AND t_n - piece >= 20),
        cand AS (SELECT d.* EXCLUDE (copy), fragments, everywhere, row_number() OVER (ORDER BY d.vol, d.base, d.proposal) AS id FROM d JOIN q ON q.vol = d.vol AND q.a = d.a JOIN w ON w.vol = d.vol AND w.proposal = d.proposal WHERE copy = 1),
        cells AS (SELECT id, (g.proposal = cand.proposal) <> inv AS piece, id * 4 + CAST((g.proposal = cand.proposal) <> inv AS INT) AS side, g.z, g.y, g.x, g.v, g.z * 64 + g.y * 8 + g.x AS cell FROM cand JOIN g ON g.vol = cand.vol AND g.base = cand.base),
        every AS (SELECT side, z, y, x, cell FROM cells UNION ALL SELECT id * 4 + 2, z, y, x, cell FROM cells),
        e AS (SELECT a.side, a.cell AS a, b.cell AS b FROM every a JOIN every b ON b.side = a.side AND b.z BETWEEN a.z - 1 AND a.z + 1 AND {near}),
        s AS (SELECT side, cell AS a, cell AS root FROM every UNION SELECT e.side, e.b, s.root FROM s JOIN e ON e.side = s.side AND e.a = s.a),
        m AS (SELECT side, count(DISTINCT root) AS parts FROM (SELECT side, a, min(root) AS root FROM s GROUP BY 1, 2) GROUP BY 1), i AS (SELECT side, count(*) AS inner_ FROM (SELECT side, a FROM e GROUP BY 1, 2 HAVING count(*) = 26) GROUP BY 1),
        f AS (SELECT id, side, piece, count(*) AS n, avg(z) AS mz, avg(y) AS my, avg(x) AS mx, avg(v) AS mean, stddev_pop(v) AS dev FROM cells GROUP BY ALL),
        both_ AS (SELECT id, {rename(moments('piece'), 'p_')}, {rename(moments('NOT piece'), 'r_')} FROM f LEFT JOIN m ON m.side = f.side LEFT JOIN i ON i.side = f.side GROUP BY 1),
        o AS (SELECT a.id, count(DISTINCT a.cell) AS meet FROM cells a JOIN cells b ON b.id = a.id AND b.z BETWEEN a.z - 1 AND a.z + 1 AND b.piece AND NOT a.piece AND {near} GROUP BY 1),
        u AS (SELECT cand.*, both_.* EXCLUDE (id), COALESCE(meet, 0) AS meet, m.parts AS t_parts, sqrt((p_mz - r_mz) ** 2 + (p_my - r_my) ** 2 + (p_mx - r_mx) ** 2) AS apart FROM cand JOIN both_ ON both_.id = cand.id LEFT JOIN o ON o.id = cand.id LEFT JOIN m ON m.side = cand.id * 4 + 2)
        SELECT vol, base AS source_id, proposal AS proposal_id, feature, value FROM (SELECT vol, base, proposal, unnest([{', '.join(f"'{k}'" for k in shape)}]) AS feature, unnest([{', '.join(f'CAST({v} AS DOUBLE)' for v in shape.values())}]) AS value FROM u)"""


@query("candidate_features", "vol:l source_id:l proposal_id:l feature:s value:d", _features_sql())
def candidate_features(spark, sf):
    """Every candidate of every slab."""
    g = X.instances_b(spark, sf).where("gt > 0").selectExpr("slab vol", "z", "y", "x", "gt base", "pred proposal", "v ct")
    found, _ = G.candidates(g, 20)
    return G.with_features(g, found).select("vol", "source_id", "proposal_id", F.explode("features").alias("feature", "value"))


@query("official_aligned_metrics", "anatomy:l n_gt:l iou:d dice:d hd95:d assd:d recall:d precision:d f1:d")
def official_aligned_metrics(spark, sf):
    """Small true fragments and small predicted components go first; then matching, scores and surface distances, averaged by anatomy over slabs."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c, _ = D.dense(pdf, ["gt", "pred"])
        gt, pred = (SU.prune_components(a.astype(np.int64), 3) if k else a.astype(np.int64) for k, a in enumerate(c))
        ids, n = np.unique(gt, return_counts=True)
        gt = np.where(np.isin(gt, ids[n < 5]), 0, gt)
        rows = []
        for a in range(4):
            g, p = (np.where((x > 50 * a) & (x <= 50 * a + 50), x, 0) for x in (gt, pred))
            gids, pids = np.unique(g[g > 0]), np.unique(p[p > 0])
            if not len(gids):
                continue
            scores, used, tp = [], set(), 0
            for i in gids:
                own = g == i
                iou, best = max(((float((own & (p == j)).sum() / (own | (p == j)).sum()), -int(j)) for j in pids), default=(0.0, 0))
                hit = iou >= 0.1
                s = SU.surface_scores(own, p == -best if hit else np.zeros_like(own))
                tp += hit
                used |= {-best} if hit else set()
                scores.append((iou if hit else 0.0, s["dice"] if hit else 0.0, s["hd95"], s["assd"]))
            m = [float(np.mean([x for x in col if x is not None])) if any(x is not None for x in col) else None for col in zip(*scores)]
            precision, recall = tp / max(tp + len(pids) - len(used), 1), tp / max(len(gids), 1)
            rows.append((a + 1, len(gids), *m, recall, precision, 2 * precision * recall / max(precision + recall, 1e-8)))
        return pd.DataFrame(rows, columns=["anatomy", "n_gt", "iou", "dice", "hd95", "assd", "recall", "precision", "f1"])

    per = X.instances_b(spark, sf).groupBy("slab").applyInPandas(run, "anatomy long, n_gt long, iou double, dice double, hd95 double, assd double, recall double, precision double, f1 double")
    return per.groupBy("anatomy").agg(F.sum("n_gt").alias("n_gt"), *[F.avg(c).alias(c) for c in ("iou", "dice", "hd95", "assd", "recall", "precision", "f1")])


@query("signed_distance", "slab:l inside:l total:d", f"""
    WITH {VOX}, m AS (SELECT slab, z - slab * 50 AS z, y, x, 0.5 + 3 * (v - 0.2) >= 0.5 AS inside FROM vox),
    d AS (SELECT a.slab, a.z, a.y, a.x, a.inside, sqrt(min((a.z - b.z) * (a.z - b.z) + (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x))) AS d FROM m a JOIN m b ON b.slab = a.slab AND b.inside <> a.inside GROUP BY ALL)
    SELECT slab, count(*) FILTER (inside) AS inside, sum(CASE WHEN inside THEN least(d, 40) / 40 ELSE -least(d, 40) / 40 END) AS total FROM d GROUP BY 1""")
def signed_distance(spark, sf):
    v = X.vox(spark, sf).withColumn("inside", 0.5 + 3 * (F.col("v") - 0.2) >= 0.5)
    return DI.signed_distances(v, ["slab"], "inside").groupBy("slab").agg(F.count_if(F.col("signed") > 0).alias("inside"), F.sum("signed").alias("total"))


@query("official_audit", "slab:l fragments:l ok:b core_share:d")
def official_audit(spark, sf):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c, _ = D.dense(pdf, ["gt"])
        inst = c[0].astype(np.int64)
        a = T.audit_official(inst, T.official_target(inst)[0])
        return pd.DataFrame([(pdf["slab"].iloc[0], len(a["parts"]), a["ok"], a["fractions"][2])], columns=["slab", "fragments", "ok", "core_share"])

    return X.instances_b(spark, sf).groupBy("slab").applyInPandas(run, "slab long, fragments long, ok boolean, core_share double")


@query("skeleton_parts", "slab:l part:s voxels:l")
def skeleton_parts(spark, sf):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c, _ = D.dense(pdf, ["v"])
        return pd.DataFrame([(pdf["slab"].iloc[0], k, int(m.sum())) for k, m in SU.skeleton_parts(c[0] * 4000, 200.0, 4).items()], columns=["slab", "part", "voxels"])

    return X.vox(spark, sf).groupBy("slab").applyInPandas(run, "slab long, part string, voxels long")


@query("foreground_by_anatomy", "anatomy:l n:l", f"WITH {VOX}, {INST_B} SELECT CASE WHEN gt BETWEEN 1 AND 200 THEN (gt - 1) // 50 + 1 ELSE 0 END AS anatomy, count(*) AS n FROM inst GROUP BY 1")
def foreground_by_anatomy(spark, sf):
    return X.instances_b(spark, sf).groupBy(anatomy_of(F.col("gt")).alias("anatomy")).agg(F.count(F.lit(1)).alias("n"))


@query("components_tiled", "parts:l largest:l voxels:l", f"""
    WITH RECURSIVE {VOX}, m AS (SELECT z, y, x, z * 64 + y * 8 + x AS id FROM vox WHERE v > 0.15), e AS (SELECT a.id AS a, b.id AS b FROM m a JOIN m b ON abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x) = 1 AND b.z BETWEEN a.z - 1 AND a.z + 1),
    r AS (SELECT id AS a, id AS root FROM m UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.a), c AS (SELECT a AS id, min(root) AS root FROM r GROUP BY 1)
    SELECT count(*) AS parts, max(n) AS largest, sum(n) AS voxels FROM (SELECT root, count(*) AS n FROM c GROUP BY 1)""")
def components_tiled(spark, sf):
    """The whole table as one volume, in tiles of 16 planes."""
    from ..operators.graph import tiled_components

    v = X.vox(spark, sf).select(F.lit(0).cast("long").alias("vol"), "z", "y", "x", (F.col("v") > 0.15).alias("m"))
    n = tiled_components(v, "vol", "m", 16, (8, 8)).groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("parts"), F.max("n").alias("largest"), F.sum("n").alias("voxels"))
