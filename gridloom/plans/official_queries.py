"""Queries of exact distances, of nearest seeds by paths, and of the challenge's case metrics, without a task that holds a volume."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import distance as D
from ..operators import geodesic as G
from ..operators import official as O
from ..sources import fixtures as X
from .base import INST_B, VOX, query

SPACING = (0.8, 1.0, 1.5)
LIMITS = O.Limits(least_fragment=24.0, least_component=6.0, threshold=0.1, radius=2.5, planes=16)
_D2 = "0.64 * (a.z - b.z) * (a.z - b.z) + (a.y - b.y) * (a.y - b.y) + 2.25 * (a.x - b.x) * (a.x - b.x)"


def _grid(spark, sf):
    return X.instances_b(spark, sf).selectExpr("slab scan", "z - slab * 50 z", "y", "x", "gt", "pred")


@query("exact_distances", "slab:l z:l y:l x:l distance:d", f"""
    WITH {VOX}, a AS (SELECT slab, z - slab * 50 AS z, y, x FROM vox WHERE v < -0.25), b AS (SELECT slab, z - slab * 50 AS z, y, x FROM vox WHERE v > 0.25)
    SELECT a.slab, a.z, a.y, a.x, (SELECT sqrt(min({_D2})) FROM b WHERE b.slab = a.slab) AS distance FROM a""")
def exact_distances(spark, sf):
    v = X.vox(spark, sf).withColumn("z", F.col("z") - F.col("slab") * 50)
    return D.to_nearest(v.where("v < -0.25").select("slab", "z", "y", "x"), v.where("v > 0.25").select("slab", "z", "y", "x"), ["slab"], SPACING)


@query("geodesic_assign", "slab:l label:l n:l total:d", f"""
    WITH RECURSIVE {VOX}, c AS (SELECT slab, z - slab * 50 AS z, y, x, CASE WHEN v > 0.3 THEN 1 + label % 4 ELSE 0 END AS seed FROM vox WHERE v > -0.05),
    e AS (SELECT a.slab, a.z, a.y, a.x, b.z AS z2, b.y AS y2, b.x AS x2 FROM c a JOIN c b ON b.slab = a.slab AND abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x) = 1),
    r AS (SELECT slab, z, y, x, seed, 0 AS d FROM c WHERE seed > 0 UNION SELECT e.slab, z2, y2, x2, r.seed, d + 1 FROM r JOIN e ON e.slab = r.slab AND e.z = r.z AND e.y = r.y AND e.x = r.x WHERE d < 6),
    b AS (SELECT slab, z, y, x, min(d * 10 + seed) AS best FROM r GROUP BY ALL)
    SELECT c.slab, COALESCE(best % 10, 0) AS label, count(*) AS n, sum(COALESCE(best // 10, 0)) AS total FROM c LEFT JOIN b ON b.slab = c.slab AND b.z = c.z AND b.y = c.y AND b.x = c.x GROUP BY 1, 2""")
def geodesic_assign(spark, sf):
    v = X.vox(spark, sf).where("v > -0.05").selectExpr("slab", "z - slab * 50 z", "y", "x", "CASE WHEN v > 0.3D THEN 1 + label % 4 ELSE 0 END seed")
    out = G.assign(v, ["slab"], connectivity=1, edge=16, most=6.0)
    return out.groupBy("slab", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("distance", F.lit(0.0))).alias("total"))


_FACES = "(VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) AS f(dz, dy, dx)"


def _edge(cells: str, keys: str) -> str:
    """Cells with a face neighbour that isn't one of the same keys."""
    same = " AND ".join(f"n.{k} = c.{k}" for k in keys.split(", "))
    return f"SELECT c.* FROM {cells} c WHERE (SELECT count(*) FROM {_FACES} JOIN {cells} n ON n.z = c.z + dz AND n.y = c.y + dy AND n.x = c.x + dx WHERE {same}) < 6"


def _parts(side: str, source: str) -> str:
    """Cells of one side after small components went; ids are raster numbers of the slab."""
    least = O.voxels_of(LIMITS.least_component, SPACING)
    return f"""{side}_e AS (SELECT a.scan, a.cell AS a, b.cell AS b FROM {source} a JOIN {source} b ON b.scan = a.scan AND b.id = a.id AND abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x) = 1),
        {side}_r AS (SELECT scan, cell AS a, cell AS root FROM {source} UNION SELECT e.scan, e.b, r.root FROM {side}_r r JOIN {side}_e e ON e.scan = r.scan AND e.a = r.a),
        {side}_m AS (SELECT scan, a, min(root) AS root FROM {side}_r GROUP BY 1, 2), {side}_n AS (SELECT scan, root FROM {side}_m GROUP BY 1, 2 HAVING count(*) >= {least}),
        {side} AS (SELECT c.scan, c.id, c.z, c.y, c.x FROM {source} c JOIN {side}_m m ON m.scan = c.scan AND m.a = c.cell JOIN {side}_n n ON n.scan = m.scan AND n.root = m.root)"""


_A = lambda c: f"(({c} - 1) // 50 + 1)"
def _scores(radius: float) -> str:
    """From cells g and p (scan, id, z, y, x) to cases, in SQL."""
    return f"""gn AS (SELECT scan, id AS gt, {_A('id')} AS anatomy, count(*) AS n FROM g GROUP BY ALL), pn AS (SELECT scan, id AS pred, {_A('id')} AS anatomy, count(*) AS n FROM p GROUP BY ALL),
    o AS (SELECT g.scan, g.id AS gt, p.id AS pred, count(*) AS both_ FROM g JOIN p USING (scan, z, y, x) WHERE {_A('g.id')} = {_A('p.id')} GROUP BY ALL),
    u AS (SELECT o.*, gn.n AS n_gt, pn.n AS n_pred, both_ / CAST(gn.n + pn.n - both_ AS DOUBLE) AS iou FROM o JOIN gn ON gn.scan = o.scan AND gn.gt = o.gt JOIN pn ON pn.scan = o.scan AND pn.pred = o.pred),
    best AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY scan, gt ORDER BY iou DESC, pred) = 1), m AS (SELECT * FROM best WHERE iou >= 0.1),
    ge AS ({_edge('g', 'scan, id')}), pe AS ({_edge('p', 'scan, id')}),
    ma AS (SELECT m.scan, m.gt, e.z, e.y, e.x FROM m JOIN ge e ON e.scan = m.scan AND e.id = m.gt), mb AS (SELECT m.scan, m.gt, e.z, e.y, e.x FROM m JOIN pe e ON e.scan = m.scan AND e.id = m.pred),
    d AS (SELECT a.scan, a.gt, sqrt(min({_D2})) AS d FROM ma a JOIN mb b ON b.scan = a.scan AND b.gt = a.gt GROUP BY a.scan, a.gt, a.z, a.y, a.x
        UNION ALL SELECT a.scan, a.gt, sqrt(min({_D2})) FROM mb a JOIN ma b ON b.scan = a.scan AND b.gt = a.gt GROUP BY a.scan, a.gt, a.z, a.y, a.x),
    s AS (SELECT scan, gt, quantile_cont(d, 0.95) AS hd95, avg(d) AS assd FROM d GROUP BY 1, 2),
    near AS (SELECT a.scan, a.id AS pred, count(*) AS near FROM p a WHERE (a.scan, a.id) IN (SELECT (scan, pred) FROM m) AND EXISTS (SELECT 1 FROM g b WHERE b.scan = a.scan AND {_A('b.id')} = {_A('a.id')} AND {_D2} <= {radius ** 2}) GROUP BY 1, 2),
    f AS (SELECT gn.scan, gn.gt, gn.anatomy, m.pred, COALESCE(m.iou, 0) AS iou, COALESCE(2.0 * m.both_ / (m.n_gt + m.n_pred), 0) AS dice, COALESCE(2.0 * m.both_ / (m.n_gt + near.near), 0) AS local_dice, hd95, assd,
        count(m.pred) OVER (PARTITION BY gn.scan, m.pred) AS uses, (SELECT count(*) FROM o WHERE o.scan = gn.scan AND o.gt = gn.gt) AS touching
        FROM gn LEFT JOIN m ON m.scan = gn.scan AND m.gt = gn.gt LEFT JOIN s ON s.scan = gn.scan AND s.gt = gn.gt LEFT JOIN near ON near.scan = m.scan AND near.pred = m.pred),
    c AS (SELECT scan, anatomy, count(*) AS n_gt, count(pred) AS tp, count(DISTINCT pred) AS used, avg(iou) AS iou, avg(dice) AS dice, avg(local_dice) AS local_dice, avg(hd95) AS hd95, avg(assd) AS assd,
        avg(CASE WHEN pred IS NOT NULL AND uses = 1 AND touching <= 1 THEN 1 ELSE 0 END) AS topology, sum(greatest(touching - 1, 0)) AS split_error FROM f GROUP BY 1, 2),
    k AS (SELECT scan, anatomy, count(*) AS n_pred FROM pn GROUP BY 1, 2),
    w AS (SELECT c.*, COALESCE(n_pred, 0) AS n_pred, COALESCE(n_pred, 0) - used AS fp, n_gt - tp AS fn, tp - used AS merge_error, tp / CAST(greatest(tp + COALESCE(n_pred, 0) - used, 1) AS DOUBLE) AS precision, tp / CAST(n_gt AS DOUBLE) AS recall FROM c LEFT JOIN k ON k.scan = c.scan AND k.anatomy = c.anatomy),
    cases AS (SELECT *, 2 * precision * recall / greatest(precision + recall, 1e-8) AS f1 FROM w)"""


_OFFICIAL = f"""WITH RECURSIVE {VOX}, {INST_B}, i AS (SELECT slab AS scan, z - slab * 50 AS z, y, x, gt, pred, (z - slab * 50) * 64 + y * 8 + x AS cell FROM inst),
    g0 AS (SELECT scan, gt AS id, z, y, x, cell FROM i WHERE gt BETWEEN 1 AND 200 AND (scan, gt) IN (SELECT (scan, gt) FROM i GROUP BY scan, gt HAVING count(*) >= {O.voxels_of(LIMITS.least_fragment, SPACING)})), p0 AS (SELECT scan, pred AS id, z, y, x, cell FROM i WHERE pred > 0),
    {_parts('g', 'g0')}, {_parts('p', 'p0')},
    {_scores(LIMITS.radius)}"""
_MEANS = " ".join(f"{c}:d" for c in O.MEANS) + " " + " ".join(f"{c}:l" for c in O.SUMS)


@query("official_cases", f"scan:l anatomy:l n_gt:l n_pred:l tp:l fp:l fn:l {_MEANS}", f"{_OFFICIAL} SELECT * FROM cases")
def official_cases(spark, sf):
    return O.official_metrics(_grid(spark, sf), SPACING, LIMITS)


@query("official_summary", f"anatomy:l samples:l {_MEANS}", f"{_OFFICIAL} SELECT anatomy, count(*) AS samples, {', '.join(f'avg({c}) AS {c}' for c in O.MEANS)}, {', '.join(f'sum({c}) AS {c}' for c in O.SUMS)} FROM cases GROUP BY ROLLUP (anatomy)")
def official_summary(spark, sf):
    return O.official_summary(O.official_metrics(_grid(spark, sf), SPACING, LIMITS))


@query("official_scans", f"scan:l anatomies:l {_MEANS}", f"{_OFFICIAL} SELECT scan, count(*) AS anatomies, {', '.join(f'avg({c}) AS {c}' for c in O.MEANS)}, {', '.join(f'sum({c}) AS {c}' for c in O.SUMS)} FROM cases GROUP BY 1")
def official_scans(spark, sf):
    return O.official_macro(O.official_metrics(_grid(spark, sf), SPACING, LIMITS))
