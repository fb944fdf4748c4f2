"""Queries of whole losses. Targets are the classes of the predicted instance map; logits are rules of the values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import losses as L
from ..operators import neighbors as N
from ..sources import fixtures as X
from .base import AFF, INST_B, VOX, query

LOGITS = ("-10 * v", "2 * v", "0.5 * v", "12 * v - 1")
_E = [f"exp({x})" for x in LOGITS]
#: Class targets of the predicted instances, probabilities, and which voxels count.
_ROWS = f"""{VOX}, {INST_B}, o AS (SELECT a.i AS dz, b.i AS dy, c.i AS dx FROM (SELECT unnest(range(-1, 2)) AS i) a, (SELECT unnest(range(-1, 2)) AS i) b, (SELECT unnest(range(-1, 2)) AS i) c),
    s AS (SELECT DISTINCT a.slab, a.z, a.y, a.x FROM inst a, o JOIN inst b ON b.slab = a.slab AND b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx WHERE a.pred > 0 AND b.pred > 0 AND a.pred <> b.pred AND (a.pred - 1) // 50 = (b.pred - 1) // 50),
    bd AS (SELECT DISTINCT slab, z + dz AS z, y + dy AS y, x + dx AS x FROM s, o), e AS (SELECT DISTINCT slab, z + dz AS z, y + dy AS y, x + dx AS x FROM inst, o WHERE pred = 0),
    r AS (SELECT slab, z, y, x, pred, CASE WHEN pred = 0 THEN 0 WHEN bd.z IS NOT NULL THEN 2 WHEN e.z IS NULL THEN 3 ELSE 1 END AS t, x <> 7 AS valid, {', '.join(f'{e} / ({" + ".join(_E)}) AS p{k}' for k, e in enumerate(_E))} FROM inst LEFT JOIN bd USING (slab, z, y, x) LEFT JOIN e USING (slab, z, y, x)),
    own AS (SELECT *, CASE t WHEN 0 THEN p0 WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE p3 END AS p FROM r)"""
_SUMS = " UNION ALL ".join(f"SELECT slab, {k} AS cls, p{k} AS p, CASE WHEN t = {k} THEN 1.0 ELSE 0.0 END AS y, valid FROM r" for k in range(4))


def _rows(spark, sf):
    g = N.class_target(X.instances_b(spark, sf), "pred", ["slab"]).withColumnRenamed("cls", "t").withColumn("valid", F.col("x") != 7)
    e = [F.exp(F.expr(x.replace("0.5", "0.5D"))) for x in LOGITS]
    return g.withColumns({f"p{k}": x / sum(e) for k, x in enumerate(e)})


PROBS = ["p0", "p1", "p2", "p3"]
_BASE = f"""{_ROWS}, c AS (SELECT slab, avg(-ln(p) * CASE WHEN t = 2 THEN 5 ELSE 1 END) FILTER (valid) AS ce FROM own GROUP BY 1),
    d AS (SELECT slab, cls, (2 * sum(p * y) + 1e-5) / (sum(p) + sum(y) + 1e-5) AS dice FROM ({_SUMS}) WHERE valid GROUP BY 1, 2), b AS (SELECT c.slab, ce, 1 - avg(dice) FILTER (cls > 0) AS dice_loss FROM c JOIN d ON d.slab = c.slab GROUP BY 1, 2)"""


@query("class_loss", "slab:l ce:d dice_loss:d loss:d", f"WITH {_BASE} SELECT *, ce + dice_loss AS loss FROM b")
def class_loss(spark, sf):
    return L.masked_dice_ce(_rows(spark, sf), ["slab"], PROBS, "t", "valid", [1, 1, 5, 1])


_PAIRS = " UNION ALL ".join(f"SELECT a.slab, a.a{k} AS p, a.pred = b.pred AS same FROM i a JOIN i b ON b.slab = a.slab AND b.z = a.z + {o[0]} AND b.y = a.y + {o[1]} AND b.x = a.x + {o[2]}" for k, o in enumerate([o for d in (1, 3, 9) for o in N.axis_offsets(d)]))


@query("class_affinity_loss", "slab:l loss:d affinity:d total:d", f"""
    WITH {_BASE}, i AS (SELECT slab, z, y, x, pred, {AFF} FROM inst WHERE pred > 0), a AS (SELECT slab, 0.5 * (COALESCE(avg(-ln(p)) FILTER (same), 0) + COALESCE(avg(-ln(1 - p)) FILTER (NOT same), 0)) AS affinity FROM ({_PAIRS}) GROUP BY 1)
    SELECT b.slab, ce + dice_loss AS loss, affinity, ce + dice_loss + 0.7 * affinity AS total FROM b JOIN a ON a.slab = b.slab""")
def class_affinity_loss(spark, sf):
    g = X.affinity_columns(X.instances_b(spark, sf)).where("pred > 0").select("slab", "z", "y", "x", "pred", *[f"a{k}" for k in range(9)])
    offsets = [o for d in (1, 3, 9) for o in N.axis_offsets(d)]
    pairs = N.affinity_pairs(g, "pred", [f"a{k}" for k in range(9)], offsets, ["slab"])
    return L.with_affinity(class_loss(spark, sf), pairs, ["slab"], "p", "same", 0.7)


@query("compound_loss", "slab:l dc_ce:d tversky:d boundary:d loss:d", f"""
    WITH {_ROWS}, f AS (SELECT * FROM (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) AS f(dz, dy, dx)),
    n AS (SELECT slab, t AS cls, count(*) AS n FROM r GROUP BY 1, 2), h AS (SELECT slab, t AS cls, count(*) AS interior FROM (SELECT a.slab, a.t, a.z, a.y, a.x FROM r a, f JOIN r b ON b.slab = a.slab AND b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx AND b.t = a.t GROUP BY ALL HAVING count(*) = 6) GROUP BY 1, 2),
    ss AS (SELECT slab, cls, sum(p * y) AS i, sum(p) AS pp, sum(y) AS tt, sum(p * p) AS p2 FROM ({_SUMS}) GROUP BY 1, 2),
    q AS (SELECT ss.*, CASE WHEN tt = 0 THEN 0 ELSE least(2 * COALESCE(interior, 0) / (n.n + 1e-5) - 1, 0.8) END AS a FROM ss LEFT JOIN n ON n.slab = ss.slab AND n.cls = ss.cls LEFT JOIN h ON h.slab = ss.slab AND h.cls = ss.cls),
    g AS (SELECT slab, avg((2 * i + 1e-5) / (pp + tt + 1e-5)) FILTER (cls > 0) AS dice, sum((1 - (i + 1e-5) / (i + 0.2 * (pp - i) + 0.8 * (tt - i) + 1e-5)) * CASE WHEN cls = 2 THEN 2 ELSE 1 END) FILTER (cls IN (2, 3) AND (tt > 0 OR pp >= 1e-5)) / sum(CASE WHEN cls = 2 THEN 2 ELSE 1 END) FILTER (cls IN (2, 3) AND (tt > 0 OR pp >= 1e-5)) AS tversky,
        avg((p2 + tt - 2 * i + 1e-5) / (p2 + tt - (1 + a) * i + 1e-5)) FILTER (cls > 0 AND (tt > 0 OR pp >= 1e-5)) AS boundary FROM q GROUP BY 1),
    c AS (SELECT slab, avg(-ln(p)) AS ce FROM own GROUP BY 1)
    SELECT g.slab, ce - dice AS dc_ce, tversky, boundary, ce - dice + 0.35 * tversky + 0.05 * boundary AS loss FROM g JOIN c ON c.slab = g.slab""")
def compound_loss(spark, sf):
    r = _rows(spark, sf)
    ce = r.groupBy("slab").agg(L.cross_entropy(PROBS, "t").alias("ce"))
    interior = N.interior_counts(r, "t", ["slab"]).withColumnRenamed("t", "cls")
    return L.compound(L.sums_by(r, ["slab"], PROBS, "t"), ["slab"], ce, interior, (1.0, 0.35, 0.05), 0.2, 0.8, [2, 3], {2: 2.0})


_M = [f"exp({x})" for x in LOGITS]


@query("marginal_dice_ce", "ce:d dice:d loss:d", f"""
    WITH {VOX}, m AS (SELECT slab, CASE WHEN v > 0.2 THEN 3 WHEN v > 0.1 THEN 2 WHEN v > 0 THEN 1 ELSE 0 END AS t0, slab % 3 AS u, {', '.join(f'{e} / ({" + ".join(_M)}) AS p{k}' for k, e in enumerate(_M))} FROM vox),
    r AS (SELECT *, CASE WHEN t0 = u + 1 THEN 0 ELSE t0 END AS t, true AS valid FROM m), c AS (SELECT avg(-ln(CASE t WHEN 0 THEN p0 + CASE u WHEN 0 THEN p1 WHEN 1 THEN p2 ELSE p3 END WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE p3 END)) AS ce FROM r),
    d AS (SELECT slab, cls, (2 * sum(p * y) + 1e-5) / (sum(p) + sum(y) + 1e-5) AS dice FROM ({_SUMS}) GROUP BY 1, 2), a AS (SELECT avg(dice) AS dice FROM d WHERE cls > 0 AND cls <> slab % 3 + 1) SELECT ce, dice, ce - dice AS loss FROM c, a""")
def marginal_dice_ce(spark, sf):
    """One class is unlabelled in each slab; its voxels are background there."""
    r = X.vox(spark, sf).selectExpr("slab", "CASE WHEN v > 0.2D THEN 3 WHEN v > 0.1D THEN 2 WHEN v > 0 THEN 1 ELSE 0 END t", *[f"{x.replace('0.5', '0.5D')} x{k}" for k, x in enumerate(LOGITS)])
    r = r.withColumn("labelled", F.array(F.lit(True), *[F.col("slab") % 3 != k for k in range(3)])).withColumn("t", F.when(F.element_at("labelled", F.col("t") + 1), F.col("t")).otherwise(0))
    return L.marginal_loss(r, "slab", [f"x{k}" for k in range(4)], "t", "labelled")
