"""Queries of the whole scan plan: routing, mask sources, steps, and the label map of every listed scan.

Scans are slabs of 50 planes, and one more that is listed without voxels. Masks and pieces are rules of the values, chosen so
that every branch occurs: masks too large and empty ones, swapped hips, missing bone, regions out of time, failing regions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scan_plan as P
from ..sources import fixtures as X
from .base import VOX, query

RULES = P.Rules(most_share=0.25, parts="union", pad=3, soft=8.0)


def scene(spark, sf):
    """(scans, volume, primary, bones)."""
    v = X.vox(spark, sf).selectExpr("slab scan", "z - slab * 50 z", "y", "x", "v", "label")
    there = v.groupBy("scan").agg((F.max("z") + 1).alias("nz"), F.lit(8).cast("long").alias("ny"), F.lit(8).cast("long").alias("nx"))
    listed = there.unionByName(v.agg((F.max("scan") + 1).alias("scan")).selectExpr("scan", "50L nz", "8L ny", "8L nx"))
    primary = v.where("v > CASE scan % 5 WHEN 1 THEN -9 WHEN 2 THEN 9 ELSE 0.05D END").selectExpr("scan", "1 + label % 4 anatomy", "z", "y", "x")
    bones = v.where("v > 0.04D AND scan % 5 <> 3").selectExpr("scan", "CASE WHEN scan % 4 = 1 THEN IF(label % 4 IN (1, 2), 3, 1) ELSE 1 + label % 3 END anatomy", "z", "y", "x")
    return listed, v.drop("label"), primary, bones


def by_rule(regions):
    """Stands for a decoder: pieces by place where the value is positive; one region in some scans fails."""
    bad = F.expr("scan % 5 = 4 AND anatomy = 2")
    good = regions.where(F.col("v") > 0).selectExpr("scan", "anatomy", "z", "y", "x", "1 + (z + y) % 3 piece", "cast(null as string) failed")
    return good.unionByName(regions.where(bad).groupBy("scan", "anatomy").agg(F.min("z").alias("z"), F.min("y").alias("y"), F.min("x").alias("x")).selectExpr("*", "0L piece", "'by rule' failed"))


_SCENE = f"""{VOX}, v AS (SELECT slab AS scan, z - slab * 50 AS z, y, x, v, label FROM vox),
    scans AS (SELECT scan, max(z) + 1 AS nz FROM v GROUP BY 1 UNION ALL SELECT max(scan) + 1, 50 FROM v),
    pri AS (SELECT scan, 1 + label % 4 AS anatomy, z, y, x FROM v WHERE v > CASE scan % 5 WHEN 1 THEN -9 WHEN 2 THEN 9 ELSE 0.05 END),
    bon AS (SELECT scan, CASE WHEN scan % 4 = 1 THEN CASE WHEN label % 4 IN (1, 2) THEN 3 ELSE 1 END ELSE 1 + label % 3 END AS anatomy, z, y, x FROM v WHERE v > 0.04 AND scan % 5 <> 3),
    cnt AS (SELECT s.scan, a.anatomy, s.nz * 64 AS total, (SELECT count(*) FROM pri p WHERE p.scan = s.scan AND p.anatomy = a.anatomy) AS n, (SELECT count(*) FROM bon b WHERE b.scan = s.scan AND b.anatomy = a.anatomy) AS bone,
        CASE WHEN a.anatomy IN (2, 3) THEN (SELECT count(*) FROM pri p JOIN bon b USING (scan, z, y, x) WHERE p.scan = s.scan AND p.anatomy = a.anatomy AND b.anatomy = 5 - a.anatomy) ELSE 0 END AS swapped FROM scans s, (SELECT unnest([1, 2, 3, 4]) AS anatomy) a),
    led AS (SELECT scan, max(n) AS biggest, arg_min(anatomy, -n * 10 + anatomy) AS leader FROM cnt GROUP BY 1),
    rou AS (SELECT cnt.*, (CASE WHEN biggest > 0 THEN n >= 0.2 * biggest ELSE anatomy <= 3 END OR (anatomy <= 3 AND leader <= 3 AND bone > 0)) AND NOT (anatomy IN (2, 3) AND bone = 0 AND n > 0 AND swapped > 0.5 * n) AS routed FROM cnt JOIN led ON led.scan = cnt.scan)"""
_SOURCES = f"""{_SCENE}, src AS (SELECT *, CASE WHEN routed THEN CASE WHEN n > 0 AND n / total < 0.25 THEN 'primary' WHEN bone > 0 THEN 'fallback' ELSE 'none' END END AS source FROM rou),
    sou AS (SELECT *, CASE WHEN routed THEN CASE source WHEN 'fallback' THEN bone / total ELSE n / total END END AS fraction FROM src)"""
_STEPS = f"""{_SOURCES}, mask AS (SELECT p.* FROM pri p JOIN sou s ON s.scan = p.scan AND s.anatomy = p.anatomy AND source = 'primary' UNION ALL SELECT b.* FROM bon b JOIN sou s ON s.scan = b.scan AND s.anatomy = b.anatomy AND source = 'fallback'),
    box AS (SELECT mask.scan, anatomy, greatest(min(z) - 3, 0) AS z0, least(max(z) + 4, nz) AS z1, greatest(min(y) - 3, 0) AS y0, least(max(y) + 4, 8) AS y1, greatest(min(x) - 3, 0) AS x0, least(max(x) + 4, 8) AS x1, nz FROM mask JOIN scans ON scans.scan = mask.scan GROUP BY mask.scan, anatomy, nz),
    tim AS (SELECT *, (z1 - z0) * (y1 - y0) * (x1 - x0) / (nz * 64) AS box_share, 2.5 AS eta, 2.5 * row_number() OVER (PARTITION BY scan ORDER BY anatomy) <= 8 AS in_time FROM box),
    fail AS (SELECT DISTINCT t.scan, t.anatomy FROM tim t JOIN v ON v.scan = t.scan WHERE in_time AND t.scan % 5 = 4 AND t.anatomy = 2 AND v.z >= z0 AND v.z < z1 AND v.y >= y0 AND v.y < y1 AND v.x >= x0 AND v.x < x1),
    pie AS (SELECT t.scan, t.anatomy, v.z, v.y, v.x, 1 + (v.z + v.y) % 3 AS piece FROM tim t JOIN v ON v.scan = t.scan WHERE in_time AND v > 0 AND v.z >= z0 AND v.z < z1 AND v.y >= y0 AND v.y < y1 AND v.x >= x0 AND v.x < x1 AND t.scan NOT IN (SELECT scan FROM fail)),
    slo AS (SELECT scan, anatomy, piece, row_number() OVER (PARTITION BY scan, anatomy ORDER BY piece) AS slot FROM (SELECT DISTINCT scan, anatomy, piece FROM pie)),
    fre AS (SELECT p.*, slot FROM pie p JOIN slo USING (scan, anatomy, piece) WHERE NOT EXISTS (SELECT 1 FROM mask m WHERE m.scan = p.scan AND m.z = p.z AND m.y = p.y AND m.x = p.x AND m.anatomy <> p.anatomy)),
    ids AS (SELECT scan, z, y, x, anatomy, (anatomy - 1) * 50 + slot AS id FROM fre QUALIFY row_number() OVER (PARTITION BY scan, z, y, x ORDER BY anatomy) = 1)"""


@query("routed_anatomies", "scan:l anatomy:l n:l bone:l swapped:l routed:b", f"WITH {_SCENE} SELECT * FROM rou")
def routed_anatomies(spark, sf):
    scans, _, primary, bones = scene(spark, sf)
    return P.routed(P.counts(scans, primary, bones), RULES)


@query("mask_sources", "scan:l anatomy:l source:s percent:d", f"WITH {_SOURCES} SELECT *, fraction * 100 AS percent FROM sou")
def mask_sources(spark, sf):
    scans, _, primary, bones = scene(spark, sf)
    return P.sourced(P.routed(P.counts(scans, primary, bones), RULES), RULES).withColumn("percent", F.col("fraction") * 100)


@query("scan_plan", "scan:l anatomy:l n:l bone:l routed:b source:s percent:d box_percent:d eta:d status:s why:s ids:l voxels:l", f"""
    WITH {_STEPS}, o AS (SELECT scan, anatomy, count(DISTINCT id) AS ids, count(*) AS voxels FROM ids GROUP BY 1, 2), last AS (SELECT max(scan) AS scan FROM scans)
    SELECT s.scan, s.anatomy, n, bone, routed, source, fraction * 100 AS percent, box_share * 100 AS box_percent, eta,
        CASE WHEN NOT routed THEN 'not routed' WHEN eta IS NULL THEN 'no mask' WHEN NOT in_time THEN 'no time' WHEN f.scan IS NOT NULL THEN 'failed' WHEN s.scan IN (SELECT scan FROM fail) OR s.scan = last.scan THEN 'scan failed' WHEN voxels IS NULL THEN 'empty' ELSE 'painted' END AS status,
        CASE WHEN f.scan IS NOT NULL THEN 'by rule' WHEN s.scan IN (SELECT scan FROM fail) THEN 'a region failed' WHEN s.scan = last.scan THEN 'no voxels' END AS why, COALESCE(ids, 0) AS ids, COALESCE(voxels, 0) AS voxels
    FROM sou s LEFT JOIN tim t ON t.scan = s.scan AND t.anatomy = s.anatomy LEFT JOIN fail f ON f.scan = s.scan AND f.anatomy = s.anatomy LEFT JOIN o ON o.scan = s.scan AND o.anatomy = s.anatomy, last""")
def scan_plan(spark, sf):
    steps = P.run(*scene(spark, sf), by_rule, RULES).steps
    return steps.withColumns({"percent": F.col("fraction") * 100, "box_percent": F.col("box_share") * 100})


@query("scan_label_map", "scan:l id:l voxels:l sz:l sy:l sx:l", f"""
    WITH {_STEPS} SELECT v.scan, COALESCE(id, 0) AS id, count(*) AS voxels, sum(v.z) AS sz, sum(v.y) AS sy, sum(v.x) AS sx FROM v LEFT JOIN ids ON ids.scan = v.scan AND ids.z = v.z AND ids.y = v.y AND ids.x = v.x GROUP BY 1, 2""")
def scan_label_map(spark, sf):
    """The label map of every scan, all zero for those that failed."""
    scans, volume, primary, bones = scene(spark, sf)
    out = P.label_map(volume, P.run(scans, volume, primary, bones, by_rule, RULES).ids)
    return out.groupBy("scan", "id").agg(F.count(F.lit(1)).alias("voxels"), F.sum("z").alias("sz"), F.sum("y").alias("sy"), F.sum("x").alias("sx"))
