"""Queries of instance sidecars and their checks. Samples are slabs; classes are a rule of the values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sidecars as S
from ..sources import fixtures as X
from .base import INST_B, VOX, query

_CLS = "CASE WHEN gt > 0 THEN CASE WHEN v > 0.25 AND slab % 3 <> 1 THEN 4 WHEN v > 0.1 THEN 3 ELSE 2 END WHEN v > -0.1 THEN 1 ELSE 0 END"
_KEY = "(z * 7919 + y * 104729 + x * 1299709) % 1000003"
MOST, TINY = 40, 40


def _grid(spark, sf):
    return X.instances_b(spark, sf).selectExpr("slab sample", "z - slab * 50 z", "y", "x", "gt id", f"cast({_CLS} as bigint) cls")


_MARKS = f"""{VOX}, {INST_B}, g AS (SELECT slab AS sample, z - slab * 50 AS z, y, x, gt AS id, {_CLS} AS cls FROM inst),
    d AS (SELECT * FROM (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) AS d(dz, dy, dx)),
    e AS (SELECT DISTINCT a.sample, a.z, a.y, a.x FROM g a, d JOIN g b ON b.sample = a.sample AND b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx WHERE a.id > 0 AND b.id > 0 AND a.id <> b.id AND (a.id - 1) // 50 = (b.id - 1) // 50),
    n AS (SELECT sample, id, count(*) AS n FROM g WHERE id BETWEEN 1 AND 200 GROUP BY 1, 2), h AS (SELECT sample, bool_or(cls = 4) AS touches FROM g GROUP BY 1),
    m AS (SELECT g.*, e.z IS NOT NULL AS edge, cls = 4 OR (NOT touches AND e.z IS NOT NULL) AS contact, COALESCE(n.n <= {TINY}, false) AS tiny, cls IN (2, 3, 4) AS support
        FROM g JOIN h ON h.sample = g.sample LEFT JOIN e ON e.sample = g.sample AND e.z = g.z AND e.y = g.y AND e.x = g.x LEFT JOIN n ON n.sample = g.sample AND n.id = g.id),
    p AS (SELECT sample, z, y, x, 'contact_locations' AS pool FROM m WHERE contact UNION ALL SELECT sample, z, y, x, 'tiny_locations' FROM m WHERE tiny UNION ALL SELECT sample, z, y, x, 'support_locations' FROM m WHERE support AND NOT contact
        UNION ALL SELECT sample, z, y, x, 'hard_negative_locations' FROM m WHERE cls = 1 UNION ALL SELECT sample, z, y, x, 'edge_locations' FROM m WHERE edge),
    k AS (SELECT *, row_number() OVER (PARTITION BY sample, pool ORDER BY {_KEY}, z, y, x) AS rank FROM p QUALIFY rank <= {MOST})"""


@query("sidecar_locations", "sample:l pool:s rank:l z:l y:l x:l", f"WITH {_MARKS} SELECT * FROM k")
def sidecar_locations(spark, sf):
    return S.locations(S.marked(_grid(spark, sf), TINY), MOST, F.expr(_KEY), 1_000_003)


@query("sidecar_audit", "sample:l fragments:l support:l background:l contact_voxels:l tiny_voxels:l support_voxels:l edge_voxels:l contact_locations:l tiny_locations:l edge_locations:l covered:b", f"""
    WITH {_MARKS}, c AS (SELECT sample, count(*) FILTER (pool = 'contact_locations') AS contact_locations, count(*) FILTER (pool = 'tiny_locations') AS tiny_locations, count(*) FILTER (pool = 'edge_locations') AS edge_locations FROM k GROUP BY 1)
    SELECT m.sample, (SELECT count(*) FROM n WHERE n.sample = m.sample) AS fragments, count(*) FILTER (support) AS support, count(*) FILTER (cls = 0) AS background, count(*) FILTER (contact) AS contact_voxels, count(*) FILTER (tiny) AS tiny_voxels,
        count(*) FILTER (support AND NOT contact) AS support_voxels, count(*) FILTER (edge) AS edge_voxels, any_value(contact_locations) AS contact_locations, any_value(tiny_locations) AS tiny_locations, any_value(edge_locations) AS edge_locations, bool_and(id = 0 OR support) AS covered
    FROM m JOIN c ON c.sample = m.sample GROUP BY m.sample""")
def sidecar_audit(spark, sf):
    from ..cluster import shared_dir
    import uuid

    out = f"{shared_dir(spark)}/sidecars-{uuid.uuid4().hex}"
    for _ in range(2):  # the second run finds everything built
        S.build(_grid(spark, sf), out, MOST, TINY, F.expr(_KEY), 1_000_003)
    return spark.read.parquet(f"{out}/audit")


@query("target_violations", "sample:l id:l rule:s n:l", f"""
    WITH {VOX}, {INST_B}, g AS (SELECT slab AS sample, gt AS id, CASE WHEN v > 0.35 THEN 9 WHEN v > 0.22 THEN 4 WHEN v > -0.01 THEN 3 WHEN v > -0.2 THEN 1 ELSE 0 END AS target FROM inst),
    a AS (SELECT sample, id, count(*) FILTER (target = 9) AS unknown, CASE WHEN id > 0 AND count(*) FILTER (target = 4) = 0 THEN 1 ELSE 0 END AS core, count(*) FILTER (id = 0 AND target IN (3, 4)) AS outside FROM g GROUP BY 1, 2)
    SELECT * FROM (SELECT sample, id, 'unknown label' AS rule, unknown AS n FROM a UNION ALL SELECT sample, id, 'no core', core FROM a UNION ALL SELECT sample, id, 'outside', outside FROM a) WHERE n > 0""")
def target_violations(spark, sf):
    return S.violations(X.instances_b(spark, sf).selectExpr("slab sample", "gt id", "CASE WHEN v > 0.35D THEN 9 WHEN v > 0.22D THEN 4 WHEN v > -0.01D THEN 3 WHEN v > -0.2D THEN 1 ELSE 0 END target"))
