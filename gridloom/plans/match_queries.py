"""Queries of joins: neighbours, overlaps, matching, ownership."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.registry import anatomy_of, same_anatomy
from ..operators import matching as M
from ..operators import neighbors as N
from ..session import load
from ..sources import fixtures as X
from .base import AFF, INST_A, INST_B, VOX, query

_A = lambda c: f"(({c} - 1) // 50 + 1)"
#: Overlap pairs and each true id's best one, in SQL.
_OVER = "over_ AS (SELECT gt, pred, count(*) AS overlap FROM inst GROUP BY 1, 2)"
_PAIRS = """pairs AS (SELECT o.gt, o.pred, o.overlap, g.n AS n_gt, p.n AS n_pred, o.overlap / CAST(g.n + p.n - o.overlap AS DOUBLE) AS iou FROM over_ o
        JOIN (SELECT gt, sum(overlap) AS n FROM over_ GROUP BY 1) g ON g.gt = o.gt JOIN (SELECT pred, sum(overlap) AS n FROM over_ GROUP BY 1) p ON p.pred = o.pred WHERE o.gt > 0 AND o.pred > 0)"""
_FRAG = f"""best AS (SELECT *, row_number() OVER (PARTITION BY gt ORDER BY iou DESC, pred) AS r FROM pairs WHERE {_A('gt')} = {_A('pred')}),
    ids AS (SELECT gt, count(*) AS n_gt FROM inst WHERE gt > 0 GROUP BY 1),
    m AS (SELECT ids.gt, ids.n_gt, {_A('ids.gt')} AS anatomy, COALESCE(b.iou, 0) AS iou, COALESCE(b.iou, 0) >= 0.1 AS matched, b.pred, b.overlap, b.n_pred FROM ids LEFT JOIN best b ON b.gt = ids.gt AND b.r = 1),
    t AS (SELECT gt, count(*) AS n_touching FROM pairs WHERE {_A('gt')} = {_A('pred')} GROUP BY 1),
    frag AS (SELECT m.*, CASE WHEN matched THEN m.iou ELSE 0 END AS iou_score, CASE WHEN matched THEN 2.0 * overlap / (m.n_gt + n_pred) ELSE 0 END AS dice_score, greatest(COALESCE(n_touching, 0) - 1, 0) AS split,
        CASE WHEN matched AND count(*) FILTER (matched) OVER (PARTITION BY CASE WHEN matched THEN pred END) = 1 AND COALESCE(n_touching, 0) <= 1 THEN 1 ELSE 0 END AS clean FROM m LEFT JOIN t ON t.gt = m.gt)"""


def _metrics(inst: str) -> str:
    return f"""WITH {VOX}, {inst}, {_OVER}, {_PAIRS}, {_FRAG},
        p AS (SELECT {_A('pred')} AS anatomy, count(DISTINCT pred) AS n_pred FROM inst WHERE pred > 0 GROUP BY 1),
        c AS (SELECT anatomy, count(*) AS n_gt, count(*) FILTER (matched) AS tp, count(DISTINCT CASE WHEN matched THEN pred END) AS used, avg(iou_score) AS iou, avg(dice_score) AS dice, sum(split) AS split_error, avg(clean) AS topology FROM frag GROUP BY 1)
        SELECT c.anatomy, n_gt, tp, used, iou, dice, tp - used AS merge_error, split_error, topology, tp / CAST(greatest(tp + COALESCE(n_pred, 0) - used, 1) AS DOUBLE) AS precision, tp / CAST(greatest(n_gt, 1) AS DOUBLE) AS recall
        FROM c LEFT JOIN p ON p.anatomy = c.anatomy"""


_COLS = "anatomy:l n_gt:l tp:l used:l iou:d dice:d merge_error:l split_error:l topology:d precision:d recall:d"


@query("match_by_anatomy", _COLS, _metrics(INST_B))
def match_by_anatomy(spark, sf):
    return M.case_metrics(X.instances_b(spark, sf))


@query("match_by_anatomy_a", _COLS, _metrics(INST_A))
def match_by_anatomy_a(spark, sf):
    return M.case_metrics(X.instances_a(spark, sf))


@query("match_macro_rollup", "anatomy:l iou:d dice:d precision:d recall:d merge_error:l split_error:l", f"SELECT anatomy, avg(iou) AS iou, avg(dice) AS dice, avg(precision) AS precision, avg(recall) AS recall, sum(merge_error) AS merge_error, sum(split_error) AS split_error FROM ({_metrics(INST_B)}) GROUP BY ROLLUP (anatomy)")
def match_macro_rollup(spark, sf):
    return M.macro(M.case_metrics(X.instances_b(spark, sf)), "anatomy", ["iou", "dice", "precision", "recall"], ["merge_error", "split_error"])


@query("topology_consistency", "gt:l anatomy:l matched:b split:l clean:l iou_score:d", f"WITH {VOX}, {INST_A}, {_OVER}, {_PAIRS}, {_FRAG} SELECT gt, anatomy, matched, split, clean, iou_score FROM frag")
def topology_consistency(spark, sf):
    return M.fragment_rows(X.instances_a(spark, sf))


@query("greedy_iou", "gt:l best_pred:l iou:d tiny:b", f"""
    WITH {VOX}, {INST_B}, {_OVER}, {_PAIRS}, ids AS (SELECT gt, sum(overlap) AS n FROM over_ WHERE gt > 0 GROUP BY 1)
    SELECT ids.gt, b.pred AS best_pred, COALESCE(b.iou, 0) AS iou, ids.n < 1000 AS tiny FROM ids LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY gt ORDER BY iou DESC, pred) AS r FROM pairs) b ON b.gt = ids.gt AND b.r = 1""")
def greedy_iou(spark, sf):
    best = M.best_matches(M.overlaps(X.instances_b(spark, sf)), 0.0, within_anatomy=False)
    return best.select("gt", "best_pred", "iou", (F.col("n_gt") < 1000).alias("tiny"))


@query("iou_for_ids", "gt:l pred:l iou:d", f"WITH {VOX}, {INST_B}, {_OVER}, {_PAIRS} SELECT gt, pred, iou FROM pairs")
def iou_for_ids(spark, sf):
    return M.iou_pairs(M.overlaps(X.instances_b(spark, sf)))


@query("assignment_iou", "anatomy:l gt:l pred:l iou:d")
def assignment_iou(spark, sf):
    g = X.instances_b(spark, sf).withColumn("anatomy", anatomy_of(F.col("gt")))
    return M.assignment(M.overlaps(g, by=["anatomy"]), "anatomy")


@query("unmatched_ids", "side:s id:l", f"""
    WITH {VOX}, {INST_B}, {_OVER}, {_PAIRS}, {_FRAG.replace(">= 0.1", ">= 0.3")} SELECT 'gt' AS side, gt AS id FROM frag WHERE NOT matched
    UNION ALL SELECT 'pred', pred FROM (SELECT DISTINCT pred FROM inst WHERE pred > 0 EXCEPT SELECT pred FROM frag WHERE matched)""")
def unmatched_ids(spark, sf):
    # at the usual limit of 0.1 all match in this fixture
    g = X.instances_b(spark, sf)
    best = M.best_matches(M.overlaps(g), 0.3)
    extra = g.where("pred > 0").select("pred").distinct().join(best.where("matched").select(F.col("matched_pred").alias("pred")), "pred", "left_anti")
    return best.where("NOT matched").select(F.lit("gt").alias("side"), F.col("gt").alias("id")).unionByName(extra.select(F.lit("pred").alias("side"), F.col("pred").alias("id")))


@query("topology_overlaps", "gt:l best_pred:l iou:d n_overlaps:l merged_with:l is_low:b largest:s", f"""
    WITH {VOX}, {INST_B}, {_OVER}, {_PAIRS}, b AS (SELECT gt, pred, iou, row_number() OVER (PARTITION BY gt ORDER BY iou DESC, pred) AS r FROM pairs),
    l AS (SELECT gt, count(*) AS n, string_agg(pred || ':' || overlap, ',' ORDER BY k) FILTER (k <= 5) AS s FROM (SELECT *, row_number() OVER (PARTITION BY gt ORDER BY overlap DESC, pred) AS k FROM pairs) GROUP BY 1)
    SELECT b.gt, b.pred AS best_pred, b.iou, l.n AS n_overlaps, count(*) OVER (PARTITION BY b.pred) - 1 AS merged_with, b.iou < 0.9 AS is_low, l.s AS largest FROM b JOIN l ON l.gt = b.gt WHERE b.r = 1""")
def topology_overlaps(spark, sf):
    return M.many_to_many(M.overlaps(X.instances_b(spark, sf)))


@query("majority_anatomy", "pred:l label:l votes:l", f"""
    WITH {VOX}, {INST_B}, l AS (SELECT inst.pred, vox.label % 4 AS label, count(*) AS n FROM inst JOIN vox USING (z, y, x) WHERE inst.pred > 0 AND vox.label % 4 BETWEEN 1 AND 3 GROUP BY 1, 2)
    SELECT pred, label, n AS votes FROM (SELECT *, row_number() OVER (PARTITION BY pred ORDER BY n DESC, label) AS r FROM l) WHERE r = 1""")
def majority_anatomy(spark, sf):
    g = X.instances_b(spark, sf, "label % 4 label").where("pred > 0 AND label BETWEEN 1 AND 3")
    return M.majority(g.groupBy("pred", "label").agg(F.count(F.lit(1)).alias("both")), "pred", "label").withColumnRenamed("both", "votes")


@query("proposal_ids", "source:l proposal:l n:l nth:l", f"""
    WITH {VOX}, {INST_B} SELECT gt AS source, pred AS proposal, n, row_number() OVER (PARTITION BY gt ORDER BY n DESC, pred) AS nth FROM (SELECT gt, pred, count(*) AS n FROM inst WHERE gt > 0 AND pred BETWEEN 1 AND 200 GROUP BY 1, 2)""")
def proposal_ids(spark, sf):
    c = X.instances_b(spark, sf).where("gt > 0 AND pred BETWEEN 1 AND 200").groupBy(F.col("gt").alias("source"), F.col("pred").alias("proposal")).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("nth", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "proposal")))


def _evidence_sql(d: int, first: int) -> str:
    parts = " UNION ALL ".join(f"SELECT a.pred AS p, b.pred AS q, a.a{first + k} AS aff FROM i a JOIN i b ON b.z = a.z + {dz} AND b.y = a.y + {dy} AND b.x = a.x + {dx} WHERE a.pred <> b.pred" for k, (dz, dy, dx) in enumerate(((d, 0, 0), (0, d, 0), (0, 0, d))))
    return f"WITH {VOX}, {INST_B}, i AS (SELECT z, y, x, pred, {AFF} FROM inst WHERE pred > 0) SELECT least(p, q) AS lo, greatest(p, q) AS hi, avg(1 - aff) AS weight, count(*) AS n FROM ({parts}) GROUP BY 1, 2"


def _evidence(d: int, first: int):
    def f(spark, sf):
        g = X.affinity_columns(X.instances_b(spark, sf))
        return N.pair_evidence(g, "pred", [f"a{first + k}" for k in range(3)], N.axis_offsets(d))

    return f


for _d, _first in ((1, 0), (3, 3), (9, 6)):
    query(f"pair_evidence_r{_d}", "lo:l hi:l weight:d n:l", _evidence_sql(_d, _first))(_evidence(_d, _first))


@query("pair_affinity", "lo:l hi:l affinity:d n:l", f"""
    WITH {VOX}, {INST_B.replace('inst AS', 'all_ AS')}, w AS (SELECT DISTINCT pred AS lo, pred + k AS hi FROM all_, (SELECT unnest(range(1, 5)) AS k) WHERE pred > 0), e AS ({_evidence_sql(1, 0)})
    SELECT w.lo, w.hi, 1 - e.weight AS affinity, COALESCE(e.n, 0) AS n FROM w LEFT JOIN e ON e.lo = w.lo AND e.hi = w.hi""")
def pair_affinity(spark, sf):
    """Each id with the four after it, whether they touch or not, or aren't there."""
    g = X.instances_b(spark, sf)
    wanted = g.where("pred > 0").select(F.col("pred").alias("lo")).distinct().withColumn("hi", F.explode(F.sequence(F.col("lo") + 1, F.col("lo") + 4)))
    return N.pair_affinity(X.affinity_columns(g), "pred", ["a0", "a1", "a2"], N.axis_offsets(), wanted)


_BALL2 = "o AS (SELECT a.i AS dz, b.i AS dy, c.i AS dx FROM (SELECT unnest(range(-2, 3)) AS i) a, (SELECT unnest(range(-2, 3)) AS i) b, (SELECT unnest(range(-2, 3)) AS i) c WHERE a.i * a.i + b.i * b.i + c.i * c.i <= 4)"


@query("adjacent_labels_ball", "lo:l hi:l", f"""
    WITH {VOX}, {INST_B}, {_BALL2}, i AS (SELECT z, y, x, pred FROM inst WHERE pred > 0)
    SELECT DISTINCT least(a.pred, b.pred) AS lo, greatest(a.pred, b.pred) AS hi FROM i a, o JOIN i b ON b.z = a.z + o.dz AND b.y = a.y + o.dy AND b.x = a.x + o.dx WHERE a.pred <> b.pred""")
def adjacent_labels_ball(spark, sf):
    return N.adjacent_pairs(X.instances_b(spark, sf), "pred", 2)


@query("candidate_interface", "slab:l lo:l hi:l voxels:l", f"""
    WITH {VOX}, {INST_B}, {_BALL2}, i AS (SELECT slab, z, y, x, pred FROM inst WHERE pred > 0),
    adj AS (SELECT DISTINCT a.slab, a.pred AS lo, b.pred AS hi FROM i a, o JOIN i b ON b.slab = a.slab AND b.z = a.z + o.dz AND b.y = a.y + o.dy AND b.x = a.x + o.dx WHERE a.pred < b.pred),
    g AS (SELECT DISTINCT slab, pred, z + dz AS z, y + dy AS y, x + dx AS x FROM i, o)
    SELECT a.slab, a.pred AS lo, b.pred AS hi, count(*) AS voxels FROM g a JOIN g b ON a.slab = b.slab AND a.z = b.z AND a.y = b.y AND a.x = b.x AND a.pred < b.pred JOIN adj ON adj.slab = a.slab AND adj.lo = a.pred AND adj.hi = b.pred GROUP BY 1, 2, 3""")
def candidate_interface(spark, sf):
    return N.candidate_interface(X.instances_b(spark, sf), "pred", 2, 2, ["slab"])


_STEP = " UNION ALL ".join(f"SELECT a.z AS z1, a.y AS y1, a.x AS x1, b.z AS z2, b.y AS y2, b.x AS x2, a.gt AS g1, b.gt AS g2 FROM i a JOIN i b ON b.z = a.z + {o[0]} AND b.y = a.y + {o[1]} AND b.x = a.x + {o[2]} WHERE a.gt <> b.gt" for o in N.axis_offsets())
_HALF = " UNION ALL ".join(f"SELECT a.z AS z1, a.y AS y1, a.x AS x1, b.z AS z2, b.y AS y2, b.x AS x2, a.gt AS g1, b.gt AS g2 FROM i a JOIN i b ON b.z = a.z + {o[0]} AND b.y = a.y + {o[1]} AND b.x = a.x + {o[2]} WHERE a.gt <> b.gt" for o in N.forward_offsets())


def _contact_sql(steps: str, block: bool) -> str:
    where = f"WHERE {_A('g1')} = {_A('g2')}" if block else ""
    return f"WITH {VOX}, {INST_B}, i AS (SELECT z, y, x, gt FROM inst WHERE gt > 0), p AS (SELECT * FROM ({steps}) {where}) SELECT z1 AS z, y1 AS y, x1 AS x FROM p UNION SELECT z2, y2, x2 FROM p"


@query("contact_voxels", "z:l y:l x:l", _contact_sql(_STEP, True))
def contact_voxels(spark, sf):
    return N.contact_voxels(X.instances_b(spark, sf), "gt", N.axis_offsets(), same_anatomy)


@query("separator13", "z:l y:l x:l", _contact_sql(_HALF, True))
def separator13(spark, sf):
    return N.contact_voxels(X.instances_b(spark, sf), "gt", N.forward_offsets(), same_anatomy)


@query("edge_breaks", "axis:l valid:l breaks:l", f"""
    WITH {VOX}, {INST_B}, i AS (SELECT z, y, x, gt FROM inst WHERE gt > 0)
    SELECT axis, count(*) AS valid, count(*) FILTER (g1 <> g2) AS breaks FROM ({" UNION ALL ".join(f"SELECT {k} AS axis, a.gt AS g1, b.gt AS g2 FROM i a JOIN i b ON b.z = a.z + {o[0]} AND b.y = a.y + {o[1]} AND b.x = a.x + {o[2]}" for k, o in enumerate(N.axis_offsets()))}) GROUP BY 1""")
def edge_breaks(spark, sf):
    return N.edge_breaks(X.instances_b(spark, sf), "gt")


_NINE = [o for d in (1, 3, 9) for o in N.axis_offsets(d)]


@query("affinity_targets", "k:l inside:l same:l positive:l", f"""
    WITH {VOX}, {INST_B} SELECT k, count(*) AS inside, count(*) FILTER (a = b AND a > 0) AS same, count(*) FILTER (a > 0 AND b > 0) AS positive FROM (
        {" UNION ALL ".join(f"SELECT {k} AS k, a.gt AS a, b.gt AS b FROM inst a JOIN inst b ON b.z = a.z + {o[0]} AND b.y = a.y + {o[1]} AND b.x = a.x + {o[2]}" for k, o in enumerate(_NINE))}) GROUP BY k""")
def affinity_targets(spark, sf):
    t = N.affinity_targets(X.instances_b(spark, sf), "gt", _NINE)
    return t.groupBy("k").agg(F.count(F.lit(1)).alias("inside"), F.count_if("same").alias("same"), F.count_if("both").alias("positive"))


_BALL26 = "o AS (SELECT a.i AS dz, b.i AS dy, c.i AS dx FROM (SELECT unnest(range(-1, 2)) AS i) a, (SELECT unnest(range(-1, 2)) AS i) b, (SELECT unnest(range(-1, 2)) AS i) c)"


@query("surface_fraction", "gt:l n:l surface:l fraction:d", f"""
    WITH {VOX}, {INST_B}, {_BALL26}, i AS (SELECT z, y, x, gt FROM inst WHERE gt > 0),
    inner_ AS (SELECT gt, count(*) AS n FROM (SELECT a.gt, a.z, a.y, a.x FROM i a, o JOIN i b ON b.z = a.z + o.dz AND b.y = a.y + o.dy AND b.x = a.x + o.dx AND b.gt = a.gt GROUP BY ALL HAVING count(*) = 27) GROUP BY 1)
    SELECT t.gt, t.n, t.n - COALESCE(inner_.n, 0) AS surface, (t.n - COALESCE(inner_.n, 0)) / CAST(t.n AS DOUBLE) AS fraction FROM (SELECT gt, count(*) AS n FROM i GROUP BY 1) t LEFT JOIN inner_ ON inner_.gt = t.gt""")
def surface_fraction(spark, sf):
    return N.surface_fraction(X.instances_b(spark, sf), "gt")


@query("contact_distance", "gt:l near:l mean:d least:d", f"""
    WITH {VOX}, {INST_B}, {_BALL2}, i AS (SELECT z, y, x, gt FROM inst WHERE gt > 0),
    d AS (SELECT a.z, a.y, a.x, a.gt, min(sqrt(o.dz * o.dz + o.dy * o.dy + o.dx * o.dx)) AS d FROM i a, o JOIN i b ON b.z = a.z + o.dz AND b.y = a.y + o.dy AND b.x = a.x + o.dx WHERE a.gt <> b.gt AND {_A('a.gt')} = {_A('b.gt')} GROUP BY ALL)
    SELECT gt, count(*) AS near, avg(d) AS mean, min(d) AS least FROM d GROUP BY 1""")
def contact_distance(spark, sf):
    d = N.distance_to_other(X.instances_b(spark, sf), "gt", 2.0, same_anatomy).where("distance IS NOT NULL")
    return d.groupBy("gt").agg(F.count(F.lit(1)).alias("near"), F.avg("distance").alias("mean"), F.min("distance").alias("least"))


@query("merge_masks", "anatomy:l source:s n:l fraction:d", f"""
    WITH {VOX}, p AS (SELECT label % 4 AS anatomy, count(*) AS n FROM vox WHERE v > 0.1 AND label % 4 <> 2 GROUP BY 1), b AS (SELECT label % 5 AS anatomy, count(*) AS n FROM vox WHERE v > 0 GROUP BY 1), t AS (SELECT count(*) AS n FROM vox)
    SELECT COALESCE(p.anatomy, b.anatomy) AS anatomy, CASE WHEN p.n / CAST(t.n AS DOUBLE) < 0.04 THEN 'primary' WHEN b.n > 0 THEN 'fallback' ELSE 'none' END AS source, CASE WHEN p.n / CAST(t.n AS DOUBLE) < 0.04 THEN p.n WHEN b.n > 0 THEN b.n ELSE 0 END AS n, p.n / CAST(t.n AS DOUBLE) AS fraction
    FROM p FULL JOIN b ON p.anatomy = b.anatomy, t""")
def merge_masks(spark, sf):
    v = X.vox(spark, sf)
    total = v.agg(F.count(F.lit(1)).alias("t"))  # one row
    p = v.where("v > 0.1 AND label % 4 <> 2").groupBy((F.col("label") % 4).alias("anatomy")).agg(F.count(F.lit(1)).alias("np"))
    b = v.where("v > 0").groupBy((F.col("label") % 5).alias("anatomy")).agg(F.count(F.lit(1)).alias("nb"))
    sane = (F.col("np") > 0) & (F.col("np") / F.col("t") < 0.04)
    return p.join(b, "anatomy", "full_outer").join(total, F.lit(True)).select("anatomy", F.when(sane, "primary").when(F.col("nb") > 0, "fallback").otherwise("none").alias("source"), F.when(sane, F.col("np")).when(F.col("nb") > 0, F.col("nb")).otherwise(0).alias("n"), (F.col("np") / F.col("t")).alias("fraction"))


@query("confine", "voxel:l part:l", "SELECT DISTINCT l_orderkey AS voxel, l_partkey AS part FROM lineitem a WHERE l_returnflag = 'R' AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_returnflag = 'A')")
def confine(spark, sf):
    # a voxel (order) owned by another anatomy (flag) is out of bounds
    rows = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("voxel"), F.col("l_partkey").alias("part"), "l_returnflag")
    other = rows.where("l_returnflag = 'A'").select("voxel").distinct()
    return rows.where("l_returnflag = 'R'").select("voxel", "part").distinct().join(other, "voxel", "left_anti")


@query("first_writer", "part:l flag:s owner:l", """
    SELECT part, flag, owner FROM (SELECT l_partkey AS part, l_returnflag AS flag, l_orderkey AS owner, row_number() OVER (PARTITION BY l_partkey ORDER BY l_returnflag, l_orderkey) AS r FROM lineitem) WHERE r = 1""")
def first_writer(spark, sf):
    # the first of a fixed order wins a voxel: a minimum, with partial sums, instead of a sort
    l = load(spark, sf, "lineitem")
    return l.groupBy(F.col("l_partkey").alias("part")).agg(F.min(F.struct("l_returnflag", "l_orderkey")).alias("m")).select("part", F.col("m.l_returnflag").alias("flag"), F.col("m.l_orderkey").alias("owner"))


@query("laterality", "slab:l own:l inside:l dropped:b", f"""
    WITH {VOX} SELECT slab, count(*) AS own, count(*) FILTER (w > 0) AS inside, count(*) FILTER (w > 0) > 0.5 * count(*) AS dropped FROM (SELECT slab, v, v - (y - 3) * 0.02 AS w FROM vox) WHERE v > 0.05 GROUP BY 1""")
def laterality(spark, sf):
    v = X.vox(spark, sf).where("v > 0.05").withColumn("w", F.expr("v - (y - 3) * 0.02D"))
    g = v.groupBy("slab").agg(F.count(F.lit(1)).alias("own"), F.count_if(F.col("w") > 0).alias("inside"))
    return g.withColumn("dropped", F.col("inside") > 0.5 * F.col("own"))
