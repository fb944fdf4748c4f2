"""Queries of sources, sinks, resampling, blending and dataset building."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.registry import anatomies, anatomy_of
from ..operators import ranking as R
from ..operators import reports as RP
from ..operators import resample as RS
from ..session import load
from ..sources import fixtures as X
from ..sources import volumes as V
from ..streaming.status import windowed_status
from .base import INST_B, VOX, query


@query("write_label_map", "slab:l value:l n:l", f"WITH {VOX} SELECT slab, greatest(least(CAST(floor(v * 1000) AS BIGINT), 200), 0) AS value, count(*) AS n FROM vox GROUP BY 1, 2")
def write_label_map(spark, sf):
    return X.vox(spark, sf).groupBy("slab", V.label_values(F.floor(F.col("v") * 1000.0)).alias("value")).agg(F.count(F.lit(1)).alias("n"))


@query("zero_output", "slab:l n:l total:l reason:s", f"WITH {VOX} SELECT slab, count(*) AS n, 0 AS total, 'no foreground' AS reason FROM vox GROUP BY 1")
def zero_output(spark, sf):
    # the fallback keeps every key: a left join to results that aren't there
    v = X.vox(spark, sf).select("slab", "z", "y", "x")
    nothing = v.where("false").withColumn("id", F.lit(1))
    return v.join(nothing, ["slab", "z", "y", "x"], "left").groupBy("slab").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("id", F.lit(0))).alias("total")).withColumn("reason", F.lit("no foreground"))


@query("crop_affine", "slab:l n:l ox:d oy:d oz:d", f"WITH {VOX} SELECT slab, count(*) AS n, 10 + 2 * 1.5 AS ox, 20 - 1 * 1.0 AS oy, slab * 50 * 0.8 + 5 * 0.8 AS oz FROM vox WHERE z - slab * 50 BETWEEN 5 AND 14 AND y BETWEEN 1 AND 6 AND x BETWEEN 2 AND 5 GROUP BY slab")
def crop_affine(spark, sf):
    v = X.vox(spark, sf).withColumn("z", F.col("z") - F.col("slab") * 50)
    c = V.crop(v, {"z": (5, 15), "y": (1, 7), "x": (2, 6)}).groupBy("slab").agg(F.count(F.lit(1)).alias("n"))
    lit = lambda *a: [F.lit(float(x)) for x in a]
    o = V.cropped_origin([F.lit(10.0), F.lit(20.0), F.col("slab") * 50 * 0.8], lit(1, 0, 0, 0, -1, 0, 0, 0, 1), lit(1.5, 1.0, 0.8), lit(2, 1, 5))
    return c.select("slab", "n", o[0].alias("ox"), o[1].alias("oy"), o[2].alias("oz"))


@query("case_presence", "seg:s complete:l partial:l", "SELECT seg, count(*) FILTER (k = 2) AS complete, count(*) FILTER (k < 2) AS partial FROM (SELECT c_mktsegment AS seg, c_nationkey AS n, count(DISTINCT c_custkey % 2) AS k FROM customer GROUP BY 1, 2) GROUP BY 1")
def case_presence(spark, sf):
    c = load(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("seg"), "c_nationkey").agg(F.count_distinct(F.col("c_custkey") % 2).alias("k"))
    return c.groupBy("seg").agg(F.count_if(F.col("k") == 2).alias("complete"), F.count_if(F.col("k") < 2).alias("partial"))


@query("first_of_sources", "id:l value:d origin:s", "SELECT p_partkey AS id, COALESCE(a, b, 0) AS value, CASE WHEN a IS NOT NULL THEN 'first' WHEN b IS NOT NULL THEN 'second' ELSE 'none' END AS origin FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice END AS a, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS b FROM part)")
def first_of_sources(spark, sf):
    p = load(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_retailprice")).alias("a"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("double")).alias("b"))
    return p.select("id", F.coalesce("a", "b", F.lit(0.0)).alias("value"), F.when(F.col("a").isNotNull(), "first").when(F.col("b").isNotNull(), "second").otherwise("none").alias("origin"))


@query("threshold_sweep", "t:d slab:l n:l", f"WITH {VOX} SELECT t / 20.0 AS t, slab, count(*) FILTER (v >= t / 20.0) AS n FROM vox, (SELECT unnest(range(0, 5)) AS t) GROUP BY 1, 2")
def threshold_sweep(spark, sf):
    # one pass for all thresholds: a count column each, then rows
    ts = [k / 20.0 for k in range(5)]
    wide = X.vox(spark, sf).groupBy("slab").agg(*[F.count_if(F.col("v") >= t).alias(f"n{k}") for k, t in enumerate(ts)])
    return wide.select("slab", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col(f"n{k}").alias("n")) for k, t in enumerate(ts)])).alias("r")).select("r.t", "slab", "r.n")


@query("audit_metadata", "slab:l least:d most:d changed:l", f"WITH {VOX} SELECT slab, min(greatest(least(v * 8000, 2000), -1000)) AS least, max(greatest(least(v * 8000, 2000), -1000)) AS most, count(*) FILTER (v * 8000 NOT BETWEEN -1000 AND 2000) AS changed FROM vox GROUP BY 1")
def audit_metadata(spark, sf):
    from ..functions.scalar import clip_hu

    v = X.vox(spark, sf).select("slab", (F.col("v") * 8000.0).alias("h")).withColumn("c", clip_hu(F.col("h")))
    return v.groupBy("slab").agg(F.min("c").alias("least"), F.max("c").alias("most"), F.count_if(F.col("c") != F.col("h")).alias("changed"))


@query("obj_mesh", "k:l n:l value:s", "SELECT 0 AS k, s_suppkey AS n, format('v {:.6f} {:.6f} {:.6f}', CAST(s_suppkey % 7 AS DOUBLE), CAST(s_suppkey % 5 AS DOUBLE), CAST(s_nationkey AS DOUBLE)) AS value FROM supplier UNION ALL SELECT 1, s_suppkey, 'f ' || s_suppkey || ' ' || (s_suppkey + 1) || ' ' || (s_suppkey + 2) FROM supplier")
def obj_mesh(spark, sf):
    s = load(spark, sf, "supplier")
    v = s.selectExpr("s_suppkey n", "double(s_suppkey % 7) x", "double(s_suppkey % 5) y", "double(s_nationkey) z")
    return V.obj_lines(v, s.selectExpr("s_suppkey n", "s_suppkey - 1 a", "s_suppkey b", "s_suppkey + 1 c"))


@query("report_json", "id:l payload:s", """SELECT s_suppkey AS id, '{"name":"' || s_name || '","nation":' || s_nationkey || '}' AS payload FROM supplier""")
def report_json(spark, sf):
    return load(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.to_json(F.struct(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))).alias("payload"))


@query("evals_ranked", "event_id:l k:l rank:l", "SELECT event_id, k, row_number() OVER (ORDER BY COALESCE(k, -1) DESC, event_id) AS rank FROM (SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE k IS NOT NULL")
def evals_ranked(spark, sf):
    e = load(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")).where("k IS NOT NULL")
    return R.ranked(e, "rank", F.desc("k"), F.col("event_id"))


@query("resample_nearest", "slab:l z:l y:l x:l gt:l", f"WITH {VOX}, {INST_B} SELECT t.slab, t.z, t.y, t.x, i.gt FROM (SELECT s AS slab, z, y, x FROM (SELECT DISTINCT slab AS s FROM inst), (SELECT unnest(range(0, 25)) AS z), (SELECT unnest(range(0, 4)) AS y), (SELECT unnest(range(0, 4)) AS x)) t JOIN inst i ON i.slab = t.slab AND i.z = t.slab * 50 + t.z * 2 + 1 AND i.y = t.y * 2 + 1 AND i.x = t.x * 2 + 1")
def resample_nearest(spark, sf):
    # half the resolution: a voxel's centre falls on the source's 2i + 1; arithmetic on coordinates, no join
    g = X.instances_b(spark, sf).withColumn("z", F.col("z") - F.col("slab") * 50)
    return g.where("z % 2 = 1 AND y % 2 = 1 AND x % 2 = 1").selectExpr("slab", "z div 2 z", "y div 2 y", "x div 2 x", "gt")


def _corner_takes(name: str, n: int, m: int) -> str:
    c = f"(o * {n - 1} / {float(m - 1)})"
    return f"""{name} AS (SELECT o, least(i, {n - 1}) AS i, sum(w) AS w FROM (SELECT o, floor({c}) AS i, 1 - ({c} - floor({c})) AS w FROM (SELECT unnest(range(0, {m})) AS o) UNION ALL SELECT o, floor({c}) + 1, {c} - floor({c}) FROM (SELECT unnest(range(0, {m})) AS o)) GROUP BY 1, 2)"""


@query("resize_linear", "slab:l n:l total:d", f"""
    WITH {VOX}, {_corner_takes('tz', 50, 25)}, {_corner_takes('ty', 8, 12)}, {_corner_takes('tx', 8, 12)},
    h AS (SELECT slab, tz.o AS z, ty.o AS y, tx.o AS x, sum((0.5 + v) * tz.w * ty.w * tx.w) AS v FROM vox JOIN tz ON tz.i = z - slab * 50 JOIN ty ON ty.i = y JOIN tx ON tx.i = x GROUP BY 1, 2, 3, 4)
    SELECT slab, count(*) AS n, sum(greatest(least(v, 1), 0)) AS total FROM h GROUP BY 1""")
def resize_linear(spark, sf):
    # probabilities to another shape, corner on corner
    v = X.vox(spark, sf).select("slab", (F.col("z") - F.col("slab") * 50).alias("z"), "y", "x", (0.5 + F.col("v")).alias("v"))
    shapes = v.select("slab").distinct().selectExpr("slab", "50L nz", "8L ny", "8L nx", "25L mz", "12L my", "12L mx")
    return RS.values(v, shapes, ["slab"], ["v"], corners=True).groupBy("slab").agg(F.count(F.lit(1)).alias("n"), F.sum(F.greatest(F.least("v", F.lit(1.0)), F.lit(0.0))).alias("total"))


@query("blend_tiles", "z:l y:l value:d weight:d", f"""
    WITH {VOX}, t AS (SELECT z, y, x, v, k, exp(-((z - (k * 4 + 4)) ** 2) / 8.0) AS w FROM vox, (SELECT unnest([-1, 0]) AS o), LATERAL (SELECT z // 4 + o AS k) WHERE k >= 0)
    SELECT z, y, sum(w * (v + 0.01 * k)) / sum(w) AS value, sum(w) AS weight FROM t GROUP BY 1, 2""")
def blend_tiles(spark, sf):
    # half-overlapping tiles along z, each with its own prediction (here the value plus a tile offset), blended by gaussian weights
    v = X.vox(spark, sf).withColumn("k", F.explode(F.array(F.expr("z div 4 - 1"), F.expr("z div 4")))).where("k >= 0")
    w = F.exp(-F.pow(F.col("z") - (F.col("k") * 4 + 4), 2) / 8.0)
    return v.withColumn("w", w).groupBy("z", "y").agg((F.sum(F.col("w") * (F.col("v") + 0.01 * F.col("k"))) / F.sum("w")).alias("value"), F.sum("w").alias("weight"))


@query("roi_rows", "slab:l name:s z0:l z1:l voxels:l ids:l", f"""
    WITH {VOX}, {INST_B} SELECT slab, CASE a WHEN 1 THEN 'Sacrum' WHEN 2 THEN 'LeftHip' WHEN 3 THEN 'RightHip' ELSE 'Femur' END AS name, greatest(min(z) - 2, slab * 50) AS z0, least(max(z) + 3, slab * 50 + 50) AS z1, count(*) AS voxels, count(DISTINCT gt) AS ids
    FROM (SELECT slab, z, gt, (gt - 1) // 50 + 1 AS a FROM inst WHERE gt > 0) GROUP BY slab, a""")
def roi_rows(spark, sf):
    g = X.instances_b(spark, sf).where("gt > 0").withColumn("anatomy", anatomy_of(F.col("gt")))
    r = g.groupBy("slab", "anatomy").agg((F.min("z") - 2).alias("a"), (F.max("z") + 3).alias("b"), F.count(F.lit(1)).alias("voxels"), F.count_distinct("gt").alias("ids"))
    return r.join(anatomies(spark), "anatomy").select("slab", "name", F.greatest("a", F.col("slab") * 50).alias("z0"), F.least("b", F.col("slab") * 50 + 50).alias("z1"), "voxels", "ids")


@query("semantic_rows", "slab:l valid:b classes:l", f"WITH {VOX}, {INST_B} SELECT slab, bool_and(c BETWEEN 0 AND 4) AS valid, count(DISTINCT c) AS classes FROM (SELECT slab, CASE WHEN gt BETWEEN 1 AND 200 THEN (gt - 1) // 50 + 1 ELSE 0 END AS c FROM inst) GROUP BY 1")
def semantic_rows(spark, sf):
    g = X.instances_b(spark, sf).select("slab", anatomy_of(F.col("gt")).alias("c"))
    return g.groupBy("slab").agg(F.bool_and(F.col("c").between(0, 4)).alias("valid"), F.count_distinct("c").alias("classes"))


@query("missing_context", "o_custkey:l n:l", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) GROUP BY 1")
def missing_context(spark, sf):
    # what a cache lacks
    cache = load(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return load(spark, sf, "orders").join(cache, "o_custkey", "left_anti").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@query("weight_paths", "dataset:l fold:s kind:s mb:d", "SELECT o_custkey % 3 + 537 AS dataset, CAST(o_orderkey % 5 AS VARCHAR) AS fold, 'best' AS kind, round_even(o_orderkey * 1000 / 1048576.0, 2) AS mb FROM orders")
def weight_paths(spark, sf):
    o = load(spark, sf, "orders").select(F.format_string("/results/Dataset%d_x/run/fold_%d/checkpoint_best.pth", F.col("o_custkey") % 3 + 537, F.col("o_orderkey") % 5).alias("path"), (F.col("o_orderkey") * 1000).alias("length"), F.current_timestamp().alias("modificationTime"))
    return V.weight_files(o)


@query("event_status", "start:s kind:s n:l mean:d last:d", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type AS kind, count(*) AS n, avg(value) AS mean, arg_max(value, (ts, event_id)) AS last FROM events GROUP BY 1, 2")
def event_status(spark, sf):
    return windowed_status(load(spark, sf, "events")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("report_lines", "k:l dataset:s value:s", """
    SELECT 0 AS k, '' AS dataset, '# Split Anatomy Evaluation' AS value UNION ALL SELECT 1, '', '' UNION ALL
    SELECT 2, CAST(p_size AS VARCHAR), '- Ds' || p_size || ' `' || CASE WHEN p_size % 10 = 0 THEN 'None' ELSE 'Set' || p_size END || '`: n=' || count(*) || ', Dice=' || CASE WHEN p_size % 7 = 0 THEN 'n/a' ELSE format('{:.4f}', (p_size % 64) / 64.0) END
        || ', IoU=' || format('{:.4f}', (p_size % 32) / 32.0) FROM part GROUP BY p_size""")
def report_lines(spark, sf):
    p = load(spark, sf, "part").groupBy(F.col("p_size").alias("dataset")).agg(F.count(F.lit(1)).alias("n"))
    d = F.col("dataset")
    return RP.summary_lines(p.select("dataset", F.when(d % 10 != 0, F.concat(F.lit("Set"), d)).alias("name"), "n", F.when(d % 7 != 0, (d % 64) / 64.0).alias("dice"), ((d % 32) / 32.0).alias("iou")))


@query("report_manifest", "source:s json:s text:s", """
    SELECT path AS source, '/out/visual_' || stem || '_20260101.json' AS json, '/out/visual_' || stem || '_20260101.txt' AS text FROM (
        SELECT CASE p_partkey % 3 WHEN 0 THEN '/eval_r/eval_' || p_partkey || '.json' WHEN 1 THEN '/r/' || p_partkey || '_eval_eval_b.v2.json' ELSE '/r/plain' || p_partkey END AS path,
            CASE p_partkey % 3 WHEN 0 THEN '' || p_partkey WHEN 1 THEN p_partkey || '_eval_b.v2' ELSE 'plain' || p_partkey END AS stem FROM part)""")
def report_manifest(spark, sf):
    p = load(spark, sf, "part").selectExpr("CASE p_partkey % 3 WHEN 0 THEN concat('/eval_r/eval_', p_partkey, '.json') WHEN 1 THEN concat('/r/', p_partkey, '_eval_eval_b.v2.json') ELSE concat('/r/plain', p_partkey) END path")
    return RP.dashboards(p, "/out", "20260101")
