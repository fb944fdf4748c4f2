"""Queries of aggregates, rankings, selections, folds, losses and logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import aggregates as A
from ..operators import logs as G
from ..operators import losses as L
from ..operators import neighbors as N
from ..operators import ranking as R
from ..session import load
from ..sources import fixtures as X
from .base import AFF, INST_B, VOX, query

_P = A.PERCENTS


@query("robust_percentiles", "flag:s " + " ".join(f"p{k + 1}:d" for k in range(9)), f"SELECT l_returnflag AS flag, {', '.join(f'quantile_cont(l_extendedprice, {q / 100}) AS p{k + 1}' for k, q in enumerate(_P))} FROM lineitem GROUP BY 1")
def robust_percentiles(spark, sf):
    return A.robust_percentiles(load(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "flag"), "l_extendedprice", ["flag"])


_CONF = "count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 1 AND toxic <> 1) AS fp, count(*) FILTER (quality <> 1 AND toxic = 1) AS fn"


@query("confusion_scores", "tp:l fp:l fn:l dice:d iou:d precision:d recall:d dice_distance:d", f"SELECT *, CASE WHEN 2 * tp + fp + fn = 0 THEN 1 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS dice, CASE WHEN tp + fp + fn = 0 THEN 1 ELSE tp / CAST(tp + fp + fn AS DOUBLE) END AS iou, CASE WHEN tp + fp = 0 THEN 1 ELSE tp / CAST(tp + fp AS DOUBLE) END AS precision, CASE WHEN tp + fn = 0 THEN 1 ELSE tp / CAST(tp + fn AS DOUBLE) END AS recall, 1 - CASE WHEN 2 * tp + fp + fn = 0 THEN 1 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS dice_distance FROM (SELECT {_CONF} FROM labels)")
def confusion_scores(spark, sf):
    return A.mask_scores(load(spark, sf, "labels").agg(*A.confusion(F.col("quality") == 1, F.col("toxic") == 1)))


@query("fbeta", "tp:l precision:d recall:d fbeta:d ratio:d", f"SELECT tp, p AS precision, r AS recall, 5 * p * r / greatest(4 * p + r, 1e-8) AS fbeta, (tp + fp) / CAST(greatest(tp + fn, 1) AS DOUBLE) AS ratio FROM (SELECT *, tp / CAST(greatest(tp + fp, 1) AS DOUBLE) AS p, tp / CAST(greatest(tp + fn, 1) AS DOUBLE) AS r FROM (SELECT {_CONF} FROM labels))")
def fbeta(spark, sf):
    return A.fbeta(load(spark, sf, "labels").agg(*A.confusion(F.col("quality") == 1, F.col("toxic") == 1)), 2.0)


@query("class_weights_inverse", "lang:s n:l weight:d", "SELECT lang, n, greatest(least(i / avg(i) OVER (), 2.0), 0.5) AS weight FROM (SELECT lang, n, (sum(n + 1) OVER ()) / (n + 1.0) AS i FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1))")
def class_weights_inverse(spark, sf):
    return A.inverse_weights(load(spark, sf, "documents"), "lang")


@query("class_weights_median", "lang:s n:l weight:d", "SELECT lang, n, greatest(least(median(n + 1.0) OVER () / (n + 1.0), 2.0), 0.5) AS weight FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1)")
def class_weights_median(spark, sf):
    return A.median_weights(load(spark, sf, "documents"), "lang")


@query("class_weight_vector", "cls:l weight:d", "SELECT c AS cls, CASE c WHEN 1 THEN 2.5 WHEN 3 THEN 0.5 ELSE 1.0 END AS weight FROM (SELECT unnest(range(0, (SELECT count(DISTINCT lang) FROM documents))) AS c)")
def class_weight_vector(spark, sf):
    n = load(spark, sf, "documents").agg(F.count_distinct("lang").alias("n"))
    given = F.create_map(F.lit(1), F.lit(2.5), F.lit(3), F.lit(0.5))
    return n.select(F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("cls")).select("cls", F.coalesce(F.try_element_at(given, F.col("cls")), F.lit(1.0)).alias("weight"))


@query("label_distribution", "gt:l n:l support:l", f"WITH {VOX}, {INST_B} SELECT gt, count(*) AS n, (SELECT count(*) FROM inst WHERE gt > 0) AS support FROM inst GROUP BY 1")
def label_distribution(spark, sf):
    n = X.instances_b(spark, sf).groupBy("gt").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("support", F.sum(F.when(F.col("gt") > 0, F.col("n")).otherwise(0)).over(Window.partitionBy()))


@query("centroids_sizes", "gt:l n:l cz:d cy:d cx:d", f"WITH {VOX}, {INST_B} SELECT i.gt, COALESCE(n, 0) AS n, cz, cy, cx FROM (SELECT unnest(range(0, 201)) AS gt) i LEFT JOIN (SELECT gt, count(*) AS n, avg(z) * 0.8 AS cz, avg(y) AS cy, avg(x) * 1.5 AS cx FROM inst WHERE gt > 0 GROUP BY 1) c ON c.gt = i.gt")
def centroids_sizes(spark, sf):
    return A.every_id(spark, A.centroids(X.instances_b(spark, sf), "gt", (0.8, 1.0, 1.5)), "gt")


@query("fragment_stats", "name:s fragments:l voxels:l", f"WITH {VOX}, {INST_B} SELECT name, COALESCE(f, 0) AS fragments, COALESCE(v, 0) AS voxels FROM (VALUES ('Sacrum', 1), ('LeftHip', 2), ('RightHip', 3), ('Femur', 4)) r(name, i) LEFT JOIN (SELECT (gt - 1) // 50 + 1 AS a, count(DISTINCT gt) AS f, count(*) AS v FROM inst WHERE gt > 0 GROUP BY 1) s ON s.a = r.i")
def fragment_stats(spark, sf):
    from ..functions.registry import anatomies, anatomy_of

    s = X.instances_b(spark, sf).where("gt > 0").groupBy("gt").agg(F.count(F.lit(1)).alias("n")).groupBy(anatomy_of(F.col("gt")).alias("anatomy")).agg(F.count(F.lit(1)).alias("f"), F.sum("n").alias("v"))
    return anatomies(spark).join(s, "anatomy", "left").select("name", F.coalesce("f", F.lit(0)).alias("fragments"), F.coalesce("v", F.lit(0)).alias("voxels"))


@query("fragment_rows", "gt:l name:s n:l z0:l z1:l y0:l y1:l x0:l x1:l", f"""
    WITH {VOX}, {INST_B} SELECT gt, CASE (gt - 1) // 50 WHEN 0 THEN 'Sacrum' WHEN 1 THEN 'LeftHip' WHEN 2 THEN 'RightHip' WHEN 3 THEN 'Femur' ELSE 'Unknown' END AS name, count(*) AS n,
        min(z) AS z0, max(z) + 1 AS z1, min(y) AS y0, max(y) + 1 AS y1, min(x) AS x0, max(x) + 1 AS x1 FROM (SELECT * REPLACE (CASE WHEN gt = 1 THEN 201 ELSE gt END AS gt) FROM inst) WHERE gt > 0 GROUP BY 1, 2""")
def fragment_rows(spark, sf):
    # an id beyond the blocks has no anatomy
    g = X.instances_b(spark, sf).withColumn("gt", F.when(F.col("gt") == 1, 201).otherwise(F.col("gt")))
    return A.fragments(g, "gt")


@query("mean_skip", "seg:s m:d n:l", "SELECT c_mktsegment AS seg, avg(CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN c_acctbal ELSE NULL END) AS m, count(*) AS n FROM customer GROUP BY 1")
def mean_skip(spark, sf):
    c = load(spark, sf, "customer").selectExpr("c_mktsegment seg", "CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN c_acctbal ELSE double('NaN') END v")
    return c.groupBy("seg").agg(A.mean_skip(F.col("v")).alias("m"), F.count(F.lit(1)).alias("n"))


_SEP = [["a0", "a1", "a2"], ["a3", "a4", "a5"], ["a6", "a7", "a8"]]


@query("split_affinity_evidence", "slab:l short:d mid:d long:d", f"WITH {VOX}, i AS (SELECT *, {AFF} FROM vox) SELECT slab, " + ", ".join(f"COALESCE(avg({' '.join(['greatest(']) + ', '.join(f'1 - {c}' for c in g)})) FILTER (v > 0.2), 0) AS {n}" for n, g in zip(("short", "mid", "long"), _SEP)) + " FROM i GROUP BY 1")
def split_affinity_evidence(spark, sf):
    g = X.affinity_columns(X.vox(spark, sf))
    return g.groupBy("slab").agg(*[e.alias(n) for n, e in zip(("short", "mid", "long"), A.separation_evidence(g, F.col("v") > 0.2, _SEP))])


@query("anatomy_context", "anatomy:l border:d boundary:d core:d coverage:d worst:d", f"""
    WITH {VOX} SELECT label % 4 AS anatomy, count(*) FILTER (v BETWEEN 0.05 AND 0.1) / CAST(greatest(count(*), 1) AS DOUBLE) AS border, count(*) FILTER (v > 0.1 AND v <= 0.15) / CAST(greatest(count(*), 1) AS DOUBLE) AS boundary,
        count(*) FILTER (v > 0.15) / CAST(greatest(count(*), 1) AS DOUBLE) AS core, count(*) FILTER (x < 4) / CAST(greatest(count(*) FILTER (y < 4), 1) AS DOUBLE) AS coverage, COALESCE(max(v) FILTER (v > 0.15), 0) AS worst FROM vox GROUP BY 1""")
def anatomy_context(spark, sf):
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    v = F.col("v")
    return X.vox(spark, sf).groupBy((F.col("label") % 4).alias("anatomy")).agg((F.count_if(v.between(0.05, 0.1)) / n).alias("border"), (F.count_if((v > 0.1) & (v <= 0.15)) / n).alias("boundary"), (F.count_if(v > 0.15) / n).alias("core"), (F.count_if(F.col("x") < 4) / F.greatest(F.count_if(F.col("y") < 4), F.lit(1))).alias("coverage"), F.coalesce(F.max(F.when(v > 0.15, v)), F.lit(0.0)).alias("worst"))


@query("mip", "y:l x:l slab:l top:l main:l", f"WITH {VOX}, {INST_B}, c AS (SELECT slab, y, x, gt, count(*) AS n FROM inst GROUP BY ALL) SELECT y, x, slab, max(gt) AS top, COALESCE(arg_max(gt, n * 1000 - gt) FILTER (gt > 0), 0) AS main FROM c GROUP BY ALL")
def mip(spark, sf):
    return A.ray_winner(X.instances_b(spark, sf), "gt", ["slab", "y", "x"])


@query("sampled_bone_features", "slab:l sampled:l bone:l fraction:d bz:d by_:d bx:d cz:d", f"""
    WITH {VOX}, s AS (SELECT slab, z - slab * 50 AS z, y, x, v > 0.05 AS bone FROM vox WHERE (z - slab * 50) % 2 = 0)
    SELECT slab, count(*) AS sampled, count(*) FILTER (bone) AS bone, avg(CAST(bone AS INT)) AS fraction, COALESCE((max(z) FILTER (bone) - min(z) FILTER (bone) + 2) / 50.0, 0) AS bz, COALESCE((max(y) FILTER (bone) - min(y) FILTER (bone) + 1) / 8.0, 0) AS by_,
        COALESCE((max(x) FILTER (bone) - min(x) FILTER (bone) + 1) / 8.0, 0) AS bx, COALESCE(avg(z) FILTER (bone) / 48.0, 0) AS cz FROM s GROUP BY 1""")
def sampled_bone_features(spark, sf):
    # every second plane, like a stride of ceil(n / 96) on a larger grid
    s = X.vox(spark, sf).withColumn("z", F.col("z") - F.col("slab") * 50).where("z % 2 = 0").withColumn("bone", F.col("v") > 0.05)
    b = lambda c: F.when(F.col("bone"), F.col(c))
    span = lambda c, add, n: F.coalesce((F.max(b(c)) - F.min(b(c)) + add) / n, F.lit(0.0))
    return s.groupBy("slab").agg(F.count(F.lit(1)).alias("sampled"), F.count_if("bone").alias("bone"), F.avg(F.col("bone").cast("int")).alias("fraction"), span("z", 2, 50.0).alias("bz"), span("y", 1, 8.0).alias("by_"), span("x", 1, 8.0).alias("bx"), F.coalesce(F.avg(b("z")) / 48.0, F.lit(0.0)).alias("cz"))


@query("image_features", "slab:l fov_z:d ratio_zx:d p1:d p5:d p9:d", f"WITH {VOX} SELECT slab, 50 * 0.8 AS fov_z, 50 * 0.8 / greatest(8 * 1.5, 1e-6) AS ratio_zx, quantile_cont(v, 0.005) AS p1, quantile_cont(v, 0.5) AS p5, quantile_cont(v, 0.995) AS p9 FROM vox GROUP BY 1")
def image_features(spark, sf):
    p = A.robust_percentiles(X.vox(spark, sf), "v", ["slab"])
    return p.withColumn("fov_z", F.lit(50 * 0.8)).withColumn("ratio_zx", F.col("fov_z") / F.greatest(F.lit(8 * 1.5), F.lit(1e-6)))


# ------------------------------------------------------------- ranking


_SIZES = "SELECT l_suppkey % 4 AS anatomy, l_partkey AS id, count(*) AS n FROM lineitem GROUP BY 1, 2"


def _sizes(spark, sf):
    return load(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 4).alias("anatomy"), F.col("l_partkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))


@query("slot_cap", "anatomy:l id:l n:l slot:l", f"SELECT anatomy, id, n, CASE WHEN c > 50 THEN r ELSE i END AS slot FROM (SELECT *, row_number() OVER (PARTITION BY anatomy ORDER BY n DESC, id) AS r, row_number() OVER (PARTITION BY anatomy ORDER BY id) AS i, count(*) OVER (PARTITION BY anatomy) AS c FROM ({_SIZES})) WHERE r <= 50")
def slot_cap(spark, sf):
    return R.slot_cap(_sizes(spark, sf), "anatomy", "id", "n")


@query("largest_component", "anatomy:l id:l n:l", f"SELECT anatomy, id, n FROM (SELECT *, row_number() OVER (PARTITION BY anatomy ORDER BY n DESC, id) AS r FROM ({_SIZES})) WHERE r = 1")
def largest_component(spark, sf):
    return _sizes(spark, sf).groupBy("anatomy").agg(F.max_by(F.struct("id", "n"), F.struct("n", -F.col("id"))).alias("m")).select("anatomy", "m.id", "m.n")


@query("volume_gate", "day:l kind:s n:l", "SELECT day, kind, n FROM (SELECT *, max(n) OVER (PARTITION BY day) AS m FROM (SELECT user_id % 50 AS day, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2)) WHERE n >= 0.2 * m")
def volume_gate(spark, sf):
    e = load(spark, sf, "events").groupBy((F.col("user_id") % 50).alias("day"), F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return R.volume_gate(e, ["day"], "n")


_EV = f"""WITH {VOX}, {INST_B}, i AS (SELECT z, y, x, pred, {AFF} FROM inst WHERE pred > 0), e AS (SELECT least(p, q) AS lo, greatest(p, q) AS hi, round(avg(aff), 9) AS score FROM (
    {" UNION ALL ".join(f"SELECT a.pred AS p, b.pred AS q, a.a{k} AS aff FROM i a JOIN i b ON b.z = a.z + {o[0]} AND b.y = a.y + {o[1]} AND b.x = a.x + {o[2]} WHERE a.pred <> b.pred" for k, o in enumerate(N.axis_offsets()))}) GROUP BY 1, 2)"""


@query("mutual_best", "lo:l hi:l score:d", f"""{_EV}, x AS (SELECT lo AS e, * FROM e UNION ALL SELECT hi, * FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY score DESC, lo, hi) AS k FROM x)
    SELECT lo, hi, any_value(score) AS score FROM r WHERE k = 1 GROUP BY lo, hi HAVING count(*) = 2""")
def mutual_best(spark, sf):
    e = N.pair_evidence(X.affinity_columns(X.instances_b(spark, sf)), "pred", ["a0", "a1", "a2"], N.axis_offsets())
    return R.mutual_best(e.select("lo", "hi", F.round(1 - F.col("weight"), 9).alias("score")), "lo", "hi", "score")


_CAND = """SELECT c_nationkey % 4 + 1 AS anatomy, (c_nationkey % 4) * 50 + c_custkey % 13 + 1 AS source_id, c_custkey AS proposal_id, (c_custkey * 7 % 11) / 11.0 - 0.6 AS d_merge, (c_custkey * 5 % 9) / 9.0 AS d_split,
    (c_custkey * 3 % 17) / 17.0 - 0.2 AS d_f1, (c_custkey * 11 % 19) / 19.0 - 0.2 AS d_dice, (c_custkey * 13 % 23) / 23.0 - 0.2 AS d_precision FROM customer"""
_BEST = f"SELECT anatomy, source_id, proposal_id, d_merge FROM (SELECT *, row_number() OVER (PARTITION BY anatomy, source_id ORDER BY d_merge, d_split, -d_f1, -d_dice, -d_precision, proposal_id) AS r FROM ({_CAND}) WHERE d_merge <= 0 AND d_split <= 1 AND d_dice >= 0 AND d_f1 >= 0 AND d_precision >= 0) WHERE r = 1"


def _candidates(spark, sf):
    return load(spark, sf, "customer").selectExpr("c_nationkey % 4 + 1 anatomy", "cast((c_nationkey % 4) * 50 + c_custkey % 13 + 1 as bigint) source_id", "c_custkey proposal_id", "(c_custkey * 7 % 11) / 11.0D - 0.6D d_merge", "(c_custkey * 5 % 9) / 9.0D d_split", "(c_custkey * 3 % 17) / 17.0D - 0.2D d_f1", "(c_custkey * 11 % 19) / 19.0D - 0.2D d_dice", "(c_custkey * 13 % 23) / 23.0D - 0.2D d_precision")


@query("gate_select", "anatomy:l source_id:l proposal_id:l d_merge:d", _BEST)
def gate_select(spark, sf):
    return R.select_splits(_candidates(spark, sf))


@query("gate_apply", "anatomy:l source_id:l new_id:l", f"""
    WITH s AS ({_BEST}), w AS (SELECT anatomy, source_id, row_number() OVER (PARTITION BY anatomy ORDER BY source_id) AS k FROM s),
    f AS (SELECT id, (id - 1) // 50 + 1 AS anatomy, row_number() OVER (PARTITION BY (id - 1) // 50 ORDER BY id) AS k FROM (SELECT unnest(range(1, 201)) AS id) WHERE id NOT IN (SELECT (c_nationkey % 4) * 50 + c_custkey % 13 + 1 FROM customer))
    SELECT w.anatomy, w.source_id, f.id AS new_id FROM w JOIN f ON f.anatomy = w.anatomy AND f.k = w.k""")
def gate_apply(spark, sf):
    c = _candidates(spark, sf)
    used = c.select("anatomy", F.col("source_id").alias("id")).distinct()
    return R.assign_free_ids(spark, used, R.select_splits(c).select("anatomy", "source_id"))


@query("candidate_rows", "gt:l pred:l piece:l rest:l inverted:b fraction:d mean:d std:d gap:d", f"""
    WITH {VOX}, {INST_B}, o AS (SELECT gt, pred, count(*) AS n, sum(v) AS s, sum(v * v) AS q FROM inst WHERE gt > 0 AND pred > 0 AND (gt - 1) // 50 = (pred - 1) // 50 GROUP BY 1, 2), t AS (SELECT gt, count(*) AS n, sum(v) AS s FROM inst WHERE gt > 0 GROUP BY 1),
    r AS (SELECT o.*, t.n AS total, t.s AS ts, count(*) OVER (PARTITION BY o.gt) AS c, row_number() OVER (PARTITION BY o.gt ORDER BY o.n, o.pred) AS k FROM o JOIN t ON t.gt = o.gt)
    SELECT gt, pred, least(n, total - n) AS piece, greatest(n, total - n) AS rest, n > total - n AS inverted, n / CAST(total AS DOUBLE) AS fraction, s / n AS mean, sqrt(greatest(q / n - (s / n) * (s / n), 0)) AS std, abs(s / n - (ts - s) / (total - n)) AS gap
    FROM r WHERE (c > 2 OR (c = 2 AND k = 1)) AND least(n, total - n) >= 10""")
def candidate_rows(spark, sf):
    g = X.instances_b(spark, sf)
    same = F.floor((F.col("gt") - 1) / 50) == F.floor((F.col("pred") - 1) / 50)
    o = g.where((F.col("gt") > 0) & (F.col("pred") > 0) & same).groupBy("gt", "pred").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.stddev_pop("v").alias("std"))
    t = g.where("gt > 0").groupBy("gt").agg(F.count(F.lit(1)).alias("total"), F.sum("v").alias("ts"))
    r = o.join(t, "gt").withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("gt"))).withColumn("k", F.row_number().over(Window.partitionBy("gt").orderBy("n", "pred")))
    rest = F.col("total") - F.col("n")
    # of exactly two proposals one candidate stands for both
    r = r.where((F.col("c") > 2) | ((F.col("c") == 2) & (F.col("k") == 1))).where(F.least("n", rest) >= 10)
    return r.select("gt", "pred", F.least("n", rest).alias("piece"), F.greatest("n", rest).alias("rest"), (F.col("n") > rest).alias("inverted"), (F.col("n") / F.col("total")).alias("fraction"), (F.col("s") / F.col("n")).alias("mean"), "std", F.abs(F.col("s") / F.col("n") - (F.col("ts") - F.col("s")) / rest).alias("gap"))


@query("distinct_signature", "gt:l pred:l n:l", f"""
    WITH {VOX}, {INST_B} SELECT gt, pred, n FROM (SELECT *, row_number() OVER (PARTITION BY gt, n, sz % 7 ORDER BY n DESC, pred) AS r FROM (SELECT gt, pred, count(*) AS n, sum(z) AS sz FROM inst WHERE gt > 0 GROUP BY 1, 2)) WHERE r = 1""")
def distinct_signature(spark, sf):
    c = X.instances_b(spark, sf).where("gt > 0").groupBy("gt", "pred").agg(F.count(F.lit(1)).alias("n"), F.sum("z").alias("sz"))
    return c.groupBy("gt", "n", (F.col("sz") % 7).alias("sig")).agg(F.min("pred").alias("pred")).select("gt", "pred", "n")


@query("small_id_filter", "gt:l n:l", f"WITH {VOX}, {INST_B} SELECT CASE WHEN c < 200 THEN 0 ELSE gt END AS gt, count(*) AS n FROM (SELECT gt, count(*) OVER (PARTITION BY gt) AS c FROM inst) GROUP BY 1")
def small_id_filter(spark, sf):
    return R.keep_by_size(X.instances_b(spark, sf).select("gt"), "gt", 200).groupBy("gt").agg(F.count(F.lit(1)).alias("n"))


@query("mask_algebra", "slab:l common:l either:l one:l only_gt:l", f"WITH {VOX}, {INST_B} SELECT slab, count(*) FILTER (gt > 0 AND pred > 0) AS common, count(*) FILTER (gt > 0 OR pred > 0) AS either, count(*) FILTER ((gt > 0) <> (pred > 0)) AS one, count(*) FILTER (gt > 0 AND pred = 0) AS only_gt FROM inst GROUP BY 1")
def mask_algebra(spark, sf):
    g, p = F.col("gt") > 0, F.col("pred") > 0
    return X.instances_b(spark, sf).groupBy("slab").agg(F.count_if(g & p).alias("common"), F.count_if(g | p).alias("either"), F.count_if(g != p).alias("one"), F.count_if(g & ~p).alias("only_gt"))


_HASH = "(c_custkey * 7919) % 5"


@query("grouped_folds", "fold:l side:s groups:l orders:l", """
    SELECT f AS fold, CASE WHEN o_custkey * 7919 % 5 = f THEN 'val' ELSE 'train' END AS side, count(DISTINCT o_custkey) AS groups, count(*) AS orders FROM orders, (SELECT unnest(range(0, 5)) AS f) GROUP BY 1, 2""")
def grouped_folds(spark, sf):
    o = load(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return R.splits(o, R.folds(o, "o_custkey"), "o_custkey").groupBy("fold", "side").agg(F.count_distinct("o_custkey").alias("groups"), F.count(F.lit(1)).alias("orders"))


@query("leak_check", "fold:l key:l sides:l", """
    SELECT f AS fold, c AS key, count(DISTINCT s) AS sides FROM (SELECT f, o_custkey AS c, CASE WHEN (o_custkey * 7919 + CASE WHEN o_orderkey % 97 = 0 THEN 1 ELSE 0 END) % 5 = f THEN 'val' ELSE 'train' END AS s FROM orders, (SELECT unnest(range(0, 5)) AS f)) GROUP BY 1, 2 HAVING count(DISTINCT s) > 1""")
def leak_check(spark, sf):
    # a split spoilt on purpose: one order in 97 goes to the next fold
    o = load(spark, sf, "orders").withColumn("own", (F.col("o_custkey") * 7919 + (F.col("o_orderkey") % 97 == 0).cast("int")) % 5)
    s = o.select(F.col("o_custkey").alias("key"), "own", F.explode(F.array(*[F.lit(k).cast("bigint") for k in range(5)])).alias("fold")).withColumn("side", F.when(F.col("own") == F.col("fold"), "val").otherwise("train"))
    return R.leaks(s, "key")


@query("case_lock", "side:s n:l", "SELECT 'both' AS side, count(*) AS n FROM customer WHERE c_custkey % 450 IN (7, 21, 260) UNION ALL SELECT 'missing', 3 - count(DISTINCT c_custkey % 450) FROM customer WHERE c_custkey % 450 IN (7, 21, 260)")
def case_lock(spark, sf):
    wanted = spark.createDataFrame([(7,), (21,), (260,)], "case_id long")
    c = load(spark, sf, "customer").select((F.col("c_custkey") % 450).alias("case_id"))
    hit = c.join(wanted, "case_id", "left_semi").agg(F.count(F.lit(1)).alias("n")).select(F.lit("both").alias("side"), "n")
    return hit.unionByName(wanted.join(c, "case_id", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("missing").alias("side"), "n"))


@query("sampled_locations", "gt:l z:l y:l x:l", f"WITH {VOX}, {INST_B} SELECT gt, z, y, x FROM (SELECT *, row_number() OVER (PARTITION BY gt ORDER BY (z * 7919 + y * 104729 + x * 1299709) % 10007, z, y, x) AS r FROM inst WHERE gt > 0) WHERE r <= 25")
def sampled_locations(spark, sf):
    g = X.instances_b(spark, sf).where("gt > 0").select("gt", "z", "y", "x")
    return R.sampled(g, ["gt"], F.expr("(z * 7919 + y * 104729 + x * 1299709) % 10007"), 25)


@query("early_stop", "user_id:l event_id:l value:d stale:l", """
    WITH RECURSIVE e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
    s AS (SELECT user_id, event_id, value, r, value AS best, 0 AS stale FROM e WHERE r = 1 UNION ALL
        SELECT e.user_id, e.event_id, e.value, e.r, CASE WHEN e.value > s.best + 1.0 THEN e.value ELSE s.best END, CASE WHEN e.value > s.best + 1.0 THEN 0 ELSE s.stale + 1 END FROM s JOIN e ON e.user_id = s.user_id AND e.r = s.r + 1)
    SELECT user_id, event_id, value, stale FROM s""")
def early_stop(spark, sf):
    return R.since_best(load(spark, sf, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value", 1.0)


@query("leaderboard", "name:s score:d rank:l line:s", "SELECT s_name AS name, score, row_number() OVER (ORDER BY COALESCE(score, -1) DESC, s_name) AS rank, format('{:.2f}', COALESCE(score, -1)) AS line FROM (SELECT s_name, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE (s_suppkey % 64) / 64.0 END AS score FROM supplier)")
def leaderboard(spark, sf):
    s = load(spark, sf, "supplier").selectExpr("s_name name", "CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE (s_suppkey % 64) / 64.0D END score")
    return G.leaderboard(s, "score", "name").withColumn("line", S.fixed(F.coalesce("score", F.lit(-1.0)), 2))


@query("weight_manifest", "dataset:l kind:s files:l mb:d", "SELECT o_custkey % 3 + 537 AS dataset, CASE WHEN o_orderstatus = 'F' THEN 'best' ELSE 'final' END AS kind, count(*) AS files, sum(round(o_totalprice / 1048.576, 2)) AS mb FROM orders GROUP BY 1, 2")
def weight_manifest(spark, sf):
    o = load(spark, sf, "orders")
    return o.groupBy((F.col("o_custkey") % 3 + 537).alias("dataset"), F.when(F.col("o_orderstatus") == "F", "best").otherwise("final").alias("kind")).agg(F.count(F.lit(1)).alias("files"), F.sum(F.round(F.col("o_totalprice") / 1048.576, 2)).alias("mb"))


@query("log_epochs", "conv_id:l turn:l epoch:l words:l mean20:d", """
    SELECT conv_id, turn, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS epoch, words, avg(words) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS mean20
    FROM (SELECT conv_id, turn, role, length(text) AS words FROM conversations)""")
def log_epochs(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = load(spark, sf, "conversations").select("conv_id", "turn", "role", F.length("text").alias("words"))
    return c.select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w).alias("epoch"), "words", F.avg("words").over(w.rowsBetween(-19, 0)).alias("mean20"))


@query("training_status", "log:l last_epoch:l best:d best_epoch:l recent_seconds:d stop_epoch:l done:b", """
    WITH l AS (SELECT o_custkey % 40 AS log, row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey) - 1 AS e, 300 + o_orderkey % 64 AS s, (o_orderkey * 31 % 1024) / 1024.0 AS d FROM orders),
    b AS (SELECT log, max(e) AS last_epoch, arg_max(d, e) FILTER (d > 0.9) AS best, max(e) FILTER (d > 0.9) AS best_epoch FROM l GROUP BY 1), r AS (SELECT log, avg(s) AS recent_seconds FROM (SELECT *, row_number() OVER (PARTITION BY log ORDER BY e DESC) AS k FROM l) WHERE k <= 20 GROUP BY 1)
    SELECT b.log, last_epoch, best, best_epoch, recent_seconds, greatest(100, COALESCE(best_epoch, 0) + 50) AS stop_epoch, true AS done FROM b JOIN r ON r.log = b.log""")
def training_status(spark, sf):
    w = Window.partitionBy("log").orderBy("o_orderkey")
    o = load(spark, sf, "orders").withColumn("log", F.col("o_custkey") % 40).withColumn("e", F.row_number().over(w) - 1)
    lines = F.array(F.format_string("Epoch %d", "e"), F.format_string("Pseudo dice [np.float32(%.4f), 1e-04]", F.lit(0.5)), F.when(F.expr("(o_orderkey * 31 % 1024) / 1024.0D > 0.9D"), F.concat(F.lit("New best EMA pseudo Dice: "), F.expr("(o_orderkey * 31 % 1024) / 1024.0D").cast("string"))), F.concat(F.lit("Epoch time: "), (300 + F.col("o_orderkey") % 64).cast("string"), F.lit(" s")), F.lit("Training done."))
    text = o.select("log", "e", F.posexplode(lines).alias("k", "text")).where("text IS NOT NULL").withColumn("line", F.col("e") * 10 + F.col("k"))
    return G.progress(G.log_status(G.parse_log(text, "log", "line", "text"), "log", "line"))


# ------------------------------------------------------------- losses


def _probs(spark, sf):
    e = load(spark, sf, "embeddings").select(F.col("label").cast("long").alias("label"), S.softmax_array(F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double") * 5.0)).alias("p"), "embedding")
    return e.select((F.col("label") % 4).alias("t"), *[F.col("p")[k].alias(f"p{k}") for k in range(4)], *[(F.col("embedding")[k].cast("double") * 5.0).alias(f"x{k}") for k in range(4)])


_PROBS = f"""pr AS (SELECT label % 4 AS t, x0, x1, x2, x3, {', '.join(f'exp(x{k}) / (exp(x0) + exp(x1) + exp(x2) + exp(x3)) AS p{k}' for k in range(4))} FROM (SELECT label, {', '.join(f'CAST(embedding[{k + 1}] AS DOUBLE) * 5 AS x{k}' for k in range(4))} FROM embeddings)),
    sums AS (SELECT cls, sum(p * t) AS inter, sum(p) AS pp, sum(t) AS tt, sum(p * p) AS p2 FROM ({' UNION ALL '.join(f'SELECT {k} AS cls, p{k} AS p, CASE WHEN t = {k} THEN 1.0 ELSE 0.0 END AS t FROM pr' for k in range(4))}) GROUP BY 1)"""


@query("tversky", "cls:l loss:d", f"WITH {_PROBS} SELECT cls, 1 - (inter + 1) / (inter + 0.3 * (pp - inter) + 0.7 * (tt - inter) + 1) AS loss FROM sums")
def tversky(spark, sf):
    return L.tversky(L.class_sums(_probs(spark, sf), ["p0", "p1", "p2", "p3"], "t"))


_CLASSES = f"""{VOX}, t AS (SELECT z, y, x, v, CASE WHEN v > 0.2 THEN 2 WHEN v > -0.2 THEN 1 ELSE 0 END AS t, 1 / (1 + exp(-20 * (v - 0.2))) AS p2, 1 / (1 + exp(20 * (v + 0.2))) AS p0 FROM vox),
    nb AS (SELECT a.z, a.y, a.x, a.t FROM t a JOIN (VALUES (0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) o(dz, dy, dx) ON true
        JOIN t b ON b.z = a.z + o.dz AND b.y = a.y + o.dy AND b.x = a.x + o.dx AND b.t = a.t GROUP BY ALL HAVING count(*) = 7),
    inside AS (SELECT t AS cls, count(*) AS interior FROM nb GROUP BY 1),
    s AS (SELECT cls, sum(p * y) AS inter, sum(p) AS pp, sum(y) AS tt, sum(p * p) AS p2 FROM (SELECT 1 AS cls, 1 - p0 - p2 AS p, CAST(t = 1 AS INT) AS y FROM t UNION ALL SELECT 2, p2, CAST(t = 2 AS INT) FROM t) GROUP BY 1)"""


@query("boundary_overlap", "cls:l alpha:d loss:d", f"""
    WITH {_CLASSES} SELECT cls, alpha, (p2 + tt - 2 * inter + 1e-5) / (p2 + tt - (1 + alpha) * inter + 1e-5) AS loss
    FROM (SELECT s.*, CASE WHEN tt = 0 THEN 0 ELSE least(2 * COALESCE(interior, 0) / (tt + 1e-5) - 1, 0.8) END AS alpha FROM s LEFT JOIN inside ON inside.cls = s.cls) WHERE tt > 0 OR pp >= 1e-5""")
def boundary_overlap(spark, sf):
    v = F.col("v")
    g = X.vox(spark, sf).select("z", "y", "x", F.when(v > 0.2, 2).when(v > -0.2, 1).otherwise(0).alias("t"), (1 / (1 + F.exp(-20 * (v - 0.2)))).alias("p2"), (1 / (1 + F.exp(20 * (v + 0.2)))).alias("p0"))
    g = g.withColumn("p1", 1 - F.col("p0") - F.col("p2"))
    interior = N.interior_counts(g, "t").withColumnRenamed("t", "cls")
    return L.boundary_overlap(L.class_sums(g, ["p0", "p1", "p2"], "t").where("cls > 0"), interior)


@query("dice_ce", "dice_loss:d ce:d total:d", f"WITH {_PROBS} SELECT dice_loss, ce, dice_loss + ce AS total FROM (SELECT 1 - avg((2 * inter + 1e-5) / (pp + tt + 1e-5)) FILTER (cls > 0) AS dice_loss FROM sums), (SELECT sum(-ln(CASE t WHEN 0 THEN p0 WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE p3 END) * w) / sum(w) AS ce FROM (SELECT *, CASE WHEN t = 2 THEN 5.0 ELSE 1.0 END AS w FROM pr))")
def dice_ce(spark, sf):
    p = _probs(spark, sf)
    d = L.soft_dice(L.class_sums(p, ["p0", "p1", "p2", "p3"], "t")).where("cls > 0").agg((1 - F.avg("dice")).alias("dice_loss"))
    c = p.agg(L.cross_entropy(["p0", "p1", "p2", "p3"], "t", [1, 1, 5, 1]).alias("ce"))
    return d.join(c, F.lit(True)).withColumn("total", F.col("dice_loss") + F.col("ce"))  # one row each


@query("marginal_ce", "t:l n:l loss:d", f"WITH {_PROBS} SELECT t, count(*) AS n, avg(-ln(CASE WHEN t IN (0, 3) THEN p0 + p3 WHEN t = 1 THEN p1 ELSE p2 END)) AS loss FROM pr GROUP BY 1")
def marginal_ce(spark, sf):
    labelled = F.array(F.lit(True), F.lit(True), F.lit(True), F.lit(False))
    return _probs(spark, sf).withColumn("l", L.marginal_nll(["x0", "x1", "x2", "x3"], "t", labelled)).groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.avg("l").alias("loss"))


_BCE = " UNION ALL ".join(f"SELECT {k} AS k, a.a{k} AS p, a.gt = b.gt AS same FROM i a JOIN i b ON b.z = a.z + {o[0]} AND b.y = a.y + {o[1]} AND b.x = a.x + {o[2]}" for k, o in enumerate([o for d in (1, 3, 9) for o in N.axis_offsets(d)]))


@query("affinity_bce", "k:l n:l loss:d", f"WITH {VOX}, {INST_B}, i AS (SELECT z, y, x, gt, {AFF} FROM inst WHERE gt > 0) SELECT k, count(*) AS n, 0.5 * (COALESCE(avg(-ln(p)) FILTER (same), 0) + COALESCE(avg(-ln(1 - p)) FILTER (NOT same), 0)) AS loss FROM ({_BCE}) GROUP BY 1")
def affinity_bce(spark, sf):
    g = X.affinity_columns(X.instances_b(spark, sf)).where("gt > 0").select("z", "y", "x", "gt", *[f"a{k}" for k in range(9)])
    offsets = [o for d in (1, 3, 9) for o in N.axis_offsets(d)]
    pairs = N.affinity_pairs(g, "gt", [f"a{k}" for k in range(9)], offsets)
    return pairs.groupBy("k").agg(F.count(F.lit(1)).alias("n"), L.affinity_loss(pairs, "p", "same").alias("loss"))


@query("unlabelled_to_background", "t:l tp:l fp:l fn:l", f"WITH {_PROBS}, a AS (SELECT CASE WHEN t = 3 THEN 0 ELSE t END AS t, CASE WHEN p0 >= greatest(p1, p2, p3) THEN 0 WHEN p1 >= greatest(p2, p3) THEN 1 WHEN p2 >= p3 THEN 2 ELSE 0 END AS m FROM pr) SELECT c AS t, count(*) FILTER (m = c AND a.t = c) AS tp, count(*) FILTER (m = c AND a.t <> c) AS fp, count(*) FILTER (m <> c AND a.t = c) AS fn FROM a, (SELECT unnest(range(0, 3)) AS c) GROUP BY 1")
def unlabelled_to_background(spark, sf):
    # one pass: the confusion table by (true, predicted), then sums for each class
    p = _probs(spark, sf).select(F.when(F.col("t") == 3, 0).otherwise(F.col("t")).alias("t"), S.argmax(F.array("p0", "p1", "p2", "p3")).alias("m")).withColumn("m", F.when(F.col("m") == 3, 0).otherwise(F.col("m")))
    n = p.groupBy("t", "m").agg(F.count(F.lit(1)).alias("n")).withColumn("c", F.explode(F.array(*[F.lit(k) for k in range(3)])))
    s = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return n.groupBy("c").agg(s((F.col("t") == F.col("c")) & (F.col("m") == F.col("c"))).alias("tp"), s((F.col("t") != F.col("c")) & (F.col("m") == F.col("c"))).alias("fp"), s((F.col("t") == F.col("c")) & (F.col("m") != F.col("c"))).alias("fn")).withColumnRenamed("c", "t")
