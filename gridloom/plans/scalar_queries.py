"""Queries of elementwise operators, registry arithmetic and labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import registry as R
from ..functions import scalar as S
from ..operators import neighbors as N
from ..operators import ranking as RK
from ..session import load
from ..sources import fixtures as X
from .base import INST_B, VOX, query

_ANAT = "CASE WHEN {0} BETWEEN 1 AND 200 THEN ({0} - 1) // 50 + 1 ELSE 0 END"


@query("id_to_anatomy", "gid:l n:l anatomy:l name:s local:l back:l pelvic:b clipped:l same_as_next:b", f"""
    SELECT gid, n, a AS anatomy, CASE a WHEN 1 THEN 'Sacrum' WHEN 2 THEN 'LeftHip' WHEN 3 THEN 'RightHip' WHEN 4 THEN 'Femur' END AS name,
        CASE WHEN a > 0 THEN (gid - 1) % 50 + 1 ELSE 0 END AS local, CASE WHEN a > 0 THEN gid ELSE 0 END AS back, gid BETWEEN 1 AND 150 AS pelvic,
        CASE WHEN gid BETWEEN 1 AND 200 THEN gid ELSE 0 END AS clipped, (a = b AND a > 0) AS same_as_next
    FROM (SELECT gid, n, {_ANAT.format('gid')} AS a, {_ANAT.format('(gid + 1)')} AS b FROM (SELECT l_partkey % 256 AS gid, count(*) AS n FROM lineitem GROUP BY 1))""")
def id_to_anatomy(spark, sf):
    g = load(spark, sf, "lineitem").groupBy((F.col("l_partkey") % 256).alias("gid")).agg(F.count(F.lit(1)).alias("n"))
    a = R.anatomy_of(F.col("gid"))
    return g.select("gid", "n", a.alias("anatomy"), R.anatomy_name(a).alias("name"), R.local_id(F.col("gid")).alias("local"), R.global_id(a, R.local_id(F.col("gid"))).alias("back"), R.valid_id(F.col("gid"), True).alias("pelvic"), R.clip_to_valid(F.col("gid")).alias("clipped"), R.same_anatomy(F.col("gid"), F.col("gid") + 1).alias("same_as_next"))


@query("anatomy_registry", "name:s anatomy:l id_lo:l id_hi:l capacity:l pelvic:b", """
    SELECT col0 AS name, col1 AS anatomy, (col1 - 1) * 50 + 1 AS id_lo, col1 * 50 AS id_hi, 50 AS capacity, col1 <= 3 AS pelvic
    FROM (VALUES ('Sacrum', 1), ('LeftHip', 2), ('RightHip', 3), ('Femur', 4))""")
def anatomy_registry(spark, sf):
    return R.anatomies(spark).withColumn("pelvic", F.col("anatomy") <= 3)


@query("case_family", "kind:s dataset:l n:l least:l most:l", """
    SELECT kind, CASE kind WHEN 'Pelvic' THEN 532 WHEN 'Femur' THEN 533 END AS dataset, count(*) AS n, min(c) AS least, max(c) AS most FROM (
        SELECT c, CASE WHEN c BETWEEN 1 AND 120 OR c BETWEEN 151 AND 200 THEN 'Pelvic' WHEN c BETWEEN 251 AND 420 THEN 'Femur' ELSE 'Unknown' END AS kind
        FROM (SELECT c_custkey % 450 AS c FROM customer)) GROUP BY 1, 2""")
def case_family(spark, sf):
    c = load(spark, sf, "customer").select((F.col("c_custkey") % 450).alias("c"))
    return c.groupBy(R.subject_type(F.col("c")).alias("kind"), R.dataset_of_case(F.col("c"), strict=False).alias("dataset")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least"), F.max("c").alias("most"))


@query("rule_tree", "size:l family:s swapped:s n:l", """
    SELECT size, CASE WHEN px <= 285.35 THEN CASE WHEN sx <= 0.71 THEN 'pelvic' WHEN sz <= 0.9 THEN 'femur' WHEN sy <= 0.91 THEN 'pelvic' ELSE 'femur' END
            WHEN sz <= 0.68 THEN CASE WHEN pz <= 193.55 THEN 'pelvic' ELSE 'femur' END ELSE CASE WHEN pz <= 390.78 THEN 'pelvic' ELSE 'femur' END END AS family,
        CASE WHEN sz * 512 <= 285.35 THEN CASE WHEN sz <= 0.71 THEN 'pelvic' WHEN sx <= 0.9 THEN 'femur' WHEN sy <= 0.91 THEN 'pelvic' ELSE 'femur' END
            WHEN sx <= 0.68 THEN CASE WHEN sx * 400 <= 193.55 THEN 'pelvic' ELSE 'femur' END ELSE CASE WHEN sx * 400 <= 390.78 THEN 'pelvic' ELSE 'femur' END END AS swapped, count(*) AS n
    FROM (SELECT p_size AS size, 0.5 + (p_size % 7) / 12.0 AS sx, 0.5 + (p_size % 5) / 9.0 AS sy, 0.4 + (p_partkey % 11) / 12.0 AS sz, p_retailprice / 5 AS px, p_retailprice / 4 AS pz FROM part) GROUP BY 1, 2, 3""")
def rule_tree(spark, sf):
    p = load(spark, sf, "part").selectExpr("p_size size", "0.5D + (p_size % 7) / 12.0D sx", "0.5D + (p_size % 5) / 9.0D sy", "0.4D + (p_partkey % 11) / 12.0D sz", "p_retailprice / 5 px", "p_retailprice / 4 pz")
    c = F.col
    fam = S.family_rule(c("sx"), c("sy"), c("sz"), c("px"), c("pz"))
    # the header rule reads the axes in reverse
    swapped = S.family_rule(c("sz"), c("sy"), c("sx"), c("sz") * 512, c("sx") * 400)
    return p.groupBy("size", fam.alias("family"), swapped.alias("swapped")).agg(F.count(F.lit(1)).alias("n"))


@query("family_route", "id:l rule:s learned:s family:s why:s", """
    SELECT id, rule, learned, CASE WHEN sure THEN learned WHEN rule IS NOT NULL THEN rule WHEN learned IS NOT NULL THEN learned END AS family,
        CASE WHEN sure THEN 'forest' WHEN rule IS NOT NULL THEN 'rule' WHEN learned IS NOT NULL THEN 'unsure forest' END AS why
    FROM (SELECT *, COALESCE(learned IS NOT NULL AND abs(p - 0.5) >= 0.15, false) AS sure FROM (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_size <= 25 THEN 'pelvic' ELSE 'femur' END AS rule,
        CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 100 >= 50 THEN 'femur' ELSE 'pelvic' END AS learned, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE (p_partkey % 100) / 100.0 END AS p FROM part))""")
def family_route(spark, sf):
    p = load(spark, sf, "part").selectExpr("p_partkey id", "CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_size <= 25 THEN 'pelvic' ELSE 'femur' END rule", "CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 100 >= 50 THEN 'femur' ELSE 'pelvic' END learned", "CASE WHEN p_partkey % 11 = 0 THEN double('NaN') ELSE (p_partkey % 100) / 100.0D END p")
    return p.withColumn("r", S.routed_family(F.col("rule"), F.col("learned"), F.col("p"))).select("id", "rule", "learned", "r.family", "r.why")


@query("window_clip_lut", "bin:l n:l clipped:d mapped:d windowed:d", f"""
    WITH {VOX} SELECT bin, count(*) AS n, avg(greatest(least(h, 2000), -1000)) AS clipped,
        avg(CASE WHEN h <= -1000 THEN 0 WHEN h <= -200 THEN (h + 1000) * 0.05 / 800 WHEN h <= 150 THEN 0.05 + (h + 200) * 0.30 / 350 WHEN h <= 700 THEN 0.35 + (h - 150) * 0.35 / 550
            WHEN h <= 1500 THEN 0.70 + (h - 700) * 0.22 / 800 WHEN h <= 2000 THEN 0.92 + (h - 1500) * 0.08 / 500 ELSE 1 END) AS mapped,
        avg((greatest(least(h, 1500), -500) + 500) / 2000) AS windowed
    FROM (SELECT v * 8000 AS h, CAST(floor(v * 20) AS BIGINT) AS bin FROM vox) GROUP BY bin""")
def window_clip_lut(spark, sf):
    h = X.vox(spark, sf).select((F.col("v") * 8000.0).alias("h"), F.floor(F.col("v") * 20.0).alias("bin"))
    return h.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(S.clip_hu(F.col("h"))).alias("clipped"), F.avg(S.piecewise(F.col("h"))).alias("mapped"), F.avg(S.window01(F.col("h"))).alias("windowed"))


_EXP = ", ".join(f"exp(CAST(embedding[{i}] AS DOUBLE)) AS e{i}" for i in range(1, 5))


@query("softmax_argmax", "vec_id:l p0:d p1:d p2:d p3:d top:l heat:d", f"""
    SELECT vec_id, e1 / s AS p0, e2 / s AS p1, e3 / s AS p2, e4 / s AS p3, CASE WHEN e1 >= greatest(e2, e3, e4) THEN 0 WHEN e2 >= greatest(e3, e4) THEN 1 WHEN e3 >= e4 THEN 2 ELSE 3 END AS top,
        1 / (1 + exp(-greatest(least(CAST(embedding[5] AS DOUBLE) * 100, 30), -30))) AS heat FROM (SELECT *, e1 + e2 + e3 + e4 AS s FROM (SELECT vec_id, embedding, {_EXP} FROM embeddings))""")
def softmax_argmax(spark, sf):
    e = load(spark, sf, "embeddings").select("vec_id", S.softmax_array(F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double"))).alias("p"), S.sigmoid(F.col("embedding")[4].cast("double") * 100.0).alias("heat"))
    return e.select("vec_id", *[F.col("p")[k].alias(f"p{k}") for k in range(4)], S.argmax(F.col("p")).alias("top"), "heat")


@query("contact_heads", "vec_id:l h0:d h1:d h2:d h3:d h4:d", f"""
    SELECT vec_id, CASE WHEN w THEN e1 / s ELSE g1 END AS h0, CASE WHEN w THEN e2 / s ELSE g2 END AS h1, CASE WHEN w THEN e3 / s ELSE g3 END AS h2, CASE WHEN w THEN e4 / s ELSE g4 END AS h3, CASE WHEN w THEN g5 END AS h4
    FROM (SELECT *, e1 + e2 + e3 + e4 AS s FROM (SELECT vec_id, vec_id % 2 = 0 AS w, {_EXP}, {", ".join(f"1 / (1 + exp(-CAST(embedding[{i}] AS DOUBLE))) AS g{i}" for i in range(1, 6))} FROM embeddings))""")
def contact_heads(spark, sf):
    e = load(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("c"))
    heads = S.contact_heads(F.when(F.col("vec_id") % 2 == 0, F.col("c")).otherwise(F.slice("c", 1, 8)))
    return e.select("vec_id", heads.alias("h")).select("vec_id", *[F.col("h")[k].alias(f"h{k}") for k in range(5)])


@query("orientation_flip", "z:l code:s n:l sx:l sy:l", f"""
    WITH {VOX} SELECT z, (CASE WHEN z % 2 = 0 THEN 'L' ELSE 'R' END) || (CASE WHEN z % 3 = 0 THEN 'P' ELSE 'A' END) || 'S' AS code, count(*) AS n,
        sum((CASE WHEN z % 2 = 0 THEN x ELSE 7 - x END) * CAST(v > 0 AS INT)) AS sx, sum((CASE WHEN z % 3 = 0 THEN y ELSE 7 - y END) * CAST(v > 0 AS INT)) AS sy FROM vox GROUP BY z""")
def orientation_flip(spark, sf):
    v = X.vox(spark, sf)
    d = [F.lit(0.0)] * 9
    d[0], d[4], d[8] = F.when(F.col("z") % 2 == 0, 1.0).otherwise(-1.0), F.when(F.col("z") % 3 == 0, 1.0).otherwise(-1.0), F.lit(1.0)
    v = v.withColumn("code", S.orientation_code(d))
    nx, ny = S.flip_axis(F.col("x"), F.lit(8), F.substring("code", 1, 1) == "R"), S.flip_axis(F.col("y"), F.lit(8), F.substring("code", 2, 1) == "A")
    on = (F.col("v") > 0).cast("int")
    return v.groupBy("z", "code").agg(F.count(F.lit(1)).alias("n"), F.sum(nx * on).alias("sx"), F.sum(ny * on).alias("sy"))


@query("canonical_clip", "slab:l code:s n:l x:d y:d z:d", f"""
    WITH {VOX}, h AS (SELECT slab, x, y, z - slab * 50 AS z, z % 4 AS o, greatest(least(v * 8000, 2000), -1000) / 1000 AS h FROM vox)
    SELECT slab, ['LPS', 'RAS', 'PSL', 'SRA'][o + 1] AS code, count(*) AS n, avg(h * CASE o WHEN 0 THEN x WHEN 1 THEN 7 - x WHEN 2 THEN z ELSE 7 - y END) AS x,
        avg(h * CASE o WHEN 0 THEN y WHEN 1 THEN 7 - y WHEN 2 THEN x ELSE 49 - z END) AS y, avg(h * CASE o WHEN 0 THEN z WHEN 1 THEN z WHEN 2 THEN y ELSE x END) AS z FROM h GROUP BY 1, 2""")
def canonical_clip(spark, sf):
    v = X.vox(spark, sf).withColumn("code", F.element_at(F.array(*map(F.lit, ("LPS", "RAS", "PSL", "SRA"))), (F.col("z") % 4 + 1).cast("int"))).withColumn("z", F.col("z") - F.col("slab") * 50)
    at = S.to_lps(F.col("code"), [F.col(a) for a in "xyz"], [F.lit(8), F.lit(8), F.lit(50)])
    h = S.clip_hu(F.col("v") * 8000.0) / 1000.0
    return v.groupBy("slab", "code").agg(F.count(F.lit(1)).alias("n"), *[F.avg(h * c).alias(a) for a, c in zip("xyz", at)])


@query("geometry_match", "same:b n:l", """
    SELECT p_partkey % 13 <> 0 AND p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AS same, count(*) AS n FROM part GROUP BY 1""")
def geometry_match(spark, sf):
    # the size is off by one for every 13th row, spacing, origin and direction by too much for every third, fifth and seventh, and by little else
    p = load(spark, sf, "part").select(*[F.when(F.col("p_partkey") % k == 0, far).otherwise(close).alias(n) for n, k, far, close in (("d", 13, 1, 0), ("s", 3, 2e-5, 5e-6), ("o", 5, 2e-4, 5e-5), ("r", 7, 2e-5, 5e-6))])
    a = {"size": F.array(*[F.lit(k) for k in (8, 8, 50)]), "spacing": F.array(*[F.lit(k) for k in (1.5, 1.0, 0.8)]), "origin": F.array(*[F.lit(k) for k in (-10.0, 4.0, 0.0)]), "direction": F.array(*[F.lit(float(k % 4 == 0)) for k in range(9)])}
    off = {"size": F.col("d"), "spacing": F.col("s"), "origin": F.col("o"), "direction": F.col("r")}
    moved = lambda c, by: F.transform(c, lambda x: x + by)
    b = {k: moved(c, off[k]) for k, c in a.items()}
    return p.groupBy(S.same_geometry(a, b).alias("same")).agg(F.count(F.lit(1)).alias("n"))


@query("model_paths", "path:s n:l", """
    SELECT CASE WHEN p_partkey % 3 = 0 THEN '/results' ELSE '/runs/' || p_partkey % 3 END || '/Dataset' || 530 + p_size % 5 || '/' || CASE WHEN p_partkey % 4 IN (0, 1) THEN 'Own' || p_size % 5 ELSE 'Trainer' || p_partkey % 4 END || '__nnUNetResEncUNetLPlans__3d_fullres' AS path, count(*) AS n FROM part GROUP BY 1""")
def model_paths(spark, sf):
    p = load(spark, sf, "part").selectExpr("CASE WHEN p_partkey % 3 <> 0 THEN concat('/runs/', p_partkey % 3) END root", "concat('Dataset', 530 + p_size % 5) name", "concat('Own', p_size % 5) own", "CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('Trainer', p_partkey % 4) END trainer")
    return p.groupBy(S.model_path(F.col("root"), "/results", F.col("name"), F.col("trainer"), F.col("own")).alias("path")).agg(F.count(F.lit(1)).alias("n"))


@query("settings_by_key", "key:s value:s n:l", """
    SELECT ['brand', 'size', 'price'][p_partkey % 3 + 1] AS key, CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN CAST(p_size AS VARCHAR) ELSE CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR) END AS value, count(*) AS n FROM part GROUP BY 1, 2""")
def settings_by_key(spark, sf):
    record = F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.floor("p_retailprice").cast("long").alias("price"))
    p = load(spark, sf, "part").select(record.alias("r"), F.element_at(F.array(F.lit("brand"), F.lit("size"), F.lit("price")), (F.col("p_partkey") % 3 + 1).cast("int")).alias("key"))
    return p.groupBy("key", S.by_key(F.col("r"), ["brand", "size", "price"], F.col("key")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


@query("geometry_check", "same:b volume:d n:l", """
    SELECT abs(s1 - s2) <= 0.00001 AND abs(o1 - o2) <= 0.0001 AS same, s1 * 2 * 0.5 AS volume, count(*) AS n FROM (
        SELECT 0.5 + (p_size % 10) / 10.0 AS s1, 0.5 + (p_size % 10) / 10.0 + CASE WHEN p_partkey % 3 = 0 THEN 0.000001 WHEN p_partkey % 3 = 1 THEN 0 ELSE 0.01 END AS s2, p_retailprice AS o1,
            p_retailprice + CASE WHEN p_partkey % 4 = 0 THEN 0.01 ELSE 0 END AS o2 FROM part) GROUP BY 1, 2""")
def geometry_check(spark, sf):
    p = load(spark, sf, "part").selectExpr("0.5D + (p_size % 10) / 10.0D s1", "0.5D + (p_size % 10) / 10.0D + CASE WHEN p_partkey % 3 = 0 THEN 0.000001D WHEN p_partkey % 3 = 1 THEN 0D ELSE 0.01D END s2", "p_retailprice o1", "p_retailprice + CASE WHEN p_partkey % 4 = 0 THEN 0.01D ELSE 0D END o2")
    same = S.near(F.col("s1"), F.col("s2"), 1e-5) & S.near(F.col("o1"), F.col("o2"), 1e-4)
    return p.groupBy(same.alias("same"), (F.col("s1") * 2 * 0.5).alias("volume")).agg(F.count(F.lit(1)).alias("n"))


@query("format_bar", "id:l shown:s bar:s", """
    SELECT s_suppkey AS id, CASE WHEN v IS NULL THEN 'n/a' ELSE format('{:.4f}', v) END AS shown, rpad(repeat('#', CAST(round_even(greatest(least(COALESCE(v, 0), 1), 0) * 30, 0) AS INT)), 30, '.') AS bar
    FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE (s_suppkey % 128) / 128.0 - 0.125 END AS v FROM supplier)""")
def format_bar(spark, sf):
    s = load(spark, sf, "supplier").selectExpr("s_suppkey id", "CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE (s_suppkey % 128) / 128.0D - 0.125D END v")
    return s.select("id", S.fixed(F.col("v")).alias("shown"), S.bar(F.col("v")).alias("bar"))


@query("sample_names", "case_id:s expert:s n:l", """
    SELECT lpad(CAST(c_custkey % 450 AS VARCHAR), 3, '0') AS case_id, CASE WHEN c_nationkey % 4 = 0 THEN 'Sacrum' WHEN c_nationkey % 4 IN (1, 2) THEN 'Hip' ELSE 'Femur' END AS expert, count(*) AS n FROM customer GROUP BY 1, 2""")
def sample_names(spark, sf):
    c = load(spark, sf, "customer").selectExpr("concat('CASE_', c_custkey % 450, '_', element_at(array('Sacrum', 'LeftHip', 'RightHip', 'Femur'), c_nationkey % 4 + 1)) name")
    expert = F.when(S.is_expert(F.col("name"), ("Sacrum",)), "Sacrum").when(S.is_expert(F.col("name"), ("LeftHip", "RightHip")), "Hip").when(S.is_expert(F.col("name"), ("Femur",)), "Femur")
    return c.groupBy(S.source_case(F.col("name"), "CASE_").alias("case_id"), expert.alias("expert")).agg(F.count(F.lit(1)).alias("n"))


@query("semantic_recode", "slab:l split:b out:l n:l", f"""
    WITH {VOX} SELECT slab, m > 3 AS split, CASE WHEN m > 3 THEN CASE c WHEN 4 THEN 1 WHEN 5 THEN 2 WHEN 6 THEN 3 ELSE 0 END ELSE c END AS out, count(*) AS n
    FROM (SELECT slab, c, max(c) OVER (PARTITION BY slab) AS m FROM (SELECT slab, CASE WHEN slab % 2 = 0 THEN label % 4 ELSE label % 7 END AS c FROM vox)) GROUP BY 1, 2, 3""")
def semantic_recode(spark, sf):
    v = X.vox(spark, sf).select("slab", F.when(F.col("slab") % 2 == 0, F.col("label") % 4).otherwise(F.col("label") % 7).alias("c"))
    counts = v.groupBy("slab", "c").agg(F.count(F.lit(1)).alias("n"))
    split = F.max("c").over(Window.partitionBy("slab")) > 3
    e = counts.withColumn("split", split)
    out = F.when(F.col("split"), S.recode(F.col("c"), {4: 1, 5: 2, 6: 3})).otherwise(F.col("c"))
    return e.groupBy("slab", "split", out.alias("out")).agg(F.sum("n").alias("n"))


@query("bbox_by_label", "gt:l z0:l z1:l y0:l y1:l x0:l x1:l", f"WITH {VOX}, {INST_B} SELECT gt, min(z) AS z0, max(z) + 1 AS z1, min(y) AS y0, max(y) + 1 AS y1, min(x) AS x0, max(x) + 1 AS x1 FROM inst WHERE gt > 0 GROUP BY gt")
def bbox_by_label(spark, sf):
    return N.label_boxes(X.instances_b(spark, sf), "gt")


@query("bbox_padded", "slab:l pred:l z0:l z1:l y0:l y1:l x0:l x1:l back:b", f"""
    WITH {VOX}, {INST_B} SELECT slab, pred, greatest(min(z) - 3, 0) AS z0, least(max(z) + 4, (SELECT max(z) + 1 FROM vox)) AS z1, greatest(min(y) - 3, 0) AS y0, least(max(y) + 4, 8) AS y1, greatest(min(x) - 3, 0) AS x0, least(max(x) + 4, 8) AS x1, true AS back
    FROM inst WHERE pred > 0 GROUP BY slab, pred""")
def bbox_padded(spark, sf):
    edges = [f"{a}{i}" for a in "zyx" for i in (0, 1)]
    g = X.instances_b(spark, sf)
    planes = g.agg(F.max("z") + 1).first()[0]
    b = N.label_boxes(g, "pred", ["slab"], pad=3, extent=(planes, 8, 8))
    r = b.select("*", S.box_ranges([F.col(e) for e in edges]).alias("ranges"))
    # boxes go to ranges and back
    return r.select("slab", "pred", *S.range_edges(F.col("ranges")), (F.struct(*edges) == F.struct(*S.range_edges(F.col("ranges")))).alias("back"))


@query("relabel_dense", "part:l compact:l n:l", "SELECT part, dense_rank() OVER (ORDER BY part) AS compact, n FROM (SELECT l_partkey * 3 + l_linenumber % 2 AS part, count(*) AS n FROM lineitem GROUP BY 1)")
def relabel_dense(spark, sf):
    # distinct ids first, ranked by ranges
    ids = load(spark, sf, "lineitem").groupBy((F.col("l_partkey") * 3 + F.col("l_linenumber") % 2).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    return RK.ranked(ids, "compact", F.col("part"))


@query("poly_rate", "epoch:l rate:d", "SELECT epoch, 0.01 * pow(greatest(0, 1 - epoch / 900.0), 0.9) AS rate FROM (SELECT DISTINCT o_orderkey % 1000 AS epoch FROM orders)")
def poly_rate(spark, sf):
    return load(spark, sf, "orders").select((F.col("o_orderkey") % 1000).alias("epoch")).distinct().select("epoch", S.poly_rate(F.lit(0.01), F.col("epoch"), F.lit(900.0)).alias("rate"))


@query("eta", "gt:l seconds:d", f"""
    WITH {VOX}, {INST_B} SELECT gt, 2.5 * greatest(1, ceil(greatest(0, dz - 192) / 96.0) + 1) * greatest(1, ceil(greatest(0, dy - 160) / 80.0) + 1) * greatest(1, ceil(greatest(0, dx - 224) / 112.0) + 1) AS seconds
    FROM (SELECT gt, (max(z) + 1 - min(z)) * 3 AS dz, (max(y) + 1 - min(y)) * 40 AS dy, (max(x) + 1 - min(x)) * 60 AS dx FROM inst WHERE gt > 0 GROUP BY gt)""")
def eta(spark, sf):
    b = N.label_boxes(X.instances_b(spark, sf), "gt")
    return b.select("gt", S.eta_seconds((F.col("z1") - F.col("z0")) * 3, (F.col("y1") - F.col("y0")) * 40, (F.col("x1") - F.col("x0")) * 60).alias("seconds"))
