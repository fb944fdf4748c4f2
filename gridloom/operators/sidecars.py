"""Instance sidecars of training samples: centres and sizes of fragments, pools of places to sample from, an audit; and checks.

A voxel table (sample, z, y, x, id, cls) becomes three tables. All five pools are sampled in one pass: the places of the lowest
keys of a hash, as many as wanted, behind a bound on the hash that the pool's size sets, so that no task sorts a whole pool.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..cluster import written
from ..functions.registry import same_anatomy, valid_id
from .neighbors import axis_offsets, contact_voxels

#: Classes of the target, and the pools by the names under which they are stored.
CLASSES = {"background": 0, "exterior_context": 1, "interior_shell": 2, "core": 3, "contact_surface": 4}
POOLS = ("contact_locations", "tiny_locations", "support_locations", "hard_negative_locations", "edge_locations")
PLACE = ["sample", "z", "y", "x"]
#: The range of the default sampling key.
SPAN = 1 << 53


def sampling_key() -> Column:
    """A hash of a pool's place from 0 to SPAN, alike in reruns."""
    return F.shiftrightunsigned(F.xxhash64("sample", "pool", "z", "y", "x"), 11)


def lowest(df: DataFrame, by: list[str], key: str, most: int, span: int, ties: list[str]) -> DataFrame:
    """Of each group the `most` rows of the lowest keys (whole numbers from 0 to span, spread evenly), ties in order of `ties`.

    A group's count bounds its keys so that a few more rows than wanted pass; a group in which fewer pass goes unbounded.
    """
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    room = most + 6 * most**0.5 + 16
    bounds = written(n.withColumn("_most", F.when(F.col("_n") > 2 * room, F.lit(float(span)) * room / F.col("_n"))))
    passed = df.join(bounds, by).where(F.col("_most").isNull() | (F.col(key) <= F.col("_most")))
    enough = passed.groupBy(*by).agg(F.count(F.lit(1)).alias("_in")).where(F.col("_in") >= most)
    few = written(bounds.where("_most IS NOT NULL").join(enough, by, "left_anti").select(*by))
    if not few.isEmpty():
        rest = df.join(few, by, "left_semi").withColumns({"_n": F.lit(0).cast("long"), "_most": F.lit(None).cast("double")})
        passed = passed.join(few, by, "left_anti").unionByName(rest)
    order = Window.partitionBy(*by).orderBy(key, *ties)
    return passed.drop("_n", "_most").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def fragments(grid: DataFrame) -> DataFrame:
    """(sample, id, n, cz, cy, cx): voxels and centre of each valid fragment."""
    return grid.where(valid_id(F.col("id"))).groupBy("sample", "id").agg(F.count(F.lit(1)).alias("n"), *[F.avg(a).alias(f"c{a}") for a in "zyx"])


def marked(grid: DataFrame, tiny: int = 512) -> DataFrame:
    """grid with `pools`, the pools of each voxel.

    edge: voxels that touch another fragment of their anatomy by a face. contact: the class, or edge in a sample without that class.
    tiny: of fragments of few voxels, in a sample that has support. support: shell, core and contact, less the contact pool. hard negative: context.
    """
    edges = contact_voxels(grid, "id", axis_offsets(), same_anatomy, ["sample"]).withColumn("edge", F.lit(True))
    small = fragments(grid).where(F.col("n") <= tiny).select("sample", "id", F.lit(True).alias("small"))
    cls, c = F.col("cls"), CLASSES
    support = cls.isin(c["interior_shell"], c["core"], c["contact_surface"])
    per = grid.groupBy("sample").agg(F.bool_or(cls == c["contact_surface"]).alias("touches"), F.bool_or(support).alias("held"))
    all_ = grid.join(edges, PLACE, "left").join(small, ["sample", "id"], "left").join(per, "sample")
    edge = F.coalesce("edge", F.lit(False))
    contact = (cls == c["contact_surface"]) | (~F.col("touches") & edge)
    tests = (contact, F.coalesce("small", F.lit(False)) & F.col("held"), support & ~contact, cls == c["exterior_context"], edge)
    named = F.array(*[F.when(t, F.lit(p)) for p, t in zip(POOLS, tests, strict=True)])
    return all_.withColumn("pools", F.filter(named, lambda p: p.isNotNull())).withColumn("support", support).select(*grid.columns, "pools", "support")


def locations(marks: DataFrame, most: int, key: Column | None = None, span: int = SPAN) -> DataFrame:
    """(sample, pool, rank, z, y, x): places of each pool, `most` at most, in the order of the key."""
    each = marks.select(*PLACE, F.explode("pools").alias("pool")).withColumn("_key", key if key is not None else sampling_key())
    return lowest(each, ["sample", "pool"], "_key", most, span, ["z", "y", "x"]).select("sample", "pool", "rank", "z", "y", "x")


def audit(marks: DataFrame, found: DataFrame, taken: DataFrame) -> DataFrame:
    """One row for each sample: fragments, voxels by kind and pool, places taken by pool, and whether support covers all instances."""
    has = lambda p: F.array_contains("pools", p)
    counts = [F.count_if(has(p)).alias(p.replace("_locations", "_voxels")) for p in POOLS]
    per = marks.groupBy("sample").agg(F.count_if("support").alias("support"), F.count_if(F.col("cls") == 0).alias("background"), *counts, (F.count_if((F.col("id") > 0) & ~F.col("support")) == 0).alias("covered"))
    kept = taken.groupBy("sample").agg(*[F.count_if(F.col("pool") == p).alias(p) for p in POOLS])
    ids = found.groupBy("sample").agg(F.count(F.lit(1)).alias("fragments"), F.array_sort(F.collect_list("id")).alias("ids"))  # ids of one anatomy
    out = per.join(ids, "sample", "left").join(kept, "sample", "left")
    return out.na.fill(0, ["fragments", *POOLS]).withColumn("ids", F.coalesce("ids", F.array().cast("array<bigint>")))


def build(grid: DataFrame, out: str, most: int, tiny: int = 512, key: Column | None = None, span: int = SPAN) -> dict[str, int]:
    """Writes fragments/, locations/ and audit/ under out, by sample, for the samples that have no audit there yet.

    The audit is written last: a sample that a failed run left without one is built again and replaces what was there.
    """
    spark = grid.sparkSession
    new = grid.join(built(spark, out, grid.schema["sample"]), "sample", "left_anti")
    marks = written(marked(new, tiny))
    if marks.isEmpty():
        return {"samples": 0, "locations": 0}
    put = lambda df, name: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sample").parquet(f"{out}/{name}")
    found, taken = written(fragments(marks)), written(locations(marks, most, key, span))
    audits = written(audit(marks, found, taken))
    for df, name in ((found, "fragments"), (taken, "locations"), (audits, "audit")):
        put(df, name)
    return {"samples": audits.count(), "locations": taken.count()}


def built(spark: SparkSession, out: str, sample: StructField) -> DataFrame:
    """(sample): those whose audit stands under out; none if nothing does."""
    schema = StructType([StructField("background", LongType()), StructField("sample", sample.dataType)])
    try:
        there = spark.read.schema(schema).parquet(f"{out}/audit")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        there = spark.createDataFrame([], schema)
    return there.select("sample").distinct()


# ------------------------------------------------------------------ checks


#: The labels of a dense target.
LABELS = {"background": 0, "external_context": 1, "fracture_barrier": 2, "fragment_shell": 3, "fragment_core": 4}


def rules() -> dict[str, Column]:
    """By name, how many voxels of a (sample, id) break the rule: labels are known, each fragment has a core, none lies outside fragments."""
    t, i = F.col("target"), F.col("id")
    inner = t.isin(LABELS["fragment_shell"], LABELS["fragment_core"])
    return {
        "unknown label": F.count_if(t.isNull() | ~t.isin(*LABELS.values())),
        "no core": F.when(F.max(i) > 0, (F.count_if(t == LABELS["fragment_core"]) == 0).cast("long")).otherwise(0),
        "outside": F.count_if((i == 0) & inner),
    }


def violations(grid: DataFrame, checks: dict[str, Column] | None = None) -> DataFrame:
    """(sample, id, rule, n): every rule that a fragment (or, as id 0, the rest of a sample) breaks; all from one grouped pass."""
    checks = checks or rules()
    per = grid.groupBy("sample", "id").agg(*[c.alias(f"_{k}") for k, c in enumerate(checks.values())])
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"_{k}").cast("long").alias("n")) for k, name in enumerate(checks)]))
    return per.select("sample", "id", rows.alias("r")).select("sample", "id", "r.rule", "r.n").where("n > 0")


def require(broken: DataFrame, shown: int = 20) -> None:
    """Fails with the keys of the first broken rules, if there are any."""
    rows = broken.orderBy("sample", "id", "rule").limit(shown).collect()
    if rows:
        raise ValueError("; ".join(f"{r['sample']} fragment {r['id']}: {r['rule']} ({r['n']})" for r in rows))
