"""Evaluation of predicted instance maps against true ones, as tables of overlaps, fragments and cases, and a summary.

    python -m jobs.evaluate_cases --input DIR --output DIR [--config FILE] [--parts 0,3]

The voxels are read once, to count overlapping pairs; all that follows comes from the written pairs:

    overlaps/part=N    (scan, gt, pred, both)                Parquet
    fragments/part=N   a row for each true fragment          Parquet
    cases/part=N       a row for each scan and anatomy       Parquet
    summary/           means and sums, overall and by anatomy  JSON
    hard/              cases of an F1 under a limit, worst first  CSV
    official/part=N    the challenge's metrics, with distances in mm  Parquet   (with "official")
    official_summary/  their means and sums                     JSON      (with "official")

A part is a run of `scans_a_part` scans. Parts are replaced whole (dynamic partition overwrite), so a rerun gives
the same tables, and --parts evaluates some again and leaves the others as they are; summary and hard are made of all
written cases. The challenge's metrics need the voxels' places, so they read them again. A scan without any prediction counts with zeros, as does one that only a folder of true volumes has.

Input formats: `planes` derives volumes from the table `embeddings`; `mha` reads <input>/labels/*.mha and, with the same
names, <input>/predictions/*.mha, whose scan number is the first number in the name.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.cluster import ship
from gridloom.operators import matching, official
from gridloom.sources import fixtures, volumes

from .common import command, settings

LOG = logging.getLogger("jobs.evaluate_cases")
DEFAULTS = {"format": "planes", "threshold": 0.1, "scans_a_part": 4, "hard_below": 0.5, "official": False, "spacing": [1.0, 1.0, 1.0], "least_fragment_mm3": 500.0, "least_component_mm3": 1000.0, "local_radius_mm": 20.0}
MEANS, SUMS = ["iou", "dice", "precision", "recall", "f1", "topology"], ["n_gt", "n_pred", "tp", "merge_error", "split_error"]
METRICS = [*SUMS, *MEANS]


def instance_maps(spark: SparkSession, source: str, kind: str) -> DataFrame:
    """(scan, z, y, x, gt, pred) of every voxel."""
    if kind == "planes":
        planes = fixtures.instances_b(spark, source)
        return planes.select(F.col("slab").alias("scan"), (F.col("z") - F.col("slab") * 50).alias("z"), "y", "x", "gt", "pred")
    if kind != "mha":
        raise ValueError(f"unknown format: {kind}")
    scan = F.regexp_extract("path", r"(\d+)[^/]*$", 1).cast("long").alias("scan")

    def side(folder: str, name: str) -> DataFrame:
        return volumes.read_mha(spark, f"{source}/{folder}")[0].select(scan, "z", "y", "x", volumes.label_values(F.col("value")).cast("long").alias(name))

    both = side("labels", "gt").join(side("predictions", "pred"), ["scan", "z", "y", "x"], "left")
    return both.select("scan", "z", "y", "x", "gt", F.coalesce("pred", F.lit(0)).alias("pred"))


def _put(df: DataFrame, path: str) -> DataFrame:
    """Replaces the parts that df holds, and reads the table back."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    return df.sparkSession.read.parquet(path)


def run(spark: SparkSession, source: str, out: str, config: dict | None = None, parts: list[int] | None = None) -> dict[str, int]:
    """Evaluates all parts or those given, writes the tables under out and returns their rows by name."""
    c = DEFAULTS | (config or {})
    ship(spark)
    part = F.floor(F.col("scan") / c["scans_a_part"]).cast("int")
    grid = instance_maps(spark, source, c["format"]).withColumn("part", part)
    mine = F.col("part").isin(parts) if parts is not None else F.lit(True)
    by = ["part", "scan"]

    LOG.info("reading %s volumes of %s, parts %s", c["format"], source, "all" if parts is None else parts)
    over = _put(matching.overlaps(grid.where(mine), by=by), f"{out}/overlaps").where(mine)
    fragments = _put(matching.fragments_of(over, c["threshold"], by), f"{out}/fragments").where(mine)
    cases = _put(matching.cases_of(fragments, over.select(*by, "pred"), by), f"{out}/cases")

    matching.macro(cases, "anatomy", MEANS, SUMS).coalesce(1).write.mode("overwrite").json(f"{out}/summary")
    hard = cases.where(F.col("f1") < c["hard_below"]).orderBy("f1", "scan", "anatomy")
    hard.select("scan", "anatomy", *METRICS).write.mode("overwrite").option("header", True).csv(f"{out}/hard")

    if c["official"]:
        limits = official.Limits(c["least_fragment_mm3"], c["least_component_mm3"], c["threshold"], c["local_radius_mm"])
        scored = official.official_metrics(grid.where(mine).drop("part"), tuple(c["spacing"]), limits)
        all_scored = _put(scored.withColumn("part", part), f"{out}/official")
        official.official_summary(all_scored).coalesce(1).write.mode("overwrite").json(f"{out}/official_summary")

    voxels = over.agg(F.sum("both")).first()[0] or 0
    wrote = {"overlaps": over.count(), "fragments": fragments.count(), "cases": cases.where(mine).count(), "cases_in_all": cases.count(), "hard": hard.count()}
    LOG.info("read %d voxels; wrote %s to %s", voxels, ", ".join(f"{n} {k}" for k, n in wrote.items()), out)
    return {"voxels": voxels} | wrote


def output(spark: SparkSession, out: str) -> DataFrame:
    """The written cases, and the summary as rows without a scan."""
    cases = spark.read.parquet(f"{out}/cases").select("scan", "anatomy", *METRICS)
    types = {f.name: f.dataType.simpleString() for f in cases.schema}
    schema = ", ".join(f"{k} {types[k]}" for k in ("anatomy", *METRICS))
    summary = spark.read.schema(schema).json(f"{out}/summary")
    return cases.unionByName(summary.withColumn("scan", F.lit(None).cast("long")))


def main() -> None:
    def go(spark, args):
        parts = [int(p) for p in args.parts.split(",")] if args.parts else None
        run(spark, args.input, args.output, settings(spark, DEFAULTS, args.config), parts)

    command("evaluate_cases", __doc__.split("\n")[0], go, lambda p: p.add_argument("--parts", help="parts to evaluate, by commas (default: all)"))


if __name__ == "__main__":
    main()
