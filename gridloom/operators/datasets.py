"""Building of training datasets: semantic labels that are checked, samples of one anatomy each, and guards for what must be there."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.registry import ANATOMIES, anatomy_of
from .scan_plan import Rules, boxes


def semantic(truth: DataFrame, partial: dict[int, list[int]] | None = None) -> DataFrame:
    """truth (scan, z, y, x, gt) with `label`, the anatomy of each voxel (0 outside). partial names, by kind of scan (a column `kind`), the
    anatomies that its labels cover; others become 0 there."""
    label = anatomy_of(F.col("gt"))
    if partial:
        covered = F.lit(False)
        for kind, anatomies in partial.items():
            covered = F.when(F.col("kind") == kind, label.isin(anatomies)).otherwise(covered)
        label = F.when(covered, label).otherwise(0)
    return truth.withColumn("label", label.cast("long"))


def unknown_labels(labelled: DataFrame, allowed: list[int], label: str = "label") -> DataFrame:
    """(scan, label): labels that a scan holds and mustn't; null is one."""
    spark = labelled.sparkSession
    held = labelled.select("scan", F.col(label).cast("long").alias("label")).distinct()
    fine = spark.createDataFrame([(int(a),) for a in allowed], "label long")
    return held.join(F.broadcast(fine), "label", "left_anti").select("scan", "label")  # a list given by hand


def require_known(labelled: DataFrame, allowed: list[int], label: str = "label", shown: int = 20) -> DataFrame:
    """labelled, or a failure that names scans and labels."""
    bad = unknown_labels(labelled, allowed, label).orderBy("scan", "label").limit(shown).collect()
    if bad:
        raise ValueError("unknown labels: " + ", ".join(f"{r['label']} in {r['scan']}" for r in bad))
    return labelled


def samples(truth: DataFrame, scans: DataFrame, pad: int = 24, prefix: str = "CASE") -> DataFrame:
    """(sample, scan, anatomy, z0 to x1, voxels, ids): a region for each anatomy that a scan holds, named prefix_scan_anatomy."""
    own = truth.withColumn("anatomy", anatomy_of(F.col("gt"))).where("anatomy > 0")
    box = boxes(own.select("scan", "anatomy", "z", "y", "x"), scans, Rules(pad=pad)).drop("box_share", "eta")
    held = own.groupBy("scan", "anatomy").agg(F.count(F.lit(1)).alias("voxels"), F.count_distinct("gt").alias("ids"))
    name = F.element_at(F.array(*[F.lit(n) for n, *_ in ANATOMIES]), F.col("anatomy").cast("int"))
    case = F.col("scan").cast("string")
    case = F.when(F.length(case) < 3, F.lpad(case, 3, "0")).otherwise(case)
    return held.join(box, ["scan", "anatomy"]).withColumn("sample", F.concat_ws("_", F.lit(prefix), case, name))


def sample_targets(truth: DataFrame, regions: DataFrame) -> DataFrame:
    """(sample, z, y, x, local): the voxels of each sample's own fragments, in its region's places, ids made dense from 1 in their order.

    regions as samples gives them. Other anatomies' fragments inside a region are background, and aren't there.
    """
    own = truth.withColumn("anatomy", anatomy_of(F.col("gt"))).where("anatomy > 0")
    ids = own.select("scan", "anatomy", "gt").distinct()  # at most 50 of an anatomy
    dense = ids.withColumn("local", F.row_number().over(Window.partitionBy("scan", "anatomy").orderBy("gt")).cast("long"))
    out = own.join(dense, ["scan", "anatomy", "gt"]).join(regions.select("sample", "scan", "anatomy", "z0", "y0", "x0"), ["scan", "anatomy"])
    return out.select("sample", *[(F.col(a) - F.col(f"{a}0")).alias(a) for a in "zyx"], "local")


def missing(wanted: DataFrame, there: DataFrame, key: list[str]) -> DataFrame:
    """The wanted keys that aren't there."""
    return wanted.select(*key).distinct().join(there.select(*key).distinct(), key, "left_anti")


def require_present(wanted: DataFrame, there: DataFrame, key: list[str], what: str, shown: int = 20) -> DataFrame:
    """there, for the wanted keys; fails with the number of missing ones and the names of the first. It makes nothing by itself."""
    lost = missing(wanted, there, key)
    first = lost.orderBy(*key).limit(shown).collect()
    if first:
        raise FileNotFoundError(f"{what} lacks {lost.count()} of the wanted: " + ", ".join("/".join(map(str, r)) for r in first))
    return there.join(wanted.select(*key).distinct(), key, "left_semi")
