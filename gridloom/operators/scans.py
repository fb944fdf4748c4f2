"""The whole scan as one plan: decode every (scan, anatomy), drop small pieces, number them in their blocks, first writer wins."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import dealt, shipped, written
from .decode import dense
from .ranking import slot_cap


def instance_map(grid: DataFrame, columns: list[str], decode: Callable[[np.ndarray], np.ndarray], least: int = 1, cap: int = 50) -> DataFrame:
    """grid (scan, anatomy, z, y, x, columns), one row a voxel of an anatomy's region, to (scan, z, y, x, id).

    Regions may overlap; of a voxel's anatomies the first keeps it. Ids are the anatomy's block plus the
    slot: by id, or by size if there are more than cap.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c, at = dense(pdf, columns)
        return pdf[["scan", "anatomy", "z", "y", "x"]].assign(piece=decode(c)[at].astype(np.int64))

    regions = dealt(grid.select("scan", "anatomy", "z", "y", "x", *columns), "scan", "anatomy").groupBy("scan", "anatomy")
    # written, as sizes, slots and owners all read them
    pieces = written(regions.applyInPandas(shipped(grid, run), "scan long, anatomy long, z long, y long, x long, piece long").where("piece > 0"))
    sizes = pieces.groupBy("scan", "anatomy", "piece").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    slots = slot_cap(sizes.withColumn("group", F.struct("scan", "anatomy")), "group", "piece", "n", cap).select("group.scan", "group.anatomy", "piece", "slot")
    owned = pieces.join(slots.hint("merge"), ["scan", "anatomy", "piece"]).groupBy("scan", "z", "y", "x").agg(F.min(F.struct("anatomy", "slot")).alias("w"))
    return owned.select("scan", "z", "y", "x", ((F.col("w.anatomy") - 1) * 50 + F.col("w.slot")).alias("id"))


def held_out_scores(grid: DataFrame, truth: DataFrame, columns: list[str], decode: Callable, least: int = 1) -> DataFrame:
    """Decode, then case metrics by (scan, anatomy) against truth (scan, z, y, x, gt)."""
    from .matching import case_metrics

    pred = instance_map(grid, columns, decode, least)
    both = truth.join(pred, ["scan", "z", "y", "x"], "full_outer").select("scan", "z", "y", "x", F.coalesce("gt", F.lit(0)).alias("gt"), F.coalesce("id", F.lit(0)).alias("pred"))
    return case_metrics(both, by=["scan"])
