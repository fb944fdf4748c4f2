"""Summaries of evaluation reports as tables of lines, and manifests of what a report job writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S

TITLE = "# Split Anatomy Evaluation"


def _plain(v: Column) -> Column:
    return F.coalesce(v.cast("string"), F.lit("None"))


def summary_lines(rows: DataFrame) -> DataFrame:
    """rows (dataset, name, n, dice, iou) to (k, dataset, value): a title, an empty line, and a line a dataset.

    Order by k and dataset; dataset is compared as text. Missing scores show as n/a, other missing values as None.
    """
    text = F.concat(F.lit("- Ds"), _plain(F.col("dataset")), F.lit(" `"), _plain(F.col("name")), F.lit("`: n="), _plain(F.col("n")), F.lit(", Dice="), S.fixed(F.col("dice")), F.lit(", IoU="), S.fixed(F.col("iou")))
    head = rows.sparkSession.createDataFrame([(0, "", TITLE), (1, "", "")], "k int, dataset string, value string")
    return head.unionByName(rows.select(F.lit(2).alias("k"), F.col("dataset").cast("string").alias("dataset"), text.alias("value")))


def dashboards(reports: DataFrame, folder: str, stamp: str) -> DataFrame:
    """reports (path) to (source, json, text): where each report's summaries go; names come from the whole stem, so variants don't collide."""
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"(.)\.[^.]*$", "$1")
    name = F.concat(F.lit(f"{folder}/visual_"), S.report_suffix(stem), F.lit(f"_{stamp}"))
    return reports.select(F.col("path").alias("source"), F.concat(name, F.lit(".json")).alias("json"), F.concat(name, F.lit(".txt")).alias("text"))
