"""Splits that are kept: written once, used again while they are free of leaks, else set aside and replaced; and case locks."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import folds, leaks, splits


class Kept(NamedTuple):
    """The split (fold, side, sample, source), and what was done: kept, made, or replaced."""

    split: DataFrame
    done: str


def _there(spark, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def kept_split(members: DataFrame, path: str, k: int = 5) -> Kept:
    """members (sample, source) split into k folds by whole sources, at path/split.

    A split that stands there is used as it is if no source is on both sides of a fold, or if no source has two samples. A leaking one
    goes to path/leaking, unless one is there already, and a new one takes its place.
    """
    spark = members.sparkSession
    there = _there(spark, f"{path}/split")
    if there is not None:
        leaking = not leaks(there, "source").isEmpty()
        several = not members.groupBy("source").agg(F.count_distinct("sample").alias("n")).where("n > 1").isEmpty()
        if not (leaking and several):
            return Kept(there, "kept")
        if _there(spark, f"{path}/leaking") is None:
            there.write.mode("errorifexists").parquet(f"{path}/leaking")
    named = members.withColumn("_n", F.xxhash64("source"))
    made = splits(named, folds(named, "_n", k, 1), "_n", k).select("fold", "side", "sample", "source")
    made.write.mode("overwrite").parquet(f"{path}/split")
    return Kept(spark.read.parquet(f"{path}/split"), "made" if there is None else "replaced")


def locked(split: DataFrame, wanted: list[str], digits: int = 3) -> DataFrame:
    """Every fold with only the wanted sources' samples, each of them on both sides; without wanted ones the split as it is.

    Sources are compared with ids padded to so many digits. Fails by name if none of them has a sample.
    """
    if not wanted:
        return split
    ids = sorted({w.strip().zfill(digits) for w in wanted if w.strip()})
    name = F.col("source").cast("string")
    mine = split.where(F.when(F.length(name) < digits, F.lpad(name, digits, "0")).otherwise(name).isin(ids))  # lpad alone cuts longer ones
    if mine.isEmpty():
        raise ValueError(f"no samples of {', '.join(ids)}")
    every = split.select("fold").distinct().join(F.broadcast(mine.select("sample", "source").distinct()))  # folds are few; a list given by hand
    return every.withColumn("side", F.explode(F.array(F.lit("train"), F.lit("val")))).select("fold", "side", "sample", "source")
