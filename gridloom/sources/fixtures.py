"""Labelled grids derived by rule from the `embeddings` table: one vector is a plane of 8 x 8 voxels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import softmax_array
from ..session import load


def vox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(z, y, x, v, label, slab); a slab of 50 planes stands for one region of interest."""
    e = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("z"), F.posexplode("embedding").alias("pos", "v"), F.col("label").cast("long").alias("label"))
    return e.selectExpr("z", "cast(pos div 8 as bigint) y", "cast(pos % 8 as bigint) x", "cast(v as double) v", "label", "z div 50 slab")


def _instances(v: DataFrame, gt: str, pred: str, more: tuple[str, ...] = ()) -> DataFrame:
    return v.selectExpr("z", "y", "x", "v", "slab", *more, f"CASE WHEN v > 0 THEN 1 + 50 * (label % 4) + {gt} ELSE 0 END AS gt", f"CASE WHEN v > -0.02 THEN 1 + 50 * (label % 4) + {pred} ELSE 0 END AS pred")


def instances_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(z, y, x, v, slab, gt, pred) without merges."""
    return _instances(vox(spark, sf_dir), "(z div 100) % 5", "((z + 6 * y) div 110) % 5")


def instances_b(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """The same with merges and splits, and more columns of the voxels."""
    return _instances(vox(spark, sf_dir), "(z div 50) % 10", "((z + 6 * y) div 125) % 5", more)


def affinity_columns(v: DataFrame) -> DataFrame:
    """Adds the affinity channels a0 to a8 by rule."""
    return v.withColumns({f"a{k}": 1.0 / (1.0 + F.exp(-(10.0 * F.col("v") + (k - 4) / 4.0))) for k in range(9)})


def channels4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, probs): softmax of each vector's first four values."""
    e = load(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("label").cast("long").alias("label"), softmax_array(F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double"))).alias("probs"))
