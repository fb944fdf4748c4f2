"""Registration: every query names its columns once, with types, and both engines' results are cast and rounded by them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6
_TYPES = {"l": ("bigint", "BIGINT"), "d": ("double", "DOUBLE"), "s": ("string", "VARCHAR"), "b": ("boolean", "BOOLEAN")}

#: Common table expressions of the fixtures, for the SQL side.
VOX = """vox AS (SELECT vec_id AS z, CAST((i - 1) // 8 AS BIGINT) AS y, CAST((i - 1) % 8 AS BIGINT) AS x, CAST(embedding[i] AS DOUBLE) AS v, CAST(label AS BIGINT) AS label,
        vec_id // 50 AS slab FROM embeddings, (SELECT unnest(range(1, 65)) AS i))"""
INST_A = """inst AS (SELECT z, y, x, v, slab, CASE WHEN v > 0 THEN 1 + 50 * (label % 4) + (z // 100) % 5 ELSE 0 END AS gt,
        CASE WHEN v > -0.02 THEN 1 + 50 * (label % 4) + ((z + 6 * y) // 110) % 5 ELSE 0 END AS pred FROM vox)"""
INST_B = """inst AS (SELECT z, y, x, v, slab, CASE WHEN v > 0 THEN 1 + 50 * (label % 4) + (z // 50) % 10 ELSE 0 END AS gt,
        CASE WHEN v > -0.02 THEN 1 + 50 * (label % 4) + ((z + 6 * y) // 125) % 5 ELSE 0 END AS pred FROM vox)"""
#: Affinity channels of a voxel by rule: channel k is sigmoid(10 v + (k - 4) / 4).
AFF = ", ".join(f"1.0 / (1.0 + exp(-(10.0 * v + ({k} - 4) / 4.0))) AS a{k}" for k in range(9))


def query(name: str, columns: str, sql: str | None = None):
    """columns: `name:type` by spaces; types l, d, s, b. Doubles are rounded to DIGITS."""
    spec = [c.split(":") for c in columns.split()]

    def wrap(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            df = f(spark, sf_dir)
            return df.select(*[(F.round(F.col(c).cast("double"), DIGITS) + F.lit(0.0) if t == "d" else F.col(c).cast(_TYPES[t][0])).alias(c) for c, t in spec])

        QUERIES[name] = run
        if sql:
            cols = ", ".join(f"ROUND(CAST({c} AS DOUBLE), {DIGITS}) + 0.0 AS {c}" if t == "d" else f"CAST({c} AS {_TYPES[t][1]}) AS {c}" for c, t in spec)
            ORACLES[name] = f"SELECT {cols} FROM ({sql}) AS q"
        return f

    return wrap
