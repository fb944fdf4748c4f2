"""The anatomy registry and arithmetic on instance ids.

Ids are blocks of BLOCK per anatomy, so membership is arithmetic, never a BETWEEN join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name, index, first and last id.
ANATOMIES = (("Sacrum", 1, 1, 50), ("LeftHip", 2, 51, 100), ("RightHip", 3, 101, 150), ("Femur", 4, 151, 200))
BLOCK, MAX_ID, PELVIC_MAX = 50, 200, 150


def anatomies(spark: SparkSession, pelvic_only: bool = False) -> DataFrame:
    """The registry as a table of four rows (three, if pelvic only)."""
    return spark.createDataFrame([(n, i, lo, hi, hi - lo + 1) for n, i, lo, hi in ANATOMIES if not pelvic_only or i <= 3], "name string, anatomy long, id_lo long, id_hi long, capacity long")


def anatomy_of(gid: Column) -> Column:
    """1 to 4, or 0 outside the blocks."""
    return F.when(gid.between(1, MAX_ID), F.floor((gid - 1) / BLOCK) + 1).otherwise(0).cast("long")


def anatomy_name(index: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for n, i, _, _ in ANATOMIES for x in (i, n)]), index.cast("int"))


def anatomy_index(name: Column) -> Column:
    """The index of a name; fails on an unknown one."""
    found = F.try_element_at(F.create_map(*[F.lit(x) for n, i, _, _ in ANATOMIES for x in (n, i)]), name)
    return F.coalesce(found, F.raise_error(F.concat(F.lit("unknown anatomy: "), name)).cast("int"))


def local_id(gid: Column) -> Column:
    """1 to 50 inside the block, 0 for an id in none."""
    return F.when(gid.between(1, MAX_ID), F.pmod(gid - 1, F.lit(BLOCK)) + 1).otherwise(0).cast("long")


def global_id(anatomy: Column, local: Column) -> Column:
    return F.when(anatomy.between(1, 4) & local.between(1, BLOCK), (anatomy - 1) * BLOCK + local).otherwise(0).cast("long")


def valid_id(gid: Column, pelvic_only: bool = False) -> Column:
    return gid.between(1, PELVIC_MAX if pelvic_only else MAX_ID)


def clip_to_valid(gid: Column, pelvic_only: bool = False) -> Column:
    return F.when(valid_id(gid, pelvic_only), gid).otherwise(0).cast("long")


def same_anatomy(a: Column, b: Column) -> Column:
    return (anatomy_of(a) == anatomy_of(b)) & (anatomy_of(a) > 0)


def subject_type(case: Column) -> Column:
    return F.when(case.between(1, 120) | case.between(151, 200), "Pelvic").when(case.between(251, 420), "Femur").otherwise("Unknown")


def dataset_of_case(case: Column, strict: bool = True) -> Column:
    """532 for pelvic cases, 533 for femur ones; others fail, or give null if not strict."""
    kind = subject_type(case)
    other = F.raise_error(F.concat(F.lit("no dataset for case "), case.cast("string"))).cast("long") if strict else F.lit(None).cast("long")
    return F.when(kind == "Pelvic", F.lit(532).cast("long")).when(kind == "Femur", F.lit(533).cast("long")).otherwise(other)
