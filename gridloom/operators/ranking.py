"""Ranking, selection, ownership and folds, all with explicit tie-breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import shipped, written


def slot_cap(sizes: DataFrame, by: str, ident: str, n: str, cap: int = 50) -> DataFrame:
    """The cap largest ids of each group. On overflow ids are numbered by size (then id), otherwise by id."""
    # the limit stands on the window itself, so that a task passes on cap rows of a group at most; the other steps see these alone
    order = Window.partitionBy(by).orderBy(F.desc(n), ident)
    top = sizes.select(by, ident, n).withColumn("by_size", F.row_number().over(order)).where(F.col("by_size") <= cap)
    overflow = sizes.groupBy(by).agg((F.count(F.lit(1)) > cap).alias("many"))
    r = top.withColumn("by_id", F.row_number().over(Window.partitionBy(by).orderBy(ident))).join(overflow, by)
    return r.select(by, ident, n, F.when(F.col("many"), F.col("by_size")).otherwise(F.col("by_id")).alias("slot"))


def ranked(df: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """df with its rows' numbers from 1 in a total order over the whole table.

    Rows are dealt to ranges, numbered in each, and lifted by the number of rows in the ranges before: no task
    holds the table. The dealt rows are written first, so that all passes see the same ranges.
    """
    dealt = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before, total = [], 0
    for r in sorted(dealt.groupBy("_range").count().collect(), key=lambda r: r["_range"]):  # one row a range
        before.append((r["_range"], total))
        total += r["count"]
    lift = df.sparkSession.createDataFrame(before, "_range int, _before long")
    here = dealt.withColumn(name, F.row_number().over(Window.partitionBy("_range").orderBy(*order)).cast("long"))
    return here.join(F.broadcast(lift), "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")


def volume_gate(sizes: DataFrame, by: list[str], n: str, share: float = 0.20) -> DataFrame:
    """Rows of at least a share of their group's largest."""
    return sizes.withColumn("_top", F.max(n).over(Window.partitionBy(*by))).where((F.col(n) >= share * F.col("_top")) & (F.col("_top") > 0)).drop("_top")


def mutual_best(pairs: DataFrame, left: str, right: str, score: str) -> DataFrame:
    """Pairs that are the best (score, then lower left, then lower right) of both their ends."""
    order = F.struct(F.col(score), -F.col(left), -F.col(right))
    ends = pairs.select(left, right, score, F.explode(F.array(left, right)).alias("end"))
    best = ends.groupBy("end").agg(F.max_by(F.struct(left, right), order).alias("b"))
    votes = best.groupBy(F.col(f"b.{left}").alias(left), F.col(f"b.{right}").alias(right)).count().where("count = 2").drop("count")
    return pairs.join(votes, [left, right], "left_semi")


def select_splits(rows: DataFrame, policy: dict | None = None, guards: dict | None = None, by: list[str] | None = None) -> DataFrame:
    """Of candidates with predicted deltas, the eligible ones' best of each group, (anatomy, source_id) by default: least merges, least splits, then the highest quality, then the lowest proposal."""
    p = {"action": "select", "merge_max": 0.0, "split_max": 1.0} | (policy or {})
    g = {"delta_dice_min": 0.0, "delta_f1_min": 0.0, "delta_precision_min": 0.0} | (guards or {})
    fits = (F.col("d_merge") <= p["merge_max"]) & (F.col("d_split") <= p["split_max"]) & (F.col("d_dice") >= g["delta_dice_min"]) & (F.col("d_f1") >= g["delta_f1_min"]) & (F.col("d_precision") >= g["delta_precision_min"])
    eligible = rows.where(fits if p["action"] == "select" else F.lit(False))
    order = F.struct("d_merge", "d_split", -F.col("d_f1"), -F.col("d_dice"), -F.col("d_precision"), "proposal_id")
    by = by or ["anatomy", "source_id"]
    return eligible.groupBy(*by).agg(F.min_by(F.struct("proposal_id", "d_merge"), order).alias("s")).select(*by, "s.proposal_id", "s.d_merge")


def assign_free_ids(spark, used: DataFrame, selected: DataFrame, block: int = 50) -> DataFrame:
    """Each selected source, ascending, gets the lowest free id of its block; those beyond the free ids get none.

    used (anatomy, id), selected (anatomy, source_id). Blocks are numbers 1 to 4, so the free ids are 200 rows at most.
    """
    grid = spark.range(4 * block).select((F.col("id") + 1).alias("id"), (F.floor(F.col("id") / block) + 1).alias("anatomy"))
    free = grid.join(used.select("id").distinct(), "id", "left_anti").withColumn("k", F.row_number().over(Window.partitionBy("anatomy").orderBy("id")))
    want = selected.withColumn("k", F.row_number().over(Window.partitionBy("anatomy").orderBy("source_id")))
    return want.join(free, ["anatomy", "k"]).select("anatomy", "source_id", F.col("id").alias("new_id"))


def keep_by_size(grid: DataFrame, label: str, least: int) -> DataFrame:
    """grid with labels of fewer voxels set to 0; ids are counted once and joined back (a window would sort the voxels)."""
    small = grid.where(F.col(label) > 0).groupBy(label).count().where(F.col("count") < least).select(label, F.lit(True).alias("_small"))
    return grid.join(small, label, "left").withColumn(label, F.when(F.col("_small"), 0).otherwise(F.col(label))).drop("_small")


def sampled(df: DataFrame, by: list[str], order: Column, most: int) -> DataFrame:
    """The first `most` rows of each group in the order of a hash: a sample without replacement, alike in reruns."""
    return df.withColumn("_h", order).withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("_h", *[c for c in df.columns if c not in by]))).where(F.col("_r") <= most).drop("_h", "_r")


def folds(groups: DataFrame, key: str, k: int = 5, factor: int = 7919) -> DataFrame:
    """(key, fold): whole groups to folds by arithmetic hashing."""
    return groups.select(key).distinct().withColumn("fold", F.pmod(F.col(key) * factor, F.lit(k)))


def splits(members: DataFrame, fold_of: DataFrame, key: str, k: int = 5) -> DataFrame:
    """(fold, side, key, ...): each member once for each fold, as val in its own and train in the others."""
    e = members.join(fold_of, key).withColumn("own", F.col("fold")).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)).cast("array<bigint>")))
    return e.withColumn("side", F.when(F.col("fold") == F.col("own"), "val").otherwise("train")).drop("own")


def leaks(split: DataFrame, key: str) -> DataFrame:
    """(fold, key) of groups on both sides of a fold; empty if the split is sound."""
    return split.groupBy("fold", key).agg(F.count_distinct("side").alias("sides")).where("sides > 1")


def since_best(series: DataFrame, by: str, order: str, value: str, delta: float) -> DataFrame:
    """Adds `stale`: steps since the value last rose by more than delta over the best that counted.

    With delta 0 a rise is a new running maximum, told by windows alone. With another delta whether a step counts
    depends on those before it, so sorted rows go through a task once, in a stream, keeping two numbers a group.
    """
    rows = series.select(by, order, value)
    if delta == 0:
        group = Window.partitionBy(by).orderBy(order)
        before = F.max(value).over(group.rowsBetween(Window.unboundedPreceding, -1))
        marked = rows.withColumn("_n", F.row_number().over(group)).withColumn("_up", F.when(before.isNull() | (F.col(value) > before), F.col("_n")))
        last = F.max("_up").over(group.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return marked.withColumn("stale", (F.col("_n") - F.coalesce(last, F.lit(0))).cast("int")).drop("_n", "_up")

    def run(batches):
        key, best, stale = object(), None, 0
        for pdf in batches:
            out = []
            for k, v in zip(pdf[by].tolist(), pdf[value].tolist(), strict=True):
                if k != key:
                    key, best, stale = k, None, 0
                better = best is None or v > best + delta
                best, stale = (v, 0) if better else (best, stale + 1)
                out.append(stale)
            yield pdf.assign(stale=out)

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.repartition(by).sortWithinPartitions(by, order).mapInPandas(shipped(rows, run), f"{types}, stale int")
