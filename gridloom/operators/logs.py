"""Training logs and run reports from text and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NUMBER = r"[-+]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][-+]?\d+)?"


def fields(lines: DataFrame, text: str) -> DataFrame:
    """Adds what each line says by itself: named (an epoch), seconds, values (class scores), best and done."""
    get = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    inner = get(r"(?:Pseudo dice|Diagnostic pseudo dice) \[(.*)\]")
    plain = F.regexp_replace(inner, r"np\.float32\(", "")
    return lines.withColumns({
        "named": get(r"Epoch (\d+)").cast("int"), "seconds": get(r"Epoch time: ([0-9.]+) s").cast("double"),
        "values": F.regexp_extract_all(plain, F.lit(f"({NUMBER})"), F.lit(1)).cast("array<double>"),
        "best": get(r"New best EMA (?:pseudo Dice|contact-energy score): ([0-9.]+)").cast("double"), "done": F.contains(text, F.lit("Training done.")),
    })


def with_epoch(lines: DataFrame, by: str, order: str) -> DataFrame:
    """Adds the epoch that a log's lines have named last."""
    w = Window.partitionBy(by).orderBy(order)
    return lines.withColumn("epoch", F.last("named", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def parse_log(lines: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """Adds to each ordered line: epoch (the last one named so far), seconds, values (class scores), best, done, and mean20 of the last 20 seconds."""
    return with_epoch(fields(lines, text), by, order)


def log_status(parsed: DataFrame, by: str, order: str, recent: int = 20) -> DataFrame:
    """(by, last_epoch, last_seconds, recent_seconds, best, best_epoch, done): one row for each log."""
    at = F.col(order)
    times = parsed.where("seconds IS NOT NULL").withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).where(F.col("r") <= recent).groupBy(by).agg(F.avg("seconds").alias("recent_seconds"), F.max_by("seconds", at).alias("last_seconds"))
    rest = parsed.groupBy(by).agg(F.max_by("epoch", at).alias("last_epoch"), F.max_by("best", F.when(F.col("best").isNotNull(), at)).alias("best"), F.max_by("epoch", F.when(F.col("best").isNotNull(), at)).alias("best_epoch"), F.bool_or("done").alias("done"))
    return rest.join(times, by, "left")


def progress(status: DataFrame, floor: int = 100, patience: int = 50) -> DataFrame:
    """Adds the stop epoch max(floor, best + patience) and the hours left."""
    stop = F.greatest(F.lit(floor), F.coalesce("best_epoch", F.lit(0)) + patience)
    return status.withColumn("stop_epoch", stop).withColumn("hours_left", F.greatest(F.lit(0), stop - F.coalesce("last_epoch", F.lit(0))) * F.coalesce("recent_seconds", F.lit(0.0)) / 3600)


def leaderboard(runs: DataFrame, score: str, tie: str) -> DataFrame:
    """Runs by falling score, null as -1, with ranks; ties in the order of `tie`. One row a run."""
    return runs.withColumn("rank", F.row_number().over(Window.orderBy(F.coalesce(score, F.lit(-1.0)).desc(), tie)))
