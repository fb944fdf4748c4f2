"""Status of training runs from their growing logs: epochs, times, best scores, and when early stopping may come.

    python -m jobs.watch_logs --input DIR --output DIR --checkpoint DIR [--config FILE]

A file stream takes the files that came since the last run (availableNow, with a checkpoint) and ends. Of each log's
lines those that say something stay as events; the status of the logs in the touched buckets is made again from their events:

    events/bucket=N/batch=N   (log, part, pos, ...)   a row for each telling line   Parquet
    status/bucket=N           a row for each log                                   Parquet

The result depends on the set of lines, not on the order of files or the number of runs: a line is known by its log, part
(such as a file's or turn's number, compared as given) and place in it, and a later delivery of a line replaces an earlier one.
A batch that is repeated after a failure replaces its own events, so nothing counts twice. Without new files a run changes nothing.

Input formats: `parquet` reads a table, whose rows give a log, a part and an array of lines by SQL expressions; `text` reads
whole files, with the columns `path` and `value` for these expressions.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import logs

from .common import command, settings

LOG = logging.getLogger("jobs.watch_logs")
DEFAULTS = {
    "format": "text", "table": "*.txt", "log": r"regexp_extract(path, '([^/]+)/[^/]+$', 1)", "part": r"regexp_extract(path, '([^/]+)$', 1)", "lines": r"split(value, '\n')",
    "buckets": 16, "recent": 20, "floor": 100, "patience": 50,
}
TELLING = ["named", "seconds", "best", "done"]
KEY = ["log", "part", "pos"]


def read(spark: SparkSession, source: str, c: dict) -> DataFrame:
    """The stream of input rows."""
    path = f"{source}/{{{c['table']}}}"  # a pattern, so that a table may be one file as well as a folder
    if c["format"] == "parquet":
        return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    if c["format"] != "text":
        raise ValueError(f"unknown format: {c['format']}")
    return spark.readStream.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))


def lines_of(rows: DataFrame, c: dict) -> DataFrame:
    """(log, part, pos, text): a row for each line; rows without a log belong to the log ''."""
    made = rows.select(F.coalesce(F.expr(c["log"]).cast("string"), F.lit("")).alias("log"), F.expr(c["part"]).alias("part"), F.posexplode(F.expr(c["lines"])).alias("pos", "text"))
    return made.where("text IS NOT NULL").withColumn("text", F.rtrim("text", F.lit("\r")))


def events_of(lines: DataFrame) -> DataFrame:
    """The telling lines, each read by itself."""
    found = logs.fields(lines, "text").select(*KEY, *TELLING)
    return found.where("named IS NOT NULL OR seconds IS NOT NULL OR best IS NOT NULL OR done")


def status_of(events: DataFrame, c: dict) -> DataFrame:
    """A row for each log, from all its events; of lines told twice the last batch's counts."""
    once = events.groupBy("bucket", *KEY).agg(F.max_by(F.struct(*TELLING), "batch").alias("e")).select("bucket", *KEY, "e.*")
    placed = once.withColumn("at", F.struct("part", "pos"))
    parsed = logs.with_epoch(placed, "log", "at")
    found = logs.progress(logs.log_status(parsed, "log", "at", c["recent"]), c["floor"], c["patience"])
    return found.join(placed.groupBy("bucket", "log").agg(F.count(F.lit(1)).alias("events")), "log")


def run(spark: SparkSession, source: str, out: str, checkpoint: str, config: dict | None = None) -> dict[str, int]:
    """Takes what is new, updates the tables under out and returns what was read and written, in all batches of this run."""
    c = DEFAULTS | (config or {})
    did = {"batches": 0, "lines": 0, "events": 0}

    def put(df: DataFrame, path: str, *by: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)

    def take(rows: DataFrame, batch: int) -> None:
        here, seen = rows.sparkSession, Observation()
        lines = lines_of(rows, c).observe(seen, F.count(F.lit(1)).alias("lines"))
        found = events_of(lines).withColumns({"bucket": F.pmod(F.xxhash64("log"), F.lit(c["buckets"])).cast("int"), "batch": F.lit(batch).cast("long")})
        put(found, f"{out}/events", "bucket", "batch")
        events = here.read.schema(found.schema).parquet(f"{out}/events")
        told = {r["bucket"]: r["count"] for r in events.where(F.col("batch") == batch).groupBy("bucket").count().collect()}  # at most as many as there are buckets
        if told:
            put(status_of(events.where(F.col("bucket").isin(*told)), c), f"{out}/status", "bucket")
        did["batches"] += 1
        did["lines"] += seen.get["lines"]
        did["events"] += sum(told.values())
        LOG.info("batch %d: read %d lines, wrote %d events to %s/events and the status of the logs of %d buckets to %s/status", batch, seen.get["lines"], sum(told.values()), out, len(told), out)

    LOG.info("reading what is new in %s/%s", source, c["table"])
    q = read(spark, source, c).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if not did["batches"]:
        LOG.info("nothing new")
    return did


def output(spark: SparkSession, out: str) -> DataFrame:
    """The status of all logs, with the numbers of their events as they stand in the events' table."""
    status = spark.read.parquet(f"{out}/status").withColumnRenamed("events", "counted")
    events = spark.read.parquet(f"{out}/events").groupBy("log").agg(F.count(F.lit(1)).alias("events"))
    return status.join(events, "log", "left").drop("bucket")


def main() -> None:
    def go(spark, args):
        run(spark, args.input, args.output, args.checkpoint, settings(spark, DEFAULTS, args.config))

    command("watch_logs", __doc__.split("\n")[0], go, lambda p: p.add_argument("--checkpoint", required=True, help="folder of the stream's checkpoint"))


if __name__ == "__main__":
    main()
