"""Incremental run status over an event stream: an extension.

Late rows are dropped by the watermark; windows close when it passes, so state is bounded by the open
windows and their kinds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of a folder's event files (Parquet)."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_status(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, kind, n, mean, last): of each window and event type; works on streams and tables alike."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if e.isStreaming else e
    return e.groupBy(F.window("ts", window).alias("w"), F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.max_by("value", F.struct("ts", "event_id")).alias("last")).select(F.col("w.start").alias("start"), "kind", "n", "mean", "last")


def run_to_table(status: DataFrame, name: str, checkpoint: str):
    """Runs the stream over what is there into an in-memory table (append: closed windows only)."""
    q = status.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
