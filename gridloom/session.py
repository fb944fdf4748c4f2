"""Session and tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "gridloom", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster use the one that is there."""
    cpus = cpus or os.cpu_count() or 4
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app).config("spark.sql.shuffle.partitions", str(cpus)).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
