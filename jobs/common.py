"""What the jobs share: configuration, the command line, and a session that only the command line makes."""

from __future__ import annotations

import argparse
import json
import logging
import os
from collections.abc import Callable

from pyspark.sql import SparkSession

HERE = os.path.dirname(os.path.abspath(__file__))
SHIPPED = "file://" + HERE


def settings(spark: SparkSession, defaults: dict, path: str | None = None) -> dict:
    """The defaults, overlaid by the JSON file at path, which any store that Spark reads may hold; an unknown name fails."""
    given = json.loads(spark.read.text(path, wholetext=True).first()["value"]) if path else {}
    unknown = sorted(set(given) - set(defaults))
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return defaults | given


def command(name: str, what: str, run: Callable, own: Callable[[argparse.ArgumentParser], None]) -> None:
    """Parses the arguments, makes a session, calls run(spark, arguments) and stops the session."""
    p = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=what)
    p.add_argument("--input", required=True, help="folder of the input tables")
    p.add_argument("--output", required=True, help="folder that the job writes")
    p.add_argument("--config", help=f"JSON file of settings (default: {name}.json beside the job)")
    own(p)
    args = p.parse_args()
    args.config = args.config or f"{SHIPPED}/{name}.json"
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    # the master and all other settings come from spark-submit or the environment
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark, args)
    finally:
        spark.stop()
