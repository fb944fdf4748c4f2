"""What needs the cluster: lineage cuts in its shared folder that survive lost executors, and this package on its executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or (unset, in a local session as in tests) a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not hasattr(spark, "_gridloom_shared"):
        spark._gridloom_shared = tempfile.mkdtemp(prefix="gridloom-")
    return spark._gridloom_shared


def ship(spark: SparkSession) -> None:
    """Once a session, sends this package to the executors, where tasks import it; executors that start later fetch it too."""
    sc = spark.sparkContext
    if getattr(sc, "_gridloom_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="gridloom-")), "gridloom.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for n in names:
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.join("gridloom", os.path.relpath(path, here)))
    sc.addPyFile(target)
    sc._gridloom_shipped = True


def shipped(df: DataFrame, run: Callable) -> Callable:
    """run, a function for tasks over df's rows, once this package is on its way to the executors."""
    ship(df.sparkSession)
    return run


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out by its keys to all of the session's shuffle partitions: kernels that take long over few bytes would else
    meet in the few tasks that these bytes fill."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where a row's keys differ from those of the row before; the first row isn't asked."""
    new = np.zeros(max(table.num_rows - 1, 0), bool)
    for k in keys:
        c = table.column(k).combine_chunks()
        here, before = c.slice(1), c.slice(0, max(len(c) - 1, 0))
        new |= pc.or_(pc.fill_null(pc.not_equal(here, before), False), pc.xor(pc.is_null(here), pc.is_null(before))).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new) + 1


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches of rows sorted by their keys as tables of whole groups, and where each group starts. A table holds the groups that end in
    one batch, and of earlier batches only what the first of them left."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        starts = _starts(pa.concat_tables([held[-1].slice(held[-1].num_rows - 1), table]), keys) - 1 if held else _starts(table, keys)
        if len(starts):
            begun = sum(t.num_rows for t in held)
            done = pa.concat_tables([*held, table.slice(0, starts[-1])])
            yield done, np.unique(np.append(0, starts[:-1] + begun))
            held = [table.slice(starts[-1])]
        else:
            held.append(table)
    if held:
        yield pa.concat_tables(held), np.zeros(1, np.int64)


def in_groups(df: DataFrame, keys: list[str], run: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """run over df's groups by keys, as rows of the schema: a call gets a table of many small groups, or a large one, and where each starts.
    A call a group costs more than most of our groups' work."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, keys):
            yield from run(table, starts).combine_chunks().to_batches()

    return dealt(df, *keys).sortWithinPartitions(*keys).mapInArrow(shipped(df, work), schema)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridloom-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
