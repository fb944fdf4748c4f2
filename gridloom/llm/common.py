"""Shared plumbing: tables, lineage cuts, checked broadcasts and byte-level word scanning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType

from ..cluster import ship
from ..cluster import written as cut  # noqa: F401

#: Rows an Arrow batch carries to Python, so that very long texts stay within a worker's memory.
ARROW_ROWS = 1000
#: Bytes of such a batch, about, where Spark has the setting.
ARROW_BYTES = 16 << 20
#: A side is broadcast only if it was counted and has at most so many rows, and bytes as text.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """What operators with Python tasks need: this package on the executors, and batches of a bounded size."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if df (already cut) counts at most `rows` rows of BROADCAST_BYTES in all; else leave the join to the planner and AQE."""
    size = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length(F.to_json(F.struct(*df.columns)))), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if size["n"] <= rows and size["bytes"] <= BROADCAST_BYTES else df


def with_added(df: DataFrame, keep: list[str], added: list[str]) -> DataFrame:
    """df's columns in_0, in_1 ... under the names in keep, then the added ones, which replace given columns of their names."""
    return df.select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(keep) if c not in added], *added)


def order_key(column: str, type_: DataType) -> Column:
    """A column's values as texts of the same order by code points: integers as hexadecimal digits, others by their text; null stays null."""
    if not isinstance(type_, IntegralType):
        return F.col(column).cast("string")
    return F.lpad(F.hex(F.col(column).cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")


def from_order_key(key: Column, type_: DataType) -> Column:
    """The values back from their keys."""
    if not isinstance(type_, IntegralType):
        return key.cast(type_)
    return F.conv(key, 16, -10).cast("long").bitwiseXOR(F.lit(-(1 << 63))).cast(type_)


def partitions(spark: SparkSession, least: int = 12) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def first_by_hash(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The first `rows` rows of df in the order of the key's hash: alike in reruns. Keys are distinct.

    On large tables a bound on the hash, set for twice as many rows, goes before the sort, so that no task
    gathers the first rows of all others.
    """
    h = F.xxhash64(key)
    n = df.count()
    if n > 4 * rows:
        df = df.where(h <= -(1 << 63) + int((1 << 64) * 2 * rows / n))
    return df.orderBy(h, *df.columns).limit(rows)


def most_counted(df: DataFrame, count: str, rows: int) -> DataFrame:
    """`rows` rows of df (or all), those of the largest counts to a sixteenth of a power of two; of the last such class, the first in hash order.

    df's first column is its key. A histogram of at most a thousand classes gives the bound, and only the
    last class is sorted, behind a bound on its hash.
    """
    bin_ = F.floor(F.log2(F.greatest(F.col(count), F.lit(1)).cast("double")) * 16)
    left, bound = rows, None
    for r in sorted(df.groupBy(bin_.alias("bin")).count().collect(), key=lambda r: -r["bin"]):
        if r["count"] > left:
            last = df.where(bin_ == r["bin"])
            part = first_by_hash(last, df.columns[0], left) if left else last.where(F.lit(False))
            return part if bound is None else df.where(bin_ >= bound).unionByName(part)
        left -= r["count"]
        bound = r["bin"]
    return df


# ---------------------------------------------------------------- words of a whole Arrow batch

_U64 = np.uint64


def lower_lut() -> np.ndarray:
    lut = np.arange(256, dtype=np.uint8)
    lut[65:91] += 32
    return lut


def space_lut() -> np.ndarray:
    """True for the bytes that end a word of `[^\\x20\\x09-\\x0D]+`."""
    sep = np.zeros(256, dtype=bool)
    sep[[0x20, 9, 10, 11, 12, 13]] = True
    return sep


def alnum_lut() -> np.ndarray:
    """True for the bytes outside words of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`, after A-Z were lower-cased."""
    sep = np.zeros(256, dtype=bool)
    sep[:0x30] = True
    sep[0x3A:0x61] = True
    sep[0x7B:0x80] = True
    return sep


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _U64(0x9E3779B97F4A7C15))
_STEP = 0xD6E8FEB86659FD93
_POW = np.ones(4096, dtype=np.uint64)
_POW[1:] = _STEP
_POW = np.multiply.accumulate(_POW)


def utf8_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    _, off, data = col.buffers()
    if not len(col) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


#: Bytes of text scanned at once, about: the work arrays take some fifty times as much.
SCAN_BYTES = 1 << 19


def _pieces(data: np.ndarray, off: np.ndarray, sep: np.ndarray):
    """(start, stop) of stretches of about SCAN_BYTES that cut no word: they end before a separator or a text's start."""
    start, n = 0, len(data)
    while start < n:
        stop = min(start + SCAN_BYTES, n)
        while stop < n:
            ahead = np.flatnonzero(sep[data[stop : stop + SCAN_BYTES]])
            head = off[min(np.searchsorted(off, stop), len(off) - 1)]
            found = stop + ahead[0] if len(ahead) else min(stop + SCAN_BYTES, n)
            if head <= found:
                stop = max(int(head), stop)
                break
            stop = int(found)
            if len(ahead):
                break
        yield start, stop
        start = stop


def scan_words(col: pa.Array, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of every text of the batch, in order, and the word offsets of each text (n + 1)."""
    data, off = utf8_buffers(col)
    hashes, starts, lower = [], [], lower_lut()
    for a, b in _pieces(data, off, sep):
        h, s = _scan(lower[data[a:b]], off[np.searchsorted(off, a) : np.searchsorted(off, b)] - a, sep)
        hashes.append(h)
        starts.append(s + a)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), off)


def _scan(data: np.ndarray, heads: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of one stretch; a text's start (heads) begins a word of its own."""
    word = ~sep[data]
    before = np.empty_like(word)
    before[0] = False
    before[1:] = word[:-1]
    before[heads] = False
    start = np.flatnonzero(word & ~before)
    if not len(start):
        return np.zeros(0, np.uint64), start
    inside = np.flatnonzero(word)
    of = np.cumsum((word & ~before)[inside]) - 1
    at = inside - start[of]
    value = _BYTE[data[inside]]
    long = at.max() + 1
    power = _POW if long <= len(_POW) else np.multiply.accumulate(np.concatenate(([_U64(1)], np.full(long, _STEP, np.uint64))))
    value *= power[at]
    return mix64(np.add.reduceat(value, np.flatnonzero(at == 0))), start
