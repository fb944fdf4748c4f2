"""Operator 5: document fingerprints by winnowing.

Rolling hashes of every K-gram of code points; of each window of W consecutive hashes the smallest is
chosen, the rightmost of equal ones; chosen hashes keep their positions. Two texts that share a passage
of W + K - 1 code points share a fingerprint entry. All texts take the same window; a text shorter than
one is one window.

The query sets each text beside its edited form, which takes from the next document, in ascending
doc_id. Documents are dealt to ranges of (doc_id, digest of the text) and sorted there; the first
document of a range also goes to the end of the range before, so that each finds its next one in its own
task. Rows that repeat doc_id and text become one with a count first and are spread again at the end, so
neither a repeated doc_id nor a repeated row fills a task.

Defined cases: a null text counts as empty; an empty text has an empty fingerprint, like another empty
one by 1 and any other by 0; a text of fewer than K code points is one gram; rows that repeat a doc_id
stand in the order of their texts' digests; a null doc_id stands first; a doc_id of another than an
integer type is ordered as text, by code points; the last document's next is the first (its own, if it
is alone); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, first_by_hash, mix64, order_key, partitions, small, tune

K, W = 20, 32
#: Documents of a range of doc_id, about; ranges, at most; and sampled keys for each bound between ranges.
RANGE_ROWS, MOST_RANGES, PER_BOUND = 500, 10_000, 20
#: Copies of a repeated row that one task writes.
COPIES = 10_000
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_POS_BITS = 24


def gram_hashes(text: str, k: int = K) -> np.ndarray:
    """40-bit hashes of the k-grams; one for a shorter text, none for the empty one."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + _U(1)
    k = min(k, len(c))
    if not k:
        return np.zeros(0, np.uint64)
    # by doubling: the hash of 2m letters comes from two of m
    done, value, rest = 0, None, None
    power, size = c, 1
    while size <= k:
        if k & size:
            if value is None:
                value, done = power, size
            else:
                n = len(c) - done - size + 1
                value = value[:n] * _U(pow(_BASE, size, 1 << 64)) + power[done : done + n]
                done += size
        if 2 * size > k:
            break
        n = len(power) - size
        power = power[:n] * _U(pow(_BASE, size, 1 << 64)) + power[size : size + n]
        size *= 2
    return mix64(value) >> _U(_POS_BITS)


def winnow(text: str, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the fingerprint, in the order of positions."""
    h = gram_hashes(text, k)
    n = len(h)
    if not n:
        return h, np.zeros(0, np.int64)
    w = min(n, w)
    hs, ps = [], []
    step = (1 << _POS_BITS) - w  # positions are packed below the hash, so very long texts go in overlapping pieces
    for at in range(0, max(1, n - w + 1), step):
        part = h[at : at + step + w - 1]
        low = _U((1 << _POS_BITS) - 1) - np.arange(len(part), dtype=np.uint64)  # falls with the position: rightmost ties
        best, size = (part << _U(_POS_BITS)) | low, 1
        while 2 * size <= w:
            best = np.minimum(best[:-size], best[size:])
            size *= 2
        if size < w:
            best = np.minimum(best[: len(best) - (w - size)], best[w - size :])
        chosen = best[np.concatenate(([True], best[1:] != best[:-1]))]
        hs.append(chosen >> _U(_POS_BITS))
        ps.append((_U((1 << _POS_BITS) - 1) - (chosen & _U((1 << _POS_BITS) - 1))).astype(np.int64) + at)
    hashes, places = np.concatenate(hs), np.concatenate(ps)
    keep = np.concatenate(([True], places[1:] != places[:-1]))
    return hashes[keep], places[keep]


def as_text(fp: tuple[np.ndarray, np.ndarray]) -> str:
    return ",".join([f"{h:010x}:{p}" for h, p in zip(fp[0].tolist(), fp[1].tolist(), strict=True)])


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Jaccard likeness of the distinct hashes; 1 for two empty fingerprints."""
    x, y = set(a[0].tolist()), set(b[0].tolist())
    return len(x & y) / len(x | y) if x or y else 1.0


def edited_text(text: str, nxt: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + nxt[:half]


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    spark = docs.sparkSession
    tune(spark)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce("text", F.lit(""))
    key = F.coalesce(F.concat(F.lit("1"), order_key("doc_id", docs.schema["doc_id"].dataType)), F.lit("0"))
    rows = docs.select("doc_id", key.alias("k"), F.md5(text.cast("binary")).alias("h"), text.alias("text"))
    schema = f"doc_id {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    keys = cut(rows.groupBy("k", "h").agg(F.count(F.lit(1)).alias("copies")))
    n = keys.count()
    if not n:
        return spark.createDataFrame([], schema)
    repeated = cut(keys.where("copies > 1"))
    several = not repeated.isEmpty()
    if several:
        once = rows.join(small(repeated.select("k", "h")), ["k", "h"], "left_anti").select("doc_id", "k", "h", "text", F.lit(1).cast("long").alias("copies"))
        held = rows.join(small(repeated.select("k", "h")), ["k", "h"], "left_semi").groupBy("k", "h").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
        rows = once.unionByName(held)
    else:
        rows = rows.withColumn("copies", F.lit(1).cast("long"))

    n_ranges = max(1, min(MOST_RANGES, -(-n // RANGE_ROWS)))
    sampled = sorted((r["k"], r["h"]) for r in first_by_hash(keys.select(F.concat_ws(":", "k", "h").alias("key"), "k", "h"), "key", PER_BOUND * n_ranges).collect()) if n_ranges > 1 else []
    bounds = sampled[PER_BOUND::PER_BOUND]

    @F.pandas_udf("int")
    def range_of(k: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([bisect_left(bounds, x) for x in zip(k, h, strict=True)], dtype="int32")

    heads = {r["r"]: (r["least"]["k"], r["least"]["h"]) for r in keys.groupBy(range_of("k", "h").alias("r")).agg(F.min(F.struct("k", "h")).alias("least")).collect()}
    order = sorted(heads)
    before = {heads[r]: order[j - 1] for j, r in enumerate(order)}

    @F.pandas_udf("array<int>")
    def places(k: pd.Series, h: pd.Series) -> pd.Series:
        """A row's range, and the range before (as -1 - it) if the row is the first of its own."""
        return pd.Series([[bisect_left(bounds, x), -1 - before[x]] if x in before else [bisect_left(bounds, x)] for x in zip(k, h, strict=True)])

    dealt = rows.withColumn("place", F.explode(places("k", "h"))).select("doc_id", "k", "h", "text", "copies", F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place")).alias("r"), (F.col("place") < 0).alias("ahead"))
    ordered = dealt.repartition(partitions(spark), "r").sortWithinPartitions("r", "ahead", "k", "h").select("doc_id", "text", "copies", "r", "ahead")

    def run(batches):
        last = None  # (range, doc_id, text, copies, fingerprint)
        for batch in batches:
            out = []

            def say(at, text, fp):
                edit = edited_text(at[2], text)
                efp = winnow(edit)
                return (at[1], len(at[2]), hashlib.sha256(edit.encode()).hexdigest(), as_text(at[4]), as_text(efp), likeness(at[4], efp), likeness(at[4], fp))

            for doc_id, text, copies, r, ahead in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                if ahead and (last is None or last[0] != r):
                    continue  # this range has found its next document
                fp = winnow(text)
                if last is not None and last[0] == r:
                    out.append((*say(last, text, fp), 1))
                # of copies, each but the last has the next one beside it
                if not ahead and copies > 1:
                    out.append((*say((r, doc_id, text, copies, fp), text, fp), copies - 1))
                last = None if ahead else (r, doc_id, text, copies, fp)
            cols = list(zip(*out, strict=True)) or [()] * 8
            types = (batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "copies"])

    found = ordered.mapInArrow(run, schema + ", copies long")
    if not several:
        return found.drop("copies")
    # counted rows are spread in parts of a bounded size
    parts = found.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES))))
    own = F.least(F.lit(COPIES).cast("long"), F.col("copies") - F.col("part") * COPIES)
    spread = parts.withColumn("own", own).repartition(partitions(spark), "edited_sha256", "part")
    return spread.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("own")))).drop("copies", "part", "own", "copy")
