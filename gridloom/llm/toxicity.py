"""Operator 9: toxicity by compression distance.

Two zstandard dictionaries hold the windows (words, and pairs of neighbours) that mark toxic and ordinary
training texts: all toxic marks that pass a test of significance, and the most frequent ordinary words.
Every word of a text, and every pair that is a mark, is compressed with each; what the toxic dictionary
saves over the ordinary one is the window's distance. A text's largest distances, and how many pass
thresholds, go through a logistic calibration. It is fitted out of fold: the training rows are dealt to
FOLDS parts, and each part is measured with dictionaries made from the others. The cut between toxic and
ordinary is the one of the best F score (BETA) on these out-of-fold scores, and stands at a score of 0.5.

The dictionaries' entries are chosen by counting, not by zstandard's own trainer: that one ranks what is
frequent, not what tells the kinds apart (the README states what it reached).

A window is compressed with a fixed carrier behind it that both dictionaries hold: zstandard stores
inputs of a few bytes raw and looks for no match in the last eight, so a bare word has no measurable
length.

Learned from at most TRAIN_ROWS labelled rows whose crc32(doc_id as text) mod 5 is not 0, the first in
hash order; the windows of whole texts of all rows are scored.

Defined cases: a null or empty text has no windows and gets the calibration's score for none; windows
that repeat in a text count once; of several texts of one labelled doc_id the first in code-point order
teaches; a null doc_id is held out of nothing (`held_out` gives null) and teaches nothing; a word over WINDOW_BYTES bytes is several windows; labels that repeat
a doc_id count as toxic if one of them does, null labels not at all; without labelled rows of both kinds
every score is the smoothed rate of toxic rows, (toxic + 0.5) / (all + 2); an empty table gives no rows; other columns pass through
`score_documents` and are no input of a score (given columns score and predicted are replaced; `drop_toxic` returns them as given).
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import first_by_hash, most_counted, tune, with_added

TRAIN_ROWS = 12_000
ORDINARY_BYTES = 65_536
#: A toxic window stands in so many toxic training texts at least, and in so many times its share of ordinary ones.
LEAST_TEXTS, RATIO = 3, 6.0
#: The least G (likelihood-ratio) statistic of a toxic word, and of a pair: chances of about 5e-5 and 1e-6, as there are more pairs.
LEAST_G, LEAST_G_PAIR = 15.0, 22.0
#: Rows in which a task passes windows on while it counts.
COUNT_ROWS = 100_000
WINDOW_BYTES = 48
LEVEL = 9
CARRIER = b" compression carrier of a window"
THRESHOLDS = (2, 3, 4)
TOP = (1, 3, 8)
CACHE = 250_000
#: Parts of the training rows for the calibration.
FOLDS = 5
FEATURES = len(TOP) + 2 + 3 * len(THRESHOLDS)
#: Weight of recall against precision in the choice of the cut: that of the best F score of this beta.
BETA = 1.0
_WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def windows(text: str | None) -> list[bytes]:
    """The text's distinct windows."""
    out: dict[bytes, None] = {}
    for w in dict.fromkeys(_WORD.findall((text or "").lower())):
        b = w.encode()
        for i in range(0, len(b), WINDOW_BYTES):
            out[b" " + b[i : i + WINDOW_BYTES] + b" "] = None
    return list(out)


def pair(a: str, b: str) -> bytes:
    """The window of two neighbouring words; of long words, what stands next to the other."""
    half = WINDOW_BYTES // 2
    return b" " + a.encode()[-half:] + b" " + b.encode()[:half] + b" "


def pairs(text: str | None) -> list[bytes]:
    """The text's distinct pairs of neighbouring words."""
    words = _WORD.findall((text or "").lower())
    return list(dict.fromkeys(pair(a, b) for a, b in dict.fromkeys(zip(words, words[1:]))))


@lru_cache(maxsize=4)
def compressors(toxic: bytes, ordinary: bytes):
    import zstandard as zs

    params = zs.ZstdCompressionParameters.from_level(LEVEL, format=zs.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
    return tuple(zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(d, dict_type=zs.DICT_TYPE_RAWCONTENT), compression_params=params).compress for d in (toxic, ordinary))


class Distances:
    """Distances of windows, kept in a bounded cache by word."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.by_toxic, self.by_ordinary = compressors(toxic, ordinary)
        self.seen: dict[str, int] = {}
        # two spaces stand between windows, one within a pair
        marks = [w for w in toxic[: -len(CARRIER)].strip(b" ").split(b"  ") if b" " in w]
        self.pairs = {b" " + w + b" " for w in marks}
        #: first words of pairs; a longer word may begin one with its end
        self.firsts = {w.split(b" ")[0].decode("utf-8", "replace") for w in marks}

    def distance(self, window: bytes) -> int:
        x = window + CARRIER
        return len(self.by_ordinary(x)) - len(self.by_toxic(x))

    def features(self, text: str | None) -> list[float]:
        words = _WORD.findall((text or "").lower())
        seen, d, long = self.seen, [], {}
        for w in dict.fromkeys(words):
            x = seen.get(w)
            if x is None:
                b = w.encode()
                if len(b) > WINDOW_BYTES:
                    long.update(dict.fromkeys(windows(w)))
                    continue
                if len(seen) >= CACHE:
                    seen.clear()
                x = seen[w] = self.distance(b" " + b + b" ")
            d.append(x)
        known = {b" " + w.encode() + b" " for w in words} if long else ()
        d += [self.distance(w) for w in long if w not in known]
        n = len(d)
        if self.pairs:
            firsts, half = self.firsts, WINDOW_BYTES // 2
            near = dict.fromkeys((a, b) for a, b in zip(words, words[1:]) if a in firsts or (len(a) > half // 4 and (len(a) > half or not a.isascii())))
            d += [self.distance(w) for w in dict.fromkeys(pair(*x) for x in near) if w in self.pairs]
        d.sort(reverse=True)
        over = [float(sum(x >= t for x in d)) for t in THRESHOLDS]
        counts = [y for x in over for y in (math.log1p(x), x / math.sqrt(n) if n else 0.0, x / n if n else 0.0)]
        return [float(sum(d[:k])) for k in TOP] + [math.log1p(n), sum(x for x in d if x >= THRESHOLDS[0]) / math.sqrt(n + 1)] + counts


def _dictionary(ranked: list[bytes], size: int | None = None) -> bytes:
    """The best windows (all, or those that fit) last, where zstandard finds them at the least cost, then the carrier."""
    out, n = [], 0
    for w in ranked:
        if size is not None and n + len(w) > size:
            break
        out.append(w)
        n += len(w)
    return b"".join(reversed(out)) + CARRIER


def g_statistic(toxic: Column, ordinary: Column, n_toxic: int, n_ordinary: int) -> Column:
    """Twice the log-likelihood ratio of a window's counts against the texts' share of toxic ones."""
    n, p = toxic + ordinary, n_toxic / (n_toxic + n_ordinary)
    part = lambda k, share: F.when(k > 0, k * F.log(k / (n * share))).otherwise(0.0)
    return 2 * (part(toxic, p) + part(ordinary, 1 - p))


def rank_marks(marks: list[tuple[bytes, bool, int, int]]) -> list[bytes]:
    """Marks (window, whether a pair, toxic and ordinary texts) by falling ratio; pairs only if neither word is a mark itself."""
    words = {w for w, pair, *_ in marks if not pair}
    kept = [m for m in marks if not m[1] or not any(b" " + w + b" " in words for w in m[0].split())]
    return [m[0] for m in sorted(kept, key=lambda m: (-m[2] / (m[3] + 0.2), -m[2], m[0]))]


def fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (intercept first) of a ridge-penalised logistic regression on x as it stands."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    b = np.zeros(z.shape[1])
    ridge = np.eye(len(b))
    ridge[0, 0] = 1e-3
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z.T * (p * (1 - p))) @ z + ridge, z.T @ (y - p) - ridge @ b)
        b += step
        if np.abs(step).max() < 1e-9:
            break
    w = b[1:] / scale
    return np.concatenate(([b[0] - w @ mean], w))


def best_cut(score: np.ndarray, y: np.ndarray) -> float:
    """The log-odds at which predicting toxic from there on has the best F score; the middle of the gap to the next lower one."""
    order = np.argsort(-score, kind="stable")
    s, hits = score[order], np.cumsum(y[order])
    b = BETA * BETA
    f = np.where(np.append(s[:-1] != s[1:], True), (1 + b) * hits / (np.arange(1, len(s) + 1) + b * y.sum()), -1.0)
    k = int(np.argmax(f))
    return float(s[k] if k + 1 == len(s) else (s[k] + s[k + 1]) / 2)


def _dictionaries(counts: DataFrame, left_out: int | None) -> tuple[bytes, bytes]:
    """The two dictionaries from the window counts of all parts but one."""
    parts = [k for k in range(FOLDS) if k != left_out]
    toxic, texts = (sum((F.col(f"{name}{k}") for k in parts), F.lit(0)) for name in ("toxic", "texts"))
    own = counts.select("w", "pair", toxic.alias("toxic"), (texts - toxic).alias("ordinary"))
    whole = own.where(F.length("w") == 0).first()
    n_toxic, n_ordinary = (whole["toxic"], whole["ordinary"]) if whole else (0, 0)
    if not n_toxic or not n_ordinary:
        return CARRIER, CARRIER
    few = own.where((F.length("w") > 4) & (F.col("toxic") >= LEAST_TEXTS) & (F.col("toxic") / n_toxic > RATIO * (F.col("ordinary") + 0.2) / n_ordinary))
    marks = few.where(g_statistic(F.col("toxic"), F.col("ordinary"), n_toxic, n_ordinary) >= F.when(F.col("pair"), LEAST_G_PAIR).otherwise(LEAST_G)).collect()
    frequent = most_counted(own.where((F.length("w") > 0) & ~F.col("pair") & (F.col("ordinary") > 0)).select("w", "ordinary"), "ordinary", ORDINARY_BYTES // 2).collect()
    return (
        _dictionary(rank_marks([(bytes(r["w"]), r["pair"], r["toxic"], r["ordinary"]) for r in marks])),
        _dictionary([bytes(r["w"]) for r in sorted(frequent, key=lambda r: (-r["ordinary"], bytes(r["w"])))], ORDINARY_BYTES),
    )


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[bytes, bytes, np.ndarray]:
    """(toxic dictionary, ordinary dictionary, weights)."""
    tune(docs.sparkSession)
    told = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    ids = first_by_hash(told, "doc_id", rows).withColumn("fold", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("fold")), F.lit(FOLDS)).cast("int"))
    # one text an id, so that ids bound the rows; of several the first in code-point order
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"), F.first("fold").alias("fold")).select("text", "toxic", "fold")

    def count(batches):
        columns = {"w": pa.binary(), "pair": pa.bool_(), "toxic": pa.int64(), "fold": pa.int32()}
        rows: list[tuple] = []

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), columns.values(), strict=True)], names=list(columns))
            rows.clear()
            return out

        for batch in batches:
            for text, t, fold in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                rows.append((b"", False, t, fold))  # stands for the text
                rows += [(w, False, t, fold) for w in windows(text)]
                rows += [(w, True, t, fold) for w in pairs(text)]
                if len(rows) >= COUNT_ROWS:
                    yield flush()
        if rows:
            yield flush()

    at = lambda k, x: F.sum(F.when(F.col("fold") == k, x).otherwise(0))
    found = sample.mapInArrow(count, "w binary, pair boolean, toxic long, fold int")
    counts = found.groupBy("w", "pair").agg(*[c for k in range(FOLDS) for c in (at(k, F.col("toxic")).alias(f"toxic{k}"), at(k, 1).alias(f"texts{k}"))])
    counts = counts.where(~F.col("pair") | (sum((F.col(f"toxic{k}") for k in range(FOLDS)), F.lit(0)) >= LEAST_TEXTS)).cache()
    try:
        whole = counts.where(F.length("w") == 0).first()
        n_toxic = sum(whole[f"toxic{k}"] for k in range(FOLDS)) if whole else 0
        n_ordinary = sum(whole[f"texts{k}"] for k in range(FOLDS)) - n_toxic if whole else 0
        if not n_toxic or not n_ordinary:
            return CARRIER, CARRIER, np.array([math.log((n_toxic + 0.5) / (n_ordinary + 1.5))] + [0.0] * FEATURES)
        toxic, ordinary = _dictionaries(counts, None)
        others = [_dictionaries(counts, k) for k in range(FOLDS)]
    finally:
        counts.unpersist()

    def describe(batches):
        measures = [Distances(*d) for d in others]
        for batch in batches:
            texts, folds = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([measures[k].features(t) for t, k in zip(texts, folds, strict=True)], pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    measured = sample.mapInArrow(describe, "x array<double>, toxic int").collect()
    measured.sort(key=lambda r: (r["toxic"], r["x"]))  # sums in one order, whatever order the rows came in
    x, y = np.array([r["x"] for r in measured]), np.array([r["toxic"] for r in measured], float)
    weights = fit_logistic(x, y)
    weights[0] -= best_cut(weights[0] + x @ weights[1:], y)
    return toxic, ordinary, weights


def _scored(docs: DataFrame, labels: DataFrame, keep: list[str], rows: int) -> DataFrame:
    """The columns in keep as in_0, in_1 ..., with score and predicted, so that no given name clashes."""
    toxic, ordinary, weights = train(docs, labels, rows)

    def run(batches):
        measure = Distances(toxic, ordinary)
        for batch in batches:
            n = batch.num_columns - 1
            x = np.array([measure.features(t) for t in batch.column(n).to_pylist()]).reshape(-1, FEATURES)
            z = np.clip(weights[0] + x @ weights[1:], -30, 30)
            score = 1 / (1 + np.exp(-z))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32), pa.int32())], names=[*batch.schema.names[:n], "score", "predicted"])

    given = docs.select(*[docs[c].alias(f"in_{i}") for i, c in enumerate(keep)], F.col("text").alias("_text"))
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in given.schema if f.name != "_text"] + ["score double, predicted int"])
    return given.mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, rows: int = TRAIN_ROWS) -> DataFrame:
    """docs' columns (or those in keep) with score and predicted behind them; docs has doc_id and text."""
    keep = docs.columns if keep is None else keep
    return with_added(_scored(docs, labels, keep, rows), keep, ["score", "predicted"])


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those predicted toxic."""
    kept = _scored(docs, labels, docs.columns, TRAIN_ROWS).where("predicted = 0")
    return kept.select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(docs.columns)])
