"""Operator 11: collocations by level-wise passes (Apriori), scored at their weakest cut.

1. Texts are lower-cased (A-Z), split into pieces at punctuation and line ends and into words; words are
   counted by language. Those of at least LEAST occurrences get numbers.
2. Texts become sequences of these numbers, written once; everything else is a break.
3. Pass k counts phrases of k words, as pairs of the numbers of their two overlapping phrases of k - 1 words:
   a pair is only emitted where both are frequent. The frequent ones get numbers in turn.
4. A candidate's cuts need the counts of its first and last words of every length. They come down from
   level to level by equality joins on the numbers; nothing goes back to the texts.

A level's table is broadcast to tasks as sorted arrays (two numbers packed into 64 bits, and the phrase's
number) while its size is at most BROADCAST_ROWS rows and, for words, BROADCAST_BYTES bytes. Beyond that
sequences are rows of (text, position, number) instead, and each level joins them to its table and to their
neighbours by equality. Both ways give the same counts, and a test holds them to that.

Occurrences are counted in each task and each partition before they are shuffled, so a frequent phrase costs
a row a task.

Defined cases: a null text is empty; a null language is `und`, together with texts that name it so; texts in
one language that repeat count as often; an empty table, or one without frequent phrases, gives no rows;
other columns are ignored. Counts are exact, and scores are whole numbers of exact decimals.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import ranked
from .common import cut, lower_lut, partitions, small, tune, utf8_buffers

#: Words of a phrase, occurrences of a candidate, and phrases reported for each language.
LONGEST, LEAST, MOST = 5, 100, 2000
#: A level's table is broadcast if it has at most so many rows (and bytes of words).
BROADCAST_ROWS, BROADCAST_BYTES = 2_000_000, 32 << 20
UNKNOWN = "und"
#: Bytes of text that are scanned at once, about.
SCAN = 4 << 20

_GAP = np.zeros(256, bool)
_GAP[[0x20, 9, *b".,;:!?", 10, 11, 12, 13]] = True
_END = np.zeros(256, bool)
_END[[*b".,;:!?", 10, 11, 12, 13]] = True
_LOWER = lower_lut()


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of all texts, their texts' numbers, and whether a word follows the one before it in its piece."""
    data, off = utf8_buffers(texts)
    found, of, follows = [], [], []
    first = 0
    while first < len(off) - 1:
        last = max(first + 1, int(np.searchsorted(off, off[first] + SCAN, "right")) - 1)
        part = _LOWER[data[off[first] : off[last]]]
        heads = off[first:last] - off[first]
        inside = ~_GAP[part]
        if inside.any():
            new = inside.copy()
            new[1:] &= ~inside[:-1]
            new[heads[heads < len(part)]] |= inside[heads[heads < len(part)]]
            start = np.flatnonzero(new)
            size = np.add.reduceat(inside, start).astype(np.int64)
            text = np.searchsorted(heads, start, "right") - 1
            ends = np.cumsum(_END[part])[start]
            near = np.zeros(len(start), bool)
            near[1:] = (text[1:] == text[:-1]) & (ends[1:] == ends[:-1])
            offsets = np.zeros(len(start) + 1, np.int32)
            np.cumsum(size, out=offsets[1:])
            found.append(pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(part[inside])))
            of.append(text + first)
            follows.append(near)
        first = last
    if not found:
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, bool)
    return pa.concat_arrays(found), np.concatenate(of), np.concatenate(follows)


def _by_language(batch: pa.RecordBatch):
    """(language, its words, their texts' rows, follows) of each language of a batch (lang, text)."""
    langs = batch.column(0)
    for lang in langs.unique().to_pylist():
        rows = np.flatnonzero(pc.equal(langs, lang).to_numpy(zero_copy_only=False))
        words, of, follows = words_of(batch.column(1).take(pa.array(rows)))
        yield lang, words, rows[of], follows


def _count_words(batches):
    for batch in batches:
        for lang, words, _, _ in _by_language(batch):
            if len(words):
                n = words.value_counts()
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), n.field(0), n.field(1)], names=["lang", "word", "n"])


def _encode(numbers) -> Callable:
    """Texts to (seq): the numbers of their words, with -1 for breaks and other words. numbers: {lang: (words, numbers)}, broadcast."""

    def run(batches):
        known = {lang: (pa.array(w, pa.string()), np.asarray(n, np.int64)) for lang, (w, n) in numbers.value.items()}
        for batch in batches:
            for lang, words, of, follows in _by_language(batch):
                if lang not in known or not len(words):
                    continue
                values, ids = known[lang]
                at = pc.index_in(words, value_set=values).fill_null(-1).to_numpy(zero_copy_only=False)
                seq = np.where(at >= 0, ids[at], -1)
                seq = np.insert(seq, np.flatnonzero(~follows), -1)
                text = np.insert(of, np.flatnonzero(~follows), of[~follows])
                cuts = np.flatnonzero(np.diff(text, prepend=-1))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.append(cuts, len(seq)), pa.int32()), pa.array(seq, pa.int64()))], names=["seq"])

    return run


def _pairs(seq: np.ndarray) -> np.ndarray:
    """Packed pairs of neighbours; -1 where either is none."""
    a, b = seq[:-1], seq[1:]
    return np.where((a >= 0) & (b >= 0), (a << 32) | b, -1)


def _climb(seq: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The numbers of the frequent phrases that begin at each word, one level after the other."""
    for keys, ids in levels:
        pairs = _pairs(seq)
        at = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
        seq = np.where(keys[at] == pairs, ids[at], -1)
    return seq


def _count_pairs(levels) -> Callable:
    def run(batches):
        for batch in batches:
            values = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            pairs = _pairs(_climb(values, levels.value))
            found, n = np.unique(pairs[pairs >= 0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found >> 32), pa.array(found & 0xFFFFFFFF), pa.array(n)], names=["left", "right", "n"])

    return run


def _place_words(batches):
    """(lang, part, text, at, word): every word with its place; places of words of different pieces aren't neighbours."""
    for k, batch in enumerate(batches):
        for lang, words, of, follows in _by_language(batch):
            if len(words):
                at = np.arange(len(words)) + np.cumsum(~follows)
                n = len(words)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(np.full(n, k)), pa.array(of), pa.array(at), words], names=["lang", "part", "text", "at", "word"])


def _kept(counts: DataFrame, least: int, key: list[str]) -> DataFrame:
    """Frequent phrases with numbers from 0."""
    kept = counts.groupBy(*key).agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return cut(ranked(kept, "id", *key).withColumn("id", F.col("id") - 1))


class _Arrays:
    """Levels by broadcast arrays over written sequences."""

    def __init__(self, docs: DataFrame, words: DataFrame):
        spark = docs.sparkSession
        numbers: dict[str, tuple[list, list]] = {}
        for r in words.select("lang", "word", "id").toLocalIterator():
            own = numbers.setdefault(r["lang"], ([], []))
            own[0].append(r["word"])
            own[1].append(r["id"])
        self.spark, self.levels = spark, []
        self.seqs = cut(docs.mapInArrow(_encode(spark.sparkContext.broadcast(numbers)), "seq array<long>"))

    def counts(self) -> DataFrame:
        return self.seqs.mapInArrow(_count_pairs(self.spark.sparkContext.broadcast(self.levels)), "left long, right long, n long")

    def rise(self, table: DataFrame) -> None:
        t = table.select("left", "right", "id").toArrow()
        keys = (t["left"].to_numpy() << 32) | t["right"].to_numpy()
        order = np.argsort(keys)
        self.levels.append((keys[order], t["id"].to_numpy()[order]))


class _Rows:
    """Levels by joins of rows (place, at, id), whatever the tables' sizes."""

    def __init__(self, docs: DataFrame, words: DataFrame):
        place = F.struct(F.spark_partition_id().alias("task"), "part", "text")
        placed = docs.mapInArrow(_place_words, "lang string, part long, text long, at long, word string").withColumn("place", place)
        self.rows = cut(placed.join(words.select("lang", "word", "id"), ["lang", "word"]).select("place", "at", "id"))

    @classmethod
    def of(cls, rows: DataFrame) -> _Rows:
        self = cls.__new__(cls)
        self.rows = rows
        return self

    def _met(self) -> DataFrame:
        after = self.rows.select("place", (F.col("at") - 1).alias("at"), F.col("id").alias("right"))
        return self.rows.withColumnRenamed("id", "left").join(after, ["place", "at"])

    def counts(self) -> DataFrame:
        return self._met().select("left", "right", F.lit(1).cast("long").alias("n"))

    def rise(self, table: DataFrame) -> None:
        self.rows = cut(self._met().join(table.select("left", "right", "id"), ["left", "right"]).select("place", "at", "id"))


def _fits(table: DataFrame, rows: int, size: str = "0") -> bool:
    """Whether a written table is small enough for a broadcast."""
    t = table.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.expr(size)), F.lit(0)).alias("bytes")).first()
    return t["n"] <= rows and t["bytes"] <= BROADCAST_BYTES


def _to_rows(docs: DataFrame, words: DataFrame, levels: list[DataFrame]) -> _Rows:
    rows = _Rows(docs, words)
    for t in levels:
        rows.rise(t)
    return rows


def level_tables(docs: DataFrame, longest: int, least: int, rows: int) -> tuple[DataFrame, list[DataFrame]]:
    """All words' counts (lang, word, n), and the frequent phrases by length: (id, lang, word, n), then (id, left, right, n)."""
    spoken = cut(docs.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    words = _kept(spoken, least, ["lang", "word"])
    found = [words]
    if words.isEmpty():
        return spoken, found
    way = _Arrays(docs, words) if _fits(words, rows, "octet_length(word)") else _Rows(docs, words)
    while len(found) < longest:
        table = _kept(way.counts(), least, ["left", "right"])
        if table.isEmpty():
            break
        found.append(table)
        if len(found) < longest:
            if isinstance(way, _Arrays) and not _fits(table, rows):
                way = _to_rows(docs, words, found[1:-1])
            way.rise(table)
    return spoken, found


def candidates(spoken: DataFrame, found: list[DataFrame]) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of every candidate that no longer one stands for."""
    total = cut(spoken.groupBy("lang").agg(F.sum("n").alias("total")))
    words = found[0]
    # heads, tails: the counts of a phrase's first and last 1, 2, ... words
    known = words.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), F.array("n").alias("heads"), F.array("n").alias("tails"))
    out = None
    for k, table in enumerate(found[1:], 2):
        left = known.select(F.col("id").alias("left"), "lang", "phrase", "heads")
        right = known.select(F.col("id").alias("right"), "last", "tails")
        known = cut(table.join(left, "left").join(right, "right").select("id", "n", "lang", F.concat("phrase", F.lit(" "), "last").alias("phrase"), "last", F.concat("heads", F.array("n")).alias("heads"), F.concat("tails", F.array("n")).alias("tails")))
        mine = known
        if k < len(found):
            longer = found[k]
            both = longer.select(F.explode(F.array("left", "right")).alias("id"), F.col("n").alias("longer")).groupBy("id").agg(F.max("longer").alias("longer"))
            mine = mine.join(both, "id", "left").where("longer IS NULL OR longer < n")
        with_total = mine.join(small(total), "lang")
        whole = lambda c: c.cast("decimal(18,0)")
        cuts = []
        for j in range(1, k):
            l, r = F.col("heads")[j - 1], F.col("tails")[k - j - 1]
            score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * whole(F.col("n")) * whole(F.col("total")), whole(l) * whole(r))
            cuts.append(F.struct(score.alias("score"), F.lit(j).alias("k"), l.alias("l"), r.alias("r")))
        weakest = F.array_min(F.array(*cuts))
        rows = with_total.select("lang", "phrase", F.col("n").alias("a"), weakest.alias("w"), F.col("total").alias("n")).select("lang", "phrase", "a", "w.l", "w.r", "n", "w.score")
        out = rows if out is None else out.unionByName(rows)
    return out


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, most: int = MOST, rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs (lang, text) to each language's first phrases: (lang, rank, phrase, a, l, r, n, score)."""
    tune(docs.sparkSession)
    given = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    spoken, found = level_tables(given, longest, least, rows)
    if len(found) < 2:
        return docs.sparkSession.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = candidates(spoken, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return best.select("lang", F.col("rank").cast("long"), "phrase", *[F.col(c).cast("long") for c in ("a", "l", "r", "n", "score")])


def oracle_sql(longest: int = LONGEST, least: int = LEAST, most: int = MOST) -> str:
    """The result in DuckDB SQL."""
    of = lambda i, j: f"array_to_string(w[{i}:{j}], ' ')"
    sizes = ", ".join(map(str, range(1, longest + 1)))
    return rf"""
        WITH p AS (SELECT COALESCE(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        s AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
        g AS (SELECT lang, k, {of('i', 'i + k - 1')} AS phrase FROM (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM s, (SELECT unnest([{sizes}]) AS k) AS sizes)),
        f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY 1, 2, 3 HAVING count(*) >= {least}),
        t AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY 1),
        c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
        o AS (SELECT DISTINCT x.lang, x.phrase FROM c x JOIN (SELECT lang, a, unnest([{of('1', 'k - 1')}, {of('2', 'k')}]) AS part FROM c WHERE k > 2) y ON y.lang = x.lang AND y.part = x.phrase AND 100 * y.a >= 100 * x.a),
        u AS (SELECT c.lang, c.phrase, c.a, c.i, x.a AS l, y.a AS r, t.n, CAST(1000 AS HUGEINT) * c.a * t.n // (CAST(x.a AS HUGEINT) * y.a) AS score
              FROM (SELECT *, unnest(range(1, k)) AS i FROM c) c JOIN t ON t.lang = c.lang
              JOIN f x ON x.lang = c.lang AND x.phrase = {of('1', 'i').replace('w[', 'c.w[')} JOIN f y ON y.lang = c.lang AND y.phrase = {of('i + 1', 'c.k').replace('w[', 'c.w[')}
              WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.lang = c.lang AND o.phrase = c.phrase)),
        b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
        FROM b QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= {most}"""
