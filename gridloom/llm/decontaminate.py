"""Operator 7: benchmark decontamination by suffix arrays over the training texts.

Every shard (an Arrow batch of documents) gets a suffix array of its words, sorted to the depth of a
window; every suffix of the benchmark is looked up in it by binary search. Places where a suffix matches
lie on diagonals (place in the text less place in the item); a run of neighbours on one diagonal is a
verbatim match, which gives its whole length and where it stands in both. Suffixes that can't begin a
match (their next words are no neighbours anywhere in the benchmark) are left out of the array; that is
exact.

The benchmark travels to the documents in blocks of a bounded size. One block is the usual case: no join
and no shuffle. Of several, each is a pass of its own that writes what it found, by the digest of the
text, and is destroyed before the next one; only contaminated texts come together afterwards.

Defined cases: a null text, or one without words, has no words, windows or hits; an item with fewer
words than a window is one window, one without words none; items that repeat count once by item_id; an
empty benchmark contaminates nothing; of equally long matches the first by item, place in it and place
in the text is named; other columns pass through `mark` (those of the added names are replaced).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_lut, cut, scan_words, small, tune, with_added

WINDOW = 10
#: Bytes of benchmark text that one broadcast block carries, at most (one item may exceed it).
BLOCK_BYTES = 4_000_000
#: Places of matches that are expanded at once.
PLACES = 1 << 20
ADDED = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match", "longest_item", "longest_item_at", "longest_at"]
_MATCH = "struct<less:long,item:string,item_at:long,at:long>"


class Suffixes:
    """The suffixes of a block of items, each cut at a window and each distinct one once, by length."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        items = sorted(items, key=lambda x: (x[0], x[1] or ""))
        hashes, off = scan_words(pa.array([t for _, t in items], pa.large_string()), alnum_lut())
        self.names, self.window, self.off = [n for n, _ in items], window, off
        self.vocabulary = np.unique(hashes)
        ids = self.words = np.searchsorted(self.vocabulary, hashes) + 1
        sizes = np.diff(off)
        owner = np.repeat(np.arange(len(items)), sizes)
        self.owner = owner
        link = np.flatnonzero(owner[:-1] == owner[1:]) if len(ids) else np.zeros(0, np.int64)
        self.pairs = np.unique(self._pair(ids[link], ids[link + 1]))
        #: by length: the sorted keys; and where each key's places (of all items' words in one row) begin and stand
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        left = np.repeat(off[1:], sizes) - np.arange(len(ids))  # words from here to the item's end
        for m in np.unique(np.minimum(sizes[sizes > 0], window)).tolist():
            whole = np.minimum(np.repeat(sizes, sizes), window) == m
            at = np.flatnonzero(whole & (left >= m))
            keys = np.ascontiguousarray(ids[at[:, None] + np.arange(m)].astype(">u4")).view(f"S{4 * m}").ravel()
            order = np.argsort(keys, kind="stable")
            distinct, first = np.unique(keys[order], return_index=True)
            self.by_length[m] = (distinct, np.append(first, len(at)), at[order])

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a * (len(self.vocabulary) + 1) + b

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the words in the vocabulary from 1; 0 for others."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def search(self, ids: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray]]:
        """Yields (m, whether these are all of m, places in the texts, places in the items) of suffixes that match to the depth m, all pairs of places."""
        n = len(ids)
        if not n or not self.by_length:
            return
        doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
        linked = np.zeros(n, bool)
        if len(self.pairs) and n > 1:
            key = self._pair(ids[:-1], ids[1:])
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            linked[:-1] = (self.pairs[at] == key) & (doc[:-1] == doc[1:]) & (ids[:-1] > 0)
        # run[i]: how many words from i on are each the other's neighbour somewhere in the benchmark
        breaks = np.flatnonzero(~linked)
        run = breaks[np.searchsorted(breaks, np.arange(n))] - np.arange(n) + 1
        starts = np.flatnonzero((run >= min(self.by_length)) & (ids > 0))
        if not len(starts):
            return
        depth = max(self.by_length)
        suffix = np.where(np.arange(depth) < run[starts][:, None], ids[np.minimum(starts[:, None] + np.arange(depth), n - 1)], 0).astype(">u4")
        suffix = np.ascontiguousarray(suffix).view(f"S{4 * depth}").ravel()
        order = np.argsort(suffix, kind="stable")
        array, where = suffix[order], starts[order]
        for m, (keys, first, places) in self.by_length.items():
            lo = np.searchsorted(array, keys.astype(f"S{4 * depth}"), "left")
            if m == depth:
                hi = np.searchsorted(array, keys, "right")
            else:
                above = np.ascontiguousarray(np.concatenate([np.frombuffer(keys.tobytes(), np.uint8).reshape(-1, 4 * m), np.full((len(keys), 4 * (depth - m)), 255, np.uint8)], 1)).view(f"S{4 * depth}").ravel()
                hi = np.searchsorted(array, above, "right")
            found = np.flatnonzero(hi > lo)
            a, b = hi[found] - lo[found], first[found + 1] - first[found]
            # every place in the texts with every place in the items, a bounded number of pairs at once
            parts = [x for x in np.split(np.arange(len(found)), np.flatnonzero(np.diff(np.cumsum(a * b) // PLACES)) + 1) if len(x)]
            for part in parts:
                pairs = a[part] * b[part]
                which = np.repeat(part, pairs)
                nth = np.arange(len(which)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
                yield m, len(parts) == 1, where[lo[found[which]] + nth // b[which]], places[first[found[which]] + nth % b[which]]


class Found:
    """What was found in one text: hit words as stretches, items, and the longest verbatim match."""

    __slots__ = ("spans", "items", "longest")

    def __init__(self):
        self.spans: list[tuple[int, int]] = []
        self.items: set[str] = set()
        self.longest: tuple[int, str, int, int] | None = None

    def add(self, spans: list[tuple[int, int]], items: list[str], longest: tuple[int, str, int, int]) -> None:
        merged: list[tuple[int, int]] = []
        for a, b in sorted([*self.spans, *spans]):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        self.spans = merged
        self.items.update(items)
        self.longest = longest if self.longest is None else min(self.longest, longest)


def matches(suffixes: Suffixes, hashes: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Yields (places in the texts, places in the items, lengths) of maximal verbatim matches of a window or more."""
    ids = suffixes.ids(hashes)
    for m, whole, at, item_at in suffixes.search(ids, off):
        diagonal = at - item_at
        order = np.lexsort((at, diagonal))
        at, item_at, diagonal = at[order], item_at[order], diagonal[order]
        # places are numbered through all texts and all items, so a run also ends with its text or its item
        doc, owner = np.searchsorted(off, at, "right"), suffixes.owner[item_at]
        new = np.ones(len(at), bool)
        new[1:] = (diagonal[1:] != diagonal[:-1]) | (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1]) | (owner[1:] != owner[:-1])
        head = np.flatnonzero(new)
        at, item_at, size = at[head], item_at[head], np.diff(np.append(head, len(at))) + m - 1
        if not whole:  # runs may go on in another part of the search
            at, item_at, size = _extended(suffixes, ids, off, at, item_at, size)
        yield at, item_at, size


def _extended(suffixes: Suffixes, ids: np.ndarray, off: np.ndarray, at: np.ndarray, item_at: np.ndarray, size: np.ndarray):
    """The matches grown at both ends as far as the words are equal."""
    d, o = np.searchsorted(off, at, "right") - 1, suffixes.owner[item_at]
    room = np.minimum(off[d + 1] - at, suffixes.off[o + 1] - item_at)
    before = np.minimum(at - off[d], item_at - suffixes.off[o])
    for limit, step in ((room, 1), (before, -1)):
        grown = size.copy() if step > 0 else np.zeros_like(size)
        live = np.flatnonzero(grown < limit)
        while len(live):
            i = at[live] + grown[live] if step > 0 else at[live] - grown[live] - 1
            j = item_at[live] + grown[live] if step > 0 else item_at[live] - grown[live] - 1
            live = live[ids[i] == suffixes.words[j]]
            grown[live] += 1
            live = live[grown[live] < limit[live]]
        if step > 0:
            size = grown
        else:
            at, item_at, size = at - grown, item_at - grown, size + grown
    return at, item_at, size


def find(suffixes: Suffixes, text: pa.Array) -> tuple[np.ndarray, dict[int, Found]]:
    """The number of words of each text, and what was found, by the text's number."""
    hashes, off = scan_words(text, alnum_lut())
    out: dict[int, Found] = {}
    for at, item_at, size in matches(suffixes, hashes, off):
        doc = np.searchsorted(off, at, "right") - 1
        order = np.argsort(doc, kind="stable")
        cuts = np.flatnonzero(np.diff(doc[order])) + 1
        for own in np.split(order, cuts):
            d = int(doc[own[0]])
            begin = at[own] - off[d]
            owners = suffixes.owner[item_at[own]]
            top = own[size[own] == size[own].max()]
            longest = min((-int(size[k]), suffixes.names[suffixes.owner[item_at[k]]], int(item_at[k] - suffixes.off[suffixes.owner[item_at[k]]]), int(at[k] - off[d])) for k in top.tolist())
            out.setdefault(d, Found()).add(list(zip(begin.tolist(), (begin + size[own]).tolist(), strict=True)), [suffixes.names[k] for k in np.unique(owners).tolist()], longest)
    return np.diff(off), out


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str | None]]]:
    """Lists of (item_id as text, text), a bounded number of bytes each, through the driver one at a time."""
    sized = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = sized.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total * 2 // block_bytes)) if total > block_bytes else 1
    for i in range(n):
        part = sized if n == 1 else sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        yield [(r["item_id"] or "", r["text"]) for r in part.collect()]


def _pass(suffixes, only_found: bool) -> Callable:
    """Of batches (other columns, text): the other columns with n_words, spans, items and longest."""

    def run(batches):
        for batch in batches:
            k = batch.num_columns - 1
            sizes, found = find(suffixes.value, batch.column(k))
            rows = sorted(found) if only_found else range(batch.num_rows)
            none = Found()
            own = [found.get(i, none) for i in rows]
            kept = batch.take(pa.array(list(rows), pa.int64())) if only_found else batch
            longest = [None if f.longest is None else dict(zip(("less", "item", "item_at", "at"), f.longest, strict=True)) for f in own]
            yield pa.RecordBatch.from_arrays(
                [
                    *(kept.column(i) for i in range(k)), pa.array([int(sizes[i]) for i in rows], pa.int64()),
                    pa.array([[{"a": a, "b": b} for a, b in f.spans] for f in own], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
                    pa.array([sorted(f.items) for f in own], pa.list_(pa.string())),
                    pa.array(longest, pa.struct([("less", pa.int64()), ("item", pa.string()), ("item_at", pa.int64()), ("at", pa.int64())])),
                ],
                names=[*batch.schema.names[:k], "n_words", "spans", "items", "longest"],
            )

    return run


_FOUND = f"n_words long, spans array<struct<a:long,b:long>>, items array<string>, longest {_MATCH}"


def _marked(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int, keep: list[str]) -> DataFrame:
    """The columns in keep as in_0, in_1 ..., with the added ones, so that no given name clashes."""
    spark = docs.sparkSession
    tune(spark)
    given = docs.select(*[docs[c].alias(f"in_{i}") for i, c in enumerate(keep)], F.col("text").alias("_text"))
    kept = [f"in_{i}" for i in range(len(keep))]
    types = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in given.schema if f.name != "_text")
    blocks = _blocks(benchmark, block_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        found = given.mapInArrow(_pass(spark.sparkContext.broadcast(Suffixes(first, window)), False), types + _FOUND)
    else:
        digest = F.sha2(F.coalesce("_text", F.lit("")), 256)
        by_text = given.select(digest.alias("digest"), "_text")
        passes = None
        for block in (b for part in ([first, second], blocks) for b in part):
            shared = spark.sparkContext.broadcast(Suffixes(block, window))
            # equal texts find the same: one row of each stays, by partial aggregation
            one = by_text.mapInArrow(_pass(shared, True), "digest string, " + _FOUND).groupBy("digest").agg(*[F.first(c).alias(c) for c in ("spans", "items", "longest")])
            done = cut(one)
            shared.destroy()
            passes = done if passes is None else passes.unionByName(done)
        whole = cut(passes.groupBy("digest").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"), F.min("longest").alias("longest")))
        counted = given.select(*kept, "_text", digest.alias("digest")).mapInArrow(_count, types + "digest string, n_words long")
        found = counted.join(small(whole), "digest", "left").select(*kept, "n_words", F.coalesce("spans", F.array().cast("array<struct<a:long,b:long>>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), "longest")
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(acc["end"], x["a"]))).alias("n"), F.greatest(acc["end"], x["b"]).alias("end"))
    items = F.array_sort(F.array_distinct("items"))
    return found.select(
        *kept, "n_words", F.aggregate(F.array_sort("spans"), start, step, lambda acc: acc["n"]).alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"), F.coalesce(-F.col("longest.less"), F.lit(0)).alias("longest_match"), F.col("longest.item").alias("longest_item"), F.col("longest.item_at").alias("longest_item_at"), F.col("longest.at").alias("longest_at"),
    )


def _count(batches):
    """Of batches (other columns, text, digest): all but the text, with the number of words."""
    for batch in batches:
        k = batch.schema.get_field_index("_text")
        sizes = np.diff(scan_words(batch.column(k), alnum_lut())[1])
        others = [i for i in range(batch.num_columns) if i != k]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in others), pa.array(sizes, pa.int64())], names=[*(batch.schema.names[i] for i in others), "n_words"])


def mark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None) -> DataFrame:
    """docs with ADDED: n_words, n_hit, n_items, items_sha256, contaminated, and the longest verbatim match: its words
    (0 without one), item, and word numbers in the item and in the text.

    keep: the columns of docs to return (all by default); text must be among docs' columns.
    """
    keep = docs.columns if keep is None else keep
    return with_added(_marked(docs, benchmark, window, block_bytes, keep), keep, ADDED)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the contaminated ones."""
    kept = _marked(docs, benchmark, window, BLOCK_BYTES, docs.columns).where("NOT contaminated")
    return kept.select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(docs.columns)])


def oracle_sql() -> str:
    """The contract's columns of every document in DuckDB SQL, by comparing windows as texts."""
    words = r"COALESCE(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
    return f"""
        WITH d AS (SELECT doc_id, {words} AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item, {words} AS w FROM benchmark),
        g AS (SELECT item, j, m, array_to_string(w[j:j + m - 1], ' ') AS k FROM (SELECT item, w, least(len(w), {WINDOW}) AS m, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS j FROM b WHERE len(w) > 0)),
        p AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM g) WHERE len(w) >= m),
        h AS (SELECT p.doc_id, p.i, p.m, g.item, g.j FROM p JOIN g ON g.m = p.m AND g.k = array_to_string(p.w[p.i:p.i + p.m - 1], ' ')),
        u AS (SELECT doc_id, item, m, i, j, i - row_number() OVER (PARTITION BY doc_id, item, m, i - j ORDER BY i) AS run FROM h),
        v AS (SELECT doc_id, item, count(*) + m - 1 AS size, min(j) - 1 AS item_at, min(i) - 1 AS place FROM u GROUP BY doc_id, item, m, i - j, run),
        l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY size DESC, item, item_at, place) AS r FROM v) WHERE r = 1),
        n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS q FROM h) GROUP BY 1),
        t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items, sha256(COALESCE(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated,
            COALESCE(l.size, 0) AS longest_match, l.item AS longest_item, l.item_at AS longest_item_at, l.place AS longest_at
        FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN l ON l.doc_id = d.doc_id"""
