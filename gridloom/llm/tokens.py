"""Operator 1: token counts by a map-side two-tier lookup.

Tier one is a broadcast table of the corpus's frequent pre-tokens and their lengths in tokens; tier two,
for the others, is the library's encoder behind a bounded cache in each worker. No pre-token is shuffled:
only each task's short list of its most frequent ones is.

A pre-token is a run of spaces with what follows it, or a line feed with what follows. The model has no
piece with a space after another character, nor one with a line feed (both are checked), so no merge
crosses the start of a pre-token and the counts add up to the library's count of the whole text.

Defined cases: a null text counts as empty and has 0 tokens; a text without spaces is one pre-token,
whatever its length, and is not cached; an empty table gives no rows; rows that repeat are counted each.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, most_counted, tune

MODEL = "piece_bpe_32k.model"
#: Entries of the broadcast table; distinct pre-tokens a task counts before it drops the rarest; those it reports.
TABLE_ENTRIES = 32_768
TASK_COUNTED, TASK_REPORTED = 200_000, 8192
#: Entries of a worker's cache, and the longest pre-token (in characters) that it keeps.
CACHE_ENTRIES, CACHE_CHARS = 300_000, 64
OVER = 4096
UNIT = re.compile(r"(?: +|\n)[^ \n]*")


def model_bytes(path: str | None = None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=2)
def processor(model: bytes):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    if any(re.search("[^▁]▁|\n", p) for p in pieces) or sp.encode("a  b\n") == sp.encode("a b"):
        raise ValueError("pieces of this model cross spaces or lines, or it strips spaces; whole texts would have to be encoded")
    return sp


def pre_tokens(text: str) -> list[str]:
    """The text's pre-tokens; the model's own space mark reads as a space, and the text begins with one that the model adds."""
    return UNIT.findall(" " + text.replace("▁", " ")) if text else []


def unit_lengths(model: bytes, units: list[str]) -> list[int]:
    """Tokens of each pre-token where it stands: without the space that the model adds in front."""
    sp = processor(model)
    # a space in front is the one that the model adds; before a line feed that space is a piece of its own
    encoded = sp.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1) if units else []
    return [1 if u == " " else len(ids) - (u[0] == "\n") for u, ids in zip(units, encoded, strict=True)]


def frequent_units(docs: DataFrame, entries: int = TABLE_ENTRIES) -> list[str]:
    """The most frequent pre-tokens by the tasks' bounded counts over all texts. It decides speed only, never a count."""

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(pre_tokens(text))
                    if len(seen) > TASK_COUNTED:
                        seen = Counter(dict(seen.most_common(TASK_COUNTED // 2)))
        top = [(u, n) for u, n in seen.most_common(TASK_REPORTED) if n > 1 and len(u) <= CACHE_CHARS]
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["unit", "n"])

    found = cut(docs.select("text").mapInArrow(count, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n")))
    return [r["unit"] for r in most_counted(found, "n", entries).select("unit").collect()]


def count_tokens(docs: DataFrame, model_path: str | None = None, over: int = OVER, entries: int = TABLE_ENTRIES) -> DataFrame:
    """docs (doc_id, text) to (doc_id, n_bytes, n_tokens, over_limit)."""
    spark = docs.sparkSession
    tune(spark)
    model = model_bytes(model_path)
    units = frequent_units(docs, entries)
    shared = spark.sparkContext.broadcast((model, dict(zip(units, unit_lengths(model, units), strict=True))))

    def encode(batches):
        model, table = shared.value
        cache: dict[str, int] = {}
        known = dict(table)  # tier one; misses are added to it up to a bound, which is the worker's cache
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts = []
            for text in texts:
                found = pre_tokens(text)
                try:
                    counts.append(sum(map(known.__getitem__, found)))
                    continue
                except KeyError:
                    pass
                missed = [u for u in dict.fromkeys(found) if u not in known]
                here = dict(zip(missed, unit_lengths(model, missed), strict=True))
                counts.append(sum(known[u] if u in known else here[u] for u in found))
                cache.update((u, n) for u, n in here.items() if len(u) <= CACHE_CHARS)
                if len(cache) > CACHE_ENTRIES:
                    cache.clear()
                    known = dict(table)
                else:
                    known.update((u, n) for u, n in here.items() if len(u) <= CACHE_CHARS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([n > over for n in counts], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
