"""Operator 6: shard by a permutation-filled lookup table. DataFrame functions only.

Each shard orders the slots of a prime-sized table by its own permutation (offset + j * skip) mod size;
the shards take turns, each claiming its next free slot, until the table is full. Placement is then
one array access: slot = hash(key) mod size. The table depends on the shard names alone; when a shard
goes, only few other keys move.

Defined cases: a null key is placed by the text's hash instead, and by the empty string if that is null
too; rows that repeat share a shard; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A prime, far above the number of shards, so that shards hold near-equal shares of the slots.
TABLE_SIZE = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _number(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:12], 16)


def lookup_table(shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE) -> list[int]:
    """The shard number of each slot. The work is the table's size, whatever the data's."""
    if not 0 < len(shards) <= size:
        raise ValueError("there must be between one shard and one for each slot")
    offset = [_number(s, "offset") % size for s in shards]
    skip = [_number(s, "skip") % (size - 1) + 1 for s in shards]
    at, owner, left = list(offset), [-1] * size, size
    while left:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % size
            owner[at[i]] = i
            left -= 1
            if not left:
                break
    return owner


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("long"), F.lit(size))


def shard_of(slot: Column, table: list[int]) -> Column:
    """Constant time: Spark folds the split text into one array that each task receives once."""
    return F.element_at(F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>"), (slot + 1).cast("int"))


def shard(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """docs with the added columns slot and shard (they replace columns of these names)."""
    name = F.coalesce(F.col(key).cast("string"), F.md5(F.col(text).cast("binary")) if text in docs.columns else F.lit(""), F.lit(""))
    given = [c for c in docs.columns if c not in ("slot", "shard")]
    placed = docs.select(*given, slot_of(name, size).alias("slot"))
    return placed.select(*given, "slot", shard_of(F.col("slot"), lookup_table(shards, size)).alias("shard"))


def oracle_sql() -> str:
    table = ",".join(map(str, lookup_table()))
    return f"""
        WITH t AS (SELECT string_split('{table}', ',') AS owners),
             d AS (SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), md5(text), '')), 1, 12))::BIGINT % {TABLE_SIZE} AS slot FROM documents)
        SELECT doc_id, slot, CAST(owners[slot + 1] AS INTEGER) AS shard FROM d, t"""
