"""Operator 12: near-duplicate embeddings by random-hyperplane sign hashing, verified by exact cosines.

The signs of a vector's products with random hyperplanes are cut into table keys; two vectors of one label
are candidates if they share a key in any table and their signs agree often enough in all.

1. Each vector gets its signs and a digest; equal vectors of a label form a class of one node, with a count.
2. Classes are dealt to the buckets of all tables by their signs alone. A bucket's task keeps the members
   that have a candidate whose first common table is this one, so that a pair counts once, however many
   tables it shares; no pair leaves its task.
3. Kept members meet again with their vectors. Cosines in double precision decide; a task gives each
   member's number of links, weighted by the classes' counts, and a spanning forest of them.
4. Components of the forests are the result's; rows get theirs by their class, after the components.

A bucket of more than BUCKET classes is dealt to blocks, and each pair of blocks is a task of its own: no task
holds an unbounded group. Numbers of links need all pairs of a bucket of different vectors, so its work
grows with the square of their number; rows cost one node for each different vector only.

With 16 tables of 16 signs a pair at a cosine of 0.98 is missed with a probability of 0.001, closer pairs with
less. Labels of more than some hundred million vectors want more signs a table, and more tables for the same
recall: 32 signs and 54 tables miss 0.001.

Defined cases: a vector that is null, empty, zero, or holds null or non-finite components links with nothing, nor does
one without a label, nor do vectors of different lengths; each row is a vector of its own, also where vec_ids
repeat; a row without a vec_id counts as a link of others, lends its component no id, and is kept only if it
links with nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegralType

from ..operators.graph import components
from .common import cut, partitions, small, tune

#: Classes of a bucket that are compared in one task, at most, and of a block of a larger one.
BUCKET, BLOCK = 1024, 512
#: Rows of a bucket that are compared with its others at once.
ROWS = 256


class Tables(NamedTuple):
    """So many tables of so many signs (32 at most), and the cosine that links."""

    least: float = 0.98
    tables: int = 16
    signs: int = 16

    @property
    def key(self) -> type:
        return np.uint16 if self.signs <= 16 else np.uint32

    @property
    def most_apart(self) -> int:
        """Signs in which a linked pair differs, at most: five standard deviations above the mean at the threshold."""
        share, n = math.acos(self.least) / math.pi, self.tables * self.signs
        return math.ceil(n * share + 5 * math.sqrt(n * share * (1 - share)))


def hyperplanes(dims: int, how: Tables) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([1_103, dims])).standard_normal((dims, how.tables * how.signs))


def signs(unit: np.ndarray, planes: np.ndarray, how: Tables) -> np.ndarray:
    """The table keys (rows, tables) of unit vectors."""
    up = (unit @ planes > 0).reshape(len(unit), how.tables, how.signs)
    return (up * (np.uint32(1) << np.arange(how.signs, dtype=np.uint32))).sum(2, dtype=np.uint32).astype(how.key)


def unit_vectors(values: np.ndarray) -> np.ndarray:
    scaled = values / np.abs(values).max(1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _describe(how: Tables, stored: type) -> Callable:
    """(vec_id, label, vector) to (vec_id, label, key, keys, vec): the class, the table keys and the components, null where a vector can't link."""

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            n = batch.num_rows
            labels, vectors = batch.column(1).to_pylist(), batch.column(2)
            inner = vectors.flatten().cast(pa.float64())
            flat = inner.fill_null(np.nan).to_numpy(zero_copy_only=False)
            lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(lengths)
            key, keys, vec = [None] * n, [None] * n, [None] * n
            for dims in np.unique(lengths[lengths > 0]).tolist():
                rows = np.flatnonzero(lengths == dims)
                values = flat[(ends[rows] - dims)[:, None] + np.arange(dims)] + 0.0  # -0 is 0
                fine = np.isfinite(values).all(1) & (values != 0).any(1) & np.array([labels[i] is not None for i in rows])
                rows, values = rows[fine], values[fine]
                if not len(rows):
                    continue
                if dims not in planes:
                    planes[dims] = hyperplanes(dims, how)
                found = signs(unit_vectors(values), planes[dims], how)
                for k, i in enumerate(rows.tolist()):
                    vec[i], keys[i] = values[k].astype(stored).tobytes(), found[k].tobytes()
                    key[i] = hashlib.blake2b(f"{dims} {labels[i]}\0".encode() + vec[i], digest_size=16).digest()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.binary()) for c in (key, keys, vec))], names=["vec_id", "label", "key", "keys", "vec"])

    return run


def _pairs(keys: np.ndarray, side: np.ndarray | None, table: int, near: Callable):
    """(i, j) arrays of near pairs in both directions whose first common table is this one and, with sides, that lie on different ones."""
    for a in range(0, len(keys), ROWS):
        hit = near(a, a + ROWS)
        i, j = np.nonzero(hit)
        i += a
        fits = i != j
        if side is not None:
            fits &= side[i] != side[j]
        i, j = i[fits], j[fits]
        first = np.concatenate([(keys[i[p : p + 65536]] == keys[j[p : p + 65536]]).argmax(1) for p in range(0, len(i), 65536)] or [i])
        yield i[first == table], j[first == table]


def candidates(keys: np.ndarray, side: np.ndarray | None, table: int, how: Tables) -> np.ndarray:
    """Marks the bucket's members that have a candidate here."""
    found = np.zeros(len(keys), bool)

    def near(a, b):
        apart = np.zeros((len(keys[a:b]), len(keys)), np.uint16)
        for t in range(how.tables):
            apart += np.bitwise_count(keys[a:b, None, t] ^ keys[None, :, t])
        return apart <= how.most_apart

    for i, j in _pairs(keys, side, table, near):
        found[i] = found[j] = True
    return found


def links(unit: np.ndarray, keys: np.ndarray, counts: np.ndarray, side: np.ndarray | None, table: int, how: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Each member's links here, weighted by counts, and its root in a forest of them."""
    degree, root = np.zeros(len(keys), np.int64), np.arange(len(keys))
    for i, j in _pairs(keys, side, table, lambda a, b: unit[a:b] @ unit.T >= how.least):
        np.add.at(degree, i, counts[j])
        cuts = np.flatnonzero(np.diff(i, prepend=-1))
        for x, own in zip(i[cuts].tolist(), np.split(j, cuts[1:]) if len(cuts) else [], strict=True):
            met = np.unique(np.append(root[own], root[x]))
            if len(met) > 1:
                root[np.isin(root, met[1:])] = met[0]
    return degree, root


def _runs(batches, keys: list[str]):
    """Tables of the rows of equal keys, two at least, from batches sorted by the keys; a run may cross batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            c = batch.column(k)
            new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            new[0] |= not held or held[-1].column(k)[-1] != c[0]
        starts = np.append(np.flatnonzero(new), batch.num_rows)
        if held and (whole := pa.Table.from_batches([*held, batch.slice(0, starts[0])])).num_rows > 1 and len(starts) > 1:
            yield whole.combine_chunks()
        if len(starts) == 1:  # all of it goes on with what is held
            held.append(batch)
            continue
        for i in np.flatnonzero(np.diff(starts[:-1]) > 1):
            yield pa.Table.from_batches([batch.slice(starts[i], starts[i + 1] - starts[i])])
        held = [batch.slice(starts[-2])]
    if held and (whole := pa.Table.from_batches(held)).num_rows > 1:
        yield whole.combine_chunks()


_PLACE = ["label", "tab", "band", "x", "y"]


def _matrix(column, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def _of(run: pa.Table, how: Tables):
    """A run's table keys, sides (if it is of two blocks) and table; vectors of different lengths are runs of their own by their band's prefix."""
    side = run["side"].to_numpy() if run["x"][0].as_py() != run["y"][0].as_py() else None
    return _matrix(run["keys"], how.key), side, run["tab"][0].as_py()


def _candidate_pass(how: Tables) -> Callable:
    def run(batches):
        for rows in _runs(batches, _PLACE):
            found = candidates(*_of(rows, how), how)
            if found.any():
                yield from rows.filter(pa.array(found)).to_batches()

    return run


def _link_pass(how: Tables, stored: type) -> Callable:
    def run(batches):
        for rows in _runs(batches, _PLACE):
            keys, side, table = _of(rows, how)
            degree, root = links(unit_vectors(_matrix(rows["vec"], stored).astype(np.float64)), keys, rows["n"].to_numpy(), side, table, how)
            linked = np.flatnonzero(degree)
            if len(linked):
                own = rows["key"].chunk(0)
                yield pa.RecordBatch.from_arrays([own.take(pa.array(linked)), pa.array(degree[linked]), own.take(pa.array(root[linked]))], names=["key", "links", "root"])

    return run


def _placed(classes: DataFrame, how: Tables) -> DataFrame:
    """Classes at their places: the bucket of each table, and blocks x, y of large ones with the side that a class is of."""
    width = np.dtype(how.key).itemsize
    band = lambda t: F.concat(F.hex(F.octet_length("vec").cast("long")), F.lit("."), F.hex(F.substring("keys", width * t + 1, width)))
    dealt = classes.select("label", "key", "keys", F.posexplode(F.array(*[band(t) for t in range(how.tables)])).alias("tab", "band"))
    bucket = ["label", "tab", "band"]
    hot = cut(dealt.groupBy(*bucket).count().where(F.col("count") > BUCKET).select(*bucket, F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    if hot.isEmpty():
        return dealt.select(*_PLACE[:3], F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("side"), "key", "keys")
    all_ = dealt.join(small(hot), bucket, "left").withColumn("side", F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")))
    met = all_.withColumn("z", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    return met.select(*bucket, F.least("side", "z").alias("x"), F.greatest("side", "z").alias("y"), "side", "key", "keys")


def near_duplicates(vectors: DataFrame, how: Tables = Tables()) -> DataFrame:  # noqa: B008
    """vectors (vec_id, embedding, label) to (vec_id, n_links, component_id, kept)."""
    spark = vectors.sparkSession
    tune(spark)
    parts, ident = partitions(spark), vectors.schema["vec_id"].dataType
    stored = np.float32 if vectors.schema["embedding"].dataType == ArrayType(FloatType()) else np.float64
    if isinstance(ident, IntegralType):
        vectors, id_type = vectors.withColumn("vec_id", F.col("vec_id").cast("long")), "long"
    else:
        vectors, id_type = vectors.withColumn("vec_id", F.col("vec_id").cast("string")), "string"
    given = vectors.select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    base = cut(given.mapInArrow(_describe(how, stored), f"vec_id {id_type}, label string, key binary, keys binary, vec binary"))
    classes = cut(base.where("key IS NOT NULL").groupBy("label", "key").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"), F.first("keys").alias("keys"), F.first("vec").alias("vec")))

    by_place = lambda df: df.repartition(parts, *_PLACE).sortWithinPartitions(*_PLACE)
    placed = _placed(classes, how)
    active = cut(by_place(placed).mapInArrow(_candidate_pass(how), placed.schema))
    met = by_place(active.join(classes.select("key", "n", "vec"), "key").select(*active.columns, "n", "vec"))
    found = cut(met.mapInArrow(_link_pass(how, stored), "key binary, links long, root binary"))

    own = classes.where("n > 1").select("key", (F.col("n") - 1).alias("links")).unionByName(found.select("key", "links"))
    degrees = own.groupBy("key").agg(F.sum("links").alias("links"))
    comps = components(found.select(F.col("key").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("key"), "root")
    of_class = cut(degrees.join(comps, "key", "left").join(classes.select("key", "least"), "key").select("key", "links", F.coalesce("root", "key").alias("root"), "least"))
    least = of_class.groupBy("root").agg(F.min("least").alias("component"))
    info = cut(of_class.join(least, "root").select("key", "links", "component"))
    out = base.select("vec_id", "key").join(small(info), "key", "left")
    linked = F.col("links").isNotNull()
    return out.select(
        F.col("vec_id").cast(ident), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.when(linked, F.col("component")).otherwise(F.col("vec_id")).cast(ident).alias("component_id"),
        F.when(linked, F.coalesce(F.col("vec_id") == F.col("component"), F.lit(False))).otherwise(F.lit(True)).alias("kept"),
    )


def oracle_sql() -> str:
    """The result in DuckDB SQL, by all pairs of a label; for small tables."""
    return """
        WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        f AS MATERIALIZED (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM f a JOIN f b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) END >= 0.98),
        r AS (SELECT vec_id AS a, vec_id AS root FROM v UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.a),
        m AS (SELECT a AS vec_id, min(root) AS component_id FROM r GROUP BY 1),
        n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1)
        SELECT v.vec_id, COALESCE(n.n, 0) AS n_links, m.component_id, v.vec_id = m.component_id AS kept
        FROM v JOIN m ON m.vec_id = v.vec_id LEFT JOIN n ON n.vec_id = v.vec_id"""
