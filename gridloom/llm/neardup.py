"""Operator 8: near-duplicates by MinHash with tensored banding, verified on full shingle sets.

Two collections of g groups of t minhashes stand for a text: 2 * g * t minhashes make g * g table keys, one for each pair (a group of the first, a group of the second). The pairs
are formed inside buckets: texts are dealt by a group of the first collection, and within a bucket two
texts are candidates if any group of the second agrees as well and their minhashes agree often enough.

1. Each text becomes its distinct 5-word shingles' 64-bit hashes; texts with equal sets form a class,
   of which one member (the smallest doc_id) goes on.
2. Buckets give candidate links; only a spanning forest of a bucket's links leaves its task. In a bucket
   of more than BUCKET members the table keys themselves are formed, and the members of each hang on its
   smallest: rows times groups, whatever the bucket's size.
3. Families (components of candidate links) gather their members' full sets. An exact prefix-filter
   join in each family gives the true links' spanning forest, and components of those are the result.
4. A family of more than STAR members (or of very long texts) is dealt to blocks, and its hub, the member
   whose minhashes agree most with the family's, goes to each. Members that end in the hub's component are
   done; the others, few in a family of copies, then meet every block. So no task holds an unbounded
   group, copies of one text cost a row each, and no link between components is lost.

Links of a pair at the threshold itself are missed by the tables with a probability of about 0.001 at 85
percent and 0.0004 at 80 (which has more groups), closer pairs with less; a component is lost only if all
its paths are.

Defined cases: a null text, or one without words, has an empty set and links with nothing; a text of
one to four words is one shingle of the whole sequence; rows that repeat a doc_id are one node that has
the links of each; a row without a doc_id is the node of its text, comes after all that have one and has
no component_id of its own; doc_ids of another than an integer type are ordered as texts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..operators.graph import components as least_reachable
from .common import cut, from_order_key, mix64, order_key, partitions, scan_words, small, space_lut, tune

SHINGLE = 5


class Setting(NamedTuple):
    """Links have percent * union <= 100 * intersection. Each collection has so many groups of taken minhashes; candidates
    agree in least_agree of all minhashes (4.4 standard deviations below the mean at the threshold)."""

    percent: int
    groups: int
    taken: int
    least_agree: int

    @property
    def hashes(self) -> int:
        return 2 * self.groups * self.taken


AT_85 = Setting(85, 8, 3, 30)
AT_80 = Setting(80, 12, 3, 42)
#: Members of a bucket that are compared in one task, at most.
BUCKET = 1024
#: Members of a family's block, about; shingles of one; and members without the hub that meet a block in one task.
STAR, STAR_SHINGLES, APART = 256, 2_000_000, 1024
#: Minhashes by which a hub is chosen.
HUB_HASHES = 16

_rng = np.random.Generator(np.random.PCG64(8_675_309))
_MOST = 128
_A = _rng.integers(1, 1 << 63, _MOST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, _MOST, dtype=np.uint64)
_C = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, n: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, off = scan_words(texts, space_lut())
    spread = _C if n == SHINGLE else mix64(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    whole = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n if len(whole) else 0):
        whole += words[k : k + len(whole)] * spread[k]
    whole = mix64(whole)
    out = []
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(whole[a : b - n + 1]))
        elif b > a:
            out.append(mix64(np.array([(words[a:b] * spread[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(s: np.ndarray, hashes: int = AT_85.hashes) -> np.ndarray:
    """So many minhashes of 16 bits."""
    best = np.full(hashes, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 2048):
        x = s[at : at + 2048, None] * _A[:hashes] + _B[:hashes]
        x ^= x >> np.uint64(32)
        np.minimum(best, x.min(axis=0), out=best)
    return (mix64(best) >> np.uint64(48)).astype(np.uint16)


def _describe(hashes: int) -> Callable:
    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column(1))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                pa.array([signature(s, hashes).tobytes() if len(s) else None for s in sets], pa.binary()),
            ], names=["id", "n", "digest", "sig"])

    return run


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _groups_of_runs(batches, key_names: list[str], other: list[str]):
    """Yields (columns of one run of equal keys) from batches sorted by the keys; a run may cross batches."""
    held: list[list] = []
    last = None
    for batch in batches:
        cols = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in other]
        keys = list(zip(*[batch.column(batch.schema.get_field_index(n)).to_pylist() for n in key_names], strict=True))
        begin = 0
        for i in range(len(keys) + 1):
            if i == len(keys) or (i and keys[i] != keys[i - 1]) or (i == 0 and last is not None and keys[0] != last):
                if i > begin:
                    held.append([c[begin:i] for c in cols])
                if i < len(keys) and held:
                    yield [sum((h[k] for h in held), []) for k in range(len(other))]
                    held = []
                begin = i
        if keys:
            last = keys[-1]
    if held:
        yield [sum((h[k] for h in held), []) for k in range(len(other))]


def _edges_batch(edges: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b for _, b in edges], kind), pa.array([a for a, _ in edges], kind)], names=["node", "root"])


def bucket_edges(ids: list[int], sizes: list[int], sigs: list[bytes], how: Setting = AT_85) -> list[tuple[int, int]]:
    """A spanning forest of a bucket's candidate links, as (smaller root, node)."""
    order = sorted(range(len(ids)), key=lambda i: ids[i])
    ids, n = [ids[i] for i in order], np.array([sizes[i] for i in order])
    s = np.frombuffer(b"".join(sigs[i] for i in order), np.uint16).reshape(len(ids), how.hashes)
    second = s[:, how.hashes // 2 :].reshape(len(ids), how.groups, how.taken)
    forest = _Forest(len(ids))
    for i in range(1, len(ids)):
        apart = np.minimum(n[:i], n[i]) * 100 >= how.percent * np.maximum(n[:i], n[i])
        near = np.flatnonzero(apart & ((s[:i] == s[i]).sum(1) >= how.least_agree))
        if len(near):
            for j in near[(second[near] == second[i]).all(2).any(1)].tolist():
                forest.join(i, j)
    return [(ids[r], ids[i]) for i in range(len(ids)) if (r := forest.root(i)) != i]


def _bucket_pass(how: Setting, kind: pa.DataType) -> Callable:
    def run(batches):
        out: list[tuple[int, int]] = []
        for ids, sizes, sigs in _groups_of_runs(batches, ["part", "band"], ["id", "n", "sig"]):
            out += bucket_edges(ids, sizes, sigs, how)
            if len(out) > 50_000:
                yield _edges_batch(out, kind)
                out = []
        yield _edges_batch(out, kind)

    return run


def family_edges(ids: list[int], sets: list[np.ndarray], percent: int = AT_85.percent) -> list[tuple[int, int]]:
    """A spanning forest of the true links, exactly: texts by growing size, each looked up by its rarest shingles."""
    order = sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i]))
    values, counts = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    seen: dict[int, list[int]] = {}
    forest = _Forest(len(ids))
    rank = {i: k for k, i in enumerate(sorted(range(len(ids)), key=lambda i: ids[i]))}
    links: dict[int, int] = {}
    for i in order:
        own = sets[i]
        if not len(own):
            continue
        n = len(own)
        rare = own[np.argsort(counts[np.searchsorted(values, own)], kind="stable")]
        # of two linked sets, each holds at least ceil(percent * n / 100) of the other's: one of the first n - that + 1 is shared
        head = rare[: n - -(-percent * n // 100) + 1].tolist()
        near: dict[int, None] = {}
        for x in head:
            for j in seen.get(x, ()):
                near[j] = None
        for j in near:
            m = len(sets[j])
            if m * 100 < percent * n or forest.root(rank[i]) == forest.root(rank[j]):
                continue
            both = len(np.intersect1d(own, sets[j], assume_unique=True))
            if 100 * both >= percent * (n + m - both):
                forest.join(rank[i], rank[j])
        for x in head:
            seen.setdefault(x, []).append(i)
    by_rank = {k: i for i, k in rank.items()}
    links = {i: by_rank[forest.root(k)] for i, k in rank.items()}
    return [(ids[r], ids[i]) for i, r in links.items() if ids[r] != ids[i]]


def _family_pass(how: Setting, kind: pa.DataType) -> Callable:
    def with_sets(batches):
        for batch in batches:
            sets = shingle_sets(batch.column(batch.schema.get_field_index("text")))
            arrays = [batch.column(batch.schema.get_field_index(n)) for n in ("family", "x", "y", "id", "hub")]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([s.tobytes() for s in sets], pa.binary())], names=["family", "x", "y", "id", "hub", "set"])

    def run(batches):
        out: list[tuple] = []
        for ids, hubs, sets in _groups_of_runs(with_sets(batches), ["family", "x", "y"], ["id", "hub", "set"]):
            links = family_edges(ids, [np.frombuffer(s, np.uint64) for s in sets], how.percent)
            out += links
            if hubs[0] is not None:
                root = {n: r for r, n in links}
                out += [(None, i) for i in dict.fromkeys(ids) if root.get(i, i) != root.get(hubs[0], hubs[0])]
            if len(out) > 50_000:
                yield _edges_batch(out, kind)
                out = []
        yield _edges_batch(out, kind)

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root) links to (node, comp), comp the smallest node reachable; only nodes that aren't it."""
    return least_reachable(edges.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("root", "comp")


def _bucket_links(classes: DataFrame, how: Setting, kind: pa.DataType, edge: str) -> DataFrame:
    """Candidate links (node, root) of classes (id, n, sig)."""
    group = lambda i: F.substring("sig", 2 * how.taken * i + 1, 2 * how.taken)
    groups = lambda first: F.posexplode(F.array(*[group(first + i) for i in range(how.groups)]))
    dealt = classes.select("id", "n", "sig", groups(0).alias("part", "band"))
    hot = cut(dealt.groupBy("part", "band").count().where(F.col("count") > BUCKET).select("part", "band"))
    parts, crowded = partitions(classes.sparkSession), not hot.isEmpty()
    usual = dealt.join(small(hot), ["part", "band"], "left_anti") if crowded else dealt
    links = usual.repartition(parts, "part", "band").sortWithinPartitions("part", "band").mapInArrow(_bucket_pass(how, kind), edge)
    if not crowded:
        return links
    key = ["part", "band", "part2", "band2"]
    tables = dealt.join(small(hot), ["part", "band"]).select("part", "band", "id", groups(how.groups).alias("part2", "band2"))
    least = cut(tables.groupBy(*key).agg(F.min("id").alias("root"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"))
    return links.unionAll(tables.join(small(least), key).where("id <> root").select(F.col("id").alias("node"), "root"))


def _hubs(members: DataFrame, classes: DataFrame, how: Setting) -> DataFrame:
    """(family, hub) of members (id, family): the member with most of its family's most frequent minhashes (of the first HUB_HASHES), then the smallest."""
    hashes = [F.substring("sig", 2 * i + 1, 2).alias(f"v{i}") for i in range(HUB_HASHES)]
    each = members.select("id", "family").join(classes.groupBy("id").agg(F.min("sig").alias("sig")), "id").select("id", "family", *hashes)
    # a minhash has 16 bits, so the counts of a group are bounded whatever its size
    modes = cut(each.groupBy("family").agg(*[F.mode(f"v{i}", True).alias(f"m{i}") for i in range(HUB_HASHES)]))
    agree = sum((F.col(f"v{i}") == F.col(f"m{i}")).cast("int") for i in range(HUB_HASHES))
    return each.join(small(modes), "family").groupBy("family").agg(F.min_by("id", F.struct(-agree, "id")).alias("hub"))


def _verified(texts: DataFrame, placed: DataFrame, how: Setting, kind: pa.DataType, edge: str) -> DataFrame:
    """The true links' forest (node, root) of each (family, x, y) of placed (id, family, x, y, hub); where there is a hub, also
    a row without a root for each member that isn't in its component there."""
    rows = texts.join(small(placed), "id").repartition(partitions(texts.sparkSession), "family", "x", "y").sortWithinPartitions("family", "x", "y", "id")
    return rows.select("family", "x", "y", "id", "hub", "text").mapInArrow(_family_pass(how, kind), edge)


def _large_links(texts: DataFrame, members: DataFrame, classes: DataFrame, how: Setting, kind: pa.DataType, edge: str) -> DataFrame:
    """The true links of large families; members (id, family, blocks)."""
    hubs = cut(_hubs(members, classes, how))
    own = cut(members.withColumn("y", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).join(small(hubs), "family"))
    in_own = own.where("id <> hub").select("id", "family", F.lit(0).alias("x"), "y", "hub")
    in_all = own.where("id = hub").select("id", "family", F.lit(0).alias("x"), F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).alias("y"), "hub")
    first = cut(_verified(texts, cut(in_own.unionByName(in_all)), how, kind, edge))
    apart = cut(own.join(small(cut(first.where("root IS NULL").select(F.col("node").alias("id")))), "id", "left_semi").select("id", "family", "blocks"))
    links = first.where("root IS NOT NULL")
    if apart.isEmpty():
        return links
    rests = small(cut(apart.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / APART).cast("int").alias("rests"))))
    to_all = lambda n: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))
    rest = apart.join(rests, "family").withColumn("x", F.pmod(F.xxhash64("id", F.lit("rest")), F.col("rests")).cast("int")).select("id", "family", "x", to_all("blocks").alias("y"))
    others = own.join(rests, "family").select("id", "family", to_all("rests").alias("x"), "y")
    both = cut(rest.unionByName(others).distinct().withColumn("hub", F.lit(None).cast(members.schema["id"].dataType)))
    return links.unionAll(_verified(texts, both, how, kind, edge))


def _node(docs: DataFrame, as_long: bool) -> Column:
    """The node that a row is: its doc_id (as a text in the same order, unless all are integers), or without one its text, behind all that have one."""
    if as_long:
        return F.col("doc_id").cast("long")
    named = F.concat(F.lit("1"), order_key("doc_id", docs.schema["doc_id"].dataType))
    return F.coalesce(named, F.concat(F.lit("2"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))


def _labelled(docs: DataFrame, how: Setting) -> tuple[DataFrame, bool]:
    """(id, n, comp) of every row, by nodes, and whether these are numbers."""
    spark = docs.sparkSession
    tune(spark)
    as_long = isinstance(docs.schema["doc_id"].dataType, IntegralType) and docs.where("doc_id IS NULL").isEmpty()
    kind, id_type = (pa.int64(), "long") if as_long else (pa.string(), "string")
    edge = f"node {id_type}, root {id_type}"
    ided = docs.select(_node(docs, as_long).alias("id"), "text")
    base = cut(ided.mapInArrow(_describe(how.hashes), f"id {id_type}, n long, digest binary, sig binary"))
    classes = cut(base.where("n > 0").groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig")))
    families = components(_bucket_links(classes, how, kind, edge))

    members = families.select(F.col("node").alias("id"), F.col("comp").alias("family")).unionAll(families.select(F.col("comp").alias("id"), F.col("comp").alias("family")).distinct())
    members = cut(members.join(classes.groupBy("id").agg(F.sum("n").alias("n")), "id"))
    sizes = members.groupBy("family").agg(F.greatest(F.ceil(F.count(F.lit(1)) / STAR), F.least(F.count(F.lit(1)), F.ceil(F.sum("n") / STAR_SHINGLES))).alias("blocks"))
    large = small(cut(sizes.where("blocks > 1")))
    usual = members.join(large, "family", "left_anti").select("id", "family", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(None).cast(id_type).alias("hub"))
    links = _verified(ided, cut(usual), how, kind, edge)
    split = cut(members.join(large, "family").select("id", "family", "blocks"))
    if not split.isEmpty():
        links = links.unionAll(_large_links(ided, split, classes, how, kind, edge))
    copies = classes.join(base.where("n > 0").select("digest", F.col("id").alias("other")), "digest").where("id <> other").select(F.col("other").alias("node"), F.col("id").alias("root")).distinct()
    comps = cut(components(links.unionAll(copies)))
    found = base.select("id", "n").join(small(comps), F.col("id") == F.col("node"), "left").select("id", "n", F.coalesce("comp", "id").alias("comp"))
    return found, as_long


def near_duplicates(docs: DataFrame, how: Setting = AT_85) -> DataFrame:
    """docs (doc_id, text) to (doc_id, n_shingles, component_id, kept)."""
    found, as_long = _labelled(docs, how)
    given = docs.schema["doc_id"].dataType
    real = lambda c: F.col(c).cast(given) if as_long else F.when(F.col(c).startswith("1"), from_order_key(F.expr(f"substring({c}, 2)"), given))
    return found.select(real("id").alias("doc_id"), F.col("n").alias("n_shingles"), real("comp").alias("component_id"), (F.col("id") == F.col("comp")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, how: Setting = AT_80) -> DataFrame:
    """docs with one row of each component: the first row of its smallest node."""
    found, as_long = _labelled(docs, how)
    names = [f"in_{i}" for i in range(len(docs.columns))]
    given = docs.select(*[docs[c].alias(n) for c, n in zip(docs.columns, names, strict=True)], _node(docs, as_long).alias("node"))
    gone = cut(found.where("id <> comp").select(F.col("id").alias("node")).distinct())
    left = given.join(small(gone), "node", "left_anti")
    repeated = cut(left.groupBy("node").count().where("count > 1").select("node"))
    if not repeated.isEmpty():
        text = F.coalesce(F.col(names[docs.columns.index("text")]), F.lit(""))
        several = left.join(small(repeated), "node", "left_semi")
        one = several.groupBy("node").agg(F.min_by(F.struct(*names), F.struct(text, F.xxhash64(*names))).alias("row")).select("node", "row.*")
        left = left.join(small(repeated), "node", "left_anti").unionByName(one)
    return left.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])


def oracle_sql() -> str:
    """The result in DuckDB SQL, by joining all shingles; for small tables."""
    words = r"COALESCE(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), [])"
    return f"""
        WITH RECURSIVE d AS (SELECT doc_id, {words} AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM s a JOIN s b ON b.k = a.k AND b.doc_id <> a.doc_id GROUP BY 1, 2),
        e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_ >= 85 * (x.n + y.n - both_)),
        r AS (SELECT doc_id AS a, doc_id AS root FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.a),
        m AS (SELECT a AS doc_id, min(root) AS component_id FROM r GROUP BY 1)
        SELECT d.doc_id, COALESCE(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept FROM d JOIN m ON m.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""
