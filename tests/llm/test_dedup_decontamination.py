import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import decontaminate, neardup

from .conftest import DOCS, odd_rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows, percent=85):
    """(doc_id, text) to {doc_id: smallest reachable}, by comparing all pairs of distinct sets."""
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = {}
    for i, t in rows:
        s = frozenset(shingles(t))
        if s:
            sets.setdefault(s, []).append(i)
    for ids in sets.values():
        for i in ids:
            a, b = sorted((root(ids[0]), root(i)))
            up[b] = a
    keys = list(sets)
    for k, a in enumerate(keys):
        for b in keys[:k]:
            if min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(sets[a][0]), root(sets[b][0])))
                up[y] = x
    return {i: root(i) for i, _ in rows}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def check(spark, rows, **frame):
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], DOCS).repartition(3)
    got = neardup.near_duplicates(docs).collect()
    want = components(rows)
    assert len(got) == len(rows)
    for r in got:
        assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    assert sorted((r["doc_id"], r["n_shingles"]) for r in got) == sorted((i, len(shingles(t))) for i, t in rows)


def test_documents_against_all_pairs(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows)


def planted(seed, groups=12, size=14):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([8, 40, 120, 400]))]
        rows += [(len(rows) + k, edited(rng, base, rng.choice([0, 0, 1, 1, 2, 3, 4]))) for k in range(size)]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    return [(i * 3 + 1, t) for i, (_, t) in zip(ids, rows)]


def test_planted_copies_and_chains(spark):
    check(spark, planted(5))


def test_looser_setting_keeps_one_of_each_group(spark):
    rows = planted(11)
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], DOCS)
    want = set(components(rows, 80).values())
    assert {r["doc_id"] for r in neardup.drop_near_duplicates(docs).collect()} == want
    assert {r["doc_id"] for r in neardup.drop_near_duplicates(docs, neardup.AT_85).collect()} == set(components(rows).values())


@pytest.mark.parametrize("bucket, star, apart", [(1, 1 << 20, 9), (1 << 20, 4, 2), (3, 7, 1000)])
def test_large_groups_are_split(spark, monkeypatch, bucket, star, apart):
    """With limits of a few members every group is split, and nothing is lost."""
    monkeypatch.setattr(neardup, "BUCKET", bucket)
    monkeypatch.setattr(neardup, "STAR", star)
    monkeypatch.setattr(neardup, "APART", apart)
    rows = planted(6, groups=5, size=30)
    # a chain whose ends share little: no hub links with all
    words = [f"c{i}" for i in range(400)]
    rows += [(10_000 + k, " ".join(words[3 * k : 3 * k + 60])) for k in range(40)]
    check(spark, rows)


def test_ids_as_text_and_rows_without(spark):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(900)}" for _ in range(60)) for _ in range(12)]
    rows = [(f"d{k:02}é", t) for k, t in enumerate(texts)] + [("a0", texts[3]), (None, texts[3]), (None, texts[5] + " more"), (None, "no other text is like this one, of a row without an id"), (None, None)]
    docs = spark.createDataFrame(rows * 2, "doc_id string, text string")
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs).collect()}
    want = {(f"d{k:02}é", "a0" if k == 3 else f"d{k:02}é", k != 3) for k in range(12)}
    assert got == want | {("a0", "a0", True), (None, "a0", False), (None, "d05é", False), (None, None, True)}
    kept = sorted(((r["doc_id"] or "", r["text"] or "") for r in neardup.drop_near_duplicates(docs).collect()))
    assert kept == sorted([("a0", texts[3]), ("", rows[-2][1]), ("", "")] + [(f"d{k:02}é", t) for k, t in enumerate(texts) if k != 3])
    numbers = spark.createDataFrame([(-5, texts[0]), (3, texts[0]), (-(1 << 63), texts[1]), ((1 << 63) - 1, texts[1]), (None, texts[0])], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(numbers).collect()} == {(-5, -5), (3, -5), (-(1 << 63), -(1 << 63)), ((1 << 63) - 1, -(1 << 63)), (None, -5)}


def test_boundary_is_inclusive(spark):
    # 17 shared of 20: 85 percent exactly; and 16 of 19 below it
    a = [f"s{i}" for i in range(24)]  # 20 shingles... a prefix of 21 words has 17
    rows = [(1, " ".join(a)), (2, " ".join(a[:21])), (3, " ".join(f"t{i}" for i in range(23))), (4, " ".join(f"t{i}" for i in range(20)))]
    assert 100 * 17 >= 85 * 20 and 100 * 16 < 85 * 19
    check(spark, rows)


def test_family_join_is_exact():
    rng = random.Random(3)
    for _ in range(10):
        base = [rng.randrange(10**6) for _ in range(rng.choice([10, 60]))]
        sets = [np.unique(np.array([x if rng.random() > 0.04 else rng.randrange(10**6) for x in base], np.uint64)) for _ in range(40)]
        ids = rng.sample(range(1000), 40)
        forest = neardup._Forest(40)
        order = sorted(range(40), key=lambda i: ids[i])
        place = {ids[i]: k for k, i in enumerate(order)}
        for a in range(40):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                    forest.join(place[ids[a]], place[ids[b]])
        want = {frozenset(i for i in ids if forest.root(place[i]) == r) for r in {forest.root(k) for k in range(40)}}
        links = dict((n, r) for r, n in neardup.family_edges(ids, sets))
        got = {}
        for i in ids:
            got.setdefault(links.get(i, i), set()).add(i)
        assert want == set(map(frozenset, got.values()))


def test_components_of_chains_and_stars(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + k) for k in range(1, 30)] + [(200 + k, 230) for k in range(30)] + [(5, 5), (300, 301), (301, 300)]
    rng.shuffle(edges)
    got = dict(map(tuple, neardup.components(spark.createDataFrame(edges, "node long, root long")).collect()))
    assert got == {**{i: 0 for i in range(1, 61)}, **{100 + k: 100 for k in range(1, 30)}, **{k: 200 for k in range(201, 231)}, 301: 300}
    assert neardup.components(spark.createDataFrame([], "node long, root long")).collect() == []


def test_signatures_estimate_likeness():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 62, 2000, dtype=np.uint64)
    s, t = neardup.signature(np.unique(a[:1700])), neardup.signature(np.unique(a[300:]))
    assert abs((s == t).mean() - 0.7) < 0.25 and (neardup.signature(np.unique(a)) == neardup.signature(np.unique(a[::-1]))).all()


def test_odd_near_duplicates(odd, none):
    got = neardup.near_duplicates(odd).collect()
    assert len(got) == len(odd_rows())
    by = {r["doc_id"]: r for r in got}
    assert (by[6]["component_id"], by[7]["component_id"], by[1]["n_shingles"], by[4]["n_shingles"], by[5]["n_shingles"]) == (6, 6, 0, 1, 1)
    assert by[1]["kept"] and by[2]["kept"] and by[3]["kept"] and not by[7]["kept"] and by[None]["kept"]
    kept = neardup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 8, 9, 10]
    assert neardup.near_duplicates(none).collect() == [] and neardup.drop_near_duplicates(none).collect() == []


def test_repeated_rows_leave_one(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "en", "a", 0)] * 3 + [(2, "a b c d e f", "en", "a", 0), (3, None, "en", "a", 0), (3, None, "en", "a", 0)], DOCS)
    assert sorted(r["doc_id"] for r in neardup.drop_near_duplicates(docs).collect()) == [1, 3]


# ------------------------------------------------------------- decontamination


def hits_by_force(rows, items, window=10):
    """The added columns of each row; the longest match by comparing word by word from every pair of places."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    grams = {}
    for i, t in items:
        w = words(t)
        m = min(window, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            grams.setdefault(tuple(w[k : k + m]), set()).add((str(i), k, tuple(w)))
    out = {}
    for i, t in rows:
        w = words(t)
        flags, found, best = [0] * len(w), set(), (0, None, None, None)
        for m in {len(g) for g in grams}:
            for k in range(len(w) - m + 1):
                for item, at, own in grams.get(tuple(w[k : k + m]), ()):
                    found.add(item)
                    flags[k : k + m] = [1] * m
                    size = m
                    while k + size < len(w) and at + size < len(own) and w[k + size] == own[at + size]:
                        size += 1
                    if best[1] is None or (-size, item, at, k) < (-best[0], *best[1:]):
                        best = (size, item, at, k)
        out[i] = (len(w), sum(flags), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(flags), *best)
    return out


@pytest.mark.parametrize("block", [1 << 20, 3000])
def test_documents_against_every_window(spark, block):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    want = hits_by_force([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in bench.select("item_id", "text").collect()])
    got = {r["doc_id"]: tuple(r)[1:] for r in decontaminate.mark(docs, bench, keep=["doc_id"], block_bytes=block).collect()}
    assert got == want and sum(w[4] for w in want.values())


def test_short_items_overlaps_and_ties(spark):
    rng = random.Random(2)
    vocab = ["a", "b", "c", "É", "x1"]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 2, 3, 9, 10, 11, 14])))) for k in range(25)] + [(99, None), (5, "a b c"), (7, "-- !")]
    rows = [(k, rng.choice([" ", "--", "\n"]).join(rng.choice(vocab + ["Q"]) for _ in range(rng.randint(0, 60)))) for k in range(80)] + [(500, None), (501, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in decontaminate.mark(docs, bench, keep=["doc_id"]).collect()}
    assert got == hits_by_force(rows, items)


def test_search_finds_all_places():
    w = decontaminate.Suffixes([("i", "a b c")], 10)
    sizes, found = decontaminate.find(w, pa.array(["x a b c a B c", "b c", None, "c a b", "a b c"]))
    assert sizes.tolist() == [7, 2, 0, 3, 3] and {k: (f.spans, f.items, f.longest) for k, f in found.items()} == {0: ([(1, 7)], {"i"}, (-3, "i", 0, 1)), 4: ([(0, 3)], {"i"}, (-3, "i", 0, 0))}


@pytest.mark.parametrize("places", [1, 7, 64])
def test_a_split_search_finds_the_same(places, monkeypatch):
    rng = random.Random(places)
    word = lambda: rng.choice("abcd")
    items = [(str(k), " ".join(word() for _ in range(rng.randint(2, 30)))) for k in range(12)]
    texts = pa.array([" ".join(word() for _ in range(rng.randint(0, 80))) for _ in range(20)])
    read = lambda: {k: (f.spans, f.items, f.longest) for k, f in decontaminate.find(decontaminate.Suffixes(items, 3), texts)[1].items()}
    whole = read()
    monkeypatch.setattr(decontaminate, "PLACES", places)
    assert read() == whole and len(whole) > 10


def test_odd_decontamination(odd, none, spark):
    bench = spark.createDataFrame([(1, "lazy dog and runs"), (2, None), (3, "lorem ipsum dolor sit amet lorem ipsum dolor sit amet lorem ipsum")], "item_id long, text string").withColumn("doc_id", decontaminate.F.lit(1))
    out = decontaminate.mark(odd, bench)
    added = decontaminate.ADDED
    assert out.columns == [*(c for c in odd.columns if c not in added), *added]
    split = decontaminate.mark(odd, bench, block_bytes=40)
    same = ["doc_id", *added]
    key = lambda r: str(tuple(r))
    assert sorted(split.select(*same).collect(), key=key) == sorted(out.select(*same).collect(), key=key)
    hit = {r["doc_id"] for r in out.where("contaminated").collect()}
    assert hit == {6, 7, 8} and {r["n_hit"] for r in out.where("doc_id = 8").collect()} == {200_000}
    assert sorted((r["doc_id"] or 0) for r in decontaminate.clean(odd, bench).collect()) == [0, 1, 2, 3, 4, 5, 9, 10]
    assert decontaminate.clean(odd, bench).columns == odd.columns
    assert decontaminate.clean(odd, bench.limit(0)).count() == len(odd_rows()) and decontaminate.clean(none, bench).collect() == []


@pytest.mark.parametrize("name", ["op6_sharding", "op7_decontamination", "op8_minhash"])
def test_queries_equal_their_sql(spark, sf, name):
    import duckdb

    from gridloom.llm import queries

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    got = queries.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(cur.fetchall())
