import random

import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import common as C


def by_split(texts, sep):
    words, off = [], [0]
    lower = bytes(C.lower_lut().tolist())
    for t in texts:
        b = bytes(32 if sep[x] else x for x in (t or "").encode().translate(lower))
        words += [w for w in b.split(b" ") if w]
        off.append(len(words))
    return words, off


@pytest.mark.parametrize("stretch", [1, 7, 64, 1 << 19])
def test_words_are_those_of_a_split(stretch, monkeypatch):
    monkeypatch.setattr(C, "SCAN_BYTES", stretch)
    rng = random.Random(stretch)
    pieces = ["ab", "Ab", "é1", "z.q", "\tk", "\n", "  ", "zz" * 9, "x" * 80]
    for _ in range(40):
        texts = [rng.choice([None, "", " ".join(rng.choice(pieces) for _ in range(rng.randint(0, 9)))]) for _ in range(rng.randint(0, 7))]
        for sep in (C.space_lut(), C.alnum_lut()):
            hashes, off = C.scan_words(pa.array(texts, pa.string()), sep)
            words, expected = by_split(texts, sep)
            assert off.tolist() == expected
            seen = {}
            assert all(seen.setdefault(w, h) == h for w, h in zip(words, hashes.tolist()))
            assert len(set(seen.values())) == len(seen)


def test_sliced_arrays():
    a = pa.array(["a b", None, "c d e", ""], pa.string())
    h, off = C.scan_words(a.slice(2), C.space_lut())
    assert off.tolist() == [0, 3, 3] and np.array_equal(h, C.scan_words(pa.array(["c d e"]), C.space_lut())[0])


def test_cut_reads_back_the_rows(spark):
    df = spark.range(10)
    assert sorted(r[0] for r in C.cut(df).collect()) == list(range(10))


def test_small_is_a_hint_only_below_the_bound(spark):
    plan = lambda d: d._jdf.queryExecution().logical().toString()
    assert "hint" in plan(C.small(spark.range(3), 5)).lower() and "hint" not in plan(C.small(spark.range(9), 5)).lower()


def test_first_by_hash_is_the_sorted_head(spark):
    df = spark.range(5000).selectExpr("id", "id % 7 AS other")
    order = [r["id"] for r in df.orderBy(C.F.xxhash64("id"), "id").collect()]
    for rows in (10, 200, 4000, 9000):
        assert [r["id"] for r in C.first_by_hash(df, "id", rows).collect()] == order[:rows]
    assert C.first_by_hash(df.limit(0), "id", 5).collect() == []


def test_most_counted_fills_up_from_ties(spark):
    df = spark.createDataFrame([(f"w{i}", n) for i, n in enumerate([1000, 500, 500, 8, 8, 8, 1, 1, 1, 1])], "w string, n long")
    got = lambda k: sorted((r["n"] for r in C.most_counted(df, "n", k).collect()), reverse=True)
    assert [got(k) for k in (0, 1, 2, 3, 5, 6, 100)] == [[], [1000], [1000, 500], [1000, 500, 500], [1000, 500, 500, 8, 8], [1000, 500, 500, 8, 8, 8], [1000, 500, 500, 8, 8, 8, 1, 1, 1, 1]]
    assert C.most_counted(df, "n", 2).collect() == C.most_counted(df.repartition(3), "n", 2).collect()
    flat = spark.range(40).selectExpr("id", "3 AS n")
    assert C.most_counted(flat, "n", 7).count() == 7 and C.most_counted(df.limit(0), "n", 3).collect() == []
