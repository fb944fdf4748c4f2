import hashlib
import random
import zlib

import numpy as np
import pytest

from gridloom.llm import fingerprints as FP
from gridloom.llm import toxicity

from .conftest import DOCS, odd_rows

# ------------------------------------------------------------- toxicity


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(len(order))
    n = label.sum()
    return (rank[label == 1].sum() - n * (n - 1) / 2) / (n * (len(label) - n))


@pytest.fixture(scope="module")
def scored(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    s = toxicity.score_documents(docs, labels, keep=["doc_id"]).withColumn("held_out", toxicity.held_out(toxicity.F.col("doc_id")))
    return s.join(labels, "doc_id", "left").toPandas()


def test_held_out_accuracy(scored):
    assert (scored.held_out == scored.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    t = scored[scored.held_out & scored.toxic.notna()]
    assert auc(t.score.to_numpy(), t.toxic.to_numpy()) > 0.95
    assert t.predicted[t.toxic == 1].mean() > 0.85 and t.predicted[t.toxic == 0].mean() < 0.01
    assert scored.score.between(0, 1).all() and (scored.predicted == (scored.score >= 0.5)).all()


def planted(n, seed):
    rng = random.Random(seed)
    calm = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(calm) for _ in range(rng.randint(20, 200))]
        bad = i % 8 == 0
        if bad:
            for _ in range(len(w) // 15 + 1):
                w[rng.randrange(len(w))] = rng.choice(["wretched", "despicable", "blockhead", "vermin"])
        rows.append((i, " ".join(w), "en", "a", 0))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_planted_words_are_caught(spark):
    rows, labels = planted(800, 4)
    docs, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, lab, keep=["doc_id"]).collect()}
    held = [(i, t) for i, _, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i]["predicted"] == t for i, t in held) >= 0.98 * len(held)
    # held-out labels change nothing
    flipped = spark.createDataFrame([(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    assert {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, flipped, keep=["doc_id"]).collect()} == {k: r["score"] for k, r in got.items()}


def test_ids_bound_the_training_rows(spark):
    """A labelled id on a thousand rows teaches as one text, the first in code-point order."""
    rows, labels = planted(400, 5)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    teaches = next(i for i, *_ in rows if i % 8 == 0 and zlib.crc32(str(i).encode()) % 5)
    more = [(teaches, f"~ another text {k}", "en", "a", 0) for k in range(1000)]
    one = toxicity.train(spark.createDataFrame(rows, DOCS), lab)
    many = toxicity.train(spark.createDataFrame(rows + more, DOCS).repartition(5), lab)
    assert one[:2] == many[:2] and np.allclose(one[2], many[2], rtol=1e-9)


def test_every_significant_mark_counts(spark):
    """Many rare marks, together over a kilobyte, each in under 1 % of the toxic texts; and a pair of words that are ordinary apart."""
    rng = random.Random(11)
    calm = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    marks = ["".join(rng.choice("bcdfghjkmpqvwxyz") for _ in range(12)) for _ in range(200)]
    rows, labels = [], []
    for i in range(8000):
        w = [rng.choice(calm) for _ in range(40)]
        bad = i % 8 == 0
        at = rng.randrange(39)
        if bad and i % 16 == 0:
            w[at] = marks[i // 16 % len(marks)] if i % 5 else rng.choice(marks)
        elif bad:
            w[at : at + 2] = ["mellow", "stoat"]
        else:
            w[at : at + 1] = ["mellow"] if i % 2 else ["stoat"]
        rows.append((i, " ".join(w), "en", "a", 0))
        labels.append((i, 1, int(bad)))
    docs, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    toxic, _, _ = toxicity.train(docs, lab)
    held = {i for i, *_ in labels if zlib.crc32(str(i).encode()) % 5 == 0}
    met = {m: sum(m in t.split() for i, t, *_ in rows if i not in held) for m in marks}
    assert all((f" {m} ".encode() in toxic) == (n >= 4) for m, n in met.items() if n != 3) and sum(n >= 4 for n in met.values()) > 10 and b" mellow stoat " in toxic and b" mellow  " not in toxic
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_documents(docs, lab, keep=["doc_id"]).collect()}
    pair = [got[i] for i in held if i % 16 == 8]
    assert np.mean(pair) > 0.9 and np.mean([got[i] for i in held if i % 8]) < 0.02


def test_odd_toxicity(odd, none, spark):
    rows, labels = planted(200, 7)
    lab = spark.createDataFrame([(1000 + i, q, t) for i, q, t in labels] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    docs = odd.select("doc_id", "text").unionAll(spark.createDataFrame([(1000 + i, t) for i, t, *_ in rows], "doc_id long, text string"))
    out = toxicity.score_documents(docs, lab)
    assert out.columns == ["doc_id", "text", "score", "predicted"] and out.count() == len(rows) + len(odd_rows())
    assert out.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    # no labels: every score is the smoothed rate
    assert {r["score"] for r in toxicity.score_documents(odd, lab.limit(0)).select("score").collect()} == {0.25}
    assert toxicity.score_documents(none, lab).collect() == []
    clean = toxicity.drop_toxic(odd, lab.where("toxic = 0"))
    assert clean.columns == odd.columns and clean.count() == len(odd_rows())


def test_windows_cover_the_whole_text():
    long = "a" * 100
    assert toxicity.windows("Ab ab, cd1ef") == [b" ab ", b" cd ", b" ef "] and toxicity.windows(None) == []
    assert b"".join(w.strip() for w in toxicity.windows(long + " b")) == b"a" * 48 + b"a" * 4 + b"b"


def test_best_cut_is_that_of_the_best_f_score():
    y = np.array([0, 0, 1, 0, 1, 1.0])
    s = np.array([-3, -2, -1, 0, 1, 2.0])

    def f(cut):
        hit = (y[s >= cut] == 1).sum()
        return 2 * hit / ((s >= cut).sum() + y.sum())

    cut = toxicity.best_cut(s, y)
    assert f(cut) == max(f(c) for c in np.arange(-4, 3, 0.25)) and cut not in s
    assert toxicity.best_cut(np.zeros(4), np.array([0, 1, 0, 1.0])) == 0.0


def test_features_by_definition():
    """The distances of all windows and marked pairs, measured one by one without a cache."""
    toxic = toxicity._dictionary([b" wretch ", b" mellow stoat ", b" vile "])
    ordinary = toxicity._dictionary([b" calm ", b" mellow "])
    m = toxicity.Distances(toxic, ordinary)
    assert m.pairs == {b" mellow stoat "}
    for text in (None, "", "Calm mellow stoat, a WRETCH and a wretched mellow stoat", "vile " + "x" * 48 + " " + "x" * 100 + "y é" * 40):
        own = toxicity.windows(text)
        d = sorted((m.distance(w) for w in own + [w for w in toxicity.pairs(text) if w in m.pairs]), reverse=True)
        got = m.features(text)
        assert got[:3] == [sum(d[:k]) for k in toxicity.TOP] and got[3] == np.log1p(len(own)) and len(got) == toxicity.FEATURES
        assert [got[5 + 3 * k] for k in range(3)] == pytest.approx([np.log1p(sum(x >= t for x in d)) for t in toxicity.THRESHOLDS])
        assert m.features(text) == got


def test_logistic_finds_a_threshold():
    x = np.random.default_rng(0).normal(size=(500, 2))
    y = (x[:, 0] + 0.5 * x[:, 1] > 0).astype(float)
    w = toxicity.fit_logistic(x, y)
    assert ((w[0] + x @ w[1:] > 0) == y).mean() > 0.97


# ------------------------------------------------------------- fingerprints


def slow_winnow(text):
    k = min(FP.K, len(text))
    h = [int(FP.gram_hashes(text[j : j + k], k)[0]) for j in range(len(text) - k + 1)] if text else []
    out = []
    w = min(len(h), FP.W)
    for j in range(len(h) - w + 1 if h else 0):
        least = min(h[j : j + w])
        p = max(q for q in range(j, j + w) if h[q] == least)
        if not out or out[-1] != (least, p):
            out.append((least, p))
    return out


@pytest.mark.parametrize("text", ["", "a", "abc" * 3, "a" * 500, "ab" * 300, "The quick brown fox. " * 40, "é😀x" * 70, "".join(chr(97 + i * i % 23) for i in range(1500))])
def test_winnowing_by_definition(text):
    h, p = FP.winnow(text)
    assert list(zip(h.tolist(), p.tolist())) == slow_winnow(text)


def test_very_long_texts_go_in_pieces(monkeypatch):
    text = "".join(chr(97 + i * 7919 % 25) + str(i % 97) for i in range(3000))
    whole = FP.winnow(text)
    hashes = FP.gram_hashes(text)
    monkeypatch.setattr(FP, "_POS_BITS", 10)
    monkeypatch.setattr(FP, "gram_hashes", lambda t, k=FP.K: hashes)
    pieces = FP.winnow(text)
    assert np.array_equal(whole[1], pieces[1])


def test_shared_passages_share_entries():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    for _ in range(30):
        passage = " ".join(word() for _ in range(60))[: FP.W + FP.K - 1]
        a, b = (" ".join(word() for _ in range(n)) + passage + " ".join(word() for _ in range(n)) for n in (rng.randint(0, 300), rng.randint(0, 300)))
        assert set(FP.winnow(a)[0].tolist()) & set(FP.winnow(b)[0].tolist())


def check_edits(rows, got):
    digest = lambda t: hashlib.md5((t or "").encode()).hexdigest()
    order = sorted(rows, key=lambda r: (r[0] is not None, *([] if r[0] is None else [r[0]]), digest(r[1])))
    want = []
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        e = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        a, b, c = FP.winnow(t), FP.winnow(e), FP.winnow(nxt)
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), FP.as_text(a), FP.as_text(b), FP.likeness(a, b), FP.likeness(a, c)))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


@pytest.mark.parametrize("ranges", [500, 7])
def test_edits_against_the_sorted_list(spark, sf, monkeypatch, ranges):
    monkeypatch.setattr(FP, "RANGE_ROWS", ranges)
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(5)
    check_edits([tuple(r) for r in docs.select("doc_id", "text").collect()], FP.fingerprints(docs).collect())


@pytest.mark.parametrize("ranges", [500, 2])
def test_odd_fingerprints(odd, none, spark, monkeypatch, ranges):
    monkeypatch.setattr(FP, "RANGE_ROWS", ranges)
    check_edits([r[:2] for r in odd_rows()], FP.fingerprints(odd).collect())
    assert FP.fingerprints(none).collect() == []
    check_edits([(4, "alone in the table")], FP.fingerprints(spark.createDataFrame([(4, "alone in the table")], "doc_id long, text string")).collect())


def test_repeated_rows_and_other_ids(spark, monkeypatch):
    """A third of the rows are one row, others have no doc_id; ids may be negative, or texts."""
    monkeypatch.setattr(FP, "RANGE_ROWS", 5)
    monkeypatch.setattr(FP, "COPIES", 4)
    rng = random.Random(3)
    words = lambda: " ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(rng.randint(0, 90)))
    rows = [(7, "the same row in a third of the table, again and again")] * 30 + [(None, words()) for _ in range(20)] + [(None, None)] * 3 + [(rng.randint(-50, 50), words()) for _ in range(40)]
    check_edits(rows, FP.fingerprints(spark.createDataFrame(rows, "doc_id int, text string").repartition(4)).collect())
    named = [(None if i is None else f"d{i}é", t) for i, t in rows]
    out = FP.fingerprints(spark.createDataFrame(named, "doc_id string, text string"))
    assert out.schema["doc_id"].dataType.simpleString() == "string"
    check_edits(named, out.collect())


def test_a_prefix_keeps_its_share():
    rng = random.Random(12)
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(400))
    whole, part = FP.winnow(text), FP.winnow(text[:600])
    assert abs(FP.likeness(whole, part) - 600 / len(text)) < 0.08


# ------------------------------------------------------------- pipeline


def test_stages_in_order(spark, sf):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, ids = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    for name, stage in P.STAGES:
        before, docs = docs, P.cut(stage(spark, docs, sf))
        now = {r[0] for r in docs.select("doc_id").collect()}
        assert now <= ids and (docs.columns == columns or name == "sharding")
        if name == "near_dedup":
            from .test_dedup_decontamination import components

            rows = [tuple(r) for r in before.select("doc_id", "text").collect()]
            assert now == set(components(rows, 80).values())
        ids = now
    assert {"slot", "shard"} <= set(docs.columns)
    assert P.run(spark, sf).count() == docs.count()


def test_stages_take_odd_documents(odd, none, spark, sf):
    import corpus_pipeline as P

    for docs in (odd, none):
        for _, stage in P.STAGES:
            out = stage(spark, docs, sf)
            assert set(docs.columns) <= set(out.columns)
            out.collect()


def test_registered_queries(spark, sf):
    from gridloom.llm import queries

    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 13))
    assert set(queries.oracle_sql()) <= set(queries.queries())
    for name, q in queries.queries().items():
        out = q(spark, sf)
        if name.startswith("op11_"):  # a report of phrases, and few documents have any
            assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
            continue
        table = next(t for c, t in (("doc_id", "documents"), ("page_id", "pages"), ("vec_id", "embeddings")) if c in out.columns)
        assert out.count() == spark.read.parquet(f"{sf}/{table}.parquet").count(), name
