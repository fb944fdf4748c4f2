import random
import re
from collections import Counter

import duckdb
import pytest

from gridloom.llm import phrases as P
from gridloom.llm.queries import op11_phrases

from .conftest import DOCS

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, longest=5, least=100, most=2000):
    """rows (lang, text) to the contract's rows, phrase by phrase."""
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            total[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, w[i : i + k]] += 1
    cand = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    gone = set()
    for (lang, w), a in cand.items():
        for i in range(len(w)):
            for j in range(i + 2, len(w) + 1):
                if j - i < len(w) and 100 * a >= 100 * cand.get((lang, w[i:j]), 10**9):
                    gone.add((lang, w[i:j]))
    out = {}
    for (lang, w), a in cand.items():
        if (lang, w) in gone:
            continue
        n = total[lang]
        score, _, l, r = min((1000 * a * n // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r, n))
    return sorted((lang, i + 1, x[2].decode(), -x[1], x[3], x[4], x[5], -x[0]) for lang, xs in out.items() for i, x in enumerate(sorted(xs)[:most]))


def scene(seed, n=120):
    rng = random.Random(seed)
    words = ["a", "b", "The", "the", "É", "new", "york", "city", "x1", "naïve", "😀", "z" * 40]
    fixed = ["new york city hall", "the a b", "a a a a a a a", "b, c b. c", "one two three four five six", "É b\tÉ b"]
    rows = []
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.4 else " ".join(rng.choices(words, k=rng.randint(1, 6))) for _ in range(rng.randint(0, 12))]
        rows.append((rng.choice(["en", "de", None, "und"]), rng.choice([" ", ". ", "\n", "  ", "!"]).join(parts)))
    return rows + [(None, None), ("en", ""), ("en", " .\n"), ("fr", "only once")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, l, "a", 0) for i, (l, t) in enumerate(rows)], DOCS).repartition(3)


def run(spark, given, **how):
    return sorted(tuple(r) for r in P.collocations(frame(spark, given), **how).collect())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    rows = scene(seed)
    assert run(spark, rows, least=8) == brute(rows, least=8)


@pytest.mark.parametrize("bound", [0, 5, 30])
def test_joins_give_what_broadcasts_give(spark, bound):
    """Tables beyond the bound: from the words on, or from a later level."""
    rows = scene(5)
    want = brute(rows, least=8)
    assert len(want) > 30
    assert run(spark, rows, least=8, rows=bound) == want


def test_rank_is_cut_at_most(spark):
    rows = scene(6)
    assert run(spark, rows, least=5, most=7) == brute(rows, least=5, most=7)
    assert run(spark, rows, least=5, longest=2) == brute(rows, least=5, longest=2)


def test_products_beyond_64_bits(spark):
    """Counts far above what a test can hold go through the same scoring."""
    words = spark.createDataFrame([(0, "en", "a", 7_000_000_001), (1, "en", "b", 9_000_000_007)], "id long, lang string, word string, n long")
    pairs = spark.createDataFrame([(0, 0, 1, 6_999_999_999)], "id long, left long, right long, n long")
    spoken = spark.createDataFrame([("en", "a", 7_000_000_001), ("en", "b", 9_000_000_007), ("en", "c", 10**14)], "lang string, word string, n long")
    row = P.candidates(spoken, [words, pairs]).first()
    assert row["score"] == 1000 * 6_999_999_999 * (16_000_000_008 + 10**14) // (7_000_000_001 * 9_000_000_007)
    # a quotient just below a whole number: 1000 * a * n = l * r * 1000 * n - 1000 * n
    words = spark.createDataFrame([(0, "en", "a", 10**7), (1, "en", "b", 10**7)], "id long, lang string, word string, n long")
    pairs = spark.createDataFrame([(0, 0, 1, 10**7 - 1)], "id long, left long, right long, n long")
    spoken = spark.createDataFrame([("en", "a", 10**7)], "lang string, word string, n long")
    assert P.candidates(spoken, [words, pairs]).first()["score"] == 1000 * (10**7 - 1) * 10**7 // 10**14 == 999


def test_odd_and_empty(spark, odd, none):
    assert P.collocations(none).collect() == []
    rows = [tuple(r) for r in odd.select("lang", "text").collect()]
    assert sorted(tuple(r) for r in P.collocations(odd).collect()) == brute(rows)


def test_equals_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = sorted(tuple(r) for r in op11_phrases(spark, sf).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert got and got == sorted(con.execute(P.oracle_sql()).fetchall())


def test_sql_equals_brute_force(spark):
    rows = scene(8)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (lang VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(con.execute(P.oracle_sql(least=8)).fetchall()) == brute(rows, least=8)
