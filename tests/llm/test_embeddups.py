import duckdb
import numpy as np
import pytest

from gridloom.llm import embeddups as E

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """(vec_id, vector, label) with distinct ids to {vec_id: (links, component)} over all pairs."""
    unit = {}
    for i, v, label in rows:
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            v = np.array(v, np.float32).astype(float)
            unit[i] = (v / np.linalg.norm(v), label)
    near = {i: set() for i, *_ in rows}
    for i, (a, la) in unit.items():
        for j, (b, lb) in unit.items():
            if i < j and la == lb and len(a) == len(b) and a @ b >= 0.98:
                near[i].add(j)
                near[j].add(i)
    comp = {}
    for i in sorted(near):
        todo = [i] if i not in comp else []
        while todo:
            x = todo.pop()
            if x not in comp:
                comp[x] = i
                todo += near[x]
    return {i: (len(near[i]), comp[i]) for i in near}


def near(rng, v, cosine):
    """A vector at about this cosine of v."""
    o = rng.standard_normal(len(v))
    o -= (o @ v) / (v @ v) * v
    o *= np.linalg.norm(v) / np.linalg.norm(o)
    return cosine * v + np.sqrt(1 - cosine**2) * o


def scene(seed, n=40, dims=48):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        v = rng.standard_normal(dims) * rng.choice([1e-3, 1, 50])
        rows.append((v, k % 3))
        for c in rng.uniform(0.97, 1, rng.integers(0, 6)):
            rows.append((near(rng, v, c), k % 3 if rng.random() < 0.9 else (k + 1) % 3))
        if k % 5 == 0:
            rows += [(v, k % 3)] * 3 + [(v * 2, k % 3)]
    order = rng.permutation(len(rows))
    return [(int(i), [float(x) for x in np.float32(rows[k][0])], rows[k][1]) for i, k in enumerate(order)]


def got(spark, rows, schema=SCHEMA, **how):
    out = E.near_duplicates(spark.createDataFrame(rows, schema).repartition(3), E.Tables(**how)).collect()
    assert len(out) == len(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out if r["vec_id"] is not None)
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out}


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, seed):
    rows = scene(seed)
    assert got(spark, rows) == brute(rows)


def test_sql_equals_all_pairs():
    rows = [*scene(2, n=25), (900, None, 1), (901, [], 1), (902, [0.0] * 48, 1), (903, [1.0, None] * 24, 1), (904, [1.0, float("inf")] * 24, 1), (905, [1.0] * 48, None), (906, [1.0] * 3, 1), (907, [1.0] * 3, 1)]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", [[i, v, k] for i, v, k in rows])
    got = {i: (n, c, k) for i, n, c, k in con.execute(E.oracle_sql()).fetchall()}
    assert got == {i: (n, c, i == c) for i, (n, c) in brute(rows).items()} and sum(n for n, *_ in got.values()) > 20


def test_large_buckets_go_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(E, "BUCKET", 20)
    monkeypatch.setattr(E, "BLOCK", 8)
    rng = np.random.default_rng(4)
    v = rng.standard_normal(32)
    rows = [(i, [float(x) for x in np.float32(near(rng, v, 0.995))], 1) for i in range(150)] + [(200 + i, [float(x) for x in np.float32(v)], 1) for i in range(60)]
    assert got(spark, rows) == brute(rows)


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(9)
    rows = []
    for k in range(1500):
        v = rng.standard_normal(64)
        rows += [(2 * k, v.tolist(), 1), (2 * k + 1, near(rng, v, 0.98001).tolist(), 1)]
    found = got(spark, rows, "vec_id long, embedding array<double>, label int")
    assert sum(n for n, _ in found.values()) / 3000 > 0.995


def test_bits_of_wide_keys(spark):
    rows = scene(3, n=15)
    assert got(spark, rows, tables=30, signs=18) == brute(rows)


def test_defined_cases(spark):
    one = [1.0, 2.0, 3.0]
    rows = [
        (1, None, 1), (2, [], 1), (3, [0.0, 0.0, 0.0], 1), (4, [1.0, None, 3.0], 1), (5, [1.0, float("nan"), 3.0], 1), (6, [float("inf"), 2.0, 3.0], 1),
        (7, one, None), (8, one, 1), (9, one, 1), (10, one, 2), (11, [1.0, 2.0, 3.0, 0.0], 1), (12, [-1.0, -2.0, -3.0], 1), (13, [-0.0, 0.0, 1.0], 1), (14, [0.0, 0.0, 1.0], 1), (None, one, 1), (None, [5.0, -2.0, 0.0], 7),
    ]
    out = E.near_duplicates(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS key", "2 AS n", "3 AS links", "4 AS root", "5 AS x", "6 AS kept", "7 AS component_id")).collect()
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in out if r["vec_id"] is not None}
    alone = {i: (0, i, True) for i in (1, 2, 3, 4, 5, 6, 7, 10, 11, 12)}
    assert found == alone | {8: (2, 8, True), 9: (2, 8, False), 13: (1, 13, True), 14: (1, 13, False)}
    assert sorted((r["n_links"], r["component_id"], r["kept"]) for r in out if r["vec_id"] is None) in ([(0, None, True), (2, 8, False)],)


def test_repeated_ids_are_vectors_of_their_own(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.001], 1), (2, [0.0, 1.0], 1), (2, [0.0, 1.0], 1)]
    out = sorted(tuple(r) for r in E.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert out == [(1, 1, 1, True)] * 2 + [(2, 1, 2, True)] * 2


def test_empty_and_text_ids(spark):
    assert E.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [("b", [1.0, 0.0], "long label " * 20), ("a", [1.0, 0.0], "long label " * 20), ("c", [1.0, 0.0], "long label " * 20 + "x")]
    assert got(spark, rows, "vec_id string, embedding array<double>, label string") == {"b": (1, "a"), "a": (1, "a"), "c": (0, "c")}
