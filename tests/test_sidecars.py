"""Sidecars: pools and their samples against plain Python, resuming, and checks that name what is broken."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import sidecars as S

GRID = "sample string, z long, y long, x long, id long, cls long"


def scene(seed, names=("a", "b", "c")):
    rng = np.random.default_rng(seed)
    rows = []
    for k, name in enumerate(names):
        ids = np.where(rng.random((6, 5, 7)) < 0.6, rng.choice([3, 4, 60], (6, 5, 7)), 0)
        cls = np.where(ids > 0, rng.choice([2, 3] if k == 1 else [2, 3, 4], ids.shape), rng.choice([0, 1], ids.shape))
        rows += [(name, *map(int, at), int(ids[at]), int(cls[at])) for at in np.ndindex(*ids.shape)]
    return rows


def pools_of(rows, tiny):
    """{(sample, pool): places}, by looking at every voxel's six neighbours."""
    at = {r[:4]: (r[4], r[5]) for r in rows}
    sizes, touches = {}, set()
    for (s, *_), (i, c) in at.items():
        sizes[s, i] = sizes.get((s, i), 0) + 1
        touches |= {s} if c == 4 else set()
    edge = set()
    for (s, z, y, x), (i, _) in at.items():
        for d in ((1, 0, 0), (0, 1, 0), (0, 0, 1), (-1, 0, 0), (0, -1, 0), (0, 0, -1)):
            j = at.get((s, z + d[0], y + d[1], x + d[2]), (0, 0))[0]
            if i and j and i != j and (i - 1) // 50 == (j - 1) // 50:
                edge.add((s, z, y, x))
    out = {}
    for k, (i, c) in at.items():
        contact = c == 4 or (k[0] not in touches and k in edge)
        for pool, yes in zip(S.POOLS, (contact, i > 0 and sizes[k[0], i] <= tiny, c in (2, 3, 4) and not contact, c == 1, k in edge), strict=True):
            if yes:
                out.setdefault((k[0], pool), set()).add(k[1:])
    return out


def test_pools_sizes_and_audit(spark, tmp_path):
    rows = scene(1)
    want = pools_of(rows, 45)
    grid = spark.createDataFrame(rows, GRID).repartition(3)
    did = S.build(grid, str(tmp_path), most=10_000, tiny=45)
    assert did == {"samples": 3, "locations": sum(map(len, want.values()))}
    got = {}
    for r in spark.read.parquet(f"{tmp_path}/locations").collect():
        got.setdefault((r["sample"], r["pool"]), set()).add((r["z"], r["y"], r["x"]))
    assert got == want
    for r in spark.read.parquet(f"{tmp_path}/audit").collect():
        own = [x for x in rows if x[0] == r["sample"]]
        assert r["ids"] == sorted({x[4] for x in own} - {0}) and r["fragments"] == len(r["ids"]) and r["covered"]
        assert r["support"] == sum(x[5] in (2, 3, 4) for x in own) and r["background"] == sum(x[5] == 0 for x in own)
        assert {p: r[p] for p in S.POOLS} == {p: r[p.replace("_locations", "_voxels")] for p in S.POOLS} == {p: len(want.get((r["sample"], p), ())) for p in S.POOLS}
    f = {(r["sample"], r["id"]): r for r in spark.read.parquet(f"{tmp_path}/fragments").collect()}
    own = np.array([x[1:4] for x in rows if x[0] == "a" and x[4] == 3])
    assert f["a", 3]["n"] == len(own) and [f["a", 3][c] for c in ("cz", "cy", "cx")] == pytest.approx(own.mean(0))


@pytest.mark.parametrize("span", [S.SPAN, 1 << 60])
def test_samples_are_the_lowest_keys(spark, span):
    """Also where the bound lets too few pass, as it does for a span that the keys don't fill."""
    key = (F.col("z") * 7919 + F.col("x") * 104729) % 1_000_003 if span == S.SPAN else F.lit(span - 1) - F.col("x")
    n = 40_000
    df = spark.range(n).selectExpr("'a' sample", "'p' pool", "id % 200 z", "0L y", "id x").withColumn("_key", key)
    if span == S.SPAN:
        span = 1_000_003
    rows = sorted((r["_key"], r["z"], r["y"], r["x"]) for r in df.collect())[:500]
    got = S.lowest(df, ["sample", "pool"], "_key", 500, span, ["z", "y", "x"]).collect()
    assert sorted((r["_key"], r["z"], r["y"], r["x"]) for r in got) == rows and {r["rank"] for r in got} == set(range(1, 501))


def test_second_run_writes_nothing_and_a_broken_one_is_repaired(spark, tmp_path, monkeypatch):
    rows, out = scene(2), str(tmp_path)
    grid = spark.createDataFrame(rows, GRID)
    first = S.build(grid.where("sample <> 'c'"), out, most=20)
    files = {f: os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(out) for f in names if f.startswith("part")}
    assert first["samples"] == 2 and S.build(grid.where("sample <> 'c'"), out, most=20) == {"samples": 0, "locations": 0}
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(S, "audit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        S.build(grid, out, most=20)
    assert S.build(grid, out, most=20)["samples"] == 1
    now = {f: os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(out) for f in names}
    assert files.items() <= now.items()
    assert spark.read.parquet(f"{out}/audit").count() == 3 and spark.read.parquet(f"{out}/locations").groupBy("sample", "pool").count().where("count > 20").isEmpty()


def test_every_broken_rule_is_named(spark):
    rows = [("a", 1, 4), ("a", 1, 3), ("a", 0, 1), ("b", 2, 3), ("b", 2, 2), ("b", 0, 4), ("b", 0, 3), ("c", 5, 4), ("c", 5, 7), ("c", 0, None), ("d", 0, 0)]
    broken = S.violations(spark.createDataFrame(rows, "sample string, id long, target long"))
    assert sorted(map(tuple, broken.collect())) == [("b", 0, "outside", 2), ("b", 2, "no core", 1), ("c", 0, "unknown label", 1), ("c", 5, "unknown label", 1)]
    S.require(broken.where("sample = 'a'"))
    with pytest.raises(ValueError, match=r"b fragment 0: outside \(2\); b fragment 2: no core \(1\)"):
        S.require(broken)
