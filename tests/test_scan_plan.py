"""The scan plan on scenes of a few voxels, against an evaluation scan by scan, and where regions fail."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import kernels as K
from gridloom.operators import scan_plan as P

CELL = "scan long, anatomy long, z long, y long, x long"


def cells(spark, given):
    """given: {(scan, anatomy): boolean array}."""
    rows = [(s, a, *map(int, at)) for (s, a), m in given.items() for at in np.argwhere(m)]
    return spark.createDataFrame(rows, CELL)


def scans(spark, shapes):
    return spark.createDataFrame([(s, *shape) for s, shape in shapes.items()], "scan long, nz long, ny long, nx long")


def volume(spark, shapes, value=1.0):
    return spark.createDataFrame([(s, *map(int, at), value) for s, shape in shapes.items() for at in np.ndindex(*shape)], "scan long, z long, y long, x long, v double")


def block(shape, *boxes):
    m = np.zeros(shape, bool)
    for z, y, x in boxes:
        m[slice(*z), slice(*y), slice(*x)] = True
    return m


def found(df, *names):
    return {(r["scan"], r["anatomy"]): tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.collect()}


def test_routing(spark):
    """Shares of the largest, no mask at all, bone that recalls, a femur that leads, a swapped hip."""
    shape = (10, 10, 10)
    at = lambda n, z=0: block(shape, ((z, z + 1), (0, 10), (0, 10))) & (np.arange(1000).reshape(shape) < z * 100 + n)
    primary = {(1, 1): at(100), (1, 2): at(20, 1), (1, 4): at(19, 2), (3, 1): at(50), (4, 4): at(90), (4, 2): at(10, 1), (5, 1): at(60), (5, 2): at(40, 1), (6, 1): at(60), (6, 2): at(40, 1)}
    bones = {(3, 3): at(5, 5), (4, 3): at(50, 5), (5, 3): at(21, 1), (6, 3): at(20, 1)}
    p, b = cells(spark, primary), cells(spark, bones)
    every = scans(spark, dict.fromkeys(range(1, 7), shape))
    got = found(P.routed(P.counts(every, p, b)), "routed")
    kept = {s: {a for a in P.ANATOMIES if got[s, a]} for s in range(1, 7)}
    assert kept == {1: {1, 2}, 2: {1, 2, 3}, 3: {1, 3}, 4: {4}, 5: {1, 3}, 6: {1, 2, 3}}
    plain = found(P.routed(P.counts(every, p, b), P.Rules(reconcile=False)), "routed")
    assert {a for a in P.ANATOMIES if plain[5, a]} == {1, 2} and {a for a in P.ANATOMIES if plain[3, a]} == {1}


def test_sources(spark):
    shape = (10, 10, 10)
    half, tenth, none = block(shape, ((0, 5), (0, 10), (0, 10))), block(shape, ((0, 1), (0, 10), (0, 10))), block(shape)
    p = cells(spark, {(1, 1): tenth, (1, 2): half, (1, 3): half})
    b = cells(spark, {(1, 2): tenth, (2, 1): none | tenth})
    routed = P.routed(P.counts(scans(spark, {1: shape, 2: shape}), p, b))
    got = found(P.sourced(routed), "source", "fraction")
    assert {k: v for k, v in got.items() if v[0]} == {(1, 1): ("primary", 0.1), (1, 2): ("fallback", 0.1), (1, 3): ("none", 0.5), (2, 1): ("fallback", 0.1), (2, 2): ("none", 0.0), (2, 3): ("none", 0.0)}
    assert found(P.sourced(routed, P.Rules(fallback=False)), "source")[1, 2] == "none"


@pytest.mark.parametrize("mode", ["largest", "floor", "union"])
def test_parts(spark, mode):
    rng = np.random.default_rng(3)
    given = {(s, a): rng.random((9, 7, 6)) < 0.12 for s in (1, 2) for a in (1, 3)}
    given[3, 1] = block((9, 7, 6), ((0, 1), (0, 1), (0, 3)), ((5, 6), (0, 1), (0, 3)))  # a tie
    want = {}
    for k, m in given.items():
        labels, n = K.components(m, 3)
        sizes = np.bincount(labels.ravel(), minlength=n + 1)[1:]
        keep = {int(np.argmax(sizes)) + 1} | ({i + 1 for i in range(n) if sizes[i] >= 4} if mode == "floor" else set())
        want[k] = {tuple(at) for at in np.argwhere(np.isin(labels, list(keep)) if mode != "union" else m)}
    got = P.parts(cells(spark, given), P.Rules(parts=mode, least_part=4, planes=4), (7, 6)).collect()
    assert {k: {(r["z"], r["y"], r["x"]) for r in got if (r["scan"], r["anatomy"]) == k} for k in given} == want
    with pytest.raises(ValueError, match="unknown parts"):
        P.parts(cells(spark, given), P.Rules(parts="most"), (7, 6))


def test_boxes_and_time(spark):
    shape = (300, 20, 30)
    given = {(1, a): block(shape, ((k, k + 1), (3, 5), (0, 30))) for k, a in enumerate((1, 2, 3, 4), 100)}
    b = P.boxes(cells(spark, given), scans(spark, {1: shape}), P.Rules(pad=4))
    assert found(b, "z0", "z1", "y0", "y1", "x0", "x1", "eta")[1, 1] == (96, 105, 0, 9, 0, 30, 2.5)
    spans = spark.createDataFrame([(1, 1, 3.0), (1, 2, 9.0), (1, 3, 4.0), (1, 4, 4.0), (2, 1, 0.5)], "scan long, anatomy long, eta double")
    assert found(P.timed(spans, P.Rules(soft=10.0)), "in_time") == {(1, 1): True, (1, 2): False, (1, 3): True, (1, 4): False, (2, 1): True}
    assert not any(found(P.timed(spans, P.Rules(soft=100.0, hard=0.0)), "in_time").values())


def test_a_failing_scan_leaves_the_others(spark):
    """A decoder that raises on one region: its scan is 0 throughout, the others are as they are without it."""
    shape = (6, 6, 6)
    shapes = {1: shape, 2: shape, 3: shape}
    left, right = block(shape, ((0, 2), (0, 6), (0, 3))), block(shape, ((3, 5), (0, 6), (0, 3)))
    p = cells(spark, {(s, a): m for s in shapes for a, m in ((1, left), (4, right))})
    none, rules = cells(spark, {(9, 1): block((1, 1, 1))}).limit(0), P.Rules(pad=0)
    v = volume(spark, shapes).withColumn("v", F.when((F.col("scan") == 2) & (F.col("z") == 3), -1.0).otherwise(1.0))

    def fragile(c):
        if (c[0] < 0).any():
            raise ValueError("bad slice")
        return np.where(np.arange(c[0].shape[1])[None, :, None] < 3, 1, 2) * np.ones(c[0].shape, int)

    listed = scans(spark, shapes | {7: shape})
    out = P.run(listed, v, p, none, lambda regions: P.decoded(regions, ["v"], fragile), rules)
    got = found(out.steps, "status", "why", "ids", "voxels")
    assert got[1, 1] == got[3, 1] == got[1, 4] == ("painted", None, 2, 36)
    assert got[2, 1] == ("scan failed", "a region failed", 0, 0) and got[2, 4] == ("failed", "ValueError: bad slice", 0, 0)
    assert got[7, 1] == ("no mask", "no voxels", 0, 0) and got[1, 2][0] == "not routed"
    whole = P.label_map(v, out.ids)
    assert {(r["scan"], r["id"]): r["count"] for r in whole.groupBy("scan", "id").count().collect()} == {(s, i): n for s in (1, 3) for i, n in ((0, 144), (1, 18), (2, 18), (151, 18), (152, 18))} | {(2, 0): 216}


def test_painting(spark):
    """Slots by size beyond the cap, no entry into another's mask, the first anatomy keeps a voxel."""
    rows = [(1, 1, 0, 0, x, 1 + x) for x in range(4)] + [(1, 1, 1, 0, x, 3) for x in range(2)] + [(1, 1, 2, 0, 0, 2)] + [(1, 2, 0, 0, x, 9) for x in range(6)]
    pieces = spark.createDataFrame(rows, f"{CELL}, piece long")
    owned = spark.createDataFrame([(1, 2, 0, 0, 1), (1, 2, 0, 0, 5), (1, 1, 0, 0, 4)], CELL)
    got = {(r["z"], r["x"]): r["id"] for r in P.painted(pieces, owned, cap=2).collect()}
    # of anatomy 1 pieces 3 (three voxels) and 2 (two) get the slots; x = 1 belongs to 2's mask, x = 4 to 1's
    assert got == {(0, 2): 1, (1, 0): 1, (1, 1): 1, (2, 0): 2, (0, 0): 3, (0, 1): 3, (0, 3): 3, (0, 5): 3}
    free = {(r["z"], r["x"]): r["id"] for r in P.painted(pieces, None, cap=2).collect()}
    assert free[0, 1] == 2 and free[0, 4] == 3


def test_proposed_splits_pass_the_gate(spark):
    """A region of one piece; the proposal cuts it, and a gate that takes every split gives the smaller part a free id."""
    from gridloom.operators import gate as G

    class Line:
        def predict(self, x):
            return np.zeros(len(x))

    names = ["isolated_piece_fraction"]
    payload = {"models": {f"delta_{t}": Line() for t in ("merge", "split", "dice", "f1", "precision")}, "feature_names": names, "policy": {"action": "select", "merge_max": 0.0, "split_max": 1.0}, "quality_guards": {"delta_dice_min": 0.0, "delta_f1_min": 0.0, "delta_precision_min": 0.0}}
    shape = (4, 4, 10)
    p = cells(spark, {(1, 1): block(shape, ((0, 4), (0, 4), (0, 10))), (2, 1): block(shape, ((0, 4), (0, 4), (0, 10)))})
    one = lambda regions: P.decoded(regions, ["v"], lambda c: np.ones(c[0].shape, int))

    def cut(regions):
        def halves(c):
            if c[0].max() > 1:
                raise ValueError("no proposal here")
            return np.where(np.arange(10)[None, None, :] < 3, 1, 2) * np.ones(c[0].shape, int)

        return P.decoded(regions, ["v"], halves)

    v = volume(spark, {1: shape, 2: shape}).withColumn("v", F.col("scan").cast("double"))
    args = (scans(spark, {1: shape, 2: shape}), v, p, p.limit(0), one, P.Rules(most_share=1.1))
    plain = P.run(*args)
    assert found(plain.steps, "ids", "voxels")[1, 1] == (1, 160)
    out = P.run(*args, propose=cut, gate=lambda g: G.run_gate(g, payload, 10))
    sizes = {(r["scan"], r["id"]): r["count"] for r in out.ids.groupBy("scan", "id").count().collect()}
    assert sizes == {(1, 1): 112, (1, 2): 48, (2, 1): 160}
    assert found(out.steps, "ids", "voxels")[1, 1] == (2, 160)
