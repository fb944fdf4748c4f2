"""Whole losses and class targets against array arithmetic."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import losses as L
from gridloom.operators import neighbors as N
from gridloom.operators import targets as T

P = ["p0", "p1", "p2", "p3"]


def data(seed, n=60, groups=(1, 2, 3)):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    p = np.exp(x) / np.exp(x).sum(1, keepdims=True)
    t = rng.choice([0, 1, 3] if seed == 2 else [0, 1, 2, 3], n)
    return x, p, t, rng.choice(groups, n), rng.random(n) < 0.7


def frame(spark, x, p, t, g, ok):
    return spark.createDataFrame([(int(g[i]), *map(float, x[i]), *map(float, p[i]), int(t[i]), bool(ok[i])) for i in range(len(t))], "g long, x0 double, x1 double, x2 double, x3 double, p0 double, p1 double, p2 double, p3 double, t long, ok boolean").repartition(3)


def dice(p, y, s=1e-5):
    return (2 * (p * y).sum(0) + s) / (p.sum(0) + y.sum(0) + s)


@pytest.mark.parametrize("seed", [1, 2])
def test_masked_dice_ce(spark, seed):
    x, p, t, g, ok = data(seed)
    ok[g == 3] = False  # a group without a valid voxel
    w = np.array([1, 1, 5, 1.0])
    got = {r["g"]: r for r in L.masked_dice_ce(frame(spark, x, p, t, g, ok), ["g"], P, "t", "ok", list(w)).collect()}
    for k in (1, 2):
        m = ok & (g == k)
        ce = (-np.log(p[m, t[m]]) * w[t[m]]).mean()
        d = 1 - dice(p[m], np.eye(4)[t[m]])[1:].mean()
        assert (got[k]["ce"], got[k]["dice_loss"], got[k]["loss"]) == pytest.approx((ce, d, ce + d))
    assert (got[3]["ce"], got[3]["dice_loss"]) == (0.0, 0.0)
    pairs = spark.createDataFrame([(1, 0.9, True), (1, 0.4, True), (1, 0.2, False), (2, 0.9, True)], "g long, p double, same boolean")
    a = {r["g"]: r for r in L.with_affinity(L.masked_dice_ce(frame(spark, x, p, t, g, ok), ["g"], P, "t", "ok", list(w)), pairs, ["g"], "p", "same", 2.0).collect()}
    assert a[1]["affinity"] == pytest.approx(0.5 * (-np.log([0.9, 0.4]).mean() - np.log(0.8))) and a[2]["affinity"] == pytest.approx(-0.5 * np.log(0.9)) and a[3]["affinity"] == 0
    assert a[1]["total"] == pytest.approx(a[1]["loss"] + 2 * a[1]["affinity"])


@pytest.mark.parametrize("seed", [1, 2])
def test_compound(spark, seed):
    x, p, t, g, ok = data(seed)
    p = p.copy()
    if seed == 2:
        p[:, 2] = 0.0  # a class that is nowhere
    rows = frame(spark, x, p, t, g, ok)
    ce = rows.groupBy("g").agg(L.cross_entropy(P, "t").alias("ce"))
    interior = spark.createDataFrame([(k, c, 10, 3 * c) for k in (1, 2, 3) for c in (1, 2, 3)], "g long, cls long, n long, interior long")
    got = {r["g"]: r for r in L.compound(L.sums_by(rows, ["g"], P, "t"), ["g"], ce, interior, (1.0, 0.35, 0.05), 0.2, 0.8, [2, 3], {2: 3.0}).collect()}
    s = 1e-5
    for k in (1, 2, 3):
        m = g == k
        y, q = np.eye(4)[t[m]], p[m]
        i, pp, tt, p2 = (q * y).sum(0), q.sum(0), y.sum(0), (q * q).sum(0)
        there = (tt > 0) | (pp >= s)
        tv = 1 - (i + s) / (i + 0.2 * (pp - i) + 0.8 * (tt - i) + s)
        w = np.array([0, 0, 3.0, 1.0]) * there
        a = np.where(tt == 0, 0, np.minimum(2 * 3 * np.arange(4) / (10 + s) - 1, 0.8))
        bd = ((p2 + tt - 2 * i + s) / (p2 + tt - (1 + a) * i + s))[1:][there[1:]].mean()
        anchor = -np.log(q[np.arange(len(q)), t[m]]).mean() - dice(q, y)[1:].mean()
        assert (got[k]["dc_ce"], got[k]["tversky"], got[k]["boundary"]) == pytest.approx((anchor, (tv * w).sum() / w.sum(), bd))
        assert got[k]["loss"] == pytest.approx(anchor + 0.35 * got[k]["tversky"] + 0.05 * bd)
    plain = L.compound(L.sums_by(rows, ["g"], P, "t"), ["g"], ce).first()
    assert plain["boundary"] == 0 and plain["loss"] == plain["dc_ce"]


def test_marginal_loss(spark):
    x, p, t, g, ok = data(4, groups=(1, 2))
    known = {1: [True, True, False, True], 2: [True, True, True, True]}
    t = np.where((g == 1) & (t == 2), 0, t)
    rows = frame(spark, x, p, t, g, ok).withColumn("known", F.when(F.col("g") == 1, F.array(*map(F.lit, known[1]))).otherwise(F.array(*map(F.lit, known[2]))))
    r = L.marginal_loss(rows, "g", [f"x{k}" for k in range(4)], "t", "known").first()
    q = p.copy()
    q[g == 1, 0] += p[g == 1, 2]
    ce = -np.log(q[np.arange(len(t)), t]).mean()
    d = np.mean([dice(p[g == k], np.eye(4)[t[g == k]])[c] for k in (1, 2) for c in (1, 2, 3) if known[k][c]])
    assert tuple(r) == pytest.approx((ce, d, ce - d))


def test_patch_scores(spark):
    rows = spark.createDataFrame([(0.5, 1.0, 0.5), (0.7, 0.0, 0.0), (None, None, None)], "iou_f double, recall double, precision double")
    assert tuple(L.patch_scores(rows).first()) == pytest.approx((0.6, 0.5, 0.25, 2 * 0.5 * 0.25 / 0.75))
    assert tuple(L.patch_scores(rows.limit(0)).first()) == (0.0, 0.0, 0.0, 0.0)


@pytest.mark.parametrize(("grow", "shrink"), [(1, 1), (2, 1), (1, 2), (0, 1)])
def test_class_target(spark, grow, shrink):
    rng = np.random.default_rng(8)
    a = np.zeros((9, 8, 10), int)
    a[1:8, 1:7, 1:5], a[1:8, 1:7, 5:9], a[0:3, 0:3, 8:10] = 1, 2, 70
    a[rng.random(a.shape) < 0.01] = 0
    grid = spark.createDataFrame([("v", *map(int, at), int(a[at]), 1) for at in np.ndindex(*a.shape)], "vol string, z long, y long, x long, id long, cls0 long")
    got = np.zeros(a.shape, int)
    for r in N.class_target(grid, "id", ["vol"], grow, shrink).collect():
        got[r["z"], r["y"], r["x"]] = r["cls"]
    if grow:
        assert (got == T.abbc_target(a, grow, shrink)).all()
    touch = np.zeros(a.shape, bool)
    for at in np.argwhere(a > 0):
        for d in N.all26():
            b = tuple(at + d)
            if all(0 <= b[k] < a.shape[k] for k in range(3)) and a[b] > 0 and a[b] != a[tuple(at)] and (a[b] - 1) // 50 == (a[tuple(at)] - 1) // 50:
                touch[tuple(at)] = True
    assert ((got == 2) >= touch).all() and {0, 1, 2} <= set(np.unique(got))
