"""Distances by planes and lines against all pairs, and the case metrics on scenes with known results."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import distance as D
from gridloom.operators import official as O

CELL = "job long, side string, z long, y long, x long, value long"


def brute(queries, seeds, spacing):
    """Squared distances and the first nearest seed of each query."""
    s = np.asarray(spacing)
    d = (((queries[:, None] - seeds[None]) * s) ** 2).sum(2)
    return np.sqrt(d.min(1)), d.argmin(1)


@pytest.mark.parametrize("seed", range(4))
def test_equals_all_pairs(spark, seed):
    rng = np.random.default_rng(seed)
    spacing = [(1.0, 1.0, 1.0), (0.8, 1.0, 1.5), (2.0, 0.5, 0.5), (1.0, 1.0, 1.0)][seed]
    want, q_rows, s_rows = {}, [], []
    for job in range(4):
        shape = rng.integers(1, 14, 3)
        every = np.argwhere(np.ones(shape, bool)) - [3, 0, 5]
        q = every[rng.random(len(every)) < 0.3]
        s = every[rng.random(len(every)) < (0.02, 0.2, 0.9, 0.5)[job]]
        q, s = (q if len(q) else every[:1]), (s if len(s) else every[-1:])
        side = "ab"[job % 2]
        d, near = brute(q, s, spacing)
        want |= {(job, side, *map(int, c)): (float(x), int(v)) for c, x, v in zip(q, d, near)}
        q_rows += [(job, side, *map(int, c), 0) for c in q]
        s_rows += [(job, side, *map(int, c), k) for k, c in enumerate(s)]
    q, s = spark.createDataFrame(q_rows, CELL).repartition(3), spark.createDataFrame(s_rows, CELL).repartition(2)
    got = {tuple(r)[:5]: (r["distance"], r["nearest"]) for r in D.to_nearest(q.drop("value"), s, ["job", "side"], spacing, "value").collect()}
    assert got.keys() == want.keys()
    for k, (d, v) in want.items():
        assert got[k][0] == pytest.approx(d)
        if seed in (0, 3):  # whole numbers: ties are exact
            assert got[k][1] == v


def test_plane_blocks_and_jobs_without_seeds(spark, monkeypatch):
    rows = [(1, "a", z, 0, x, 7) for z in range(3) for x in range(5)] + [(2, "a", 0, 0, 0, 7)]
    q = spark.createDataFrame(rows, CELL)
    s = spark.createDataFrame([(1, "a", 9, 0, 2, 5), (3, "a", 0, 0, 0, 1)], CELL)
    got = {(r["job"], r["z"], r["x"]): r["distance"] for r in D.to_nearest(q, s, ["job"]).collect()}
    assert len(got) == 16 and got[2, 0, 0] is None and got[1, 2, 2] == 7.0 and got[1, 0, 4] == np.sqrt(85)
    assert D.to_nearest(q.limit(0), s, ["job"]).collect() == []
    assert D.to_nearest(q, s, ["job"]).columns == [*q.columns, "distance"]
    monkeypatch.setattr(D, "BLOCK", 1)
    values = np.random.default_rng(1).random((6, 4))
    best, row = D.least_sums(values, np.arange(6), np.arange(9), 1.0)
    assert (best == ((np.arange(9)[:, None] - np.arange(6)) ** 2)[:, :, None].__add__(values[None]).min(1)).all() and best.shape == row.shape


def test_no_task_holds_a_volume(spark):
    """The two groupings are by plane and by line, beside the job."""
    q = spark.createDataFrame([(1, "a", 0, 0, 0, 0)], CELL)
    plan = D.to_nearest(q, q, ["job", "side"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"FlatMapGroupsInPandas \[job#\w+, side#\w+, z#", plan), plan
    assert re.search(r"FlatMapCoGroupsInPandas \[job#\w+, side#\w+, y#", plan), plan


def test_signed_distances(spark):
    rows = [(j, "", 0, 0, x, int(j == 2 or (j == 1 and x >= 3))) for j in (1, 2, 3) for x in range(6)]
    g = spark.createDataFrame(rows, CELL).withColumn("inside", F.col("value") == 1)
    got = {(r["job"], r["x"]): r["signed"] for r in D.signed_distances(g, ["job"], "inside", (1, 1, 2.0), limit=5.0).collect()}
    assert [got[1, x] for x in range(6)] == [-1.0, -0.8, -0.4, 0.4, 0.8, 1.0]
    assert {got[2, x] for x in range(6)} == {1.0} and {got[3, x] for x in range(6)} == {0.0}


# ------------------------------------------------------------------ case metrics


def grid(spark, gt, pred, scan=1):
    rows = [(scan, *map(int, at), int(gt[tuple(at)]), int(pred[tuple(at)])) for at in np.ndindex(*gt.shape)]
    return spark.createDataFrame(rows, "scan long, z long, y long, x long, gt long, pred long")


def test_a_shifted_cube(spark):
    gt, pred = np.zeros((16, 12, 12), int), np.zeros((16, 12, 12), int)
    gt[2:8, 2:8, 2:8], pred[4:10, 2:8, 2:8] = 1, 2
    gt[10:16, 2:8, 2:8] = pred[10:16, 2:8, 2:8] = 60  # equal masks
    r = {x["anatomy"]: x for x in O.official_metrics(grid(spark, gt, pred), (1.0, 1.0, 1.0), O.Limits(100.0, 100.0, 0.1, 1.0, 5)).collect()}
    assert r[2]["hd95"] == r[2]["assd"] == 0.0 and r[2]["iou"] == r[2]["dice"] == r[2]["local_dice"] == r[2]["topology"] == 1.0
    edge = lambda m: {tuple(c) for c in np.argwhere(m) if any(tuple(np.add(c, d)) not in {tuple(i) for i in np.argwhere(m)} for d in D.FACES)}
    a, b = (np.array(sorted(edge(m))) for m in (gt == 1, pred == 2))
    d = np.concatenate([brute(a, b, (1, 1, 1))[0], brute(b, a, (1, 1, 1))[0]])
    assert r[1]["hd95"] == pytest.approx(np.percentile(d, 95)) and r[1]["assd"] == pytest.approx(d.mean())
    assert r[1]["iou"] == 0.5 and r[1]["dice"] == pytest.approx(2 / 3)
    assert r[1]["local_dice"] == pytest.approx(2 * 144 / (216 + 180))  # of the prediction, the plane within 1 mm of the truth counts


def test_limits_are_volumes(spark):
    """With 0.5 mm3 a voxel, 8 voxels are 4 mm3; components go by faces, within an id."""
    gt, pred = np.zeros((8, 6, 6), int), np.zeros((8, 6, 6), int)
    gt[0:2, 0:2, 0:2] = 1  # 4 mm3
    gt[4, 0:2, 0:3] = 2  # 3 mm3: too small a fragment
    gt[6, 5, 0:5], gt[7, 5, 5] = 3, 3  # 3 mm3 in all, components of 2.5 and 0.5
    pred[0:2, 0:2, 0:2], pred[4, 0:2, 0:3] = 9, 8
    spacing = (0.5, 1.0, 1.0)
    r = O.official_metrics(grid(spark, gt, pred), spacing, O.Limits(3.5, 0.0, 0.1, 1.0)).first()
    assert (r["n_gt"], r["n_pred"], r["tp"], r["fp"], r["fn"]) == (1, 2, 1, 1, 0)
    r = O.official_metrics(grid(spark, gt, pred), spacing, O.Limits(0.0, 3.5, 0.1, 1.0)).first()
    assert (r["n_gt"], r["n_pred"]) == (1, 1)
    r = O.official_metrics(grid(spark, gt, pred), spacing, O.Limits(0.0, 2.5, 0.1, 1.0)).first()
    assert (r["n_gt"], r["n_pred"], r["tp"], r["fn"]) == (3, 2, 2, 1)
    assert r["dice"] == pytest.approx(2 / 3) and r["hd95"] == r["assd"] == 0.0  # unmatched ones have no distances


def test_scan_without_predictions_and_empty(spark):
    gt = np.zeros((4, 4, 4), int)
    gt[:2] = 1
    g = grid(spark, gt, gt * 0).unionByName(grid(spark, gt * 0, gt, 2))
    limits = O.Limits(0.0, 0.0, 0.1, 5.0)
    rows = O.official_metrics(g, limits=limits).collect()
    assert [(r["scan"], r["anatomy"], r["hd95"], r["assd"], r["dice"], r["f1"], r["fn"]) for r in rows] == [(1, 1, None, None, 0.0, 0.0, 1)]
    macro = O.official_macro(O.official_metrics(g, limits=limits)).first()
    assert macro["anatomies"] == 1 and macro["hd95"] is None and macro["split_error"] == 0
    assert O.official_metrics(g.limit(0)).collect() == []
