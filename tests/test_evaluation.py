"""Evaluation drivers on scenes with known results."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import evaluation as E
from gridloom.operators import official as O

SAID = "sample long, z long, y long, x long, p0 double, p1 double"


def test_held_out_samples_are_scored_alone(spark):
    """Two samples of one scan: a perfect one on a grid of half the size, and one that is too loose; a third has no prediction."""
    gt = np.zeros((12, 8, 8), int)
    gt[2:6, 2:6, 2:6], gt[8:10, 2:6, 2:6], gt[10:12, 2:6, 2:6] = 1, 51, 151
    truth = spark.createDataFrame([(3, *map(int, at), int(gt[at])) for at in np.ndindex(*gt.shape)], "scan long, z long, y long, x long, gt long")
    samples = spark.createDataFrame([(10, 3, 1), (11, 3, 2), (12, 3, 4)], "sample long, scan long, anatomy long")
    scans = spark.createDataFrame([(3, 12, 8, 8)], "scan long, nz long, ny long, nx long")
    box = (4, 4, 4)  # of sample 10 without padding; the model's grid has the corners in the same places
    rows = [(10, *at, 0.1, 0.6) for at in np.ndindex(2, 2, 2)] + [(11, *at, 0.4, 0.6) for at in np.ndindex(8, 8, 8)]
    said = spark.createDataFrame(rows, SAID)
    seen = []

    def decode(regions):
        seen.append(regions)
        return regions.where("p1 > 0.5").selectExpr("sample", "z", "y", "x", "1 piece")

    out = {r["sample"]: r for r in E.held_out(samples, truth, scans, said, ["p0", "p1"], decode, limits=O.Limits(0.0, 0.0, 0.1, 5.0), pad=0).collect()}
    assert seen[0].where("sample = 10").count() == np.prod(box) and seen[0].where("sample = 11").isEmpty()
    assert seen[0].select(F.max(F.abs(F.col("p0") + F.col("p1") - 1))).first()[0] < 1e-9
    assert out[10]["decoded"] and out[10]["dice"] == out[10]["f1"] == 1.0 and out[10]["hd95"] == 0.0 and out[10]["support"] == 8 / 64
    assert not out[11]["decoded"] and out[11]["support"] == 16.0 and out[11]["dice"] == 0.0 and out[11]["hd95"] is None
    assert not out[12]["decoded"] and out[12]["support"] is None and out[12]["recall"] == 0.0
    few = E.held_out(samples, truth, scans, said, ["p0", "p1"], decode, limits=O.Limits(1000.0, 0.0, 0.1, 5.0), pad=0).collect()
    assert {(r["dice"], r["merge_error"]) for r in few} == {(None, 0)}


def test_boundary_evaluation(spark, tmp_path):
    """A perfect scan, one whose decoder joins two fragments, and one without any target."""
    rows = []
    for scan in (1, 2, 3):
        for x in range(12):
            gt = 0 if scan == 3 else 1 if x < 5 else 2 if x < 10 else 0
            target = 0 if gt == 0 else 2 if x in (4, 5) else 4
            pred = target if scan != 2 else 4 if gt else 0
            rows.append((scan, 0, 0, x, gt, target, pred, gt if scan == 1 else 7 if gt else 0))
    grid = spark.createDataFrame(rows, "scan long, z long, y long, x long, gt long, target long, pred long, decoded long")
    out = E.boundary(grid)
    got = {r["scan"]: r for r in out.collect()}
    assert (got[1]["iou_f"], got[1]["merged"], got[1]["support_dice"], got[1]["support_hd95"], got[1]["barrier_fbeta"], got[1]["seeds"]) == (1.0, 0, 1.0, 0.0, 1.0, 8)
    assert (got[2]["iou_f"], got[2]["merged"], got[2]["barrier_recall"], got[2]["barrier_ratio"], got[2]["support_dice"]) == (0.5, 2, 0.0, 0.0, 1.0)
    assert (got[3]["iou_f"], got[3]["support_dice"], got[3]["support_hd95"], got[3]["support_nsd"], got[3]["seeds"]) == (None, 1.0, 0.0, 1.0, 0)
    s = E.boundary_summary(out).first()
    assert (s["scans"], s["iou_f_mean"], s["iou_f_min"], s["missing_seeds"]) == (3, 0.75, 0.5, 1) and s["barrier_recall_mean"] == pytest.approx(1 / 3)
    E.write_report(out, E.boundary_summary(out), f"{tmp_path}/r")
    part = next(f for f in os.listdir(f"{tmp_path}/r/summary") if f.startswith("part"))
    assert json.loads(open(f"{tmp_path}/r/summary/{part}").read())["scans"] == 3
    assert spark.read.json(f"{tmp_path}/r/rows").count() == 3
