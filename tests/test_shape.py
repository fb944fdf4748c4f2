"""Shape features by relations against arrays, candidate by candidate."""

import numpy as np
import pytest

from gridloom.operators import gate as G
from gridloom.operators import shape as S
from gridloom.operators.surfaces import SHAPE_FEATURES, candidate_features


@pytest.mark.parametrize("spacing", [(1.0, 1.0, 1.0), (0.8, 1.0, 1.5)])
def test_equal_to_arrays(spark, spacing):
    rng = np.random.default_rng(3)
    rows, blocks = [], {}
    for vol in (1, 2):
        shape = (9, 7, 8)
        base = np.where(rng.random(shape) < 0.8, 1 + (np.arange(8)[None, None, :] > 4) * 59, 0) * np.ones(shape, int)
        proposal = np.where(rng.random(shape) < 0.9, 1 + (np.arange(9)[:, None, None] // 3) + np.where(base == 60, 50, 0), 0)
        ct = rng.normal(300, 100, shape).round(3)
        blocks[vol] = base, proposal, ct
        rows += [(vol, *map(int, at), int(base[at]), int(proposal[at]), float(ct[at])) for at in np.ndindex(*shape)]
    grid = spark.createDataFrame(rows, "vol long, z long, y long, x long, base long, proposal long, ct double").repartition(3)
    found, _ = G.candidates(grid, 5)
    want = found.unionByName(found.withColumn("invert", ~found["invert"]).withColumn("proposal_id", found["proposal_id"])).select("vol", "source_id", "proposal_id", "invert")
    plain, turned = want.where("NOT invert"), want.where("invert")
    seen = 0
    for some in (plain, turned):
        flags = {(r["vol"], r["source_id"], r["proposal_id"]): r["invert"] for r in some.collect()}
        for r in S.shape_features(grid, some, spacing, planes=4).collect():
            base, proposal, ct = blocks[r["vol"]]
            source = base == r["source_id"]
            piece = source & ((proposal == r["proposal_id"]) != flags[r["vol"], r["source_id"], r["proposal_id"]])
            assert {k: r[k] for k in SHAPE_FEATURES} == pytest.approx(candidate_features(source, piece, ct, spacing))
            seen += 1
    assert seen >= 8


def test_nothing(spark):
    grid = spark.createDataFrame([(1, 0, 0, 0, 1, 1, 5.0)], "vol long, z long, y long, x long, base long, proposal long, ct double")
    found, _ = G.candidates(grid, 1)
    assert S.shape_features(grid, found).collect() == [] and G.with_features(grid, found).collect() == []
