"""Dataset building, guards and models read through Spark."""

import pickle

import pytest

from gridloom.operators import datasets as D
from gridloom.operators import gate as G

GT = "scan long, z long, y long, x long, gt long, kind string"


def test_semantic_labels_and_their_check(spark):
    truth = spark.createDataFrame([(1, 0, 0, k, g, kind) for k, (g, kind) in enumerate([(0, "p"), (50, "p"), (51, "p"), (199, "p"), (151, "f"), (1, "f"), (250, "p")])], GT)
    label = lambda df: [r["label"] for r in df.orderBy("x").collect()]
    assert label(D.semantic(truth)) == [0, 1, 2, 4, 4, 1, 0]
    assert label(D.semantic(truth, {"p": [1, 2, 3], "f": [4]})) == [0, 1, 2, 0, 4, 0, 0]
    assert D.require_known(D.semantic(truth), [0, 1, 2, 3, 4]).count() == 7
    with pytest.raises(ValueError, match="unknown labels: 2 in 1, 4 in 1"):
        D.require_known(D.semantic(truth), [0, 1, 3])
    assert D.unknown_labels(D.semantic(truth).withColumn("label", truth["gt"] * 0).selectExpr("scan", "nullif(label, 0) label"), [0]).collect() == [(1, None)]


def test_samples_and_targets(spark):
    rows = [(7, z, 1, x, g, "p") for z, x, g in [(2, 0, 3), (2, 1, 3), (3, 0, 20), (5, 5, 60), (0, 0, 0)]] + [(1234, 0, 0, 0, 160, "f")]
    truth = spark.createDataFrame(rows, GT)
    scans = spark.createDataFrame([(7, 8, 4, 6), (1234, 1, 1, 1), (9, 2, 2, 2)], "scan long, nz long, ny long, nx long")
    s = {r["sample"]: r for r in D.samples(truth, scans, pad=1, prefix="C").collect()}
    assert set(s) == {"C_007_Sacrum", "C_007_LeftHip", "C_1234_Femur"}
    assert [s["C_007_Sacrum"][k] for k in ("z0", "z1", "y0", "y1", "x0", "x1", "voxels", "ids")] == [1, 5, 0, 3, 0, 3, 3, 2]
    t = sorted(tuple(r) for r in D.sample_targets(truth, D.samples(truth, scans, pad=1, prefix="C")).collect())
    assert t == [("C_007_LeftHip", 1, 1, 1, 1), ("C_007_Sacrum", 1, 1, 0, 1), ("C_007_Sacrum", 1, 1, 1, 1), ("C_007_Sacrum", 2, 1, 0, 2), ("C_1234_Femur", 0, 0, 0, 1)]


def test_guard_names_what_is_missing(spark):
    want = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "k string, j long")
    there = spark.createDataFrame([("a", 1, 9), ("d", 5, 9)], "k string, j long, v long")
    with pytest.raises(FileNotFoundError, match="the cache lacks 2 of the wanted: b/1, c/2"):
        D.require_present(want, there, ["k", "j"], "the cache")
    assert [tuple(r) for r in D.require_present(want.where("k = 'a'"), there, ["k", "j"], "the cache").collect()] == [("a", 1, 9)]


class Flat:
    def predict(self, x):
        return [0.0] * len(x)


def test_models_are_read_through_spark(spark, tmp_path):
    good = {"models": {"delta_merge": Flat()}, "feature_names": [], "policy": {}, "quality_guards": {}}
    for name, payload in (("good", good), ("short", {"models": {}}), ("deaf", good | {"models": {"delta_merge": 3}})):
        (tmp_path / name).write_bytes(pickle.dumps(payload))
    assert G.load_payload(spark, f"file://{tmp_path}/good")["models"]["delta_merge"].predict([1, 2]) == [0.0, 0.0]
    with pytest.raises(KeyError, match="feature_names, policy, quality_guards"):
        G.load_payload(spark, f"{tmp_path}/short")
    with pytest.raises(TypeError, match="delta_merge"):
        G.load_payload(spark, f"{tmp_path}/deaf")
