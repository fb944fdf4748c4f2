"""Router features, edge breaks, kept splits and audited writes on small scenes."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import kernels as K
from gridloom.operators import neighbors as N
from gridloom.operators import router as R
from gridloom.operators import splits as SP
from gridloom.sources import audited as AU
from gridloom.sources import volumes as V


def test_router_features_of_scans_of_different_sizes(spark):
    """Strides follow each scan; a scan without bone has zeros."""
    rng = np.random.default_rng(5)
    given = {1: rng.random((11, 6, 9)) * 400 - 100, 2: rng.random((3, 4, 2)) * 400 - 100, 3: np.zeros((2, 2, 2))}
    spacing = (0.8, 1.0, 1.5)
    v = spark.createDataFrame([(s, *map(int, at), float(a[at])) for s, a in given.items() for at in np.ndindex(*a.shape)], "scan long, z long, y long, x long, v double").repartition(3)
    scans = spark.createDataFrame([(s, *a.shape, *spacing) for s, a in given.items()], "scan long, nz long, ny long, nx long, sz double, sy double, sx double")
    got = {r["scan"]: r for r in R.image_features(v, scans, most=4, planes=2).collect()}
    assert len(R.FEATURES) == 37 and set(got) == {1, 2, 3}
    for s, a in given.items():
        step = [max(-(-n // 4), 1) for n in a.shape]
        small = a[:: step[0], :: step[1], :: step[2]]
        bone = small > 200
        want = dict(zip(("sample_stride_z", "sample_stride_y", "sample_stride_x"), step)) | {"bone_frac_sampled": bone.mean(), "shape_z": a.shape[0], "fov_x": a.shape[2] * 1.5, "hu_p05": np.percentile(a, 5), "hu_p99_5": np.percentile(a, 99.5)}
        if bone.any():
            at = np.argwhere(bone)
            labels, n = K.components(bone, 3)
            sizes = sorted(np.bincount(labels.ravel())[1:], reverse=True)
            want |= {"bone_cc_count": n, "bone_largest_cc_frac": sizes[0] / bone.sum(), "bone_second_cc_frac": sizes[1] / bone.sum() if n > 1 else 0}
            for k, x in enumerate("zyx"):
                box = np.ptp(at[:, k]) + 1
                want |= {f"bone_bbox_frac_{x}": box / small.shape[k], f"bone_bbox_mm_{x}": box * step[k] * spacing[k], f"bone_centroid_frac_{x}": at[:, k].mean() / max(small.shape[k] - 1, 1)}
        else:
            want |= dict.fromkeys(R.BONE[4:], 0)
        assert {k: got[s][k] for k in want} == pytest.approx(want)


def test_family_by_voxels(spark):
    rows = [(1, 4, 5), (1, 1, 5), (2, 4, 4), (2, 2, 5), (3, 0, 9)]
    got = {r["scan"]: tuple(r)[1:] for r in R.family_by_voxels(spark.createDataFrame(rows, "scan long, anatomy long, n long")).collect()}
    assert got == {1: ("femur", 0.5), 2: ("pelvic", 4 / 9), 3: (None, None)}


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_edge_breaks(spark, radius):
    rng = np.random.default_rng(7)
    a = rng.choice([0, 0, 0, 1, 2, 60, 230], (6, 5, 7))
    valid = np.where((a >= 1) & (a <= 200), a, 0)
    want = set()
    for axis in range(3):
        step = [0, 0, 0]
        step[axis] = 1
        inside = [at for at in np.ndindex(*a.shape) if at[axis] + 1 < a.shape[axis]]
        ends = {at: (valid[at], valid[tuple(np.add(at, step))]) for at in inside}
        hit = [at for at, (p, q) in ends.items() if p and q and p != q and (p - 1) // 50 == (q - 1) // 50]
        want |= {(axis, *at) for at, (p, q) in ends.items() if (p or q) and any(max(abs(np.subtract(at, h))) <= radius for h in hit)}
    grid = spark.createDataFrame([("v", *map(int, at), int(a[at])) for at in np.ndindex(*a.shape)], "vol string, z long, y long, x long, id long")
    shapes = spark.createDataFrame([("v", *a.shape)], "vol string, nz long, ny long, nx long")
    got = N.edge_break_targets(grid, "id", shapes, ["vol"], radius).select("axis", "z", "y", "x").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_splits_are_made_kept_and_replaced(spark, tmp_path):
    members = spark.createDataFrame([(f"s{c}_{k}", f"{c:03d}") for c in range(20) for k in range(1 + c % 3)], "sample string, source string")
    first = SP.kept_split(members, f"{tmp_path}/a")
    assert first.done == "made" and SP.leaks(first.split, "source").isEmpty()
    per = first.split.groupBy("sample").agg(F.count_if(F.col("side") == "val").alias("v"), F.count(F.lit(1)).alias("n")).collect()
    assert len(per) == members.count() and {(r["v"], r["n"]) for r in per} == {(1, 5)}
    before = sorted(os.listdir(f"{tmp_path}/a/split"))
    assert SP.kept_split(members, f"{tmp_path}/a").done == "kept" and sorted(os.listdir(f"{tmp_path}/a/split")) == before

    leaking = members.selectExpr("0L fold", "if(sample like '%0', 'val', 'train') side", "sample", "source")
    for _ in range(2):  # what was set aside first stays
        leaking.write.mode("overwrite").parquet(f"{tmp_path}/b/split")
        assert SP.kept_split(members, f"{tmp_path}/b").done == "replaced"
    assert not SP.leaks(spark.read.parquet(f"{tmp_path}/b/leaking"), "source").isEmpty() and SP.leaks(spark.read.parquet(f"{tmp_path}/b/split"), "source").isEmpty()

    alone = members.dropDuplicates(["source"])  # one sample a source: nothing can leak, so even a strange split stays
    alone.selectExpr("0L fold", "explode(array('val', 'train')) side", "sample", "source").write.parquet(f"{tmp_path}/c/split")
    assert SP.kept_split(alone, f"{tmp_path}/c").done == "kept"


def test_case_lock(spark):
    split = spark.createDataFrame([(f, "val" if f == c % 2 else "train", f"s{c}", str(c)) for f in range(2) for c in (7, 12, 1007)], "fold long, side string, sample string, source string")
    got = sorted(map(tuple, SP.locked(split, ["7", "012 "]).collect()))
    assert got == sorted((f, side, f"s{c}", str(c)) for f in range(2) for side in ("train", "val") for c in (7, 12))
    assert SP.locked(split, []) is split
    with pytest.raises(ValueError, match="no samples of 008, 009"):
        SP.locked(split, ["9", "8"])


def test_audited_write(spark, tmp_path):
    """Mirrored and exchanged axes: every voxel keeps its place in space."""
    a = np.arange(24, dtype=float).reshape(2, 3, 4) * 200 - 1500
    direction = {1: (1, 0, 0, 0, 1, 0, 0, 0, 1), 2: (-1, 0, 0, 0, 0, -1, 0, 1, 0)}
    v = spark.createDataFrame([(s, *map(int, at), float(a[at])) for s in direction for at in np.ndindex(*a.shape)], "scan long, z long, y long, x long, v double")
    g = spark.createDataFrame([(s, [4, 3, 2], [1.0, 2.0, 3.0], [10.0, 20.0, 30.0], [float(x) for x in d]) for s, d in direction.items()], "scan long, size array<long>, spacing array<double>, origin array<double>, direction array<double>")
    seen = AU.write_clipped(v, g, str(tmp_path))
    assert seen == {"range": (-1000.0, 2000.0), "voxels": 48, "least": -1000.0, "most": 2000.0, "clipped": 2 * int(((a < -1000) | (a > 2000)).sum())}
    geo = {r["scan"]: r for r in spark.read.parquet(f"{tmp_path}/geometry").collect()}
    assert [geo[s]["source"]["orientation"] for s in (1, 2)] == ["LPS", "RSA"] and {geo[s]["output"]["orientation"] for s in (1, 2)} == {"LPS"}
    assert geo[1]["output"]["origin"] == [10.0, 20.0, 30.0] and geo[2]["output"]["size"] == [4, 2, 3]

    def world(o, at):
        d = np.array(o["direction"]).reshape(3, 3)
        return tuple(np.round(np.array(o["origin"]) + d @ (np.array(at[::-1]) * o["spacing"]), 6).tolist())

    for s in direction:
        want = {world(geo[s]["source"], at): float(np.clip(a[at], -1000, 2000)) for at in np.ndindex(*a.shape)}
        got = {world(geo[s]["output"], (r["z"], r["y"], r["x"])): r["v"] for r in spark.read.parquet(f"{tmp_path}/voxels").where(F.col("scan") == s).collect()}
        assert got == want
    assert np.linalg.det(np.array(geo[2]["output"]["direction"]).reshape(3, 3)) == pytest.approx(1)


def test_image_files_are_read_turned(spark, tmp_path):
    """The same object in two orientations, on disk, lies in the same places once read."""
    a = np.arange(24, dtype=np.int16).reshape(2, 3, 4)
    (tmp_path / "one.mha").write_bytes(V.mha_bytes(a, (1, 2, 3), (10, 20, 30)))
    mirrored = np.ascontiguousarray(a[:, :, ::-1])
    (tmp_path / "two.mha").write_bytes(V.mha_bytes(mirrored, (1, 2, 3), (13, 20, 30), (-1, 0, 0, 0, 1, 0, 0, 0, 1)))
    voxels, geometry = AU.read_lps(spark, str(tmp_path))
    got = {}
    for r in voxels.collect():
        got.setdefault(r["scan"].rsplit("/", 1)[1], {})[r["z"], r["y"], r["x"]] = r["v"]
    assert got["one.mha"] == got["two.mha"] == {at: float(a[at]) for at in np.ndindex(*a.shape)}
    out = {r["scan"].rsplit("/", 1)[1]: r for r in geometry.collect()}
    assert out["two.mha"]["source"]["orientation"] == "RPS" and out["two.mha"]["output"] == out["one.mha"]["output"]


def test_arrays_with_and_without_names(spark, tmp_path):
    a = np.random.default_rng(1).random((2, 3, 2, 4)).astype(np.float32)
    np.save(tmp_path / "plain.npy", a)
    np.savez(tmp_path / "named.npz", other=a * 0, softmax=a)
    got = {}
    for r in V.read_npz(spark, str(tmp_path)).collect():
        got.setdefault(r["path"].rsplit("/", 1)[1], {})[r["c"], r["z"], r["y"], r["x"]] = r["value"]
    assert got["plain.npy"] == got["named.npz"] == {at: float(a[at]) for at in np.ndindex(*a.shape)}
    np.save(tmp_path / "flat.npy", a[0])
    with pytest.raises(Exception, match="four axes"):
        V.read_npz(spark, str(tmp_path)).count()
