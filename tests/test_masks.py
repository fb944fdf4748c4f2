"""Exclusive masks, boundary shares, boxes, orientation and report lines, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import scalar as S
from gridloom.operators import aggregates as A
from gridloom.operators import losses as L
from gridloom.operators import masks as MK
from gridloom.operators import neighbors as N
from gridloom.operators import reports as RP

CELLS = "vol long, z long, y long, x long"


def cells(mask, *more):
    return [(*more, *map(int, p)) for p in np.argwhere(mask)]


def brute_opened(mask):
    out = np.zeros_like(mask)
    nz, ny, nx = mask.shape
    for z in range(nz - 1):
        for y in range(ny - 1):
            for x in range(nx - 1):
                if mask[z : z + 2, y : y + 2, x : x + 2].all():
                    out[z : z + 2, y : y + 2, x : x + 2] = True
    return out


def test_opening_equals_brute_force_in_each_volume(spark):
    r = np.random.default_rng(3)
    masks = {v: r.random((6, 7, 8)) < share for v, share in ((0, 0.7), (4, 0.85), (5, 0.2))}
    rows = [row for v, m in masks.items() for row in cells(m, v)]
    got = sorted(map(tuple, MK.opened(spark.createDataFrame(rows, CELLS), ["vol"]).collect()))
    assert got == sorted(row for v, m in masks.items() for row in cells(brute_opened(m), v))


def test_masks_part_the_grid_and_lose_small_parts(spark):
    """Two bricks of 32 and 8 voxels of one winner in one volume, one of 32 across a tile's border in another, a thin bar, and ties with the background."""
    p = np.zeros((2, 3, 10, 8, 8))  # volume, channel
    p[:, 0] = 0.4
    p[0, 1, 0:2, 0:4, 0:4], p[0, 1, 6:8, 6:8, 6:8], p[0, 2, 9, :, 0] = 0.9, 0.9, 0.9
    p[1, 2, 3:5, 2:6, 2:6], p[1, 1, 0:2, 0:4, 0:4] = 0.9, 0.4
    rows = [(v, *at, *[float(p[(v, c, *at)]) for c in range(3)]) for v in (0, 1) for at in np.ndindex(10, 8, 8)]
    grid = spark.createDataFrame(rows, CELLS + ", c0 double, c1 double, c2 double")
    run = lambda least: {(r["vol"], r["anatomy"]): r["count"] for r in MK.argmax_masks(grid, ["c0", "c1", "c2"], 4, (8, 8), least).groupBy("vol", "anatomy").count().collect()}
    assert run(9) == {(0, 1): 32, (1, 2): 32}
    assert run(8) == {(0, 1): 40, (1, 2): 32}
    assert run(33) == {}
    assert MK.argmax_masks(grid.where("false"), ["c0", "c1", "c2"], 4, (8, 8), 1).count() == 0


def test_alpha_follows_the_share_of_interior_voxels(spark):
    t = np.zeros((5, 6, 7), int)
    t[0:4, 1:5, 1:6], t[2, 2, 2] = 1, 2
    faces = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]

    def inside(p):
        near = [tuple(int(a + b) for a, b in zip(p, o)) for o in faces]
        return all(all(0 <= q[a] < t.shape[a] for a in range(3)) and t[q] == t[p] for q in near)

    rows = [(*at, int(t[at])) for at in np.ndindex(*t.shape)]
    got = {r["t"]: (r["n"], r["interior"]) for r in N.interior_counts(spark.createDataFrame(rows, "z long, y long, x long, t long"), "t").collect()}
    assert got == {k: (int((t == k).sum()), sum(inside(at) for at in np.ndindex(*t.shape) if t[at] == k)) for k in (0, 1, 2)}
    sums = spark.createDataFrame([(1, 30.0, 40.0, 79.0, 20.0), (2, 0.5, 1.0, 1.0, 0.5), (3, 0.0, 2.0, 0.0, 1.0), (4, 0.0, 0.0, 0.0, 0.0)], "cls long, inter double, pp double, tt double, p2 double")
    counts = spark.createDataFrame([(k, *v) for k, v in got.items()], "cls long, n long, interior long")
    alpha = {r["cls"]: r["alpha"] for r in L.boundary_overlap(sums, counts).collect()}
    # a class of surface alone has -1, one that only the probabilities know has 0, and one that nothing knows goes
    assert alpha[1] == pytest.approx(2 * got[1][1] / (got[1][0] + 1e-5) - 1) and alpha[2] == -1.0 and alpha[3] == 0.0 and set(alpha) == {1, 2, 3}


def test_boxes_are_clamped_and_turn_into_ranges(spark):
    g = spark.createDataFrame([(0, 2, 3, 5), (4, 2, 7, 5), (4, 0, 0, 0)], "z long, y long, x long, label long")
    (box,) = N.label_boxes(g, "label", pad=2, extent=(6, 8, 8)).collect()
    assert tuple(box) == (5, 0, 6, 0, 5, 1, 8)
    (free,) = N.label_boxes(g, "label", pad=2).collect()
    assert tuple(free) == (5, -2, 7, 0, 5, 1, 10)
    r = N.label_boxes(g, "label").select(S.box_ranges([F.col(f"{a}{i}") for a in "zyx" for i in (0, 1)]).alias("r")).first()["r"]
    assert [tuple(e) for e in r] == [(0, 5), (2, 3), (3, 8)]


def test_fragments_name_ids_beyond_the_blocks_unknown(spark):
    g = spark.createDataFrame([(0, 0, 0, 1), (3, 1, 2, 1), (5, 5, 5, 200), (6, 6, 6, 201), (7, 7, 7, 0)], "z long, y long, x long, label long")
    assert sorted((r["label"], r["name"], r["n"], r["z0"], r["z1"]) for r in A.fragments(g, "label").collect()) == [(1, "Sacrum", 2, 0, 4), (200, "Femur", 1, 5, 6), (201, "Unknown", 1, 6, 7)]


def test_axes_are_permuted_and_flipped(spark):
    rows = spark.createDataFrame([(c, 1, 2, 3) for c in ("LPS", "RAI", "SLP", "AIR", "LLL")], "code string, x long, y long, z long")
    got = {r[0]: tuple(r)[1:] for r in rows.select("code", *S.to_lps(F.col("code"), [F.col(a) for a in "xyz"], [F.lit(10), F.lit(20), F.lit(30)])).collect()}
    assert got == {"LPS": (1, 2, 3), "RAI": (8, 17, 26), "SLP": (2, 3, 1), "AIR": (26, 8, 17), "LLL": (1, None, None)}


def test_a_missing_number_is_no_equal_geometry(spark):
    d = spark.createDataFrame([([1.0, 2.0], [1.0, 2.0 + 5e-6]), ([1.0, 2.0], [1.0, None]), ([1.0, 2.0], [1.0, 2.1])], "a array<double>, b array<double>")
    side = lambda c: {"size": F.array(F.lit(3)), "spacing": F.col(c), "direction": F.array(F.lit(1.0)), "origin": F.array(F.lit(0.0))}
    assert [r[0] for r in d.coalesce(1).select(S.same_geometry(side("a"), side("b"))).collect()] == [True, False, False]


def test_an_unknown_key_fails_by_name(spark):
    d = spark.createDataFrame([("a",), ("nope",)], "key string").withColumn("r", F.struct(F.lit(5).alias("a"), F.lit("x").alias("b")))
    assert d.where("key = 'a'").select(S.by_key(F.col("r"), ["a", "b"], F.col("key"))).first()[0] == "5"
    with pytest.raises(Exception, match="unknown key: nope"):
        d.select(S.by_key(F.col("r"), ["a", "b"], F.col("key"))).collect()


def test_report_lines_and_names(spark):
    rows = spark.createDataFrame([(533, "b", 2, 0.5, None), (532, None, 3, float("nan"), 0.25)], "dataset long, name string, n long, dice double, iou double")
    lines = [r["value"] for r in RP.summary_lines(rows).orderBy("k", "dataset").collect()]
    assert lines[1:] == ["", "- Ds532 `None`: n=3, Dice=n/a, IoU=0.2500", "- Ds533 `b`: n=2, Dice=0.5000, IoU=n/a"]
    paths = spark.createDataFrame([("/eval_x/eval_a.eval_b.json",), ("plain",)], "path string")
    assert sorted(r["text"] for r in RP.dashboards(paths, "/o", "d").collect()) == ["/o/visual_a.eval_b_d.txt", "/o/visual_plain_d.txt"]
