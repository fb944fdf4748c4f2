import numpy as np
import pytest

from gridloom.operators import decode as D
from gridloom.operators import decode_targets as DT
from gridloom.operators import heal as H
from gridloom.operators import surfaces as SU
from gridloom.operators import targets as T


def world(shape, **slabs):
    """Labels 1, 2 ... of stretches along the second axis, inside a margin of one voxel; and class fields that say border there, background elsewhere."""
    labels = np.zeros(shape, int)
    for k, (lo, hi) in enumerate(slabs.values(), 1):
        labels[1:-1, lo:hi, 1:-1] = k
    p = np.zeros((4, *shape))
    p[0], p[1] = labels == 0, 0.7 * (labels > 0)
    return labels, p


def count(labels):
    return len(np.unique(labels[labels > 0]))


def test_beside_others_and_inner_by_definition():
    r = np.random.default_rng(3)
    labels = r.integers(0, 3, (5, 6, 7)) * (r.random((5, 6, 7)) > 0.6)
    mask = r.random(labels.shape) > 0.2
    near, inside = H.beside_others(labels, 2), H.inner(mask, labels)
    for at in np.ndindex(labels.shape):
        around = [tuple(np.add(at, o)) for o in np.ndindex(5, 5, 5) if sum((k - 2) ** 2 for k in o) <= 4]
        around = [tuple(int(x) - 2 for x in q) for q in around]
        others = {labels[q] for q in around if all(0 <= x < n for x, n in zip(q, labels.shape))} - {0, labels[at]}
        assert near[at] == (labels[at] > 0 and bool(others))
        steps = [tuple(np.add(at, d)) for d in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))]
        assert inside[at] == (mask[at] and all(all(0 <= x < n for x, n in zip(q, labels.shape)) and mask[q] and labels[q] == labels[at] for q in steps))


@pytest.mark.parametrize("seed", range(4))
def test_the_queue_merges_as_asking_all_pairs_again_does(seed):
    r = np.random.default_rng(seed)
    labels = r.integers(0, 9, (4, 5, 6))
    weight = r.random(labels.shape).round(1)

    def judge(out, a, b):
        gap = 1 - abs(weight[out == a].mean() - weight[out == b].mean())
        return {"left": a, "right": b, "score": round(gap, 1)} if gap > 0.75 else None

    want, steps = labels.copy(), []
    while True:
        found = [e for a, around in H.neighbours(want, 1).items() for b in around if b > a and (e := judge(want, a, b))]
        if not found:
            break
        e = min(found, key=lambda e: (-e["score"], e["left"], e["right"]))
        want[want == e["right"]] = e["left"]
        steps.append((e["left"], e["right"]))
    out, events = H.merge_best(labels, judge, 1, 99)
    assert [(e["left"], e["right"]) for e in events] == steps and (out == np.unique(want, return_inverse=True)[1].reshape(out.shape)).all()


def test_a_wall_that_no_neighbour_explains_cuts():
    labels, p = world((16, 40, 14), whole=(2, 38))
    p[2, :, 17:20] = 0.95 * (labels[:, 17:20] > 0)
    out, report = H.refine(labels, p, passes=2)
    assert count(out) == 2 and [e["pieces"] for e in report["splits"]] == [2] and (out > 0).sum() == (labels > 0).sum()
    assert len(np.unique(out[:, 5][labels[:, 5] > 0])) == 1 and out[8, 5, 7] != out[8, 30, 7]
    # too little of it; pieces too small; and a neighbour that explains it
    few = p.copy()
    few[2] = 0
    few[2, 7:9, 17:20, 6:8] = 0.95
    assert not H.refine(labels, few, passes=2)[1]["splits"]
    assert not H.refine(labels, p, passes=2, least_piece=3000)[1]["splits"]
    both, p = world((16, 40, 14), left=(2, 18), right=(18, 38))
    p[2, :, 17:19] = 0.95 * (both[:, 17:19] > 0)
    out, report = H.refine(both, p, passes=2)
    assert count(out) == 2 and not report["splits"] and not report["merges"]


def test_pairs_merge_where_no_boundary_stands():
    labels, p = world((9, 30, 9), a=(1, 10), b=(10, 20), c=(20, 29))
    out, report = H.refine(labels, p, passes=0)
    assert count(out) == 1 and len(report["merges"]) == 2
    p[2, :, 18:22] = 0.9 * (labels[:, 18:22] > 0)
    out, report = H.refine(labels, p, passes=0)
    assert count(out) == 3 and not report["merges"]  # a boundary in sight of a pair counts for it, wherever it stands


def test_filling_changes_no_instance():
    labels, _ = world((7, 20, 7), a=(2, 6), b=(12, 17))
    mask = np.zeros(labels.shape, bool)
    mask[2:5, 4:14, 2:5] = True
    out, filled = H.fill_mask(labels, mask)
    assert (out[labels > 0] == labels[labels > 0]).all() and filled == (mask & (labels == 0)).sum() == (out > 0).sum() - (labels > 0).sum()


def agreeing(labels, ranges=3):
    a = np.zeros((9, *labels.shape))
    a[: 3 * ranges] = 0.8
    return a


@pytest.mark.parametrize(
    "why, fields, options",
    [
        ("boundary", {2: 0.9}, {"least_gain": 0.5}),
        ("candidate_size", {}, {"least_mm3": 10_000.0}),
        ("core_veto", {3: 0.99}, {"small_veto": True}),
        ("border_veto", {}, {"small_veto": True, "border_veto": 0.2}),
        ("affinity", {}, {"ranges": 2}),
        (None, {}, {}),
        (None, {}, {"ranges": 2, "small_strict": False}),
        (None, {}, {"ranges": 2, "small_mm3": 50.0}),
    ],
)
def test_reasons_against_a_merge(why, fields, options):
    """Of two instances of 441 and 539 voxels: what holds them apart, one reason at a time."""
    options = dict(options)
    labels, p = world((9, 22, 9), a=(1, 10), b=(10, 21))
    for channel, value in fields.items():
        p[channel] = value * (labels > 0)
    a = agreeing(labels, options.pop("ranges", 3))
    out, report = H.progressive_merge(labels, p, a, **{"least_mm3": 10.0, "small_mm3": 1000.0, **options})
    assert (count(out), report["accepted"]) == ((2, 0) if why else (1, 1))
    assert {k for k, n in report["rejected"].items() if n} == ({why} if why else set())


def test_one_round_of_mutual_best_pairs():
    labels, p = world((9, 41, 9), a=(1, 11), b=(11, 21), c=(21, 31), d=(31, 40))
    a, options = agreeing(labels), {"least_mm3": 1.0}
    one = H.progressive_merge(labels, p, a, mutual=True, **options)
    many = H.progressive_merge(labels, p, a, **options)
    assert (count(many[0]), many[1]["accepted"]) == (1, 3)
    merged = {x for e in one[1]["events"] for x in (e["left"], e["right"])}
    assert one[1]["accepted"] == len(merged) // 2 and count(one[0]) == 4 - one[1]["accepted"] > 1


def test_soft_merges_need_border_and_agreement():
    labels, p = world((9, 30, 9), a=(1, 10), b=(10, 20), c=(20, 29))
    assert H.soft_merge(labels, p, agreeing(labels))[1]["accepted"] == 2
    out, report = H.soft_merge(labels, p, agreeing(labels, 1))
    assert count(out) == 3 and report["affinity"] == report["examined"] == 2
    p[2] = 0.5 * (labels > 0)
    assert H.soft_merge(labels, p, agreeing(labels))[1]["boundary"] == 2


def test_conservative_splits_ask_for_volume_core_and_affinity():
    labels, p = world((16, 40, 14), whole=(2, 38))
    p[3, 4:12, 4:36, 4:10] = 0.9
    p[2, :, 17:20] = 0.95 * (labels[:, 17:20] > 0)
    apart = np.full((9, *labels.shape), 0.2)
    split = lambda a=apart, **k: H.conservative_split(labels, p, a, **{"least_mm3": 500.0, **k})
    out, report = split()
    assert count(out) == 2 and report["accepted"] == 1
    assert split(least_mm3=4000.0)[1]["rejected"]["pieces"] == 1 and split(least_core=10_000)[1]["rejected"]["core"] == 1
    assert split(1 - apart)[1]["rejected"]["affinity"] == 1 and split(absolute=10_000, relative=2.0)[1]["rejected"]["boundary"] == 1


def column(**broken):
    """A column of border with a core at either end, all affinities high but for the named ranges'."""
    p = np.zeros((4, 8, 34, 8))
    p[1] = 1
    for y in (1, 29):
        p[:, 2:6, y : y + 4, 2:6] = np.array([0, 0, 0, 1.0])[:, None, None, None]
    a = np.full((9, 8, 34, 8), 0.97)
    for name in broken:
        a[list(D.RANGES[name])] = 0.02
    return p, a


def test_far_ranges_veto_what_near_ones_join():
    free = {"least": 1, "least_pairs": 1}
    p, a = column()
    whole = D.multirange(p, a, **free)
    assert count(whole[0]) == 1 and (whole[0] == D.affinity_agglomerate(p, a, 0.75, 1)).all()
    for name in ("mid", "long"):
        p, a = column(**{name: True})
        assert count(D.affinity_agglomerate(p, a, 0.75, 1)) == 1
        out, report = D.multirange(p, a, **free)
        assert count(out) > 1 and report[f"{name}_veto"] > 0
        out, report = D.multirange(p, a, **free, **{name: False})
        assert count(out) == 1 and report[f"{name}_veto"] == 0


def test_cores_seed_instances_and_nothing_comes_of_background():
    p, _ = column()
    assert count(D.core_seed(p, least=50)) == 2 and count(D.core_seed(p, least=1100)) == 0 and count(D.core_seed(p, least=50, ratio=1.5)) <= 1
    p[:] = 0
    p[0] = 1
    none = [D.core_seed(p), D.agglomerate(p), D.multirange(p, np.ones((9, *p.shape[1:])))[0]]
    assert not any(x.any() for x in none)


def test_two_small_merge_rules():
    labels = np.array([[[1, 1, 1, 2, 3, 3, 3, 3]]])
    assert D.drop_small(labels, 3).ravel().tolist() == [1, 1, 1, 1, 2, 2, 2, 2]
    assert D.absorb(labels, np.array([1, 2, 3])).max() == 0
    assert D.merge_small_by_component(labels, 100).ravel().tolist() == labels.ravel().tolist()
    assert D.merge_small_by_component(labels, 3).ravel().tolist() == [1, 1, 1, 1, 2, 2, 2, 2]


def test_fusion_never_crosses_base_borders():
    r = np.random.default_rng(0)
    base = np.ones((6, 6, 12), int)
    base[:, :, 6:] = 2
    p, a = r.dirichlet(np.ones(4), (6, 6, 12)).transpose(3, 0, 1, 2), r.random((9, 6, 6, 12))
    out = D.fuse(base, p, a, least=4, least_ridge=2, seed_core=0.2, seed_ridge=0.9)
    assert (out > 0).all() and not set(np.unique(out[base == 1])) & set(np.unique(out[base == 2]))


def test_targets_have_one_core_each_and_decode_back():
    inst = np.zeros((14, 14, 24), int)
    inst[2:12, 2:12, 2:12] = 1
    inst[2:12, 2:12, 12:22] = 2
    barrier, audit = T.barrier_target(inst, shell=2.0)
    assert audit["external_inside"] == audit["barrier_outside"] == 0 and not audit["several"] and set(np.unique(barrier)) == {0, 1, 2, 3, 4}
    for profile in ("hard_barrier", "geodesic_marker", "geodesic_marker_v2"):
        out = DT.barrier(barrier, profile)
        assert count(out) == 2 and (out[inst == 1] == out[3, 3, 3]).mean() > 0.95
    for profile in T.V5_PROFILES:
        v5 = T.v5_target(inst, profile=profile, body=2.0)
        assert count(DT.markers_v5(v5)[0]) == 2
        assert count(DT.markers_v5(v5, healed=True, least_core=5)[0]) == 2
    official, info = T.official_target(inst)
    assert T.audit_official(inst, official)["ok"] and T.official_target(inst, dynamic=(2, 12))[1]["radii"].keys() == {1, 2}
    semantic = (inst > 0).astype(int)
    assert set(np.unique(DT.official(semantic, official, least_core=1, least=50))) == {0, 1, 2}
    abbc = T.abbc_target(inst, 1, 1)
    assert set(np.unique(abbc)) == {0, 1, 2, 3} and (abbc[inst == 0] == 0).all() and (abbc[5, 5, 11:13] == 2).all()
    with pytest.raises(ValueError):
        T.v5_target(inst, profile="none")
    with pytest.raises(ValueError):
        DT.barrier(barrier, "none")


def test_surface_scores():
    a = np.zeros((8, 8, 8), bool)
    a[2:6, 2:6, 2:6] = True
    assert SU.surface_scores(a, a) == {"dice": 1.0, "hd95": 0.0, "assd": 0.0, "nsd": 1.0}
    assert SU.surface_scores(a, a & False)["hd95"] is None and SU.surface_scores(a & False, a & False)["dice"] == 1.0
    moved = np.roll(a, 1, 2)
    s = SU.surface_scores(a, moved)
    assert s["hd95"] == 1.0 and 0 < s["assd"] < 1 and s["nsd"] == 1.0 and s["dice"] == pytest.approx(0.75)


def test_signed_distance_pruning_skeleton():
    p = np.zeros((1, 1, 9))
    p[0, 0, 3:6] = 1
    assert (SU.signed_distance(p).ravel() * 40).tolist() == [-3, -2, -1, 1, 2, 1, -1, -2, -3]
    assert not SU.signed_distance(p * 0).any()
    inst = np.array([[[1, 0, 1, 1, 2, 2, 0, 2]]])
    assert SU.prune_components(inst, 2).ravel().tolist() == [0, 0, 1, 1, 2, 2, 0, 0]
    v = np.zeros((6, 6, 30))
    for x in (2, 13, 24):
        v[1:5, 1:5, x : x + 4] = 500
    v[1:5, 1:5, 13] = 500
    parts = SU.skeleton_parts(v, least=10)
    assert {k: int(np.nonzero(m)[2].mean()) for k, m in parts.items()} == {"Sacrum": 14, "RightHip": 3, "LeftHip": 25}


def test_candidate_features():
    source = np.ones((4, 4, 8), bool)
    piece = source.copy()
    piece[:, :, 3:] = False
    f = SU.candidate_features(source, piece, np.indices(source.shape)[2].astype(float), (1, 1, 2))
    assert f["isolated_piece_fraction"] == 3 / 8 and f["interface_voxels"] == 16 and f["centroid_distance_mm"] == 8 and f["source_bbox_long_mm"] == 16 and f["source_component_count"] == f["piece_component_count"] == 1
    assert f["ct_absolute_mean_difference"] == 4.0 and tuple(f) == SU.SHAPE_FEATURES and f["piece_small_volume_cm3"] == 48 * 2 / 1000
    assert f["ct_piece_std"] == pytest.approx(np.std([0, 1, 2])) and f["ct_standardized_mean_difference"] == pytest.approx(4 / np.sqrt((np.var([0, 1, 2]) + np.var([3, 4, 5, 6, 7])) / 2))


def test_femur_fragments_have_targets():
    inst = np.zeros((14, 14, 24), int)
    inst[2:12, 2:12, 2:12] = 151
    inst[2:12, 2:12, 12:22] = 200
    barrier, audit = T.barrier_target(inst, shell=2.0)
    assert audit["fragments"] == 2 and set(np.unique(barrier)) == {0, 1, 2, 3, 4} and count(DT.barrier(barrier)) == 2
    for dynamic in (None, (2, 12)):
        official, info = T.official_target(inst, dynamic=dynamic)
        assert ((official > 0) == (inst > 0)).all() and T.audit_official(inst, official)["ok"]
    assert T.official_target(np.where(inst == 151, 201, 0))[0].max() == 0


def test_audits_count_femur_fragments(spark):
    from pyspark.sql import functions as F

    from gridloom.plans import QUERIES
    from gridloom.sources import fixtures as X

    sf = "/root/testdata/sf0.001"
    true = {r["slab"]: r["n"] for r in X.instances_b(spark, sf).where("gt > 0").groupBy("slab").agg(F.count_distinct("gt").alias("n")).collect()}
    for name in ("official_audit", "barrier_oracle_eval"):
        assert {r["slab"]: r["fragments"] for r in QUERIES[name](spark, sf).collect()} == true
