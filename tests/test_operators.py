import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import registry as R
from gridloom.functions import scalar as S
from gridloom.operators import gate as G
from gridloom.operators import logs
from gridloom.operators import matching as M
from gridloom.operators import neighbors as N
from gridloom.operators import ranking as RK
from gridloom.operators import scans
from gridloom.sources import volumes as V
from gridloom.streaming import status


def grid(spark, *arrays, names):
    at = np.indices(arrays[0].shape).reshape(3, -1).T.tolist()
    rows = [(*p, *[a[tuple(p)].item() for a in arrays]) for p in at]
    return spark.createDataFrame(rows, "z long, y long, x long, " + ", ".join(f"{n} {'double' if a.dtype.kind == 'f' else 'long'}" for n, a in zip(names, arrays)))


def test_id_arithmetic(spark):
    rows = spark.createDataFrame([(i,) for i in (0, 1, 50, 51, 100, 101, 150, 151, 200, 250)], "i long").coalesce(1)
    got = rows.select(R.anatomy_of(F.col("i")), R.local_id(F.col("i")), R.clip_to_valid(F.col("i"), True)).collect()
    assert [r[0] for r in got] == [0, 1, 1, 2, 2, 3, 3, 4, 4, 0] and [r[1] for r in got] == [0, 1, 50, 1, 50, 1, 50, 1, 50, 0] and [r[2] for r in got] == [0, 1, 50, 51, 100, 101, 150, 0, 0, 0]
    with pytest.raises(Exception, match="no dataset for case"):
        rows.select(R.dataset_of_case(F.col("i") + 1000)).collect()
    with pytest.raises(Exception, match="unknown anatomy"):
        rows.select(R.anatomy_index(F.lit("Skull"))).collect()


def test_clean_fragments_count_in_topology(spark):
    gt = np.zeros((2, 4, 10), int)
    gt[:, :, :4], gt[:, :, 5:] = 1, 51
    pred = np.where(gt == 1, 7, 0)
    pred[:, :, 5:8], pred[:, :, 8:] = 60, 61
    m = {r["anatomy"]: r for r in M.case_metrics(grid(spark, gt, pred, names=("gt", "pred"))).collect()}
    assert (m[1]["topology"], m[1]["iou"], m[2]["topology"], m[2]["split_error"]) == (1.0, 1.0, 0.0, 1)
    assert m[2]["precision"] == 0.5 and m[2]["recall"] == 1.0


def test_lowest_id_wins_ties_and_unmatched_count_zero(spark):
    gt = np.array([[[1, 1, 1, 1] + [2] * 40]])
    pred = np.array([[[9, 9, 8, 8] + [10] + [0] * 39]])
    best = {r["gt"]: r for r in M.best_matches(M.overlaps(grid(spark, gt, pred, names=("gt", "pred")))).collect()}
    assert best[1]["matched_pred"] == 8 and best[2]["matched_pred"] is None and 0 < best[2]["iou"] < 0.1
    rows = {r["gt"]: r for r in M.fragment_rows(grid(spark, gt, pred, names=("gt", "pred"))).collect()}
    assert rows[2]["iou_score"] == 0 and rows[2]["dice_score"] == 0


def test_offsets_beyond_the_grid_give_no_rows(spark):
    g = grid(spark, np.arange(1, 9).reshape(2, 2, 2), np.ones((2, 2, 2)), names=("label", "a"))
    assert N.pair_evidence(g, "label", ["a"] * 3, N.axis_offsets(9)).count() == 0
    assert len(N.ball_offsets(3)) == 122 and len(N.ball_offsets(3, half=True)) == 61 and len(N.forward_offsets()) == 13


def test_neighbour_joins_are_no_nested_loops(spark):
    g = grid(spark, np.arange(1, 28).reshape(3, 3, 3), names=("label",))
    plan = N.adjacent_pairs(g, "label", 1)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


class Share:
    """A regressor by rule: a start and a slope over the first feature."""

    def __init__(self, start, slope=0.0):
        self.start, self.slope = start, slope

    def predict(self, x):
        return self.start + self.slope * x[:, 0]


def gate_model(merge=-0.6, **more):
    models = {f"delta_{t}": Share(0.0) for t in G.TARGETS} | {"delta_merge": Share(merge, -0.1)}
    return {"models": models, "feature_names": ["isolated_piece_fraction"], "policy": {"action": "select", "merge_max": -0.55, "split_max": 1.0}, "quality_guards": {}} | more


def striped(vol, bounds, source=1):
    """Rows (vol, z, y, x, base, proposal, ct) of a column: one source, whose proposals are stretches of it."""
    rows = []
    for z in range(12):
        proposal = source + 1 + sum(z >= b for b in bounds)
        rows += [(vol, z, y, 0, source, proposal, float(z)) for y in range(3)]
    return rows


GRID = "vol long, z long, y long, x long, base long, proposal long, ct double"


def test_each_volume_gets_its_own_split(spark):
    """Three volumes with the same ids: together they split as they do alone."""
    parts = {7: striped(7, [4]), 8: striped(8, [6, 9]), 9: striped(9, [2, 5, 11]) + [(9, 0, 9, 0, 2, 0, 0.0)]}
    run = lambda rows, model: sorted(map(tuple, G.run_gate(spark.createDataFrame(rows, GRID), model, 3).select("vol", "z", "y", "base").collect()))
    together = run(sum(parts.values(), []), gate_model())
    assert together == sorted(sum((run(rows, gate_model()) for rows in parts.values()), []))
    # the largest isolated part of each source, under the lowest id that its volume has free
    want = {7: (2, 12), 8: (2, 18), 9: (3, 18)}
    for vol, (new, n) in want.items():
        got = [b for v, *_, b in together if v == vol]
        assert got.count(new) == n and got.count(1) == 36 - n and len(got) == len(parts[vol])
    kept = run(parts[8], gate_model(policy={"action": "keep"}))
    assert {b for *_, b in kept} == {1} and run(parts[8], gate_model(merge=0.0)) == kept


def test_candidates_and_why_not(spark):
    g = spark.createDataFrame(striped(1, [4]) + striped(2, []) + striped(3, [1, 8]), GRID)
    found, rejected = G.candidates(g, 4)
    got = {(r["vol"], r["proposal_id"]): r for r in found.collect()}
    assert set(got) == {(1, 2), (3, 3), (3, 4)} and {r["reason"]: r["count"] for r in rejected.collect()} == {"fewer_than_two": 1, "small_piece": 1}
    assert (got[3, 3]["invert"], got[3, 3]["piece"], got[3, 3]["coverage"], got[3, 3]["leakage"], got[3, 3]["fragments"]) == (True, 15, 1.0, 0.0, 1)
    reports = spark.createDataFrame([(3, 1, 40, 10, 5, 2, 1, 60, 30, 110, 200, [0.2, 0.4])], "vol long, anatomy long, supervoxels long, rag_edges long, mid_covered long, long_covered long, vetoed long, border long, boundary long, core long, hard_total long, errors array<double>")
    f = {(r["vol"], r["proposal_id"]): r["features"] for r in G.with_features(g, found, context=G.decoder_context(reports)).collect()}
    assert [f[3, 4][n] for n in G.CONTEXT_FEATURES] == pytest.approx([40, 10, 0.5, 0.2, 0.1, 0.3, 0.15, 0.55, 2, 0.4, 0.3]) and f[1, 2]["context_accepted_splits"] == 0
    assert f[3, 3]["isolated_is_complement"] == 1 and f[3, 3]["proposal_ids_in_source"] == 3 and f[3, 3]["is_sacrum"] == 1 and len(f[3, 3]) == 44
    with pytest.raises(KeyError, match="policy"):
        G.check_payload({k: v for k, v in gate_model().items() if k != "policy"})
    with pytest.raises(Exception, match="missing features: nothing"):
        G.predict(G.with_features(g, found), gate_model(feature_names=["nothing"])).collect()


def test_equal_predictions_take_the_lower_proposal(spark):
    rows = spark.createDataFrame([("Sacrum", 1, p, -0.8, 1.5, 0.01, 0.0, 0.0) for p in (4, 3)], "anatomy string, source_id long, proposal_id long, d_merge double, d_split double, d_dice double, d_f1 double, d_precision double")
    assert [r["proposal_id"] for r in RK.select_splits(rows, {"merge_max": -0.55, "split_max": 2.25}, {"delta_dice_min": -0.01, "delta_f1_min": -0.05, "delta_precision_min": -0.1}).collect()] == [3]


def test_routing_falls_back(spark):
    rows = spark.createDataFrame([("pelvic", "femur", 0.9), ("pelvic", "femur", 0.6), (None, "femur", 0.6), (None, None, None), ("femur", "pelvic", float("nan"))], "rule string, learned string, p double").coalesce(1)
    got = [r[0] for r in rows.select(S.routed_family(F.col("rule"), F.col("learned"), F.col("p"))).collect()]
    assert [g and tuple(g) for g in got] == [("femur", "forest"), ("pelvic", "rule"), ("femur", "unsure forest"), None, ("femur", "rule")]


def test_slot_cap_on_both_sides_of_the_limit(spark):
    s = spark.createDataFrame([(1, i, 100 - i) for i in range(60)] + [(2, i, i) for i in range(5)], "a long, id long, n long")
    got = {(r["a"], r["id"]): r["slot"] for r in RK.slot_cap(s, "a", "id", "n").collect()}
    assert len(got) == 55 and got[(1, 0)] == 1 and got[(1, 49)] == 50 and got[(2, 4)] == 5


def test_expert_keys_partition(spark):
    keys = spark.createDataFrame([(f"CASE_001_{a}",) for a in ("Sacrum", "LeftHip", "RightHip", "Femur")], "k string")
    experts = [("Sacrum",), ("LeftHip", "RightHip"), ("Femur",)]
    got = keys.select(*[S.is_expert(F.col("k"), e).cast("int") for e in experts]).collect()
    assert [sum(r) for r in got] == [1] * 4


def test_log_lines(spark):
    text = ["Epoch 0", "Pseudo dice [np.float32(0.5), np.float32(1e-04)]", "Epoch time: 10.0 s", "Epoch 1", "New best EMA pseudo Dice: 0.61", "Epoch time: 20.0 s", "Training done."]
    lines = spark.createDataFrame([("a", i, t) for i, t in enumerate(text)], "log string, line long, text string")
    parsed = logs.parse_log(lines, "log", "line", "text")
    assert [r["values"] for r in parsed.orderBy("line").collect()][1] == [0.5, 1e-4]
    r = logs.progress(logs.log_status(parsed, "log", "line")).collect()[0]
    assert (r["last_epoch"], r["best"], r["best_epoch"], r["recent_seconds"], r["done"], r["stop_epoch"]) == (1, 0.61, 1, 15.0, True, 100)


def test_volume_files(spark, tmp_path):
    a = np.arange(24, dtype=np.int16).reshape(2, 3, 4)
    for part, packed in (("p1", False), ("p2", True)):
        (tmp_path / part / "001").mkdir(parents=True)
        (tmp_path / part / "001" / "image.mha").write_bytes(V.mha_bytes(a, (0.5, 1.0, 2.0), (1, 2, 3), compressed=packed))
    (tmp_path / "p1" / "001" / "label.mha").write_bytes(V.mha_bytes(a.astype(np.uint8)))
    voxels, geometry = V.read_mha(spark, str(tmp_path), "image.mha")
    assert sorted((r["z"], r["y"], r["x"], int(r["value"])) for r in voxels.collect()) == sorted([(z, y, x, int(a[z, y, x])) for z in range(2) for y in range(3) for x in range(4)] * 2)
    assert {(r["nx"], r["sz"], tuple(r["origin"])) for r in geometry.collect()} == {(4, 2.0, (1.0, 2.0, 3.0))}
    files = V.list_files(spark, str(tmp_path), "*.mha")
    both = V.cases(files)
    assert [tuple(r) for r in both.collect()] == [("p1", "001")]
    assert V.subset(both, ["1"]).count() == 1 and V.first_input(spark, str(tmp_path)).endswith("p1/001/image.mha")
    with pytest.raises(ValueError, match="007"):
        V.subset(both, ["7"])
    with pytest.raises(ValueError):
        V.crop(voxels, {"z": (1, 1)})
    np.savez(tmp_path / "a.npz", softmax=np.ones((2, 1, 1, 2)), other=np.zeros(3))
    assert V.read_npz(spark, str(tmp_path)).agg(F.sum("value")).first()[0] == 4.0


def test_reports(spark, tmp_path):
    (tmp_path / "archive_old").mkdir()
    for name, text in (("a.json", json.dumps({"dataset": 1, "iou_f": 0.5, "samples": 3})), ("b.json", json.dumps({"dataset": 1, "iou_f": 0.9, "samples": 3})), ("c.json", "{broken"), ("d.json", json.dumps({"dataset": 1})), ("archive_old/e.json", json.dumps({"dataset": 1, "iou_f": 1.0, "samples": 1}))):
        (tmp_path / name).write_text(text)
    got = V.read_evals(spark, str(tmp_path)).collect()
    assert [r["iou_f"] for r in got] == [0.9, 0.5]
    assert json.loads(V.json_safe({"a": np.float32(1.5), "b": np.arange(2), "c": float("nan"), "d": tmp_path})) == {"a": 1.5, "b": [0, 1], "c": None, "d": str(tmp_path)}
    V.write_json(spark.range(3), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_stream_equals_table(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    folder = str(tmp_path / "events")
    events.repartitionByRange(4, "ts").write.parquet(folder)
    q = status.run_to_table(status.windowed_status(status.read_events(spark, folder, 100), late="1 second"), "status", str(tmp_path / "cp"))
    assert q.exception() is None
    got = {tuple(r) for r in spark.table("status").collect()}
    want = {tuple(r) for r in status.windowed_status(events).collect()}
    assert got and got <= want


def test_scan_pipeline_owns_each_voxel_once(spark):
    a = np.zeros((2, 4, 8), int)
    g = grid(spark, a + 1, names=("v",)).withColumn("scan", F.lit(1).cast("long"))
    both = g.withColumn("anatomy", F.explode(F.array(F.lit(2).cast("long"), F.lit(1).cast("long")))).where("anatomy = 1 OR x > 3").where("anatomy = 2 OR x < 6")
    out = scans.instance_map(both, ["v"], lambda c: (c[0] > 0).astype(int))
    n = {r["id"]: r["count"] for r in out.groupBy("id").count().collect()}
    assert n == {1: 48, 51: 16}


def test_formatting(spark):
    rows = spark.createDataFrame([(0.53125,), (None,), (float("nan"),), (2.0,)], "v double").coalesce(1)
    got = rows.select(S.fixed(F.col("v")), S.bar(F.col("v"), 4)).collect()
    assert [tuple(r) for r in got] == [("0.5312", "##.."), ("n/a", "...."), ("n/a", "...."), ("2.0000", "####")]
