"""The jobs: reruns, growing input, parts done again, failures between writes, command lines."""

import glob
import json
import os
import subprocess
import sys

import duckdb
import numpy as np
import pytest

from pyspark.sql import functions as F

from gridloom.operators import official as O
from gridloom.sources import volumes as V
from jobs import common, evaluate_cases, watch_logs
from jobs import queries as Q

from .test_queries import canon

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(str, df.collect()))


def files(folder):
    return sorted((f, os.path.getmtime(f)) for f in glob.glob(f"{folder}/**/*.parquet", recursive=True))


@pytest.mark.parametrize("name", ["job1_evaluate_cases", "job2_watch_logs"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(Q.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    df = Q.queries()[name](spark, SF)
    want = canon(cur.fetchall(), columns, sorted(columns))
    assert want and canon(map(tuple, df.collect()), df.columns, sorted(columns)) == want


# ------------------------------------------------------------------ evaluation


def test_evaluation_reruns_alike(spark, tmp_path):
    first = evaluate_cases.run(spark, SF, f"file://{tmp_path}/a")
    before = rows(evaluate_cases.output(spark, f"{tmp_path}/a"))
    assert evaluate_cases.run(spark, SF, f"file://{tmp_path}/a") == first
    assert rows(evaluate_cases.output(spark, f"{tmp_path}/a")) == before
    assert first["voxels"] == 500 * 64 and first["cases"] == first["cases_in_all"] > 0


def test_parts_are_done_again_alone(spark, tmp_path):
    out = str(tmp_path)
    evaluate_cases.run(spark, SF, out, {"scans_a_part": 3})
    everything, others = rows(evaluate_cases.output(spark, out)), files(f"{out}/cases/part=0") + files(f"{out}/overlaps/part=2")
    done = evaluate_cases.run(spark, SF, out, {"scans_a_part": 3}, parts=[1])
    assert 0 < done["cases"] < done["cases_in_all"]
    assert rows(evaluate_cases.output(spark, out)) == everything
    assert files(f"{out}/cases/part=0") + files(f"{out}/overlaps/part=2") == others
    # with another limit, only that part's cases differ; the summary is made of all
    evaluate_cases.run(spark, SF, out, {"scans_a_part": 3, "threshold": 0.9}, parts=[1])
    changed = evaluate_cases.output(spark, out).where("scan IS NOT NULL")
    assert {r["scan"] // 3 for r in changed.collect() if str(r) not in set(everything)} == {1}


def test_volumes_in_files_and_a_missing_prediction(spark, tmp_path):
    for k in (1, 2):
        gt = np.zeros((4, 5, 6), np.int16)
        gt[:2], gt[2:] = k, 60
        for folder in ("labels", "predictions"):
            os.makedirs(f"{tmp_path}/in/{folder}", exist_ok=True)
        with open(f"{tmp_path}/in/labels/case_{k:03d}.mha", "wb") as f:
            f.write(V.mha_bytes(gt))
        if k == 1:
            pred = np.where(gt == 1, 3, 0).astype(np.int16)
            with open(f"{tmp_path}/in/predictions/case_001.mha", "wb") as f:
                f.write(V.mha_bytes(pred))
    done = evaluate_cases.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", {"format": "mha"})
    assert done == {"voxels": 240, "overlaps": 4, "fragments": 4, "cases": 4, "cases_in_all": 4, "hard": 3}
    got = {(r["scan"], r["anatomy"]): r for r in evaluate_cases.output(spark, f"{tmp_path}/out").collect()}
    assert got[1, 1]["dice"] == got[1, 1]["f1"] == 1.0 and got[1, 1]["n_pred"] == 1
    assert all(got[k]["dice"] == got[k]["f1"] == got[k]["tp"] == 0 for k in ((1, 2), (2, 1), (2, 2)))
    assert got[None, None]["n_gt"] == 4 and got[None, None]["dice"] == 0.25 and got[None, 1]["dice"] == 0.5
    hard = spark.read.option("header", True).csv(f"{tmp_path}/out/hard").collect()
    assert [(r["scan"], r["anatomy"]) for r in hard] == [("1", "2"), ("2", "1"), ("2", "2")]
    with pytest.raises(ValueError, match="unknown format"):
        evaluate_cases.run(spark, f"{tmp_path}/in", f"{tmp_path}/no", {"format": "dicom"})


def test_official_metrics_by_parts(spark, tmp_path):
    """The challenge's metrics in the job equal the operator's, and parts are done again alone."""
    config = {"official": True, "spacing": [0.8, 1.0, 1.5], "least_fragment_mm3": 24.0, "least_component_mm3": 6.0, "local_radius_mm": 2.5, "scans_a_part": 5}
    out = str(tmp_path)
    evaluate_cases.run(spark, SF, out, config)
    grid = evaluate_cases.instance_maps(spark, SF, "planes")
    want = O.official_metrics(grid, (0.8, 1.0, 1.5), O.Limits(24.0, 6.0, 0.1, 2.5))
    rounded = lambda df: rows(df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.drop("part").dtypes]))
    got = rounded(spark.read.parquet(f"{out}/official"))
    assert got == rounded(want) and len(got) > 20
    others = files(f"{out}/official/part=1")
    evaluate_cases.run(spark, SF, out, config, parts=[0])
    assert files(f"{out}/official/part=1") == others and rounded(spark.read.parquet(f"{out}/official")) == got
    summary = spark.read.json(f"{out}/official_summary").where("anatomy IS NULL").first()
    assert summary["samples"] == len(got) and summary["hd95"] > 0


def test_command_line_of_the_evaluation(tmp_path):
    call = [sys.executable, "-m", "jobs.evaluate_cases", "--input", SF, "--output", f"{tmp_path}/out"]
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=4 pyspark-shell"}
    for more in ([], ["--parts", "1"]):
        p = subprocess.run(call + more, cwd=REPO, env=env, capture_output=True, text=True, timeout=300, check=False)
        assert p.returncode == 0, p.stderr[-2000:]
    assert "reading planes volumes" in p.stderr and "parts [1]" in p.stderr and "wrote" in p.stderr
    p = subprocess.run([*call, "--config", f"{tmp_path}/none.json"], cwd=REPO, env=env, capture_output=True, text=True, timeout=300, check=False)
    assert p.returncode != 0


# ------------------------------------------------------------------ logs


TABLE = "conv_id long, turn long, role string, text string, bucket string, batch long, pos int"


def turns(*given):
    return [(c, t, "assistant" if t % 2 else "user", x, "b", 7, 9) for c, t, x in given]


def put(spark, folder, given):
    spark.createDataFrame(given, TABLE).coalesce(1).write.mode("append").parquet(f"{folder}/conversations.parquet")


def watch(spark, tmp_path, at="a", **more):
    return watch_logs.run(spark, str(tmp_path / "in"), f"{tmp_path}/{at}/t", f"{tmp_path}/{at}/c", Q._config("watch_logs") | more)


def status(spark, tmp_path, at="a"):
    return rows(watch_logs.output(spark, f"{tmp_path}/{at}/t"))


def test_two_runs_over_growing_input(spark, tmp_path):
    early = turns((1, 0, "one two"), (1, 1, "x" * 500), (2, 0, "other\nlines"), (3, 5, None), (None, 0, "no log"))
    late = turns((1, 2, "y" * 90), (2, 1, "end"), (4, 0, ""), (1, 3, "z" * 40))
    put(spark, tmp_path / "in", early)
    one = watch(spark, tmp_path)
    assert one["batches"] == 1 and one["events"] == 2 * 4 + 1 + 1
    before = {r["log"]: r for r in watch_logs.output(spark, f"{tmp_path}/a/t").collect()}
    assert before["1"]["best"] == 0.005 and before["1"]["recent_seconds"] == 253.5 and before["3"]["last_seconds"] is None
    put(spark, tmp_path / "in", late)
    two = watch(spark, tmp_path)
    assert two["batches"] == 1 and two["events"] == 2 * 4 + 2  # only what is new
    after = {r["log"]: r for r in watch_logs.output(spark, f"{tmp_path}/a/t").collect()}
    assert after["1"]["last_epoch"] == 3 and after["1"]["best"] == 0.0004 and after["1"]["events"] == after["1"]["counted"] == 10
    assert after["3"] == before["3"] and set(after) == {"", "1", "2", "3", "4"}
    # the same as one run over all of it
    assert watch(spark, tmp_path, "b")["events"] == one["events"] + two["events"]
    assert status(spark, tmp_path, "b") == status(spark, tmp_path)


def test_nothing_new_changes_nothing(spark, tmp_path):
    put(spark, tmp_path / "in", turns((1, 0, "a"), (2, 0, "b")))
    watch(spark, tmp_path)
    before = files(tmp_path / "a")
    assert watch(spark, tmp_path) == {"batches": 0, "lines": 0, "events": 0}
    assert files(tmp_path / "a") == before


def test_order_of_files_and_repeats_dont_matter(spark, tmp_path):
    put(spark, tmp_path / "in", turns((1, 7, "seven"), (1, 8, "eight!")))
    watch(spark, tmp_path)
    put(spark, tmp_path / "in", turns((1, 0, "zero"), (1, 1, "one"), (1, 8, "eight!")))
    watch(spark, tmp_path)
    r = watch_logs.output(spark, f"{tmp_path}/a/t").first()
    assert (r["last_epoch"], r["last_seconds"], r["best_epoch"], r["best"]) == (8, 6.0, 7, 0.00005)
    assert (r["counted"], r["events"]) == (10, 12)  # each line counts once, both deliveries stand


def test_batch_that_failed_is_taken_again(spark, tmp_path, monkeypatch):
    put(spark, tmp_path / "in", turns((1, 0, "a" * 30), (2, 0, "b" * 40)))
    watch(spark, tmp_path)
    put(spark, tmp_path / "in", turns((1, 1, "c" * 50)))

    def broken(*_):
        raise RuntimeError("lost between the two tables")

    with monkeypatch.context() as m, pytest.raises(Exception, match="lost between"):
        m.setattr(watch_logs, "status_of", broken)
        watch(spark, tmp_path)
    assert watch(spark, tmp_path)["events"] == 3
    watch(spark, tmp_path, "b")
    assert status(spark, tmp_path) == status(spark, tmp_path, "b")


def test_plain_lines_only(spark, tmp_path):
    os.makedirs(tmp_path / "in/run9")
    (tmp_path / "in/run9/log.txt").write_text("nothing here\nto see\n")
    assert watch_logs.run(spark, f"{tmp_path}/in/*", f"{tmp_path}/t", f"{tmp_path}/c") == {"batches": 1, "lines": 3, "events": 0}


def log(first, last):
    return "".join(f"2026: Epoch {e}\nPseudo dice [np.float32(0.5), 1e-04]\nEpoch time: {100 + e}.5 s\r\n" + (f"New best EMA pseudo Dice: 0.{e:03d}\n" if e % 10 == 0 else "") for e in range(first, last))


def test_command_line_over_text_logs(tmp_path):
    """Logs as files: a log is a folder, whose files come one after the other."""
    os.makedirs(tmp_path / "in/fold_0")
    os.makedirs(tmp_path / "in/fold_1")
    (tmp_path / "in/fold_0/training_log_1.txt").write_text(log(0, 25))
    (tmp_path / "config.json").write_text(json.dumps({"buckets": 4}))
    call = [sys.executable, "-m", "jobs.watch_logs", "--input", f"{tmp_path}/in/*", "--output", f"{tmp_path}/t", "--checkpoint", f"{tmp_path}/c", "--config", f"{tmp_path}/config.json"]
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=4 pyspark-shell"}

    def run():
        p = subprocess.run(call, cwd=REPO, env=env, capture_output=True, text=True, timeout=300, check=False)
        assert p.returncode == 0, p.stderr[-2000:]
        return p.stderr

    assert "batch 0: read 79 lines, wrote 53 events" in run().replace(f"{tmp_path}", "")
    (tmp_path / "in/fold_0/training_log_2.txt").write_text(log(25, 40) + "Training done.\n")
    (tmp_path / "in/fold_1/training_log_1.txt").write_text(log(0, 3))
    assert "batch 1: " in run()
    assert "nothing new" in run()
    found = {r[0]: r[1:] for r in duckdb.sql(f"SELECT log, last_epoch, last_seconds, recent_seconds, best, best_epoch, done, stop_epoch FROM read_parquet('{tmp_path}/t/status/*/*.parquet')").fetchall()}
    assert found == {"fold_0": (39, 139.5, 130.0, 0.03, 30, True, 100), "fold_1": (2, 102.5, 101.5, 0.0, 0, False, 100)}


def test_settings(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"threshold": 0.3}')
    assert common.settings(spark, evaluate_cases.DEFAULTS, f"{tmp_path}/c.json")["threshold"] == 0.3
    (tmp_path / "c.json").write_text('{"treshold": 0.3}')
    with pytest.raises(ValueError, match="treshold"):
        common.settings(spark, evaluate_cases.DEFAULTS, f"{tmp_path}/c.json")
    for name, job in (("evaluate_cases", evaluate_cases), ("watch_logs", watch_logs)):
        assert set(common.settings(spark, job.DEFAULTS, f"{common.SHIPPED}/{name}.json")) == set(job.DEFAULTS)
    with pytest.raises(ValueError, match="unknown format"):
        watch_logs.run(spark, str(tmp_path), f"{tmp_path}/t", f"{tmp_path}/c", {"format": "xml"})
