"""The jobs as registered queries: each runs twice into a new folder, and returns the output as it stands then."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.cluster import shared_dir
from gridloom.plans.base import DIGITS, INST_B, VOX

from . import evaluate_cases, watch_logs


def _config(name: str) -> dict:
    with open(os.path.join(os.path.dirname(os.path.abspath(__file__)), f"{name}.json")) as f:
        return json.load(f)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(c, DIGITS) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def job1_evaluate_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "job1")
    for _ in range(2):
        evaluate_cases.run(spark, sf_dir, out, _config("evaluate_cases"))
    return _rounded(evaluate_cases.output(spark, out))


def job2_watch_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "job2")
    for _ in range(2):
        watch_logs.run(spark, sf_dir, f"{out}/tables", f"{out}/checkpoint", _config("watch_logs"))
    return _rounded(watch_logs.output(spark, f"{out}/tables"))


def queries() -> dict:
    return {"job1_evaluate_cases": job1_evaluate_cases, "job2_watch_logs": job2_watch_logs}


_A = lambda c: f"(({c} - 1) // 50 + 1)"
_MEANS = ["iou", "dice", "precision", "recall", "f1", "topology"]
_SUMS = ["n_gt", "n_pred", "tp", "merge_error", "split_error"]
_R = lambda c: f"ROUND(CAST({c} AS DOUBLE), {DIGITS}) + 0.0 AS {c}"

_CASES = f"""
    WITH {VOX}, {INST_B}, o AS (SELECT slab AS scan, gt, pred, count(*) AS n FROM inst GROUP BY ALL),
    g AS (SELECT scan, gt, sum(n) AS n FROM o WHERE gt > 0 GROUP BY ALL), p AS (SELECT scan, pred, sum(n) AS n FROM o WHERE pred > 0 GROUP BY ALL),
    pairs AS (SELECT o.scan, o.gt, o.pred, o.n AS both_, g.n AS n_gt, p.n AS n_pred, o.n / CAST(g.n + p.n - o.n AS DOUBLE) AS iou FROM o JOIN g ON g.scan = o.scan AND g.gt = o.gt JOIN p ON p.scan = o.scan AND p.pred = o.pred WHERE {_A('o.gt')} = {_A('o.pred')}),
    best AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY scan, gt ORDER BY iou DESC, pred) = 1),
    f AS (SELECT g.scan, g.gt, {_A('g.gt')} AS anatomy, COALESCE(b.iou, 0) AS iou, COALESCE(b.iou, 0) >= 0.1 AS matched, CASE WHEN b.iou >= 0.1 THEN b.pred END AS used, 2.0 * b.both_ / (g.n + b.n_pred) AS dice,
        (SELECT count(*) FROM pairs q WHERE q.scan = g.scan AND q.gt = g.gt) AS touching FROM g LEFT JOIN best b ON b.scan = g.scan AND b.gt = g.gt),
    u AS (SELECT *, count(used) OVER (PARTITION BY scan, used) AS uses FROM f),
    a AS (SELECT scan, anatomy, count(*) AS n_gt, count(*) FILTER (matched) AS tp, count(DISTINCT used) AS used, avg(CASE WHEN matched THEN iou ELSE 0 END) AS iou, avg(CASE WHEN matched THEN dice ELSE 0 END) AS dice,
        CAST(sum(greatest(touching - 1, 0)) AS BIGINT) AS split_error, avg(CASE WHEN matched AND uses = 1 AND touching <= 1 THEN 1 ELSE 0 END) AS topology FROM u GROUP BY 1, 2),
    k AS (SELECT scan, {_A('pred')} AS anatomy, count(*) AS n_pred FROM p GROUP BY 1, 2),
    m AS (SELECT a.*, COALESCE(n_pred, 0) AS n_pred, tp - used AS merge_error, tp / CAST(greatest(tp + COALESCE(n_pred, 0) - used, 1) AS DOUBLE) AS precision, tp / CAST(n_gt AS DOUBLE) AS recall FROM a LEFT JOIN k ON k.scan = a.scan AND k.anatomy = a.anatomy),
    c AS (SELECT *, 2.0 * precision * recall / greatest(precision + recall, 1e-8) AS f1 FROM m)
    SELECT scan, anatomy, {', '.join(_SUMS)}, {', '.join(map(_R, _MEANS))} FROM c
    UNION ALL SELECT NULL, anatomy, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in _SUMS)}, {', '.join(f'ROUND(avg({c}), {DIGITS}) + 0.0 AS {c}' for c in _MEANS)} FROM c GROUP BY ROLLUP (anatomy)"""

_STATUS = f"""
    WITH l AS (SELECT CAST(conv_id AS VARCHAR) AS log, turn, role, length(COALESCE(text, '')) AS n, text IS NOT NULL AS told FROM conversations),
    r AS (SELECT log, avg(n) AS recent_seconds FROM (SELECT * FROM l WHERE told QUALIFY row_number() OVER (PARTITION BY log ORDER BY turn DESC) <= 20) GROUP BY 1),
    s AS (SELECT log, CAST(max(turn) AS INTEGER) AS last_epoch, CAST(arg_max(n, turn) FILTER (told) AS DOUBLE) AS last_seconds, arg_max(n / 100000, turn) FILTER (told AND role = 'assistant') AS best,
        CAST(max(turn) FILTER (told AND role = 'assistant') AS INTEGER) AS best_epoch, false AS done, count(*) + count(*) FILTER (told) + count(*) FILTER (told AND role = 'assistant') AS events FROM l GROUP BY 1),
    p AS (SELECT s.*, recent_seconds, greatest(100, COALESCE(best_epoch, 0) + 50) AS stop_epoch FROM s LEFT JOIN r ON r.log = s.log)
    SELECT log, last_epoch, best_epoch, done, {', '.join(map(_R, ['last_seconds', 'recent_seconds', 'best']))}, stop_epoch, {_R('hours_left')}, events AS counted, events
    FROM (SELECT *, greatest(0, stop_epoch - COALESCE(last_epoch, 0)) * COALESCE(recent_seconds, 0) / 3600 AS hours_left FROM p)"""


def oracle_sql() -> dict[str, str]:
    return {"job1_evaluate_cases": _CASES, "job2_watch_logs": _STATUS}
