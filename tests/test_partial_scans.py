"""Tables whose last slab is short, and plans of tables that are larger than their estimates."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from gridloom.functions.registry import same_anatomy
from gridloom.operators import distance as D
from gridloom.operators import neighbors as N
from gridloom.plans import ORACLES, QUERIES

from .test_queries import canon

SF = "/root/testdata/sf0.001"


def test_exploded_tables_are_not_broadcast(spark):
    """An explode multiplies rows by the offsets, and the planner's estimate stays."""
    g = spark.range(200).selectExpr("id z", "0L y", "0L x", "1 + id div 7 gt")
    d = N.distance_to_other(g, "gt", 2.0, same_anatomy)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan, plan
    assert d.where("distance = 1").count() == 2 * 28  # both ends of each border


@pytest.mark.parametrize("name", ["audited_clip", "held_out_evaluation", "router_features"])
def test_a_table_that_ends_within_a_slab(spark, tmp_path, name):
    """Slabs are scans of 50 planes, also the last one of 40."""
    spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id < 90").write.parquet(f"{tmp_path}/embeddings.parquet")
    df = QUERIES[name](spark, str(tmp_path))
    cur = duckdb.connect()
    cur.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    cur = cur.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert canon(map(tuple, df.collect()), df.columns, sorted(columns)) == canon(cur.fetchall(), columns, sorted(columns))


def test_distances_are_dealt_to_all_partitions(spark):
    """Few bytes of many planes would else meet in one or two tasks."""
    q = spark.range(4000).selectExpr("id div 50 job", "id % 50 z", "0L y", "0L x")
    d = D.to_nearest(q, q.where("z = 3"), ["job"], (2.0, 1.0, 1.0))
    got = d.select("job", "z", "distance", F.spark_partition_id().alias("at"))
    rows = got.collect()
    assert len(rows) == 4000 and all(r["distance"] == 2.0 * abs(r["z"] - 3) for r in rows)
    assert len({r["at"] for r in rows}) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_pairs_carry_one_channel(spark):
    """A joined row holds the channel of its offset, not all of them."""
    g = spark.range(4).selectExpr("7L vol", "id z", "0L y", "0L x", "1 + id div 2 gt", "id * 1.0D a0", "id * 10.0D a1")
    pairs = N.affinity_pairs(g, "gt", ["a0", "a1"], [(1, 0, 0), (2, 0, 0)], ["vol"])
    assert sorted(tuple(r) for r in pairs.collect()) == [(7, 0, 0.0, True), (7, 0, 1.0, False), (7, 0, 2.0, True), (7, 1, 0.0, False), (7, 1, 10.0, False)]
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "Generate explode" in x]
    beside = [re.search(r"\[([^\]]*)\], false, \[", x)[1] for x in dealt]  # what stands beside the exploded column
    assert beside and not any(re.search(r"\ba[01]#", x) for x in beside), beside


def test_class_targets_shuffle_no_exploded_rows(spark):
    """No row of an explode is shuffled before its partial sums."""
    g = spark.range(400).selectExpr("id div 100 vol", "id % 100 div 10 z", "id % 10 y", "0L x", "if(id % 7 = 0, 0, 1 + id % 60) gt")
    plan = N.class_target(g, "gt", ["vol"])._jdf.queryExecution().executedPlan().toString().splitlines()
    after = [k for k, x in enumerate(plan) if "Generate explode" in x]
    above = [next(plan[j] for j in range(k - 1, -1, -1) if "Project" not in plan[j] and "Filter" not in plan[j]) for k in after]
    assert len(above) == 3 and all("HashAggregate" in x for x in above), above
    assert "Broadcast" not in "".join(plan)
