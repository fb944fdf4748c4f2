"""Groups that cost more as calls than as work: many of them go in one call, with the rows that calls of their own give."""

import numpy as np
import pyarrow as pa
import pytest

from gridloom import cluster as C
from gridloom.operators import distance as D
from gridloom.operators import kernels as K


@pytest.mark.parametrize("size", [1, 3, 7, 100])
def test_whole_groups_of_batches(size):
    """Whatever the batches; nulls are a group."""
    keys = [("a", 1)] * 4 + [("a", 2)] + [("b", 2)] * 9 + [(None, 2)] * 2 + [(None, None)] * 3 + [("c", 0)]
    table = pa.table({"k": [k for k, _ in keys], "j": pa.array([j for _, j in keys], "int64"), "n": list(range(len(keys)))})
    got, calls = [], 0
    for t, starts in C.whole_groups(iter(table.to_batches(max_chunksize=size)), ["k", "j"]):
        ends = [*starts[1:].tolist(), t.num_rows]
        got += [t["n"].to_pylist()[a:b] for a, b in zip(starts.tolist(), ends, strict=True)]
        calls += 1
    places = {}
    for n, k in enumerate(keys):
        places.setdefault(k, []).append(n)
    assert got == list(places.values())
    assert calls <= -(-len(keys) // size) + 1


@pytest.mark.parametrize("connectivity", [1, 2, 3])
def test_components_of_cells_of_many_groups(connectivity):
    """Cells beside each other in different groups, or across the end of a row, don't meet."""
    r = np.random.default_rng(connectivity)
    masks = [r.random((5, 4, 6)) < p for p in (0.25, 0.4, 0.6, 1.0)]
    cells = np.concatenate([np.argwhere(m) - [2, 0, 1] for m in masks])
    group = np.repeat(np.arange(4), [m.sum() for m in masks])
    order = r.permutation(len(cells))
    got = np.empty(len(cells), np.int64)
    got[order] = K.components_of_cells(group[order], cells[order], connectivity)
    parts = [K.components(m, connectivity)[0][m] for m in masks]
    want = np.concatenate([p + 1000 * k for k, p in enumerate(parts)])
    pairs = set(zip(got.tolist(), want.tolist(), strict=True))
    assert len(pairs) == len(set(got.tolist())) == len(set(want.tolist()))
    assert len(K.components_of_cells(np.zeros(0, int), np.zeros((0, 3), int))) == 0


def test_small_jobs_equal_jobs_by_planes(spark, monkeypatch):
    """Distances and the values of the nearest seeds, and columns that the queries bring; jobs without seeds, and such of no key."""
    rng = np.random.default_rng(5)
    rows = [(int(j) if j else None, *map(int, c), int(rng.integers(0, 99)), bool(rng.random() < 0.3)) for j in range(30) for c in np.argwhere(rng.random(rng.integers(1, 7, 3)) < 0.5) - 2]
    g = spark.createDataFrame(rows, "job long, z long, y long, x long, value long, seed boolean")
    q, s = g.where("NOT seed").selectExpr("job", "z", "y", "x", "concat('q', value) said"), g.where("seed AND (job % 7 > 0 OR job IS NULL)")
    rows_of = lambda: sorted(map(tuple, D.to_nearest(q, s, ["job"], (0.8, 1.0, 1.5), "value").collect()), key=str)
    plan = D.to_nearest(q, s, ["job"])._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan
    small = rows_of()
    monkeypatch.setattr(D, "SMALL", 0)
    assert small == rows_of() and len(small) == q.count()
    assert any(r[-1] is None for r in small) and any(r[-1] is not None for r in small)


@pytest.mark.parametrize("radius", [0, 1, 2, 5])
def test_balls_by_squared_distances(radius):
    """As by all offsets of a ball, also where it is larger than the grid."""
    r = np.random.default_rng(radius)
    for shape in ((9, 7, 8), (1, 4, 12), (2, 2, 2)):
        for share in (0.0, 0.02, 0.5, 1.0):
            mask = r.random(shape) < share
            assert (K.dilate_ball(mask, radius) == K.dilate(mask, K.ball(radius))).all()
            assert (K.dilate_ball(mask, radius, mask) == K.dilate(mask, K.ball(radius), mask)).all()
            if radius:
                assert (K.erode_ball(mask, radius) == K.erode(mask, K.ball(radius))).all()


def test_a_balls_steps_grow_with_its_radius(monkeypatch):
    """What lies within ten voxels of small parts is found without the 4,169 offsets of a ball."""
    from gridloom.operators import decode_targets as DT

    calls, views = [], K.views
    monkeypatch.setattr(K, "views", lambda *a: calls.append(1) or views(*a))
    inst = np.zeros((12, 9, 9), np.int64)
    inst[1:3], inst[6, 4, 4] = 1, 2
    got = DT.to_global_ids(np.where(inst > 0, 1, 0), inst, least=5)
    assert (got == np.where(inst > 0, 1, 0)).all()  # the lone voxel joins
    assert len(calls) < 100


@pytest.mark.parametrize("connectivity", [1, 3])
def test_flood_takes_the_lowest_and_then_the_earliest(connectivity):
    """Against a plain queue of places."""
    import heapq

    r = np.random.default_rng(connectivity)
    mask, priority = r.random((6, 7, 5)) < 0.7, r.integers(0, 4, (6, 7, 5))
    markers = np.where(r.random(mask.shape) < 0.05, r.integers(1, 5, mask.shape), 0)
    want = np.where(mask, markers, 0)
    queue = [(float(priority[tuple(p)]), k, tuple(p)) for k, p in enumerate(np.argwhere(want > 0).tolist())]
    n = len(queue)
    heapq.heapify(queue)
    while queue:
        _, _, p = heapq.heappop(queue)
        for o in K.structure(connectivity):
            q = tuple(a + b for a, b in zip(p, o, strict=True))
            if all(0 <= a < s for a, s in zip(q, mask.shape, strict=True)) and mask[q] and want[q] == 0:
                want[q] = want[p]
                heapq.heappush(queue, (float(priority[q]), n, q))
                n += 1
    got = K.flood(priority, markers, mask, connectivity)
    assert (got == want).all() and got.dtype == np.int32


def test_blocks_and_tiles_are_dealt_to_all_partitions(spark):
    """Few bytes of blocks that take long would else meet in one task."""
    from pyspark.sql import functions as F

    from gridloom.operators import decode as DE
    from gridloom.operators import geodesic as G
    from gridloom.operators import scans as P

    every = int(spark.conf.get("spark.sql.shuffle.partitions"))
    g = spark.range(400).selectExpr("id div 4 slab", "id div 4 scan", "1L anatomy", "id % 4 z", "0L y", "0L x", "1.0D v")
    one = DE.per_block(g, "slab", ["v"], lambda c: c[0].astype(int))
    assert len({r[0] for r in one.select(F.spark_partition_id()).distinct().collect()}) == every
    plans, written = [], G.written
    with pytest.MonkeyPatch.context() as m:
        for module in (G, P):
            m.setattr(module, "written", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or written(df))
        rest = P.instance_map(g, ["v"], lambda c: c[0].astype(int))._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plans[0] and "FlatMapGroupsInPandas" in plans[0] and "InPandas" not in rest  # decoded once
        G.assign(g.selectExpr("slab", "z", "y", "x", "if(z = 0, 1, 0) seed"), ["slab"], edge=2)
    rounds = [p for p in plans if "FlatMapCoGroupsInPandas" in p]
    assert len(rounds) == 2 and all(p.count("REPARTITION_BY_NUM") == 2 for p in rounds)


def test_tables_of_candidates_are_not_broadcast(spark):
    """Only the free ids of an anatomy (200 rows) and the counts of ranges are."""
    from gridloom.operators import gate as T

    g = spark.range(4000).selectExpr("id div 800 vol", "id % 800 div 16 z", "id % 16 div 4 y", "id % 4 x", "1 + id % 2 base", "1 + id % 800 div 200 proposal", "id * 0.5D ct")
    found, _ = T.candidates(g, 5)
    plan = T.with_features(g, found)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("BroadcastExchange") <= 2, plan.count("BroadcastExchange")
