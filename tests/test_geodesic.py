"""Assignment by paths against a search with a heap, whatever the tiles."""

import heapq

import numpy as np
import pytest

from gridloom.operators import geodesic as G

CELLS = "vol string, z long, y long, x long, seed long"


def heap(cells, spacing, connectivity, most=None):
    """{cell: (label, length)} of {cell: seed}."""
    ways = G.steps(spacing, connectivity)
    done, queue = {}, [(0, s, c) for c, s in cells.items() if s]
    heapq.heapify(queue)
    while queue:
        d, s, c = heapq.heappop(queue)
        if c in done:
            continue
        done[c] = (s, d)
        for o, w in ways:
            n = tuple(np.add(c, o).tolist())
            if n in cells and n not in done:
                heapq.heappush(queue, (d + w, s, n))
    far = None if most is None else most * G.UNIT
    return {c: (s, d / G.UNIT) for c, (s, d) in done.items() if far is None or d <= far}


@pytest.mark.parametrize(("edge", "connectivity", "spacing", "most"), [(64, 1, (1, 1, 1), None), (4, 3, (0.8, 1.0, 1.5), None), (3, 1, (1, 1, 1), None), (5, 2, (1, 2, 1), 4.0)])
def test_equals_a_heap_search(spark, edge, connectivity, spacing, most):
    rng = np.random.default_rng(edge)
    rows, want = [], {}
    for vol in "ab":
        shape = (11, 9, 13)
        inside = np.argwhere(rng.random(shape) < (0.45 if vol == "a" else 0.8)) - [2, 0, 0]
        cells = {tuple(c): 0 for c in inside.tolist()}
        for k, i in enumerate(rng.choice(len(inside), 6, replace=False)):
            cells[tuple(inside[i].tolist())] = 1 + k % 4
        rows += [(vol, *c, s or None) for c, s in cells.items()]
        reached = heap(cells, spacing, connectivity, most)
        want |= {(vol, *c): reached.get(c, (0, None)) for c in cells}
    got = G.assign(spark.createDataFrame(rows, CELLS).repartition(3), ["vol"], spacing, connectivity, edge, most).collect()
    assert {tuple(r)[:4]: (r["label"], r["distance"]) for r in got} == want
    assert {s for s, _ in want.values()} >= {0, 1}


def test_rounds_grow_with_tiles_crossed(spark, monkeypatch):
    """A corridor of 40 voxels in tiles of 10: four rounds, whatever its length inside the tiles."""
    calls = []
    written = G.written
    monkeypatch.setattr(G, "written", lambda df: calls.append(1) or written(df))
    rows = [("a", 0, 0, x, 5 if x == 0 else 0) for x in range(40)]
    got = G.assign(spark.createDataFrame(rows, CELLS), ["vol"], edge=10).collect()
    assert {r["x"]: r["distance"] for r in got} == {x: float(x) for x in range(40)}
    assert (len(calls) - 2) // 3 == 4


def test_ties_walls_and_nothing(spark):
    rows = [("a", 0, 0, x, {0: 9, 4: 2}.get(x, 0)) for x in range(5)] + [("a", 5, 5, 5, 0)]
    got = {(r["z"], r["x"]): (r["label"], r["distance"]) for r in G.assign(spark.createDataFrame(rows, CELLS), ["vol"], edge=2).collect()}
    assert got == {(0, 0): (9, 0.0), (0, 1): (9, 1.0), (0, 2): (2, 2.0), (0, 3): (2, 1.0), (0, 4): (2, 0.0), (5, 5): (0, None)}
    none = spark.createDataFrame([(v, z, y, x, 0) for v, z, y, x, _ in rows], CELLS)
    assert {(r["label"], r["distance"]) for r in G.assign(none, ["vol"]).collect()} == {(0, None)}
    assert G.assign(none.limit(0), ["vol"]).collect() == []
