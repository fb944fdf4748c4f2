import random

import numpy as np
import pytest

from gridloom.operators import graph, kernels


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 20)] + [(200 + k, 230) for k in range(20)] + [(5, 5), (301, 300)]
    random.Random(1).shuffle(edges)
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + k: 100 for k in range(1, 20)}, **{k: 200 for k in [*range(201, 220), 230]}, 301: 300}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("connectivity,planes", [(1, 3), (3, 4), (2, 50)])
def test_tiles_give_the_whole_volumes_components(spark, connectivity, planes):
    r = np.random.default_rng(connectivity)
    rows, want = [], {}
    for vol in (1, 2):
        m = r.random((13, 5, 6)) < 0.3
        parts, n = kernels.components(m, connectivity)
        for p in range(1, n + 1):
            at = np.argwhere(parts == p).tolist()
            first = min((z * 5 + y) * 6 + x for z, y, x in at)
            want |= {(vol, *a): first for a in at}
        rows += [(vol, *p, bool(m[tuple(p)])) for p in np.argwhere(np.ones(m.shape)).tolist()]
    g = spark.createDataFrame(rows, "vol long, z long, y long, x long, m boolean")
    got = {tuple(q)[:4]: q["root"] for q in graph.tiled_components(g, "vol", "m", planes, (5, 6), connectivity).collect()}
    assert got == want
