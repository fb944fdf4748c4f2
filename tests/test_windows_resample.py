"""Sliding windows against a loop over patches, and resampling against array arithmetic."""

import numpy as np
import pytest

from gridloom.operators import resample as R
from gridloom.operators import windows as W

VOX = "vol string, z long, y long, x long, v double"


def rows(volumes):
    return [(k, *map(int, at), float(a[at])) for k, a in volumes.items() for at in np.ndindex(*a.shape)]


def shapes(spark, given, names="nz ny nx"):
    return spark.createDataFrame([(k, *s) for k, s in given.items()], "vol string, " + ", ".join(f"{n} long" for n in names.split()))


def loop(a, model, patch, step, outputs):
    """The blended outputs of one volume, patch by patch."""
    pad = [max(p - n, 0) for n, p in zip(a.shape, patch)]
    low = [p // 2 for p in pad]
    b = np.pad(a, [(q, p - q) for p, q in zip(pad, low)])
    starts = []
    for n, p in zip(b.shape, patch):
        k = int(np.ceil((n - p) / (p * step))) + 1
        starts.append([int(np.round((n - p) / (k - 1) * i)) for i in range(k)] if k > 1 else [0])
    w, total, said = W.gaussian(patch), np.zeros(b.shape), np.zeros((outputs, *b.shape))
    for z in starts[0]:
        for y in starts[1]:
            for x in starts[2]:
                s = slice(z, z + patch[0]), slice(y, y + patch[1]), slice(x, x + patch[2])
                said[(slice(None), *s)] += model(b[s][None]) * w
                total[s] += w
    inner = tuple(slice(q, q + n) for q, n in zip(low, a.shape))
    return (said / total)[(slice(None), *inner)]


@pytest.mark.parametrize(("patch", "step"), [((4, 4, 4), 0.5), ((6, 8, 5), 0.5), ((5, 3, 4), 0.3), ((12, 12, 12), 0.5)])
def test_equals_a_loop_over_patches(spark, patch, step):
    rng = np.random.default_rng(1)
    given = {"a": rng.random((9, 7, 11)), "b": rng.random((4, 10, 5))}
    model = lambda d: np.concatenate([d * 2 - d.mean(), d[:, ::-1].copy()])  # noqa: E731  says different things in each patch
    grid = spark.createDataFrame(rows(given), VOX).repartition(3)
    got = W.predict(grid, shapes(spark, {k: a.shape for k, a in given.items()}), ["vol"], ["v"], 2, model, patch, step)
    want = {k: loop(a, model, patch, step, 2) for k, a in given.items()}
    out = got.collect()
    assert len(out) == sum(a.size for a in given.values())
    for r in out:
        assert (r["p0"], r["p1"]) == pytest.approx(tuple(want[r["vol"]][:, r["z"], r["y"], r["x"]]))


@pytest.mark.parametrize("patch", [(3, 4, 2), (8, 8, 8)])
def test_a_linear_model_needs_no_patches(spark, patch):
    a = np.random.default_rng(2).random((6, 5, 7))
    got = W.predict(spark.createDataFrame(rows({"a": a}), VOX), shapes(spark, {"a": a.shape}), ["vol"], ["v"], 1, lambda d: 3 * d + 1, patch).collect()
    assert all(r["p0"] == pytest.approx(3 * a[r["z"], r["y"], r["x"]] + 1) for r in got)


def test_models_that_break_the_contract_fail_by_name(spark):
    a = np.ones((3, 3, 3))
    run = lambda model: W.predict(spark.createDataFrame(rows({"a": a}), VOX), shapes(spark, {"a": a.shape}), ["vol"], ["v"], 2, model, (2, 2, 2)).collect()
    with pytest.raises(Exception, match=r"the model returned \(1, 2, 2, 2\)"):
        run(lambda d: d)
    with pytest.raises(Exception, match="aren't finite"):
        run(lambda d: np.concatenate([d, d / 0]))


def interpolated(a, shape, orders):
    """Separable interpolation with repeated ends."""
    for axis, (m, order) in enumerate(zip(shape, orders)):
        n = a.shape[axis]
        c = (np.arange(m) + 0.5) * n / m - 0.5
        at = lambda i: np.take(a, np.clip(i, 0, n - 1).astype(int), axis)
        f = (c - np.floor(c)).reshape([-1 if k == axis else 1 for k in range(3)])
        a = at(np.floor(c + 0.5)) if order == 0 else at(np.floor(c)) * (1 - f) + at(np.floor(c) + 1) * f
    return a


TARGETS = {"a": (9, 4, 14), "b": (3, 12, 5)}


@pytest.mark.parametrize("orders", [(1, 1, 1), (0, 1, 1), (0, 0, 0)])
def test_values_and_labels(spark, orders):
    rng = np.random.default_rng(3)
    given = {"a": rng.random((6, 7, 5)), "b": rng.random((6, 6, 6))}
    sizes = shapes(spark, {k: (*a.shape, *TARGETS[k]) for k, a in given.items()}, "nz ny nx mz my mx")
    got = R.values(spark.createDataFrame(rows(given), VOX), sizes, ["vol"], ["v"], orders).collect()
    want = {k: interpolated(a, TARGETS[k], orders) for k, a in given.items()}
    assert len(got) == sum(np.prod(s) for s in TARGETS.values())
    assert all(r["v"] == pytest.approx(want[r["vol"]][r["z"], r["y"], r["x"]]) for r in got)

    ids = {k: rng.choice([0, 0, 1, 2, 7], a.shape) for k, a in given.items()}
    cells = spark.createDataFrame([(k, *map(int, at), int(a[at])) for k, a in ids.items() for at in np.ndindex(*a.shape)], "vol string, z long, y long, x long, label long")
    found = {tuple(r)[:4]: r["label"] for r in R.labels(cells, sizes, ["vol"], orders).collect()}
    for k, a in ids.items():
        out = np.zeros(TARGETS[k], int)
        for label in (1, 2, 7):
            out[np.round(interpolated((a == label).astype(float), TARGETS[k], orders), 9) >= 0.5] = label
        assert {at: int(v) for at, v in np.ndenumerate(out) if v} == {t[1:]: v for t, v in found.items() if t[0] == k}
    with pytest.raises(ValueError, match="orders"):
        R.labels(cells, sizes, ["vol"], (1, 2, 1))


def test_back_to_the_original_grid(spark):
    small = np.arange(8).reshape(2, 2, 2)
    cells = spark.createDataFrame([("a", *map(int, at), int(small[at])) for at in np.ndindex(2, 2, 2)], "vol string, z long, y long, x long, label long")
    sizes = shapes(spark, {"a": (2, 2, 2, 4, 2, 6)}, "nz ny nx mz my mx")
    boxes = shapes(spark, {"a": (1, 3, 2)}, "z0 y0 x0")
    got = {tuple(r)[1:4]: r["label"] for r in R.label_map_to_original(cells, sizes, boxes, ["vol"], (0, 0, 0), (2, 0, 1)).collect()}
    whole = np.zeros((8, 8, 9), int)
    whole[1:5, 3:5, 2:8] = np.repeat(np.repeat(small, 2, 0), 3, 2)
    assert got == {at: int(v) for at, v in np.ndenumerate(whole.transpose(2, 0, 1)) if v}
    with pytest.raises(ValueError, match="permutation"):
        R.reinserted(cells, boxes, ["vol"], (0, 0, 1))
