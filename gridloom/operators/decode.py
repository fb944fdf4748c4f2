"""Decoders from class probabilities and affinities to instances, for one block; `per_block` runs them in Spark.

Classes: 0 background, 1 border, 2 boundary, 3 core. Affinity channels 0-2, 3-5 and 6-8 are the three
axes at the distances 1, 3 and 9.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..cluster import dealt, shipped
from . import kernels as K

RANGES = {"short": (0, 1, 2), "mid": (3, 4, 5), "long": (6, 7, 8)}
OFFSETS = [tuple(d if a == axis else 0 for a in range(3)) for d in (1, 3, 9) for axis in range(3)]


# ------------------------------------------------------------- small fragments


def absorb(labels: np.ndarray, small: np.ndarray, zero_if_all: bool = True) -> np.ndarray:
    """labels without the small ids; their voxels take the nearest kept label, or 0 where none is kept."""
    kept = np.where(np.isin(labels, small), 0, labels)
    if not (kept > 0).any():
        return kept if zero_if_all else labels.copy()
    return K.fill_nearest(kept, labels > 0)


def _sizes(labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(labels[labels > 0], return_counts=True)


def drop_small(labels: np.ndarray, least: int) -> np.ndarray:
    ids, n = _sizes(labels)
    return K.relabel(absorb(labels, ids[n < least]))[0] if (n < least).any() else labels


def drop_by_ratio(labels: np.ndarray, ratio: float) -> np.ndarray:
    ids, n = _sizes(labels)
    if ratio <= 0 or len(ids) <= 1 or not (n < ratio * n.max()).any():
        return labels
    return K.relabel(absorb(labels, ids[n < ratio * n.max()]))[0]


def merge_small_by_component(labels: np.ndarray, least: int) -> np.ndarray:
    """A small component goes whole to the label nearest to most of its voxels, the lowest of equal ones; without a large label nothing changes."""
    ids, n = _sizes(labels)
    small, large = ids[n < least], ids[n >= least]
    if not len(small) or not len(large):
        return K.relabel(labels)[0]
    nearest = K.fill_nearest(np.where(np.isin(labels, large), labels, 0), labels > 0)
    out = labels.copy()
    for s in small:
        parts, k = K.components(labels == s, 3)
        for p in range(1, k + 1):
            votes, count = np.unique(nearest[parts == p], return_counts=True)
            out[parts == p] = votes[np.argmax(count)]
    return K.relabel(out)[0]


# ------------------------------------------------------------- decoders


def core_seed(probs: np.ndarray, background: float = 0.5, core: float = 0.5, least: int = 1820, ratio: float = 0.0) -> np.ndarray:
    """Cores flood the support by their distance; small results join the nearest."""
    support = probs[0] < background
    seeds, n = K.components((probs[3] >= core) & support, 3)
    if not n:
        labels = support.astype(np.int32)
    else:
        labels = K.fill_nearest(K.flood(K.edt(seeds > 0)[0], seeds, support), support)
    ids, counts = _sizes(labels)
    if least > 1 and (counts < least).any():
        labels = absorb(labels, ids[counts < least])
    ids, counts = _sizes(labels)
    if ratio > 0 and len(ids) > 1 and (counts < ratio * counts.max()).any():
        labels = absorb(labels, ids[counts < ratio * counts.max()])
    return labels


def _seeds(core: np.ndarray, ridge: np.ndarray, foreground: np.ndarray, seed_core: float, seed_ridge: float) -> np.ndarray:
    markers, n = K.components((core > seed_core) & (ridge < seed_ridge) & foreground, 1)
    if n > 1:
        return markers
    depth = K.edt(ridge >= seed_ridge)[0]
    depth = np.where(np.isfinite(depth), depth, float(sum(depth.shape))) * foreground
    # peaks: deepest of their 9 x 9 x 9 surroundings
    top = depth.copy()
    for axis in range(3):
        padded = np.pad(top, [(4, 4) if a == axis else (0, 0) for a in range(3)], constant_values=-1)
        top = np.max([np.take(padded, range(k, k + depth.shape[axis]), axis) for k in range(9)], axis=0)
    markers, n = K.components((depth == top) & (depth > 0) & foreground, 1)
    return markers if n else K.components(foreground, 1)[0]


def _agglomerate(ridge: np.ndarray, markers: np.ndarray, foreground: np.ndarray, limit: float, weigh: Callable | None = None) -> np.ndarray:
    regions = K.flood(ridge, markers, foreground)
    if regions.max() <= 1:
        return (regions > 0).astype(np.int32)
    edges = K.region_edges(regions, ridge)
    if weigh:
        edges = weigh(regions, edges)
    group = K.link_regions(edges, limit)
    table = np.arange(regions.max() + 1)
    for a, b in group.items():
        table[a] = b
    return table[regions]


def agglomerate(probs: np.ndarray, limit: float = 0.45, least: int = 250, seed_core: float = 0.5, seed_ridge: float = 0.2, ratio: float = 0.0) -> np.ndarray:
    """Seeds in strong cores, a flood over the boundary ridges, then average linkage of regions below the limit."""
    fg = probs[0] < 0.5
    if not fg.any():
        return np.zeros(fg.shape, np.int32)
    labels = _agglomerate(probs[2], _seeds(probs[3], probs[2], fg, seed_core, seed_ridge), fg, limit)
    return drop_by_ratio(drop_small(K.relabel(labels)[0], least), ratio)


def with_separation(probs: np.ndarray, affinities: np.ndarray, short=RANGES["short"]) -> np.ndarray:
    """The boundary channel replaced by one less the weakest short affinity."""
    return np.stack([probs[0], probs[1], 1.0 - affinities[list(short)].min(0), probs[3]])


def affinity_agglomerate(probs, affinities, limit: float = 0.45, least: int = 250) -> np.ndarray:
    return agglomerate(with_separation(probs, affinities), limit, least)


def pair_means(labels: np.ndarray, affinities: np.ndarray, channels, separation: bool = True) -> dict[tuple[int, int], tuple[float, int]]:
    """Mean of 1 - affinity (or of affinity) and the count over the channels' offsets, of pairs of different labels."""
    lo, hi, val = [], [], []
    for k in channels:
        if v := K.views(labels.shape, OFFSETS[k]):
            a, b = labels[v[0]], labels[v[1]]
            hit = (a > 0) & (b > 0) & (a != b)
            lo.append(np.minimum(a, b)[hit])
            hi.append(np.maximum(a, b)[hit])
            val.append(affinities[k][v[0]][hit].astype(float))
    if not lo or not sum(map(len, lo)):
        return {}
    pairs, inverse, n = np.unique(np.stack([np.concatenate(lo), np.concatenate(hi)], 1), axis=0, return_inverse=True, return_counts=True)
    s = np.bincount(inverse.ravel(), weights=np.concatenate(val)) / n
    return {(int(a), int(b)): (1.0 - m if separation else m, int(k)) for (a, b), m, k in zip(pairs, s, n)}


def multirange(probs, affinities, limit: float = 0.75, least: int = 250, seed_core: float = 0.5, seed_ridge: float = 0.2, least_pairs: int = 32, mid: bool = True, long: bool = True) -> tuple[np.ndarray, dict]:
    """Linkage on the largest of the short, mid and long separations; the report counts covered and vetoed edges."""
    fg = probs[0] < 0.5
    report = dict.fromkeys(("supervoxels", "edges", "mid_covered", "long_covered", "mid_veto", "long_veto", "any_veto", "fragments"), 0)
    if not fg.any():
        return np.zeros(fg.shape, np.int32), report
    ridge = 1.0 - affinities[:3].min(0)

    def weigh(regions, edges):
        far = {name: pair_means(regions, affinities, RANGES[name]) for name, used in (("mid", mid), ("long", long)) if used}
        report["edges"] = len(edges)
        out = {}
        for pair, (short, n) in edges.items():
            score = short
            for name, evidence in far.items():
                value, seen = evidence.get(pair, (0.0, 0))
                if seen >= least_pairs:
                    report[f"{name}_covered"] += 1
                    report[f"{name}_veto"] += short < limit <= value
                    score = max(score, value)
            report["any_veto"] += short < limit <= score
            out[pair] = (score, n)
        return out

    markers = _seeds(probs[3], ridge, fg, seed_core, seed_ridge)
    report["supervoxels"] = int(markers.max())
    labels = drop_small(K.relabel(_agglomerate(ridge, markers, fg, limit, weigh))[0], least)
    report["fragments"] = int(labels.max())
    return labels, report


def fuse(base: np.ndarray, probs, affinities, limit: float = 0.45, least: int = 250, seed_core: float = 0.5, seed_ridge: float = 0.2, ridge_at: float = 0.5, least_ridge: int = 1500) -> np.ndarray:
    """Splits a base instance only if a coherent ridge of the least size stands in it; never crosses base borders.

    Ridges and seeds of all instances are labelled at once, by instance; what they are too few or too small
    for is settled by counting, and the rest floods one instance at a time.
    """
    ridge = 1.0 - affinities[:3].min(0)
    room = np.bincount(base.ravel())

    def parts_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Labelled parts of the mask by instance; each part's instance and size."""
        parts, n = K.components_by_value(np.where(mask, base, 0), 1)
        owner = np.zeros(n + 1, base.dtype)
        owner[parts[mask]] = base[mask]
        return parts, owner, np.bincount(parts.ravel(), minlength=n + 1)

    _, owner, size = parts_of((base > 0) & (ridge >= ridge_at))
    torn = np.unique(owner[1:][size[1:] >= least_ridge])
    seeds, owner, _ = parts_of((base > 0) & (probs[3] > seed_core) & (ridge < seed_ridge))
    many = np.bincount(owner[1:], minlength=len(room)) > 1
    pieces = np.zeros(base.shape, np.int64)
    for lab in torn[(room[torn] >= 2 * least) & many[torn]].tolist():
        own = base == lab
        found = drop_small(_agglomerate(ridge, K.relabel(np.where(own, seeds, 0))[0], own, limit), least)
        if (found[own] > 0).all():
            pieces[own] = found[own]
    out = np.zeros(base.shape, np.int32)
    inside = base > 0
    out[inside] = np.unique(np.stack([base[inside], pieces[inside]]), axis=1, return_inverse=True)[1].ravel() + 1
    return out


# ------------------------------------------------------------- in Spark


def dense(pdf: pd.DataFrame, columns: list[str]) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """(channels, z, y, x) of a block's rows, zeros where none stands, and the rows' places."""
    at = tuple((pdf[a] - pdf[a].min()).to_numpy() for a in "zyx")
    shape = tuple(int(v.max()) + 1 for v in at)
    out = np.zeros((len(columns), *shape))
    for k, c in enumerate(columns):
        out[(k, *at)] = pdf[c]
    return out, at


def per_block(grid: DataFrame, by: str, columns: list[str], decode: Callable[[np.ndarray], np.ndarray], out: str = "instance") -> DataFrame:
    """(by, z, y, x, out) of decode(channels) on each block. A block is one task's memory: cut volumes into regions of interest first.
    Blocks are dealt to all shuffle partitions, as they take long for their bytes."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        channels, at = dense(pdf, columns)
        return pdf[[by, "z", "y", "x"]].assign(**{out: decode(channels)[at].astype(np.int64)})

    return dealt(grid.select(by, "z", "y", "x", *columns), by).groupBy(by).applyInPandas(shipped(grid, run), f"{by} long, z long, y long, x long, {out} long")
