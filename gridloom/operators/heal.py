"""Healing of instances: splits along boundary that no neighbour explains, merges of pairs that nothing holds apart.

The evidence comes first and for all instances of a block at once: which predicted boundary has no other
instance near it, and which instances touch. Cuts then try walls of growing width on the few suspects;
merges take the best pair from a queue, where a merge asks anew only for the pairs of its instance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import heappop, heappush
from itertools import count
from typing import NamedTuple

import numpy as np

from . import kernels as K
from .decode import RANGES, pair_means

BORDER, BOUNDARY, CORE = 1, 2, 3


class Limits(NamedTuple):
    """What makes an instance a suspect: unexplained boundary beyond a share of its predicted boundary, or beyond a count."""

    relative: float = 0.1
    absolute: int = 100


def box(mask: np.ndarray, pad: int) -> tuple[slice, ...]:
    at = np.argwhere(mask)
    return tuple(slice(max(0, a - pad), min(n, b + 1 + pad)) for a, b, n in zip(at.min(0), at.max(0), mask.shape, strict=True))


# ------------------------------------------------------------- evidence of a block


def beside_others(labels: np.ndarray, radius: int) -> np.ndarray:
    """Voxels of instances that have another instance within the radius."""
    out = np.zeros(labels.shape, bool)
    for o in K.ball(radius):
        if v := K.views(labels.shape, o):
            here, there = labels[v[1]], labels[v[0]]
            out[v[1]] |= (here > 0) & (there > 0) & (here != there)
    return out


def inner(mask: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Voxels whose six neighbours are masked too and of the same instance."""
    out = mask.copy()
    for o in K.ball(1):
        kept = np.zeros_like(mask)
        if v := K.views(mask.shape, o):
            kept[v[1]] = mask[v[0]] & (labels[v[0]] == labels[v[1]])
        out &= kept
    return out


def suspects(labels: np.ndarray, line: np.ndarray, explained: np.ndarray, limits: Limits) -> dict[int, tuple[int, float]]:
    """(missing voxels, their share of the predicted ones) of the instances whose line lacks an explanation."""
    line = line & (labels > 0)
    n = int(labels.max()) + 1
    predicted = np.bincount(labels[line], minlength=n)
    missing = np.bincount(labels[inner(line & ~explained, labels)], minlength=n)
    share = missing / np.maximum(predicted, 1)
    return {int(i): (int(missing[i]), float(share[i])) for i in np.flatnonzero((share > limits.relative) | (missing > limits.absolute))}


def neighbours(labels: np.ndarray, radius: int) -> dict[int, set[int]]:
    """The instances within the radius of each."""
    near: dict[int, set[int]] = {int(i): set() for i in np.unique(labels[labels > 0])}
    top = int(labels.max()) + 1
    for o in K.ball(radius):
        if o > (0, 0, 0) and (v := K.views(labels.shape, o)):
            a, b = labels[v[0]].astype(np.int64), labels[v[1]].astype(np.int64)
            for key in np.unique((a * top + b)[(a > 0) & (b > 0) & (a != b)]).tolist():
                p, q = divmod(key, top)
                near[p].add(q)
                near[q].add(p)
    return near


# ------------------------------------------------------------- cuts


def walls(own: np.ndarray, line: np.ndarray, radius: int, most: int, confined: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(step, parts, sizes by part) of an instance without ever wider walls along the line."""
    for step in range(1, most + 1):
        line = K.dilate_ball(line, radius, own if confined else None)
        parts, n = K.components(own & ~line, 3)
        yield step, parts, np.bincount(parts.ravel(), minlength=n + 1)[1:]


def split_heal(labels: np.ndarray, hard: np.ndarray, boundary: np.ndarray, relative: float = 0.1, absolute: int = 100, least_piece: int = 400, cut_radius: int = 3, most_cuts: int = 10, interface: int = 3) -> tuple[np.ndarray, list[dict]]:
    """Cuts the suspects in pieces, the second of which has more than the least voxels; the wall's voxels flood back by boundary probability."""
    out, events = labels.copy(), []
    for lab, (missing, share) in suspects(labels, hard == BOUNDARY, beside_others(labels, interface), Limits(relative, absolute)).items():
        crop = box(labels == lab, 1)
        own = labels[crop] == lab
        tries = walls(own, (hard[crop] == BOUNDARY) & own, cut_radius, most_cuts)
        done = next(((step, parts, np.sort(sizes)[::-1]) for step, parts, sizes in tries if len(sizes) > 1 and np.sort(sizes)[-2] > least_piece), None)
        if done:
            step, parts, sizes = done
            seeds = np.where(parts > 0, parts + out.max(), 0)
            out[crop][own] = K.flood(boundary[crop], seeds, own, 3)[own]
            events.append({"label": lab, "pieces": len(sizes), "missing": missing, "error": share, "dilations": step, "second": int(sizes[1])})
    return K.relabel(out)[0], events


def conservative_split(labels, probs, affinities, voxel_mm3: float = 1.0, relative: float = 0.1, absolute: int = 100, least_mm3: float = 1000.0, least_core: int = 50, separation: float = 0.5, ranges: int = 2, cut_radius: int = 3, most_cuts: int = 10, interface: int = 3, most_passes: int = 3) -> tuple[np.ndarray, dict]:
    """Splits in two only: each piece has a least volume and core, and enough affinity ranges separate along the line. Passes end when one changes nothing."""
    hard, out = np.argmax(probs, 0), K.relabel(labels)[0]
    why, accepted = dict.fromkeys(("boundary", "pieces", "core", "affinity"), 0), 0
    apart = np.stack([(1.0 - affinities[list(c)]).max(0) for c in RANGES.values()])

    def halves(own, line, crop) -> tuple[str, np.ndarray | None]:
        """Why not, or the two pieces as seeds 1 and 2."""
        for _, parts, sizes in walls(own, line, cut_radius, most_cuts):
            big = np.flatnonzero(sizes * voxel_mm3 >= least_mm3) + 1
            if len(big) == 2:
                break
        else:
            return "pieces", None
        seeds = (parts == big[0]) + 2 * (parts == big[1])
        if np.bincount(seeds[hard[crop] == CORE], minlength=3)[1:].min() < least_core:
            return "core", None
        agree = sum(bool(line.any()) and float(r[line].mean()) >= separation for r in apart[(slice(None), *crop)])
        return ("affinity", None) if agree < ranges else ("", seeds)

    for _ in range(most_passes):
        before, found = accepted, suspects(out, hard == BOUNDARY, beside_others(out, interface), Limits(relative, absolute))
        why["boundary"] += len(np.unique(out[out > 0])) - len(found)
        now = out.copy()
        for lab in found:
            crop = box(out == lab, 1)
            own = out[crop] == lab
            reason, seeds = halves(own, (hard[crop] == BOUNDARY) & own, crop)
            if seeds is None:
                why[reason] += 1
                continue
            now[crop][own] = K.flood(probs[2][crop], np.where(seeds > 0, seeds + now.max(), 0), own, 3)[own]
            accepted += 1
        out = K.relabel(now)[0]
        if accepted == before:
            break
    return out, {"accepted": accepted, "rejected": why, "fragments": int(out.max())}


# ------------------------------------------------------------- merges


class Meeting:
    """Where two instances' surroundings overlap, in a crop around both."""

    def __init__(self, labels: np.ndarray, a: int, b: int, radius: int):
        self.crop = box((labels == a) | (labels == b), max(20, radius + 2))
        self.labels = labels[self.crop]
        self.mask = K.dilate_ball(self.labels == a, radius) & K.dilate_ball(self.labels == b, radius)

    def mean(self, field: np.ndarray) -> float:
        return float(field[self.crop][self.mask].mean())

    def gain(self, hard: np.ndarray) -> float:
        """How much nearer the predicted boundary is to no meeting (Dice distance 1) than to this one; negative if it stands between the two."""
        line = hard[self.crop] == BOUNDARY
        total = int(self.mask.sum()) + int(line.sum())
        distance = 1 - 2 * int((self.mask & line).sum()) / total if total else 0.0
        return distance - float(line.any())

    def agreeing(self, affinities: np.ndarray, a: int, b: int, at: float, least: int) -> list[float]:
        """Mean affinities between the two of the ranges that have enough pairs of voxels and reach the level."""
        two, local = np.where((self.labels == a) | (self.labels == b), self.labels, 0), affinities[(slice(None), *self.crop)]
        means = (pair_means(two, local, c, separation=False).get((a, b), (0.0, 0)) for c in RANGES.values())
        return [m for m, n in means if n >= least and m >= at]


def merge_best(labels: np.ndarray, judge: Callable[[np.ndarray, int, int], dict | None], radius: int, most: int) -> tuple[np.ndarray, list[dict]]:
    """Merges the pair of the best score, the lowest of equal ones, until none is left.

    A verdict depends on its two instances alone, so it stands until one of them changes; the queue holds
    every verdict with the versions of its instances.
    """
    out, near, events = labels.copy(), neighbours(labels, radius), []
    version, nth, queue = dict.fromkeys(near, 0), count(), []

    def ask(a: int, b: int) -> None:
        if e := judge(out, a, b):
            heappush(queue, (-e["score"], a, b, next(nth), version[a], version[b], e))

    for a in sorted(near):
        for b in sorted(x for x in near[a] if x > a):
            ask(a, b)
    while queue and len(events) < most:
        _, a, b, _, at_a, at_b, e = heappop(queue)
        if version.get(a) != at_a or version.get(b) != at_b:
            continue
        out[out == b] = a
        events.append(e)
        del version[b]
        version[a] += 1
        near[a] = (near[a] | near.pop(b)) - {a, b}
        for x in sorted(near[a]):
            near[x] = (near[x] - {b}) | {a}
            ask(min(a, x), max(a, x))
    return K.relabel(out)[0], events


def merge_heal(labels, hard, adjacency: int = 2, interface: int = 3, margin: float = 0.05 / 3, most: int = 100):
    """Merges pairs that the predicted boundary doesn't hold apart."""

    def judge(out, a, b):
        gain = Meeting(out, a, b, interface).gain(hard)
        return {"left": a, "right": b, "score": gain} if gain > margin else None

    return merge_best(labels, judge, adjacency, most)


def refine(labels, probs, passes: int = 3, **split) -> tuple[np.ndarray, dict]:
    """Clears background, heals splits in passes, then merges."""
    hard = np.argmax(probs, 0)
    solid = hard > 0
    out, n = K.relabel(np.where(solid, labels, 0))
    splits: list[dict] = []
    for k in range(1, passes + 1):
        out, events = split_heal(out, hard, probs[2], **split)
        splits += [{**e, "pass": k} for e in events]
    merged, merges = merge_heal(out, hard)
    final, fragments = K.relabel(np.where(solid, merged, 0))
    return final, {"initial": n, "hard": np.bincount(hard.ravel(), minlength=4).tolist(), "splits": splits, "after_split": int(out.max()), "merges": merges, "fragments": int(fragments)}


def soft_merge(labels, probs, affinities, most_boundary: float = 0.30, at: float = 0.55, ranges: int = 2, least: int = 8, adjacency: int = 2, interface: int = 3, most: int = 100):
    """Merges pairs on whose meeting the border outweighs a weak boundary and enough affinity ranges agree."""
    seen = {"examined": 0, "boundary": 0, "affinity": 0}

    def judge(out, a, b):
        seen["examined"] += 1
        where = Meeting(out, a, b, interface)
        boundary, border = where.mean(probs[BOUNDARY]), where.mean(probs[BORDER])
        if not boundary < border or boundary > most_boundary:
            seen["boundary"] += 1
            return None
        means = where.agreeing(affinities, a, b, at, least)
        if len(means) < ranges:
            seen["affinity"] += 1
            return None
        return {"left": a, "right": b, "score": border - boundary + float(np.mean(means))}

    out, events = merge_best(labels, judge, adjacency, most)
    return out, seen | {"accepted": len(events), "fragments": int(out.max()), "events": events}


REASONS = ("interface", "boundary", "candidate_size", "core_veto", "border_veto", "affinity")


def progressive_merge(labels, probs, affinities, spacing=(1.0, 1.0, 1.0), small_strict: bool = True, small_veto: bool = False, mutual: bool = False, least_mm3: float = 1000.0, small_mm3: float = 5000.0, least_gain: float = -0.25, at: float = 0.55, large_ranges: int = 2, small_ranges: int = 3, least: int = 8, core_veto: float = 0.25, border_veto: float = 0.40, adjacency: int = 2, interface: int = 3, most: int = 100):
    """Merges pairs by boundary and affinity evidence, the best first, or all mutual best ones in one round; counts why pairs are rejected."""
    hard, voxel = np.argmax(probs, 0), float(np.prod(spacing))
    rejected = dict.fromkeys(REASONS, 0)

    def verdict(out, a, b) -> str | dict:
        where = Meeting(out, a, b, interface)
        if not where.mask.any():
            return "interface"
        gain = where.gain(hard)
        if gain <= least_gain:
            return "boundary"
        n, minor = min((int((where.labels == x).sum()), x) for x in (a, b))
        if n * voxel < least_mm3:
            return "candidate_size"
        is_small = n * voxel < small_mm3
        if is_small and small_veto:
            if np.mean(hard[where.crop][where.labels == minor] == CORE) >= core_veto:
                return "core_veto"
            if where.mean(probs[BORDER]) >= border_veto:
                return "border_veto"
        means = where.agreeing(affinities, a, b, at, least)
        if len(means) < (small_ranges if is_small and small_strict else large_ranges):
            return "affinity"
        return {"left": a, "right": b, "score": float(np.mean(means)) + gain, "gain": gain}

    def judge(out, a, b):
        v = verdict(out, a, b)
        if isinstance(v, str):
            rejected[v] += 1
            return None
        return v

    if mutual:
        out, events = merge_mutual(labels, judge, adjacency)
    else:
        out, events = merge_best(labels, judge, adjacency, most)
    return out, {"accepted": len(events), "fragments": int(out.max()), "rejected": rejected, "events": events}


def merge_mutual(labels: np.ndarray, judge: Callable, radius: int) -> tuple[np.ndarray, list[dict]]:
    """Merges, in one round, the pairs that are the best of both their ends."""
    rank = lambda e: (-e["score"], e["left"], e["right"])
    best: dict[int, dict] = {}
    for a, around in neighbours(labels, radius).items():
        for b in sorted(x for x in around if x > a):
            if e := judge(labels, a, b):
                for end in (a, b):
                    best[end] = min(best.get(end, e), e, key=rank)
    events = sorted((e for a, e in best.items() if a == e["left"] and best[e["right"]] is e), key=rank)
    into = np.arange(int(labels.max()) + 1)
    for e in events:
        into[e["right"]] = e["left"]
    return K.relabel(into[labels])[0], events


def fill_mask(labels: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, int]:
    """Instances grown at equal cost over the mask and themselves; (labels, voxels filled). Voxels of instances never change."""
    out = K.flood(np.zeros(labels.shape), labels, mask | (labels > 0))
    return out, int(((out > 0) & (labels == 0)).sum())
