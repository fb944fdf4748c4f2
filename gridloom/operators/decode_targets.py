"""Decoders of predicted class volumes (barrier, core markers, official classes, contact heads), for one block."""

from __future__ import annotations

import numpy as np
import pandas as pd

from . import heal
from . import kernels as K
from .targets import BARRIER, OFFICIAL, V5, fracture_regions


#: What it costs a flood to enter a barrier, by profile, or a contact.
BARRIER_COST, CONTACT_COST = {"geodesic_marker": 12.0, "geodesic_marker_v2": 64.0}, 12.0


def flooded(labels: np.ndarray, seeds: np.ndarray, costs: dict[int, float]) -> np.ndarray:
    """A flood from numbered seeds over the classes that have a cost."""
    price = np.full(max(int(labels.max()), *costs) + 1, np.inf)
    price[list(costs)] = list(costs.values())
    energy = price[labels]
    return K.flood(energy, seeds, np.isfinite(energy))


def nearest_core(labels: np.ndarray) -> np.ndarray:
    """Shell and core by their connected parts (26 neighbours), a part of several cores by the nearest of its own; barrier voxels join what is nearest.

    A voxel's piece is the pair of its part and its core, no core if the part has one at most; pieces are numbered in the order of the pairs.
    """
    parts, n = K.components(np.isin(labels, (BARRIER["shell"], BARRIER["core"])), 3)
    cores, _ = K.components(labels == BARRIER["core"], 3)
    held = np.unique(np.stack([parts[cores > 0], cores[cores > 0]]), axis=1)  # a core lies in one part
    several = np.flatnonzero(np.bincount(held[0], minlength=n + 1) > 1)
    core = np.zeros(labels.shape, np.int64)
    for part in several:
        own = parts == part
        core[own] = K.fill_nearest(np.where(own, cores, 0), own)[own]
    inside = parts > 0
    out = np.zeros(labels.shape, np.int32)
    out[inside] = np.unique(np.stack([parts[inside], core[inside]]), axis=1, return_inverse=True)[1].ravel() + 1
    return K.fill_nearest(out, labels == BARRIER["barrier"])


def barrier(labels: np.ndarray, profile: str = "hard_barrier") -> np.ndarray:
    """hard_barrier: nearest_core. The profiles of BARRIER_COST: a flood from the cores over shell and barrier, or the support's parts if there is no core."""
    if profile == "hard_barrier":
        return nearest_core(labels)
    if profile not in BARRIER_COST:
        raise ValueError(f"unknown decoder profile: {profile}")
    seeds, n = K.components(labels == BARRIER["core"], 1)
    if n == 0:
        return K.components(labels >= BARRIER["barrier"], 1)[0]
    return flooded(labels, seeds, {BARRIER["core"]: 0.0, BARRIER["shell"]: 1.0, BARRIER["barrier"]: BARRIER_COST[profile]})


def healed_cores(core: np.ndarray, room: np.ndarray, least: int, steps: int) -> np.ndarray:
    """Cores closed over gaps of so many steps by faces, inside the room; of the parts those of `least` voxels, or else the largest."""
    reach = range(-steps, steps + 1)
    around = [(i, j, k) for i in reach for j in reach for k in reach if abs(i) + abs(j) + abs(k) <= steps]
    joined = (K.erode(K.dilate(core & room, around), around) | core) & room
    parts, n = K.components(joined, 1)
    if n == 0:
        return joined
    size = np.bincount(parts.ravel(), minlength=n + 1)[1:]
    kept = size >= least if size.max() >= least else np.arange(n) == size.argmax()
    return np.append(False, kept)[parts]


def markers_v5(labels: np.ndarray, healed: bool = False, least_core: int = 128, closings: int = 2) -> tuple[np.ndarray, dict]:
    """A flood from the cores over shell and contact, and a report: seeds, and the parts of the support that have none.

    healed: the cores are healed_cores of the support without contact; what was core and isn't any more counts as shell.
    """
    core = labels == V5["core"]
    if healed and core.any():
        core = healed_cores(core, np.isin(labels, (V5["shell"], V5["core"])), least_core, closings)
    seeds, n = K.components(core, 1)
    classes = np.where(core, V5["core"], np.where(labels == V5["core"], V5["shell"], labels))
    parts, k = K.components(np.isin(classes, (V5["shell"], V5["core"], V5["contact"])), 1)
    missing = np.setdiff1d(np.arange(1, k + 1), parts[core]).tolist()
    report = {"seeds": n, "missing": missing}
    if n == 0:
        return np.zeros(labels.shape, np.int32), report
    return flooded(classes, seeds, {V5["core"]: 0.0, V5["shell"]: 1.0, V5["contact"]: CONTACT_COST}), report


def official_to_instances(classes: np.ndarray, least_core: int = 50) -> np.ndarray:
    """Each connected part's voxels to the nearest of its large enough cores; parts without one give nothing."""
    parts, n = K.components(classes > 0, 3)
    out, last = np.zeros(classes.shape, np.int32), 0
    for p in range(1, n + 1):
        own = parts == p
        cores, _ = K.components(own & (classes == OFFICIAL["core"]), 3)
        sizes = np.bincount(cores.ravel())
        keep = [i for i in range(1, len(sizes)) if sizes[i] >= least_core]
        if keep:
            seeds = np.where(np.isin(cores, keep), np.searchsorted(keep, cores) + 1 + last, 0)
            # first without the contact class, then over it
            local = K.fill_nearest(seeds, own & (classes != OFFICIAL["contact"]))
            local = K.fill_nearest(np.where(own, local, 0), own)
            out[own] = local[own]
            last += len(keep)
    return out


def majority_anatomy(semantic: np.ndarray, inst: np.ndarray) -> dict[int, int]:
    """Most frequent anatomy of 1 to 3 of each instance, the lowest of equal ones."""
    out = {}
    for i in np.unique(inst[inst > 0]).tolist():
        n = np.bincount(semantic[inst == i].astype(int), minlength=4)[1:4]
        if n.sum():
            out[i] = int(np.argmax(n)) + 1
    return out


def nearby(parts: np.ndarray, of: np.ndarray, radius: int) -> dict[int, np.ndarray]:
    """Of each given part the places (raster numbers) of other parts' voxels within so many voxels of it."""
    place, out = np.arange(parts.size).reshape(parts.shape), {}
    for part in of.tolist():
        crop = heal.box(parts == part, radius)
        view = parts[crop]
        out[part] = place[crop][K.dilate_ball(view == part, radius) & (view != part) & (view > 0)]
    return out


def to_global_ids(semantic: np.ndarray, inst: np.ndarray, least: int = 1000, radii: tuple[int, ...] = (3, 10)) -> np.ndarray:
    """Ids of the anatomies' blocks, by falling size, of the connected parts of instances in one anatomy.

    A part of `least` voxels or fewer, with what has joined it, joins the part of its anatomy of which most voxels lie within the first of
    the radii that reaches any (of equal ones the lowest). One of no anatomy of 1 to 3 goes if it is as small.

    What lies near each small part is found once, on the parts as they were; joining only moves pointers, and one sort numbers all.
    """
    both = (semantic > 0) & (inst > 0)
    if not both.any():
        return np.zeros(inst.shape, np.int32)
    kind = np.zeros(inst.shape, np.int64)
    kind[both] = np.unique(np.stack([semantic[both], inst[both]]), axis=1, return_inverse=True)[1].ravel() + 1
    parts, count = K.components_by_value(kind, 3)
    owner, size = np.zeros(count + 1, np.int64), np.bincount(parts.ravel(), minlength=count + 1)
    owner[parts[both]] = semantic[both]
    size[0] = 0  # no part
    small = np.flatnonzero((size > 0) & (size <= least))
    named = small[owner[small] <= 3]
    near = [nearby(parts, named, r) for r in radii]
    flat, head, members = parts.ravel(), np.arange(count + 1), {int(i): [int(i)] for i in named}
    head[np.setdiff1d(small, named)] = 0
    for part in named.tolist():
        for around in near:
            at = np.unique(np.concatenate([around[m] for m in members[part]]))
            votes = np.bincount(head[flat[at]], minlength=count + 1)
            votes[(owner != owner[part]) | (np.arange(count + 1) == part)] = 0
            if votes.any():
                joined = int(votes.argmax())
                head[members[part]] = joined
                members[joined] = members.get(joined, [joined]) + members.pop(part)
                break

    table = pd.DataFrame({"part": head[parts[both]], "anatomy": semantic[both]}).query("part > 0 and anatomy <= 3")
    sizes = table.value_counts(["anatomy", "part"]).rename("n").reset_index().sort_values(["anatomy", "n", "part"], ascending=[True, False, True])
    number = np.zeros(count + 1, np.int32)
    number[sizes["part"]] = 50 * (sizes["anatomy"] - 1) + 1 + sizes.groupby("anatomy").cumcount()
    return np.where(both & (semantic <= 3), number[head[parts]], 0)


def split_official(inst: np.ndarray, classes: np.ndarray, disk: int = 6) -> np.ndarray:
    """Cuts instances of 400 voxels or more along predicted contact, if it is more than an edge and large pieces come of it.

    An instance by itself has no contact, so all that is predicted inside it lacks an explanation.
    """
    line, out = classes == OFFICIAL["contact"], inst.copy()
    room = np.bincount(inst.ravel())
    for i in heal.suspects(inst, line, np.zeros(inst.shape, bool), heal.Limits(0.1, 100)):
        if room[i] < 400:
            continue
        crop = heal.box(inst == i, 1)
        own = inst[crop] == i
        for _, parts, sizes in heal.walls(own, line[crop] & own, 3, 10, confined=False):
            if np.sum(sizes > 400) > 1:
                seeds = np.where(np.append(0, sizes)[parts] > 100, parts, 0)
                out[crop][own] = K.fill_nearest(seeds, own)[own] + out.max()
                break
    return K.relabel(out)[0]


def merge_official(inst: np.ndarray, classes: np.ndarray, semantic: np.ndarray, disk: int = 6, margin: float = 0.05) -> np.ndarray:
    """One pass over pairs of an anatomy that stand within two steps of each other, by falling precedence of their ids: merged
    if the predicted contact fits the merged shape better than the two."""
    line = classes == OFFICIAL["contact"]
    drawn = int(line.sum())

    def misfit(shape: np.ndarray) -> float:
        region = fracture_regions(shape, disk)
        total = int(region.sum()) + drawn
        return 1.0 - 2.0 * int((region & line).sum()) / total if total else 0.0

    owner, room = majority_anatomy(semantic, inst), np.bincount(inst.ravel())
    groups: dict[int | None, list[int]] = {}
    for i in range(1, len(room)):
        if room[i] > 100:
            groups.setdefault(owner.get(i), []).append(i)
    out = inst.copy()
    around = {i: K.dilate_ball(inst == i, 2) for ids in groups.values() for i in ids}
    # a pair's order by (first, second) id over all anatomies doesn't matter: pairs of different ones share no instance
    for ids in groups.values():
        gone: set[int] = set()
        for a in ids:
            for b in (x for x in ids if x > a):
                if a in gone or b in gone or not (around[a] & around[b]).any():
                    continue
                two = np.where(out == a, 1, 2 * (out == b))
                apart, whole = misfit(two), misfit(np.minimum(two, 1))
                if whole < apart - margin or apart == whole == 1.0:
                    out[out == b] = a
                    around[a] |= around[b]
                    gone.add(b)
    return K.relabel(out)[0]


def official(semantic: np.ndarray, classes: np.ndarray, least_core: int = 50, least: int = 1000, disk: int = 6) -> np.ndarray:
    """Cores to instances, ids by anatomy, split, merge, ids again, small ones out, holes filled by the nearest."""
    inside = (semantic >= 1) & (semantic <= 3)
    classes = np.where(inside, classes, 0)
    ids = K.relabel(to_global_ids(semantic, official_to_instances(classes, least_core), least))[0]
    ids = to_global_ids(semantic, merge_official(split_official(ids, classes, disk), classes, semantic, disk), least)
    found, n = np.unique(ids[ids > 0], return_counts=True)
    return K.fill_nearest(np.where(np.isin(ids, found[n < least]), 0, ids), inside & (classes > 0))


def contact_heads(semantic: np.ndarray, support, core, contact, hard) -> np.ndarray:
    """Support less widened contact walls, a flood from the cores on an energy, ids by majority anatomy; weak small islands go."""
    pelvic = (semantic >= 1) & (semantic <= 4)
    wall = K.dilate(pelvic & (contact >= 0.45), [(0, 0, 0), *K.structure(3)])
    place = pelvic & (support >= 0.45) & (hard < 0.60) & ~wall
    seeds, n = K.components(place & (core >= 0.50), 3)
    out = np.zeros(semantic.shape, np.int32)
    if not n:
        return out
    local = K.flood(10.0 * contact + 4.0 * hard + 0.25 * (1.0 - core), seeds, place)
    used = {1: 0, 2: 0, 3: 0}
    for i, a in sorted(majority_anatomy(semantic, local).items()):
        own = (local == i) & (semantic == a)
        if own.sum() < 300 and core[own].max() < 0.35 and support[own].mean() < 0.45:
            continue
        used[a] += 1
        out[own] = 50 * (a - 1) + used[a]
    return out
