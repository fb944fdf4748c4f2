"""Surface distances, component pruning and candidate features, as numpy kernels under applyInPandas."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..cluster import shipped
from . import kernels as K
from .decode import dense


def surface(mask: np.ndarray) -> np.ndarray:
    return mask & ~K.erode(mask, [(0, 0, 0), *K.structure(1)])


def distances(a: np.ndarray, b: np.ndarray, spacing=(1.0, 1.0, 1.0)) -> np.ndarray | None:
    """Both directed sets of border distances together; none if one side is empty."""
    if not a.any() or not b.any():
        return None
    sa, sb = surface(a), surface(b)
    return np.concatenate([K.edt(sb, spacing)[0][sa], K.edt(sa, spacing)[0][sb]])


def surface_scores(a: np.ndarray, b: np.ndarray, spacing=(1.0, 1.0, 1.0), tolerance: float = 2.0) -> dict:
    """Dice, HD95, ASSD and surface Dice: 0 mm for equal masks (both empty too), null if one is empty."""
    both = int(a.sum()) + int(b.sum())
    out = {"dice": 2 * int((a & b).sum()) / both if both else 1.0}
    if (a == b).all():
        return out | {"hd95": 0.0, "assd": 0.0, "nsd": 1.0}
    d = distances(a, b, spacing)
    return out | ({"hd95": None, "assd": None, "nsd": None} if d is None else {"hd95": float(np.percentile(d, 95)), "assd": float(d.mean()), "nsd": float((d <= tolerance).mean())})


def surface_table(grid: DataFrame, by: str, a: str, b: str, spacing=(1.0, 1.0, 1.0), tolerance: float = 2.0) -> DataFrame:
    """(by, dice, hd95, assd, nsd) of the boolean columns a and b in each block."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v, _ = dense(pdf.astype({a: int, b: int}), [a, b])
        return pd.DataFrame([{by: pdf[by].iloc[0]} | surface_scores(v[0] > 0, v[1] > 0, spacing, tolerance)])

    return grid.select(by, "z", "y", "x", a, b).groupBy(by).applyInPandas(shipped(grid, run), f"{by} long, dice double, hd95 double, assd double, nsd double")


def component_table(grid: DataFrame, by: str, mask: str, connectivity: int = 1) -> DataFrame:
    """(by, z, y, x, root): of each masked voxel, the raster number in its block of its component's first voxel."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v, at = dense(pdf.astype({mask: int}), [mask])
        parts, n = K.components(v[0] > 0, connectivity)
        first = np.full(n + 1, -1)
        flat = parts.ravel()
        places = np.flatnonzero(flat)
        first[flat[places[::-1]]] = places[::-1]
        out = pdf[[by, "z", "y", "x"]].assign(root=first[parts[at]])
        return out[out["root"] >= 0]

    return grid.select(by, "z", "y", "x", mask).groupBy(by).applyInPandas(shipped(grid, run), f"{by} long, z long, y long, x long, root long")


def nearest_table(grid: DataFrame, by: str, label: str, where: str, spacing=(1.0, 1.0, 1.0)) -> DataFrame:
    """(by, z, y, x, distance, filled): of each voxel of `where` without a label, to the nearest labelled voxel, and its label."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v, at = dense(pdf.astype({where: int}), [label, where])
        labels = v[0].astype(np.int64)
        d, nearest = K.edt(labels > 0, spacing)
        out = pdf[[by, "z", "y", "x"]].assign(distance=d[at], filled=np.where(nearest[at] >= 0, labels.ravel()[nearest[at]], 0))
        return out[(v[1][at] > 0) & (labels[at] == 0) & np.isfinite(out["distance"])]

    return grid.select(by, "z", "y", "x", label, where).groupBy(by).applyInPandas(shipped(grid, run), f"{by} long, z long, y long, x long, distance double, filled long")


def prune_components(inst: np.ndarray, least: int, connectivity: int = 1) -> np.ndarray:
    """Components of each id with fewer voxels become 0."""
    parts, n = K.components_by_value(inst, connectivity)
    sizes = np.bincount(parts.ravel(), minlength=n + 1)
    return np.where(sizes[parts] >= least, inst, 0)


def signed_distance(prob: np.ndarray, spacing=(1.0, 1.0, 1.0), limit: float = 40.0) -> np.ndarray:
    """Inside less outside distance of p >= 0.5, clipped and scaled to [-1, 1]; zeros without an inside."""
    mask = prob >= 0.5
    if not mask.any():
        return np.zeros(prob.shape)
    inside = K.edt(~mask, spacing)[0] if (~mask).any() else np.full(prob.shape, limit)
    return np.clip(np.where(mask, inside, -K.edt(mask, spacing)[0]), -limit, limit) / limit


def skeleton_parts(volume: np.ndarray, threshold: float = 200.0, least: int = 10_000) -> dict[str, np.ndarray]:
    """Of the three largest bony parts: the most central along x, then the lower and the higher x."""
    parts, n = K.components(K.opening(volume > threshold), 3)
    sizes = np.bincount(parts.ravel())[1:] if n else np.zeros(0, int)
    top = [i for i in np.argsort(-sizes, kind="stable")[:5].tolist() if sizes[i] >= least][:3]
    if not top:
        return {}
    cx = {i: float(np.nonzero(parts == i + 1)[2].mean()) for i in top}
    middle = volume.shape[2] / 2
    sacrum = min(top, key=lambda i: (abs(cx[i] - middle), i))
    rest = sorted((i for i in top if i != sacrum), key=lambda i: cx[i])
    out = {"Sacrum": sacrum}
    if len(rest) == 2:
        out |= {"RightHip": rest[0], "LeftHip": rest[1]}
    elif rest:
        out["RightHip" if cx[rest[0]] < middle else "LeftHip"] = rest[0]
    return {name: parts == i + 1 for name, i in out.items()}


#: The names by which stored models ask for features of a candidate's shape and intensities.
SHAPE_FEATURES = (
    "source_log_volume_cm3", "source_component_count", "source_bbox_short_mm", "source_bbox_mid_mm", "source_bbox_long_mm", "source_bbox_elongation", "piece_small_volume_cm3", "piece_large_volume_cm3", "piece_small_large_ratio",
    "isolated_piece_fraction", "piece_component_count", "remainder_component_count", "piece_surface_fraction", "remainder_surface_fraction", "interface_voxels", "interface_source_fraction", "centroid_distance_mm",
    "centroid_distance_radius_ratio", "ct_piece_mean", "ct_remainder_mean", "ct_absolute_mean_difference", "ct_standardized_mean_difference", "ct_piece_std", "ct_remainder_std",
)


def candidate_features(source: np.ndarray, piece: np.ndarray, ct: np.ndarray, spacing=(1.0, 1.0, 1.0)) -> dict[str, float]:
    """SHAPE_FEATURES of splitting a piece off a source: one table of moments of the two sides, then their combinations."""
    side = np.where(piece, 1, 0)[source]
    place, value = np.argwhere(source) * np.asarray(spacing, float), ct[source].astype(float)
    n = np.bincount(side, minlength=2)
    mean_of = lambda x: np.bincount(side, weights=x, minlength=2) / np.maximum(n, 1)
    mean = mean_of(value)
    std = np.sqrt(mean_of((value - mean[side]) ** 2))
    center = np.stack([mean_of(place[:, k]) for k in range(3)], 1)
    sides = np.sort(np.ptp(place, axis=0) + np.asarray(spacing, float))
    full = [(0, 0, 0), *K.structure(3)]
    masks = {"source": source, "piece": piece, "remainder": source & ~piece}
    voxel, total = float(np.prod(spacing)), int(n.sum())
    meet = int((K.dilate(piece, full) & masks["remainder"]).sum())
    apart, gap = float(np.linalg.norm(center[1] - center[0])), float(abs(mean[1] - mean[0]))
    found = {f"{k}_component_count": K.components(m, 3)[1] for k, m in masks.items()}
    found |= {f"{k}_surface_fraction": 1.0 - K.erode(m, full).sum() / max(m.sum(), 1) for k, m in masks.items() if k != "source"}
    found |= {f"source_bbox_{k}_mm": x for k, x in zip(("short", "mid", "long"), sides, strict=True)}
    found |= {f"piece_{k}_volume_cm3": x * voxel / 1000 for k, x in zip(("small", "large"), np.sort(n), strict=True)}
    found |= {f"ct_{k}_mean": mean[i] for k, i in (("piece", 1), ("remainder", 0))} | {f"ct_{k}_std": std[i] for k, i in (("piece", 1), ("remainder", 0))}
    found |= {
        "source_log_volume_cm3": np.log1p(total * voxel / 1000), "source_bbox_elongation": sides[2] / max(sides[0], 1e-6), "piece_small_large_ratio": n.min() / max(n.max(), 1), "isolated_piece_fraction": n[1] / max(total, 1),
        "interface_voxels": meet, "interface_source_fraction": meet / max(total, 1), "centroid_distance_mm": apart, "centroid_distance_radius_ratio": apart / max((3 * total * voxel / (4 * np.pi)) ** (1 / 3), 1e-6),
        "ct_absolute_mean_difference": gap, "ct_standardized_mean_difference": gap / max(float(np.sqrt(np.mean(std**2))), 1e-6),
    }
    return {k: float(found[k]) for k in SHAPE_FEATURES}
