"""Elementwise functions on intensities, channels, geometry and strings; all stay in codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The intensity range, and the knots of the intensity map.
HU_RANGE = (-1000.0, 2000.0)
KNOTS = ((-1000.0, 0.0), (-200.0, 0.05), (150.0, 0.35), (700.0, 0.70), (1500.0, 0.92), (2000.0, 1.0))
WINDOW = (-500.0, 1500.0)


def clip(v: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.least(v, F.lit(hi)), F.lit(lo))


def clip_hu(v: Column) -> Column:
    return clip(v, *HU_RANGE)


def piecewise(v: Column, knots=KNOTS) -> Column:
    """Linear between knots, constant beyond the ends."""
    out = F.when(v <= knots[0][0], F.lit(knots[0][1]))
    for (x0, y0), (x1, y1) in zip(knots, knots[1:]):
        out = out.when(v <= x1, F.lit(y0) + (v - x0) * ((y1 - y0) / (x1 - x0)))
    return out.when(v > knots[-1][0], F.lit(knots[-1][1]))


def window01(v: Column, lo: float = WINDOW[0], hi: float = WINDOW[1]) -> Column:
    return (clip(v, lo, hi) - lo) / (hi - lo)


def softmax(channels: list[Column]) -> list[Column]:
    """Shifted by the largest; the sum is 1e-8 at least."""
    top = F.greatest(*channels)
    e = [F.exp(c - top) for c in channels]
    total = F.greatest(reduce(lambda a, b: a + b, e), F.lit(1e-8))
    return [x / total for x in e]


def softmax_array(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    total = F.greatest(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), F.lit(1e-8))
    return F.transform(e, lambda x: x / total)


def sigmoid(v: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-clip(v, -30.0, 30.0)))


def argmax(channels: Column) -> Column:
    """The first of the largest, from 0."""
    return (F.array_position(channels, F.array_max(channels)) - 1).cast("long")


def contact_heads(channels: Column) -> Column:
    """Five head probabilities: of 16 channels or more, a softmax of the first four and a sigmoid of the fifth; else sigmoids, and null."""
    wide = F.concat(softmax_array(F.slice(channels, 1, 4)), F.array(sigmoid(F.element_at(channels, 5))))
    narrow = F.concat(F.transform(F.slice(channels, 1, 4), sigmoid), F.array(F.lit(None).cast("double")))
    return F.when(F.size(channels) >= 16, wide).otherwise(narrow)


def orientation_code(direction: list[Column]) -> Column:
    """Three letters (toward which each image axis runs) of a 3x3 direction matrix, rows x, y, z."""
    letters = (("L", "R"), ("P", "A"), ("S", "I"))

    def letter(axis: int) -> Column:
        d = [direction[3 * r + axis] for r in range(3)]
        top = F.greatest(*[F.abs(x) for x in d])
        out = None
        for r in range(3):
            pick = F.when(d[r] > 0, letters[r][0]).otherwise(letters[r][1])
            out = F.when(F.abs(d[r]) == top, pick) if out is None else out.when(F.abs(d[r]) == top, pick)
        return out

    return F.concat(*[letter(a) for a in range(3)])


def flip_axis(at: Column, extent: Column, flip: Column) -> Column:
    return F.when(flip, extent - 1 - at).otherwise(at)


def near(a: Column, b: Column, tolerance: float) -> Column:
    return F.abs(a - b) <= tolerance


def family_rule(sx: Column, sy: Column, sz: Column, fov_x: Column, fov_z: Column) -> Column:
    """Pelvic or femur by spacing and field of view; the cuts are fixed values."""
    narrow = F.when(sx <= 0.71, "pelvic").when(sz <= 0.90, "femur").when(sy <= 0.91, "pelvic").otherwise("femur")
    wide = F.when(fov_z <= F.when(sz <= 0.68, F.lit(193.55)).otherwise(F.lit(390.78)), "pelvic").otherwise("femur")
    return F.when(fov_x <= 285.35, narrow).otherwise(wide)


def routed_family(rule: Column, learned: Column, p_femur: Column, margin: float = 0.15) -> Column:
    """(family, why): a sure forest first, then the rule, then an unsure forest; null without any."""
    known = F.coalesce(learned.isin("pelvic", "femur"), F.lit(False))
    ruled = F.coalesce(rule.isin("pelvic", "femur"), F.lit(False))
    sure = known & F.coalesce(~F.isnan(p_femur) & (F.abs(p_femur - 0.5) >= margin), F.lit(False))
    pair = lambda f, why: F.struct(f.alias("family"), F.lit(why).alias("why"))
    return F.when(sure, pair(learned, "forest")).when(ruled, pair(rule, "rule")).when(known, pair(learned, "unsure forest"))


def tiles(extent: Column, patch: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.greatest(F.lit(0), extent - patch) / (patch * 0.5)) + 1)


def eta_seconds(dz: Column, dy: Column, dx: Column, patch=(192, 160, 224), each: float = 2.5) -> Column:
    """Seconds for half-overlapping patches over a box; 0 without a box."""
    n = tiles(dz, patch[0]) * tiles(dy, patch[1]) * tiles(dx, patch[2])
    return F.when(dz.isNull() | dy.isNull() | dx.isNull(), 0.0).otherwise(n * each)


def poly_rate(lr0: Column, step: Column, total: Column, power: float = 0.9) -> Column:
    return lr0 * F.pow(F.greatest(F.lit(0.0), 1.0 - step / total), F.lit(power))


def fixed(v: Column, digits: int = 4) -> Column:
    """A number with so many digits, or n/a for null and NaN."""
    return F.when(v.isNull() | F.isnan(v), "n/a").otherwise(F.format_string(f"%.{digits}f", F.bround(v, digits)))


def bar(v: Column, width: int = 30) -> Column:
    n = F.bround(clip(F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0)), 0.0, 1.0) * width).cast("int")
    return F.rpad(F.repeat(F.lit("#"), n), width, ".")


def source_case(sample: Column, prefix: str) -> Column:
    return F.lpad(F.split_part(F.regexp_replace(sample, f"^{prefix}", ""), F.lit("_"), F.lit(1)), 3, "0")


def is_expert(sample: Column, suffixes: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [sample.endswith("_" + s) for s in suffixes])


def recode(v: Column, pairs: dict[int, int], other: int = 0) -> Column:
    out = None
    for a, b in pairs.items():
        out = F.when(v == a, b) if out is None else out.when(v == a, b)
    return (out.otherwise(other) if out is not None else F.lit(other)).cast("long")


def to_lps(code: Column, at: list[Column], extent: list[Column]) -> list[Column]:
    """Coordinates x, y, z after the image axes are permuted and flipped to run toward L, P and S; null if the code lacks a direction."""
    out = []
    for letter, opposite in (("L", "R"), ("P", "A"), ("S", "I")):
        found = [F.when(F.substring(code, k + 1, 1) == letter, at[k]).when(F.substring(code, k + 1, 1) == opposite, extent[k] - 1 - at[k]) for k in range(3)]
        out.append(F.coalesce(*found))
    return out


def same_geometry(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Equal size, spacing and direction within 1e-5, origin within 1e-4; each an array of numbers by these names."""
    close = lambda k, t: F.forall(F.zip_with(a[k], b[k], lambda x, y: F.coalesce(near(x, y, t), F.lit(False))), lambda v: v)
    return (a["size"] == b["size"]) & close("spacing", 1e-5) & close("direction", 1e-5) & close("origin", 1e-4)


def model_path(root: Column, default_root: str, dataset: Column, trainer: Column, own_trainer: Column, plans: str = "nnUNetResEncUNetLPlans", config: str = "3d_fullres") -> Column:
    """root/dataset/trainer__plans__config; without a root the default one, without a trainer (null or empty) the dataset's own."""
    run = F.concat_ws("__", F.coalesce(F.nullif(trainer, F.lit("")), own_trainer), F.lit(plans), F.lit(config))
    return F.concat_ws("/", F.coalesce(root, F.lit(default_root)), dataset, run)


def report_suffix(stem: Column) -> Column:
    """The stem without its first `eval_`."""
    return F.regexp_replace(stem, "(?s)^(.*?)eval_", "$1")


def box_ranges(edges: list[Column]) -> Column:
    """Edges z0, z1, y0, y1, x0, x1 as an array of (start, stop), z first."""
    return F.array(*[F.struct(edges[2 * k].alias("start"), edges[2 * k + 1].alias("stop")) for k in range(3)])


def range_edges(ranges: Column) -> list[Column]:
    """The edges z0, z1, y0, y1, x0, x1 of an array of (start, stop)."""
    return [ranges[k][e].alias(f"{a}{i}") for k, a in enumerate("zyx") for i, e in enumerate(("start", "stop"))]


def by_key(record: Column, fields: list[str], key: Column) -> Column:
    """The named field of a struct as text; fails by name on a key that is none of the fields."""
    known = reduce(lambda w, f: w.when(key == f, record[f].cast("string")), fields[1:], F.when(key == fields[0], record[fields[0]].cast("string")))
    return known.otherwise(F.raise_error(F.concat(F.lit("unknown key: "), F.coalesce(key, F.lit("null")))).cast("string"))
