"""The plan of a whole scan, for all scans at once: masks, routing, regions, decoding, painting, and zeros where it fails.

Everything is keyed by (scan, anatomy) and made of counts and joins, so that thousands of scans are one plan:

1. counts      voxels of the primary and the bone masks, and of their meeting with the other hip's bone
2. routed      the anatomies to decode: a share of the largest primary mask, corrected by the bone masks
3. sourced     the mask of each: the primary one if it is sane, else the bone one, else none
4. parts       the mask's largest component, those over a size, or all of them
5. boxes       the region around it, padded and clamped, with its share and estimated seconds
6. timed       which regions fit the time of a scan, one after the other
7. decode      given by the caller: regions to pieces
8. painted     pieces as ids of their blocks, out of other anatomies' masks, the first anatomy keeps a voxel
   refined     optionally, splits that a second decoder proposes and a gate takes
9. label_map   every voxel of every listed scan; a scan without a result, or with a failed region, is 0 throughout

Tables: scans (scan, nz, ny, nx), cells (scan, anatomy, z, y, x) each once, volume (scan, z, y, x, ...). Anatomies are
1 to 4; 1 to 3 are pelvic, and 2 and 3 are the two hips. Unlike a run on one machine, the time of a scan counts
estimated seconds alone.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import shipped, written
from ..functions import scalar as S
from ..functions.registry import anatomy_of
from .decode import dense
from .graph import tiled_components
from .ranking import slot_cap

ANATOMIES, PELVIC, HIPS = (1, 2, 3, 4), 3, (2, 3)
KEY = ["scan", "anatomy"]
PLACE = ["scan", "z", "y", "x"]


class Rules(NamedTuple):
    """An anatomy is routed from keep_share of the scan's largest mask on; a mask is sane below most_share of the scan. parts is
    largest, floor (from least_part voxels on, or the largest) or union. Regions are padded by pad voxels; a region that would end
    after soft seconds is left out, and none begins after hard ones. Tiles of so many planes are a task's memory in labelling."""

    keep_share: float = 0.20
    most_share: float = 0.35
    reconcile: bool = True
    fallback: bool = True
    parts: str = "largest"
    least_part: int = 1820
    pad: int = 24
    soft: float = 480.0
    hard: float = 540.0
    confine: bool = True
    planes: int = 64


def counts(scans: DataFrame, primary: DataFrame, bones: DataFrame) -> DataFrame:
    """(scan, anatomy, total, n, bone, swapped) of every scan and anatomy: voxels in all, of the primary mask, of the bone mask, and
    of a hip's primary mask inside the other hip's bone."""
    every = scans.select("scan", (F.col("nz") * F.col("ny") * F.col("nx")).alias("total"), F.explode(F.array(*[F.lit(a).cast("long") for a in ANATOMIES])).alias("anatomy"))
    n = primary.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    bone = bones.groupBy(*KEY).agg(F.count(F.lit(1)).alias("bone"))
    other = bones.where(F.col("anatomy").isin(*HIPS)).select("scan", (sum(HIPS) - F.col("anatomy")).alias("anatomy"), "z", "y", "x")
    swapped = primary.join(other, [*KEY, "z", "y", "x"], "left_semi").groupBy(*KEY).agg(F.count(F.lit(1)).alias("swapped"))
    out = every.join(n, KEY, "left").join(bone, KEY, "left").join(swapped, KEY, "left")
    return out.na.fill(0, ["n", "bone", "swapped"])


def routed(found: DataFrame, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """counts with `routed`.

    Without any primary mask a scan is pelvic. Where a pelvic mask is the largest (of equal ones the first), pelvic anatomies
    that have bone are added. A hip without bone of its own, with more than half of its mask in the other hip's bone, is a swap and goes.
    """
    per = found.groupBy("scan").agg(F.max("n").alias("biggest"), F.min_by("anatomy", F.struct(-F.col("n"), F.col("anatomy"))).alias("leader"))
    pelvic = F.col("anatomy") <= PELVIC
    keep = F.when(F.col("biggest") > 0, F.col("n") >= rules.keep_share * F.col("biggest")).otherwise(pelvic)
    if rules.reconcile:
        keep = keep | (pelvic & (F.col("leader") <= PELVIC) & (F.col("bone") > 0))
        keep = keep & ~swap(F.col("anatomy"), F.col("n"), F.col("bone"), F.col("swapped"))
    return found.join(per, "scan").withColumn("routed", keep).drop("biggest", "leader")


def swap(anatomy: Column, n: Column, bone: Column, inside_other: Column) -> Column:
    """Whether a hip's mask is the other hip's: no bone of its own, and more than half of it inside the other's."""
    return anatomy.isin(*HIPS) & (bone == 0) & (n > 0) & (inside_other > 0.5 * n)


def sourced(found: DataFrame, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """routed counts with `source` (primary, fallback or none; null where not routed) and the mask's share of the scan."""
    share, bone = F.col("n") / F.col("total"), F.col("bone") / F.col("total")
    sane = (F.col("n") > 0) & (share < rules.most_share)
    other = (F.col("bone") > 0) & F.lit(rules.fallback)
    source = F.when(sane, "primary").when(other, "fallback").otherwise("none")
    fraction = F.when(~sane & other, bone).otherwise(share)
    return found.withColumn("source", F.when(F.col("routed"), source)).withColumn("fraction", F.when(F.col("routed"), fraction))


def masks(choice: DataFrame, primary: DataFrame, bones: DataFrame) -> DataFrame:
    """The cells of each routed anatomy's mask."""
    of = lambda cells, source: cells.select(*KEY, "z", "y", "x").join(choice.where(F.col("source") == source).select(*KEY), KEY, "left_semi")
    return of(primary, "primary").unionByName(of(bones, "fallback"))


def parts(cells: DataFrame, rules: Rules, extent: tuple[int, int]) -> DataFrame:
    """cells of the components (26 neighbours) that rules.parts keeps; of equally large ones the one that comes first."""
    if rules.parts == "union":
        return cells
    if rules.parts not in ("largest", "floor"):
        raise ValueError(f"unknown parts: {rules.parts}")
    one = len(ANATOMIES) + 1
    named = cells.select((F.col("scan") * one + F.col("anatomy")).alias("_of"), "z", "y", "x")
    found = tiled_components(named, "_of", "true", rules.planes, extent, connectivity=3)
    sizes = found.groupBy("_of", "root").agg(F.count(F.lit(1)).alias("n"))
    top = sizes.groupBy("_of").agg(F.max_by("root", F.struct("n", -F.col("root"))).alias("root"))
    if rules.parts == "floor":
        top = top.unionByName(sizes.where(F.col("n") >= rules.least_part).select("_of", "root")).distinct()
    kept = found.join(top, ["_of", "root"], "left_semi")
    return kept.select(F.expr(f"_of div {one}").alias("scan"), (F.col("_of") % one).alias("anatomy"), "z", "y", "x")


def boxes(cells: DataFrame, scans: DataFrame, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """(scan, anatomy, z0 to x1, box_share, eta): half-open boxes around the cells, padded, inside the scan."""
    ends = cells.groupBy(*KEY).agg(*[f(a).alias(f"{f.__name__}_{a}") for a in "zyx" for f in (F.min, F.max)])
    placed = ends.join(scans.select("scan", "nz", "ny", "nx"), "scan")
    edges = [e for a in "zyx" for e in (F.greatest(F.col(f"min_{a}") - rules.pad, F.lit(0)).alias(f"{a}0"), F.least(F.col(f"max_{a}") + 1 + rules.pad, F.col(f"n{a}")).alias(f"{a}1"))]
    out = placed.select(*KEY, *edges, (F.col("nz") * F.col("ny") * F.col("nx")).alias("total"))
    size = [F.col(f"{a}1") - F.col(f"{a}0") for a in "zyx"]
    return out.withColumns({"box_share": size[0] * size[1] * size[2] / F.col("total"), "eta": S.eta_seconds(*size)}).drop("total")


def timed(regions: DataFrame, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """boxes with `in_time`: by anatomy, those whose seconds still fit after those before them that did."""
    turn = F.array_sort(F.collect_list(F.struct("anatomy", "eta")))  # at most four of a scan
    nothing = F.struct(F.lit(0.0).alias("spent"), F.array().cast("array<bigint>").alias("kept"))

    def step(so_far: Column, r: Column) -> Column:
        fits = (so_far["spent"] < rules.hard) & (so_far["spent"] + r["eta"] <= rules.soft)
        return F.struct((so_far["spent"] + F.when(fits, r["eta"]).otherwise(0.0)).alias("spent"), F.when(fits, F.array_append(so_far["kept"], r["anatomy"])).otherwise(so_far["kept"]).alias("kept"))

    kept = regions.groupBy("scan").agg(turn.alias("turn")).select("scan", F.aggregate("turn", nothing, step)["kept"].alias("kept"))
    return regions.join(kept, "scan").withColumn("in_time", F.array_contains("kept", F.col("anatomy"))).drop("kept")


def region_voxels(volume: DataFrame, regions: DataFrame) -> DataFrame:
    """The volume's voxels in each region's box, with its anatomy: a voxel in two boxes stands twice."""
    edges = [f"{a}{k}" for a in "zyx" for k in (0, 1)]
    inside = [(F.col(a) >= F.col(f"{a}0")) & (F.col(a) < F.col(f"{a}1")) for a in "zyx"]
    # boxes are four a scan at most: the join is one by scan, and the ranges are its filter
    return volume.join(regions.select(*KEY, *edges), "scan").where(inside[0] & inside[1] & inside[2]).drop(*edges)


def decoded(voxels: DataFrame, columns: list[str], decode: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """A decoder of arrays as one for `run`: each region is a task's block. A region on which it fails becomes a row that says why."""

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf[["scan", "anatomy", "z", "y", "x"]]
        try:
            c, places = dense(pdf, columns)
            return at.assign(piece=decode(c)[places].astype(np.int64), failed=None).query("piece > 0")
        except Exception as e:  # noqa: BLE001  whatever a decoder raises costs its scan, not the others
            return at.head(1).assign(piece=0, failed=f"{type(e).__name__}: {e}")

    return voxels.select(*KEY, "z", "y", "x", *columns).groupBy(*KEY).applyInPandas(shipped(voxels, block), "scan long, anatomy long, z long, y long, x long, piece long, failed string")


def painted(pieces: DataFrame, owned: DataFrame | None, cap: int = 50) -> DataFrame:
    """pieces (scan, anatomy, z, y, x, piece) to (scan, z, y, x, anatomy, id).

    The cap largest pieces of an anatomy get the ids of its block; none enters a cell of another anatomy's mask (owned), and
    of several anatomies the first keeps a voxel.
    """
    sizes = pieces.groupBy(*KEY, "piece").agg(F.count(F.lit(1)).alias("n"))
    slots = slot_cap(sizes.withColumn("group", F.struct(*KEY)), "group", "piece", "n", cap).select("group.scan", "group.anatomy", "piece", "slot")
    named = pieces.join(slots, [*KEY, "piece"])
    if owned is not None:
        o = owned.select(*[F.col(c).alias(f"_{c}") for c in (*PLACE, "anatomy")])
        same = [F.col(c) == F.col(f"_{c}") for c in PLACE]
        named = named.join(o, [*same, F.col("anatomy") != F.col("_anatomy")], "left_anti")
    first = named.groupBy(*PLACE).agg(F.min(F.struct("anatomy", "slot")).alias("w"))
    return first.select(*PLACE, "w.anatomy", ((F.col("w.anatomy") - 1) * cap + F.col("w.slot")).alias("id"))


def label_map(volume: DataFrame, ids: DataFrame) -> DataFrame:
    """(scan, z, y, x, id) of every voxel of the volume; 0 where nothing is painted."""
    return volume.select(*PLACE).join(ids.select(*PLACE, "id"), PLACE, "left").withColumn("id", F.coalesce("id", F.lit(0)).cast("long"))


def refined(ids: DataFrame, proposed: DataFrame, volume: DataFrame, value: str, gate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """ids after a gate has taken some of the proposed splits; proposed as painted gives it.

    gate gets and returns (vol, z, y, x, base, proposal, ct), as gate.run_gate does, over painted voxels: the foreground stays.
    """
    grid = ids.join(proposed.select(*PLACE, F.col("id").alias("proposal")), PLACE, "left").join(volume.select(*PLACE, F.col(value).alias("ct")), PLACE)
    out = gate(grid.select(F.col("scan").alias("vol"), "z", "y", "x", F.col("id").alias("base"), F.coalesce("proposal", F.lit(0)).alias("proposal"), "ct"))
    return out.select(F.col("vol").alias("scan"), "z", "y", "x", anatomy_of(F.col("base")).alias("anatomy"), F.col("base").alias("id"))


class Result(NamedTuple):
    """ids (scan, z, y, x, anatomy, id) of painted voxels, and steps: a row for each scan and anatomy."""

    ids: DataFrame
    steps: DataFrame


def run(scans: DataFrame, volume: DataFrame, primary: DataFrame, bones: DataFrame, decode: Callable[[DataFrame], DataFrame], rules: Rules = Rules(), cap: int = 50, propose: Callable[[DataFrame], DataFrame] | None = None, gate: Callable[[DataFrame], DataFrame] | None = None, value: str = "v") -> Result:  # noqa: B008
    """The plan, steps 1 to 8.

    decode takes the regions' voxels (the volume's columns and the anatomy) and returns (scan, anatomy, z, y, x, piece, failed);
    a row with `failed` names a region that gave nothing. With propose, a decoder of the same form, and gate its splits are taken
    as `refined` says, by the volume's column `value`; where it fails, a region has no proposals. A scan with such a region, or without voxels, is painted nowhere.
    steps has (scan, anatomy, n, bone, routed, source, fraction, box_share, eta, status, why, ids, voxels), status being one of
    not routed, no mask, no time, failed, scan failed, empty, painted.
    """
    choice = written(sourced(routed(counts(scans, primary, bones), rules), rules))
    mine = masks(choice, primary, bones)
    extent = scans.agg(F.coalesce(F.max("ny"), F.lit(1)), F.coalesce(F.max("nx"), F.lit(1))).first()
    regions = written(timed(boxes(parts(mine, rules, tuple(extent)), scans, rules), rules))
    voxels = region_voxels(volume, regions.where("in_time"))
    pieces = written(decode(voxels))
    trouble = pieces.where("failed IS NOT NULL").groupBy(*KEY).agg(F.min("failed").alias("why"))
    unread = scans.select("scan").join(volume.select("scan").distinct(), "scan", "left_anti").withColumn("lost", F.lit("no voxels"))
    lost = written(trouble.groupBy("scan").agg(F.first(F.lit("a region failed")).alias("lost")).unionByName(unread))
    good = pieces.where("failed IS NULL AND piece > 0").join(lost, "scan", "left_anti")
    owned = mine if rules.confine else None
    ids = written(painted(good.select(*KEY, "z", "y", "x", "piece"), owned, cap))
    if propose is not None and gate is not None:
        wanted = propose(voxels).where("failed IS NULL AND piece > 0").join(lost, "scan", "left_anti")
        ids = written(refined(ids, painted(wanted.select(*KEY, "z", "y", "x", "piece"), owned, cap), volume, value, gate))

    of = ids.groupBy(*KEY).agg(F.count_distinct("id").alias("ids"), F.count(F.lit(1)).alias("voxels"))
    steps = choice.join(regions.select(*KEY, "box_share", "eta", "in_time"), KEY, "left").join(trouble, KEY, "left").join(lost, "scan", "left").join(of, KEY, "left")
    status = F.when(~F.col("routed"), "not routed").when(F.col("eta").isNull(), "no mask").when(~F.col("in_time"), "no time").when(F.col("why").isNotNull(), "failed").when(F.col("lost").isNotNull(), "scan failed").when(F.col("voxels").isNull(), "empty").otherwise("painted")
    whole = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return Result(ids, steps.select(*KEY, "n", "bone", "routed", "source", "fraction", "box_share", "eta", status.alias("status"), F.coalesce("why", "lost").alias("why"), whole("ids"), whole("voxels")))
