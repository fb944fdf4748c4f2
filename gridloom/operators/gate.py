"""Split candidates scored by injected regressors: enumerate, predict, select, apply; all keyed by volume and source.

The tables are long: a grid has (vol, z, y, x, base, proposal, ct). Overlaps, ranks, ids and features are relational; only
the injected models see rows as arrays.
"""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..cluster import shipped
from ..functions.registry import ANATOMIES, anatomy_of
from .ranking import select_splits
from .shape import shape_features
from .surfaces import SHAPE_FEATURES

TARGETS = ("merge", "split", "dice", "f1", "precision")
#: The names by which stored models ask for features of the decoders' reports.
CONTEXT_FEATURES = (
    "context_initial_supervoxels", "context_initial_rag_edges", "context_mid_coverage", "context_long_coverage", "context_veto_fraction", "context_abbc_border_fraction", "context_abbc_boundary_fraction",
    "context_abbc_core_fraction", "context_accepted_splits", "context_max_relative_error", "context_mean_relative_error",
)
KEYS = ("models", "feature_names", "policy", "quality_guards")


def check_payload(payload: dict, keys=KEYS) -> dict:
    missing = [k for k in keys if k not in payload]
    if missing:
        raise KeyError(f"the model lacks {', '.join(missing)}")
    return payload


def load_payload(spark: SparkSession, path: str, keys=KEYS) -> dict:
    """A pickled model of your own making, from any store that Spark reads; never load one that you don't trust. Fails by name if keys
    are missing, or regressors that can't predict."""
    payload = check_payload(pickle.loads(spark.read.format("binaryFile").load(path).select("content").first()["content"]), keys)
    deaf = sorted(k for k, m in payload.get("models", {}).items() if not callable(getattr(m, "predict", None)))
    if deaf:
        raise TypeError(f"these models can't predict: {', '.join(deaf)}")
    return payload


def candidates(grid: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(candidates, rejected): (vol, anatomy, source_id, proposal_id, invert, piece, rest, proposals, fragments, coverage, leakage), and counts of sources or pieces by reason.

    A source needs two proposals inside its block; of exactly two the smaller (then lower) stands for both. The
    piece is the smaller side; both sides need `least` voxels; of equal pieces (count and coordinate sums) the
    one with most voxels in the proposal, then the lowest id, stays.
    """
    v = grid.where("base > 0").withColumn("anatomy", anatomy_of(F.col("base")))
    inside = (F.col("proposal") > 0) & (anatomy_of(F.col("proposal")) == F.col("anatomy"))
    sums = [F.count(F.lit(1)).alias("n"), *[F.sum(a).alias(f"s{a}") for a in "zyx"]]
    per = v.where(inside).groupBy("vol", "anatomy", F.col("base").alias("source_id"), F.col("proposal").alias("proposal_id")).agg(*sums)
    whole = v.groupBy("vol", "anatomy", F.col("base").alias("source_id")).agg(*[c.alias(f"t_{k}") for c, k in zip((F.count(F.lit(1)), *[F.sum(a) for a in "zyx"]), ("n", "z", "y", "x"))])
    source = Window.partitionBy("vol", "source_id")
    totals = grid.where("proposal > 0").groupBy("vol", F.col("proposal").alias("proposal_id")).agg(F.count(F.lit(1)).alias("everywhere"))
    fragments = whole.groupBy("vol", "anatomy").agg(F.count(F.lit(1)).alias("fragments"))
    joined = whole.join(fragments.hint("merge"), ["vol", "anatomy"]).join(per.hint("merge"), ["vol", "anatomy", "source_id"], "left").join(totals.hint("merge"), ["vol", "proposal_id"], "left")
    ranked = joined.withColumn("k", F.count("proposal_id").over(source)).withColumn("covered", F.sum("n").over(source)).withColumn("nth", F.row_number().over(source.orderBy("n", "proposal_id")))
    few = ranked.where("k < 2").select("vol", "source_id").distinct().select(F.lit("fewer_than_two").alias("reason"))
    kept = ranked.where("k > 2 OR (k = 2 AND nth = 1)").withColumn("invert", F.col("n") > F.col("t_n") - F.col("n"))
    side = lambda part, all_: F.when(F.col("invert"), F.col(all_) - F.col(part)).otherwise(F.col(part))
    kept = kept.withColumns({"piece": side("n", "t_n"), "pz": side("sz", "t_z"), "py": side("sy", "t_y"), "px": side("sx", "t_x")}).withColumn("rest", F.col("t_n") - F.col("piece"))
    small = (F.col("piece") < least) | (F.col("rest") < least)
    same = Window.partitionBy("vol", "source_id", "piece", "pz", "py", "px").orderBy(F.desc("n"), "proposal_id")
    marked = kept.where(~small).withColumn("copy", F.row_number().over(same))
    rejected = few.unionAll(kept.where(small).select(F.lit("small_piece"))).unionAll(marked.where("copy > 1").select(F.lit("duplicate_piece"))).groupBy("reason").count()
    return marked.where("copy = 1").select("vol", "anatomy", "source_id", "proposal_id", "invert", "piece", "rest", F.col("k").alias("proposals"), "fragments", (F.col("covered") / F.col("t_n")).alias("coverage"), ((F.col("everywhere") - F.col("n")) / F.col("everywhere")).alias("leakage")), rejected


def decoder_context(reports: DataFrame) -> DataFrame:
    """(vol, anatomy, CONTEXT_FEATURES) of decoder reports, one row a volume and anatomy.

    reports: vol, anatomy, supervoxels, rag_edges, mid_covered, long_covered, vetoed, border, boundary, core,
    hard_total, and errors, the array of the accepted splits' relative errors.
    """
    edges, total = F.greatest(F.col("rag_edges"), F.lit(1)), F.greatest(F.col("hard_total"), F.lit(1))
    mean = F.aggregate("errors", F.lit(0.0), lambda acc, x: acc + x) / F.greatest(F.size("errors"), F.lit(1))
    values = (F.col("supervoxels"), F.col("rag_edges"), F.col("mid_covered") / edges, F.col("long_covered") / edges, F.col("vetoed") / edges, F.col("border") / total, F.col("boundary") / total, F.col("core") / total, F.size("errors"), F.coalesce(F.array_max("errors"), F.lit(0.0)), mean)
    return reports.select("vol", "anatomy", *[v.cast("double").alias(n) for n, v in zip(CONTEXT_FEATURES, values, strict=True)])


def with_features(grid: DataFrame, found: DataFrame, spacing=(1.0, 1.0, 1.0), context: DataFrame | None = None) -> DataFrame:
    """The candidates with their features in a map column: counts and shapes, all by relations.

    context: (vol, anatomy, CONTEXT_FEATURES); 0 for volumes and anatomies that it lacks.
    """
    shape = shape_features(grid, found, spacing)
    made = shape.select("vol", "source_id", "proposal_id", F.create_map(*[x for k in SHAPE_FEATURES for x in (F.lit(k), F.col(k))]).alias("features"))
    by_name = {n: i for n, i, _, _ in ANATOMIES}
    counted = {k: (F.col("anatomy") == by_name[n]) for k, n in (("is_sacrum", "Sacrum"), ("is_left_hip", "LeftHip"), ("is_right_hip", "RightHip"), ("is_femur", "Femur"))}
    counted |= {"anatomy_v35_fragment_count": F.col("fragments"), "isolated_is_complement": F.col("invert"), "proposal_ids_in_source": F.col("proposals"), "proposal_foreground_coverage": F.col("coverage"), "proposal_label_leakage_fraction": F.col("leakage")}
    joined = found.join(made.hint("merge"), ["vol", "source_id", "proposal_id"])
    if context is not None:
        joined = joined.join(context.select("vol", "anatomy", *CONTEXT_FEATURES).hint("merge"), ["vol", "anatomy"], "left")
    counted |= {n: F.coalesce(F.col(n), F.lit(0.0)) if context is not None else F.lit(0.0) for n in CONTEXT_FEATURES}
    more = F.create_map(*[x for k, v in counted.items() for x in (F.lit(k), v.cast("double"))])
    return joined.withColumn("features", F.map_concat("features", more)).drop(*CONTEXT_FEATURES)


def predict(rows: DataFrame, payload: dict) -> DataFrame:
    """Adds d_merge ... d_precision by the payload's regressors over the map column `features`; a missing feature fails by name."""
    check_payload(payload)
    names = list(payload["feature_names"])
    out = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.schema] + [f"d_{t} double" for t in TARGETS])

    def run(batches):
        for pdf in batches:
            if len(pdf):
                rows = [dict(f) for f in pdf["features"]]
                lost = [n for n in names if any(n not in f for f in rows)]
                if lost:
                    raise KeyError(f"missing features: {', '.join(lost)}")
                x = np.array([[f[n] for n in names] for f in rows], float)
                pdf = pdf.assign(**{f"d_{t}": np.asarray(payload["models"][f"delta_{t}"].predict(x), float) for t in TARGETS})
            else:
                pdf = pdf.assign(**{f"d_{t}": 0.0 for t in TARGETS})
            yield pdf

    return rows.mapInPandas(shipped(rows, run), out)


def select(rows: DataFrame, payload: dict) -> DataFrame:
    """(vol, anatomy, source_id, proposal_id, invert): the best eligible candidate of each source."""
    best = select_splits(rows, payload["policy"], payload["quality_guards"], ["vol", "anatomy", "source_id"])
    return rows.join(best.select("vol", "anatomy", "source_id", "proposal_id").hint("merge"), ["vol", "anatomy", "source_id", "proposal_id"], "left_semi").select("vol", "anatomy", "source_id", "proposal_id", "invert")


def apply(grid: DataFrame, selected: DataFrame) -> DataFrame:
    """grid with base updated: each selected piece gets the lowest free id of its block in its volume, sources ascending; those beyond get none. The foreground never changes."""
    spark = grid.sparkSession
    ids = spark.range(1, 201).select("id", (F.floor((F.col("id") - 1) / 50) + 1).alias("anatomy"))
    used = grid.where("base > 0").select("vol", F.col("base").alias("id")).distinct()
    volumes = selected.select("vol").distinct()
    free = volumes.join(F.broadcast(ids)).join(used.hint("merge"), ["vol", "id"], "left_anti").withColumn("k", F.row_number().over(Window.partitionBy("vol", "anatomy").orderBy("id")))  # 200 rows a volume
    want = selected.withColumn("k", F.row_number().over(Window.partitionBy("vol", "anatomy").orderBy("source_id"))).join(free.hint("merge"), ["vol", "anatomy", "k"]).select("vol", F.col("source_id").alias("base"), "proposal_id", "invert", F.col("id").alias("new_id"))
    hit = (F.col("proposal") == F.col("proposal_id")) != F.col("invert")
    return grid.join(want.hint("merge"), ["vol", "base"], "left").withColumn("base", F.when(F.col("new_id").isNotNull() & hit, F.col("new_id")).otherwise(F.col("base"))).drop("proposal_id", "invert", "new_id")


def run_gate(grid: DataFrame, payload: dict, least: int, spacing=(1.0, 1.0, 1.0), context: DataFrame | None = None) -> DataFrame:
    found, _ = candidates(grid, least)
    return apply(grid, select(predict(with_features(grid, found, spacing, context), payload), payload))


def predict_family(features: DataFrame, payload: dict) -> DataFrame:
    """Adds family and p_femur by an injected classifier with predict_proba over the payload's ordered features."""
    check_payload(payload, ("model", "feature_names", "labels"))
    names, labels = list(payload["feature_names"]), list(payload["labels"])
    lost = sorted(set(names) - set(features.columns))
    if lost:
        raise KeyError(f"missing features: {', '.join(lost)}")
    out = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in features.schema] + ["family string", "p_femur double"])

    def run(batches):
        for pdf in batches:
            p = np.asarray(payload["model"].predict_proba(pdf[names].to_numpy(float)), float).reshape(len(pdf), len(labels))
            yield pdf.assign(family=[labels[k] for k in p.argmax(1)] if len(pdf) else [], p_femur=p[:, labels.index("femur")])

    return features.mapInPandas(shipped(features, run), out)
