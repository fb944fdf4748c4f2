"""Operator 10: judge urls by rules, and by boosted trees on lexical features where no rule fits. DataFrame functions only.

The labelled urls are those that a rule decides. The trees (Spark ML, in the JVM) are fitted on a bounded
sample of the distinct ones, each weighing as often as it stands, and judge the urls that no rule fits.
Their features are lengths, depth, shares of digits, entropies, counts of parameters, and how often urls of the same
host suffix or first path segment are blocked. These shares are counted over all labelled rows; a training url
sees them without its own fold, so that no label stands among its own features.

Defined cases: a null url, or one without `://`, has empty host and path; an empty table gives no rows;
if no url of the table is labelled, the score is 0.5 and the verdict allow; of rules that fit and are equally long the
first by code points wins; repeated rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Labelled urls that the trees are fitted on, at most: the first in hash order.
TRAIN_ROWS = 20_000
#: Parts of the labelled urls for the shares, and the weight (in urls) of the overall share in each.
FOLDS, SMOOTH = 5, 20
FEATURES = ("url_len", "host_len", "path_len", "depth", "dots", "digit_ratio", "hyphens", "params", "has_query", "has_fragment", "is_https", "host_entropy", "path_entropy", "longest_digits", "suffix_rate", "segment_rate")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_column(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule whose host is the url's or a parent of it and whose path begins the url's; a struct (rule, verdict) or null."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits; 0 for the empty text."""
    chars = F.split(text, "")
    n = F.length(text).cast("double")
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n
    return F.when(n > 0, F.aggregate(F.array_distinct(F.filter(chars, lambda c: c != "")), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))).otherwise(0.0)


def features(urls: DataFrame) -> DataFrame:
    u, host, path = F.coalesce(F.col("url"), F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    return urls.withColumns({
        "url_len": F.length(u).cast("double"), "host_len": F.length(host).cast("double"), "path_len": F.length(path).cast("double"),
        "depth": F.size(F.filter(F.split(path, "/"), lambda s: s != "")).cast("double"), "dots": (F.length(host) - F.length(F.replace(host, F.lit("."), F.lit("")))).cast("double"),
        "digit_ratio": F.length(F.regexp_replace(u, "[^0-9]", "")) / F.greatest(F.length(u), F.lit(1)), "hyphens": (F.length(u) - F.length(F.replace(u, F.lit("-"), F.lit("")))).cast("double"),
        "params": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))).cast("double"), "has_query": F.instr(u, "?").cast("boolean").cast("double"), "has_fragment": F.instr(u, "#").cast("boolean").cast("double"),
        "is_https": u.startswith("https://").cast("double"), "host_entropy": entropy(host), "path_entropy": entropy(path),
        "longest_digits": F.coalesce(F.array_max(F.transform(F.split(path, "[^0-9]+"), lambda s: F.length(s))), F.lit(0)).cast("double"),
        "suffix": F.substring_index(host, ".", -1), "segment": F.substring_index(F.substring_index(path, "/", 2), "/", -1),
    })


class Model(NamedTuple):
    """The trees (None without labelled urls), the shares by suffix and by segment, and the overall share of block."""

    trees: GBTClassificationModel | None
    by_suffix: DataFrame
    by_segment: DataFrame
    prior: float


def _placed(pages: DataFrame, rules) -> DataFrame:
    parts = pages.select("page_id", "url").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    return parts.withColumn("hit", rule_column(F.col("host"), F.col("path"), rules))


def _shares(labelled: DataFrame, key: str, prior: float) -> DataFrame:
    """(key, whole, without): the smoothed share of block by key, and the same without each fold."""
    by_fold = labelled.groupBy(key, "fold").agg(F.sum("label").alias("b"), F.count(F.lit(1)).alias("n"))
    at = lambda c, k: F.sum(F.when(F.col("fold") == k, F.col(c)).otherwise(0))
    share = lambda b, n: (b + SMOOTH * prior) / (n + SMOOTH)
    out = by_fold.groupBy(key).agg(share(F.sum("b"), F.sum("n")).alias("whole"), F.array(*[share(F.sum("b") - at("b", k), F.sum("n") - at("n", k)) for k in range(FOLDS)]).alias("without"))
    return small(cut(out))


def _vectors(df: DataFrame, by_suffix: DataFrame, by_segment: DataFrame, prior: float, own_fold: bool) -> DataFrame:
    for key, shares in (("suffix", by_suffix), ("segment", by_segment)):
        rate = F.element_at("without", F.col("fold") + 1) if own_fold else F.col("whole")
        df = df.join(shares, key, "left").withColumn(f"{key}_rate", F.coalesce(rate, F.lit(prior))).drop("whole", "without")
    return VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(df)


def train(pages: DataFrame, rules=RULES, train_rows: int = TRAIN_ROWS) -> Model:
    """The model of the urls of pages that a rule decides."""
    fold = F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int")
    told = features(_placed(pages, rules).where("hit IS NOT NULL").withColumns({"label": (F.col("hit.verdict") == "block").cast("double"), "fold": fold}))
    whole = told.agg(F.coalesce(F.sum("label"), F.lit(0.0)).alias("b"), F.count(F.lit(1)).alias("n"), F.approx_count_distinct("url").alias("urls")).first()
    prior = (whole["b"] + 1) / (whole["n"] + 2)
    by_suffix, by_segment = _shares(told, "suffix", prior), _shares(told, "segment", prior)
    if not whole["n"]:
        return Model(None, by_suffix, by_segment, prior)
    # distinct urls by hash: a bound for twice as many goes before the shuffle, so a url that fills a third of the rows is one of them
    h = F.xxhash64("url", F.lit("sample"))
    if whole["urls"] > 4 * train_rows:
        told = told.where(h <= -(1 << 63) + int((1 << 64) * 2 * train_rows / whole["urls"]))
    names = [c for c in told.columns if c not in ("page_id", "hit")]
    sample = told.groupBy(*names).agg(F.count(F.lit(1)).cast("double").alias("w")).orderBy(h, "url").limit(train_rows)
    # one partition, so that sums come in one order and reruns agree; the sample is bounded
    ready = _vectors(cut(sample), by_suffix, by_segment, prior, True).select("x", "label", "w").coalesce(1).cache()
    try:
        trees = GBTClassifier(featuresCol="x", labelCol="label", weightCol="w", maxIter=10, maxDepth=4, seed=7).fit(ready)
    finally:
        ready.unpersist()
    return Model(trees, by_suffix, by_segment, prior)


def judge(pages: DataFrame, rules=RULES, train_rows: int = TRAIN_ROWS, model: Model | None = None) -> DataFrame:
    """pages (page_id, url) to (page_id, host, path, rule, verdict, block_score); the model is learned from pages if none is given."""
    model = model or train(pages, rules, train_rows)
    base = _placed(pages, rules)
    if model.trees is None:
        scored = base.withColumn("block_score", F.lit(0.5))
        by_trees = F.lit("allow")
    else:
        scored = model.trees.transform(_vectors(features(base), model.by_suffix, model.by_segment, model.prior, False)).withColumn("block_score", vector_to_array("probability")[1])
        by_trees = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce(F.col("hit.verdict"), by_trees).alias("verdict"), "block_score")
