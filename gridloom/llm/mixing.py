"""Operator 3: mix sources to target weights on a low-discrepancy schedule. DataFrame functions only.

Every source is cut into near-equal blocks (sizes differ by a word at most) of words over its documents in hash order. Slot i of the
schedule is the golden-ratio point frac((i + 1/2) * phi), mapped through the cumulative slot shares to
a source; the k-th slot of a source takes its block k mod n_blocks. A document's taken words are its
overlap with taken blocks, repeats counted.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; an empty
table or one without words takes nothing; rows that repeat are separate documents; columns other
than the three used are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: No source is taken more often than this.
MOST_REPEATS = 3
#: Words of a block, at most, and blocks of a source, at least (or one a word).
BLOCK_WORDS = 256
LEAST_BLOCKS = 64
#: At this many slots or fewer, blocks shrink below BLOCK_WORDS to keep the schedule fine.
LEAST_SLOTS = 65_536
#: The fraction of the golden ratio as a 32-bit integer step: slot i is at (i * STEP) mod 2^32, exactly.
STEP, RING = 2_654_435_769, 1 << 32
#: Slots ranked together; ranks between chunks come from sums of their counts.
CHUNK = 4096
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: F.Column) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """One row a source (src, source_size) in; adds weight and target.

    Sharing by weight with caps is a water level: target = least(cap, level * weight). In the order of
    cap / weight the capped sources come first, so the level follows from running sums. The windows
    see one row a source, never documents.
    """
    order = Window.orderBy(F.col("src.missing"), F.col("src.name"))
    everything = Window.partitionBy()
    ranked = sizes.withColumn("nth", (F.row_number().over(order) - 1) % len(WEIGHTS)).withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("nth").cast("int") + 1).cast("double"))
    full = ranked.withColumn("cap", F.col("source_size") * float(MOST_REPEATS)).withColumn("filled_at", F.col("cap") / F.col("weight"))
    upto = Window.orderBy("filled_at", "src.missing", "src.name")
    run = full.withColumn("caps", F.sum("cap").over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("light", F.sum("weight").over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    whole = run.withColumn("total", F.sum("source_size").over(everything)).withColumn("heavy", F.sum("weight").over(everything))
    # after the first j sources are full, the others would stand at this level; it holds if none of them is full there
    level = whole.withColumn("level", (F.col("total") - F.col("caps") + F.col("cap")) / (F.col("heavy") - F.col("light") + F.col("weight")))
    water = level.withColumn("water", F.min(F.when(F.col("level") <= F.col("filled_at"), F.struct("filled_at", "src.missing", "src.name", "level"))).over(everything)["level"])
    return water.select("src", "source_size", "weight", "total", F.least("cap", F.coalesce(F.col("water"), F.lit(0.0)) * F.col("weight")).alias("target"))


def mix(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, source) to (doc_id, source, text_hash, size, source_size, target, taken)."""
    spark = docs.sparkSession
    sized = cut(docs.select("doc_id", "source", F.struct(F.col("source").isNull().alias("missing"), F.coalesce("source", F.lit("")).alias("name")).alias("src"), F.xxhash64("doc_id", "text").alias("text_hash"), word_count(F.col("text")).alias("size")))
    counted = sized.groupBy("src").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    targets = cut(source_targets(counted.select("src", "source_size")).join(counted.select(F.col("src").alias("s2"), "rows"), F.expr("src <=> s2")).drop("s2"))
    block = F.greatest(F.lit(1.0), F.least(F.lit(float(BLOCK_WORDS)), F.col("total") / LEAST_SLOTS))
    plan = targets.withColumn("n_blocks", F.least(F.col("source_size"), F.greatest(F.lit(LEAST_BLOCKS), F.ceil(F.col("source_size") / block))).cast("long"))
    plan = plan.withColumn("slots", F.when(F.col("n_blocks") > 0, F.col("target") * F.col("n_blocks") / F.nullif(F.col("source_size"), F.lit(0))).otherwise(0.0))
    spread = Window.orderBy("src.missing", "src.name")
    plan = plan.withColumn("upto", F.sum("slots").over(spread.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("all_slots", F.nullif(F.sum("slots").over(Window.partitionBy()), F.lit(0.0))).withColumn("lo", (F.col("upto") - F.col("slots")) / F.col("all_slots") * RING).withColumn("hi", F.when(F.row_number().over(Window.orderBy(F.col("upto").desc(), F.col("src.missing").desc(), F.col("src.name").desc())) == 1, F.lit(float(RING))).otherwise(F.col("upto") / F.col("all_slots") * RING))
    # rows of a hash bucket: enough that neither a bucket nor the list of a source's buckets gets long
    plan = plan.withColumn("buckets", F.ceil(F.col("rows") / F.greatest(F.lit(128.0), F.sqrt("rows") / 4)).cast("long"))
    plan = cut(plan.select("src", "source_size", "target", "n_blocks", "slots", "lo", "hi", "buckets"))
    n_slots = int(round(plan.agg(F.coalesce(F.sum("slots"), F.lit(0.0))).first()[0]))

    times = _times(spark, plan, n_slots)
    placed = _placed(sized, plan)
    hit = _block_range(placed)
    words = F.greatest(F.lit(0), F.least(F.col("stop"), F.col("block_stop")) - F.greatest(F.col("start"), F.col("block_start")))
    # in doubles, as block times size may leave 64 bits; the same function gives a block's stop and the next one's start
    start_of = lambda b: F.when(b >= F.col("n_blocks"), F.col("source_size")).otherwise(F.floor(b.cast("double") / F.col("n_blocks") * F.col("source_size")))
    spans = hit.withColumn("block", F.explode(F.sequence("first_block", "last_block"))).withColumn("block_start", start_of(F.col("block"))).withColumn("block_stop", start_of(F.col("block") + 1))
    taken = spans.join(times, ["src", "block"], "left").groupBy("src", "bucket", "nth").agg(F.sum(words * F.coalesce("times", F.lit(0))).alias("taken"))
    return placed.join(taken, ["src", "bucket", "nth"], "left").select("doc_id", "source", "text_hash", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _point(i: F.Column) -> F.Column:
    """(i * STEP + RING / 2) mod RING, in halves of 16 bits so that no product leaves 64 bits."""
    i = i % RING
    high, low = F.floor(i / 65536).cast("long"), i % 65536
    return (high * STEP % RING * 65536 + low * STEP + RING // 2) % RING


def _times(spark, plan: DataFrame, n_slots: int) -> DataFrame:
    """How often each block is taken: (src, block, times).

    The sources' intervals of the ring are cut at cells of 1/1024, so that a slot meets its interval by
    an equality on the cell and a check of the bounds, not by a nested loop.
    """
    cell = RING // 1024
    cells = plan.where("slots > 0").select("src", "n_blocks", "lo", "hi", F.explode(F.sequence((F.col("lo") / cell).cast("long"), F.least(F.lit(1023), (F.col("hi") / cell).cast("long")))).alias("cell"))
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), _point(F.col("id")).alias("point")).withColumn("cell", F.expr(f"point div {cell}"))
    at = slots.join(small(cells), "cell").where("point >= lo AND point < hi").select("slot", "src", "n_blocks", F.expr(f"slot div {CHUNK}").alias("chunk"))
    before = at.groupBy("src", "chunk").count().withColumn("before", F.sum("count").over(Window.partitionBy("src").orderBy("chunk")) - F.col("count")).drop("count")
    ranked = at.withColumn("nth", F.row_number().over(Window.partitionBy("src", "chunk").orderBy("slot")) - 1).join(before, ["src", "chunk"]).withColumn("rank", F.col("before") + F.col("nth"))
    return ranked.where(F.col("rank") < MOST_REPEATS * F.col("n_blocks")).groupBy("src", (F.col("rank") % F.col("n_blocks")).alias("block")).agg(F.count(F.lit(1)).alias("times"))


def _placed(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """Each document's words [start, stop) in its source, in the order of (bucket, hash, doc_id, size)."""
    keyed = sized.join(small(plan.drop("lo", "hi", "slots")), "src").withColumn("bucket", F.pmod(F.shiftright("text_hash", 8), F.col("buckets")))
    inside = Window.partitionBy("src", "bucket").orderBy("text_hash", F.col("doc_id").asc_nulls_first(), "size")
    here = keyed.withColumn("nth", F.row_number().over(inside)).withColumn("within", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    before = keyed.groupBy("src", "bucket").agg(F.sum("size").alias("sum")).withColumn("before", F.sum("sum").over(Window.partitionBy("src").orderBy("bucket")) - F.col("sum")).drop("sum")
    return here.join(before, ["src", "bucket"]).withColumn("stop", F.col("before") + F.col("within")).withColumn("start", F.col("stop") - F.col("size")).drop("within", "before", "buckets")


def _block_range(placed: DataFrame) -> DataFrame:
    """The blocks that may overlap [start, stop): those of its ends by proportion, and one more at either side for rounding."""
    block_of = lambda p: F.floor(p.cast("double") / F.col("source_size") * F.col("n_blocks"))
    ends = placed.where("size > 0").withColumn("first_block", F.greatest(F.lit(0), block_of(F.col("start")) - 1)).withColumn("last_block", F.least(F.col("n_blocks") - 1, block_of(F.col("stop")) + 1))
    return ends.select("src", "bucket", "nth", "start", "stop", "source_size", "n_blocks", "first_block", "last_block")


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: each row of docs appears round(taken / size) times (half up), with docs' own columns; a document
    without words stays once, as the mix says nothing about it."""
    share = cut(mix(docs).select("doc_id", "text_hash", "size", "taken"))
    # rows that repeat in every used column share their copies: their sum is spread over them by the average
    share = share.groupBy("doc_id", "text_hash", "size").agg(F.avg("taken").alias("taken")).withColumn("copies", F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int"))
    lookup = share.where("copies > 0").select(F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash"), "copies")
    # docs' columns by number, whatever their names
    own = docs.select(*[docs[c].alias(f"in_{i}") for i, c in enumerate(docs.columns)], docs["doc_id"].alias("r_id"), F.xxhash64("doc_id", "text").alias("r_hash"))
    out = own.join(lookup, F.expr("r_id <=> k_id AND r_hash = k_hash")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(docs.columns)])
