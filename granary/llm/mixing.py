"""Mixing sources to target weights (problem 8).

A mix is a schedule of slots. Golden-ratio points, mapped through the cumulative
weights, give each slot a source, so every stretch of the mix has the shares of
the whole. Each source's documents are shuffled and cut into blocks of equal
tokens, as often as it may repeat; the r-th slot of a source takes its r-th block.

Running sums and ranks are taken within bounded buckets whose offsets are summed
first, so no source is gathered, however large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.runtime import stored

BLOCK_TOKENS = 2048
#: Documents of a bucket on average; slots of a bucket.
BUCKET = 20_000
GOLDEN = 0.6180339887498949


def source_name(c: F.Column) -> F.Column:
    """Sources are compared trimmed and in lower case; empty is none."""
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def targets(mixes: DataFrame) -> DataFrame:
    return (
        mixes.select("mix_name", source_name(F.col("source_name")).alias("source"), F.col("source_name"), F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce(F.col("max_repeats").cast("int"), F.lit(1)), F.lit(0)).alias("max_repeats"))
        .where("mix_name is not null and source is not null")
        .dropDuplicates(["mix_name", "source"])
    )


def totals(documents: DataFrame, mixes: DataFrame, source: str, size: str) -> DataFrame:
    """mix_name, source, its share and repeats, its tokens, those of the mix, and the target in tokens. As few rows as the fixed table of mixes."""
    tokens = documents.groupBy(source_name(F.col(source)).alias("source")).agg(F.sum(F.greatest(F.col(size), F.lit(0)).cast("bigint")).alias("tokens"))
    rows = F.broadcast(targets(mixes)).join(tokens, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0).cast("bigint")))
    return rows.withColumn("mix_tokens", F.sum("tokens").over(Window.partitionBy("mix_name"))).withColumn("target_tokens", F.col("target_share") * F.col("mix_tokens"))


def blocks(documents: DataFrame, plan: DataFrame, source: str, size: str, key: str, buckets: int) -> DataFrame:
    """mix_name, source, block, doc_id, repeat_no, tokens: each source shuffled anew for each repeat and cut into blocks of equal tokens."""
    rows = documents.select(F.col(key).alias("doc_id"), source_name(F.col(source)).alias("source"), F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0).cast("bigint")), F.lit(0)).alias("n"))
    needed = F.least(F.col("max_repeats"), F.ceil(F.col("target_tokens") / F.col("tokens")).cast("int") + 1)
    repeats = plan.where("tokens > 0 and max_repeats > 0 and target_share > 0").select("mix_name", "source", F.explode(F.sequence(F.lit(0), needed - 1)).alias("repeat_no"))
    rows = rows.join(F.broadcast(repeats), "source")
    shuffled = F.xxhash64("doc_id", "mix_name", "repeat_no")
    rows = rows.withColumn("place", shuffled).withColumn("bucket", F.pmod(F.col("place"), F.lit(buckets)).cast("int"))
    order = ["mix_name", "source"]
    sums = rows.groupBy(*order, "repeat_no", "bucket").agg(F.sum("n").alias("s"))
    before = Window.partitionBy(*order).orderBy("repeat_no", "bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    offsets = sums.withColumn("offset", F.coalesce(F.sum("s").over(before), F.lit(0).cast("bigint"))).drop("s")
    inside = Window.partitionBy(*order, "repeat_no", "bucket").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n").over(inside), F.lit(0).cast("bigint"))
    rows = rows.withColumn("start", start).join(offsets, [*order, "repeat_no", "bucket"])
    return rows.select(*order, F.floor((F.col("start") + F.col("offset")) / BLOCK_TOKENS).cast("bigint").alias("block"), "doc_id", "repeat_no", F.col("n").alias("tokens"))


def slots(plan: DataFrame) -> DataFrame:
    """mix_name, source, rank, slot: the schedule. Slots are made and ranked in bounded buckets."""
    edges = Window.partitionBy("mix_name").orderBy("source")
    weights = plan.where("target_share > 0 and mix_tokens > 0")
    weights = weights.withColumn("top", F.sum("target_share").over(edges)).withColumn("whole", F.sum("target_share").over(Window.partitionBy("mix_name")))
    intervals = weights.select("mix_name", "source", ((F.col("top") - F.col("target_share")) / F.col("whole")).alias("low"), (F.col("top") / F.col("whole")).alias("high"), (F.row_number().over(edges.rowsBetween(Window.unboundedPreceding, 0)) == F.count(F.lit(1)).over(Window.partitionBy("mix_name"))).alias("final"))
    sizes = weights.groupBy("mix_name").agg(F.ceil(F.max(F.col("mix_tokens") * F.col("whole")) / BLOCK_TOKENS).cast("bigint").alias("slots"))
    buckets = sizes.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("slots") - 1) / BUCKET))))
    buckets = buckets.repartition("mix_name", "bucket")
    made = buckets.withColumn("slot", F.explode(F.sequence(F.col("bucket") * BUCKET, F.least(F.col("slots"), (F.col("bucket") + 1) * BUCKET) - 1)))
    point = F.col("slot") * F.lit(GOLDEN) % 1.0
    made = made.withColumn("point", point).join(F.broadcast(intervals), "mix_name").where("point >= low and (point < high or final)")
    counts = made.groupBy("mix_name", "source", "bucket").agg(F.count(F.lit(1)).alias("s"))
    before = Window.partitionBy("mix_name", "source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("s").over(before), F.lit(0).cast("bigint"))).drop("s")
    inside = Window.partitionBy("mix_name", "source", "bucket").orderBy("slot")
    return made.withColumn("at", F.row_number().over(inside) - 1).join(offsets, ["mix_name", "source", "bucket"]).select("mix_name", "source", (F.col("at") + F.col("offset")).alias("rank"), "slot")


def mixed(documents: DataFrame, mixes: DataFrame, source: str = "source", size: str = "n_tokens", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(chosen, report) of every mix.

    chosen: mix_name, slot, source, doc_id, repeat_no (from 0) and tokens, one row
    for each use of a document. report: for each source of a mix its target and
    actual share, and whether it can reach the target: its tokens times max_repeats
    against target_share times the tokens of all sources of the mix.

    Null, empty and unknown sources are in no mix. Null and negative sizes count as
    0. A source without documents, or of no repeats, has no rows and a share of 0.
    Null shares count as 0, null repeats as 1. mixes is fixed and small.
    """
    plan = stored(totals(documents, mixes, source, size), "plan")
    buckets = max(1, -(-documents.count() // BUCKET))
    cut = blocks(documents, plan, source, size, key, buckets)
    chosen = stored(slots(plan).withColumnRenamed("rank", "block").join(cut, ["mix_name", "source", "block"]).select("mix_name", "slot", "source", "doc_id", "repeat_no", "tokens"), "chosen")
    used = chosen.groupBy("mix_name", "source").agg(F.sum("tokens").alias("chosen_tokens"), F.count_distinct("doc_id").alias("documents"), F.max("repeat_no").alias("repeats"))
    report = plan.join(used, ["mix_name", "source"], "left").withColumn("chosen_tokens", F.coalesce("chosen_tokens", F.lit(0).cast("bigint")))
    share = F.col("chosen_tokens") / F.nullif(F.sum("chosen_tokens").over(Window.partitionBy("mix_name")), F.lit(0).cast("bigint"))
    return chosen, report.select(
        "mix_name", "source_name", "target_share", "max_repeats", "tokens", "mix_tokens", "target_tokens", "chosen_tokens", F.coalesce("documents", F.lit(0).cast("bigint")).alias("documents"), F.coalesce(share, F.lit(0.0)).alias("actual_share"),
        (F.col("tokens") * F.col("max_repeats") >= F.col("target_tokens")).alias("reachable"),
    )
