"""Mixing sources to target weights by hash thresholds.

Every row gets a 60-bit hash of its id. Per source, the wanted words are a whole number of copies of everything
plus a remainder below one copy. The remainder is all rows below a hash threshold, which nested histograms find:
words are summed by source and the top 12 hash bits, the bucket in which the running sum passes the budget is the
boundary, and only that bucket is divided by the next 12 bits, five times, down to a single hash value. Rows are
then filtered by comparison; no row is ever sorted, and a source with a third of all rows costs no task more than
its share, because histograms are combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from optelem.llm.texts import add_columns, word_count
from optelem.plans.lookups import lookup_side, settle

BITS, LEVELS = 12, 5
HASH_BITS = BITS * LEVELS
MAX_SOURCES_BROADCAST = 200_000  # rows of three numbers and a key, tens of MB at most


def row_hash(row_id: Column) -> Column:
    """60 bits of the MD5 of the id's text; NULL hashes like the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(row_id.cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """_key, source_size, target of `sizes` (_key, _source, _size).

    Sources in code point order, NULL last, take the weights in turn and share the sum of all sizes; no target
    passes `cap` times its source's size, and what is above is shared again by weight. Ordered by cap per weight,
    a source is capped exactly if the level that the rest would reach is above its cap, so one running sum over
    one row per source settles all rounds of sharing.
    """
    big = "decimal(38,0)"
    per = sizes.groupBy("_key").agg(F.first("_source").alias("_source"), F.sum("_size").cast("long").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1
    per = per.withColumn("_w", F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int")).cast("long"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_level = Window.orderBy((F.col("_cap").cast("double") / F.col("_w")), "_key")
    per = per.withColumn("_cap", (F.col("source_size") * cap).cast("long"))
    per = (per.withColumn("_all", F.sum("source_size").over(everything))
           .withColumn("_caps", F.coalesce(F.sum("_cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
           .withColumn("_ws", F.sum("_w").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing))))
    capped = (F.col("_all") - F.col("_caps")).cast(big) * F.col("_w").cast("decimal(10,0)") > F.col("_cap").cast("decimal(28,0)") * F.col("_ws").cast("decimal(10,0)")
    per = per.withColumn("_capped", capped)
    per = (per.withColumn("_rest", F.col("_all") - F.coalesce(F.sum(F.when(F.col("_capped"), F.col("_cap"))).over(everything), F.lit(0)))
           .withColumn("_open", F.sum(F.when(~F.col("_capped"), F.col("_w"))).over(everything)))
    target = F.when(F.col("_capped"), F.col("_cap").cast("double")).otherwise((F.col("_w") * F.col("_rest")).cast("double") / F.col("_open").cast("double"))
    return per.select("_key", "source_size", target.alias("target"))


def thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """_key, source_size, target, _copies, _below: a row is taken `_copies` times, once more if its hash is below `_below`."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = settle(targets.withColumn("_copies", whole).withColumn("_budget", F.col("target") - F.col("_copies") * F.col("source_size"))
                   .withColumn("_prefix", F.lit(0).cast("long")).withColumn("_before", F.lit(0).cast("long")))
    near = rows.select("_key", "_hash", "_size").where("_size > 0")
    for level in range(LEVELS):
        shift = HASH_BITS - BITS * (level + 1)
        sums = near.groupBy("_key", F.shiftright("_hash", shift).alias("_bucket")).agg(F.sum("_size").alias("_here"))
        running = F.sum("_here").over(Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
        placed = sums.withColumn("_running", F.coalesce(running, F.lit(0))).join(lookup_side(state, MAX_SOURCES_BROADCAST), "_key")
        passes = F.col("_before") + F.col("_running") + F.col("_here") > F.col("_budget")
        first = placed.where(passes).groupBy("_key").agg(F.min(F.struct("_bucket", "_running", "_here")).alias("_first"))
        state = settle(state.join(first, "_key", "left").withColumn("_before", F.col("_before") + F.coalesce("_first._running", F.lit(0)))
                       .withColumn("_prefix", F.coalesce("_first._bucket", F.lit(0))).withColumn("_last", F.col("_first._here")).drop("_first"))
        if level < LEVELS - 1:
            bounds = lookup_side(state.where("_last IS NOT NULL").select("_key", "_prefix"), MAX_SOURCES_BROADCAST)
            near = settle(near.join(bounds, "_key").where(F.shiftright("_hash", shift) == F.col("_prefix")).drop("_prefix"))
    nearer = F.col("_before") + F.col("_last") - F.col("_budget") < F.col("_budget") - F.col("_before")
    below = F.when(F.col("_last").isNotNull(), F.col("_prefix") + F.when(nearer, 1).otherwise(0)).otherwise(F.lit(0)).cast("long")
    return state.select("_key", "source_size", "target", "_copies", below.alias("_below"))


def mix(df: DataFrame, row_id: str = "doc_id", source: str = "source", text: str = "text",
        weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """`df` with size, source_size, target, copies and taken = copies * size.

    The copies of a source come within half of its boundary row of the target. Equal ids share a hash, so repeated
    rows are taken alike and reruns agree. A NULL text has size 0 and so do texts without words; they get copies by
    their hash and take nothing. NULL is a source of its own, the last one. An empty table stays empty. Columns of
    `df` with the names of the results are replaced.
    """
    rows = settle(df.select(source_key(F.col(source)).alias("_key"), F.col(source).alias("_source"),
                            row_hash(F.col(row_id)).alias("_hash"), word_count(text).alias("_size")))
    bounds = lookup_side(settle(thresholds(rows, source_targets(rows, weights, cap))), MAX_SOURCES_BROADCAST)
    keyed = add_columns(df, {"size": word_count(text), "_key": source_key(F.col(source)), "_hash": row_hash(F.col(row_id))})
    joined = keyed.drop("source_size", "target").join(bounds, "_key")
    copies = (F.col("_copies") + F.when(F.col("_hash") < F.col("_below"), 1).otherwise(0)).cast("long")
    mixed = add_columns(joined, {"copies": copies, "taken": copies * F.col("size")})
    return mixed.drop("_key", "_hash", "_copies", "_below")


def repeat_rows(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Every row as often as its `copies` say, with the given columns."""
    return mixed.where("copies > 0").select(*columns, F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).drop("_copy")
