"""Ordered per-key computations that survive hot keys.

A plain window over a key sorts all rows of that key in one task. Here each key is cut into
time chunks; rows are processed per (key, chunk), a one-row summary per chunk carries the state
of earlier chunks forward, and the two are joined. The only per-key pass runs over chunk
summaries, whose number is bounded by the covered time span.

The first ordering column must be the time column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from optelem.functions.times import bucket
from optelem.plans.keys import join_on

CHUNK_SECONDS = 300  # a key with a third of 100 TB over a month then puts a few GB into a chunk


def _with_carry(df: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    return join_on(df, carry, [*keys, "_chunk"], "left")


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str,
                chunk_seconds: float = CHUNK_SECONDS) -> DataFrame:
    """Add `out`: sum of `value` over all earlier rows of the key (the current row excluded)."""
    rows = df.withColumn("_chunk", bucket(order[0], chunk_seconds)).withColumn("_value", value)
    totals = rows.groupBy(*keys, "_chunk").agg(F.sum("_value").alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, "_chunk", F.sum("_total").over(earlier).alias("_carry"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    return (_with_carry(rows, carry, keys)
            .withColumn(out, F.coalesce(F.sum("_value").over(inside), zero) + F.coalesce("_carry", zero))
            .drop("_chunk", "_value", "_carry"))


def previous_row(df: DataFrame, keys: list[str], order: list[str], columns: dict[str, str],
                 chunk_seconds: float = CHUNK_SECONDS) -> DataFrame:
    """Add, for each `new: old` pair, the value of `old` in the preceding row of the key."""
    rows = (df.withColumn("_chunk", bucket(order[0], chunk_seconds))
            .withColumn("_here", F.struct(*[F.col(old).alias(new) for new, old in columns.items()])))
    last = rows.groupBy(*keys, "_chunk").agg(F.max_by("_here", F.struct(*order)).alias("_last"))
    carry = last.select(*keys, "_chunk", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_chunk")).alias("_carry"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    joined = _with_carry(rows, carry, keys).withColumn("_prev", F.coalesce(F.lag("_here").over(inside), "_carry"))
    return joined.select(*df.columns, *[F.col(f"_prev.{new}").alias(new) for new in columns])


def last_known(df: DataFrame, keys: list[str], order: list[str], value: str, out: str,
               chunk_seconds: float = CHUNK_SECONDS) -> DataFrame:
    """Add `out`: newest non-null `value` of the key at or before the row (an as-of fill)."""
    rows = df.withColumn("_chunk", bucket(order[0], chunk_seconds))
    newest = (rows.groupBy(*keys, "_chunk")
              .agg(F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_newest")))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = newest.select(*keys, "_chunk", F.last("_newest", ignorenulls=True).over(earlier).alias("_carry"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (_with_carry(rows, carry, keys)
            .withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(inside), "_carry"))
            .drop("_chunk", "_carry"))
