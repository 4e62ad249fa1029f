"""Exact interpolated percentiles without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from optelem.plans.keys import join_on
from optelem.plans.lookups import lookup_side, settle

STEPS_PER_OCTAVE = 64
PARTS = 4096  # of a value bucket, evenly between its smallest and its largest value


def _value_bucket(v: Column) -> Column:
    """Monotone bucket number; each bucket spans about one percent of relative width."""
    size = F.floor(F.least(F.log2(F.abs(v)) * STEPS_PER_OCTAVE, F.lit(90_000e0))).cast("long") + F.lit(100_000)
    return F.when(v == 0, F.lit(0).cast("long")).when(v > 0, size).otherwise(-size)


def _regrouped(df: DataFrame, keys: Sequence[str], groupings: Sequence[Sequence[str]] | None) -> DataFrame:
    """Each row once per grouping: keys that it rolls up are NULL, and bit i of `level`, from the last key on, says which."""
    if groupings is None:
        return df
    kinds = dict(df.dtypes)

    def grouping(kept: Sequence[str]) -> Column:
        level = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in kept)
        return F.struct(*[(F.col(k) if k in kept else F.lit(None).cast(kinds[k])).alias(k) for k in keys], F.lit(level).alias("level"))

    rest = [c for c in df.columns if c not in keys]
    return df.select(*rest, F.explode(F.array(*[grouping(g) for g in groupings])).alias("_g")).select("_g.*", *rest)


def _holding(sums: DataFrame, keys: Sequence[str], order: str, probs: dict[str, float]) -> DataFrame:
    """The rows of `sums` (keys, order, _c, _start) in which a wanted rank lies, with `_at`, the rows before them."""
    earlier = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.withColumn("_at", F.col("_start") + F.coalesce(F.sum("_c").over(earlier), F.lit(0)))
    wanted = [f(_rank(p)) for p in probs.values() for f in (F.floor, F.ceil)]
    return placed.where(reduce(lambda a, b: a | b, [_holds(r) for r in wanted]))


def _rank(p: float) -> Column:
    return F.lit(p) * (F.col("_n") - 1)


def _holds(rank: Column) -> Column:
    return (rank >= F.col("_at")) & (rank < F.col("_at") + F.col("_c"))


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], weight: str | None = None,
                      totals: dict[str, Column] | None = None, groupings: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """keys + one column per entry of `probs` + `n`, equal to continuous percentiles; NULL and NaN values do not count.

    First pass: a histogram of value buckets per key, a few hundred counts each, tells which bucket holds each wanted
    rank. Second pass: only rows of those buckets, about one in a hundred, are counted by value; a second histogram
    cuts each bucket into thousands of parts, and only the values of the parts that hold a wanted rank are ordered.
    Neither pass shuffles raw rows, and no task orders more than a sliver of a key, so a hot key costs no task more
    than its share of the scan. `weight` names a count column of pre-aggregated rows. `totals` are further sums or
    counts over all rows of a key, taken along in the first pass. With `groupings` (lists of keys) the result has a
    `level` and a row per group of each; groups are made from counts, never from raw rows.
    """
    keys, totals = list(keys), totals or {}
    v = F.col(value).cast("double")
    rows = df.withColumn("_v", F.when(~F.isnan(v), v)).withColumn("_b", _value_bucket(F.col("_v")))
    count = F.sum(F.when(F.col("_v").isNotNull(), F.col(weight))) if weight else F.count("_v")
    fine = settle(rows.groupBy(*keys, "_b").agg(F.coalesce(count, F.lit(0)).cast("long").alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high"),
                                                *[c.alias(f"_t_{name}") for name, c in totals.items()]))
    by = keys if groupings is None else [*keys, "level"]
    hist = _regrouped(fine, keys, groupings)
    if groupings is not None:
        hist = hist.groupBy(*by, "_b").agg(F.sum("_c").alias("_c"), F.min("_low").alias("_low"), F.max("_high").alias("_high"), *[F.sum(f"_t_{n}").alias(f"_t_{n}") for n in totals])
    whole = hist.withColumn("_n", F.sum("_c").over(Window.partitionBy(*by))).withColumn("_start", F.lit(0).cast("long"))
    hits = settle(_holding(whole.where("_b IS NOT NULL"), by, "_b", probs).select(*by, "_b", "_at", "_n", "_low", "_high"))
    wanted = fine.where("_b IS NOT NULL").select(*keys, "_b")
    if groupings is not None:  # the buckets of the finest groups that some grouping needs
        wanted = join_on(_regrouped(wanted.withColumns({f"_f_{k}": F.col(k) for k in keys}), keys, groupings), hits.select(*by, "_b"), [*by, "_b"], "left_semi")
        wanted = wanted.select(*[F.col(f"_f_{k}").alias(k) for k in keys], "_b").distinct()
    else:
        wanted = hits.select(*keys, "_b")
    near = join_on(rows.where("_v IS NOT NULL"), lookup_side(wanted), [*keys, "_b"], "left_semi")
    values = near.groupBy(*keys, "_b", "_v").agg((F.sum(weight) if weight else F.count(F.lit(1))).cast("long").alias("_c"))
    values = join_on(_regrouped(values, keys, groupings), lookup_side(hits.withColumnRenamed("_at", "_start")), [*by, "_b"])
    share = F.try_divide(F.col("_v") - F.col("_low"), F.col("_high") - F.col("_low"))
    part = F.coalesce(F.least(F.floor(share * PARTS), F.lit(PARTS - 1)).try_cast("int"), F.lit(0))
    values = settle(values.groupBy(*by, "_b", "_v", "_start", "_n", part.alias("_part")).agg(F.sum("_c").alias("_c")))
    parts = values.groupBy(*by, "_b", "_part", "_start", "_n").agg(F.sum("_c").alias("_c"))
    slivers = _holding(parts, [*by, "_b"], "_part", probs).select(*by, "_b", "_part", F.col("_at").alias("_before"))
    last = join_on(values, lookup_side(slivers), [*by, "_b", "_part"]).withColumn("_start", F.col("_before"))
    placed = _holding(last, [*by, "_b", "_part"], "_v", probs)
    picks = []
    for i, p in enumerate(probs.values()):
        for tag, f in (("lo", F.floor), ("hi", F.ceil)):
            picks.append(F.max(F.when(_holds(f(_rank(p))), F.col("_v"))).alias(f"_{tag}{i}"))
    picked = placed.groupBy(*by).agg(F.max("_n").alias("_n"), *picks)
    results = [(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (_rank(p) - F.floor(_rank(p)))).alias(name) for i, (name, p) in enumerate(probs.items())]
    out = picked.select(*by, *results, F.col("_n").cast("long").alias("n"))
    if not totals:
        return out
    sums = hist.groupBy(*by).agg(*[F.sum(f"_t_{name}").alias(name) for name in totals])
    return join_on(sums, out, by, "left").select(*by, *probs, "n", *totals)
