"""Digest trees: sums of row digests per range of key hashes, so that two tables are compared without their rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from optelem.plans.lookups import settle

LEVELS = (6, 12, 18)  # bits of the hash at each level; the last ones are the leaves


def framed(*fields: str | Column) -> Column:
    """The fields in one text, each behind its length, so that no two different rows give the same text; NULL is marked apart from empty."""
    texts = [(F.col(f) if isinstance(f, str) else f).cast("string") for f in fields]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("~")) for t in texts])


def leaf_of(key: str) -> Column:
    """The leaf of a key: the first bits of its hash. Keys that read alike have one leaf whatever their type."""
    return F.shiftrightunsigned(F.xxhash64(F.col(key).cast("string")), 64 - LEVELS[-1])


def digest_tree(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """level, node, n, low, high: rows and digest sums of every range of `df`; at most 2 ** 18 leaves, whatever its size.

    It can be written beside a table and compared later. The rows are summed once, upper levels are sums of leaves.
    """
    digest = F.sha2(framed(key, *columns), 256)
    halves = [F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(20,0)").alias(name) for at, name in ((1, "low"), (16, "high"))]
    leaves = df.select(leaf_of(key).alias("node"), *halves).groupBy("node").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).cast("decimal(38,0)").alias(c) for c in ("low", "high")])
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.lit(LEVELS[-1] - bits).alias("up")) for i, bits in enumerate(LEVELS)]))
    every = settle(leaves).withColumn("_at", at).select(F.col("_at.level").alias("level"), F.expr("shiftright(node, _at.up)").alias("node"), "n", "low", "high")
    return every.groupBy("level", "node").agg(F.sum("n").alias("n"), *[F.sum(c).cast("decimal(38,0)").alias(c) for c in ("low", "high")])


def differing_leaves(one: DataFrame, other: DataFrame) -> DataFrame:
    """leaf: those in which two trees differ. Each level compares only the children of ranges that differed above."""
    one, other = settle(one), settle(other)
    differing = None
    for level, bits in enumerate(LEVELS):
        sides = [tree.where(F.col("level") == level).drop("level") for tree in (one, other)]
        if differing is not None:
            step = bits - LEVELS[level - 1]
            sides = [s.withColumn("_above", F.shiftright("node", step)).join(differing, "_above", "left_semi").drop("_above") for s in sides]
        both = sides[0].join(sides[1].select(F.col("node"), *[F.col(c).alias(f"_{c}") for c in ("n", "low", "high")]), "node", "full")
        same = F.col("n").eqNullSafe(F.col("_n")) & F.col("low").eqNullSafe(F.col("_low")) & F.col("high").eqNullSafe(F.col("_high"))
        differing = both.where(~same).select(F.col("node").alias("_above"))
    return settle(differing.withColumnRenamed("_above", "leaf"))


def rows_in(df: DataFrame, key: str, leaves: DataFrame, inside: bool = True) -> DataFrame:
    """The rows of `df` whose key is in one of `leaves`, or in none; there are at most 2 ** 18 of them."""
    keyed = df.withColumn("_leaf", leaf_of(key))
    return keyed.join(F.broadcast(leaves.withColumnRenamed("leaf", "_leaf")), "_leaf", "left_semi" if inside else "left_anti").drop("_leaf")
