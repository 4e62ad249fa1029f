"""Lookup sides: broadcast only after a bounded count and their column widths prove them small, otherwise a shuffled join under AQE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from optelem.session import ensure_checkpoint_dir

MAX_BROADCAST_ROWS = 500_000
MAX_BROADCAST_BYTES = 256 * 1024 * 1024


def lookup_side(side: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Mark `side` for broadcast when it holds at most `max_rows` rows and MAX_BROADCAST_BYTES of values.

    Counting stops at max_rows + 1. A larger side is returned without a hint: Spark then sort-merges, and AQE splits
    the partitions of a hot key.
    """
    found = side.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(_width(side)).alias("bytes")).first()
    return F.broadcast(side) if found["n"] <= max_rows and (found["bytes"] or 0) <= MAX_BROADCAST_BYTES else side


def _width(side: DataFrame) -> Column:
    """Bytes of a row: the length of its strings and binaries, of nested values as JSON, and 8 for any other value."""
    total = F.lit(8 * len(side.columns)).cast("long")
    for field in side.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(column), F.lit(0))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0))
    return total


def settle(df: DataFrame) -> DataFrame:
    """Cut lineage of an expensive, small intermediate by a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settled_lookup(side: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """`lookup_side` for a side that is itself the result of an aggregation: computed once, then counted."""
    return lookup_side(settle(side), max_rows)
