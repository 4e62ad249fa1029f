"""Time helpers that stay in timestamp_ntz, so no session zone is involved."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def trunc(unit: str, column: str | Column) -> Column:
    return F.date_trunc(unit, column).cast("timestamp_ntz")


def epoch_us(column: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, {column})")


def bucket(column: str, seconds: float) -> Column:
    """Number of the fixed-width time bucket a timestamp falls into."""
    return F.floor(epoch_us(column) / F.lit(int(seconds * 1_000_000))).cast("long")


def bucket_start(number: Column, seconds: int) -> Column:
    return F.timestamp_seconds(number * seconds).cast("timestamp_ntz")


def ts(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def plus_seconds(column: str, seconds: float) -> Column:
    return F.col(column) + F.expr(f"INTERVAL '{seconds}' SECOND")
