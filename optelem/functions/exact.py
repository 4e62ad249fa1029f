"""Order-independent arithmetic: sums run over whole microseconds, so a retried task cannot change a result."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_micros(ms: Column | str) -> Column:
    """Whole microseconds; NaN, infinities and what a long cannot hold are NULL."""
    ms = F.col(ms) if isinstance(ms, str) else ms
    return F.round(ms * 1000).try_cast("long")


def mean_ms(ms: str) -> Column:
    """Mean of the values that are numbers, NULL without one."""
    micros = as_micros(ms)
    return F.try_divide(F.sum(micros).cast("double"), F.lit(1e3) * F.count(micros))
