"""Parallelism for row-wise work that is heavy per row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread(df: DataFrame, key: str) -> DataFrame:
    """Shuffle rows by `key` when the input is too small to be split for every core; a well-split input stays as it is.

    The size is the optimizer's estimate and the number of files, neither of which starts a job.
    """
    if df.isStreaming:
        return df
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return df.repartition(cores, F.xxhash64(key)) if max(size // split, len(df.inputFiles())) < cores else df
