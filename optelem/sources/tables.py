"""Readers of telemetry, pages, change ticks, file freshness and visit logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def scan_events(spark: SparkSession, source: str, schema: str | T.StructType = EVENTS_SCHEMA) -> DataFrame:
    """Columnar read of telemetry from a path, or from a catalog table when the name has no slash."""
    if "/" in source:
        return spark.read.schema(schema).parquet(source)
    return spark.table(source)


def stream_events(spark: SparkSession, path: str, schema: str | T.StructType = EVENTS_SCHEMA, files_per_trigger: int = 100,
                  time: str = "ts") -> DataFrame:
    """The same read as a micro-batch source; event time becomes `timestamp`, which watermarks need."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return stream.withColumn(time, F.col(time).cast("timestamp"))


def stream_rate(spark: SparkSession, rows_per_second: int) -> DataFrame:
    """Load-test feed: (timestamp, value) rows at a steady rate."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()


def scan_pages(pages: DataFrame) -> DataFrame:
    """page_id, route, html; the route is the path of the page's address."""
    path = F.try_parse_url("url", F.lit("PATH"))
    return pages.select("page_id", F.when(F.coalesce(path, F.lit("")) == "", F.lit("/")).otherwise(path).alias("route"), "html")


def changes_since(df: DataFrame, cursor: str, since: int) -> DataFrame:
    """How many rows lie after a cursor, and the new cursor (the old one when nothing came)."""
    return (df.where(F.col(cursor) > since)
            .agg(F.count(F.lit(1)).alias("count"), F.coalesce(F.max(cursor), F.lit(since).cast("long")).alias("cursor")))


def file_times(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path and modified_at of the files below a folder; contents are not read."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
            .load(folder).select("path", F.col("modificationTime").alias("modified_at")))


def stale_outputs(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """dataset, is_stale: newest input after the oldest output, or no output. Inputs: (dataset, modified_at)."""
    newest = inputs.groupBy("dataset").agg(F.max("modified_at").alias("_in"))
    oldest = outputs.groupBy("dataset").agg(F.min("modified_at").alias("_out"))
    stale = F.col("_out").isNull() | F.coalesce(F.col("_in") > F.col("_out"), F.lit(False))
    return newest.join(oldest, "dataset", "left").select("dataset", stale.alias("is_stale"))


def merge_visit_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """Visit logs of several products in one schema; columns a product lacks are NULL."""
    tagged = [df.select(F.lit(name).alias("source"), "*") for name, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
