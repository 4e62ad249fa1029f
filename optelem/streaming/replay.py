"""Replays: a table fed to a stream slice by slice, the query started anew for each, as after a crash between them."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from optelem.session import ensure_checkpoint_dir

ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
TIMEOUT_S = 3600


@dataclass(frozen=True)
class Folders:
    """Of one replay, in the shared folder: the growing input, the output and the stream's checkpoint."""

    feed: str
    out: str
    checkpoint: str


@contextmanager
def _settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in conf}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def replay(df: DataFrame, time: str, start: Callable[[DataFrame, Folders], StreamingQuery], slices: int = 3, conf: dict[str, str] | None = None) -> Folders:
    """Feed `df` to the stream that `start` builds, in `slices` of the order of `time`, and return its folders.

    Each slice is appended to the feed, and the query is started from its checkpoint and runs until it has read all
    there is; a last start finds nothing new. `time` comes as `timestamp`, which watermarks need. Rows whose time is
    NULL are in the first slice.
    """
    spark = df.sparkSession
    root = f"{ensure_checkpoint_dir(spark)}/replay-{uuid.uuid4().hex}"
    folders = Folders(f"{root}/feed", f"{root}/out", f"{root}/checkpoint")
    at = F.unix_micros(F.col(time).cast("timestamp"))
    cuts = df.agg(F.percentile_approx(at, [i / slices for i in range(1, slices)])).first()[0] or []
    place = sum((F.coalesce(at > cut, F.lit(False)).cast("int") for cut in cuts), F.lit(0))
    with _settings(spark, conf or {}):
        for number in range(slices + 1):
            if number < slices:
                df.where(place == number).write.mode("append").parquet(folders.feed)
            stream = spark.readStream.schema(df.schema).parquet(folders.feed).withColumn(time, F.col(time).cast("timestamp"))
            query = start(stream, folders)
            if not query.awaitTermination(TIMEOUT_S):
                query.stop()
                raise TimeoutError(f"the replay of slice {number} did not end")
    return folders


def to_files(shape: Callable[[DataFrame], DataFrame], mode: str = "append") -> Callable[[DataFrame, Folders], StreamingQuery]:
    """For `replay`: what `shape` makes of the stream, as Parquet files."""
    def start(stream: DataFrame, folders: Folders) -> StreamingQuery:
        return (shape(stream).writeStream.outputMode(mode).format("parquet").option("path", folders.out)
                .option("checkpointLocation", folders.checkpoint).trigger(availableNow=True).start())

    return start


def read_out(spark: SparkSession, folders: Folders) -> DataFrame:
    return spark.read.parquet(folders.out)
