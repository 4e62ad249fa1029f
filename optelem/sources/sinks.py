"""Batches, idempotent writes, keyed read models, exports."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from optelem.functions.times import ts
from optelem.plans.keys import join_on
from optelem.plans.lookups import lookup_side, settle, settled_lookup
from optelem.sources.landing import write_counted

# fixed values: ingest limits
MAX_EVENTS = 25
MAX_BYTES = 8 * 1024 * 1024


ENVELOPE = '{"source":"","tenant_id":"","batch_id":"","records":[]}'
ID_BYTES = 64


def _room(max_bytes: int) -> Column:
    """Bytes that the envelope of a request leaves for records."""
    return F.lit(max_bytes - len(ENVELOPE) - ID_BYTES) - F.octet_length("source") - F.octet_length("tenant_id")


def oversized(df: DataFrame, record: str = "record", max_bytes: int = MAX_BYTES) -> DataFrame:
    """Records that fit no request, as rejects for `quality.dead_letters`; `pack_batches` packs the others."""
    return df.where(F.octet_length(record) > F.coalesce(_room(max_bytes), F.lit(0))).withColumn("reason", F.lit("record_too_large"))


def pack_batches(df: DataFrame, max_events: int = MAX_EVENTS, max_bytes: int = MAX_BYTES, bucket_rows: int = 50_000) -> DataFrame:
    """tenant_id, source, batch_id, pos, event_id, record, n_bytes: batches whose requests, envelope and commas included, keep both limits.

    Input: tenant_id, source, event_id, record (JSON text). A tenant's source is hashed into buckets
    of about `bucket_rows` records, so a hot one spreads over many tasks; packing walks each bucket
    in event order with constant state.
    """
    sized = df.select("tenant_id", "source", "event_id", "record", F.octet_length("record").cast("long").alias("n_bytes"), _room(max_bytes).cast("long").alias("_room"))
    sized = sized.where(F.col("n_bytes") <= F.col("_room"))
    buckets = sized.groupBy("tenant_id", "source").agg(F.ceil(F.count(F.lit(1)) / F.lit(bucket_rows)).cast("long").alias("_buckets"))
    placed = (sized.join(settled_lookup(buckets), ["tenant_id", "source"])
              .withColumn("_bucket", F.pmod(F.xxhash64("event_id"), F.col("_buckets"))).drop("_buckets"))
    keys = ["tenant_id", "source", "_bucket"]
    ordered = placed.repartition(*keys).sortWithinPartitions(*keys, "event_id")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner, number, count, size = None, 0, 0, 0
        for pdf in batches:
            numbers, positions = [], []
            for key, n, room in zip(zip(*[pdf[k] for k in keys]), pdf["n_bytes"], pdf["_room"]):
                if key != owner:
                    owner, number, count, size = key, 0, 0, 0
                elif count == max_events or size + n > room:
                    number, count, size = number + 1, 0, 0
                numbers.append(number)
                positions.append(count)
                count, size = count + 1, size + n + 1  # the comma
            yield pdf.drop(columns="_room").assign(_number=numbers, pos=positions)

    packed = ordered.mapInPandas(pack, "tenant_id string, source string, event_id long, record string, n_bytes long, _bucket long, _number long, pos int")
    batch_id = F.sha2(F.concat_ws("|", "tenant_id", "source", F.col("_bucket").cast("string"), F.col("_number").cast("string")), 256)
    return packed.select("tenant_id", "source", batch_id.alias("batch_id"), "pos", "event_id", "record", "n_bytes")


def batch_documents(packed: DataFrame) -> DataFrame:
    """batch_id and the posted document; a batch holds at most MAX_EVENTS records, so collecting it is bounded."""
    records = F.transform(F.array_sort(F.collect_list(F.struct("pos", "record"))), lambda r: r["record"])
    body = F.concat(F.lit('{"source":"'), F.col("source"), F.lit('","tenant_id":"'), F.col("tenant_id"), F.lit('","batch_id":"'),
                    F.col("batch_id"), F.lit('","records":['), F.array_join("_r", ","), F.lit("]}"))
    return packed.groupBy("tenant_id", "source", "batch_id").agg(records.alias("_r")).select("tenant_id", "batch_id", body.alias("document"))


def write_batches(stream: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """One folder per micro-batch, overwritten when a batch is run again."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def read_if_present(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """The Parquet table at `path`, or None before its first write."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def drop_rows(spark: SparkSession, path: str, gone: Column, partition: str | None = None) -> None:
    """Rewrite the Parquet table at `path` without the rows for which `gone` holds.

    With the name of its partition column, only partitions that hold such rows are written, and those that hold
    nothing else are removed. What is kept is staged next to the table before anything of it is replaced.
    """
    df = spark.read.parquet(path)
    gone = F.coalesce(gone, F.lit(False))
    staged = path.rstrip("/") + "__staged"
    if partition is None:
        df.where(~gone).write.mode("overwrite").parquet(staged)
        spark.read.schema(df.schema).parquet(staged).write.mode("overwrite").parquet(path)
        return
    folder = F.regexp_extract(F.input_file_name(), "^(.*)/[^/]*$", 1)
    touched = settle(df.where(gone).select(F.col(partition), folder.alias("_folder")).distinct())
    affected = join_on(df, lookup_side(touched.select(partition).distinct()), [partition], "left_semi")
    affected.where(~gone).write.mode("overwrite").parquet(staged)
    kept = spark.read.schema(df.schema).parquet(staged)
    emptied = join_on(touched, kept.select(partition).distinct(), [partition], "left_anti").select("_folder").collect()  # partitions, not rows
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    for row in emptied:
        target = spark._jvm.org.apache.hadoop.fs.Path(row["_folder"])
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


BUCKETS = 16


def _newest(df: DataFrame, keys: Sequence[str], newest: Sequence[str | Column], columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*newest)).alias("_row")).select("_row.*")


def upsert_results(batch: DataFrame, target: str, keys: Sequence[str], newest: Sequence[str | Column], partition: str = "day", batch_id: int | str | None = None,
                   buckets: int = BUCKETS, distinct: bool = False) -> None:
    """Add a batch to a keyed read model: a file set per batch in folders by (partition, key bucket, batch). Nothing older is read or written.

    A batch that is applied again replaces its own files, so it adds nothing; `batch_id` names it, by default a digest of
    its rows. `read_results` shows the newest version of each key, `compact_results` merges folders. The number of
    buckets of a target must stay the same. `distinct` says that the batch holds each key once already.
    """
    if batch_id is None:
        mark = batch.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*batch.columns).cast("decimal(38,0)"))).first()
        batch_id = f"{mark[0]}x{mark[1]}"
    rows = batch if distinct else _newest(batch, keys, newest, batch.columns)
    placed = rows.withColumn("key_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).withColumn("file_set", F.lit(f"b{batch_id}"))
    (placed.repartition(partition, "key_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(partition, "key_bucket", "file_set").parquet(target))


def _file_sets(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame | None:
    return read_if_present(spark, target, T.StructType([*schema.fields, T.StructField("key_bucket", T.IntegerType()), T.StructField("file_set", T.StringType())]))


def read_results(spark: SparkSession, target: str, schema: T.StructType, keys: Sequence[str], newest: Sequence[str | Column], columns: Sequence[str] | None = None) -> DataFrame:
    """The read model at `target`: the newest version of each key, whatever file sets it lies in. Filters on the partition are pushed to the files.

    With `columns`, only those are shuffled and returned.
    """
    found = _file_sets(spark, target, schema)
    if found is None:
        return spark.createDataFrame([], schema).select(*(columns or schema.names))
    return _newest(found, keys, newest, columns or schema.names)


def compact_results(spark: SparkSession, target: str, schema: T.StructType, keys: Sequence[str], newest: Sequence[str | Column], partition: str = "day", most: int = 8) -> int:
    """Merge buckets with more than `most` file sets into one set each and return their number; others are not touched.

    The merged set is complete before the old ones are deleted, and rows that stand in both are one to a reader, so a
    crash at any point loses nothing and the next run goes on.
    """
    found = _file_sets(spark, target, schema)
    if found is None:
        return 0
    folder = F.regexp_extract(F.input_file_name(), "^(.*)/[^/]*$", 1)
    sets = settle(found.select(partition, "key_bucket", "file_set", folder.alias("_folder")).distinct())  # folders, not rows
    full = settle(sets.groupBy(partition, "key_bucket").agg(F.count_distinct("file_set").alias("_sets"), F.max("file_set").alias("_last")).where(F.col("_sets") > most))
    number = full.count()
    if number:
        merged = _newest(join_on(found, lookup_side(full.select(partition, "key_bucket")), [partition, "key_bucket"], "left_semi"), keys, newest, [*schema.names, "key_bucket"])
        name = f"m{uuid.uuid4().hex}"
        (merged.withColumn("file_set", F.lit(name)).repartition(partition, "key_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(partition, "key_bucket", "file_set").parquet(target))
        for row in join_on(sets, full.select(partition, "key_bucket"), [partition, "key_bucket"], "left_semi").select("_folder").distinct().toLocalIterator():
            path = spark._jvm.org.apache.hadoop.fs.Path(row["_folder"])
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return number


def export_tenant(df: DataFrame, tenant: str, job: str, root: str, fmt: str = "parquet") -> DataFrame:
    """Write one tenant's rows below tenants/{tenant}/exports/{job}/ and return the job row.

    Rows of any other tenant make the job fail before it writes. A job's folder is never replaced.
    """
    if fmt not in ("csv", "json", "parquet"):
        raise ValueError(f"format {fmt} is not offered")
    if df.where(~F.col("tenant_id").eqNullSafe(F.lit(tenant))).limit(1).count():
        raise PermissionError(f"rows of other tenants in the export of {tenant}")
    path = f"{root}/tenants/{tenant}/exports/{job}"
    n = write_counted(df, path, {"n": F.count(F.lit(1))}, fmt=fmt, mode="errorifexists", **({"header": "true"} if fmt == "csv" else {}))["n"]
    return df.sparkSession.createDataFrame([(job, tenant, fmt, path, n, "complete")],
                                           "job_id string, tenant_id string, format string, path string, n long, status string")


def recent_metrics(rollup: DataFrame, as_of: str, metrics: Sequence[str] = ("avg_latency", "requests", "errors")) -> DataFrame:
    """Yesterday-onward rollup rows as tenant_id, metric_name, metric_value, recorded_at."""
    recent = rollup.where(F.col("hour") >= ts(as_of) - F.expr("INTERVAL 1 DAY"))
    return (recent.select("tenant_id", "hour", *[F.col(m).cast("double").alias(m) for m in metrics])
            .unpivot(["tenant_id", "hour"], list(metrics), "metric_name", "metric_value")
            .select("tenant_id", "metric_name", "metric_value", F.col("hour").alias("recorded_at")))


def unload_recent(rollup: DataFrame, as_of: str, target: str) -> None:
    """Write the recent metric rows, replacing the target."""
    recent_metrics(rollup, as_of).write.mode("overwrite").parquet(target)
