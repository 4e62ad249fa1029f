"""Streaming twins of the batch operators, and the whole ingest path.

Sources come from `sources.tables.stream_events`; event time is `timestamp`. Watermarks and gaps
are arguments. Every query takes a checkpoint folder and restarts from it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from optelem.functions.exact import mean_ms
from optelem.operators import enrich, quality, sealing, threat
from optelem.operators.rollups import TIER_LIMITS, failed, one_limit
from optelem.operators.threat import SIEM_RULES
from optelem.plans.keys import join_on
from optelem.plans.lookups import lookup_side
from optelem.sources.sinks import BUCKETS, read_results, upsert_results

WATERMARK = "10 minutes"


def stream_dedupe(stream: DataFrame, watermark: str = WATERMARK, time: str = "event_time") -> DataFrame:
    """First arrival per (tenant, idempotency key) inside the watermark."""
    return stream.withWatermark(time, watermark).dropDuplicatesWithinWatermark(["tenant_id", "idempotency_key"])


def stream_hourly_rollup(stream: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """tenant_id, hour, avg_latency, requests, errors; update mode, so late rows inside the watermark correct an hour."""
    mean = mean_ms("latency_ms")
    return (stream.withWatermark("event_time", watermark).groupBy("tenant_id", F.window("event_time", "1 hour").alias("w"))
            .agg(mean.alias("avg_latency"), F.count(F.lit(1)).alias("requests"), F.count_if(failed()).alias("errors"))
            .select("tenant_id", F.col("w.start").cast("timestamp_ntz").alias("hour"), "avg_latency", "requests", "errors"))


ROLLUP_KEYS, ROLLUP_NEWEST = ["tenant_id", "hour"], ["requests", "errors", "avg_latency"]


def read_rollup(spark: SparkSession, target: str) -> DataFrame:
    """The hourly rollup as it stands: of a (tenant, hour) the version with the most requests."""
    schema = T.StructType.fromDDL("tenant_id string, hour timestamp_ntz, avg_latency double, requests long, errors long, day date")
    return read_results(spark, target, schema, ROLLUP_KEYS, ROLLUP_NEWEST).drop("day")


def write_rollup(rollup: DataFrame, target: str, checkpoint: str, buckets: int = BUCKETS, **trigger) -> StreamingQuery:
    """Keyed read model of the hourly rollup, days are partitions; `read_rollup` shows it."""
    def write(batch: DataFrame, batch_id: int) -> None:
        upsert_results(batch.withColumn("day", F.to_date("hour")), target, ROLLUP_KEYS, ROLLUP_NEWEST, batch_id=batch_id, buckets=buckets)

    return (rollup.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def stream_signals(stream: DataFrame, rule: tuple = SIEM_RULES[0], watermark: str = WATERMARK) -> DataFrame:
    """One threshold rule over tumbling or sliding windows; a signal appears once its window is closed."""
    name, condition, entity, size, slide, threshold = rule
    counted = (stream.where(condition).withWatermark("event_time", watermark)
               .groupBy("tenant_id", F.col(entity).cast("string").alias("entity"), F.window("event_time", size, slide).alias("w")).agg(F.count(F.lit(1)).alias("n")))
    return counted.where(F.col("n") >= threshold).select(
        F.lit(name).alias("rule"), "tenant_id", "entity", F.col("w.start").cast("timestamp_ntz").alias("window_start"),
        F.col("w.end").cast("timestamp_ntz").alias("window_end"), "n")


def stream_sessions(stream: DataFrame, gap: str = "30 minutes", watermark: str = WATERMARK, user: str = "user_id") -> DataFrame:
    """Sessions per user, emitted when they close."""
    return (stream.withWatermark("event_time", watermark).groupBy(user, F.session_window("event_time", gap).alias("w"))
            .agg(F.min("event_time").alias("_s"), F.max("event_time").alias("_e"), F.count(F.lit(1)).alias("events"))
            .select(user, F.col("_s").cast("timestamp_ntz").alias("started_at"), F.col("_e").cast("timestamp_ntz").alias("ended_at"),
                    F.expr("timestampdiff(SECOND, _s, _e)").alias("duration_s"), "events"))


BUCKET_OUTPUT = "tenant_id string, second timestamp, capacity double, tokens double, requests long, allowed long"


class TokenBucket(StatefulProcessor):
    """Bucket of one tenant: its newest second, the tokens at the start of it and the requests in it. Sees one row per second."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = T.StructType([T.StructField("second", T.LongType()), T.StructField("tokens", T.DoubleType()), T.StructField("used", T.LongType())])
        self.bucket = handle.getValueState("bucket", schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows)).sort_values("second")  # a row per second since the last batch, however many requests
        second, tokens, used = self.bucket.get() if self.bucket.exists() else (None, 0.0, 0)
        starts = []
        for at, capacity, n in zip(found["second"].to_numpy(dtype="datetime64[s]").astype(np.int64).tolist(), found["capacity"].tolist(), found["requests"].tolist()):
            tokens = float(capacity) if second is None else min(float(capacity), tokens - min(float(used), float(int(tokens))) + (at - second) * capacity / 60.0)
            second, used = at, n
            starts.append(tokens)
        self.bucket.update((int(second), float(tokens), int(used)))
        whole = np.floor(starts).astype(np.int64)
        yield found[["second", "capacity", "requests"]].assign(tenant_id=key[0], tokens=starts, allowed=np.minimum(whole, found["requests"].to_numpy()))[
            ["tenant_id", "second", "capacity", "tokens", "requests", "allowed"]]

    def close(self) -> None:
        pass


def stream_token_bucket(stream: DataFrame, limits: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """tenant_id, second, capacity, tokens, requests, allowed: the bucket at the start of each second in which a tenant sent requests.

    Two chained stateful operators: requests are counted per tenant and second, and a second's count goes on to the
    tenant's bucket when the watermark has passed it. No task holds requests. `bucket_decisions` gives the decision for
    each request. A tenant's state is three numbers. Needs the RocksDB state store.
    """
    counted = (stream.withWatermark("event_time", watermark).groupBy("tenant_id", F.window("event_time", "1 second").alias("w")).agg(F.count(F.lit(1)).alias("requests"))
               .select("tenant_id", F.col("w.start").alias("second"), "requests"))
    shaped = counted.join(lookup_side(one_limit(limits, ["tenant_id"])), "tenant_id", "left").select(
        "tenant_id", "second", "requests", F.coalesce("capacity", F.lit(min(TIER_LIMITS.values()))).cast("double").alias("capacity"))
    return shaped.groupBy("tenant_id").transformWithStateInPandas(TokenBucket(), BUCKET_OUTPUT, "append", "none")


def bucket_decisions(requests: DataFrame, seconds: DataFrame) -> DataFrame:
    """tenant_id, event_id, allowed, remaining, retry_after of the requests whose second is in the output of `stream_token_bucket`.

    A request's decision follows from its place within its second.
    """
    placed = requests.select("tenant_id", "event_id", "event_time", F.date_trunc("second", F.col("event_time").cast("timestamp")).alias("second"))
    placed = placed.withColumn("_pos", F.row_number().over(Window.partitionBy("tenant_id", "second").orderBy("event_time", "event_id")))
    judged = join_on(placed, seconds.select("tenant_id", "second", "capacity", "tokens"), ["tenant_id", "second"])
    whole = F.floor("tokens")
    left = F.col("tokens") - F.least(F.col("_pos").cast("double"), whole.cast("double"))
    allowed = F.col("_pos") <= whole
    retry = F.ceil((F.lit(1e0) - left) / (F.col("capacity") / F.lit(60e0))).cast("long")
    return judged.select("tenant_id", "event_id", allowed.alias("allowed"), F.floor(left).cast("long").alias("remaining"), F.when(~allowed, retry).otherwise(F.lit(0).cast("long")).alias("retry_after"))


def stream_enrich(stream: DataFrame, read_tables: Callable[[SparkSession], tuple[DataFrame, DataFrame, DataFrame]], out: str,
                  checkpoint: str, **trigger) -> StreamingQuery:
    """Tenant, network and indicator columns per micro-batch. `read_tables` is called for each batch, so refreshed feeds are seen."""
    def write(batch: DataFrame, batch_id: int) -> None:
        tenants, blocks, indicators = read_tables(batch.sparkSession)
        placed = enrich.network_class(enrich.geo_asn(quality.attribute_host(batch, tenants, "mapped_tenant"), blocks))
        threat.match_indicators(placed, indicators).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def stream_complaints(complaints: DataFrame, telemetry: DataFrame, window_minutes: int = 30, watermark: str = WATERMARK) -> DataFrame:
    """Failure counts per (tenant, filing minute) within whole minutes around it, in append mode once its window has passed.

    Failures collapse per minute and complaints per filing minute before the join, which meets on
    (tenant, minute).
    """
    failures = (telemetry.where(failed()).withWatermark("event_time", watermark)
                .groupBy("tenant_id", "service_id", "status_code", F.window("event_time", "1 minute").alias("w")).agg(F.count(F.lit(1)).alias("n"))
                .select("tenant_id", "service_id", "status_code", "n", F.window_time("w").alias("failed_at"), F.col("w.start").alias("at_minute")))
    reach, minute = F.expr(f"INTERVAL {window_minutes} MINUTE"), F.expr("INTERVAL 1 MINUTE")
    asks = (complaints.withColumn("filed_minute", F.date_trunc("minute", "filed_at")).withWatermark("filed_minute", watermark)
            .dropDuplicates(["tenant_id", "filed_minute"])
            .select(F.col("tenant_id").alias("ask_tenant"), "filed_minute",
                    F.explode(F.sequence(F.col("filed_minute") - reach, F.col("filed_minute") + reach, minute)).alias("ask_minute")))
    on = ((F.col("ask_tenant") == F.col("tenant_id")) & (F.col("ask_minute") == F.col("at_minute"))
          & (F.col("failed_at") >= F.col("filed_minute") - reach) & (F.col("failed_at") < F.col("filed_minute") + reach + minute))
    return asks.join(failures, on).select("tenant_id", "filed_minute", "service_id", "status_code", "n")


def best_causes(counts: DataFrame, complaints: DataFrame) -> DataFrame:
    """complaint_id, cause, hits over the accumulated counts of `stream_complaints`."""
    totals = counts.groupBy("tenant_id", "filed_minute", "service_id", "status_code").agg(F.sum("n").alias("n"))
    best = totals.groupBy("tenant_id", "filed_minute").agg(F.min(F.struct((-F.col("n")).alias("neg"), "service_id", "status_code")).alias("b"))
    filed = complaints.withColumn("filed_minute", F.date_trunc("minute", F.col("filed_at").cast("timestamp")))
    return filed.join(best, ["tenant_id", "filed_minute"]).select(
        "complaint_id", F.concat_ws(":", "b.service_id", F.col("b.status_code").cast("string")).alias("cause"), (-F.col("b.neg")).alias("hits"))


def late_rows(df: DataFrame, limit: str = WATERMARK) -> DataFrame:
    """Rows that arrived later than the watermark allows, as dead letters."""
    late = df.where(F.col("received_at") > F.col("event_time") + F.expr(f"INTERVAL {limit}"))
    return late.withColumn("reason", F.lit("late"))


def live_ticks(stream: DataFrame, cursor: str, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """One row per micro-batch: count of its rows and the highest cursor value."""
    def write(batch: DataFrame, batch_id: int) -> None:
        tick = batch.agg(F.count(F.lit(1)).alias("count"), F.max(cursor).alias("cursor"))
        tick.coalesce(1).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


@dataclass(frozen=True)
class IngestTargets:
    results: str
    dead_letters: str
    receipts: str
    checkpoint: str
    buckets: int = BUCKETS


class IngestTables(NamedTuple):
    """Lookup tables of an ingest stream; the last two only where events are sealed or carry a sender key."""

    tenants: DataFrame
    blocks: DataFrame
    indicators: DataFrame
    keyring: DataFrame | None = None
    sender_keys: DataFrame | None = None


@dataclass(frozen=True)
class IngestRules:
    """What an ingest stream does besides contract, tenant and lateness; a field that is left out switches its step off.

    payload: schema of sealed payloads, opened under `mode`. steps, current: upcasts by version, and the version that
    they lead to. sender_key: column with the key of the sender. tags: routing tags that metadata may carry. families:
    prefixes of product-local identifiers in the column `family`, and the universal ones.
    """

    late_limit: str = WATERMARK
    payload: str | None = None
    mode: str = "required"
    steps: dict[int, dict[str, str]] | None = None
    current: int | None = None
    sender_key: str | None = None
    tags: tuple[str, ...] | None = None
    metadata: str = "metadata"
    families: dict[str, str] | None = None
    family: str = "family"


def judge(batch: DataFrame, tenants: DataFrame, late_limit: str = WATERMARK) -> DataFrame:
    """Batch rows with `reason`: contract, tenant binding, lateness, first one wins."""
    bound = quality.bind_tenant(batch, tenants).withColumnRenamed("reason", "_tenant_reason")
    late = F.when(F.col("received_at") > F.col("event_time") + F.expr(f"INTERVAL {late_limit}"), F.lit("late"))
    return quality.check_contract(bound).withColumn("reason", F.coalesce("reason", "_tenant_reason", late)).drop("_tenant_reason")


def judge_all(batch: DataFrame, tables: IngestTables, rules: IngestRules = IngestRules()) -> tuple[DataFrame, DataFrame | None]:
    """(events with `reason`, envelopes that did not open): opening, upcasting, then every check, the first broken one wins.

    The order is version, contract, tenant, sender key, metadata, lateness. An envelope that does not open has no
    event to check; its row is the reject.
    """
    rows, unopened = batch, None
    if rules.payload:
        rows, unopened = sealing.open_columns(batch, tables.keyring, rules.payload, rules.mode)
    reasons = []
    if rules.steps is not None:
        rows = quality.upcast(rows, rules.steps)
        known = F.coalesce(F.col("version") == F.lit(rules.current), F.lit(False))
        rows = rows.withColumn("_version_reason", F.when(~known, F.lit("unknown_version")))
        reasons.append("_version_reason")
    if rules.sender_key:
        rows = quality.attribute_key(rows, tables.sender_keys, rules.sender_key)
        foreign = F.when(~F.col("key_tenant").eqNullSafe(F.col("claimed_tenant")), F.lit("key_of_other_tenant"))
        rows = rows.withColumn("_key_reason", F.coalesce("reason", foreign)).drop("reason", "key_tenant")
    if rules.tags is not None:
        rows = quality.check_metadata(rows, rules.tags, rules.metadata).withColumnRenamed("reason", "_tag_reason").drop("bad_keys")
    if rules.families:
        rows = quality.rename_family(rows, rules.family, rules.families)
    judged = judge(rows, tables.tenants, rules.late_limit)
    late = F.col("reason") == "late"
    reasons += [F.when(~late, F.col("reason")), *[c for c in ("_key_reason", "_tag_reason") if c in rows.columns], "reason"]
    own = [c for c in judged.columns if not (c.startswith("_") and c.endswith("_reason"))]
    return judged.withColumn("reason", F.coalesce(*reasons)).select(*own), unopened


RESULT_KEYS = ["tenant_id", "idempotency_key"]


def earliest() -> list:
    """The earliest arrival of an event wins, also against rows of earlier batches."""
    return [-F.unix_micros(F.col("received_at").cast("timestamp")), -F.col("delivery"), -F.col("event_id")]


def read_ingested(spark: SparkSession, targets: IngestTargets, columns: Sequence[str] | None = None) -> DataFrame:
    """The keyed results of `ingest_stream`, one row per event, whole or with the named columns."""
    schema = spark.read.parquet(targets.results).drop("key_bucket", "file_set").schema
    return read_results(spark, targets.results, schema, RESULT_KEYS, earliest(), columns)


def ingest_stream(stream: DataFrame, read_tables: Callable[[SparkSession], tuple], targets: IngestTargets, rules: IngestRules = IngestRules(),
                  **trigger) -> StreamingQuery:
    """The whole ingest path in one restart-safe query: opening, upcasting, checks, deduplication, enrichment, keyed results, dead letters and receipts.

    `read_tables` gives the fields of IngestTables and is called for each batch. The judged batch is persisted once
    and feeds every target. Results are keyed, the side outputs are one folder per batch id, so a batch that runs
    again after a crash changes nothing.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        tables = IngestTables(*read_tables(batch.sparkSession))
        judged, unopened = judge_all(batch, tables, rules)
        judged = judged.persist()
        try:
            good = quality.dedupe(judged.where("reason IS NULL"))
            placed = threat.match_indicators(enrich.network_class(enrich.geo_asn(enrich.parse_user_agent(good), tables.blocks)), tables.indicators, seen=judged)
            rows = placed.drop("reason").withColumn("day", F.to_date("event_time"))
            upsert_results(rows, targets.results, RESULT_KEYS, earliest(), batch_id=batch_id, buckets=targets.buckets, distinct=True)  # the contract asks for a key
            rejected = [judged] if unopened is None else [judged, unopened]
            quality.dead_letters(*rejected).write.mode("overwrite").parquet(f"{targets.dead_letters}/batch={batch_id}")
            shared = ["tenant_id", "idempotency_key", *quality.ARRIVAL, "reason"]
            seen = reduce(DataFrame.unionByName, [d.select(*shared) for d in rejected])
            receipt = quality.batch_receipts(seen.withColumn("batch_id", F.concat_ws("-", F.lit(str(batch_id)), "tenant_id")))
            receipt.write.mode("overwrite").parquet(f"{targets.receipts}/batch={batch_id}")
        finally:
            judged.unpersist()

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", targets.checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
