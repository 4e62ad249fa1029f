"""Registered queries and oracles: streams replayed slice by slice, and sinks written and read back."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import functions as F

from optelem.fixtures import query, view, with_views
from optelem.operators import rollups, threat
from optelem.session import ensure_checkpoint_dir
from optelem.sources import documents, landing, sinks
from optelem.sources.ingest_format import TelemetryIngest
from optelem.streaming import streams
from optelem.streaming.replay import ROCKSDB, read_out, replay, to_files
from registry.quality import JUDGED, _judged
from registry.rollups import ORACLES as BATCH, ROLLUP, _limits

RULE = ("error_burst", "status_code >= 500", "tenant_id", "1 hour", "1 hour", 2)
LATE = "SELECT event_id, event_time, CASE WHEN event_id % 17 = 0 THEN event_time + INTERVAL '11' MINUTE WHEN event_id % 17 = 1 THEN event_time + INTERVAL '10' MINUTE ELSE received_at END AS received_at, delivery FROM raw_tel"
BUCKETS = 2


def _tel(spark, d):
    return view(spark, d, "tel")


def _folder(spark, name):
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _files(spark, d, source, time, shape):
    return read_out(spark, replay(view(spark, d, source), time, to_files(shape)))


def _before(spark, d, hours=1):
    """An hour before the newest event."""
    return _tel(spark, d).agg(F.max("event_time")).first()[0] - timedelta(hours=hours)


def _events(spark, d):
    found = _files(spark, d, "tel", "event_time", lambda s: s)
    return found.select("event_id", "tenant_id", F.col("event_time").cast("timestamp_ntz").alias("event_time"))


def _deduped(spark, d):
    return _files(spark, d, "raw_tel", "received_at", lambda s: streams.stream_dedupe(s.withColumn("event_time", F.col("event_time").cast("timestamp")))).select("tenant_id", "idempotency_key")


def _rollup(spark, d):
    def start(stream, folders):
        return streams.write_rollup(streams.stream_hourly_rollup(stream), folders.out, folders.checkpoint, buckets=BUCKETS)

    return streams.read_rollup(spark, replay(_tel(spark, d), "event_time", start).out)


def _signals(spark, d):
    found = _files(spark, d, "tel", "event_time", lambda s: streams.stream_signals(s, RULE))
    return found.where(F.col("window_end") < F.lit(_before(spark, d)).cast("timestamp_ntz"))


def _sessions(spark, d):
    found = _files(spark, d, "tel", "event_time", streams.stream_sessions)
    return found.where(F.col("ended_at") < F.lit(_before(spark, d)).cast("timestamp_ntz"))


def _bucket(spark, d):
    def start(stream, folders):
        return to_files(lambda s: streams.stream_token_bucket(s, _limits(spark, d)))(stream, folders)

    seconds = read_out(spark, replay(_tel(spark, d), "event_time", start, conf=ROCKSDB))
    early = _tel(spark, d).where(F.col("event_time") < F.lit(_before(spark, d)).cast("timestamp_ntz"))
    return streams.bucket_decisions(early, seconds)


def _lookups(spark, d):
    return view(spark, d, "tenants"), view(spark, d, "geo_blocks"), threat.merge_feeds(view(spark, d, "ioc_feed"), as_of="2024-02-01 00:00:00")


def _enriched(spark, d):
    def start(stream, folders):
        return streams.stream_enrich(stream, lambda s: _lookups(s, d), folders.out, folders.checkpoint)

    found = read_out(spark, replay(_tel(spark, d), "event_time", start))
    return found.select("event_id", "host", F.col("mapped_tenant").alias("mapped"))


def _ticks(spark, d):
    def start(stream, folders):
        return streams.live_ticks(stream, "event_id", folders.out, folders.checkpoint)

    ticks = read_out(spark, replay(_tel(spark, d), "event_time", start))
    return ticks.agg(F.count(F.lit(1)).alias("ticks"), F.sum("count").alias("n"), F.max("cursor").alias("cursor"))


def _written_ticks(spark, d):
    """Rows read back per micro-batch beside the tick that its write counted."""
    folders = []

    def start(stream, f):
        folders[:] = [f"{f.out}/rows", f"{f.out}/ticks"]
        return landing.ticking_batches(stream, "event_id", *folders, f.checkpoint)

    replay(_tel(spark, d), "event_time", start)
    written = spark.read.parquet(folders[0]).groupBy("batch").agg(F.count(F.lit(1)).alias("_n"), F.max("event_id").alias("_top"))
    both = spark.read.parquet(folders[1]).join(written, "batch", "full")
    same = F.coalesce((F.col("count") == F.col("_n")) & (F.col("cursor") == F.col("_top")), F.lit(False))
    return both.agg(F.count(F.lit(1)).alias("ticks"), F.sum("count").alias("n"), F.max("cursor").alias("cursor"), F.bool_and(same).alias("as_written"))


def _landed_receipt(spark, d):
    """The raw table as one batch: its receipt beside the number of rows in the files."""
    accepted, rejected = _folder(spark, "accepted"), _folder(spark, "rejected")
    receipt = landing.land_batch(_judged(spark, d), "raw", accepted, rejected)
    in_files = {c: spark.read.parquet(p).agg(F.count(F.lit(1))).scalar() for c, p in (("rows_accepted", accepted), ("rows_rejected", rejected))}
    return receipt.withColumns(in_files)


def _batches(spark, d):
    def start(stream, folders):
        return sinks.write_batches(stream, folders.out, folders.checkpoint)

    return read_out(spark, replay(_tel(spark, d), "event_time", start)).select("event_id", "tenant_id")


def _ingested(spark, d):
    targets = []

    def start(stream, folders):
        targets[:] = [streams.IngestTargets(f"{folders.out}/results", f"{folders.out}/dead", f"{folders.out}/receipts", folders.checkpoint, BUCKETS)]
        timed = stream.withColumn("received_at", F.col("received_at").cast("timestamp_ntz"))
        return streams.ingest_stream(timed, lambda s: _lookups(s, d), targets[0])

    replay(view(spark, d, "raw_tel"), "received_at", start)
    good = streams.read_ingested(spark, targets[0], ["event_id", "idempotency_key", "delivery"]).select("*", F.lit(None).cast("string").alias("error_class"))
    dead = spark.read.parquet(targets[0].dead_letters)
    return good.unionByName(dead.select("event_id", "idempotency_key", F.col("attempts").alias("delivery"), "error_class"))


def _landed(spark, d):
    spark.dataSource.register(TelemetryIngest)
    path = _folder(spark, "landing")
    _tel(spark, d).select("event_id", "tenant_id").write.format("telemetry_ingest").mode("append").option("path", path).option("source", "replay").save()
    found = documents.scan_batches(spark, path)
    return found.select("source", F.variant_get("record", "$.event_id", "long").alias("event_id"), F.variant_get("record", "$.tenant_id", "string").alias("tenant_id"))


def _upserted(spark, d):
    path, tel = _folder(spark, "model"), _tel(spark, d)
    whole = rollups.hourly_rollup(tel).withColumn("day", F.to_date("hour"))
    for batch in (rollups.hourly_rollup(tel.where("event_id % 2 = 0")).withColumn("day", F.to_date("hour")), whole, whole):
        sinks.upsert_results(batch, path, streams.ROLLUP_KEYS, streams.ROLLUP_NEWEST, buckets=BUCKETS)
    sinks.compact_results(spark, path, whole.schema, streams.ROLLUP_KEYS, streams.ROLLUP_NEWEST, most=1)
    return streams.read_rollup(spark, path)


def _exported(spark, d):
    root = _folder(spark, "exports")
    rows = _tel(spark, d).where("tenant_id = 't3'").select("event_id", "tenant_id", "latency_ms")
    job = sinks.export_tenant(rows, "t3", "job-1", root)
    return spark.read.parquet(f"{root}/tenants/t3/exports/job-1").join(F.broadcast(job.select("tenant_id", F.col("n").alias("job_rows"))), "tenant_id")  # one job


QUERIES = {
    "stream_events": _events,
    "stream_dedupe": _deduped,
    "stream_hourly_rollup": _rollup,
    "stream_signals": _signals,
    "stream_sessions": _sessions,
    "stream_token_bucket": _bucket,
    "stream_enrich": _enriched,
    "late_rows": lambda s, d: streams.late_rows(query(s, d, LATE)).select("event_id", "delivery", "reason"),
    "live_ticks": _ticks,
    "ticking_batches": _written_ticks,
    "land_batch": _landed_receipt,
    "ingest_stream": _ingested,
    "write_batches": _batches,
    "telemetry_ingest": _landed,
    "upsert_results": _upserted,
    "export_tenant": _exported,
}

CLOSED = "(SELECT max(event_time) - INTERVAL 1 HOUR FROM tel)"
ORACLES = {
    "stream_events": "SELECT event_id, tenant_id, event_time FROM tel",
    "stream_dedupe": "SELECT DISTINCT tenant_id, idempotency_key FROM raw_tel",
    "stream_hourly_rollup": f"WITH {ROLLUP} SELECT * FROM roll",
    "stream_signals": f"""SELECT 'error_burst' AS rule, tenant_id, tenant_id AS entity, hour AS window_start, hour + INTERVAL 1 HOUR AS window_end, n FROM
      (SELECT tenant_id, date_trunc('hour', event_time) AS hour, count(*) AS n FROM tel WHERE status_code >= 500 GROUP BY ALL) h WHERE n >= 2 AND hour + INTERVAL 1 HOUR < {CLOSED}""",
    "stream_sessions": f"""WITH marked AS (SELECT *, CASE WHEN event_time <= lag(event_time) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM tel WINDOW w AS (PARTITION BY user_id ORDER BY event_time, event_id)),
      numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY event_time, event_id) AS sno FROM marked)
      SELECT user_id, min(event_time) AS started_at, max(event_time) AS ended_at, (epoch_us(max(event_time)) - epoch_us(min(event_time))) // 1000000 AS duration_s, count(*) AS events FROM numbered GROUP BY user_id, sno HAVING max(event_time) < {CLOSED}""",
    "stream_enrich": "SELECT event_id, tel.host, t.tenant_id AS mapped FROM tel LEFT JOIN tenants t ON tel.host = t.host",
    "late_rows": f"SELECT event_id, delivery, 'late' AS reason FROM ({LATE}) l WHERE event_id % 17 = 0",
    "live_ticks": "SELECT CAST(3 AS BIGINT) AS ticks, CAST(count(*) AS BIGINT) AS n, max(event_id) AS cursor FROM tel",
    "ticking_batches": "SELECT CAST(3 AS BIGINT) AS ticks, CAST(count(*) AS BIGINT) AS n, max(event_id) AS cursor, true AS as_written FROM tel",
    "land_batch": f"""WITH {JUDGED}, c AS (SELECT count(*) AS n, count(reason) AS rejected, (SELECT count(*) FROM (SELECT DISTINCT tenant_id, idempotency_key FROM judged WHERE reason IS NULL) k) AS accepted FROM judged)
      SELECT 'raw' AS batch_id, n, accepted, n - accepted - rejected AS duplicate, rejected, CASE WHEN accepted = n THEN 'complete' WHEN accepted > 0 THEN 'partial' ELSE 'rejected' END AS state,
      accepted AS rows_accepted, rejected AS rows_rejected FROM c""",
    "ingest_stream": f"""WITH {JUDGED}, good AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, idempotency_key ORDER BY received_at, delivery, event_id) AS rn FROM judged WHERE reason IS NULL)
      SELECT event_id, idempotency_key, delivery, NULL AS error_class FROM good WHERE rn = 1 UNION ALL SELECT event_id, idempotency_key, delivery, reason FROM judged WHERE reason IS NOT NULL""",
    "write_batches": "SELECT event_id, tenant_id FROM tel",
    "telemetry_ingest": "SELECT 'replay' AS source, event_id, tenant_id FROM tel",
    "upsert_results": f"WITH {ROLLUP} SELECT * FROM roll",
    "export_tenant": "SELECT event_id, tenant_id, latency_ms, count(*) OVER () AS job_rows FROM tel WHERE tenant_id = 't3'",
}
ORACLES = {k: with_views(v) for k, v in ORACLES.items()}
ORACLES["stream_token_bucket"] = f"SELECT * FROM ({BATCH['token_bucket_audit']}) b WHERE event_id IN (SELECT event_id FROM events WHERE ts < (SELECT max(ts) - INTERVAL 1 HOUR FROM events))"
