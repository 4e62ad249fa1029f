"""Streams over split files give the batch operator's table; a restart adds nothing."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from optelem.fixtures import view
from optelem.operators import enrich, quality, rollups, sealing, threat
from optelem.plans.lookups import settle
from optelem.sources import sinks, tables
from optelem.streaming import streams
from tests.conftest import SMALL, rows


@pytest.fixture(scope="module")
def tel(spark):
    return view(spark, SMALL, "tel").cache()


def in_order(folder):
    """A file stream reads oldest files first: give the files their order."""
    for i, path in enumerate(sorted(glob.glob(f"{folder}/part-*"))):
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    return folder


@pytest.fixture(scope="module")
def feed(spark, tel, tmp_path_factory):
    """tel in four files in time order."""
    folder = str(tmp_path_factory.mktemp("feed") / "tel")
    tel.repartitionByRange(4, "event_time").sortWithinPartitions("event_time", "event_id").write.parquet(folder)
    return in_order(folder)


def stream(spark, folder, schema, **kw):
    return tables.stream_events(spark, folder, schema, files_per_trigger=1, time="event_time", **kw)


def run(df, mode, out, checkpoint):
    q = (df.writeStream.outputMode(mode).format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start())
    q.awaitTermination(240)
    return df.sparkSession.read.parquet(str(out))


def after(df, column, tel, hours):
    """Rows whose window had closed when the input ended."""
    end = tel.agg(F.max("event_time")).first()[0]
    return df.where(F.col(column) < F.lit(end).cast("timestamp_ntz") - F.expr(f"INTERVAL {hours} HOURS"))


def test_rate_source(spark):
    assert tables.stream_rate(spark, 5).isStreaming


def test_dedupe(spark, tmp_path):
    raw = view(spark, SMALL, "raw_tel")
    raw.repartitionByRange(3, "received_at").sortWithinPartitions("received_at").write.parquet(str(tmp_path / "raw"))
    s = stream(spark, in_order(str(tmp_path / "raw")), raw.schema)
    out = run(streams.stream_dedupe(s), "append", tmp_path / "out", tmp_path / "ck")
    assert out.count() == quality.dedupe(raw).count() < raw.count()
    assert out.select("tenant_id", "idempotency_key").distinct().count() == out.count()


def test_hourly_rollup_and_restart(spark, feed, tel, tmp_path):
    target, checkpoint = str(tmp_path / "t"), str(tmp_path / "ck")
    for _ in range(2):
        s = streams.stream_hourly_rollup(stream(spark, feed, tel.schema))
        streams.write_rollup(s, target, checkpoint, buckets=2).awaitTermination(240)
        assert rows(streams.read_rollup(spark, target)) == rows(rollups.hourly_rollup(tel))


def test_signals(spark, feed, tel, tmp_path):
    rule = ("error_burst", "status_code >= 500", "tenant_id", "2 hours", "1 hour", 2)
    out = run(streams.stream_signals(stream(spark, feed, tel.schema), rule), "append", tmp_path / "out", tmp_path / "ck")
    want = after(threat.siem_signals(tel, [rule]), "window_end", tel, 1)
    assert rows(after(out, "window_end", tel, 1)) == rows(want.select(*out.columns)) and want.count() > 0


def test_sessions(spark, feed, tel, tmp_path):
    out = run(streams.stream_sessions(stream(spark, feed, tel.schema)), "append", tmp_path / "out", tmp_path / "ck")
    want = after(enrich.sessionise(tel), "ended_at", tel, 1)
    assert rows(after(out, "ended_at", tel, 1)) == rows(want.select(*out.columns))


def test_token_bucket(spark, feed, tel, tmp_path):
    limits = spark.createDataFrame([(f"t{i}", 1 + i % 2) for i in range(8)], "tenant_id string, capacity int")
    # every tenant's requests squeezed into a few minutes, so that buckets run dry
    tight = tel.withColumn("event_time", (F.timestamp_seconds(F.lit(1_704_067_200) + F.floor(F.col("event_id") / 4))).cast("timestamp_ntz"))
    folder = str(tmp_path / "tight")
    tight.repartitionByRange(3, "event_time").sortWithinPartitions("event_time", "event_id").write.parquet(folder)
    limits = limits.unionByName(limits.where("tenant_id = 't1'").withColumn("capacity", F.col("capacity") + 5))
    s = streams.stream_token_bucket(stream(spark, in_order(folder), tight.schema), limits, "0 seconds")
    seconds = run(s, "append", tmp_path / "out", tmp_path / "ck")
    out = streams.bucket_decisions(tight, seconds)
    end = tight.agg(F.max("event_time")).first()[0]
    want = rollups.token_bucket_audit(tight, limits).where(F.col("event_time") < F.lit(end).cast("timestamp_ntz")).select(*out.columns)  # the last second is still open
    assert rows(out) == rows(want) and out.where("NOT allowed").count() > 0 and out.where("allowed").count() > 0
    assert seconds.agg(F.sum("allowed")).first()[0] == out.where("allowed").count() and seconds.count() < out.count()


def lookups(spark):
    return (view(spark, SMALL, "tenants"), view(spark, SMALL, "geo_blocks"), threat.merge_feeds(view(spark, SMALL, "ioc_feed"), as_of="2024-02-01 00:00:00"))


def test_enrich(spark, feed, tel, tmp_path):
    streams.stream_enrich(stream(spark, feed, tel.schema), lookups, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(240)
    tenants, blocks, indicators = lookups(spark)
    want = threat.match_indicators(enrich.network_class(enrich.geo_asn(quality.attribute_host(tel, tenants, "mapped_tenant"), blocks)), indicators)
    columns = ["event_id", "mapped_tenant", "asn", "network_class", "abuse_score", "is_malicious"]
    assert rows(spark.read.parquet(str(tmp_path / "out")), *columns) == rows(want, *columns)


def test_complaints(spark, feed, tel, tmp_path):
    complaints = view(spark, SMALL, "complaints")
    complaints.write.parquet(str(tmp_path / "complaints"))
    asked = tables.stream_events(spark, str(tmp_path / "complaints"), complaints.schema, time="filed_at")
    counts = run(streams.stream_complaints(asked, stream(spark, feed, tel.schema), 60), "append", tmp_path / "out", tmp_path / "ck")
    want = enrich.complaint_root_cause(complaints, tel, 60).where("cause <> 'unknown'").select("complaint_id", "cause", "hits")
    # windows near the newest complaint are still open: the slower of both watermarks counts
    end = min(tel.agg(F.max("event_time")).first()[0], complaints.agg(F.max("filed_at")).first()[0])
    settled = complaints.where(F.col("filed_at") < F.lit(end).cast("timestamp_ntz") - F.expr("INTERVAL 4 HOURS")).select("complaint_id")
    got = streams.best_causes(counts, complaints).join(settled, "complaint_id", "left_semi")
    assert rows(got) == rows(want.join(settled, "complaint_id", "left_semi").select(*got.columns)) and got.count() > 0


def test_late_rows(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00", "2024-01-01 00:10:00"), (2, "2024-01-01 00:00:00", "2024-01-01 00:10:01")], "event_id long, e string, r string")
    df = df.select("event_id", F.col("e").cast("timestamp").alias("event_time"), F.col("r").cast("timestamp").alias("received_at"))
    assert rows(streams.late_rows(df), "event_id", "reason") == [(2, "late")]


def test_ticks(spark, feed, tel, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "ck")
    for _ in range(2):
        streams.live_ticks(stream(spark, feed, tel.schema), "event_id", out, checkpoint).awaitTermination(240)
    ticks = spark.read.parquet(out)
    assert ticks.count() == 4 and ticks.agg(F.sum("count"), F.max("cursor")).first()[:] == (tel.count(), tel.agg(F.max("event_id")).first()[0])


def test_write_batches(spark, feed, tel, tmp_path):
    for _ in range(2):
        sinks.write_batches(stream(spark, feed, tel.schema), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(240)
    assert spark.read.parquet(str(tmp_path / "out")).count() == tel.count()


def test_ingest_end_to_end(spark, tmp_path):
    raw = view(spark, SMALL, "raw_tel")
    # one row arrives an hour late
    raw = raw.withColumn("received_at", F.when((F.col("event_id") == 7) & (F.col("delivery") == 1), F.col("event_time") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("received_at"))).cache()
    raw.repartitionByRange(3, "received_at").write.parquet(str(tmp_path / "raw"))
    in_order(str(tmp_path / "raw"))
    targets = streams.IngestTargets(str(tmp_path / "results"), str(tmp_path / "dlq"), str(tmp_path / "receipts"), str(tmp_path / "ck"), buckets=1)

    def once():
        s = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "raw"))
        streams.ingest_stream(s, lookups, targets).awaitTermination(400)
        return streams.read_ingested(spark, targets), spark.read.parquet(targets.dead_letters), spark.read.parquet(targets.receipts)

    results, dlq, receipts = once()
    judged = streams.judge(raw, view(spark, SMALL, "tenants"))
    want = quality.dedupe(judged.where("reason IS NULL"))
    assert rows(results, "tenant_id", "idempotency_key", "delivery") == rows(want, "tenant_id", "idempotency_key", "delivery")
    assert dlq.count() == judged.where("reason IS NOT NULL").count() and dlq.where("error_class = 'late'").count() == 1
    assert receipts.agg(F.sum("n")).first()[0] == raw.count()
    before = rows(results, "tenant_id", "idempotency_key", "event_id")
    results, dlq, receipts = once()
    assert rows(results, "tenant_id", "idempotency_key", "event_id") == before and receipts.agg(F.sum("n")).first()[0] == raw.count()


def test_ingest_of_sealed_events(spark, tmp_path):
    """One reject of each kind on the whole path; a restart adds nothing."""
    raw = view(spark, SMALL, "raw_tel").where("event_id < 60 AND delivery = 1").where("claimed_tenant = tenant_id AND latency_in IS NOT NULL")
    good = raw.withColumn("sender_key", F.concat(F.lit("key-"), "tenant_id")).withColumn("metadata", F.lit('{"zone":"a"}')).withColumn("family", F.lit("local_x"))
    odd = good.limit(7).select("event_id").collect()
    ids = [r["event_id"] for r in odd]

    def swapped(column, i, value):
        return F.when(F.col("event_id") == ids[i], F.lit(value)).otherwise(F.col(column))

    sent = (good.withColumn("version", swapped("version", 0, 9)).withColumn("sender_key", swapped("sender_key", 1, "stolen")).withColumn("metadata", swapped("metadata", 2, '{"zone":'))
            .withColumn("status_code", swapped("status_code", 3, 999)).withColumn("claimed_tenant", swapped("claimed_tenant", 4, "t99"))
            .withColumn("received_at", F.when(F.col("event_id") == ids[5], F.col("event_time") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("received_at"))))
    key = spark.createDataFrame([("k1", bytes(range(32)), "2024-01-01", True)], "kid string, key binary, created_at string, is_active boolean")
    sealed = settle(sealing.seal_columns(sent, key, ["client_ip", "latency_in"], "ingest", "edge")).withColumn("ctx", swapped("ctx", 6, "elsewhere"))
    sealed = settle(sealed)
    sealed.write.parquet(str(tmp_path / "raw"))
    owners = view(spark, SMALL, "tenants").select(F.sha2(F.concat(F.lit("key-"), "tenant_id"), 256).alias("key_hash"), "tenant_id", F.lit(True).alias("is_active"))
    rules = streams.IngestRules(payload="client_ip string, latency_in double", steps={1: {"latency_in": "latency_in * 1"}}, current=2, sender_key="sender_key", tags=("zone",), families={"local_": "threat_"})
    targets = streams.IngestTargets(*[str(tmp_path / x) for x in ("results", "dlq", "receipts", "ck")], buckets=2)

    def read_tables(s):
        return (*lookups(s), key, owners)

    want, unopened = streams.judge_all(sealed, streams.IngestTables(*read_tables(spark)), rules)
    for _ in range(2):
        s = spark.readStream.schema(sealed.schema).parquet(str(tmp_path / "raw"))
        streams.ingest_stream(s, read_tables, targets, rules).awaitTermination(400)
        results, dlq = streams.read_ingested(spark, targets), spark.read.parquet(targets.dead_letters)
        assert rows(dlq, "event_id", "error_class") == sorted(zip(ids, ["unknown_version", "unknown_key", "metadata_malformed", "bad_status", "tenant_mismatch", "late", "not_authentic"]))
        assert rows(results, "event_id") == rows(want.where("reason IS NULL"), "event_id") and unopened.count() == 1
        assert rows(results.select("version", "family").distinct()) == [(2, "threat_x")]
        assert spark.read.parquet(targets.receipts).agg(F.sum("n"), F.sum("rejected")).first()[:] == (sent.count(), 7)
