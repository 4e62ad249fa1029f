"""Registered queries and oracles: sources, ingest checks, privacy."""

from __future__ import annotations

from pyspark.sql import functions as F

from optelem.fixtures import query, table, view, with_views
from optelem.operators import enrich, quality
from optelem.sources import tables

RAW_BATCH = "concat(tenant_id, '-', CAST(event_id % 400 AS STRING))"
META = "SELECT event_id, tenant_id, CASE WHEN event_id % 29 = 0 THEN '{\"k\": 1, \"note\": \"x\"}' WHEN event_id % 31 = 0 THEN '{\"zone\": \"a\", \"who\": \"b\"}' ELSE props END AS metadata FROM (SELECT event_id, concat('t', CAST(user_id % 8 AS STRING)) AS tenant_id, props FROM events) e"
SENDERS = "SELECT event_id, concat('key-', CAST(k % 12 AS STRING)) AS sender_key FROM tel"
CLAIMED_FAMILY = "SELECT event_id, concat(CASE WHEN k % 3 = 0 THEN 'local_' WHEN k % 3 = 1 THEN 'legacy_' ELSE '' END, event_type) AS family FROM tel"
UPCAST_STEPS = {1: {"schema_note": "'from_v1'", "latency_ms": "latency_ms * 2"}}


def _contract(spark, d):
    return quality.check_contract(view(spark, d, "raw_tel"))


def _bound(spark, d):
    return quality.bind_tenant(view(spark, d, "raw_tel"), view(spark, d, "tenants"))


def _judged(spark, d):
    """raw_tel with the contract reason, then the tenant reason."""
    bound = _bound(spark, d).withColumnRenamed("reason", "tenant_reason")
    return quality.check_contract(bound).withColumn("reason", F.coalesce("reason", "tenant_reason"))


def _dlq(spark, d):
    return quality.dead_letters(_judged(spark, d), payload=["event_id", "idempotency_key", "event_type"])


def _accepted(spark, d):
    return quality.dedupe(_judged(spark, d).where("reason IS NULL"))


def _keys(spark, d):
    rows = query(spark, d, "SELECT concat('key-', CAST(n_nationkey AS STRING)) AS sender_key, concat('t', CAST(n_nationkey % 8 AS STRING)) AS tenant_id, n_nationkey % 5 <> 4 AS is_active FROM nation WHERE n_nationkey < 10")
    return rows.withColumn("key_hash", F.sha2("sender_key", 256))


def _sent(spark, d):
    return view(spark, d, "tel").withColumn("us", F.round(F.col("latency_ms") * 1000).cast("long"))


def _landed(spark, d):
    sent = _sent(spark, d).where("event_id % 101 <> 0")
    changed = sent.withColumn("us", F.when(F.col("event_id") % 211 == 0, F.col("us") + 1).otherwise(F.col("us")))
    extra = sent.where("event_id % 307 = 0").withColumn("event_id", F.col("event_id") + 100_000_000)
    return changed.unionByName(extra)


def _ga4(spark, d):
    return view(spark, d, "tel").where("event_id % 3 = 0").select("event_id", "tenant_id", "event_time", F.col("host").alias("page_host"))


def _recordings(spark, d):
    return view(spark, d, "tel").where("event_id % 3 = 1").select("event_id", "tenant_id", "event_time", F.lit(1).alias("clicks"))


def _edge(spark, d):
    return view(spark, d, "tel").where("event_id % 3 = 2").select("event_id", "tenant_id", "event_time", "client_ip")


QUERIES = {
    "scan_events": lambda s, d: tables.scan_events(s, f"{d}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props"),
    "scan_pages": lambda s, d: tables.scan_pages(table(s, d, "pages")),
    "changes_since": lambda s, d: tables.changes_since(view(s, d, "tel"), "event_id", 100),
    "merge_visit_sources": lambda s, d: tables.merge_visit_sources({"analytics": _ga4(s, d), "recording": _recordings(s, d), "edge": _edge(s, d)}),
    "check_contract": lambda s, d: _contract(s, d).select("event_id", "delivery", "reason"),
    "check_metadata": lambda s, d: quality.check_metadata(query(s, d, META), ["k", "zone"]).select("event_id", "bad_keys", "reason"),
    "bind_tenant": lambda s, d: _bound(s, d).select("event_id", "delivery", "claimed_tenant", "mapped_tenant", "reason"),
    "attribute_key": lambda s, d: quality.attribute_key(query(s, d, SENDERS), _keys(s, d)),
    "attribute_host": lambda s, d: quality.attribute_host(view(s, d, "tel"), view(s, d, "tenants"), "mapped").select("event_id", "host", "mapped"),
    "rename_family": lambda s, d: quality.rename_family(query(s, d, CLAIMED_FAMILY), "family", {"local_": "threat_", "legacy_": "status_"}),
    "dedupe": lambda s, d: quality.dedupe(view(s, d, "raw_tel")).select("tenant_id", "idempotency_key", "event_id", "delivery", "received_at"),
    "upcast": lambda s, d: quality.upcast(view(s, d, "tel"), UPCAST_STEPS).select("event_id", "version", "latency_ms", "schema_note"),
    "dead_letters": lambda s, d: _dlq(s, d),
    "replay": lambda s, d: quality.replay(_dlq(s, d), _accepted(s, d), cap=2).select("event_id", "idempotency_key", "error_class", "attempts", "state"),
    "batch_receipts": lambda s, d: quality.batch_receipts(_judged(s, d).withColumn("batch_id", F.expr(RAW_BATCH))),
    "reconcile_checksums": lambda s, d: quality.reconcile_checksums(_sent(s, d), _landed(s, d), "event_id", ["tenant_id", "status_code", "us"]),
    "quarantine_outliers": lambda s, d: quality.quarantine_outliers(view(s, d, "tel"), k=0.4).select("event_id", "tenant_id", "service_id", "is_outlier"),
    "redact_pii": lambda s, d: quality.redact_pii(table(s, d, "documents")).select("doc_id", "n_hits", "text"),
    "minimise_ips": lambda s, d: quality.minimise_ips(enrich.geo_asn(view(s, d, "tel"), view(s, d, "geo_blocks")), "2024-01-15 12:00:00").select("event_id", "client_ip", "asn", "country"),
    "consent_gate": lambda s, d: quality.consent_gate(view(s, d, "tel"), view(s, d, "consent")).select("event_id", "user_id", "tenant_id", "event_time"),
    "anonymous_counts": lambda s, d: quality.anonymous_counts(view(s, d, "tel"), view(s, d, "consent")),
}

REASON = """CASE WHEN latency_in IS NULL THEN 'missing_latency' WHEN NOT (latency_in BETWEEN 0 AND 480) THEN 'latency_out_of_range'
 WHEN NOT (status_code BETWEEN 100 AND 599) THEN 'bad_status' WHEN NOT regexp_matches(tenant_id, '^t[0-9]+$') THEN 'bad_tenant' END"""
TENANT_REASON = "CASE WHEN t.tenant_id IS NULL THEN 'unmapped_host' WHEN r.claimed_tenant IS DISTINCT FROM t.tenant_id THEN 'tenant_mismatch' END"
JUDGED = f"""judged AS (SELECT r.*, coalesce({REASON.replace('tenant_id', 'r.tenant_id')}, {TENANT_REASON}) AS reason
 FROM raw_tel r LEFT JOIN tenants t ON r.host = t.host)"""
DLQ = JUDGED + """, dlq AS (SELECT event_id, idempotency_key, reason AS error_class,
 json_object('event_id', event_id, 'idempotency_key', idempotency_key, 'event_type', event_type)::VARCHAR AS payload, delivery AS attempts FROM judged WHERE reason IS NOT NULL)"""
CONSENTED = """given AS (SELECT user_id, decided_at, bool_and(analytical) AS analytical FROM consent GROUP BY ALL),
 dated AS (SELECT t.*, coalesce(c.analytical, false) AS consented FROM tel t ASOF LEFT JOIN given c ON t.user_id = c.user_id AND t.event_time >= c.decided_at)"""

ORACLES = {
    "scan_events": "SELECT event_id, ts, user_id, event_type, value, props FROM events",
    "scan_pages": "SELECT page_id, CASE WHEN p = '' THEN '/' ELSE p END AS route, html FROM (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '[?#].*$', '') AS p, html FROM pages) x",
    "changes_since": "SELECT count(*) AS count, max(event_id) AS cursor FROM tel WHERE event_id > 100",
    "merge_visit_sources": """SELECT 'analytics' AS source, event_id, tenant_id, event_time, host AS page_host, NULL::INTEGER AS clicks, NULL::VARCHAR AS client_ip FROM tel WHERE event_id % 3 = 0
      UNION ALL SELECT 'recording', event_id, tenant_id, event_time, NULL, 1, NULL FROM tel WHERE event_id % 3 = 1
      UNION ALL SELECT 'edge', event_id, tenant_id, event_time, NULL, NULL, client_ip FROM tel WHERE event_id % 3 = 2""",
    "check_contract": f"SELECT event_id, delivery, {REASON} AS reason FROM raw_tel",
    "check_metadata": f"""SELECT event_id, bad_keys, CASE WHEN bad_keys <> '' THEN 'metadata_not_allowed' END AS reason FROM
      (SELECT event_id, array_to_string(list_sort([x FOR x IN json_keys(metadata) IF x NOT IN ('k', 'zone')]), ',') AS bad_keys FROM ({META}) m) y""",
    "bind_tenant": f"SELECT event_id, delivery, claimed_tenant, t.tenant_id AS mapped_tenant, {TENANT_REASON} AS reason FROM raw_tel r LEFT JOIN tenants t ON r.host = t.host",
    "attribute_key": f"""SELECT event_id, key_tenant, CASE WHEN key_tenant IS NULL THEN 'unknown_key' END AS reason FROM ({SENDERS}) s LEFT JOIN
      (SELECT sha256(concat('key-', CAST(n_nationkey AS STRING))) AS key_hash, concat('t', CAST(n_nationkey % 8 AS STRING)) AS key_tenant FROM nation WHERE n_nationkey < 10 AND n_nationkey % 5 <> 4) n ON sha256(sender_key) = key_hash""",
    "attribute_host": "SELECT event_id, tel.host, t.tenant_id AS mapped FROM tel LEFT JOIN tenants t ON tel.host = t.host",
    "rename_family": f"SELECT event_id, regexp_replace(regexp_replace(family, '^local_', 'threat_'), '^legacy_', 'status_') AS family FROM ({CLAIMED_FAMILY}) c",
    "dedupe": "SELECT tenant_id, idempotency_key, event_id, delivery, received_at FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, idempotency_key ORDER BY received_at, delivery, event_id) AS rn FROM raw_tel) x WHERE rn = 1",
    "upcast": "SELECT event_id, 2 AS version, CASE WHEN version = 1 THEN latency_ms * 2 ELSE latency_ms END AS latency_ms, CASE WHEN version = 1 THEN 'from_v1' END AS schema_note FROM tel",
    "dead_letters": f"WITH {DLQ} SELECT * FROM dlq",
    "replay": f"""WITH {DLQ} SELECT event_id, d.idempotency_key, error_class, attempts, CASE WHEN EXISTS (SELECT 1 FROM judged a WHERE a.reason IS NULL AND a.idempotency_key = d.idempotency_key) THEN 'already_accepted'
      WHEN attempts >= 2 THEN 'exhausted' ELSE 'replayable' END AS state FROM dlq d""",
    "batch_receipts": f"""WITH {JUDGED}, marked AS (SELECT {RAW_BATCH} AS batch_id, reason, CASE WHEN reason IS NULL THEN row_number() OVER (PARTITION BY tenant_id, idempotency_key, reason IS NULL ORDER BY received_at, delivery, event_id) END AS rn FROM judged)
      SELECT batch_id, n, accepted, n - accepted - rejected AS duplicate, rejected, CASE WHEN accepted = n THEN 'complete' WHEN accepted > 0 THEN 'partial' ELSE 'rejected' END AS state
      FROM (SELECT batch_id, count(*) AS n, count(reason) AS rejected, count(CASE WHEN rn = 1 THEN 1 END) AS accepted FROM marked GROUP BY batch_id) x""",
    "reconcile_checksums": """SELECT event_id AS key, CASE WHEN event_id % 101 = 0 THEN 'missing' WHEN event_id % 211 = 0 THEN 'changed' ELSE 'match' END AS verdict FROM tel
      UNION ALL SELECT event_id + 100000000, 'extra' FROM tel WHERE event_id % 307 = 0 AND event_id % 101 <> 0""",
    "quarantine_outliers": """SELECT event_id, t.tenant_id, t.service_id, latency_ms < q1 - 0.4e0 * (q3 - q1) OR latency_ms > q3 + 0.4e0 * (q3 - q1) AS is_outlier FROM tel t JOIN
      (SELECT tenant_id, service_id, quantile_cont(latency_ms, 0.25) AS q1, quantile_cont(latency_ms, 0.75) AS q3 FROM tel GROUP BY ALL) f ON t.tenant_id = f.tenant_id AND t.service_id = f.service_id""",
    "redact_pii": r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) + len(regexp_extract_all(t1, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}')) + len(regexp_extract_all(t2, '\+?[0-9][0-9() -]{7,}[0-9]')) AS INTEGER) AS n_hits,
      regexp_replace(t2, '\+?[0-9][0-9() -]{7,}[0-9]', '<phone>', 'g') AS text FROM
      (SELECT *, regexp_replace(t1, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}', '<ipv4>', 'g') AS t2 FROM
       (SELECT doc_id, text, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '<email>', 'g') AS t1 FROM documents) a) b""",
    "minimise_ips": """WITH marked AS (SELECT *, CASE WHEN event_time > lag(event_time) OVER w + INTERVAL 30 MINUTE THEN 1 WHEN lag(event_time) OVER w IS NULL THEN 1 ELSE 0 END AS opens FROM tel WINDOW w AS (PARTITION BY user_id ORDER BY event_time, event_id)),
      numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY event_time, event_id) AS sno FROM marked),
      ended AS (SELECT *, max(event_time) OVER (PARTITION BY user_id, sno) AS session_end FROM numbered),
      ips AS (SELECT *, split_part(client_ip, '.', 1)::BIGINT * 16777216 + split_part(client_ip, '.', 2)::BIGINT * 65536 + split_part(client_ip, '.', 3)::BIGINT * 256 + split_part(client_ip, '.', 4)::BIGINT AS ip FROM ended)
      SELECT event_id, CASE WHEN NOT (session_end + INTERVAL 30 MINUTE < TIMESTAMP '2024-01-15 12:00:00') THEN client_ip END AS client_ip, asn, country FROM ips LEFT JOIN geo_blocks ON ip BETWEEN ip_first AND ip_last""",
    "consent_gate": f"WITH {CONSENTED} SELECT event_id, user_id, tenant_id, event_time FROM dated WHERE consented",
    "anonymous_counts": f"WITH {CONSENTED} SELECT tenant_id, CAST(event_time AS DATE) AS day, count(*) AS n FROM dated WHERE NOT consented GROUP BY ALL",
}
ORACLES = {k: with_views(v) for k, v in ORACLES.items()}
