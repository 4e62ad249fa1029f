"""Registered queries and oracles: coverage, retention, erasure, key ages, batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from optelem.fixtures import query, view, with_views
from optelem.operators import lifecycle, rollups, sealing
from optelem.sources import sinks
from registry.rollups import ROLLUP

SWEEP_AS_OF = "2024-02-10 00:00:00"
KEYRING = "SELECT concat('key-', CAST(o_orderkey AS STRING)) AS kid, o_orderdate AS created_at, o_orderkey % 7 = 0 AS is_active FROM orders"


def _tel(spark, d):
    return view(spark, d, "tel")


def _stale_rollups(spark, d):
    """Rollups with missing, early-refreshed, wrong and orphan hours."""
    r = rollups.hourly_rollup(_tel(spark, d))
    h = F.hour("hour")
    kept = r.where(~((h == 5) & (F.col("tenant_id") == "t1")))
    wrong = kept.withColumn("requests", F.when(h == 7, F.col("requests") + 1).otherwise(F.col("requests")))
    orphans = r.where((h == 3) & (F.col("tenant_id") == "t2")).withColumn("tenant_id", F.lit("t77"))
    after = F.when(h == 9, F.expr("INTERVAL 10 MINUTE")).otherwise(F.expr("INTERVAL 60 MINUTE"))
    return wrong.unionByName(orphans).withColumn("refreshed_at", F.col("hour") + after)


def _gaps(spark, d):
    return lifecycle.coverage_gaps(_tel(spark, d), _stale_rollups(spark, d))


def _classed(spark, d):
    cls = F.when(F.col("event_type") == "error", "audit").when(F.col("event_type") == "signup", "billing").when(F.col("event_type") == "purchase", "ip_block").otherwise("telemetry")
    return _tel(spark, d).withColumn("class", cls)


def _tables(spark, d):
    return {"telemetry": _tel(spark, d), "accounts": view(spark, d, "accounts"), "observations": view(spark, d, "tech_obs")}


def _erased(spark, d):
    before = _tables(spark, d)
    return lifecycle.erase_receipt(before, lifecycle.erase_tenant(before, "t3"), "t3")


def _subject(spark, d):
    return {"telemetry": _tel(spark, d).select("event_id", "user_id", "tenant_id", "event_type"),
            "consent": view(spark, d, "consent").select("user_id", "analytical", "marketing")}


def _patch(spark, d):
    return query(spark, d, "SELECT event_id, CAST(NULL AS STRING) AS event_type, 'fixed.example.com' AS host FROM tel WHERE event_type = 'signup'")


def _records(spark, d):
    return _tel(spark, d).select("tenant_id", F.col("service_id").alias("source"), "event_id",
                                 F.to_json(F.struct("event_id", "event_type", "user_agent")).alias("record"))


def _packed(spark, d):
    """One row per batch, from whole packed records."""
    packed = sinks.pack_batches(_records(spark, d))
    return packed.groupBy("tenant_id", "source", "batch_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("n_bytes"))


QUERIES = {
    "coverage_gaps": _gaps,
    "repair_rollups": lambda s, d: lifecycle.repair_rollups(_tel(s, d), _stale_rollups(s, d), _gaps(s, d)),
    "retention_sweep": lambda s, d: lifecycle.retention_sweep(_classed(s, d), _gaps(s, d), SWEEP_AS_OF).select("event_id", "class", "verdict"),
    "erase_tenant": _erased,
    "erase_tenant_kept": lambda s, d: lifecycle.erase_tenant(_tables(s, d), "t3")["accounts"],
    "subject_export": lambda s, d: lifecycle.subject_export(_subject(s, d), 42),
    "subject_rectify": lambda s, d: lifecycle.subject_rectify(_tel(s, d), _patch(s, d), ["event_id"]).select("event_id", "event_type", "host"),
    "keys_due": lambda s, d: sealing.keys_due(query(s, d, KEYRING), "1998-01-01 00:00:00", 600),
    "pack_batches": _packed,
}

STALE = ROLLUP + """, stale AS (SELECT tenant_id, hour, avg_latency, CASE WHEN EXTRACT(HOUR FROM hour) = 7 THEN requests + 1 ELSE requests END AS requests, errors,
  hour + CASE WHEN EXTRACT(HOUR FROM hour) = 9 THEN INTERVAL 10 MINUTE ELSE INTERVAL 60 MINUTE END AS refreshed_at FROM roll WHERE NOT (EXTRACT(HOUR FROM hour) = 5 AND tenant_id = 't1')
  UNION ALL SELECT 't77', hour, avg_latency, requests, errors, hour + INTERVAL 60 MINUTE FROM roll WHERE EXTRACT(HOUR FROM hour) = 3 AND tenant_id = 't2'),
 gaps AS (SELECT * FROM (SELECT coalesce(a.tenant_id, b.tenant_id) AS tenant_id, coalesce(a.hour, b.hour) AS hour, CASE WHEN b.tenant_id IS NULL THEN 'missing' WHEN a.tenant_id IS NULL THEN 'orphan' WHEN a.newest > b.refreshed_at THEN 'outdated' WHEN a.requests <> b.requests OR a.errors <> b.errors THEN 'mismatch' END AS problem
  FROM (SELECT r.*, n.newest FROM roll r JOIN (SELECT tenant_id, date_trunc('hour', event_time) AS hour, max(event_time) AS newest FROM tel GROUP BY ALL) n ON n.tenant_id = r.tenant_id AND n.hour = r.hour) a FULL OUTER JOIN stale b ON a.tenant_id = b.tenant_id AND a.hour = b.hour) x WHERE problem IS NOT NULL)"""

ORACLES = {
    "coverage_gaps": f"WITH {STALE} SELECT * FROM gaps",
    "repair_rollups": f"WITH {ROLLUP} SELECT * FROM roll",
    "retention_sweep": f"""WITH {STALE}, c AS (SELECT event_id, tenant_id, event_time, CASE event_type WHEN 'error' THEN 'audit' WHEN 'signup' THEN 'billing' WHEN 'purchase' THEN 'ip_block' ELSE 'telemetry' END AS class FROM tel)
      SELECT event_id, class, CASE WHEN class = 'billing' OR (epoch_us(TIMESTAMP '{SWEEP_AS_OF}') - epoch_us(event_time)) // 1000000 <= CASE class WHEN 'ip_block' THEN 86400 ELSE 2592000 END THEN 'kept' WHEN g.tenant_id IS NOT NULL THEN 'held' ELSE 'purged' END AS verdict
      FROM c LEFT JOIN gaps g ON g.tenant_id = c.tenant_id AND g.hour = date_trunc('hour', event_time)""",
    "erase_tenant": """SELECT 'telemetry' AS table_name, count(CASE WHEN tenant_id = 't3' THEN 1 END) AS removed, count(CASE WHEN tenant_id <> 't3' THEN 1 END) AS kept, CAST(0 AS BIGINT) AS remaining FROM tel
      UNION ALL SELECT 'accounts', count(CASE WHEN tenant_id = 't3' THEN 1 END), count(CASE WHEN tenant_id <> 't3' THEN 1 END), 0 FROM accounts
      UNION ALL SELECT 'observations', count(CASE WHEN tenant_id = 't3' THEN 1 END), count(CASE WHEN tenant_id <> 't3' THEN 1 END), 0 FROM tech_obs""",
    "erase_tenant_kept": "SELECT * FROM accounts WHERE tenant_id <> 't3'",
    "subject_export": """SELECT 'telemetry' AS table_name, json_object('event_id', event_id, 'user_id', user_id, 'tenant_id', tenant_id, 'event_type', event_type)::VARCHAR AS row_json FROM tel WHERE user_id = 42
      UNION ALL SELECT 'consent', json_object('user_id', user_id, 'analytical', analytical, 'marketing', marketing)::VARCHAR FROM consent WHERE user_id = 42""",
    "subject_rectify": "SELECT event_id, event_type, CASE WHEN event_type = 'signup' THEN 'fixed.example.com' ELSE host END AS host FROM tel",
    # small tables fill one bucket per tenant and source, and 25 records stay far below 8 MiB
    "pack_batches": """SELECT tenant_id, source, sha256(concat_ws('|', tenant_id, source, '0', CAST(no AS STRING))) AS batch_id, count(*) AS n, CAST(sum(n_bytes) AS BIGINT) AS n_bytes FROM
      (SELECT tenant_id, service_id AS source, (row_number() OVER (PARTITION BY tenant_id, service_id ORDER BY event_id) - 1) // 25 AS no, strlen(json_object('event_id', event_id, 'event_type', event_type, 'user_agent', user_agent)::VARCHAR) AS n_bytes FROM tel) x GROUP BY ALL""",
    "keys_due": f"SELECT kid, CAST(date_diff('day', CAST(created_at AS DATE), DATE '1998-01-01') AS INTEGER) AS age_days FROM ({KEYRING}) k WHERE is_active AND date_diff('day', CAST(created_at AS DATE), DATE '1998-01-01') >= 600",
}
ORACLES = {k: with_views(v) for k, v in ORACLES.items()}
