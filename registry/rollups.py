"""Registered queries and oracles: rollups, SLA, incidents, scores, quotas, access."""

from __future__ import annotations

from pyspark.sql import functions as F

from optelem.fixtures import query, view, with_views
from optelem.operators import enrich, ml, rollups
from optelem.sources import sinks
from registry.enrichment import ENR, enriched
from registry.quality import DLQ, _dlq
from registry.threat import FLAGGED, flagged

HOUR_AS_OF = "2024-01-20 12:00:00"
NOW = "2024-01-30 12:00:00"
GAPPED = "SELECT * FROM tel WHERE EXTRACT(DAY FROM event_time) % 7 <> 3"
STATUS_PAGES = "SELECT page_id, concat('t', CAST(page_id % 8 AS STRING)) AS tenant_id, page_id % 3 = 0 AS is_published, page_id % 8 = 0 AS is_platform FROM pages"
REQUESTS = "SELECT o_orderkey AS request_id, o_custkey AS account_id FROM orders"
PROFILES = "SELECT account_id, tier, remote_id IS NOT NULL AND account_id % 10 <> 3 AS subscription_active FROM billing_local"


TRAINED = "SELECT concat('m', CAST(k % 3 AS STRING)) AS model_type, event_time AS trained_at FROM tel WHERE k % 40 < 3"


def tel(spark, d):
    return view(spark, d, "tel")


def rounded(df, *columns, digits=6):
    """Interpolated values without their last digits, which depend on how an interpolation is written."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _uptime(spark, d):
    return rollups.uptime_daily(query(spark, d, GAPPED))


def incidents(spark, d):
    return rollups.incident_intervals(tel(spark, d))


def _daily(spark, d):
    return rollups.daily_records(flagged(spark, d), incidents(spark, d))


def _limits(spark, d):
    return view(spark, d, "tenants").select("tenant_id", F.when(F.col("tier") == "Pro", 6).otherwise(2).alias("capacity"))


def _forecast_ces(spark, d):
    """Scores lowered by the spike forecast of each tenant's newest hour."""
    rollup = rollups.hourly_rollup(tel(spark, d))
    newest = ml.spike_forecast(rollup).groupBy("tenant_id").agg(F.max_by("forecast", "hour").alias("forecast"))
    return rollups.ces_scores(tel(spark, d), rollup, incidents(spark, d), 450.0, newest)


QUERIES = {
    "hourly_rollup": lambda s, d: rollups.hourly_rollup(tel(s, d)),
    "last_hour_rollup": lambda s, d: rollups.last_hour_rollup(tel(s, d), HOUR_AS_OF),
    "fast_rows": lambda s, d: rollups.fast_rows(tel(s, d), 100.0).select("event_id", "status_code", "latency_ms"),
    "uptime_daily": lambda s, d: rollups.uptime_daily(tel(s, d)),
    "fill_no_data": lambda s, d: rollups.fill_no_data(_uptime(s, d), "2024-01-01", 30),
    "sla_compliance": lambda s, d: rounded(rollups.sla_compliance(enrich.human_traffic(enriched(s, d)), 0.25, 480.0), "p99"),
    "latency_by_dimension": lambda s, d: rounded(rollups.latency_by_dimension(enriched(s, d)), "p50", "p95", "p99"),
    "top_origins": lambda s, d: rollups.top_origins(flagged(s, d)),
    "incident_intervals": incidents,
    "mttr": lambda s, d: rollups.mttr(incidents(s, d)),
    "status_now": lambda s, d: rollups.status_now(tel(s, d), NOW, 3600),
    "cumulative_records": lambda s, d: rollups.cumulative_records(_daily(s, d), 7),
    "ces_scores": lambda s, d: rollups.ces_scores(tel(s, d), rollups.hourly_rollup(tel(s, d)), incidents(s, d).where("failures >= 5"), 450.0),
    "overview_series": lambda s, d: rollups.overview_series(rollups.hourly_rollup(tel(s, d))).select("tenant_id", "name", F.posexplode("points").alias("pos", "point")).select("tenant_id", "name", "pos", "point.*"),
    "quota_usage": lambda s, d: rollups.quota_usage(tel(s, d), view(s, d, "tenants"), {"Standard": 1, "Pro": 2}),
    "sliding_rate": lambda s, d: rollups.sliding_rate(tel(s, d), 1).select("event_id", "n60", "over"),
    "token_bucket_audit": lambda s, d: rollups.token_bucket_audit(tel(s, d), _limits(s, d)).select("event_id", "tenant_id", "allowed", "remaining", "retry_after"),
    "ingest_health": lambda s, d: rollups.ingest_health(tel(s, d), _dlq(s, d), NOW, 60, 0.1, 100, query(s, d, TRAINED), 3 * 86400),
    "ces_with_forecast": _forecast_ces,
    "visible_rows": lambda s, d: rollups.visible_rows(query(s, d, STATUS_PAGES), rollups.Viewer("Operator", "t1", False, ("mfa",))),
    "entitled_rows": lambda s, d: rollups.entitled_rows(query(s, d, REQUESTS), query(s, d, PROFILES)),
    "reconcile_subscriptions": lambda s, d: rollups.reconcile_subscriptions(view(s, d, "billing_local"), view(s, d, "billing_remote")),
    "unload_recent": lambda s, d: sinks.recent_metrics(rollups.hourly_rollup(tel(s, d)), "2024-01-30 00:00:00"),
}

MEAN = "CAST(sum(CAST(round(latency_ms * 1000) AS BIGINT)) AS DOUBLE) / (1e3 * count(latency_ms))"
ROLLUP = f"roll AS (SELECT tenant_id, date_trunc('hour', event_time) AS hour, {MEAN} AS avg_latency, count(*) AS requests, count(CASE WHEN status_code >= 500 THEN 1 END) AS errors FROM tel GROUP BY ALL)"
INCIDENTS = """runs AS (SELECT *, count(CASE WHEN status_code < 500 THEN 1 END) OVER (PARTITION BY tenant_id, service_id ORDER BY event_time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run FROM tel),
 inc AS (SELECT tenant_id, service_id, started_at, ended_at, failures, (epoch_us(ended_at) - epoch_us(started_at)) // 1000000 AS duration_s FROM
  (SELECT tenant_id, service_id, run, count(CASE WHEN status_code >= 500 THEN 1 END) AS failures, min(CASE WHEN status_code >= 500 THEN event_time END) AS started_at, max(CASE WHEN status_code < 500 THEN event_time END) AS ended_at FROM runs GROUP BY ALL) x WHERE failures >= 2)"""
UPTIME = "SELECT tenant_id, service_id, CAST(event_time AS DATE) AS day, count(*) AS checks, 100e0 * count(CASE WHEN status_code < 500 THEN 1 END) / count(*) AS uptime_pct"
DIMS = "device_type, country, network_class"
SPIKES = """e AS (SELECT *, CAST(errors AS DOUBLE) / requests AS err FROM roll),
 x AS (SELECT tenant_id, hour, (coalesce((avg_latency - min(avg_latency) OVER t) / nullif(max(avg_latency) OVER t - min(avg_latency) OVER t, 0), 0) + coalesce((err - min(err) OVER t) / nullif(max(err) OVER t - min(err) OVER t, 0), 0)) / 2 AS x FROM e WINDOW t AS (PARTITION BY tenant_id)),
 q AS (SELECT tenant_id, hour, list({'v': x, 's': 0e0}) OVER (PARTITION BY tenant_id ORDER BY hour ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS seq FROM x),
 spikes AS (SELECT tenant_id, hour, list_reduce(seq, lambda a, b: {'v': CASE WHEN a.v * 0.9e0 + b.v >= 1 THEN 0e0 ELSE a.v * 0.9e0 + b.v END, 's': a.s + CASE WHEN a.v * 0.9e0 + b.v >= 1 THEN 1e0 ELSE 0e0 END}, {'v': 0e0, 's': 0e0}) AS st FROM q)"""

ORACLES = {
    "hourly_rollup": f"WITH {ROLLUP} SELECT * FROM roll",
    "last_hour_rollup": f"SELECT tenant_id, {MEAN} AS avg_latency, count(*) AS requests FROM tel WHERE event_time > TIMESTAMP '{HOUR_AS_OF}' - INTERVAL 1 HOUR AND event_time <= TIMESTAMP '{HOUR_AS_OF}' GROUP BY ALL",
    "fast_rows": "SELECT event_id, status_code, latency_ms FROM tel WHERE status_code < 400 AND latency_ms < 100",
    "uptime_daily": f"{UPTIME} FROM tel GROUP BY ALL",
    "fill_no_data": f"""WITH up AS ({UPTIME} FROM ({GAPPED}) g GROUP BY ALL), cal AS (SELECT tenant_id, service_id, CAST(d AS DATE) AS day FROM (SELECT DISTINCT tenant_id, service_id FROM up) k, generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY) g(d))
      SELECT c.tenant_id, c.service_id, c.day, CASE WHEN checks IS NULL THEN 'no_data' WHEN uptime_pct >= 99 THEN 'operational' WHEN uptime_pct >= 50 THEN 'degraded' ELSE 'outage' END AS state, uptime_pct
      FROM cal c LEFT JOIN up u ON c.tenant_id = u.tenant_id AND c.service_id = u.service_id AND c.day = u.day""",
    "sla_compliance": f"""WITH {ENR}, day AS (SELECT tenant_id, CAST(event_time AS DATE) AS day, count(*) AS requests, CAST(count(CASE WHEN status_code >= 500 THEN 1 END) AS DOUBLE) / count(*) AS error_rate, round(quantile_cont(latency_ms, 0.99), 6) AS p99 FROM human GROUP BY ALL)
      SELECT *, error_rate <= 0.25e0 AND p99 <= 480 AS compliant FROM day""",
    "latency_by_dimension": f"""WITH {ENR} SELECT {DIMS}, CAST(grouping({DIMS}) AS INTEGER) AS level, round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.95), 6) AS p95, round(quantile_cont(latency_ms, 0.99), 6) AS p99, count(*) AS n
      FROM enr GROUP BY GROUPING SETS (({DIMS}), (device_type), (country), (network_class), ())""",
    "top_origins": f"""WITH {FLAGGED}, c AS (SELECT tenant_id, country, count(*) AS n, count(CASE WHEN is_malicious THEN 1 END) AS n_flagged FROM fl GROUP BY ALL),
      r AS (SELECT *, CAST(row_number() OVER (PARTITION BY tenant_id ORDER BY n DESC, country) AS INTEGER) AS traffic_rank, CAST(row_number() OVER (PARTITION BY tenant_id ORDER BY n_flagged DESC, country) AS INTEGER) AS threat_rank FROM c)
      SELECT * FROM r WHERE traffic_rank <= 3 OR threat_rank <= 3""",
    "incident_intervals": f"WITH {INCIDENTS} SELECT * FROM inc",
    "mttr": f"""WITH {INCIDENTS} SELECT tenant_id, service_id, count(*) AS incidents, count(CASE WHEN ended_at IS NULL THEN 1 END) AS open_incidents, CAST(sum(duration_s) AS DOUBLE) / count(duration_s) AS mttr_s FROM inc GROUP BY ALL""",
    "status_now": f"""SELECT tenant_id, service_id, status_code, checked_at, CASE WHEN status_code >= 500 THEN 'down' WHEN checked_at < TIMESTAMP '{NOW}' - INTERVAL 3600 SECOND THEN 'degraded' ELSE 'operational' END AS state FROM
      (SELECT tenant_id, service_id, status_code, event_time AS checked_at, row_number() OVER (PARTITION BY tenant_id, service_id ORDER BY event_time DESC, event_id DESC) AS rn FROM tel WHERE event_time <= TIMESTAMP '{NOW}') x WHERE rn = 1""",
    "cumulative_records": f"""WITH {FLAGGED}, {INCIDENTS}, dd AS (SELECT tenant_id, CAST(event_time AS DATE) AS day, count(*) AS requests, count(CASE WHEN status_code >= 500 THEN 1 END) AS errors, count(CASE WHEN is_malicious THEN 1 END) AS threats FROM fl GROUP BY ALL),
      o AS (SELECT tenant_id, CAST(started_at AS DATE) AS day, count(*) AS incidents FROM inc GROUP BY ALL),
      a AS (SELECT dd.*, coalesce(incidents, 0) AS incidents FROM dd LEFT JOIN o ON dd.tenant_id = o.tenant_id AND dd.day = o.day)
      SELECT tenant_id, day, 100e0 * (1 - CAST(sum(errors) OVER w AS DOUBLE) / CAST(sum(requests) OVER w AS DOUBLE)) AS running_sla_pct, CAST(sum(threats) OVER w AS BIGINT) AS running_threats, CAST(sum(incidents) OVER w AS BIGINT) AS running_incidents
      FROM a WINDOW w AS (PARTITION BY tenant_id ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)""",
    "ces_scores": f"""WITH {ROLLUP}, {INCIDENTS}, t AS (SELECT tenant_id, CAST(count(CASE WHEN status_code >= 500 THEN 1 END) AS DOUBLE) / count(*) AS err, CAST(count(CASE WHEN latency_ms > 450 THEN 1 END) AS DOUBLE) / count(*) AS slow, quantile_cont(latency_ms, 0.99) AS p99 FROM tel GROUP BY tenant_id),
      h AS (SELECT tenant_id, stddev_samp(avg_latency) / avg(avg_latency) AS cv FROM roll GROUP BY tenant_id), i AS (SELECT tenant_id, count(*) AS n FROM inc WHERE failures >= 5 GROUP BY tenant_id),
      s AS (SELECT t.tenant_id, greatest(0, 100e0 - 10 * coalesce(n, 0) - 100 * slow) AS threat, 100e0 * (1 - err) * least(1e0, 450e0 / p99) AS sla, greatest(0, 100e0 - 5 * coalesce(n, 0) - 50 * coalesce(cv, 0)) AS stable
       FROM t LEFT JOIN h ON t.tenant_id = h.tenant_id LEFT JOIN i ON t.tenant_id = i.tenant_id)
      SELECT tenant_id, round(threat, 6) AS threat, round(sla, 6) AS sla, round(stable, 6) AS stable, round(0.4e0 * threat + 0.35e0 * sla + 0.25e0 * stable, 6) AS ces FROM s""",
    "ces_with_forecast": f"""WITH {ROLLUP}, {INCIDENTS}, {SPIKES}, t AS (SELECT tenant_id, CAST(count(CASE WHEN status_code >= 500 THEN 1 END) AS DOUBLE) / count(*) AS err, CAST(count(CASE WHEN latency_ms > 450 THEN 1 END) AS DOUBLE) / count(*) AS slow, quantile_cont(latency_ms, 0.99) AS p99 FROM tel GROUP BY tenant_id),
      h AS (SELECT tenant_id, stddev_samp(avg_latency) / avg(avg_latency) AS cv FROM roll GROUP BY tenant_id), i AS (SELECT tenant_id, count(*) AS n FROM inc GROUP BY tenant_id), fc AS (SELECT tenant_id, max_by(round(least(1e0, (st.s + st.v) / 12e0), 6), hour) AS f FROM spikes GROUP BY tenant_id),
      s AS (SELECT t.tenant_id, greatest(0, 100e0 - 10 * coalesce(n, 0) - 100 * slow) AS threat, 100e0 * (1 - err) * least(1e0, 450e0 / p99) AS sla, greatest(0, 100e0 - 5 * coalesce(n, 0) - 50 * coalesce(cv, 0)) AS stable, coalesce(f, 0) AS f
       FROM t LEFT JOIN h ON t.tenant_id = h.tenant_id LEFT JOIN i ON t.tenant_id = i.tenant_id LEFT JOIN fc ON fc.tenant_id = t.tenant_id)
      SELECT tenant_id, round(threat, 6) AS threat, round(sla, 6) AS sla, round(stable, 6) AS stable, round((0.4e0 * threat + 0.35e0 * sla + 0.25e0 * stable) * (1 - 0.1e0 * f), 6) AS ces FROM s""",
    "overview_series": f"""WITH {ROLLUP}, lng AS (SELECT tenant_id, hour, 'avg_latency' AS name, avg_latency AS y FROM roll UNION ALL SELECT tenant_id, hour, 'requests', requests FROM roll UNION ALL SELECT tenant_id, hour, 'errors', errors FROM roll)
      SELECT tenant_id, name, CAST(row_number() OVER (PARTITION BY tenant_id, name ORDER BY hour) - 1 AS INTEGER) AS pos, strftime(hour, '%Y-%m-%dT%H:%M') AS x, y FROM lng""",
    "token_bucket_audit": """WITH secs AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY sec) AS rn FROM (SELECT tenant_id, cap, epoch_us(event_time) // 1000000 AS sec, count(*) AS n
       FROM tel JOIN (SELECT tenant_id AS tid, CASE tier WHEN 'Pro' THEN 6 ELSE 2 END AS cap FROM tenants) l ON tid = tenant_id GROUP BY ALL) g),
      walk AS (SELECT tenant_id, cap, sec, n, rn, CAST(cap AS DOUBLE) AS tokens FROM secs WHERE rn = 1 UNION ALL
       SELECT s.tenant_id, s.cap, s.sec, s.n, s.rn, least(CAST(s.cap AS DOUBLE), w.tokens - least(CAST(w.n AS DOUBLE), floor(w.tokens)) + CAST((s.sec - w.sec) * s.cap AS DOUBLE) / 60e0) FROM walk w JOIN secs s ON s.tenant_id = w.tenant_id AND s.rn = w.rn + 1),
      ranked AS (SELECT event_id, tenant_id, epoch_us(event_time) // 1000000 AS sec, row_number() OVER (PARTITION BY tenant_id, epoch_us(event_time) // 1000000 ORDER BY event_time, event_id) AS pos FROM tel),
      j AS (SELECT r.event_id, r.tenant_id, pos <= floor(tokens) AS allowed, tokens - least(CAST(pos AS DOUBLE), floor(tokens)) AS rest, cap FROM ranked r JOIN walk w ON w.tenant_id = r.tenant_id AND w.sec = r.sec)
      SELECT event_id, tenant_id, allowed, CAST(floor(rest) AS BIGINT) AS remaining, CASE WHEN allowed THEN 0 ELSE CAST(ceil((1e0 - rest) / (cap / 60e0)) AS BIGINT) END AS retry_after FROM j""",
    "quota_usage": """SELECT u.tenant_id, minute, used, quota, greatest(0, quota - used) AS remaining, used > quota AS over FROM (SELECT tenant_id, date_trunc('minute', event_time) AS minute, count(*) AS used FROM tel GROUP BY ALL) u
      JOIN (SELECT tenant_id, CAST(CASE tier WHEN 'Pro' THEN 2 ELSE 1 END AS BIGINT) AS quota FROM tenants) t ON u.tenant_id = t.tenant_id""",
    "sliding_rate": "SELECT event_id, n60, n60 > 1 AS over FROM (SELECT event_id, count(*) OVER (PARTITION BY tenant_id ORDER BY event_time RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW) AS n60 FROM tel) x",
    "ingest_health": f"""WITH {DLQ}, v AS (SELECT 'freshness_lag_s' AS "check", CAST((epoch_us(TIMESTAMP '{NOW}') - epoch_us(max(event_time))) // 1000000 AS DOUBLE) AS value, 60 AS b FROM tel WHERE event_time <= TIMESTAMP '{NOW}'
       UNION ALL SELECT 'dlq_share', CAST((SELECT count(*) FROM dlq) AS DOUBLE) / (SELECT count(*) FROM tel), 0.1 UNION ALL SELECT 'dlq_depth', CAST((SELECT count(*) FROM dlq) AS DOUBLE), 100
       UNION ALL SELECT 'model_age_s', CAST((epoch_us(TIMESTAMP '{NOW}') - epoch_us((SELECT min(t) FROM (SELECT max(trained_at) AS t FROM ({TRAINED}) z WHERE trained_at <= TIMESTAMP '{NOW}' GROUP BY model_type) y))) // 1000000 AS DOUBLE), 259200) SELECT "check", value, CASE WHEN value <= b THEN 'ok' ELSE 'degraded' END AS state FROM v""",
    "visible_rows": f"SELECT *, tenant_id = 't1' AND NOT is_platform AS can_write FROM ({STATUS_PAGES}) p WHERE is_published OR is_platform OR tenant_id = 't1'",
    "entitled_rows": f"SELECT r.*, EXISTS (SELECT 1 FROM ({PROFILES}) p WHERE p.account_id = r.account_id AND tier = 'Pro' AND subscription_active) AS entitled FROM ({REQUESTS}) r",
    "reconcile_subscriptions": """SELECT account_id, coalesce(l.remote_id, r.remote_id) AS remote_id, tier, status, CASE WHEN account_id IS NULL THEN 'orphan_remote' WHEN l.remote_id IS NULL AND tier = 'Pro' THEN 'manual_grant' WHEN r.remote_id IS NULL THEN 'keep'
      WHEN status = 'active' AND tier <> 'Pro' THEN 'upgrade' WHEN status <> 'active' AND tier = 'Pro' THEN 'downgrade' ELSE 'keep' END AS action FROM billing_local l FULL OUTER JOIN billing_remote r ON l.remote_id = r.remote_id""",
    "unload_recent": f"""WITH {ROLLUP}, r AS (SELECT * FROM roll WHERE hour >= TIMESTAMP '2024-01-30' - INTERVAL 1 DAY)
      SELECT tenant_id, 'avg_latency' AS metric_name, avg_latency AS metric_value, hour AS recorded_at FROM r UNION ALL SELECT tenant_id, 'requests', requests, hour FROM r UNION ALL SELECT tenant_id, 'errors', errors, hour FROM r""",
}
ORACLES = {k: with_views(v) for k, v in ORACLES.items()}
ORACLES["token_bucket_audit"] = ORACLES["token_bucket_audit"].replace("WITH ", "WITH RECURSIVE ", 1)
