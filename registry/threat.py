"""Registered queries and oracles: threat intelligence, signals, findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from optelem.fixtures import query, table, view, with_views
from optelem.operators import threat
from registry.enrichment import ENR, FINDINGS, enriched, findings

AS_OF = "2024-01-31 00:00:00"
LIFE_HOURS = 20 * 24
CREATED = "2024-01-31T00:00:00.000Z"
NET_FEED = "SELECT CAST(asn AS STRING) AS indicator, 'asn' AS kind, 'feed_net' AS feed, 40 AS abuse_score, CAST('2024-01-20 00:00:00' AS TIMESTAMP) AS listed_at FROM geo_blocks WHERE asn % 11 = 0"
SCORES = "SELECT event_id, tenant_id, k / 100e0 AS score FROM tel"
SIGNALS = """SELECT event_id, tenant_id, event_time, CASE k % 9 WHEN 0 THEN 'indicator' WHEN 1 THEN 'automation' WHEN 2 THEN 'anonymiser' WHEN 3 THEN 'breached_credential'
 WHEN 4 THEN 'brand_mention' WHEN 5 THEN 'volumetric_scrape' WHEN 6 THEN 'cross_tenant_read' ELSE 'noise' END AS signal FROM tel"""


def _net_feed(spark, d):
    rows = query(spark, d, NET_FEED)
    return rows.withColumn("listed_at", F.col("listed_at").cast("timestamp_ntz"))


def indicators(spark, d):
    feed = view(spark, d, "ioc_feed")
    return threat.merge_feeds(feed.where("feed = 'feed_a'"), feed.where("feed = 'feed_b'"), _net_feed(spark, d), as_of=AS_OF, life_hours=LIFE_HOURS)


def flagged(spark, d):
    """tel with network columns, abuse_score and is_malicious."""
    return threat.match_indicators(enriched(spark, d), indicators(spark, d))


def _signals(spark, d):
    return query(spark, d, SIGNALS)


def _flagged_listings(spark, d):
    return (view(spark, d, "tel").select("client_ip", "tenant_id").distinct()
            .join(indicators(spark, d).where("kind = 'ipv4'").select(F.col("indicator").alias("client_ip")), "client_ip", "left_semi")
            .withColumnRenamed("client_ip", "indicator"))


def _stix_objects(spark, d):
    return threat.stix_objects(findings(spark, d), _flagged_listings(spark, d), CREATED)


def _bundled(spark, d):
    """Per tenant the objects in its bundles, found again in the JSON, and whether all bundles are of their type."""
    pages = threat.stix_bundle(_stix_objects(spark, d))
    inside = F.from_json("bundle_json", "type string, id string, objects array<struct<type: string, id: string>>")
    parsed = pages.select("tenant_id", "n_objects", inside.alias("b"))
    return parsed.groupBy("tenant_id").agg(F.sum("n_objects").alias("objects"), F.sum(F.size("b.objects")).cast("long").alias("found"),
                                           F.bool_and((F.col("b.type") == "bundle") & F.col("b.id").startswith("bundle--")).alias("sound"))


def _active(spark, d):
    return flagged(spark, d).where("abuse_score >= 99").select("tenant_id")


QUERIES = {
    "merge_feeds": indicators,
    "match_indicators": lambda s, d: flagged(s, d).select("event_id", "abuse_score", "is_malicious"),
    "block_list_as_of": lambda s, d: threat.block_list_as_of(view(s, d, "tel"), view(s, d, "ioc_feed")).select("event_id", "client_ip", "blocked"),
    "trace_back": lambda s, d: threat.trace_back(view(s, d, "tel"), view(s, d, "ioc_feed")),
    "tag_stride": lambda s, d: threat.tag_stride(_signals(s, d)).select("event_id", "signal", "category", "category_name", "response"),
    "stride_trend": lambda s, d: threat.stride_trend(threat.tag_stride(_signals(s, d))),
    "breach_match": lambda s, d: threat.breach_match(view(s, d, "accounts"), view(s, d, "breaches")),
    "brand_mentions": lambda s, d: threat.brand_mentions(table(s, d, "documents"), view(s, d, "brand_terms")),
    "traffic_spikes": lambda s, d: threat.traffic_spikes(enriched(s, d)),
    "global_baseline": lambda s, d: threat.global_baseline(flagged(s, d), AS_OF, by="network_class").unionByName(threat.global_baseline(flagged(s, d), AS_OF)),
    "tenant_vs_global": lambda s, d: threat.tenant_vs_global(flagged(s, d), threat.global_baseline(flagged(s, d), AS_OF)),
    "cross_tenant_attempts": lambda s, d: threat.cross_tenant_attempts(view(s, d, "audit_log")),
    "siem_signals": lambda s, d: threat.siem_signals(view(s, d, "tel")),
    "siem_cases": lambda s, d: threat.siem_cases(threat.siem_signals(view(s, d, "tel")), 24, AS_OF),
    "audit_summary": lambda s, d: threat.audit_summary(view(s, d, "audit_log")),
    "response_actions": lambda s, d: threat.response_actions(query(s, d, SCORES)),
    "playbook_runs": lambda s, d: threat.playbook_runs(view(s, d, "playbook_actions")),
    "playbook_timeline": lambda s, d: threat.playbook_timeline(view(s, d, "playbook_actions")).select("run_id", "seq", "action_id", "attempts", "state", "retry_eligible", "next_retry_at"),
    "triage_board": lambda s, d: threat.triage_board(findings(s, d), _active(s, d)),
    "stix_objects": _stix_objects,
    "stix_bundle": _bundled,
}

IND = f"""feeds AS (SELECT * FROM ioc_feed UNION ALL {NET_FEED}),
 ind AS (SELECT kind, indicator, feed, abuse_score, listed_at FROM (SELECT *, row_number() OVER (PARTITION BY kind, indicator ORDER BY listed_at DESC, feed DESC, abuse_score DESC) AS rn
  FROM feeds WHERE listed_at <= TIMESTAMP '{AS_OF}') x WHERE rn = 1 AND listed_at > TIMESTAMP '{AS_OF}' - INTERVAL {LIFE_HOURS} HOUR)"""
FLAGGED = f"""{ENR}, {IND}, fl AS (SELECT enr.*, coalesce(greatest(i.abuse_score, a.abuse_score), 0) AS abuse_score, coalesce(greatest(i.abuse_score, a.abuse_score) >= 25, false) AS is_malicious
 FROM enr LEFT JOIN ind i ON i.kind = 'ipv4' AND i.indicator = client_ip LEFT JOIN ind a ON a.kind = 'asn' AND a.indicator = CAST(asn AS STRING))"""
CATS = "cats(signal, category, category_name, response) AS (VALUES " + ", ".join(
    f"('{k}', '{c}', '{threat.CATEGORY_NAMES[c]}', '{threat.SIGNAL_RESPONSES[k]}')" for k, cs in threat.SIGNAL_CATEGORIES.items() for c in cs) + ")"
SIEM = """sig AS (
 SELECT 'error_burst' AS rule, tenant_id, service_id AS entity, date_trunc('hour', event_time) AS window_start, date_trunc('hour', event_time) + INTERVAL 1 HOUR AS window_end, count(*) AS n FROM tel WHERE status_code >= 500 GROUP BY ALL HAVING count(*) >= 5
 UNION ALL SELECT 'credential_stuffing', tenant_id, client_ip, date_trunc('day', event_time), date_trunc('day', event_time) + INTERVAL 1 DAY, count(*) FROM tel WHERE event_type = 'signup' GROUP BY ALL HAVING count(*) >= 2
 UNION ALL SELECT 'volumetric_scrape', tenant_id, CAST(user_id AS STRING), ws, ws + INTERVAL 2 HOUR, count(*) FROM (SELECT *, time_bucket(INTERVAL 30 MINUTE, event_time) - INTERVAL 30 MINUTE * i AS ws FROM tel, range(4) r(i) WHERE event_type IN ('view', 'click')) y GROUP BY ALL HAVING count(*) >= 3)"""
GRAMS = """toks AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS w, generate_subscripts(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), 1) AS i FROM documents) a WHERE w <> ''),
 led AS (SELECT doc_id, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4, lead(w, 4) OVER o AS w5 FROM toks WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
 grams AS (SELECT doc_id, w AS term FROM led UNION ALL SELECT doc_id, w || ' ' || w2 FROM led UNION ALL SELECT doc_id, w || ' ' || w2 || ' ' || w3 FROM led UNION ALL SELECT doc_id, w || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM led UNION ALL SELECT doc_id, w || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5 FROM led),
 wanted AS (SELECT DISTINCT trim(regexp_replace(lower(term), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS term FROM brand_terms)"""


def _stix_id(kind: str, *parts: str) -> str:
    h = f"sha256(concat_ws('|', '{kind}', {', '.join(parts)}))"
    return f"'{kind}--' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-8' || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"


def _stix_select(kind: str, ident: str, fields: str, source: str) -> str:
    return f"""SELECT tenant_id, {ident} AS object_id, json_object('type', '{kind}', 'spec_version', '2.1', 'id', {ident}, 'created', '{CREATED}', 'modified', '{CREATED}', {fields})::VARCHAR AS object_json FROM {source}"""


STIX = " UNION ALL ".join([
    _stix_select("identity", _stix_id("identity", "tenant_id"), "'name', tenant_id, 'identity_class', 'organization'",
                 "(SELECT tenant_id FROM findings UNION SELECT tenant_id FROM flagged) a"),
    _stix_select("indicator", _stix_id("indicator", "tenant_id", "indicator"),
                 f"'pattern', '[ipv4-addr:value = ' || chr(39) || indicator || chr(39) || ']', 'pattern_type', 'stix', 'valid_from', '{CREATED}'", "flagged"),
    _stix_select("observed-data", _stix_id("observed-data", "tenant_id", "product", "version"),
                 f"""'number_observed', 1, 'first_observed', '{CREATED}', 'last_observed', '{CREATED}', 'object_refs', json_array({_stix_id("software", "product", "version")})""",
                 "(SELECT DISTINCT tenant_id, product, version FROM findings) b"),
])
RUNS = """tl AS (SELECT *, state = 'failed' AND attempts < 3 AS retry_eligible, CASE WHEN state = 'failed' AND attempts < 3 THEN updated_at + to_seconds(30 * CAST(pow(2, attempts) AS BIGINT)) END AS next_retry_at FROM playbook_actions)"""

ORACLES = {
    "merge_feeds": f"WITH {IND} SELECT * FROM ind",
    "match_indicators": f"WITH {FLAGGED} SELECT event_id, abuse_score, is_malicious FROM fl",
    "block_list_as_of": "SELECT event_id, client_ip, EXISTS (SELECT 1 FROM ioc_feed i WHERE i.indicator = t.client_ip AND t.event_time >= i.listed_at AND t.event_time < i.listed_at + INTERVAL 24 HOUR) AS blocked FROM tel t",
    "trace_back": """SELECT client_ip, tenant_id, service_id, count(*) AS hits, min(event_time) AS first_at, max(event_time) AS last_at FROM tel JOIN (SELECT indicator, min(listed_at) AS listed_at FROM ioc_feed GROUP BY indicator) f
      ON f.indicator = client_ip AND event_time < f.listed_at GROUP BY ALL""",
    "tag_stride": f"WITH {CATS} SELECT event_id, s.signal, category, category_name, response FROM ({SIGNALS}) s JOIN cats ON s.signal = cats.signal",
    "stride_trend": f"""WITH {CATS}, h AS (SELECT tenant_id, category, date_trunc('hour', event_time) AS hour, count(*) AS n FROM ({SIGNALS}) s JOIN cats ON s.signal = cats.signal GROUP BY ALL)
      SELECT h.tenant_id, h.category, h.hour, h.n, h.n - coalesce(p.n, 0) AS delta FROM h LEFT JOIN h p ON p.tenant_id = h.tenant_id AND p.category = h.category AND p.hour = h.hour - INTERVAL 1 HOUR""",
    "breach_match": "SELECT account_id, tenant_id, sha256(lower(trim(email))) AS email_hash FROM accounts WHERE lower(trim(email)) IN (SELECT lower(trim(email)) FROM breaches)",
    "brand_mentions": f"WITH {GRAMS} SELECT doc_id, g.term, count(*) AS n FROM grams g JOIN wanted w ON g.term = w.term GROUP BY ALL",
    "traffic_spikes": f"""WITH {ENR}, h AS (SELECT asn, date_trunc('hour', event_time) AS hour, count(*) AS n FROM enr WHERE asn IS NOT NULL GROUP BY ALL),
      s AS (SELECT *, count(*) OVER w AS k, avg(n) OVER w AS m, stddev_samp(n) OVER w AS sd FROM h WINDOW w AS (PARTITION BY asn ORDER BY hour ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))
      SELECT asn, hour, n, round(CASE WHEN k >= 6 THEN (n - m) / nullif(sd, 0) END, 6) AS z, coalesce(CASE WHEN k >= 6 THEN (n - m) / nullif(sd, 0) END > 3, false) AS is_spike FROM s""",
    "global_baseline": f"""WITH {FLAGGED}, recent AS (SELECT * FROM fl WHERE event_time <= TIMESTAMP '{AS_OF}' AND event_time > TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY),
      g AS (SELECT network_class AS segment, * FROM recent UNION ALL SELECT 'all', * FROM recent)
      SELECT segment, count(DISTINCT tenant_id) AS n_tenants, CAST(count(CASE WHEN status_code >= 500 THEN 1 END) AS DOUBLE) / count(*) AS failure_rate, CAST(count(CASE WHEN is_malicious THEN 1 END) AS DOUBLE) / count(*) AS suspicious_ratio
      FROM g GROUP BY segment HAVING count(DISTINCT tenant_id) >= 5""",
    "tenant_vs_global": f"""WITH {FLAGGED}, b AS (SELECT CAST(count(CASE WHEN status_code >= 500 THEN 1 END) AS DOUBLE) / count(*) AS f, CAST(count(CASE WHEN is_malicious THEN 1 END) AS DOUBLE) / count(*) AS m FROM fl),
      pl AS (SELECT tenant_id, country, count(*) AS n, count(CASE WHEN status_code >= 500 THEN 1 END) AS f, count(CASE WHEN is_malicious THEN 1 END) AS m FROM fl GROUP BY ALL),
      t AS (SELECT tenant_id, CAST(sum(n) AS BIGINT) AS requests, CAST(sum(f) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS failure_rate, CAST(sum(m) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS suspicious_ratio, CAST(max(n) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS top_location_weight FROM pl GROUP BY tenant_id)
      SELECT t.*, CASE WHEN requests < 100 THEN 'zero' WHEN suspicious_ratio > b.m AND failure_rate > b.f THEN 'high' WHEN suspicious_ratio > b.m OR failure_rate > b.f THEN 'elevated' ELSE 'normal' END AS level FROM t, b""",
    "cross_tenant_attempts": """SELECT actor, actor_tenant, target_tenant, count(*) AS n, count(CASE WHEN outcome = 'ok' THEN 1 END) AS succeeded, min("at") AS first_at, max("at") AS last_at,
      CASE WHEN count(CASE WHEN outcome = 'ok' THEN 1 END) > 0 THEN 'critical' ELSE 'high' END AS severity FROM audit_log WHERE actor_tenant <> target_tenant GROUP BY ALL""",
    "siem_signals": f"WITH {SIEM} SELECT * FROM sig",
    "siem_cases": f"""WITH {SIEM}, m AS (SELECT *, CASE WHEN window_start <= max(window_end) OVER (PARTITION BY tenant_id, entity ORDER BY window_start, window_end, rule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + INTERVAL 24 HOUR THEN 0 ELSE 1 END AS o FROM sig),
      c AS (SELECT *, sum(o) OVER (PARTITION BY tenant_id, entity ORDER BY window_start, window_end, rule ROWS UNBOUNDED PRECEDING) AS cn FROM m),
      g AS (SELECT tenant_id, entity, array_to_string(list_sort(list(DISTINCT rule)), ',') AS rules, count(*) AS signals, min(window_start) AS started_at, max(window_end) AS last_seen_at FROM c GROUP BY tenant_id, entity, cn)
      SELECT *, sha256(concat_ws('|', tenant_id, entity, strftime(started_at, '%Y%m%d%H%M%S'))) AS case_id, CASE WHEN contains(rules, ',') THEN 'high' WHEN signals > 1 THEN 'medium' ELSE 'low' END AS severity, CASE WHEN last_seen_at + INTERVAL 24 HOUR < TIMESTAMP '{AS_OF}' THEN 'closed' ELSE 'open' END AS state FROM g""",
    "audit_summary": "SELECT actor_tenant, actor, action, outcome, count(*) AS n, CAST(grouping(actor_tenant, actor, action, outcome) AS INTEGER) AS level FROM audit_log GROUP BY ROLLUP (actor_tenant, actor, action, outcome)",
    "response_actions": f"SELECT event_id, tenant_id, score, CASE WHEN score < 0.5 THEN 'allow' WHEN score < 0.7 THEN 'throttle' WHEN score < 0.9 THEN 'challenge' ELSE 'block' END AS action, score >= 0.7 AS in_review FROM ({SCORES}) s",
    "playbook_timeline": f"WITH {RUNS} SELECT run_id, CAST(seq AS INTEGER) AS seq, action_id, attempts, state, retry_eligible, next_retry_at FROM tl",
    "playbook_runs": f"""WITH {RUNS}, r AS (SELECT run_id, count(*) AS actions, count(CASE WHEN state = 'succeeded' THEN 1 END) AS succeeded, count(CASE WHEN state = 'failed' THEN 1 END) AS failed,
       count(CASE WHEN retry_eligible THEN 1 END) AS retry_eligible, min(next_retry_at) AS next_retry_at, max_by(state, seq) AS last_state FROM tl GROUP BY run_id)
      SELECT *, CASE WHEN succeeded = actions THEN 'succeeded' WHEN retry_eligible > 0 THEN 'retrying' WHEN actions - succeeded - failed > 0 THEN 'waiting' ELSE 'failed' END AS run_state FROM r""",
    "stix_objects": f"""WITH {FINDINGS}, {IND}, flagged AS (SELECT DISTINCT tenant_id, client_ip AS indicator FROM tel WHERE client_ip IN (SELECT indicator FROM ind WHERE kind = 'ipv4')) {STIX}""",
    "triage_board": f"""WITH {FLAGGED}, {FINDINGS}, act AS (SELECT DISTINCT tenant_id FROM fl WHERE abuse_score >= 99),
      sc AS (SELECT f.*, a.tenant_id IS NOT NULL AS has_active_intel, CAST(greatest(1, least(5, ceil(cvss / 2))) AS INTEGER) * (2 + 3 * CAST(a.tenant_id IS NOT NULL AS INTEGER)) AS priority FROM findings f LEFT JOIN act a ON f.tenant_id = a.tenant_id)
      SELECT *, CAST(dense_rank() OVER (PARTITION BY tenant_id ORDER BY priority DESC, cvss DESC, cve_id) AS INTEGER) AS rank, CASE WHEN priority >= 20 THEN 'now' WHEN priority >= 8 THEN 'next' ELSE 'backlog' END AS "column" FROM sc""",
}
ORACLES["stix_bundle"] = f"SELECT tenant_id, count(*) AS objects, count(*) AS found, true AS sound FROM ({ORACLES['stix_objects']}) s GROUP BY tenant_id"
ORACLES = {k: with_views(v) for k, v in ORACLES.items()}
