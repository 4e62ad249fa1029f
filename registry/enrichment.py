"""Registered queries and oracles: enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from optelem.fixtures import query, table, view, with_views
from optelem.operators import enrich


def enriched(spark, d):
    """tel with user agent, network and country columns."""
    return enrich.network_class(enrich.geo_asn(enrich.parse_user_agent(view(spark, d, "tel")), view(spark, d, "geo_blocks")))


TARGETS = """SELECT page_id, CASE page_id % 9 WHEN 0 THEN 'http://10.0.0.5/admin' WHEN 1 THEN 'http://user:pw@site.example.com/' WHEN 2 THEN 'http://169.254.169.254/latest'
 WHEN 3 THEN 'ftp://files.example.com/a' WHEN 4 THEN 'http://127.0.0.1:8080/x' ELSE url END AS url FROM pages"""
PRODUCTS = "SELECT DISTINCT lower(concat(p_name, ' ', p_type, ' ', p_brand)) AS name FROM part"
DICTIONARY = "SELECT DISTINCT lower(CASE WHEN p_size < 10 THEN concat(p_name, ' ', p_type, ' ', p_brand) ELSE concat(p_type, ' pro ', p_name) END) AS name FROM part"


def _approved(spark, d):
    return table(spark, d, "pages").where("url LIKE 'https:%'").select(enrich.url_host("url").alias("host"))


def _inventory(spark, d):
    return enrich.tech_inventory(enrich.tech_evidence(view(spark, d, "tech_obs")))


def findings(spark, d):
    return enrich.match_vulnerabilities(_inventory(spark, d), view(spark, d, "vuln_feed"))


QUERIES = {
    "parse_user_agent": lambda s, d: enrich.parse_user_agent(view(s, d, "tel")).select("event_id", "device_type", "os_name", "browser_name", "is_bot"),
    "geo_asn": lambda s, d: enrich.geo_asn(view(s, d, "tel"), view(s, d, "geo_blocks")).select("event_id", "client_ip", "country", "asn", "kind"),
    "network_class": lambda s, d: enriched(s, d).select("event_id", "network_class"),
    "human_traffic": lambda s, d: enrich.human_traffic(enriched(s, d)).select("event_id", "tenant_id"),
    "sessionise": lambda s, d: enrich.sessionise(view(s, d, "tel")),
    "behaviour_flags": lambda s, d: enrich.behaviour_flags(view(s, d, "tel"), max_regularity=0.9, min_interaction=0.3),
    "complaint_entities": lambda s, d: enrich.complaint_entities(view(s, d, "complaints")).select("complaint_id", "intent", "error_code", "browser", "feature"),
    "complaint_root_cause": lambda s, d: enrich.complaint_root_cause(view(s, d, "complaints"), view(s, d, "tel"), 720),
    "safe_targets": lambda s, d: enrich.safe_targets(query(s, d, TARGETS), _approved(s, d)),
    "tech_inventory": lambda s, d: _inventory(s, d),
    "cpe_candidates": lambda s, d: enrich.cpe_candidates(query(s, d, PRODUCTS), query(s, d, DICTIONARY)),
    "match_vulnerabilities": lambda s, d: findings(s, d),
}

UA = """CASE WHEN regexp_matches(user_agent, '(?i)bot|crawler|spider|curl/|python-requests') THEN 'Bot' WHEN regexp_matches(user_agent, 'iPad|Tablet') THEN 'Tablet'
 WHEN regexp_matches(user_agent, 'iPhone|Mobile|Android') THEN 'Mobile' ELSE 'Desktop' END AS device_type,
 CASE WHEN user_agent LIKE '%Windows NT%' THEN 'Windows' WHEN regexp_matches(user_agent, 'iPhone OS|CPU OS') THEN 'iOS' WHEN user_agent LIKE '%Android%' THEN 'Android'
 WHEN user_agent LIKE '%Mac OS X%' THEN 'macOS' WHEN user_agent LIKE '%Linux%' THEN 'Linux' ELSE 'Other' END AS os_name,
 CASE WHEN user_agent LIKE '%Edg/%' THEN 'Edge' WHEN user_agent LIKE '%Chrome/%' THEN 'Chrome' WHEN user_agent LIKE '%Firefox/%' THEN 'Firefox' WHEN user_agent LIKE '%Safari/%' THEN 'Safari' ELSE 'Other' END AS browser_name"""
IP = "split_part(client_ip, '.', 1)::BIGINT * 16777216 + split_part(client_ip, '.', 2)::BIGINT * 65536 + split_part(client_ip, '.', 3)::BIGINT * 256 + split_part(client_ip, '.', 4)::BIGINT"
# tel with the columns of `enriched`, as a chain of CTEs named `enr`
ENR = f"""ua AS (SELECT *, {UA}, {IP} AS ip FROM tel),
 enr AS (SELECT ua.*, device_type = 'Bot' AS is_bot, country, asn, kind, CASE WHEN kind IN ('datacenter', 'residential') THEN kind ELSE 'other' END AS network_class
  FROM ua LEFT JOIN geo_blocks ON ip BETWEEN ip_first AND ip_last),
 human AS (SELECT * FROM enr WHERE NOT is_bot AND NOT (network_class = 'datacenter' AND (os_name IN ('Linux', 'Other') OR browser_name = 'Other')))"""
INVENTORY = """inv AS (SELECT tenant_id, trim(regexp_replace(lower(trim(tech_name)), '[^a-z0-9.+#]+', ' ', 'g')) AS tech_name, version, count(DISTINCT site_id) AS sites,
 max(confidence) AS confidence, min(seen_at) AS first_seen, max(seen_at) AS last_seen FROM tech_obs GROUP BY ALL)"""
FINDINGS = INVENTORY + """, findings AS (SELECT tenant_id, inv.tech_name AS product, version, cve_id, cvss FROM inv JOIN vuln_feed v ON inv.tech_name = v.product
 AND CAST(split_part(version, '.', 1) AS INTEGER) BETWEEN major_from AND major_to)"""
URL_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)', 1))"

ORACLES = {
    "parse_user_agent": f"SELECT event_id, device_type, os_name, browser_name, device_type = 'Bot' AS is_bot FROM (SELECT event_id, {UA} FROM tel) x",
    "geo_asn": f"SELECT event_id, client_ip, country, asn, kind FROM (SELECT *, {IP} AS ip FROM tel) t LEFT JOIN geo_blocks ON ip BETWEEN ip_first AND ip_last",
    "network_class": f"WITH {ENR} SELECT event_id, network_class FROM enr",
    "human_traffic": f"WITH {ENR} SELECT event_id, tenant_id FROM human",
    "sessionise": """WITH marked AS (SELECT *, CASE WHEN event_time <= lag(event_time) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM tel WINDOW w AS (PARTITION BY user_id ORDER BY event_time, event_id)),
      numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY event_time, event_id) AS sno FROM marked)
      SELECT user_id, min(event_time) AS started_at, max(event_time) AS ended_at, (epoch_us(max(event_time)) - epoch_us(min(event_time))) // 1000000 AS duration_s, count(*) AS events FROM numbered GROUP BY user_id, sno""",
    "behaviour_flags": """WITH gaps AS (SELECT *, (epoch_us(event_time) - lag(epoch_us(event_time)) OVER (PARTITION BY user_id ORDER BY event_time, event_id)) / 1e6 AS gap FROM tel),
      u AS (SELECT user_id, count(*) AS events, round(stddev_samp(gap) / avg(gap), 6) AS gap_cv, CAST(count(CASE WHEN event_type IN ('click', 'view') THEN 1 END) AS DOUBLE) / count(*) AS interaction_share FROM gaps GROUP BY user_id)
      SELECT *, events >= 10 AND (gap_cv < 0.9 OR interaction_share < 0.3) AS is_automated FROM u""",
    "complaint_entities": """SELECT complaint_id, 'not_loading' AS intent, CAST(regexp_extract(text, 'error ([0-9]+)', 1) AS INTEGER) AS error_code,
      CASE WHEN text LIKE '%Chrome%' THEN 'Chrome' ELSE 'Firefox' END AS browser, regexp_extract(text, '(svc[0-9]+)', 1) AS feature FROM complaints""",
    "complaint_root_cause": """WITH hits AS (SELECT complaint_id, service_id, status_code, count(*) AS n FROM complaints c JOIN tel t ON c.tenant_id = t.tenant_id AND t.status_code >= 500
       AND date_trunc('minute', event_time) BETWEEN date_trunc('minute', filed_at) - INTERVAL 12 HOUR AND date_trunc('minute', filed_at) + INTERVAL 12 HOUR GROUP BY ALL),
      best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY complaint_id ORDER BY n DESC, service_id, status_code) AS rn FROM hits) x WHERE rn = 1),
      res AS (SELECT c.complaint_id, c.tenant_id, coalesce(service_id || ':' || status_code, 'unknown') AS cause, coalesce(n, 0) AS hits,
       CASE WHEN n >= 5 THEN 'high' WHEN n >= 2 THEN 'medium' WHEN n = 1 THEN 'low' ELSE 'none' END AS severity FROM complaints c LEFT JOIN best b ON c.complaint_id = b.complaint_id)
      SELECT *, json_object('complaint_id', complaint_id, 'tenant_id', tenant_id, 'cause', cause, 'severity', severity)::VARCHAR AS record FROM res""",
    "safe_targets": f"""SELECT page_id, url, CASE WHEN page_id % 9 = 0 THEN 'private' WHEN page_id % 9 = 1 THEN 'credentials' WHEN page_id % 9 = 2 THEN 'metadata_service' WHEN page_id % 9 = 3 THEN 'not_web' WHEN page_id % 9 = 4 THEN 'loopback'
      WHEN {URL_HOST} NOT IN (SELECT {URL_HOST} FROM pages WHERE url LIKE 'https:%') THEN 'off_domain' END AS reason FROM ({TARGETS}) t""",
    "tech_inventory": f"WITH {INVENTORY} SELECT * FROM inv",
    "cpe_candidates": f"""WITH p AS (SELECT name AS product, list_distinct(regexp_split_to_array(name, '[^a-z0-9]+')) AS pt FROM ({PRODUCTS}) x), d AS (SELECT name AS entry, list_distinct(regexp_split_to_array(name, '[^a-z0-9]+')) AS dt FROM ({DICTIONARY}) y),
      scored AS (SELECT product, entry, CAST(len(list_intersect(pt, dt)) AS DOUBLE) / (len(pt) + len(dt) - len(list_intersect(pt, dt))) AS similarity, product = entry AS same FROM p JOIN d ON list_has_any(pt, dt)),
      best AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY same DESC, similarity DESC, entry) AS rn FROM scored WHERE similarity >= 0.5)
      SELECT product, 'cpe:2.3:a:*:' || regexp_replace(entry, '[^a-z0-9]+', '_', 'g') || ':*:*:*:*:*:*:*:*' AS cpe, CASE WHEN same THEN 'exact' ELSE 'tokens' END AS match_kind, similarity FROM best WHERE rn = 1""",
    "match_vulnerabilities": f"WITH {FINDINGS} SELECT * FROM findings",
}
ORACLES = {k: with_views(v) for k, v in ORACLES.items()}
