"""Views that reshape the driver tables into telemetry schemas; the same text runs in Spark and in the check oracles."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS: dict[str, str] = {
    "tel": """
SELECT event_id, CAST(regexp_extract(props,'[0-9]+',0) AS INT) AS k, concat('t', CAST(user_id % 8 AS STRING)) AS tenant_id,
 concat('svc', CAST(CAST(regexp_extract(props,'[0-9]+',0) AS INT) % 5 AS STRING)) AS service_id, user_id, ts AS event_time, event_type, value AS latency_ms,
 CASE WHEN event_type='error' THEN 500 + CAST(regexp_extract(props,'[0-9]+',0) AS INT) % 4 WHEN CAST(regexp_extract(props,'[0-9]+',0) AS INT) % 10 = 3 THEN 404 ELSE 200 END AS status_code,
 concat(CAST(10 + user_id % 6 AS STRING),'.',CAST(CAST(regexp_extract(props,'[0-9]+',0) AS INT) % 16 AS STRING),'.',CAST(user_id % 256 AS STRING),'.',regexp_extract(props,'[0-9]+',0)) AS client_ip,
 CASE user_id % 6 WHEN 0 THEN 'Mozilla/5.0 (Windows NT 10.0; Win64; x64) Chrome/126.0 Safari/537.36' WHEN 1 THEN 'Mozilla/5.0 (iPhone; CPU iPhone OS 17_5 like Mac OS X) Version/17.5 Mobile/15E148 Safari/604.1' WHEN 2 THEN 'Mozilla/5.0 (iPad; CPU OS 16_6 like Mac OS X) Version/16.6 Safari/604.1' WHEN 3 THEN 'Mozilla/5.0 (X11; Linux x86_64; rv:127.0) Gecko/20100101 Firefox/127.0' WHEN 4 THEN 'Googlebot/2.1 (+http://www.google.com/bot.html)' ELSE 'Mozilla/5.0 (Linux; Android 14; Pixel 8) Chrome/126.0 Mobile Safari/537.36' END AS user_agent,
 concat('app', CAST(user_id % 8 AS STRING), '.example.com') AS host,
 CASE WHEN event_id % 11 = 0 THEN 1 ELSE 2 END AS version,
 md5(concat(CAST(user_id AS STRING),'|',event_type,'|',CAST(event_id AS STRING))) AS idempotency_key FROM events
""",
    "raw_tel": """
SELECT t.*, event_time AS received_at, 1 AS delivery, CASE WHEN event_id % 53 = 0 THEN 't99' ELSE tenant_id END AS claimed_tenant, CASE WHEN event_id % 37 = 0 THEN NULL ELSE latency_ms END AS latency_in FROM tel t
 UNION ALL SELECT t.*, event_time + INTERVAL '5' MINUTE, 2, tenant_id, latency_ms FROM tel t WHERE event_id % 20 = 0
""",
    "odd_tel": """
SELECT event_id, k, CASE WHEN event_id % 23 = 0 THEN NULL ELSE tenant_id END AS tenant_id, CASE WHEN event_id % 19 < 3 THEN NULL ELSE service_id END AS service_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE user_id END AS user_id,
 event_time, event_type, CASE WHEN event_id % 17 = 0 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 31 = 0 THEN NULL ELSE latency_ms END AS latency_ms, status_code, client_ip, user_agent, host, version,
 CASE WHEN event_id % 13 = 0 THEN NULL ELSE idempotency_key END AS idempotency_key, event_time AS received_at, 1 AS delivery FROM tel
""",
    "tenants": """
SELECT concat('t', CAST(n_nationkey AS STRING)) AS tenant_id, concat('app', CAST(n_nationkey AS STRING), '.example.com') AS host, CASE WHEN n_nationkey % 3 = 0 THEN 'Pro' ELSE 'Standard' END AS tier, n_nationkey = 0 AS is_platform, n_nationkey % 2 = 0 AS is_published FROM nation WHERE n_nationkey < 8
""",
    "geo_blocks": """
SELECT n_name AS country, 64500 + n_nationkey AS asn, CASE n_nationkey % 3 WHEN 0 THEN 'datacenter' WHEN 1 THEN 'residential' ELSE 'business' END AS kind,
 CAST(10 + n_nationkey % 6 AS BIGINT) * 16777216 + CAST(floor(n_nationkey / 6) AS BIGINT) * 4 * 65536 AS ip_first,
 CAST(10 + n_nationkey % 6 AS BIGINT) * 16777216 + (CAST(floor(n_nationkey / 6) AS BIGINT) * 4 + 3) * 65536 + 65535 AS ip_last FROM nation WHERE n_nationkey < 24
""",
    "ioc_feed": """
SELECT client_ip AS indicator, 'ipv4' AS kind, CASE WHEN event_id % 2 = 0 THEN 'feed_a' ELSE 'feed_b' END AS feed, k AS abuse_score, event_time + INTERVAL '1' HOUR AS listed_at FROM tel WHERE event_id % 97 = 0
""",
    "consent": """
SELECT user_id, event_time AS decided_at, k % 2 = 0 AS analytical, k % 3 = 0 AS marketing FROM tel WHERE event_type = 'signup'
""",
    "audit_log": """
SELECT event_id AS audit_id, event_time AS at, user_id AS actor, tenant_id AS actor_tenant, concat('t', CAST((user_id + CASE WHEN k = 7 THEN 1 ELSE 0 END) % 8 AS STRING)) AS target_tenant, event_type AS action, CASE WHEN status_code < 400 THEN 'ok' ELSE 'denied' END AS outcome FROM tel WHERE event_type IN ('click','view','error')
""",
    "accounts": """
SELECT c_custkey AS account_id, concat('t', CAST(c_custkey % 8 AS STRING)) AS tenant_id, concat('user', CAST(c_custkey AS STRING), '@example.com') AS email FROM customer
""",
    "breaches": """
SELECT concat('  USER', CAST(c_custkey AS STRING), '@Example.com') AS email, 'dump_1' AS source FROM customer WHERE c_custkey % 13 = 0
""",
    "billing_local": """
SELECT c_custkey AS account_id, CASE WHEN c_custkey % 4 = 0 THEN 'Pro' ELSE 'Standard' END AS tier, CASE WHEN c_custkey % 12 = 0 THEN NULL ELSE concat('cus_', CAST(c_custkey AS STRING)) END AS remote_id FROM customer
""",
    "billing_remote": """
SELECT concat('cus_', CAST(o_custkey AS STRING)) AS remote_id, CASE o_orderstatus WHEN 'F' THEN 'canceled' WHEN 'O' THEN 'active' ELSE 'past_due' END AS status, o_orderdate AS period_end FROM (SELECT o.*, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders o) x WHERE rn = 1
""",
    "playbook_actions": """
SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY updated_at, action_id, hook_id, qty, price) AS seq, action_id, hook_id, CAST(qty AS INT) % 4 AS attempts, state, updated_at
 FROM (SELECT l_orderkey AS run_id, l_partkey AS action_id, l_suppkey AS hook_id, l_quantity AS qty, l_extendedprice AS price,
  CASE l_returnflag WHEN 'A' THEN 'succeeded' WHEN 'R' THEN 'failed' ELSE 'waiting' END AS state, l_shipdate AS updated_at FROM lineitem) x
""",
    "tech_obs": """
SELECT concat('t', CAST(l_suppkey % 8 AS STRING)) AS tenant_id, l_suppkey AS site_id, p_name AS tech_name, concat(CAST(p_size AS STRING),'.',CAST(p_partkey % 10 AS STRING)) AS version, round(l_discount * 10, 2) AS confidence, l_shipdate AS seen_at FROM lineitem JOIN part ON p_partkey = l_partkey
""",
    "vuln_feed": """
SELECT concat('CVE-2024-', CAST(10000 + p_partkey AS STRING)) AS cve_id, p_name AS product, p_size AS major_from, p_size + 5 AS major_to, round(p_size / 5.0, 1) AS cvss FROM part WHERE p_partkey % 7 = 0
""",
    "complaints": """
SELECT event_id AS complaint_id, tenant_id, event_time + INTERVAL '10' MINUTE AS filed_at,
 concat('The ', service_id, ' page would not load, error ', CAST(status_code AS STRING), CASE user_id % 2 WHEN 0 THEN ' in Chrome' ELSE ' in Firefox' END) AS text
 FROM tel WHERE event_type = 'error' AND event_id % 10 = 0
""",
    "brand_terms": """
SELECT item_id, concat(split_part(text,' ',2),' ',split_part(text,' ',3),' ',split_part(text,' ',4),' ',split_part(text,' ',5)) AS term FROM benchmark
""",
    "conv_md": """
SELECT c.conv_id, c.turn, concat('## ', role, ' ', CAST(turn AS STRING), chr(10), chr(10), text) AS md FROM conversations c
""",
}


def _uses(sql: str, names) -> list[str]:
    words = set(re.findall(r"[a-z_]+", sql))
    return [n for n in names if n in words]


def _closure(sql: str) -> list[str]:
    """Views used by `sql`, directly or through other views, in an order that defines before use."""
    found: list[str] = []

    def visit(text: str) -> None:
        for name in _uses(text, VIEWS):
            if name not in found:
                visit(VIEWS[name])
                found.append(name)

    visit(sql)
    return list(dict.fromkeys(found))


def with_views(sql: str) -> str:
    """Prefix an oracle text with the view definitions it uses; `sql` may start with its own CTEs (`WITH ...`)."""
    ctes = [f"{n} AS ({VIEWS[n]})" for n in _closure(sql)]
    sql = sql.strip()
    if not ctes:
        return sql
    if sql.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + sql[15:]
    if sql.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + sql[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view over the tables in `sf_dir`."""
    return query(spark, sf_dir, f"SELECT * FROM {name}")


def query(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run SQL over fixture views and driver tables without registering anything in the session."""
    text = with_views(sql)
    base = [f"{t} AS (SELECT * FROM parquet.`{sf_dir}/{t}.parquet`)" for t in _uses(text, TABLES)]
    if text.upper().startswith("WITH "):
        return spark.sql("WITH " + ",\n".join(base) + ",\n" + text[5:])
    return spark.sql("WITH " + ",\n".join(base) + "\n" + text)
