"""Registered queries and oracles over rows that are out of the ordinary: NULL keys, NaN, repeats, malformed and unusual texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from optelem.fixtures import query, table, view, with_views
from optelem.functions.text import anchor_key
from optelem.operators import docs, enrich, lifecycle, ml, quality, rollups, threat
from registry.enrichment import FINDINGS, findings
from registry.rollups import INCIDENTS

REPEATS = "SELECT * FROM odd_tel UNION ALL SELECT event_id, k, tenant_id, service_id, user_id, event_time, event_type, latency_ms, status_code, client_ip, user_agent, host, version, idempotency_key, event_time + INTERVAL '5' MINUTE AS received_at, 2 AS delivery FROM odd_tel WHERE event_id % 20 = 0"
METADATA = """SELECT event_id, CASE event_id % 8 WHEN 0 THEN '{"k": 1' WHEN 1 THEN '[1, 2]' WHEN 2 THEN 'plain' WHEN 3 THEN NULL WHEN 4 THEN '{}' WHEN 5 THEN '{"k": {"who": 1}}' WHEN 6 THEN '{"who": 1, "k": 2}' ELSE '{"zone": "a"}' END AS metadata FROM tel"""
DOMAINS = "SELECT 'domain' AS kind, CASE r_regionkey WHEN 0 THEN 'app1.example.com' WHEN 1 THEN 'EXAMPLE.com' WHEN 2 THEN 'co.uk' ELSE 'app2.example.com' END AS indicator, CASE r_regionkey WHEN 0 THEN 90 WHEN 1 THEN 30 WHEN 2 THEN 99 ELSE 10 END AS abuse_score FROM region WHERE r_regionkey < 4"
HOSTS = "SELECT event_id, client_ip, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'a.app1.example.com' WHEN 2 THEN 'shop.example.co.uk' WHEN 3 THEN 'example.org' ELSE host END AS host FROM tel"
PAGES = """SELECT page_id, concat('https://site', CAST(page_id % 3 AS STRING), '.example.com/p', CAST(page_id AS STRING)) AS url, concat('<p id="z z">x</p><a href=/gone', CAST(page_id AS STRING), '>a</a><link href="/style.css"><img src=''/i.png''>',
 '<a href="#z%20z">b</a><a href="#none">c</a><a href="/q?a=1&amp;b=2">d</a><a href="p', CAST(page_id AS STRING), '.html">self</a>') AS html FROM pages"""
HEADINGS = "SELECT doc_id, concat('Spark™ ﬁnal Ⅷ №', CAST(doc_id AS STRING), ' ½ Éa ', CASE doc_id % 3 WHEN 0 THEN '㎏' WHEN 1 THEN '&amp;' ELSE 'ß' END) AS text FROM documents"
BODIES = """SELECT doc_id, 1 AS idx, concat('s', CAST(doc_id AS STRING)) AS slug, concat('# Alpha', chr(10), chr(10), '```', chr(10), '## no heading', chr(10), '```', chr(10), 'Big Title', chr(10), '=====', chr(10), chr(10), 'Small', chr(10), '---', chr(10),
 '### Beta ###', chr(10), 'text # no', chr(10), '## Beta', chr(10), '~~~', chr(10), '# open fence ', CAST(doc_id AS STRING)) AS body FROM documents"""
NOTES = "SELECT concat('n', CAST(doc_id AS STRING)) AS id, date_add(DATE '2025-01-01', CAST(doc_id % 7 AS INT)) AS published_at, concat(CASE doc_id % 2 WHEN 0 THEN 'Note ' ELSE 'Part ' END, CAST(doc_id % 3 AS STRING), '.', CAST(doc_id % 23 AS STRING)) AS note, doc_id % 9 = 0 AS draft FROM documents"
TERMS = "SELECT conv_id * 100 + turn AS doc_id, text FROM conversations"


LISTED_TWICE = "SELECT tenant_id, tier FROM tenants UNION ALL SELECT tenant_id, 'Standard' AS tier FROM tenants WHERE tenant_id IN ('t1', 't3') UNION ALL SELECT tenant_id, 'Pro' AS tier FROM tenants WHERE tenant_id = 't4' UNION ALL SELECT 't5' AS tenant_id, NULL AS tier"
ALIKE = "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'a|b' WHEN event_id % 4 = 1 THEN NULL ELSE '~' END AS x, CASE WHEN event_id % 4 = 0 THEN 'c' WHEN event_id % 4 = 1 THEN '' ELSE concat('3:', CAST(event_id AS STRING)) END AS y FROM tel"
NOT_ALIKE = "SELECT event_id, CASE WHEN event_id % 8 = 0 THEN 'a' WHEN event_id % 8 = 4 THEN 'a|b' WHEN event_id % 8 = 1 THEN '~' WHEN event_id % 8 = 5 THEN NULL ELSE '~' END AS x, CASE WHEN event_id % 8 = 0 THEN 'b|c' WHEN event_id % 8 = 4 THEN 'c' WHEN event_id % 4 = 1 THEN '' ELSE concat('3:', CAST(event_id AS STRING)) END AS y FROM tel"


def odd(spark, d):
    return view(spark, d, "odd_tel")


def _limits(spark, d):
    return view(spark, d, "tenants").where("tenant_id <> 't2'").select("tenant_id", F.when(F.col("tier") == "Pro", 6).otherwise(2).alias("capacity"))


def _unscored(spark, d):
    """Findings of which every fourth has no CVSS."""
    found = findings(spark, d)
    return found.withColumn("cvss", F.when(F.col("cve_id").endswith("7") | F.col("cve_id").endswith("2"), F.lit(None)).otherwise(F.col("cvss")))


def _flagged(spark, d):
    rows = query(spark, d, HOSTS).withColumn("asn", F.lit(None).cast("int"))
    return threat.match_indicators(rows, query(spark, d, DOMAINS)).select("event_id", "abuse_score", "is_malicious")


def _due(spark, d):
    due, kept = lifecycle.due_rows(odd(spark, d).withColumn("event_time", F.when(F.col("k") != 7, F.col("event_time"))), "2024-01-20 00:00:00", 5 * 86400, "event_time")
    return due.select("event_id", F.lit(True).alias("archived")).unionByName(kept.select("event_id", F.lit(False).alias("archived")))


QUERIES = {
    "odd_contract": lambda s, d: quality.check_contract(odd(s, d).withColumnRenamed("latency_ms", "latency_in")).select("event_id", "reason"),
    "odd_metadata": lambda s, d: quality.check_metadata(query(s, d, METADATA), ["k", "zone"]).select("event_id", "bad_keys", "reason"),
    "odd_dedupe": lambda s, d: quality.dedupe(query(s, d, REPEATS)).select("event_id", "tenant_id", "idempotency_key", "delivery"),
    "odd_outliers": lambda s, d: quality.quarantine_outliers(odd(s, d), k=0.4).select("event_id", "tenant_id", "service_id", "is_outlier"),
    "odd_consent": lambda s, d: quality.consent_as_of(odd(s, d), view(s, d, "consent")).select("event_id", "consented"),
    "odd_rollup": lambda s, d: rollups.hourly_rollup(odd(s, d)),
    "odd_incidents": lambda s, d: rollups.incident_intervals(odd(s, d)),
    "odd_sliding_rate": lambda s, d: rollups.sliding_rate(odd(s, d), 1, 600).select("event_id", "n60", "over"),
    "odd_token_bucket": lambda s, d: rollups.token_bucket_audit(odd(s, d), _limits(s, d)).select("event_id", "tenant_id", "capacity", "allowed"),
    "odd_limits": lambda s, d: rollups.token_bucket_audit(odd(s, d), query(s, d, LISTED_TWICE).select("tenant_id", F.when(F.col("tier") == "Pro", 6).when(F.col("tier") == "Standard", 2).alias("capacity"))).select("event_id", "tenant_id", "capacity"),
    "odd_quota": lambda s, d: rollups.quota_usage(view(s, d, "tel"), query(s, d, LISTED_TWICE), {"Standard": 1, "Pro": 3}),
    "odd_checksums": lambda s, d: quality.reconcile_checksums(query(s, d, ALIKE), query(s, d, NOT_ALIKE), "event_id", ["x", "y"]),
    "odd_planes": lambda s, d: table(s, d, "documents").select("doc_id", anchor_key(F.concat_ws(" ", F.lit("𝐀lpha 𝟙 🄐"), "lang", "doc_id")).alias("key")),
    "odd_behaviour": lambda s, d: enrich.behaviour_flags(odd(s, d), max_regularity=0.9, min_interaction=0.3),
    "odd_anomaly": lambda s, d: ml.anomaly_scores(rollups.hourly_rollup(odd(s, d).where("latency_ms IS NOT NULL AND NOT isnan(latency_ms)"))),
    "odd_indicators": _flagged,
    "odd_triage": lambda s, d: threat.triage_board(_unscored(s, d), query(s, d, "SELECT tenant_id FROM tenants WHERE tenant_id IN ('t1', 't3')")),
    "odd_archive": _due,
    "odd_links": lambda s, d: docs.link_audit(query(s, d, PAGES)),
    "odd_anchor_keys": lambda s, d: query(s, d, HEADINGS).select("doc_id", anchor_key(F.col("text")).alias("key")),
    "odd_headings": lambda s, d: docs.heading_index(query(s, d, BODIES)),
    "odd_notes": lambda s, d: docs.ordered_notes(query(s, d, NOTES)).select("id", "rank", "prev_id", "next_id"),
    "odd_brand_terms": lambda s, d: threat.brand_mentions(query(s, d, TERMS), table(s, d, "benchmark").select(F.array_join(F.slice(F.split("text", " "), 2, F.col("item_id").cast("int") + 1), " ").alias("term"))),
}

GOOD = "latency_ms IS NOT NULL AND NOT isnan(latency_ms)"
MEAN = f"CAST(sum(CASE WHEN {GOOD} THEN CAST(round(latency_ms * 1000) AS BIGINT) END) AS DOUBLE) / (1e3 * nullif(count(CASE WHEN {GOOD} THEN 1 END), 0))"
ROLL = "SELECT tenant_id, date_trunc('hour', event_time) AS hour, {0} AS avg_latency, count(*) AS requests, count(CASE WHEN status_code >= 500 THEN 1 END) AS errors FROM odd_tel {1} GROUP BY ALL"

ORACLES = {
    "odd_limits": f"""SELECT event_id, o.tenant_id, coalesce(cap, 60) AS capacity FROM odd_tel o LEFT JOIN (SELECT tenant_id, min(CASE tier WHEN 'Pro' THEN 6 WHEN 'Standard' THEN 2 END) AS cap FROM ({LISTED_TWICE}) l GROUP BY tenant_id) m ON m.tenant_id = o.tenant_id""",
    "odd_quota": f"""WITH u AS (SELECT tenant_id, date_trunc('minute', event_time) AS minute, count(*) AS used FROM tel GROUP BY ALL), m AS (SELECT tenant_id, min(CASE tier WHEN 'Pro' THEN 3 ELSE 1 END) AS q FROM ({LISTED_TWICE}) l GROUP BY tenant_id)
      SELECT u.tenant_id, minute, used, CAST(coalesce(q, 1) AS BIGINT) AS quota, CAST(greatest(0, coalesce(q, 1) - used) AS BIGINT) AS remaining, used > coalesce(q, 1) AS over FROM u LEFT JOIN m ON m.tenant_id = u.tenant_id""",
    "odd_planes": "SELECT doc_id, concat_ws('-', 'alpha-1-a', lang, doc_id) AS key FROM documents",
    "odd_checksums": "SELECT event_id AS key, CASE WHEN event_id % 8 IN (0, 1) THEN 'changed' ELSE 'match' END AS verdict FROM tel",
    "odd_contract": """SELECT event_id, CASE WHEN idempotency_key IS NULL THEN 'missing_key' WHEN latency_ms IS NULL THEN 'missing_latency' WHEN isnan(latency_ms) OR NOT latency_ms BETWEEN 0 AND 480 THEN 'latency_out_of_range'
      WHEN NOT status_code BETWEEN 100 AND 599 THEN 'bad_status' WHEN tenant_id IS NULL THEN 'bad_tenant' END AS reason FROM odd_tel""",
    "odd_metadata": "SELECT event_id, CASE WHEN event_id % 8 = 6 THEN 'who' ELSE '' END AS bad_keys, CASE WHEN event_id % 8 < 3 THEN 'metadata_malformed' WHEN event_id % 8 = 6 THEN 'metadata_not_allowed' END AS reason FROM tel",
    "odd_dedupe": f"SELECT event_id, tenant_id, idempotency_key, delivery FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, idempotency_key ORDER BY received_at, delivery, event_id) AS rn FROM ({REPEATS}) r) x WHERE rn = 1 OR idempotency_key IS NULL",
    "odd_outliers": f"""SELECT event_id, t.tenant_id, t.service_id, coalesce(latency_ms < q1 - 0.4e0 * (q3 - q1) OR latency_ms > q3 + 0.4e0 * (q3 - q1), false) AS is_outlier FROM odd_tel t LEFT JOIN
      (SELECT tenant_id, service_id, quantile_cont(CASE WHEN {GOOD} THEN latency_ms END, 0.25) AS q1, quantile_cont(CASE WHEN {GOOD} THEN latency_ms END, 0.75) AS q3 FROM odd_tel GROUP BY ALL) f
      ON t.tenant_id IS NOT DISTINCT FROM f.tenant_id AND t.service_id IS NOT DISTINCT FROM f.service_id""",
    "odd_consent": """WITH given AS (SELECT user_id, decided_at, bool_and(analytical) AS analytical FROM consent GROUP BY ALL)
      SELECT event_id, coalesce(c.analytical, false) AS consented FROM odd_tel t ASOF LEFT JOIN given c ON t.user_id = c.user_id AND t.event_time >= c.decided_at""",
    "odd_rollup": ROLL.format(MEAN, ""),
    "odd_incidents": f"WITH {INCIDENTS.replace('FROM tel', 'FROM odd_tel')} SELECT * FROM inc",
    "odd_sliding_rate": "SELECT event_id, n60, n60 > 1 AS over FROM (SELECT event_id, count(*) OVER (PARTITION BY tenant_id ORDER BY event_time RANGE BETWEEN INTERVAL 600 SECOND PRECEDING AND CURRENT ROW) AS n60 FROM odd_tel) x",
    "odd_token_bucket": """WITH secs AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY sec) AS rn FROM (SELECT tenant_id, coalesce(cap, 60) AS cap, epoch_us(event_time) // 1000000 AS sec, count(*) AS n
       FROM odd_tel LEFT JOIN (SELECT tenant_id AS tid, CASE tier WHEN 'Pro' THEN 6 ELSE 2 END AS cap FROM tenants WHERE tenant_id <> 't2') l ON tid = tenant_id GROUP BY ALL) g),
      walk AS (SELECT tenant_id, cap, sec, n, rn, CAST(cap AS DOUBLE) AS tokens FROM secs WHERE rn = 1 UNION ALL
       SELECT s.tenant_id, s.cap, s.sec, s.n, s.rn, least(CAST(s.cap AS DOUBLE), w.tokens - least(CAST(w.n AS DOUBLE), floor(w.tokens)) + CAST((s.sec - w.sec) * s.cap AS DOUBLE) / 60e0) FROM walk w JOIN secs s ON s.tenant_id IS NOT DISTINCT FROM w.tenant_id AND s.rn = w.rn + 1),
      ranked AS (SELECT event_id, tenant_id, epoch_us(event_time) // 1000000 AS sec, row_number() OVER (PARTITION BY tenant_id, epoch_us(event_time) // 1000000 ORDER BY event_time, event_id) AS pos FROM odd_tel)
      SELECT r.event_id, r.tenant_id, cap AS capacity, pos <= floor(tokens) AS allowed FROM ranked r JOIN walk w ON w.tenant_id IS NOT DISTINCT FROM r.tenant_id AND w.sec = r.sec""",
    "odd_behaviour": """WITH gaps AS (SELECT *, (epoch_us(event_time) - lag(epoch_us(event_time)) OVER (PARTITION BY user_id ORDER BY event_time, event_id)) / 1e6 AS gap FROM odd_tel),
      u AS (SELECT user_id, count(*) AS events, round(stddev_samp(gap) / avg(gap), 6) AS gap_cv, CAST(count(CASE WHEN event_type IN ('click', 'view') THEN 1 END) AS DOUBLE) / count(*) AS interaction_share FROM gaps GROUP BY user_id)
      SELECT *, events >= 10 AND (coalesce(gap_cv, 1) < 0.9 OR interaction_share < 0.3) AS is_automated FROM u""",
    "odd_anomaly": f"""WITH roll AS ({ROLL.format(MEAN, f'WHERE {GOOD}')}), c AS (SELECT tenant_id, quantile_cont(avg_latency, 0.5) AS m FROM roll GROUP BY tenant_id),
      o AS (SELECT roll.*, m, abs(avg_latency - m) AS off FROM roll JOIN c ON c.tenant_id IS NOT DISTINCT FROM roll.tenant_id), s AS (SELECT tenant_id, quantile_cont(off, 0.5) AS mad FROM o GROUP BY tenant_id),
      z AS (SELECT o.tenant_id, hour, coalesce(0.6745e0 * (avg_latency - m) / nullif(mad, 0), 0) AS z FROM o JOIN s ON s.tenant_id IS NOT DISTINCT FROM o.tenant_id)
      SELECT tenant_id, hour, round(z, 4) AS z, round(least(1e0, abs(z) / 6), 4) AS score FROM z""",
    "odd_indicators": """SELECT event_id, s AS abuse_score, s >= 25 AS is_malicious FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 90 WHEN 2 THEN 99 WHEN 3 THEN 0 ELSE CASE WHEN host = 'app1.example.com' THEN 90 ELSE 30 END END AS s FROM tel) x""",
    "odd_triage": f"""WITH {FINDINGS}, un AS (SELECT * REPLACE (CASE WHEN cve_id LIKE '%7' OR cve_id LIKE '%2' THEN NULL ELSE cvss END AS cvss) FROM findings),
      sc AS (SELECT *, tenant_id IN ('t1', 't3') AS has_active_intel, CASE WHEN cvss IS NULL THEN 3 ELSE CAST(greatest(1, least(5, ceil(cvss / 2))) AS INTEGER) END * (2 + 3 * CAST(tenant_id IN ('t1', 't3') AS INTEGER)) AS priority FROM un)
      SELECT *, CAST(dense_rank() OVER (PARTITION BY tenant_id ORDER BY priority DESC, cvss DESC NULLS LAST, cve_id) AS INTEGER) AS rank, CASE WHEN priority >= 20 THEN 'now' WHEN priority >= 8 THEN 'next' ELSE 'backlog' END AS "column" FROM sc""",
    "odd_archive": "SELECT event_id, k <> 7 AND event_time < TIMESTAMP '2024-01-15 00:00:00' AS archived FROM odd_tel",
    "odd_links": """SELECT page_id, '/gone' || page_id AS link, 'missing_page' AS problem FROM pages UNION ALL SELECT page_id, '#none', 'missing_fragment' FROM pages UNION ALL SELECT page_id, '/q?a=1&b=2', 'missing_page' FROM pages""",
    "odd_anchor_keys": "SELECT doc_id, 'sparktm-final-viii-no' || doc_id || '-1-2-ea' || CASE doc_id % 3 WHEN 0 THEN '-kg' ELSE '' END AS key FROM documents",
    "odd_headings": """SELECT doc_id, 1 AS idx, CAST(pos AS INTEGER) AS pos, CAST(depth AS INTEGER) AS depth, v.text, key, id, '/book/s' || doc_id || '/#' || id AS target FROM documents,
      (VALUES (0, 1, 'Alpha', 'alpha', 'alpha'), (1, 1, 'Big Title', 'big-title', 'big-title'), (2, 2, 'Small', 'small', 'small'), (3, 3, 'Beta', 'beta', 'beta'), (4, 2, 'Beta', 'beta', 'beta-2')) v(pos, depth, text, key, id)""",
    "odd_notes": """WITH n AS (SELECT 'n' || doc_id AS id, doc_id % 7 AS day, CASE doc_id % 2 WHEN 0 THEN 'note' ELSE 'part' END AS word, doc_id % 3 AS major, doc_id % 23 AS minor FROM documents WHERE doc_id % 9 <> 0),
      r AS (SELECT id, row_number() OVER (ORDER BY day DESC, word DESC, major DESC, minor DESC, id DESC) AS rank FROM n) SELECT *, lag(id) OVER (ORDER BY rank) AS prev_id, lead(id) OVER (ORDER BY rank) AS next_id FROM r""",
    "odd_brand_terms": r"""WITH words AS (SELECT conv_id * 100 + turn AS doc_id, ' ' || trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' AS t FROM conversations),
      terms AS (SELECT DISTINCT trim(regexp_replace(lower(array_to_string(string_split(text, ' ')[2:item_id + 2], ' ')), '[^\p{L}\p{N}]+', ' ', 'g')) AS term FROM benchmark),
      toks AS (SELECT doc_id, string_split(trim(t), ' ') AS w FROM words WHERE trim(t) <> ''), lens AS (SELECT DISTINCT len(string_split(term, ' ')) AS n FROM terms WHERE term <> ''),
      grams AS (SELECT doc_id, array_to_string(w[i:i + n - 1], ' ') AS term FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM toks, lens WHERE len(w) >= n) g)
      SELECT doc_id, g.term, count(*) AS n FROM grams g JOIN terms USING (term) GROUP BY ALL""",
}
ORACLES = {k: with_views(v) for k, v in ORACLES.items()}
ORACLES["odd_token_bucket"] = ORACLES["odd_token_bucket"].replace("WITH ", "WITH RECURSIVE ", 1)
