"""Registered queries and oracles: readers over text made from the tables, sealing, cookies, file ages."""

from __future__ import annotations

from pyspark.sql import functions as F

from optelem.fixtures import query, view, with_views
from optelem.operators import quality, sealing
from optelem.plans.lookups import settle
from optelem.sources import documents, tables

BATCH_LINES = """SELECT CASE WHEN event_id % 50 = 0 THEN '{"source": ' WHEN event_id % 50 = 1 THEN '' WHEN event_id % 50 = 2 THEN 'junk' WHEN event_id % 50 = 3 THEN '{"source":"s9","records":[]}' WHEN event_id % 50 = 4 THEN NULL ELSE concat('{"source":"s', CAST(event_id % 3 AS STRING), '","cluster_id":"c","batch_id":"b', CAST(event_id AS STRING), '","records":[{"id":', CAST(event_id AS STRING), '},{"id":', CAST(event_id * 2 AS STRING), ',"more":[1,2]}]}') END AS value FROM tel"""
PREDICTIONS = """SELECT concat('{"score":', CAST(k AS STRING), ',"event_id":', CAST(event_id AS STRING), ',"scored_at":"', CASE WHEN event_id % 7 = 0 THEN 'yesterday' ELSE '2024-01-02T03:04:05' END, '","extra":true}') AS value FROM tel"""
NOTE_FILES = """SELECT concat('file:/notes/note-', CAST(doc_id AS STRING), '.md') AS path, concat(CASE WHEN doc_id % 11 = 0 THEN '' ELSE concat('---', chr(10)) END, 'title: "T ', CAST(doc_id AS STRING), '"', chr(10),
 CASE WHEN doc_id % 7 = 0 THEN '' ELSE concat('summary: s', chr(10)) END, 'publishedAt: ', CASE doc_id % 5 WHEN 0 THEN '2026-07-05garbage' WHEN 1 THEN '2026-07-05T10:20:30' ELSE '2026-07-05' END, chr(10),
 'note: Note 1.', CAST(doc_id AS STRING), chr(10), 'categories:', chr(10), '  - a', chr(10), '  - "b c"', chr(10), '---', chr(10), '## One', chr(10), 'x', chr(10), CASE WHEN doc_id % 3 = 0 THEN '' ELSE '## Two' END, chr(10)) AS value FROM documents"""
MANIFESTS = """SELECT concat('file:/m/', CAST(p_partkey AS STRING)) AS path, CASE p_partkey % 4 WHEN 0 THEN concat('Pkg', CAST(p_partkey AS STRING), '==', CAST(p_size AS STRING), '.1 ; python_version > "3"') WHEN 1 THEN concat('- `lib-', CAST(p_partkey AS STRING), '`: ^', CAST(p_size AS STRING), '.0')
 WHEN 2 THEN concat('extra[full]==', CAST(p_size AS STRING)) ELSE '# comment' END AS value FROM part"""
COOKIES = "SELECT event_id, k % 2 = 0 AS analytical, concat('_ga=1; session=', CAST(k AS STRING), '; _ga_X', CAST(k AS STRING), '=2;_gid=3; _gat_a=4; theme=dark=1; _gax=5') AS cookie_header FROM tel"
INPUTS = "SELECT concat('d', CAST(k % 7 AS STRING)) AS dataset, event_time AS modified_at FROM tel WHERE event_id % 2 = 0"
OUTPUTS = "SELECT concat('d', CAST(k % 6 AS STRING)) AS dataset, event_time + INTERVAL '10' DAY AS modified_at FROM tel WHERE event_id % 97 = 0"
KEY_HEX = {"k1": "01" * 32, "k2": "02" * 32}


def _keyring(spark, d, active):
    """Two keys; the newest active one seals."""
    rows = query(spark, d, "SELECT concat('k', CAST(r_regionkey AS STRING)) AS kid, r_regionkey AS no FROM region WHERE r_regionkey IN (1, 2)")
    key = F.unhex(F.when(F.col("kid") == "k1", KEY_HEX["k1"]).otherwise(KEY_HEX["k2"]))
    return rows.select("kid", key.alias("key"), F.make_timestamp_ntz(F.lit(2024), F.col("no"), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("created_at"), F.col("kid").isin(*active).alias("is_active"))


def _sealed(spark, d):
    plain = view(spark, d, "tel").select("event_id", "tenant_id", "client_ip", "latency_ms")
    return settle(sealing.seal_columns(plain, _keyring(spark, d, ["k1"]), ["client_ip", "latency_ms"], "store", "edge"))


def _opened(spark, d):
    sealed = _sealed(spark, d)
    tampered = (sealed.withColumn("ctx", F.when(F.col("event_id") % 10 == 1, "elsewhere").otherwise(F.col("ctx")))
                .withColumn("kid", F.when(F.col("event_id") % 10 == 2, "k9").otherwise(F.col("kid"))).withColumn("ciphertext", F.when(F.col("event_id") % 10 != 3, F.col("ciphertext"))))
    good, bad = sealing.open_columns(tampered, _keyring(spark, d, ["k1"]), "client_ip string, latency_ms double")
    return good.select("event_id", "client_ip", "latency_ms", F.lit(None).cast("string").alias("reason")).unionByName(
        bad.select("event_id", F.lit(None).cast("string").alias("client_ip"), F.lit(None).cast("double").alias("latency_ms"), "reason"))


def _rotated(spark, d):
    rotated = settle(sealing.rotate_keys(_sealed(spark, d), _keyring(spark, d, ["k1", "k2"]), ["k1"]))
    good, _ = sealing.open_columns(rotated, _keyring(spark, d, ["k2"]).where("kid = 'k2'"), "client_ip string, latency_ms double")
    return rotated.select("event_id", "kid").join(good.select("event_id", "client_ip", "latency_ms"), "event_id")


QUERIES = {
    "scan_batches": lambda s, d: documents.parse_batches(query(s, d, BATCH_LINES)).select("source", "cluster_id", "batch_id", "pos", F.variant_get("record", "$.id", "long").alias("id"), "reason", "raw"),
    "batch_dead_letters": lambda s, d: documents.batch_dead_letters(documents.parse_batches(query(s, d, BATCH_LINES))),
    "load_predictions": lambda s, d: documents.parse_predictions(query(s, d, PREDICTIONS), {"event_id": "long", "score": "double", "scored_at": "timestamp"}, ["scored_at"]).withColumn("scored_at", F.col("scored_at").cast("timestamp_ntz")),
    "scan_notes": lambda s, d: documents.parse_notes(query(s, d, NOTE_FILES)).select("id", "title", "summary", "published_at", "note", F.array_join("categories", "|").alias("categories"), "draft", "error"),
    "lockfile_inventory": lambda s, d: documents.parse_manifests(query(s, d, MANIFESTS)),
    "stale_outputs": lambda s, d: tables.stale_outputs(query(s, d, INPUTS), query(s, d, OUTPUTS)),
    "strip_tracking_cookies": lambda s, d: quality.strip_tracking_cookies(query(s, d, COOKIES)),
    "open_columns": _opened,
    "rotate_keys": _rotated,
}

ORACLES = {
    "scan_batches": """SELECT 's' || event_id % 3 AS source, 'c' AS cluster_id, 'b' || event_id AS batch_id, CAST(pos AS INTEGER) AS pos, event_id * (1 + pos) AS id, NULL AS reason, NULL AS raw FROM tel, range(2) r(pos) WHERE event_id % 50 > 4
      UNION ALL SELECT CASE WHEN event_id % 50 = 3 THEN 's9' END, NULL, NULL, NULL, NULL, CASE event_id % 50 WHEN 0 THEN 'malformed_json' WHEN 2 THEN 'malformed_json' WHEN 3 THEN 'no_records' ELSE 'empty_document' END, coalesce(value, '')
      FROM tel JOIN (VALUES (0, '{"source": '), (1, ''), (2, 'junk'), (3, '{"source":"s9","records":[]}'), (4, NULL)) v(m, value) ON m = event_id % 50 WHERE event_id % 50 < 5""",
    "batch_dead_letters": """SELECT CAST(NULL AS BIGINT) AS event_id, sha256(value) AS idempotency_key, reason AS error_class, value AS payload, 1 AS attempts FROM tel JOIN (VALUES (0, 'malformed_json', '{"source": '), (1, 'empty_document', ''),
      (2, 'malformed_json', 'junk'), (3, 'no_records', '{"source":"s9","records":[]}'), (4, 'empty_document', '')) v(m, reason, value) ON m = event_id % 50""",
    "load_predictions": "SELECT event_id, CAST(k AS DOUBLE) AS score, CASE WHEN event_id % 7 <> 0 THEN TIMESTAMP '2024-01-02 03:04:05' END AS scored_at FROM tel",
    "scan_notes": """SELECT 'note-' || doc_id AS id, CASE WHEN ok THEN 'T ' || doc_id END AS title, CASE WHEN ok AND doc_id % 7 <> 0 THEN 's' END AS summary,
      CASE WHEN ok THEN CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN TIMESTAMP '2026-07-05 10:20:30' ELSE TIMESTAMP '2026-07-05' END END AS published_at, CASE WHEN ok THEN 'Note 1.' || doc_id END AS note, CASE WHEN ok THEN 'a|b c' ELSE '' END AS categories, false AS draft,
      CASE WHEN NOT ok THEN 'no_front_matter' WHEN doc_id % 7 = 0 THEN 'no_summary' WHEN doc_id % 5 = 0 THEN 'bad_date' WHEN doc_id % 3 = 0 THEN 'too_few_sections' END AS error FROM (SELECT doc_id, doc_id % 11 <> 0 AS ok FROM documents) x""",
    "lockfile_inventory": """SELECT 'file:/m/' || p_partkey AS path, CASE p_partkey % 4 WHEN 1 THEN 'npm' ELSE 'pypi' END AS ecosystem, CASE p_partkey % 4 WHEN 0 THEN 'pkg' || p_partkey WHEN 1 THEN 'lib-' || p_partkey ELSE 'extra' END AS package,
      CASE p_partkey % 4 WHEN 0 THEN p_size || '.1' WHEN 1 THEN p_size || '.0' ELSE CAST(p_size AS VARCHAR) END AS version FROM part WHERE p_partkey % 4 <> 3""",
    "stale_outputs": f"""WITH i AS (SELECT dataset, max(modified_at) AS newest FROM ({INPUTS}) a GROUP BY dataset), o AS (SELECT dataset, min(modified_at) AS oldest FROM ({OUTPUTS}) b GROUP BY dataset)
      SELECT i.dataset, oldest IS NULL OR newest > oldest AS is_stale FROM i LEFT JOIN o ON i.dataset = o.dataset""",
    "strip_tracking_cookies": f"SELECT event_id, analytical, CASE WHEN analytical THEN cookie_header ELSE 'session=' || regexp_extract(cookie_header, 'session=([0-9]+)', 1) || '; theme=dark=1; _gax=5' END AS cookie_header FROM ({COOKIES}) c",
    "open_columns": """SELECT event_id, CASE WHEN ok THEN client_ip END AS client_ip, CASE WHEN ok THEN latency_ms END AS latency_ms, CASE event_id % 10 WHEN 1 THEN 'not_authentic' WHEN 2 THEN 'unknown_kid' WHEN 3 THEN 'plaintext_refused' END AS reason
      FROM (SELECT *, event_id % 10 NOT IN (1, 2, 3) AS ok FROM tel) x""",
    "rotate_keys": "SELECT event_id, 'k2' AS kid, client_ip, latency_ms FROM tel",
}
ORACLES = {k: with_views(v) for k, v in ORACLES.items()}
