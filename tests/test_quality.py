import datetime as dt

from pyspark.sql import functions as F

from optelem.operators import quality
from optelem.plans import digests
from tests.conftest import rows


def raw(spark, data):
    df = spark.createDataFrame(data, "event_id long, tenant_id string, claimed_tenant string, host string, idempotency_key string, delivery int, at string, latency_in double, status_code int")
    return df.withColumn("received_at", F.col("at").cast("timestamp_ntz")).withColumn("event_type", F.lit("view"))


def test_contract_first_rule_wins(spark):
    df = raw(spark, [(1, "t1", "t1", "h", "a", 1, "2024-01-01 00:00:00", 5.0, 200), (2, "t1", "t1", "h", "b", 1, "2024-01-01 00:00:00", None, 999),
                     (3, "t1", "t1", "h", "c", 1, "2024-01-01 00:00:00", 481.0, 200), (4, None, "t1", "h", "d", 1, "2024-01-01 00:00:00", 1.0, 200),
                     (5, "t1", "t1", "h", "e", 1, "2024-01-01 00:00:00", 480.0, None)])
    assert rows(quality.check_contract(df), "event_id", "reason") == [(1, None), (2, "missing_latency"), (3, "latency_out_of_range"), (4, "bad_tenant"), (5, "bad_status")]


def test_metadata_null_and_extra(spark):
    df = spark.createDataFrame([(1, '{"a":1}'), (2, '{"z":1,"a":2,"y":3}'), (3, None), (4, "{}")], "event_id long, metadata string")
    assert rows(quality.check_metadata(df, ["a"]), "event_id", "bad_keys", "reason") == [
        (1, "", None), (2, "y,z", "metadata_not_allowed"), (3, "", None), (4, "", None)]


def test_bind_tenant_fails_closed(spark):
    tenants = spark.createDataFrame([("h1", "t1"), ("h2", "t2")], "host string, tenant_id string")
    base = (1, "x", 1, "2024-01-01 00:00:00", 1.0, 200)
    df = raw(spark, [(i, "t1", claimed, host, *base[1:]) for i, (claimed, host) in enumerate([("t1", "h1"), ("t1", "h2"), ("t1", "h9"), (None, "h1"), ("t1", None)])])
    assert rows(quality.bind_tenant(df, tenants), "event_id", "reason") == [
        (0, None), (1, "tenant_mismatch"), (2, "unmapped_host"), (3, "tenant_mismatch"), (4, "unmapped_host")]


def test_keys_inactive_refused(spark):
    keys = spark.createDataFrame([("a", "t1", True), ("b", "t2", False)], "k string, tenant_id string, is_active boolean").withColumn("key_hash", F.sha2("k", 256))
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "event_id long, sender_key string")
    out = quality.attribute_key(df, keys)
    assert rows(out, "event_id", "key_tenant", "reason") == [(1, "t1", None), (2, None, "unknown_key"), (3, None, "unknown_key")]
    assert "sender_key" not in out.columns


def test_dedupe_ties_and_hot_key(spark):
    data = [(i, "t1", "t1", "h", "same", 2 if i else 1, "2024-01-01 00:00:00", 1.0, 200) for i in range(500)] + [(900, "t2", "t2", "h", "same", 1, "2024-01-01 00:00:01", 1.0, 200)]
    assert rows(quality.dedupe(raw(spark, data)), "tenant_id", "event_id") == [("t1", 0), ("t2", 900)]
    assert quality.dedupe(raw(spark, data).where("false")).count() == 0


def test_upcast_steps_chain(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (2, 2, 3000.0), (3, 3, 4000.0), (4, 9, 1.0)], "event_id long, version int, latency double")
    steps = {1: {"latency": "latency * 1000"}, 2: {"note": "'v2'"}}
    assert rows(quality.upcast(df, steps), "event_id", "version", "latency", "note") == [(1, 3, 2000.0, "v2"), (2, 3, 3000.0, "v2"), (3, 3, 4000.0, None), (4, 9, 1.0, None)]
    assert rows(quality.unknown_versions(df, 3), "event_id") == [(4,)]


def test_dead_letters_and_replay(spark):
    df = raw(spark, [(1, "t1", "t1", "h", "a", 1, "2024-01-01 00:00:00", None, 200), (2, "t1", "t1", "h", "b", 3, "2024-01-01 00:00:00", None, 200),
                     (3, "t1", "t1", "h", "c", 1, "2024-01-01 00:00:00", None, 200), (4, "t1", "t1", "h", "d", 1, "2024-01-01 00:00:00", 2.0, 200)])
    dlq = quality.dead_letters(quality.check_contract(df))
    accepted = spark.createDataFrame([("c",), ("c",), ("d",)], "idempotency_key string")
    assert rows(quality.replay(dlq, accepted, 3), "event_id", "state") == [(1, "replayable"), (2, "exhausted"), (3, "already_accepted")]
    schema = df.drop("reason").schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    again = quality.rebuilt(dlq.where("event_id = 1"), schema)
    assert rows(again) == rows(df.where("event_id = 1")) and again.dtypes == df.dtypes
    assert rows(quality.check_contract(again), "reason") == [("missing_latency",)]


def test_receipts(spark):
    df = raw(spark, [(1, "t1", "t1", "h", "a", 1, "2024-01-01 00:00:00", 1.0, 200), (1, "t1", "t1", "h", "a", 2, "2024-01-01 00:01:00", 1.0, 200),
                     (2, "t1", "t1", "h", "b", 1, "2024-01-01 00:00:00", None, 200), (3, "t1", "t1", "h", "c", 1, "2024-01-01 00:00:00", None, 200)])
    judged = quality.check_contract(df).withColumn("batch_id", F.when(F.col("event_id") == 3, "y").otherwise("x"))
    assert rows(quality.batch_receipts(judged), "batch_id", "n", "accepted", "duplicate", "rejected", "state") == [
        ("x", 3, 1, 1, 1, "partial"), ("y", 1, 0, 0, 1, "rejected")]


def test_reconcile_compares_multisets(spark):
    sent = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "d"), (4, "d")], "id long, v string")
    landed = spark.createDataFrame([(1, "a"), (2, "x"), (3, None), (4, "d"), (5, "e")], "id long, v string")
    assert rows(quality.reconcile_checksums(sent, landed, "id", ["v"])) == [(1, "match"), (2, "changed"), (3, "match"), (4, "changed"), (5, "extra")]
    assert rows(quality.reconcile_checksums(sent.where("id = 1"), landed.where("false"), "id", ["v"])) == [(1, "missing")]


def test_outliers_keep_every_row(spark):
    df = spark.createDataFrame([("t", "s", float(v)) for v in (1, 2, 3, 4, 100)] + [("t", "s", None), ("u", "s", 5.0)], "tenant_id string, service_id string, latency_ms double")
    out = quality.quarantine_outliers(df)
    assert rows(out, "latency_ms", "is_outlier") == sorted([(1.0, False), (2.0, False), (3.0, False), (4.0, False), (100.0, True), (None, False), (5.0, False)], key=repr)


def test_redaction(spark):
    df = spark.createDataFrame([(1, "mail a.b@c.org or 10.1.2.3, call +49 (30) 123-4567"), (2, ""), (3, None)], "doc_id long, text string")
    assert rows(quality.redact_pii(df), "doc_id", "n_hits", "text") == [(1, 3, "mail <email> or <ipv4>, call <phone>"), (2, 0, ""), (3, None, None)]


def test_minimise_ips_waits_for_the_session_end(spark):
    data = [(1, "2024-01-01 10:00:00"), (1, "2024-01-01 10:29:00"), (1, "2024-01-01 12:00:00"), (2, "2024-01-01 11:45:00")]
    df = spark.createDataFrame(data, "user_id long, at string").select("user_id", F.col("at").cast("timestamp_ntz").alias("event_time"), F.lit("10.0.0.1").alias("client_ip"))
    out = quality.minimise_ips(df, "2024-01-01 12:10:00")
    assert [r["client_ip"] for r in out.orderBy("user_id", "event_time").collect()] == [None, None, "10.0.0.1", "10.0.0.1"]


def test_consent(spark):
    events = spark.createDataFrame([(1, "2024-01-01 10:00:00", 1), (1, "2024-01-01 12:00:00", 2), (1, "2024-01-02 12:00:00", 3), (2, "2024-01-01 10:00:00", 4), (3, "2024-01-01 10:00:00", 5)],
                                   "user_id long, at string, event_id long").select("user_id", F.col("at").cast("timestamp_ntz").alias("event_time"), "event_id", F.lit("t").alias("tenant_id"))
    consent = spark.createDataFrame([(1, "2024-01-01 12:00:00", True), (1, "2024-01-02 00:00:00", False), (3, "2024-01-01 10:00:00", True), (3, "2024-01-01 10:00:00", False)],
                                    "user_id long, at string, analytical boolean").select("user_id", F.col("at").cast("timestamp_ntz").alias("decided_at"), "analytical")
    assert rows(quality.consent_gate(events, consent), "event_id") == [(2,)]
    assert rows(quality.anonymous_counts(events, consent)) == [("t", dt.date(2024, 1, 1), 3), ("t", dt.date(2024, 1, 2), 1)]


def test_tracking_cookies(spark):
    header = "necessary=1; _ga=GA1; _ga_ABC=2;_gid=3; _gat_x=4; _gcl_au=5; _clck=6; _clsk=7; _garden=8"
    df = spark.createDataFrame([(1, header, False), (2, header, True), (3, header, None), (4, None, False)], "user_id long, cookie_header string, analytical boolean")
    kept = "necessary=1; _garden=8"
    assert rows(quality.strip_tracking_cookies(df), "user_id", "cookie_header") == [(1, kept), (2, header), (3, kept), (4, None)]


def test_rows_without_a_key_all_stay(spark):
    df = raw(spark, [(1, "t1", "t1", "h", None, 1, "2024-01-01 00:00:00", 1.0, 200), (2, "t1", "t1", "h", None, 1, "2024-01-01 00:00:01", 1.0, 200),
                     (3, "t1", "t1", "h", "a", 1, "2024-01-01 00:00:00", 1.0, 200), (3, "t1", "t1", "h", "a", 2, "2024-01-01 00:00:00", 1.0, 200)])
    assert rows(quality.dedupe(df), "event_id") == [(1,), (2,), (3,)]
    assert rows(quality.check_contract(df).where("reason IS NOT NULL"), "event_id", "reason") == [(1, "missing_key"), (2, "missing_key")]


def test_keys_and_hosts_listed_twice(spark):
    hosts = spark.createDataFrame([("h", "t1"), ("h", "t1"), ("g", "t1"), ("g", "t2")], "host string, tenant_id string")
    events = spark.createDataFrame([(1, "h"), (2, "g"), (3, "x"), (4, None)], "event_id long, host string")
    assert rows(quality.attribute_host(events, hosts, "mapped"), "event_id", "mapped") == [(1, "t1"), (2, None), (3, None), (4, None)]


def test_metadata_that_is_no_object(spark):
    df = spark.createDataFrame([(1, '{"k":1}'), (2, '{"k":'), (3, "[]"), (4, "7"), (5, None), (6, ""), (7, "{}"), (8, '{"x":1,"k":2}')], "event_id long, metadata string")
    found = dict(rows(quality.check_metadata(df, ["k"]), "event_id", "reason"))
    assert found == {1: None, 2: "metadata_malformed", 3: "metadata_malformed", 4: "metadata_malformed", 5: None, 6: "metadata_malformed", 7: None, 8: "metadata_not_allowed"}


def test_digest_tree_opens_only_ranges_that_differ(spark):
    sent = spark.range(5000).selectExpr("id", "CAST(id % 7 AS STRING) AS v")
    landed = sent.withColumn("v", F.when(F.col("id") == 17, "x").otherwise(F.col("v"))).where("id <> 40").unionByName(sent.where("id = 99"))
    trees = [digests.digest_tree(d, "id", ["v"]) for d in (sent, landed)]
    assert trees[0].where("level = 2").agg(F.sum("n")).first()[0] == 5000 == trees[0].where("level = 0").agg(F.sum("n")).first()[0]
    leaves = digests.differing_leaves(*trees)
    assert leaves.count() == 3
    opened = digests.rows_in(landed, "id", leaves)
    assert opened.count() < 10 and digests.rows_in(landed, "id", leaves, inside=False).count() + opened.count() == landed.count()
    changed = quality.changed_keys(sent, landed, "id", ["v"], leaves)
    assert rows(changed) == [(17, "changed"), (40, "missing"), (99, "changed")]
    plan = changed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") >= 2  # both sides, one of them a union
    assert rows(quality.reconcile_checksums(sent, sent, "id", ["v"]).groupBy("verdict").count()) == [("match", 5000)]
    assert digests.differing_leaves(*[digests.digest_tree(d.limit(0), "id", ["v"]) for d in (sent, landed)]).count() == 0


def test_rows_that_read_alike_are_different(spark):
    one = spark.createDataFrame([(1, "a|b", "c"), (2, None, "x"), (3, "1:a", "b"), (None, "n", "n"), (None, "m", "m"), (4, "", None)], "id long, x string, y string")
    other = spark.createDataFrame([(1, "a", "b|c"), (2, "~", "x"), (3, "1:a", "b"), (None, "m", "m"), (None, "n", "n"), (4, None, "")], "id long, x string, y string")
    assert rows(quality.reconcile_checksums(one, other, "id", ["x", "y"])) == sorted([(1, "changed"), (2, "changed"), (3, "match"), (None, "match"), (4, "changed")], key=repr)
