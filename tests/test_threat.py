import json
import random

from pyspark.sql import functions as F

from optelem.operators import threat
from tests.conftest import events, rows


def listings(spark, data):
    df = spark.createDataFrame(data, "kind string, indicator string, feed string, abuse_score int, at string")
    return df.withColumn("listed_at", F.col("at").cast("timestamp_ntz")).drop("at")


def test_merge_feeds_newest_and_expiry(spark):
    a = listings(spark, [("ipv4", "1.1.1.1", "a", 10, "2024-01-01 00:00:00"), ("ipv4", "2.2.2.2", "a", 10, "2023-01-01 00:00:00"), ("ipv4", "3.3.3.3", "a", 1, "2024-03-01 00:00:00")])
    b = listings(spark, [("ipv4", "1.1.1.1", "b", 90, "2024-01-02 00:00:00")])
    out = threat.merge_feeds(a, b, as_of="2024-01-10 00:00:00")
    assert rows(out, "indicator", "feed", "abuse_score") == [("1.1.1.1", "b", 90)]


def test_match_by_every_kind(spark):
    ind = listings(spark, [("ipv4", "1.1.1.1", "a", 30, "2024-01-01 00:00:00"), ("asn", "65001", "a", 80, "2024-01-01 00:00:00"), ("domain", "evil.org", "a", 10, "2024-01-01 00:00:00")])
    df = spark.createDataFrame([(1, "1.1.1.1", 1, "a.ok.org"), (2, "1.1.1.1", 65001, "ok"), (3, "9.9.9.9", None, "x.evil.org"), (4, None, None, None)], "event_id long, client_ip string, asn long, host string")
    assert rows(threat.match_indicators(df, ind), "event_id", "abuse_score", "is_malicious") == [(1, 30, True), (2, 80, True), (3, 10, False), (4, 0, False)]


def test_block_spans_merge(spark):
    ls = listings(spark, [("ipv4", "1.1.1.1", "a", 1, t) for t in ("2024-01-01 00:00:00", "2024-01-01 20:00:00", "2024-01-02 10:00:00", "2024-01-05 00:00:00")])
    assert threat.blocked_spans(ls).count() == 2
    df = events(spark, [("t", "s", 1, i, at, 200, 1.0) for i, at in enumerate(["2023-12-31 23:59:59", "2024-01-01 00:00:00", "2024-01-03 09:59:59", "2024-01-03 10:00:00", "2024-01-05 12:00:00"])])
    out = threat.block_list_as_of(df.withColumn("client_ip", F.lit("1.1.1.1")), ls)
    assert [r["blocked"] for r in out.orderBy("event_id").collect()] == [False, True, True, False, True]
    assert out.count() == 5


def test_stride_drops_unknown_signals_only(spark):
    df = spark.createDataFrame([(1, "cross_tenant_read"), (2, "noise"), (3, None)], "event_id long, signal string")
    assert rows(threat.tag_stride(df), "event_id", "category") == [(1, "I"), (1, "LM")]


def test_breach_normalises(spark):
    accounts = spark.createDataFrame([(1, "t", "A@x.org "), (2, "t", "b@x.org"), (3, "t", None)], "account_id long, tenant_id string, email string")
    breaches = spark.createDataFrame([("  a@X.org",), ("a@x.org",), (None,)], "email string")
    assert rows(threat.breach_match(accounts, breaches), "account_id") == [(1,)]


def test_brand_mentions_whole_words(spark):
    docs = spark.createDataFrame([(1, "Acme Corp; acme-corp. ACME CORPORATION acme"), (2, "nothing"), (3, None), (4, "corp")], "doc_id long, text string")
    terms = spark.createDataFrame([("acme corp",), ("Acme  Corp",), ("acme",), ("",)], "term string")
    assert rows(threat.brand_mentions(docs, terms)) == [(1, "acme corp", 2), (1, "acme", 4)]
    assert threat.brand_mentions(docs, terms.where("false")).count() == 0


def test_spikes_need_history(spark):
    base = [("t", "s", 1, h * 100 + i, f"2024-01-01 {h:02d}:00:{i:02d}", 200, 1.0) for h in range(10) for i in range(3 + h % 2)]
    burst = [("t", "s", 1, 5000 + i, f"2024-01-01 10:00:{i:02d}", 200, 1.0) for i in range(40)]
    out = threat.traffic_spikes(events(spark, base + burst).withColumn("asn", F.lit(1)))
    got = {r["hour"].hour: (r["z"], r["is_spike"]) for r in out.collect()}
    assert got[10][1] and not any(s for h, (z, s) in got.items() if h < 10) and got[3][0] is None


def test_baseline_suppresses_small_groups(spark):
    df = events(spark, [(f"t{i}", "s", 1, i, "2024-01-01 00:00:00", 500 if i % 2 else 200, 1.0) for i in range(6)]).withColumn("is_malicious", F.lit(False)).withColumn("country", F.when(F.col("event_id") < 2, "A").otherwise("B"))
    assert rows(threat.global_baseline(df, "2024-02-01 00:00:00", min_tenants=4, by="country"), "segment", "n_tenants") == [("B", 4)]
    levels = threat.tenant_vs_global(df, threat.global_baseline(df, "2024-02-01 00:00:00"), min_rows=1)
    assert {r["tenant_id"]: r["level"] for r in levels.collect()} == {f"t{i}": "elevated" if i % 2 else "normal" for i in range(6)}
    assert {r["level"] for r in threat.tenant_vs_global(df, threat.global_baseline(df, "2024-02-01 00:00:00"), min_rows=2).collect()} == {"zero"}


def test_cases_open_and_closed(spark):
    sig = spark.createDataFrame([("a", "t", "e", "2024-01-01 00:00:00", "2024-01-01 01:00:00", 5), ("b", "t", "e", "2024-01-01 02:00:00", "2024-01-01 03:00:00", 5), ("a", "t", "e", "2024-01-03 00:00:00", "2024-01-03 01:00:00", 5)],
                                "rule string, tenant_id string, entity string, s string, e string, n long")
    sig = sig.select("rule", "tenant_id", "entity", F.col("s").cast("timestamp_ntz").alias("window_start"), F.col("e").cast("timestamp_ntz").alias("window_end"), "n")
    out = threat.siem_cases(sig, 2, "2024-01-03 02:00:00")
    assert rows(out, "rules", "signals", "severity", "state") == [("a", 1, "low", "open"), ("a,b", 2, "high", "closed")]


def test_actions_at_boundaries(spark):
    df = spark.createDataFrame([(0.0, None), (0.5, None), (0.7, 0.8), (0.9, None), (1.0, None), (None, None)], "score double, review_from double")
    assert [(r["action"], r["in_review"]) for r in threat.response_actions(df).collect()] == [
        ("allow", False), ("throttle", False), ("challenge", False), ("block", True), ("block", True), (None, False)]


def test_playbooks(spark):
    df = spark.createDataFrame([(1, 1, "succeeded", 0), (1, 2, "failed", 1), (2, 1, "failed", 3), (3, 1, "succeeded", 0), (4, 1, "waiting", 0)], "run_id long, seq int, state string, attempts int")
    df = df.withColumn("updated_at", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    out = threat.playbook_runs(df)
    assert rows(out, "run_id", "run_state", "retry_eligible", "last_state") == [(1, "retrying", 1, "failed"), (2, "failed", 0, "failed"), (3, "succeeded", 0, "succeeded"), (4, "waiting", 0, "waiting")]
    assert str(out.where("run_id = 1").first()["next_retry_at"]) == "2024-01-01 00:01:00"


def test_bundles_hold_every_object_once(spark):
    findings = spark.createDataFrame([("t1", "p", f"{i}.0", f"CVE-{i}", 5.0) for i in range(30)], "tenant_id string, product string, version string, cve_id string, cvss double")
    flagged = spark.createDataFrame([("t1", "1.1.1.1"), ("t1", "1.1.1.1"), ("t2", "2.2.2.2")], "tenant_id string, indicator string")
    objects = threat.stix_objects(findings, flagged, "2024-01-01T00:00:00.000Z")
    first, second = threat.stix_bundle(objects, 10), threat.stix_bundle(objects, 10)
    assert rows(first) == rows(second)
    ids = []
    for r in first.collect():
        bundle = json.loads(r["bundle_json"])
        assert bundle["type"] == "bundle" and len(bundle["objects"]) == r["n_objects"]
        ids += [o["id"] for o in bundle["objects"]]
    assert len(ids) == len(set(ids)) == objects.count() == 2 + 2 + 30


def test_triage_keeps_findings_without_a_score(spark):
    found = spark.createDataFrame([("t", "p", "1", "CVE-1", 9.8), ("t", "p", "1", "CVE-2", None), (None, "p", "1", "CVE-3", 1.0)], "tenant_id string, product string, version string, cve_id string, cvss double")
    board = threat.triage_board(found, spark.createDataFrame([("t",)], "tenant_id string"))
    assert rows(board, "cve_id", "priority", "rank") == [("CVE-1", 25, 1), ("CVE-2", 15, 2), ("CVE-3", 2, 1)]


def test_domain_indicators_cover_what_is_below(spark):
    df = spark.createDataFrame([(1, "app.evil.co.uk"), (2, "evil.co.uk"), (3, "notevil.co.uk"), (4, "a.b.c.example.com"), (5, None)], "event_id long, host string")
    df = df.selectExpr("event_id", "host", "CAST(NULL AS STRING) AS client_ip", "CAST(NULL AS INT) AS asn")
    listed = spark.createDataFrame([("domain", "evil.co.uk", 80), ("domain", "b.c.example.com", 50), ("domain", "example.com", 60)], "kind string, indicator string, abuse_score int")
    assert rows(threat.match_indicators(df, listed), "event_id", "abuse_score") == [(1, 80), (2, 80), (3, 0), (4, 60), (5, 0)]


def test_brand_terms_of_seventy_lengths(spark):
    words = [f"w{i}" for i in range(100)]
    terms = spark.createDataFrame([(" ".join(words[i:2 * i]),) for i in range(1, 71) if 2 * i <= 100] + [(" ".join(words[:n]),) for n in range(1, 71)], "term string")
    text = spark.createDataFrame([(1, " ".join(words)), (2, "nothing"), (3, None)], "doc_id long, text string")
    found = threat.brand_mentions(text, terms)
    assert found.count() == len({r["term"] for r in terms.collect()}) and found.agg({"n": "max"}).first()[0] == 1
    assert threat.brand_mentions(text, terms.limit(0)).count() == 0


def test_brand_rows_follow_hits(spark):
    """Positions that begin no term never become rows, and a common first word proposes no long term."""
    filler = "the quick brown fox the lazy dog " * 200
    docs = spark.createDataFrame([(i, filler + ("the house of acme brands and sons " if i % 10 == 0 else "")) for i in range(50)], "doc_id long, text string")
    names = ["the house of acme brands and sons", "the house of acme", "acme brands", "house"]
    words = spark.createDataFrame([(n.split(), len(n.split()), n) for n in names], "_w array<string>, _len int, term string")
    tokens = docs.select("doc_id", threat._words("text").alias("_w"))
    starts = threat.term_starts(tokens, threat.term_trie(words), 7)
    proposed = starts.select(F.explode("_lengths")).count()
    hits = threat.brand_mentions(docs, words)
    assert hits.agg(F.sum("n")).first()[0] == proposed == 5 * 4


def test_brand_trie_against_all_windows(spark, monkeypatch):
    """Nested terms, terms across doubling depths, repeats, with a trie that is broadcast and one that is not."""
    rng = random.Random(11)
    texts = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for i in range(40)] + [(99, None), (1, "a b a b")]
    terms = sorted({" ".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(40)})
    want = {}
    for i, text in texts:
        w = (text or "").split()
        for t in terms:
            n = sum(w[k:k + len(t.split())] == t.split() for k in range(len(w)))
            if n:
                want[i, t] = want.get((i, t), 0) + n
    docs, listed = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(t,) for t in terms], "term string")
    for _ in range(2):
        assert {(r[0], r[1]): r[2] for r in threat.brand_mentions(docs, listed).select("doc_id", "term", "n").collect()} == want
        monkeypatch.setattr(threat, "lookup_side", lambda side, max_rows=0: side)


def test_hosts_are_looked_up_in_the_rows_named_for_it(spark):
    """The lookups of `match_indicators` do not compute the rows themselves when another table holds their hosts."""
    seen = spark.createDataFrame([(1, "1.1.1.1", 1, "a.evil.com"), (2, "2.2.2.2", 2, "ok.org"), (3, None, None, None)], "event_id long, client_ip string, asn long, host string")
    listed = spark.createDataFrame([("domain", "evil.com", 60), ("ipv4", "2.2.2.2", 30)], "kind string, indicator string, abuse_score int")
    dear = seen.withColumn("host", F.when(F.rand() < 2, F.raise_error(F.lit("computed"))).cast("string"))
    threat.match_indicators(dear, listed, seen=seen)
    assert rows(threat.match_indicators(seen, listed, seen=seen), "event_id", "abuse_score") == [(1, 60), (2, 30), (3, 0)] == rows(threat.match_indicators(seen, listed), "event_id", "abuse_score")
