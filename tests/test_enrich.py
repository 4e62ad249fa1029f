import pytest
from pyspark.sql import functions as F

from optelem.operators import enrich
from tests.conftest import events, rows


def test_user_agents(spark):
    agents = ["Mozilla/5.0 (Windows NT 10.0) Chrome/126.0 Safari/537.36 Edg/126.0", "curl/8.0", "Mozilla/5.0 (iPad; CPU OS 16_6 like Mac OS X) Safari/604.1", None, "",
              "Mozilla/5.0 (Macintosh; Intel Mac OS X 14_5) Version/17.5 Safari/605.1"]
    df = spark.createDataFrame(list(enumerate(agents)), "i int, user_agent string")
    assert rows(enrich.parse_user_agent(df), "i", "device_type", "os_name", "browser_name", "is_bot") == [
        (0, "Desktop", "Windows", "Edge", False), (1, "Bot", "Other", "Other", True), (2, "Tablet", "iOS", "Safari", False),
        (3, "Other", "Other", "Other", False), (4, "Desktop", "Other", "Other", False), (5, "Desktop", "macOS", "Safari", False)]


def test_geo_edges_and_bad_addresses(spark):
    blocks = spark.createDataFrame([("A", 1, "datacenter", 10 * 2**24, 10 * 2**24 + 3 * 65536 - 1), ("B", 2, "business", 10 * 2**24 + 3 * 65536, 10 * 2**24 + 3 * 65536 + 9)],
                                   "country string, asn long, kind string, ip_first long, ip_last long")
    df = spark.createDataFrame([("10.0.0.0",), ("10.2.255.255",), ("10.3.0.0",), ("10.3.0.10",), ("300.1.1.1",), ("text",), (None,), ("1.2.3",)], "client_ip string")
    out = enrich.network_class(enrich.geo_asn(df, blocks))
    assert {r["client_ip"]: (r["country"], r["network_class"]) for r in out.collect()} == {
        "10.0.0.0": ("A", "datacenter"), "10.2.255.255": ("A", "datacenter"), "10.3.0.0": ("B", "other"), "10.3.0.10": (None, "other"),
        "300.1.1.1": (None, "other"), "text": (None, "other"), None: (None, "other"), "1.2.3": (None, "other")}


def test_sessions_split_at_the_gap(spark):
    data = [("t", "s", 1, i, at, 200, 1.0) for i, at in enumerate(["2024-01-01 10:00:00", "2024-01-01 10:30:00", "2024-01-01 11:00:01", "2024-01-01 23:50:00", "2024-01-02 00:10:00"])]
    out = enrich.sessionise(events(spark, data))
    assert [(r["events"], r["duration_s"]) for r in out.orderBy("started_at").collect()] == [(2, 1800), (1, 0), (2, 1200)]


def test_behaviour(spark):
    regular = [("t", "s", 1, i, f"2024-01-01 10:{i:02d}:00", 200, 1.0) for i in range(20)]
    human = [("t", "s", 2, 100 + i, f"2024-01-01 {h:02d}:{m:02d}:00", 200, 1.0) for i, (h, m) in enumerate([(8, 0), (8, 1), (9, 30), (9, 31), (12, 0), (12, 2), (15, 0), (18, 45), (18, 46), (23, 0), (23, 5)])]
    df = events(spark, regular + human).withColumn("event_type", F.lit("view"))
    assert rows(enrich.behaviour_flags(df), "user_id", "events", "is_automated") == [(1, 20, True), (2, 11, False)]


def test_complaints(spark):
    df = spark.createDataFrame([(1, "The svc3 page would not load, error 503 in Chrome"), (2, "so slow today"), (3, None)], "complaint_id long, text string")
    assert rows(enrich.complaint_entities(df), "complaint_id", "intent", "error_code", "browser", "feature") == [
        (1, "not_loading", 503, "Chrome", "svc3"), (2, "slow", None, None, None), (3, "other", None, None, None)]


def test_root_cause_ties_and_windows(spark):
    data = [("t", "b", 1, 1, "2024-01-01 10:00:59", 500, 1.0), ("t", "a", 1, 2, "2024-01-01 10:20:00", 500, 1.0), ("t", "a", 1, 3, "2024-01-01 10:16:00", 200, 1.0),
            ("t", "z", 1, 4, "2024-01-01 09:00:00", 500, 1.0), ("u", "z", 1, 5, "2024-01-01 10:10:00", 500, 1.0)]
    complaints = spark.createDataFrame([(1, "t", "2024-01-01 10:10:30"), (2, "t", "2024-01-01 20:00:00"), (3, "t", "2024-01-01 10:10:59")], "complaint_id long, tenant_id string, at string")
    complaints = complaints.withColumn("filed_at", F.col("at").cast("timestamp_ntz"))
    out = enrich.complaint_root_cause(complaints, events(spark, data), 10)
    assert rows(out, "complaint_id", "cause", "hits", "severity") == [(1, "a:500", 1, "low"), (2, "unknown", 0, "none"), (3, "a:500", 1, "low")]


def test_root_cause_of_any_window(spark):
    """Against a plain count; the longest window has more minutes than an array may have places."""
    import datetime as dt
    import random
    from collections import Counter
    pick, start = random.Random(5), dt.datetime(2024, 1, 1)

    def when():
        return start + dt.timedelta(seconds=pick.randrange(6 * 3600))

    data = [(pick.choice(["t", "u", None]), pick.choice(["a", "b", None]), 1, i, None if i % 41 == 0 else str(when()), pick.choice([200, 500, 503, None]), 1.0) for i in range(300)]
    asks = [(i, pick.choice(["t", "u", "v", None]), None if i % 29 == 0 else str(when())) for i in range(60)]
    complaints = spark.createDataFrame(asks, "complaint_id long, tenant_id string, at string").withColumn("filed_at", F.col("at").cast("timestamp_ntz"))

    def minute(text):
        return (dt.datetime.fromisoformat(text) - start) // dt.timedelta(minutes=1)

    for window in (0, 1, 7, 60, 1_200_000_000):
        want = []
        for i, tenant, at in asks:
            near = Counter((service, status) for t, service, _, _, when_, status, _ in data if at and when_ and t and t == tenant and (status or 0) >= 500 and abs(minute(when_) - minute(at)) <= window)
            best = min(near, key=lambda k: (-near[k], k[0] or "", k[1]), default=None)
            want.append((i, "unknown" if best is None else ":".join(str(x) for x in best if x is not None), near[best] if best else 0))
        assert rows(enrich.complaint_root_cause(complaints, events(spark, data), window), "complaint_id", "cause", "hits") == sorted(want, key=repr)


def test_safe_targets(spark):
    urls = ["https://ok.example.com/x", "http://10.1.2.3/", "http://172.20.0.1/", "http://172.32.0.1/", "http://localhost:80/", "http://169.254.1.1/", "http://169.254.169.254/latest",
            "http://u:p@ok.example.com/", "https://evil.example.org/", "ftp://ok.example.com/", None]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string")
    approved = spark.createDataFrame([("OK.example.com",)], "host string")
    assert [r["reason"] for r in enrich.safe_targets(df, approved).orderBy("i").collect()] == [
        None, "private", "private", "off_domain", "loopback", "link_local", "metadata_service", "credentials", "off_domain", "not_web", "off_domain"]


def test_inventory_keeps_earlier_evidence(spark):
    schema = "tenant_id string, site_id long, tech_name string, version string, confidence double, seen_at date"
    import datetime as dt
    old = enrich.tech_evidence(spark.createDataFrame([("t", 1, "Nginx", "1.2", 0.9, dt.date(2024, 1, 1)), ("t", 2, "Redis", "7.0", 0.5, dt.date(2024, 1, 1))], schema))
    new = spark.createDataFrame([("t", 1, " nginx ", "1.2", 0.4, dt.date(2024, 2, 1)), ("t", 3, "NGINX", "1.2", 0.4, dt.date(2024, 2, 1))], schema)
    out = enrich.tech_inventory(enrich.tech_evidence(new, old))
    assert rows(out, "tech_name", "sites", "confidence", "first_seen", "last_seen") == [
        ("nginx", 2, 0.9, dt.date(2024, 1, 1), dt.date(2024, 2, 1)), ("redis", 1, 0.5, dt.date(2024, 1, 1), dt.date(2024, 1, 1))]


def test_cpe_token_matches_are_exact(spark):
    """Prefix candidates miss no pair above the threshold."""
    import itertools
    import random
    rng = random.Random(5)
    words = ["server", "web", "http", "db", "cache", "proxy", "apache", "edge"]
    names = sorted({" ".join(rng.sample(words, rng.randint(1, 4))) for _ in range(60)})
    products, entries = names[::2], names[1::2]
    best = {}
    for p, e in itertools.product(products, entries):
        a, b = set(p.split()), set(e.split())
        sim = len(a & b) / len(a | b)
        if sim >= 0.5:
            best[p] = min(best.get(p, (0, "")), (-sim, e))
    out = enrich.cpe_candidates(spark.createDataFrame([(p,) for p in products], "name string"), spark.createDataFrame([(e,) for e in entries], "name string"))
    got = {r["product"]: (r["similarity"], r["cpe"]) for r in out.collect()}
    assert got.keys() == best.keys()
    for p, (neg, e) in best.items():
        assert abs(got[p][0] + neg) < 1e-9 and e.replace(" ", "_") in got[p][1]


def test_a_word_in_every_name_brings_no_pairs(spark):
    """1,500 products and 1,500 entries that all hold one word: meetings stay below ten times the results."""
    names = lambda k: spark.range(1500).select(F.concat(F.lit("server "), F.concat_ws(" ", *[F.concat(F.lit(f"{c}"), F.col("id").cast("string")) for c in k])).alias("name"))
    products, entries = names("ab"), names("abc")
    left, right = enrich._token_sets(products, "name", "product"), enrich._token_sets(entries, "name", "entry")
    out = enrich.cpe_candidates(products, entries)
    assert out.count() == 1500 and out.agg(F.min("similarity"), F.max("similarity")).first()[:] == (0.75, 0.75)
    assert enrich.candidate_meetings(left, right, 0.5).count() <= 10 * 1500


@pytest.mark.parametrize("threshold", [0.3, 0.55, 0.7, 1.0])
def test_no_pair_is_lost_at_any_threshold(spark, threshold):
    import random
    rng = random.Random(3)
    names = sorted({" ".join(sorted(rng.sample([f"w{i}" for i in range(12)], rng.randint(1, 11)))) for _ in range(120)})
    left, right = spark.createDataFrame([(n,) for n in names[::2]], "name string"), spark.createDataFrame([(n,) for n in names[1::2] + names[:3]], "name string")
    a, b = enrich._token_sets(left, "name", "product"), enrich._token_sets(right, "name", "entry")
    met = {(r["product"], r["entry"]) for r in enrich.candidate_meetings(a, b, threshold).collect()}
    for p in names[::2]:
        for e in names[1::2] + names[:3]:
            x, y = set(p.split()), set(e.split())
            assert len(x & y) / len(x | y) < threshold or (p, e) in met


def test_version_ranges(spark):
    inv = spark.createDataFrame([("t", "x", "9.9"), ("t", "x", "10.0.1"), ("t", "x", "15.9-rc1"), ("t", "x", "16"), ("t", "x", "")], "tenant_id string, tech_name string, version string")
    feed = spark.createDataFrame([("CVE-1", "X", 10, 15, 5.0)], "cve_id string, product string, major_from int, major_to int, cvss double")
    assert rows(enrich.match_vulnerabilities(inv, feed), "version") == [("10.0.1",), ("15.9-rc1",)]
