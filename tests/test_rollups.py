import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from optelem.operators import rollups
from tests.conftest import events, rows


def at(minute, second=0):
    return f"2024-01-01 {minute // 60:02d}:{minute % 60:02d}:{second:02d}"


def test_hourly_and_last_hour(spark):
    df = events(spark, [("t", "s", 1, 1, at(59, 59), 200, 1.5), ("t", "s", 1, 2, at(60), 503, 2.5), ("t", "s", 1, 3, at(61), 499, None)])
    assert rows(rollups.hourly_rollup(df), "avg_latency", "requests", "errors") == [(1.5, 1, 0), (2.5, 2, 1)]
    assert rows(rollups.last_hour_rollup(df, "2024-01-01 02:00:00"), "requests") == [(1,)]
    assert rollups.hourly_rollup(df.where("false")).count() == 0


def test_no_data_is_never_up(spark):
    df = events(spark, [("t", "s", 1, 1, "2024-01-01 00:00:00", 200, 1.0), ("t", "s", 1, 2, "2024-01-03 00:00:00", 500, 1.0), ("t", "s", 1, 3, "2024-01-03 01:00:00", 200, 1.0)])
    out = rollups.fill_no_data(rollups.uptime_daily(df), "2024-01-01", 4)
    assert [(r["state"], r["uptime_pct"]) for r in out.orderBy("day").collect()] == [("operational", 100.0), ("no_data", None), ("degraded", 50.0), ("no_data", None)]


def test_sla_bounds(spark):
    df = events(spark, [("t", "s", 1, i, at(i), 500 if i == 0 else 200, float(i)) for i in range(100)])
    row = rollups.sla_compliance(df, 0.01, 98.01).first()
    assert row["compliant"] and row["p99"] == pytest.approx(98.01) and row["error_rate"] == 0.01
    assert not rollups.sla_compliance(df, 0.009, 1000.0).first()["compliant"]


def test_dimension_subtotals(spark):
    df = events(spark, [("t", "s", 1, i, at(i), 200, float(i)) for i in range(8)]).withColumn("device_type", F.lit("Bot")).withColumn(
        "country", F.when(F.col("event_id") < 4, "A")).withColumn("network_class", F.lit("other"))
    out = {(r["device_type"], r["country"], r["network_class"], r["level"]): (r["p50"], r["n"]) for r in rollups.latency_by_dimension(df).collect()}
    assert out[(None, None, None, 7)] == (3.5, 8) and out[("Bot", "A", "other", 0)] == (1.5, 4) and out[("Bot", None, "other", 0)] == (5.5, 4)
    assert out[(None, None, None, 5)] == (5.5, 4) and out[(None, "A", None, 5)] == (1.5, 4) and len(out) == 7


def test_sketch_error_bound(spark):
    rng = random.Random(1)
    df = events(spark, [("t", "s", 1, i, at(i % 1400), 200, rng.expovariate(0.01)) for i in range(5000)])
    merged = rollups.merged_percentiles(rollups.latency_sketches(df), ["tenant_id"], {"p50": 0.5, "p95": 0.95}).first()
    values = sorted(r["latency_ms"] for r in df.select("latency_ms").collect())
    for p in (0.5, 0.95):
        rank = sum(v <= merged[f"p{int(p * 100)}"] for v in values) / len(values)
        assert abs(rank - p) < 0.02
    assert merged["n"] == 5000


def test_incidents(spark):
    codes = [500, 500, 200, 500, 200, 503, 500, 500]
    df = events(spark, [("t", "s", 1, i, at(i), c, 1.0) for i, c in enumerate(codes)] + [("t", "x", 1, 100, at(0), 500, 1.0)])
    out = rollups.incident_intervals(df)
    assert [(r["started_at"].minute, r["ended_at"] and r["ended_at"].minute, r["failures"], r["duration_s"]) for r in out.orderBy("started_at").collect()] == [
        (0, 2, 2, 120), (5, None, 3, None)]
    assert rows(rollups.mttr(out)) == [("t", "s", 2, 1, 120.0)]


def test_incident_spans_many_chunks(spark):
    df = events(spark, [("t", "s", 1, i, f"2024-01-{1 + i // 24:02d} {i % 24:02d}:30:00", 200 if i in (0, 200) else 500, 1.0) for i in range(201)])
    assert rows(rollups.incident_intervals(df), "failures", "duration_s") == [(199, 199 * 3600)]


def test_status_now(spark):
    df = events(spark, [("t", "a", 1, 1, at(0), 200, 1.0), ("t", "b", 1, 2, at(100), 200, 1.0), ("t", "c", 1, 3, at(100), 500, 1.0), ("t", "b", 1, 4, at(500), 500, 1.0), ("t", "c", 1, 2, at(100), 200, 1.0)])
    assert rows(rollups.status_now(df, "2024-01-01 01:50:00", 3600), "service_id", "state") == [("a", "degraded"), ("b", "operational"), ("c", "down")]


def test_cumulative_window_is_in_days(spark):
    daily = spark.createDataFrame([("t", dt.date(2024, 1, d), 10, d, 1, 0) for d in (1, 2, 5)], "tenant_id string, day date, requests long, errors long, threats long, incidents long")
    out = rollups.cumulative_records(daily, 3).orderBy("day").collect()
    assert [r["running_threats"] for r in out] == [1, 2, 1] and [round(r["running_sla_pct"], 6) for r in out] == [90.0, 85.0, 50.0]


def test_ces_forecast_lowers(spark):
    df = events(spark, [("t", "s", 1, i, at(i * 7), 200, 10.0) for i in range(20)])
    roll, inc = rollups.hourly_rollup(df), rollups.incident_intervals(df)
    calm = rollups.ces_scores(df, roll, inc).first()
    assert (calm["threat"], calm["sla"], calm["stable"], calm["ces"]) == (100.0, 100.0, 100.0, 100.0)
    forecast = spark.createDataFrame([("t", 1.0)], "tenant_id string, forecast double")
    assert rollups.ces_scores(df, roll, inc, forecast=forecast).first()["ces"] == 90.0


def test_series_are_ordered(spark):
    df = events(spark, [("t", "s", 1, i, at(i * 60), 200, float(i)) for i in (3, 1, 2)])
    series = {r["name"]: [(p["x"], p["y"]) for p in r["points"]] for r in rollups.overview_series(rollups.hourly_rollup(df)).collect()}
    assert series["avg_latency"] == [(f"2024-01-01T0{h}:00", float(h)) for h in (1, 2, 3)]


def brute_sliding(data):
    out = {}
    for t, _, _, i, when, *_ in data:
        now = dt.datetime.fromisoformat(when)
        out[i] = sum(1 for u in data if u[0] == t and dt.timedelta(0) <= now - dt.datetime.fromisoformat(u[4]) <= dt.timedelta(seconds=60))
    return out


def test_sliding_rate_across_chunks(spark):
    rng = random.Random(2)
    data = [(rng.choice(["hot", "hot", "x"]), "s", 1, i, at(rng.randrange(25), rng.randrange(60)), 200, 1.0) for i in range(400)]
    out = {r["event_id"]: r["n60"] for r in rollups.sliding_rate(events(spark, data), 5, chunk_seconds=300).collect()}
    assert out == brute_sliding(data)
    short = {r["event_id"]: r["n60"] for r in rollups.sliding_rate(events(spark, data), 5, chunk_seconds=20).collect()}
    assert short == brute_sliding(data)


def brute_bucket(data, capacities):
    out = {}
    for tenant in {d[0] for d in data}:
        cap = capacities.get(tenant, 60)
        tokens, second, used = float(cap), None, 0
        for d in sorted((d for d in data if d[0] == tenant), key=lambda d: (d[4], d[3])):
            sec = int(dt.datetime.fromisoformat(d[4]).timestamp())
            if second is not None and sec > second:
                tokens = min(cap, tokens + (sec - second) * cap / 60)
            second = sec
            ok = tokens >= 1
            tokens -= ok
            out[d[3]] = (ok, int(tokens))
    return out


def test_token_bucket_replay(spark):
    rng = random.Random(4)
    data = [(rng.choice(["hot", "hot", "x", "none"]), "s", 1, i, at(rng.randrange(6), rng.randrange(60)), 200, 1.0) for i in range(600)]
    limits = spark.createDataFrame([("hot", 30), ("x", 12)], "tenant_id string, capacity int")
    out = rollups.token_bucket_audit(events(spark, data), limits)
    got = {r["event_id"]: (r["allowed"], r["remaining"]) for r in out.collect()}
    assert got == brute_bucket(data, {"hot": 30, "x": 12})
    assert all((r["retry_after"] > 0) != r["allowed"] for r in out.collect())


def test_quota(spark):
    df = events(spark, [("t", "s", 1, i, at(0, i % 60), 200, 1.0) for i in range(61)] + [("u", "s", 1, 99, at(0), 200, 1.0)])
    tenants = spark.createDataFrame([("t", "Standard")], "tenant_id string, tier string")
    assert rows(rollups.quota_usage(df, tenants), "tenant_id", "used", "quota", "remaining", "over") == [("t", 61, 60, 0, True), ("u", 1, 60, 59, False)]


def test_health_of_nothing_is_degraded(spark):
    df = events(spark, [("t", "s", 1, 1, at(0), 200, 1.0)])
    out = rollups.ingest_health(df.where("false"), df.where("false"), "2024-01-01 00:00:00", 60, 0.5)
    assert rows(out, "check", "state") == [("dlq_share", "degraded"), ("freshness_lag_s", "degraded")]


PAGES = [(1, "t1", False, False), (2, "t1", True, False), (3, "t2", False, False), (4, "t2", True, False), (5, "t0", False, True)]


@pytest.mark.parametrize("viewer,seen,writable", [
    (rollups.Viewer(is_anonymous=True, tenant_id="t1", role="Operator", amr=("mfa",)), {2, 4, 5}, set()),
    (rollups.Viewer("Viewer", "t1", amr=("mfa",)), {1, 2, 4, 5}, set()),
    (rollups.Viewer("Operator", "t1"), {1, 2, 4, 5}, set()),
    (rollups.Viewer("Operator", "t1", second_factor=True), {1, 2, 4, 5}, {1, 2}),
    (rollups.Viewer("Security Admin", "t0", amr=("pwd", "mfa")), {2, 4, 5}, set()),
    (rollups.Viewer("Operator", None, amr=("mfa",)), {2, 4, 5}, set()),
])
def test_visibility(spark, viewer, seen, writable):
    df = spark.createDataFrame(PAGES, "page_id long, tenant_id string, is_published boolean, is_platform boolean")
    out = rollups.visible_rows(df, viewer).collect()
    assert {r["page_id"] for r in out} == seen and {r["page_id"] for r in out if r["can_write"]} == writable


def test_entitlement_and_billing(spark):
    profiles = spark.createDataFrame([(1, "Pro", True), (2, "Pro", False), (3, "Standard", True)], "account_id long, tier string, subscription_active boolean")
    asks = spark.createDataFrame([(1,), (2,), (3,), (4,), (None,)], "account_id long")
    assert rows(rollups.entitled_rows(asks, profiles).where("entitled"), "account_id") == [(1,)]
    assert rollups.entitled_rows(asks, profiles).count() == 5
    local = spark.createDataFrame([(1, "Standard", "c1"), (2, "Pro", "c2"), (3, "Pro", None), (4, "Pro", "c4"), (5, "Standard", None), (6, "Pro", "c6")], "account_id long, tier string, remote_id string")
    remote = spark.createDataFrame([("c1", "active"), ("c2", "unpaid"), ("c4", "active"), ("c9", "active"), ("c6", "trialing")], "remote_id string, status string")
    out = rollups.reconcile_subscriptions(local, remote)
    assert {r["account_id"]: r["action"] for r in out.collect()} == {1: "upgrade", 2: "downgrade", 3: "manual_grant", 4: "keep", 5: "keep", 6: "keep", None: "orphan_remote"}


def test_rollup_of_values_that_are_no_numbers(spark):
    df = events(spark, [("t", "s", 1, 1, "2024-01-01 00:00:00", 200, float("nan")), ("t", "s", 1, 2, "2024-01-01 00:00:01", 500, float("inf")), ("t", "s", 1, 3, "2024-01-01 00:00:02", 200, 4.0),
                        ("u", "s", 1, 4, "2024-01-01 00:00:00", 200, float("nan"))])
    assert rows(rollups.hourly_rollup(df), "tenant_id", "avg_latency", "requests", "errors") == [("t", 4.0, 3, 1), ("u", None, 1, 0)]


def test_incidents_of_a_service_without_a_name(spark):
    data = [(None, None, 1, i, f"2024-01-01 {h:02d}:00:{s:02d}", code, 1.0) for i, (h, s, code) in enumerate([(0, 0, 500), (0, 1, 500), (0, 20, 200), (5, 0, 500), (5, 1, 500), (5, 20, 200)])]
    assert rows(rollups.incident_intervals(events(spark, data)), "failures", "duration_s") == [(2, 20), (2, 20)]


def test_sliding_rate_takes_one_look_at_each_row(spark):
    import time
    took = {}
    for n in (10_000, 40_000):
        df = spark.range(n).select(F.lit("t").alias("tenant_id"), F.timestamp_micros(F.col("id") * 1000).cast("timestamp_ntz").alias("event_time"), "id").cache()
        df.count()
        start = time.perf_counter()
        found = rollups.sliding_rate(df, 5).agg(F.max("n60"), F.count("*")).first()
        took[n] = time.perf_counter() - start
        assert tuple(found) == (n, n)
    assert took[40_000] < 6 * max(took[10_000], 0.5)
