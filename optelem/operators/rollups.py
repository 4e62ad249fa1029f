"""Rollups, uptime and SLA records, incidents, scores, quotas, access rules."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from optelem.functions.exact import mean_ms
from optelem.functions.times import bucket, epoch_us, trunc, ts
from optelem.plans.keys import join_on
from optelem.plans.lookups import lookup_side
from optelem.plans.ordered import running_sum
from optelem.plans.percentiles import exact_percentiles


def failed() -> Column:
    """A check failed when the server answered 500 or above."""
    return F.col("status_code") >= 500


def hourly_rollup(df: DataFrame) -> DataFrame:
    """tenant_id, hour, avg_latency, requests, errors."""
    return (df.groupBy("tenant_id", trunc("hour", "event_time").alias("hour"))
            .agg(mean_ms("latency_ms").alias("avg_latency"), F.count(F.lit(1)).alias("requests"),
                 F.count_if(failed()).alias("errors")))


def last_hour_rollup(df: DataFrame, as_of: str) -> DataFrame:
    """avg_latency and requests per tenant over the hour before `as_of`."""
    end = ts(as_of)
    recent = df.where((F.col("event_time") > end - F.expr("INTERVAL 1 HOUR")) & (F.col("event_time") <= end))
    return recent.groupBy("tenant_id").agg(mean_ms("latency_ms").alias("avg_latency"), F.count(F.lit(1)).alias("requests"))


def fast_rows(df: DataFrame, limit_ms: float) -> DataFrame:
    """Successful rows below a latency limit."""
    return df.where((F.col("status_code") < 400) & (F.col("latency_ms") < limit_ms))


def uptime_daily(df: DataFrame) -> DataFrame:
    """Share of successful checks per tenant, service and day, in percent."""
    checks, ok = F.count(F.lit(1)), F.count_if(~failed())
    return (df.groupBy("tenant_id", "service_id", F.to_date("event_time").alias("day"))
            .agg(checks.alias("checks"), (F.lit(100e0) * ok / checks).alias("uptime_pct")))


def fill_no_data(uptime: DataFrame, first_day: str, days: int) -> DataFrame:
    """A complete calendar per tenant and service; a day without checks is `no_data`, never 100 %."""
    span = F.sequence(F.lit(first_day).cast("date"), F.date_add(F.lit(first_day).cast("date"), days - 1))
    calendar = uptime.select("tenant_id", "service_id").distinct().withColumn("day", F.explode(span))
    state = (F.when(F.col("checks").isNull(), F.lit("no_data")).when(F.col("uptime_pct") >= 99e0, F.lit("operational"))
             .when(F.col("uptime_pct") >= 50e0, F.lit("degraded")).otherwise(F.lit("outage")))
    return (calendar.join(uptime, ["tenant_id", "service_id", "day"], "left")
            .select("tenant_id", "service_id", "day", state.alias("state"), "uptime_pct"))


def sla_compliance(df: DataFrame, max_error: float = 0.01, p99_bound: float = 1000.0) -> DataFrame:
    """Error rate and P99 per tenant and day against their bounds."""
    daily = df.withColumn("day", F.to_date("event_time"))
    out = exact_percentiles(daily, ["tenant_id", "day"], "latency_ms", {"p99": 0.99},
                            totals={"requests": F.count(F.lit(1)), "_errors": F.count_if(failed())})
    out = out.withColumn("error_rate", F.col("_errors").cast("double") / F.col("requests"))
    met = (F.col("error_rate") <= max_error) & (F.col("p99") <= p99_bound)
    return out.select("tenant_id", "day", "requests", "error_rate", "p99", F.coalesce(met, F.lit(False)).alias("compliant"))


def latency_by_dimension(df: DataFrame, dims: Sequence[str] = ("device_type", "country", "network_class")) -> DataFrame:
    """p50, p95, p99 by every single dimension, by all together and in total; bit i of `level` is set when dimension i is rolled up.

    Histograms are taken at the finest dimensions and rolled up, so a raw row is looked at once per pass.
    """
    dims = list(dims)
    return exact_percentiles(df.select(*dims, "latency_ms"), dims, "latency_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, groupings=[dims, *[[d] for d in dims], []])


def latency_sketches(df: DataFrame, k: int = 400) -> DataFrame:
    """Mergeable hourly latency sketches."""
    return (df.groupBy("tenant_id", trunc("hour", "event_time").alias("hour"))
            .agg(F.kll_sketch_agg_double("latency_ms", F.lit(k)).alias("sketch"), F.count(F.lit(1)).alias("n")))


def merged_percentiles(sketches: DataFrame, keys: Sequence[str], probs: dict[str, float], k: int = 400) -> DataFrame:
    """Merge hourly sketches to any span and read percentiles off the merged sketch."""
    merged = sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("_s"), F.sum("n").alias("n"))
    return merged.select(*keys, *[F.kll_sketch_get_quantile_double("_s", F.lit(p)).alias(name) for name, p in probs.items()], "n")


def top_origins(df: DataFrame, k: int = 3, key: str = "country") -> DataFrame:
    """Top-k origins per tenant by traffic, with their flagged share."""
    counts = df.groupBy("tenant_id", key).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_malicious").alias("n_flagged"))
    by_traffic = Window.partitionBy("tenant_id").orderBy(F.desc("n"), F.asc(key))
    by_threat = Window.partitionBy("tenant_id").orderBy(F.desc("n_flagged"), F.asc(key))
    ranked = (counts.withColumn("traffic_rank", F.row_number().over(by_traffic))
              .withColumn("threat_rank", F.row_number().over(by_threat)))
    return ranked.where((F.col("traffic_rank") <= k) | (F.col("threat_rank") <= k))


def incident_intervals(df: DataFrame, min_failures: int = 2) -> DataFrame:
    """Runs of consecutive failed checks per tenant and service; the next success closes a run.

    The run number of a row is the number of successes before it, so a run and its closing
    success share a group and no run has to be gathered.
    """
    keys = ["tenant_id", "service_id"]
    rows = df.select(*keys, "event_time", "event_id", failed().alias("_failed"))
    runs = running_sum(rows, keys, ["event_time", "event_id"], (~F.col("_failed")).cast("long"), "run")
    bounds = runs.groupBy(*keys, "run").agg(
        F.count_if("_failed").alias("failures"), F.min(F.when(F.col("_failed"), F.col("event_time"))).alias("started_at"),
        F.max(F.when(~F.col("_failed"), F.col("event_time"))).alias("ended_at"))
    incidents = bounds.where(F.col("failures") >= min_failures)
    seconds = F.expr("timestampdiff(SECOND, started_at, ended_at)")
    return incidents.select(*keys, "started_at", "ended_at", "failures", seconds.alias("duration_s"))


def mttr(incidents: DataFrame) -> DataFrame:
    """Mean seconds to recovery per service; open incidents are counted but not averaged."""
    return incidents.groupBy("tenant_id", "service_id").agg(
        F.count(F.lit(1)).alias("incidents"), F.count_if(F.col("ended_at").isNull()).alias("open_incidents"),
        (F.sum("duration_s").cast("double") / F.count("duration_s")).alias("mttr_s"))


def status_now(df: DataFrame, as_of: str, stale_seconds: int) -> DataFrame:
    """Newest check per service; a stale one is degraded, not healthy."""
    past = df.where(F.col("event_time") <= ts(as_of))
    order = F.struct("event_time", "event_id")
    latest = past.groupBy("tenant_id", "service_id").agg(F.max_by("status_code", order).alias("status_code"),
                                                          F.max("event_time").alias("checked_at"))
    stale = F.col("checked_at") < ts(as_of) - F.expr(f"INTERVAL '{stale_seconds}' SECOND")
    state = F.when(failed(), F.lit("down")).when(stale, F.lit("degraded")).otherwise(F.lit("operational"))
    return latest.withColumn("state", state)


def daily_records(df: DataFrame, incidents: DataFrame) -> DataFrame:
    """tenant_id, day, requests, errors, threats, incidents; `df` carries is_malicious."""
    day = F.to_date("event_time").alias("day")
    traffic = df.groupBy("tenant_id", day).agg(F.count(F.lit(1)).alias("requests"), F.count_if(failed()).alias("errors"),
                                               F.count_if("is_malicious").alias("threats"))
    opened = incidents.groupBy("tenant_id", F.to_date("started_at").alias("day")).agg(F.count(F.lit(1)).alias("incidents"))
    return traffic.join(opened, ["tenant_id", "day"], "left").fillna(0, ["incidents"])


def cumulative_records(daily: DataFrame, days: int = 30) -> DataFrame:
    """Running totals per tenant over the trailing `days` days."""
    numbered = daily.withColumn("_d", F.datediff("day", F.lit("1970-01-01").cast("date")))
    w = Window.partitionBy("tenant_id").orderBy("_d").rangeBetween(-(days - 1), 0)
    total = {c: F.sum(c).over(w) for c in ("requests", "errors", "threats", "incidents")}
    sla = F.lit(100e0) * (1 - total["errors"].cast("double") / total["requests"])
    return numbered.select("tenant_id", "day", sla.alias("running_sla_pct"), total["threats"].alias("running_threats"),
                           total["incidents"].alias("running_incidents"))


def ces_scores(df: DataFrame, rollup: DataFrame, incidents: DataFrame, p99_bound: float = 300.0,
               forecast: DataFrame | None = None) -> DataFrame:
    """Threat, SLA and stableness sub-scores and the weighted master score per tenant, lowered by the forecast."""
    traffic = exact_percentiles(df, ["tenant_id"], "latency_ms", {"_p99": 0.99}, totals={
        "_requests": F.count(F.lit(1)), "_errors": F.count_if(failed()), "_over": F.count_if(F.col("latency_ms") > p99_bound)})
    traffic = (traffic.withColumn("_err", F.col("_errors").cast("double") / F.col("_requests"))
               .withColumn("_slow", F.col("_over").cast("double") / F.col("_requests")))
    hours = rollup.groupBy("tenant_id").agg((F.stddev_samp("avg_latency") / F.avg("avg_latency")).alias("_cv"))
    opened = incidents.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("_inc"))
    joined = traffic.join(hours, "tenant_id", "left").join(opened, "tenant_id", "left")
    joined = (joined.join(forecast.select("tenant_id", F.col("forecast").alias("_f")), "tenant_id", "left") if forecast is not None
              else joined.withColumn("_f", F.lit(0e0)))
    joined = joined.fillna(0, ["_inc", "_cv", "_f"])
    zero = F.lit(0e0)
    scored = (joined
              .withColumn("threat", F.greatest(zero, F.lit(100e0) - 10 * F.col("_inc") - 100 * F.col("_slow")))
              .withColumn("sla", F.lit(100e0) * (1 - F.col("_err")) * F.least(F.lit(1e0), F.try_divide(F.lit(p99_bound), F.col("_p99"))))
              .withColumn("stable", F.greatest(zero, F.lit(100e0) - 5 * F.col("_inc") - 50 * F.col("_cv"))))
    ces = (0.40 * F.col("threat") + 0.35 * F.col("sla") + 0.25 * F.col("stable")) * (1 - 0.1 * F.col("_f"))
    return scored.select("tenant_id", *[F.round(c, 6).alias(c) for c in ("threat", "sla", "stable")], F.round(ces, 6).alias("ces"))


def overview_series(rollup: DataFrame, metrics: Sequence[str] = ("avg_latency", "requests", "errors")) -> DataFrame:
    """Dashboard series: tenant_id, name, points ordered by x. One point per hour bounds a series."""
    long = rollup.select("tenant_id", "hour", *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        ["tenant_id", "hour"], list(metrics), "name", "y")
    points = F.array_sort(F.collect_list(F.struct(F.date_format("hour", "yyyy-MM-dd'T'HH:mm").alias("x"), "y")))
    return long.groupBy("tenant_id", "name").agg(points.alias("points"))


# fixed values: requests per minute by tier
TIER_LIMITS = {"Standard": 60, "Pro": 1000}


def tier_limit(tier: str = "tier", limits: dict[str, int] | None = None):
    limits = limits or TIER_LIMITS
    default = min(limits.values())
    chosen = F.lit(default)
    for name, value in limits.items():
        chosen = F.when(F.col(tier) == name, F.lit(value)).otherwise(chosen)
    return chosen


def quota_usage(df: DataFrame, tenants: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """Requests per tenant and minute against the tier limit; of a tenant that is listed more than once the lowest limit holds."""
    quotas = tenants.select("tenant_id", tier_limit(limits=limits).cast("long").alias("quota")).groupBy("tenant_id").agg(F.min("quota").alias("quota"))
    used = df.groupBy("tenant_id", trunc("minute", "event_time").alias("minute")).agg(F.count(F.lit(1)).alias("used"))
    joined = used.join(lookup_side(quotas), "tenant_id", "left")
    joined = joined.withColumn("quota", F.coalesce("quota", F.lit(min((limits or TIER_LIMITS).values())).cast("long")))
    return joined.select("tenant_id", "minute", "used", "quota", F.greatest(F.lit(0).cast("long"), F.col("quota") - F.col("used")).alias("remaining"),
                         (F.col("used") > F.col("quota")).alias("over"))


def sliding_rate(df: DataFrame, limit: int, span_seconds: int = 60, chunk_seconds: int = 300) -> DataFrame:
    """Requests of the tenant in the trailing span at each request.

    A request counts one from its time and takes it back just after the span, so a running sum tells how many are
    in the span and each row is looked at once. Each tenant is cut into time chunks; requests near a chunk's end are
    also sent to the next chunk, where they count but are not returned.
    """
    span = span_seconds * 1_000_000
    us = df.select(F.struct(*df.columns).alias("_row"), "tenant_id", epoch_us("event_time").alias("_us"), bucket("event_time", chunk_seconds).alias("_chunk"))
    last = F.floor((F.col("_us") + span) / F.lit(chunk_seconds * 1_000_000)).cast("long")
    spread = us.withColumn("_at", F.explode(F.sequence("_chunk", last)))
    nothing = F.lit(None).cast(us.schema["_row"].dataType)
    enters = F.struct(F.col("_us").alias("_t"), F.lit(1).alias("_step"), F.when(F.col("_at") == F.col("_chunk"), F.col("_row")).otherwise(nothing).alias("_row"))
    leaves = F.struct((F.col("_us") + span + 1).alias("_t"), F.lit(-1).alias("_step"), nothing.alias("_row"))
    steps = spread.select("tenant_id", "_at", F.explode(F.array(enters, leaves)).alias("_e")).select("tenant_id", "_at", "_e.*")
    w = Window.partitionBy("tenant_id", "_at").orderBy("_t").rangeBetween(Window.unboundedPreceding, 0)
    counted = steps.withColumn("n60", F.sum("_step").over(w)).where(F.col("_row").isNotNull())
    return counted.select("_row.*", "n60", (F.col("n60") > limit).alias("over"))


def one_limit(limits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, capacity: one row per key; of several limits the lowest holds."""
    return limits.groupBy(*keys).agg(F.min("capacity").alias("capacity"))


def token_bucket_audit(df: DataFrame, limits: DataFrame, keys: Sequence[str] = ("tenant_id",)) -> DataFrame:
    """Replay a token bucket over logged requests: allowed, remaining, retry_after.

    `limits` holds the keys and `capacity` (per minute), the lowest of a key holds. Tokens refill at each whole second, so the
    state changes once per key and second: the sequential replay sees per-second counts only, cut
    wherever an idle minute has certainly refilled the bucket. The verdict of a request follows
    from its position within its second.
    """
    keys = list(keys)
    keyed = (df.join(lookup_side(one_limit(limits, keys)), keys, "left")
             .withColumn("capacity", F.coalesce("capacity", F.lit(min(TIER_LIMITS.values()))))
             .withColumn("_sec", bucket("event_time", 1)))
    seconds = keyed.groupBy(*keys, "capacity", "_sec").agg(F.count(F.lit(1)).alias("_n"))
    by_key = Window.partitionBy(*keys).orderBy("_sec")
    idle = F.coalesce(F.col("_sec") - F.lag("_sec").over(by_key) > 60, F.lit(True)).cast("int")
    cut = seconds.withColumn("_idle", idle).withColumn("_seg", F.sum("_idle").over(by_key)).drop("_idle")
    schema = T.StructType([*cut.select(*keys, "_sec").schema.fields, T.StructField("_tokens", T.DoubleType())])
    ordered = cut.repartition(*keys, "_seg").sortWithinPartitions(*keys, "_seg", "_sec")

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segment, tokens, at = None, 0.0, 0
        for pdf in batches:
            starts = []
            owners = zip(*[pdf[c] for c in (*keys, "_seg")])
            for owner, capacity, sec, n in zip(owners, pdf["capacity"], pdf["_sec"], pdf["_n"]):
                tokens = min(float(capacity), tokens + (sec - at) * capacity / 60.0) if owner == segment else float(capacity)
                starts.append(tokens)
                tokens -= min(float(n), float(int(tokens)))
                segment, at = owner, sec
            yield pdf[[*keys, "_sec"]].assign(_tokens=starts)

    starts = ordered.mapInPandas(replay, schema)
    position = F.row_number().over(Window.partitionBy(*keys, "_sec").orderBy("event_time", "event_id"))
    judged = join_on(keyed.withColumn("_pos", position), starts, [*keys, "_sec"])
    whole = F.floor("_tokens")
    allowed = F.col("_pos") <= whole
    left = F.col("_tokens") - F.least(F.col("_pos").cast("double"), whole.cast("double"))
    retry = F.ceil((F.lit(1e0) - left) / (F.col("capacity") / F.lit(60e0)))
    return (judged.withColumn("allowed", allowed).withColumn("remaining", F.floor(left).cast("long"))
            .withColumn("retry_after", F.when(~allowed, retry.cast("long")).otherwise(F.lit(0).cast("long")))
            .drop("_sec", "_pos", "_tokens"))


def ingest_health(df: DataFrame, dlq: DataFrame, as_of: str, max_lag_seconds: int, max_dlq_share: float, max_dlq_depth: int | None = None,
                  models: DataFrame | None = None, max_model_age_seconds: int = 86400) -> DataFrame:
    """check, value, state; an empty input is degraded, never healthy.

    Freshness of the newest event and share of dead letters; with a bound also their number, and with `models`
    (model_type, trained_at) the age of the model type that was last trained longest ago.
    """
    lag = (df.where(F.col("event_time") <= ts(as_of))
           .agg(F.max("event_time").alias("_newest"))
           .select(F.lit("freshness_lag_s").alias("check"),
                   F.expr(f"timestampdiff(SECOND, _newest, CAST('{as_of}' AS TIMESTAMP_NTZ))").cast("double").alias("value"),
                   F.lit(float(max_lag_seconds)).alias("bound")))
    both = df.select(F.lit(0).alias("_dead")).unionByName(dlq.select(F.lit(1).alias("_dead")))
    totals = both.agg(F.sum("_dead").cast("double").alias("_d"), F.count(F.lit(1)).alias("_n"))
    depth = totals.select(F.lit("dlq_share").alias("check"), F.try_divide(F.col("_d"), F.col("_n") - F.col("_d")).alias("value"),
                          F.lit(max_dlq_share).alias("bound"))
    rows = lag.unionByName(depth)
    if max_dlq_depth is not None:
        rows = rows.unionByName(totals.select(F.lit("dlq_depth").alias("check"), F.coalesce("_d", F.lit(0e0)).alias("value"), F.lit(float(max_dlq_depth)).alias("bound")))
    if models is not None:
        newest = models.where(F.col("trained_at") <= ts(as_of)).groupBy("model_type").agg(F.max("trained_at").alias("_newest"))
        age = F.expr(f"timestampdiff(SECOND, _oldest, CAST('{as_of}' AS TIMESTAMP_NTZ))").cast("double")
        rows = rows.unionByName(newest.agg(F.min("_newest").alias("_oldest")).select(F.lit("model_age_s").alias("check"), age.alias("value"), F.lit(float(max_model_age_seconds)).alias("bound")))
    state = F.when(F.coalesce(F.col("value") <= F.col("bound"), F.lit(False)), F.lit("ok")).otherwise(F.lit("degraded"))
    return rows.select("check", "value", state.alias("state"))


@dataclass(frozen=True)
class Viewer:
    """Who asks: role, own tenant, signed in or not, authentication methods."""

    role: str = "Viewer"
    tenant_id: str | None = None
    is_anonymous: bool = False
    amr: tuple[str, ...] = ()
    second_factor: bool = False

    @property
    def has_mfa(self) -> bool:
        return "mfa" in self.amr or self.second_factor


WRITING_ROLES = ("Operator", "Security Admin")


def visible_rows(rows: DataFrame, viewer: Viewer) -> DataFrame:
    """Rows the viewer may read (published, platform or own tenant) with `can_write`.

    rows: page_id, tenant_id, is_published, is_platform. Platform rows are writable for nobody.
    """
    own = F.lit(False) if viewer.is_anonymous else F.coalesce(F.col("tenant_id") == F.lit(viewer.tenant_id), F.lit(False))
    may_write = viewer.role in WRITING_ROLES and viewer.has_mfa and not viewer.is_anonymous
    seen = rows.where(F.col("is_published") | F.col("is_platform") | own)
    return seen.withColumn("can_write", F.lit(may_write) & own & ~F.col("is_platform"))


def entitled_rows(requests: DataFrame, profiles: DataFrame, paid: Sequence[str] = ("Pro",)) -> DataFrame:
    """Add `entitled`: the account holds an active paid tier."""
    active = (profiles.where(F.col("subscription_active") & F.col("tier").isin(*paid))
              .select("account_id").distinct().withColumn("_ok", F.lit(True)))
    return requests.join(active, "account_id", "left").withColumn("entitled", F.coalesce("_ok", F.lit(False))).drop("_ok")


# fixed values: remote subscription status to local tier
STATUS_TIERS = {"active": "Pro", "canceled": "Standard", "unpaid": "Standard", "past_due": "Standard"}


def reconcile_subscriptions(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Action per account: upgrade, downgrade, keep, manual_grant or orphan_remote; accounts match by stored id only."""
    target = F.lit(None).cast("string")
    for status, tier in STATUS_TIERS.items():
        target = F.when(F.col("status") == status, F.lit(tier)).otherwise(target)
    # accounts without a stored id match nothing; kept apart, they do not pile up on one join key
    stored = local.where(F.col("remote_id").isNotNull()).join(remote.withColumn("_wanted", target), "remote_id", "full_outer")
    joined = stored.unionByName(local.where(F.col("remote_id").isNull()), allowMissingColumns=True)
    action = (F.when(F.col("account_id").isNull(), F.lit("orphan_remote"))
              .when(F.col("remote_id").isNull() & (F.col("tier") == "Pro"), F.lit("manual_grant"))
              .when(F.col("_wanted").isNull(), F.lit("keep"))
              .when((F.col("_wanted") == "Pro") & (F.col("tier") != "Pro"), F.lit("upgrade"))
              .when((F.col("_wanted") != "Pro") & (F.col("tier") == "Pro"), F.lit("downgrade"))
              .otherwise(F.lit("keep")))
    return joined.select("account_id", "remote_id", "tier", "status", action.alias("action"))
