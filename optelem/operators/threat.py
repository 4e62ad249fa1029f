"""Threat intelligence, signals and cases, response decisions, findings and sharing bundles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from optelem.functions.network import host_suffixes
from optelem.functions.times import bucket, epoch_us, trunc, ts
from optelem.plans.keys import join_on
from optelem.plans.lookups import lookup_side, settle, settled_lookup
from optelem.plans.spread import spread


def merge_feeds(*feeds: DataFrame, as_of: str, life_hours: int = 24 * 30) -> DataFrame:
    """Newest entry per (kind, indicator) over all feeds, expired ones dropped."""
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds)
    seen = union.where(F.col("listed_at") <= ts(as_of))
    newest = seen.groupBy("kind", "indicator").agg(
        F.max_by(F.struct("feed", "abuse_score", "listed_at"), F.struct("listed_at", "feed", "abuse_score")).alias("e"))
    alive = F.col("e.listed_at") > ts(as_of) - F.expr(f"INTERVAL '{life_hours}' HOUR")
    return newest.where(alive).select("kind", "indicator", "e.feed", "e.abuse_score", "e.listed_at")


def match_indicators(df: DataFrame, indicators: DataFrame, min_score: int = 25, seen: DataFrame | None = None) -> DataFrame:
    """Add abuse_score (the highest of address, ASN and domain indicators) and is_malicious. `df` carries client_ip, asn, host.

    A domain indicator covers the host itself and everything below it; each distinct host is looked up once, under
    all its suffixes. The hosts are read from `seen`, rows that hold those of `df` at least and are cheaper to read, by
    default from `df` itself.
    """
    keyed = df.withColumn("_ipv4", F.col("client_ip")).withColumn("_asn", F.col("asn").cast("string")).withColumn("_domain", F.col("host"))
    indicators = settle(indicators.select("kind", "indicator", "abuse_score"))

    def highest(kind: str) -> DataFrame:
        return indicators.where(F.col("kind") == kind).groupBy(F.col("indicator").alias(f"_{kind}")).agg(F.max("abuse_score").alias(f"_{kind}_score"))

    domains = highest("domain").withColumn("_suffix", F.lower("_domain")).select("_suffix", "_domain_score")
    hosts = (df if seen is None else seen).select(F.col("host").alias("_domain")).distinct().withColumn("_suffix", F.explode(host_suffixes(F.col("_domain"))))
    by_host = settle(hosts.join(lookup_side(domains), "_suffix").groupBy("_domain").agg(F.max("_domain_score").alias("_domain_score")))
    for kind, side in (("ipv4", highest("ipv4")), ("asn", highest("asn")), ("domain", by_host)):
        keyed = keyed.join(lookup_side(side), f"_{kind}", "left")
    score = F.greatest("_ipv4_score", "_asn_score", "_domain_score")
    return (keyed.withColumn("abuse_score", F.coalesce(score, F.lit(0)).cast("int"))
            .withColumn("is_malicious", F.coalesce(score >= min_score, F.lit(False)))
            .select(*df.columns, "abuse_score", "is_malicious"))


def blocked_spans(listings: DataFrame, life_seconds: int = 86400) -> DataFrame:
    """indicator, start, end: overlapping listings merged, so an address has disjoint spans.

    Listings inside one life-wide chunk always overlap, which bounds the ordered part to one row
    per address and chunk.
    """
    chunks = (listings.withColumn("_c", bucket("listed_at", life_seconds)).groupBy("indicator", "_c")
              .agg(F.min("listed_at").alias("_first"), F.max("listed_at").alias("_last")))
    by_ip = Window.partitionBy("indicator").orderBy("_c")
    life = F.expr(f"INTERVAL '{life_seconds}' SECOND")
    opens = F.coalesce(F.col("_first") > F.lag("_last").over(by_ip) + life, F.lit(True)).cast("int")
    spans = chunks.withColumn("_o", opens).withColumn("_no", F.sum("_o").over(by_ip))
    return spans.groupBy("indicator", "_no").agg(F.min("_first").alias("start"), (F.max("_last") + life).alias("end")).drop("_no")


def block_list_as_of(df: DataFrame, listings: DataFrame, life_seconds: int = 86400) -> DataFrame:
    """Add `blocked`: the address was on the block list when it connected.

    Spans are laid out by day, so the join key is (address, day) and a busy address is spread.
    """
    spans = blocked_spans(listings.where(F.col("kind") == "ipv4"), life_seconds).withColumnRenamed("indicator", "_ip")
    days = F.sequence(F.to_date("start"), F.to_date("end"))
    side = spans.withColumn("_day", F.explode(days))
    keyed = df.withColumn("_at", F.to_date("event_time"))
    on = ((F.col("client_ip") == F.col("_ip")) & (F.col("_at") == F.col("_day"))
          & (F.col("event_time") >= F.col("start")) & (F.col("event_time") < F.col("end")))
    joined = keyed.join(lookup_side(side), on, "left")
    return joined.select(*df.columns, F.col("_ip").isNotNull().alias("blocked"))


def trace_back(df: DataFrame, listings: DataFrame) -> DataFrame:
    """What each flagged address touched before it was first listed."""
    first = (listings.where(F.col("kind") == "ipv4").groupBy(F.col("indicator").alias("client_ip")).agg(F.min("listed_at").alias("listed_at")))
    joined = df.join(lookup_side(first), "client_ip").where(F.col("event_time") < F.col("listed_at"))
    return joined.groupBy("client_ip", "tenant_id", "service_id").agg(
        F.count(F.lit(1)).alias("hits"), F.min("event_time").alias("first_at"), F.max("event_time").alias("last_at"))


# fixed values: signal kind to threat categories and platform response
SIGNAL_CATEGORIES = {
    "indicator": ("S", "D"),
    "automation": ("S",),
    "anonymiser": ("LM", "S"),
    "breached_credential": ("S", "E"),
    "brand_mention": ("I",),
    "volumetric_scrape": ("D",),
    "cross_tenant_read": ("I", "LM"),
}
SIGNAL_RESPONSES = {
    "indicator": "raise_score_and_throttle",
    "automation": "challenge_or_sever",
    "anonymiser": "restrict_sensitive_routes",
    "breached_credential": "force_mfa_and_alert",
    "brand_mention": "open_incident_and_share",
    "volumetric_scrape": "rate_limit_and_penalise",
    "cross_tenant_read": "highest_severity_triage",
}
CATEGORY_NAMES = {"S": "Spoofing", "T": "Tampering", "R": "Repudiation", "I": "Information Disclosure",
                  "D": "Denial of Service", "E": "Elevation of Privilege", "LM": "Lateral Movement"}


def _literal_map(values: dict[str, Column]) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])


def tag_stride(signals: DataFrame, kind: str = "signal") -> DataFrame:
    """One row per signal and category, with the category name and the platform response."""
    categories = _literal_map({k: F.array(*[F.lit(c) for c in v]) for k, v in SIGNAL_CATEGORIES.items()})
    responses = _literal_map({k: F.lit(v) for k, v in SIGNAL_RESPONSES.items()})
    names = _literal_map({k: F.lit(v) for k, v in CATEGORY_NAMES.items()})
    exploded = (signals.withColumn("category", F.explode(F.try_element_at(categories, F.col(kind))))
                .withColumn("response", F.try_element_at(responses, F.col(kind))))
    return exploded.withColumn("category_name", F.try_element_at(names, F.col("category")))


def stride_trend(tagged: DataFrame, time: str = "event_time") -> DataFrame:
    """Hourly counts per tenant and category, and the change against the previous hour (a missing hour counts 0)."""
    hourly = tagged.groupBy("tenant_id", "category", trunc("hour", time).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("tenant_id", "category").orderBy("hour")
    adjacent = F.lag("hour").over(w) == F.col("hour") - F.expr("INTERVAL 1 HOUR")
    before = F.when(adjacent, F.lag("n").over(w)).otherwise(F.lit(0).cast("long"))
    return hourly.withColumn("delta", F.col("n") - before)


def email_hash(column: str = "email") -> Column:
    return F.sha2(F.lower(F.trim(F.col(column))), 256)


def breach_match(accounts: DataFrame, breaches: DataFrame) -> DataFrame:
    """Accounts whose normalised, hashed e-mail is in a breach corpus."""
    leaked = breaches.select(email_hash().alias("email_hash")).distinct()
    return accounts.withColumn("email_hash", email_hash()).join(leaked, "email_hash", "left_semi").select("account_id", "tenant_id", "email_hash")


def _words(c: str) -> Column:
    return F.filter(F.split(F.lower(F.col(c)), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _first(words: str, n: Column | int) -> Column:
    return F.array_join(F.slice(words, 1, n), " ")


MAX_DEPTH = 31  # doubling depths of a trie, more than an array can hold words


def term_trie(wanted: DataFrame) -> DataFrame:
    """prefix, lengths, goes_on: the first 1, 2, 4, 8... words of terms, the lengths of terms with that prefix that are
    shorter than twice of it, and whether longer ones share it. wanted: _w (words), _len."""
    depths = F.filter(F.array(*[F.lit(2 ** j) for j in range(MAX_DEPTH - 1)]), lambda d: d <= F.col("_len"))
    levels = wanted.select("_w", "_len", F.explode(depths).alias("_depth"))
    short = F.col("_len") < F.col("_depth").cast("long") * 2
    return levels.groupBy(_first("_w", F.col("_depth")).alias("prefix")).agg(F.collect_set(F.when(short, F.col("_len"))).alias("lengths"), F.bool_or(~short).alias("goes_on"))


def term_starts(tokens: DataFrame, trie: DataFrame, longest: int) -> DataFrame:
    """doc_id, _rest, _lengths: positions whose words begin a term, the words from there, and the lengths still possible.

    tokens: doc_id, _w. A position walks the trie at depths 1, 2, 4, ... and goes on only while a longer term shares its
    words, so a length is proposed only where its term's first half stands. With a small trie this is one pass over the
    texts; with one too large to broadcast, positions travel with at most `longest` words each.
    """
    root = lookup_side(trie)
    if root is trie:
        starts = F.transform(F.sequence(F.lit(1), F.size("_w")), lambda i: F.slice("_w", i, longest))
        rows = tokens.where(F.size("_w") > 0).select("doc_id", F.explode(starts).alias("_rest")).withColumn("_at", F.col("_rest")[0])
        walk = rows.join(root, F.col("_at") == F.col("prefix"))
    else:
        rows = tokens.select("doc_id", "_w", F.posexplode("_w").alias("_pos", "_at"))
        walk = rows.join(root, F.col("_at") == F.col("prefix")).withColumn("_rest", F.slice("_w", F.col("_pos") + 1, longest))
    walk = walk.select("doc_id", "_rest", F.col("lengths").alias("_lengths"), F.col("goes_on").alias("_on"))
    depth = 2
    while depth <= longest:
        here = F.when(F.col("_on") & (F.size("_rest") >= depth), _first("_rest", depth))
        found = walk.withColumn("_at", here).join(root, F.col("_at") == F.col("prefix"), "left")
        more = F.when(F.col("lengths").isNull(), F.col("_lengths")).otherwise(F.concat("_lengths", "lengths"))
        walk = found.select("doc_id", "_rest", more.alias("_lengths"), F.coalesce("goes_on", F.lit(False)).alias("_on"))
        depth *= 2
    return walk.select("doc_id", "_rest", F.filter("_lengths", lambda n: n <= F.size("_rest")).alias("_lengths"))


def brand_mentions(documents: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, term, n: whole-word occurrences of brand terms, over whole texts.

    Texts walk a trie of the terms; only positions that begin a term become rows, see `term_starts`.
    """
    shaped = terms.select(_words("term").alias("_w")).where(F.size("_w") > 0).withColumn("_len", F.size("_w"))
    wanted = settle(shaped.select(F.array_join("_w", " ").alias("term"), "_w", "_len").distinct())
    longest = wanted.agg(F.max("_len")).first()[0] or 1
    tokens = spread(documents.select("doc_id", text), "doc_id").select("doc_id", _words(text).alias("_w"))
    starts = term_starts(tokens, term_trie(wanted), longest)
    proposed = starts.select("doc_id", "_rest", F.explode("_lengths").alias("_n")).select("doc_id", _first("_rest", F.col("_n")).alias("term"))
    return proposed.join(lookup_side(wanted.select("term")), "term").groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))


def traffic_spikes(df: DataFrame, key: str = "asn", buckets: int = 24, min_buckets: int = 6, limit: float = 3.0) -> DataFrame:
    """Hourly volume per key against the trailing buckets."""
    hourly = df.where(F.col(key).isNotNull()).groupBy(key, trunc("hour", "event_time").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(key).orderBy("hour").rowsBetween(-buckets, -1)
    scored = (hourly.withColumn("_k", F.count(F.lit(1)).over(w)).withColumn("_m", F.avg("n").over(w))
              .withColumn("_s", F.stddev_samp("n").over(w)))
    z = F.when(F.col("_k") >= min_buckets, F.try_divide(F.col("n") - F.col("_m"), F.nullif(F.col("_s"), F.lit(0e0))))
    return scored.select(key, "hour", "n", F.round(z, 6).alias("z"), F.coalesce(z > limit, F.lit(False)).alias("is_spike"))


def global_baseline(df: DataFrame, as_of: str, days: int = 90, min_tenants: int = 5, by: str | None = None) -> DataFrame:
    """failure_rate and suspicious_ratio across tenants, no identifiers; groups of too few tenants are suppressed."""
    recent = df.where((F.col("event_time") <= ts(as_of)) & (F.col("event_time") > ts(as_of) - F.expr(f"INTERVAL '{days}' DAY")))
    group = F.col(by) if by else F.lit("all").alias("segment")
    per_tenant = recent.groupBy(group.alias("segment"), "tenant_id").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("status_code") >= 500).alias("_f"), F.count_if("is_malicious").alias("_m"))
    return (per_tenant.groupBy("segment").agg(
        F.count(F.lit(1)).alias("n_tenants"),
        (F.sum("_f").cast("double") / F.sum("_n")).alias("failure_rate"), (F.sum("_m").cast("double") / F.sum("_n")).alias("suspicious_ratio"))
        .where(F.col("n_tenants") >= min_tenants))


def tenant_vs_global(df: DataFrame, baseline: DataFrame, min_rows: int = 100) -> DataFrame:
    """Tenant ratios against the one-row baseline, and the weight of its main location; thin tenants get the zero-threat level."""
    by_place = df.groupBy("tenant_id", "country").agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("status_code") >= 500).alias("_f"),
                                                      F.count_if("is_malicious").alias("_m"))
    tenant = by_place.groupBy("tenant_id").agg(
        F.sum("_n").alias("requests"), (F.sum("_f").cast("double") / F.sum("_n")).alias("failure_rate"),
        (F.sum("_m").cast("double") / F.sum("_n")).alias("suspicious_ratio"),
        (F.max("_n").cast("double") / F.sum("_n")).alias("top_location_weight"))
    usual = baseline.where(F.col("segment") == "all")
    failure, suspicious = usual.select("failure_rate").scalar(), usual.select("suspicious_ratio").scalar()
    level = (F.when(F.col("requests") < min_rows, F.lit("zero"))
             .when((F.col("suspicious_ratio") > suspicious) & (F.col("failure_rate") > failure), F.lit("high"))
             .when((F.col("suspicious_ratio") > suspicious) | (F.col("failure_rate") > failure), F.lit("elevated")).otherwise(F.lit("normal")))
    return tenant.withColumn("level", level)


def cross_tenant_attempts(audit: DataFrame) -> DataFrame:
    """Audit rows aimed at another tenant, per actor and target; a success is the most severe."""
    foreign = audit.where(~F.col("actor_tenant").eqNullSafe(F.col("target_tenant")))
    grouped = foreign.groupBy("actor", "actor_tenant", "target_tenant").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") == "ok").alias("succeeded"),
        F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    return grouped.withColumn("severity", F.when(F.col("succeeded") > 0, F.lit("critical")).otherwise(F.lit("high")))


TAG = "array<struct<rule:string,entity:string,window_start:timestamp_ntz,window_end:timestamp_ntz,threshold:int>>"
UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def _micros(span: str) -> int:
    number, unit = span.split()
    return int(number) * UNIT_SECONDS[unit.rstrip("s")] * 1_000_000


# rule: (name, condition, entity column, window, slide, threshold)
SIEM_RULES = (
    ("error_burst", "status_code >= 500", "service_id", "1 hour", "1 hour", 5),
    ("credential_stuffing", "event_type = 'signup'", "client_ip", "1 day", "1 day", 2),
    ("volumetric_scrape", "event_type IN ('view', 'click')", "user_id", "2 hours", "30 minutes", 3),
)


def siem_signals(df: DataFrame, rules: Sequence[tuple] = SIEM_RULES, time: str = "event_time") -> DataFrame:
    """rule, tenant_id, entity, window_start, window_end, n for windows at or above their rule's threshold.

    One scan and one shuffle for all rules: a row is tagged with the (rule, entity, window) it counts for.
    """
    tags = []
    for name, condition, entity, size, slide, threshold in rules:
        width, step = (F.expr(f"CAST(INTERVAL '{x.split()[0]}' {x.split()[1].rstrip('s')} AS INTERVAL DAY TO SECOND)") for x in (size, slide))
        us = epoch_us(time)
        step_us, width_us = (_micros(x) for x in (slide, size))
        newest = F.floor(us / F.lit(step_us)).cast("long")
        oldest = F.floor((us - F.lit(width_us)) / F.lit(step_us)).cast("long") + 1
        starts = F.transform(F.sequence(oldest, newest), lambda k: F.timestamp_micros(k * F.lit(step_us)).cast("timestamp_ntz"))
        own = F.transform(starts, lambda s: F.struct(F.lit(name).alias("rule"), F.col(entity).cast("string").alias("entity"), s.alias("window_start"),
                                                     (s + width).alias("window_end"), F.lit(threshold).alias("threshold")))
        tags.append(F.when(F.expr(condition), own).otherwise(F.array().cast(TAG)))
    tagged = df.select("tenant_id", F.explode(F.flatten(F.array(*tags))).alias("_tag")).select("tenant_id", "_tag.*")
    counted = tagged.groupBy("rule", "tenant_id", "entity", "window_start", "window_end", "threshold").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= F.col("threshold")).select("rule", "tenant_id", "entity", "window_start", "window_end", "n")


def siem_cases(signals: DataFrame, gap_hours: int, as_of: str) -> DataFrame:
    """Signals of one entity whose windows lie less than a gap apart form a case."""
    by_entity = Window.partitionBy("tenant_id", "entity").orderBy("window_start", "window_end", "rule")
    seen_until = F.max("window_end").over(by_entity.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.expr(f"INTERVAL '{gap_hours}' HOUR")
    opens = F.coalesce(F.col("window_start") > seen_until + gap, F.lit(True)).cast("int")
    numbered = signals.withColumn("_o", opens).withColumn("case_no", F.sum("_o").over(by_entity))
    cases = numbered.groupBy("tenant_id", "entity", "case_no").agg(
        F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("rules"), F.count(F.lit(1)).alias("signals"),
        F.min("window_start").alias("started_at"), F.max("window_end").alias("last_seen_at"), F.max("n").alias("peak"))
    severity = F.when(F.col("rules").contains(","), F.lit("high")).when(F.col("signals") > 1, F.lit("medium")).otherwise(F.lit("low"))
    state = F.when(F.col("last_seen_at") + gap < ts(as_of), F.lit("closed")).otherwise(F.lit("open"))
    case_id = F.sha2(F.concat_ws("|", "tenant_id", "entity", F.date_format("started_at", "yyyyMMddHHmmss")), 256)
    return cases.select(case_id.alias("case_id"), "tenant_id", "entity", "rules", "signals", "started_at", "last_seen_at", severity.alias("severity"), state.alias("state"))


def audit_summary(audit: DataFrame) -> DataFrame:
    """Attempts by tenant, actor, action and outcome with subtotals; `level` 0 is the finest."""
    return audit.rollup("actor_tenant", "actor", "action", "outcome").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level"))


# fixed values: (score from, score below, action)
RESPONSE_POLICY = ((0.0, 0.5, "allow"), (0.5, 0.7, "throttle"), (0.7, 0.9, "challenge"), (0.9, None, "block"))


def response_actions(scores: DataFrame, policy: Sequence[tuple] = RESPONSE_POLICY, review_from: float = 0.7, score: str = "score") -> DataFrame:
    """Add `action` by score range and `in_review` above the tenant's threshold (column review_from, else the default)."""
    chosen = F.lit(None).cast("string")
    for low, high, action in policy:
        inside = F.col(score) >= low if high is None else (F.col(score) >= low) & (F.col(score) < high)
        chosen = F.when(inside, F.lit(action)).otherwise(chosen)
    threshold = F.coalesce(F.col("review_from"), F.lit(review_from)) if "review_from" in scores.columns else F.lit(review_from)
    return scores.withColumn("action", chosen).withColumn("in_review", F.coalesce(F.col(score) >= threshold, F.lit(False)))


def playbook_timeline(actions: DataFrame, cap: int = 3, backoff_seconds: int = 30) -> DataFrame:
    """Action results of a run in order (`seq`), with retry eligibility and the next retry time."""
    eligible = (F.col("state") == "failed") & (F.col("attempts") < cap)
    wait = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.lit(backoff_seconds) * F.pow(F.lit(2), "attempts")).cast("decimal(18,6)"))
    return (actions.withColumn("retry_eligible", F.coalesce(eligible, F.lit(False)))
            .withColumn("next_retry_at", F.when(eligible, F.col("updated_at") + wait)))


def playbook_runs(actions: DataFrame, cap: int = 3, backoff_seconds: int = 30) -> DataFrame:
    """Run state from its action results; counts and extremes only, so a run may hold any number of results."""
    timeline = playbook_timeline(actions, cap, backoff_seconds)
    runs = timeline.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("actions"), F.count_if(F.col("state") == "succeeded").alias("succeeded"),
        F.count_if(F.col("state") == "failed").alias("failed"), F.count_if("retry_eligible").alias("retry_eligible"),
        F.min("next_retry_at").alias("next_retry_at"), F.max_by("state", "seq").alias("last_state"))
    waiting = F.col("actions") - F.col("succeeded") - F.col("failed")
    state = (F.when(F.col("succeeded") == F.col("actions"), F.lit("succeeded")).when(F.col("retry_eligible") > 0, F.lit("retrying"))
             .when(waiting > 0, F.lit("waiting")).otherwise(F.lit("failed")))
    return runs.withColumn("run_state", state)


UNKNOWN_IMPACT = 3


def triage_board(findings: DataFrame, active: DataFrame) -> DataFrame:
    """Findings per tenant with priority, dense rank and board column.

    findings: tenant_id, product, version, cve_id, cvss. active: tenant_id of tenants under active
    attack. Ranks are dense over the vulnerabilities of a tenant, whose number the feed bounds. A finding without a
    CVSS has a middling impact and ranks after scored ones of its priority.
    """
    hot = lookup_side(active.select("tenant_id").distinct().withColumn("_active", F.lit(1)))
    scored = findings.join(hot, "tenant_id", "left").withColumn("has_active_intel", F.col("_active").isNotNull()).drop("_active")
    impact = F.when(F.col("cvss").isNull(), F.lit(UNKNOWN_IMPACT)).otherwise(F.greatest(F.lit(1), F.least(F.lit(5), F.ceil(F.col("cvss") / 2).cast("int"))))
    scored = scored.withColumn("priority", impact * (F.lit(2) + 3 * F.col("has_active_intel").cast("int")))
    w = Window.partitionBy("tenant_id").orderBy(F.desc("priority"), F.desc("cvss"), F.asc("cve_id"))
    ranks = scored.select("tenant_id", "cve_id", "cvss", "priority").distinct().withColumn("rank", F.dense_rank().over(w))
    lane = F.when(F.col("priority") >= 20, F.lit("now")).when(F.col("priority") >= 8, F.lit("next")).otherwise(F.lit("backlog"))
    return join_on(scored, ranks, ["tenant_id", "cve_id", "cvss", "priority"]).withColumn("column", lane)


def stix_objects(findings: DataFrame, listings: DataFrame, created: str) -> DataFrame:
    """tenant_id, object_id, object_json: identity, indicator and observed-data objects with ids that repeat on every run."""
    def stable_id(kind: str, *parts: str) -> Column:
        h = F.sha2(F.concat_ws("|", F.lit(kind), *[F.col(p).cast("string") for p in parts]), 256)
        pieces = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)),
                  F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12)]
        return F.concat(F.lit(f"{kind}--"), F.concat_ws("-", *pieces))

    def shaped(df: DataFrame, kind: str, ident: Column, **fields: Column) -> DataFrame:
        common = [F.lit(kind).alias("type"), F.lit("2.1").alias("spec_version"), ident.alias("id"),
                  F.lit(created).alias("created"), F.lit(created).alias("modified")]
        body = F.to_json(F.struct(*common, *[c.alias(n) for n, c in fields.items()]))
        return df.select("tenant_id", ident.alias("object_id"), body.alias("object_json"))

    tenants = findings.select("tenant_id").unionByName(listings.select("tenant_id")).distinct()
    identity = shaped(tenants, "identity", stable_id("identity", "tenant_id"), name=F.col("tenant_id"), identity_class=F.lit("organization"))
    flagged = listings.select("tenant_id", "indicator").distinct()
    pattern = F.concat(F.lit("[ipv4-addr:value = '"), F.col("indicator"), F.lit("']"))
    indicator = shaped(flagged, "indicator", stable_id("indicator", "tenant_id", "indicator"), pattern=pattern,
                       pattern_type=F.lit("stix"), valid_from=F.lit(created))
    software = findings.select("tenant_id", "product", "version").distinct()
    refs = F.array(stable_id("software", "product", "version"))
    observed = shaped(software, "observed-data", stable_id("observed-data", "tenant_id", "product", "version"), number_observed=F.lit(1),
                      first_observed=F.lit(created), last_observed=F.lit(created), object_refs=refs)
    return identity.unionByName(indicator).unionByName(observed)


def stix_bundle(objects: DataFrame, max_objects: int = 500) -> DataFrame:
    """tenant_id, page, n_objects, bundle_json. A tenant's objects spread over as many hashed pages as its count needs."""
    sizes = objects.groupBy("tenant_id").agg(F.ceil(F.count(F.lit(1)) / F.lit(max_objects)).cast("long").alias("_pages"))
    paged = objects.join(settled_lookup(sizes), "tenant_id").withColumn("page", F.pmod(F.xxhash64("object_id"), F.col("_pages")))
    parts = paged.groupBy("tenant_id", "page").agg(
        F.count(F.lit(1)).alias("n_objects"), F.array_sort(F.collect_list(F.struct("object_id", "object_json"))).alias("_o"))
    body = F.array_join(F.transform("_o", lambda o: o["object_json"]), ",")
    ident = F.concat(F.lit("bundle--"), F.md5(F.concat_ws("|", "tenant_id", F.col("page").cast("string"))))
    bundle = F.concat(F.lit('{"type":"bundle","id":"'), ident, F.lit('","objects":['), body, F.lit("]}"))
    return parts.select("tenant_id", "page", "n_objects", bundle.alias("bundle_json"))
