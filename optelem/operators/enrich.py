"""Enrichment: user agents, networks, sessions, behaviour, complaints, technologies, vulnerabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from optelem.functions.network import ip_to_long, prefix16, url_host
from optelem.functions.times import bucket, epoch_us
from optelem.operators.quality import session_spans
from optelem.plans.lookups import lookup_side, settle, settled_lookup
from optelem.plans.ordered import previous_row

# fixed values: first matching pattern names the class
DEVICE_PATTERNS = {"Bot": "(?i)bot|crawler|spider|curl/|python-requests", "Tablet": "iPad|Tablet", "Mobile": "iPhone|Mobile|Android"}
OS_PATTERNS = {"Windows": "Windows NT", "iOS": "iPhone OS|CPU OS", "Android": "Android", "macOS": "Mac OS X", "Linux": "Linux"}
BROWSER_PATTERNS = {"Edge": "Edg/", "Chrome": "Chrome/", "Firefox": "Firefox/", "Safari": "Safari/"}


def _classify(text: str, patterns: dict[str, str], default: str) -> Column:
    chosen = None
    for name, pattern in patterns.items():
        hit = F.col(text).rlike(pattern)
        chosen = F.when(hit, F.lit(name)) if chosen is None else chosen.when(hit, F.lit(name))
    return chosen.otherwise(F.lit(default))


def parse_user_agent(df: DataFrame, column: str = "user_agent") -> DataFrame:
    """Add device_type, os_name, browser_name, is_bot."""
    device = F.when(F.col(column).isNull(), F.lit("Other")).otherwise(_classify(column, DEVICE_PATTERNS, "Desktop"))
    return (df.withColumn("device_type", device)
            .withColumn("os_name", _classify(column, OS_PATTERNS, "Other"))
            .withColumn("browser_name", _classify(column, BROWSER_PATTERNS, "Other"))
            .withColumn("is_bot", F.col("device_type") == "Bot"))


def geo_asn(df: DataFrame, blocks: DataFrame, ip: str = "client_ip") -> DataFrame:
    """Add country, asn, kind by address range (ip_first..ip_last, disjoint).

    Blocks are laid out per /16 prefix they cover, so an address is compared with the blocks of its
    own prefix only; a table too large to broadcast joins on the prefix, where AQE splits hot ones.
    """
    covered = F.sequence(prefix16(F.col("ip_first")), prefix16(F.col("ip_last")))
    side = blocks.select("country", "asn", "kind", "ip_first", "ip_last", F.explode(covered).alias("_prefix"))
    keyed = df.withColumn("_ip", ip_to_long(ip)).withColumn("_p", prefix16(F.col("_ip")))
    on = (F.col("_p") == F.col("_prefix")) & F.col("_ip").between(F.col("ip_first"), F.col("ip_last"))
    return keyed.join(lookup_side(side), on, "left").drop("_ip", "_p", "_prefix", "ip_first", "ip_last")


def network_class(df: DataFrame, kind: str = "kind") -> DataFrame:
    """Add network_class: datacenter, residential or other."""
    known = F.col(kind).isin("datacenter", "residential")
    return df.withColumn("network_class", F.when(known, F.col(kind)).otherwise(F.lit("other")))


def human_traffic(df: DataFrame) -> DataFrame:
    """Without bots and without datacenter traffic of headless-looking clients."""
    headless = (F.col("network_class") == "datacenter") & (F.col("os_name").isin("Linux", "Other") | (F.col("browser_name") == "Other"))
    return df.where(~F.col("is_bot") & ~headless)


def sessionise(df: DataFrame, gap_seconds: int = 1800, user: str = "user_id", time: str = "event_time") -> DataFrame:
    """Inactivity-gap sessions per user."""
    spans = session_spans(df, user, time, gap_seconds)
    sessions = spans.groupBy(user, "session_no").agg(F.first("session_start").alias("started_at"), F.first("session_end").alias("ended_at"),
                                                     F.sum("n").alias("events"))
    seconds = F.expr("timestampdiff(SECOND, started_at, ended_at)")
    return sessions.select(user, "started_at", "ended_at", seconds.alias("duration_s"), "events")


def behaviour_flags(df: DataFrame, max_regularity: float = 0.3, min_interaction: float = 0.1, min_events: int = 10,
                    interactions: Sequence[str] = ("click", "view")) -> DataFrame:
    """Per user: events, gap_cv (regularity of gaps), interaction_share, is_automated."""
    rows = df.select("user_id", "event_time", "event_id", "event_type").withColumn("us", epoch_us("event_time"))
    gaps = previous_row(rows, ["user_id"], ["event_time", "event_id"], {"prev_us": "us"})
    gap_s = (F.col("us") - F.col("prev_us")) / F.lit(1e6)
    per_user = gaps.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("events"), F.try_divide(F.stddev_samp(gap_s), F.avg(gap_s)).alias("gap_cv"),
        F.count_if(F.col("event_type").isin(*interactions)).alias("_touch"))
    share = F.col("_touch").cast("double") / F.col("events")
    flagged = (F.col("events") >= min_events) & ((F.coalesce("gap_cv", F.lit(1e0)) < max_regularity) | (share < min_interaction))
    return per_user.select("user_id", "events", F.round("gap_cv", 6).alias("gap_cv"), share.alias("interaction_share"), flagged.alias("is_automated"))


# fixed values: complaint vocabulary
INTENT_KEYWORDS = {"not_loading": "would not load|does not load|blank page", "slow": "slow|timeout|timed out", "login": "log in|login|password"}
BROWSER_WORDS = ("Chrome", "Firefox", "Safari", "Edge")


def complaint_entities(df: DataFrame, text: str = "text") -> DataFrame:
    """Add intent, error_code, browser, feature found in free text."""
    def found(pattern: str, group: int = 1) -> Column:
        return F.nullif(F.regexp_extract(F.col(text), pattern, group), F.lit(""))

    return (df.withColumn("intent", _classify(text, INTENT_KEYWORDS, "other"))
            .withColumn("error_code", found("error ([0-9]{3})").cast("int"))
            .withColumn("browser", found("(" + "|".join(BROWSER_WORDS) + ")"))
            .withColumn("feature", found("(svc[0-9]+)")))


def failures_around(filed: DataFrame, failures: DataFrame, window_minutes: int) -> DataFrame:
    """tenant_id, _filed, service_id, status_code, _n: failures within `window_minutes` of each distinct (tenant_id, _filed).

    `failures` holds counts `_n` by tenant_id, service_id, status_code and minute `_at`. Time is cut into blocks as long
    as the window, which then is the end of one block and the beginning of the next, so it follows from two running
    totals and no window is laid out minute by minute. A total runs over one block of one (tenant, service, status),
    which has a few rows for each of its minutes at most, however many events there are.
    """
    length = F.lit(2 * window_minutes + 1)

    def block(minute: Column) -> Column:
        return minute - F.pmod(minute, length)

    low, high = F.col("_filed") - window_minutes, F.col("_filed") + window_minutes
    asked = filed.select("tenant_id", "_filed").distinct()
    ends = (asked.select("tenant_id", "_filed", low.alias("_at"), F.lit(True).alias("_from"))
            .unionByName(asked.where(block(low) != block(high)).select("tenant_id", "_filed", high.alias("_at"), F.lit(False).alias("_from")))
            .withColumn("_block", block(F.col("_at"))))
    placed = failures.withColumn("_block", block(F.col("_at")))
    kinds = placed.select("tenant_id", "_block", "service_id", "status_code").distinct()
    met = ends.join(kinds.hint("merge"), ["tenant_id", "_block"])  # neither side is proven small
    rows = placed.unionByName(met, allowMissingColumns=True)
    whole = Window.partitionBy("tenant_id", "_block", "service_id", "status_code")
    until = whole.orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    before = whole.orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    part = F.when(F.col("_from"), F.coalesce(F.sum("_n").over(whole), zero) - F.coalesce(F.sum("_n").over(before), zero)).otherwise(F.coalesce(F.sum("_n").over(until), zero))
    parts = rows.withColumn("_part", part).where(F.col("_from").isNotNull() & (F.col("_part") > 0))
    return parts.groupBy("tenant_id", "_filed", "service_id", "status_code").agg(F.sum("_part").alias("_n"))


def complaint_root_cause(complaints: DataFrame, df: DataFrame, window_minutes: int = 30) -> DataFrame:
    """Most frequent failure of the complaint's tenant within whole minutes around its filing.

    Failures collapse to per-minute counts and complaints to distinct (tenant, minute) before they
    meet, so a burst of either is counted once.
    """
    failures = (df.where(F.col("status_code") >= 500)
                .groupBy("tenant_id", "service_id", "status_code", bucket("event_time", 60).alias("_at")).agg(F.count(F.lit(1)).alias("_n")))
    filed = complaints.withColumn("_filed", bucket("filed_at", 60))
    counts = failures_around(filed, failures, window_minutes)
    best = counts.groupBy("tenant_id", "_filed").agg(F.min(F.struct((-F.col("_n")).alias("neg"), "service_id", "status_code")).alias("_best"))
    joined = filed.join(best.hint("merge"), ["tenant_id", "_filed"], "left")
    hits = F.coalesce(-F.col("_best.neg"), F.lit(0).cast("long"))
    severity = F.when(hits >= 5, F.lit("high")).when(hits >= 2, F.lit("medium")).when(hits == 1, F.lit("low")).otherwise(F.lit("none"))
    cause = F.when(F.col("_best").isNotNull(), F.concat_ws(":", "_best.service_id", F.col("_best.status_code").cast("string")))
    shaped = joined.select("complaint_id", "tenant_id", F.coalesce(cause, F.lit("unknown")).alias("cause"), hits.alias("hits"), severity.alias("severity"))
    return shaped.withColumn("record", F.to_json(F.struct("complaint_id", "tenant_id", "cause", "severity")))


def safe_targets(urls: DataFrame, approved: DataFrame, url: str = "url") -> DataFrame:
    """Add `reason`, NULL for a target that may be visited. `approved` lists hosts in column `host`."""
    host = url_host(url)
    literal = host.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$")
    reason = (F.when(~F.col(url).rlike("(?i)^https?://"), F.lit("not_web"))
              .when(F.col(url).rlike(r"^[A-Za-z]+://[^/?#]*@"), F.lit("credentials"))
              .when(host.rlike(r"^(localhost|127\.|0\.0\.0\.0$|\[?::1)"), F.lit("loopback"))
              .when(host.rlike(r"^169\.254\.169\.254$|^metadata\."), F.lit("metadata_service"))
              .when(host.rlike(r"^169\.254\."), F.lit("link_local"))
              .when(literal & host.rlike(r"^(10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)"), F.lit("private")))
    ok = lookup_side(approved.select(F.lower("host").alias("_host")).distinct().withColumn("_ok", F.lit(True)))
    joined = urls.withColumn("_host", host).withColumn("_reason", reason).join(ok, "_host", "left")
    final = F.coalesce("_reason", F.when(F.col("_ok").isNull(), F.lit("off_domain")))
    return joined.select(*urls.columns, final.alias("reason"))


def tech_name(column: str) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.trim(F.col(column))), "[^a-z0-9.+#]+", " "))


def tech_evidence(observations: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """One row per tenant, technology, version and site. Earlier evidence stays, so a failed scan deletes nothing."""
    shaped = observations.select("tenant_id", tech_name("tech_name").alias("tech_name"), "version", "site_id", "confidence",
                                 F.col("seen_at").alias("first_seen"), F.col("seen_at").alias("last_seen"))
    both = shaped if previous is None else shaped.unionByName(previous)
    return both.groupBy("tenant_id", "tech_name", "version", "site_id").agg(
        F.max("confidence").alias("confidence"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def tech_inventory(evidence: DataFrame) -> DataFrame:
    """Per tenant, technology and version: sites, best confidence, first and last seen."""
    return evidence.groupBy("tenant_id", "tech_name", "version").agg(
        F.count(F.lit(1)).alias("sites"), F.max("confidence").alias("confidence"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def cpe_string(product: str, version: str | None = None) -> Column:
    tail = F.col(version) if version else F.lit("*")
    return F.concat(F.lit("cpe:2.3:a:*:"), F.regexp_replace(F.col(product), "[^a-z0-9]+", "_"), F.lit(":"), tail, F.lit(":*:*:*:*:*:*:*"))


def _token_sets(df: DataFrame, text: str, out: str) -> DataFrame:
    """Distinct texts with their sorted token sets."""
    return df.select(F.col(text).alias(out)).distinct().withColumn(
        f"{out}_tokens", F.array_sort(F.array_distinct(F.filter(F.split(F.col(out), "[^a-z0-9]+"), lambda t: t != ""))))


def candidate_meetings(products: DataFrame, entries: DataFrame, threshold: float) -> DataFrame:
    """product, product_tokens, entry, entry_tokens of pairs that may reach the Jaccard threshold; a pair may come more than once.

    Tokens are ranked rarest first. The first token that two names share, at place i of a and j of b, leaves at most
    1 + min(a - i, b - j) shared tokens; if even those miss the threshold the pair never meets there. Places and sizes
    are part of the join key: a product row is made only for the (size, place) of entries that hold its token and may
    reach the threshold, so a word that stands in every name, last by rarity, brings no pairs together.
    """
    spread = products.select(F.explode("product_tokens").alias("token")).unionByName(entries.select(F.explode("entry_tokens").alias("token")))
    frequency = settled_lookup(spread.groupBy("token").agg(F.count(F.lit(1)).alias("_freq")))

    def reach(shared: Column, a: Column, b: Column) -> Column:
        return shared.cast("double") / (a + b - shared) >= F.lit(threshold)

    def prefixes(side: DataFrame, name: str) -> DataFrame:
        size = F.size(f"{name}_tokens")
        exploded = side.select(name, f"{name}_tokens", size.alias("_size"), F.explode(f"{name}_tokens").alias("token")).join(frequency, "token")
        placed = exploded.withColumn("_place", F.row_number().over(Window.partitionBy(name).orderBy("_freq", "token")))
        rest = F.col("_size") - F.col("_place") + 1
        return placed.where(reach(rest, F.col("_size"), rest)).drop("_freq")

    right = settle(prefixes(entries, "entry"))
    kinds = right.groupBy("token").agg(F.collect_set(F.struct("_size", "_place")).alias("_kinds"))
    left = prefixes(products, "product").withColumnsRenamed({"_size": "_a", "_place": "_i"}).join(lookup_side(kinds), "token")
    open_kinds = F.filter("_kinds", lambda k: reach(F.least(F.col("_a") - F.col("_i"), k["_size"] - k["_place"]) + 1, F.col("_a"), k["_size"]))
    asked = left.select("product", "product_tokens", "token", F.explode(open_kinds).alias("_k")).select("product", "product_tokens", "token", "_k.*")
    return asked.join(right, ["token", "_size", "_place"]).select("product", "product_tokens", "entry", "entry_tokens")


def cpe_candidates(products: DataFrame, dictionary: DataFrame, threshold: float = 0.5) -> DataFrame:
    """product, cpe, match_kind, similarity: the exact dictionary entry, else the closest token set.

    Both sides are (name) tables of normalised texts. Pairs come from `candidate_meetings` and are scored where they
    meet; meeting twice changes nothing.
    """
    left = _token_sets(products, "name", "product")
    right = _token_sets(dictionary, "name", "entry")
    exact = left.join(right.select(F.col("entry")), F.col("product") == F.col("entry"))
    open_left = left.join(right.select(F.col("entry").alias("product")), "product", "left_anti")
    pairs = candidate_meetings(open_left, right, threshold)
    shared = F.size(F.array_intersect("product_tokens", "entry_tokens"))
    similarity = shared.cast("double") / (F.size("product_tokens") + F.size("entry_tokens") - shared)
    scored = pairs.select("product", "entry", similarity.alias("similarity")).where(F.col("similarity") >= threshold)
    best = scored.groupBy("product").agg(F.min(F.struct((-F.col("similarity")).alias("neg"), "entry")).alias("b"))
    near = best.select("product", F.col("b.entry").alias("entry"), F.lit("tokens").alias("match_kind"), (-F.col("b.neg")).alias("similarity"))
    same = exact.select("product", "entry", F.lit("exact").alias("match_kind"), F.lit(1e0).alias("similarity"))
    return same.unionByName(near).select("product", cpe_string("entry").alias("cpe"), "match_kind", "similarity")


def version_key(column: str) -> Column:
    """Version text as an array of numbers, which Spark orders element by element."""
    return F.transform(F.split(F.regexp_replace(F.col(column), "[^0-9.].*$", ""), r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))


def match_vulnerabilities(inventory: DataFrame, feed: DataFrame) -> DataFrame:
    """tenant_id, product, version, cve_id, cvss. feed: cve_id, product, major_from, major_to, cvss.

    Versions meet the feed once, not once per tenant; only affected versions go back to the tenants.
    """
    owners = inventory.select("tenant_id", F.col("tech_name").alias("product"), "version").distinct()
    versions = owners.select("product", "version").distinct().withColumn("_key", version_key("version"))
    ranges = feed.select("cve_id", F.lower("product").alias("_product"), F.col("cvss").cast("double").alias("cvss"),
                         F.array(F.col("major_from").cast("int")).alias("_from"), F.array((F.col("major_to") + 1).cast("int")).alias("_below"))
    affected = versions.join(ranges, (F.col("product") == F.col("_product")) & (F.col("_key") >= F.col("_from")) & (F.col("_key") < F.col("_below")))
    affected = affected.select("product", "version", "cve_id", "cvss")
    return owners.join(affected, ["product", "version"]).select("tenant_id", "product", "version", "cve_id", "cvss")
