"""Ingest checks: contracts, attribution, deduplication, dead letters, receipts, privacy."""

from __future__ import annotations

from functools import reduce
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from optelem.functions.times import bucket
from optelem.plans.digests import differing_leaves, digest_tree, framed, rows_in
from optelem.plans.keys import join_on
from optelem.plans.lookups import lookup_side, settle, settled_lookup
from optelem.plans.ordered import last_known
from optelem.plans.percentiles import exact_percentiles
from optelem.plans.spread import spread

# (reason, condition that must hold); the first failing rule names the reason
TELEMETRY_RULES = (
    ("missing_key", "idempotency_key IS NOT NULL"),
    ("missing_latency", "latency_in IS NOT NULL"),
    ("latency_out_of_range", "latency_in BETWEEN 0 AND 480"),
    ("bad_status", "status_code BETWEEN 100 AND 599"),
    ("bad_tenant", "tenant_id RLIKE '^t[0-9]+$'"),
)


def check_contract(df: DataFrame, rules: Sequence[tuple[str, str]] = TELEMETRY_RULES) -> DataFrame:
    """Add `reason`: the first rule the row breaks, NULL for an acceptable row."""
    broken = [F.when(~F.coalesce(F.expr(condition), F.lit(False)), F.lit(reason)) for reason, condition in rules]
    return df.withColumn("reason", F.coalesce(*broken))


def check_metadata(df: DataFrame, allowed: Sequence[str], column: str = "metadata") -> DataFrame:
    """Add `bad_keys` and `reason`: routing tags outside the allow-list, and whatever is no JSON object, reject the row.

    NULL metadata carries no tag and passes.
    """
    keys = F.json_object_keys(column)
    bad = F.array_sort(F.array_except(F.coalesce(keys, F.array().cast("array<string>")), F.array(*[F.lit(k) for k in allowed])))
    malformed = F.col(column).isNotNull() & (keys.isNull() | F.try_parse_json(F.col(column)).isNull())
    return (df.withColumn("bad_keys", F.array_join(bad, ","))
            .withColumn("reason", F.when(malformed, F.lit("metadata_malformed")).when(F.col("bad_keys") != "", F.lit("metadata_not_allowed"))))


def _one_owner(mapping: DataFrame, key: str, owner: str) -> DataFrame:
    """One row per key; a key that is listed for several owners belongs to none."""
    owners = mapping.groupBy(key).agg(F.min(owner).alias("_low"), F.max(owner).alias("_high"))
    return owners.select(key, F.when(F.col("_low") == F.col("_high"), F.col("_low")).alias(owner))


def attribute_host(df: DataFrame, tenants: DataFrame, out: str = "tenant_id") -> DataFrame:
    """Host to tenant; unknown hosts, and those of several tenants, get NULL."""
    side = lookup_side(_one_owner(tenants.select("host", F.col("tenant_id").alias("_mapped")), "host", "_mapped"))
    return df.drop(out).join(side, "host", "left").withColumnRenamed("_mapped", out)


def bind_tenant(df: DataFrame, tenants: DataFrame, claimed: str = "claimed_tenant") -> DataFrame:
    """Claimed tenant must equal the mapped one; anything else is refused."""
    bound = attribute_host(df, tenants, "mapped_tenant")
    reason = (F.when(F.col("mapped_tenant").isNull(), F.lit("unmapped_host"))
              .when(~F.col(claimed).eqNullSafe(F.col("mapped_tenant")), F.lit("tenant_mismatch")))
    return bound.withColumn("reason", reason)


def attribute_key(df: DataFrame, keys: DataFrame, key: str = "sender_key") -> DataFrame:
    """SHA-256 of the sender key looked up among the active keys (key_hash, tenant_id, is_active)."""
    active = keys.where("is_active").select(F.col("key_hash").alias("_hash"), F.col("tenant_id").alias("key_tenant"))
    side = lookup_side(_one_owner(active, "_hash", "key_tenant"))
    hashed = df.withColumn("_hash", F.sha2(F.col(key).cast("binary"), 256))
    return (hashed.join(side, "_hash", "left").drop("_hash", key)
            .withColumn("reason", F.when(F.col("key_tenant").isNull(), F.lit("unknown_key"))))


def rename_family(df: DataFrame, column: str, prefixes: dict[str, str]) -> DataFrame:
    """Product-local identifier prefixes to the universal families."""
    renamed = reduce(lambda c, p: F.regexp_replace(c, f"^{p[0]}", p[1]), prefixes.items(), F.col(column))
    return df.withColumn(column, renamed)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """First row per key in `order`. An aggregate, so repeats of a hot key collapse before the shuffle."""
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row"))
    return picked.select("_row.*")


ARRIVAL = ["received_at", "delivery", "event_id"]


def dedupe(df: DataFrame) -> DataFrame:
    """First arrival per (tenant, idempotency key). Rows without a key repeat nothing and all stay."""
    keyed = first_per_key(df.where(F.col("idempotency_key").isNotNull()), ["tenant_id", "idempotency_key"], ARRIVAL)
    return keyed.unionByName(df.where(F.col("idempotency_key").isNull()))


def upcast(df: DataFrame, steps: dict[int, dict[str, str]]) -> DataFrame:
    """Bring older event versions to the current shape; `steps[v]` holds the expressions from version v to v + 1."""
    for version in sorted(steps):
        old = F.col("version") == version
        names = list(dict.fromkeys([*df.columns, *steps[version]]))
        projected = []
        for name in names:
            current = F.col(name) if name in df.columns else F.lit(None)
            projected.append((F.when(old, F.expr(steps[version][name])).otherwise(current) if name in steps[version]
                              else current).alias(name))
        df = df.select(*projected).withColumn("version", F.when(F.col("version") == version, version + 1).otherwise(F.col("version")))
    return df


def unknown_versions(df: DataFrame, current: int) -> DataFrame:
    """Events of a version that no step leads from."""
    return df.where(F.col("version").isNull() | (F.col("version") > current) | (F.col("version") < 1))


def dead_letters(*rejected: DataFrame, key: str = "idempotency_key", attempts: str = "delivery",
                 payload: Sequence[str] | None = None) -> DataFrame:
    """Rejected rows of any check with error class, original payload and attempts.

    The payload is the whole row as JSON, NULL fields included, so that `rebuilt` can give the event back.
    """
    def shaped(d: DataFrame) -> DataFrame:
        fields = payload or [c for c in d.columns if c != "reason"]
        body = F.to_json(F.struct(*fields), {"ignoreNullFields": "false", "timestampNTZFormat": PAYLOAD_TIME})
        return d.where(F.col("reason").isNotNull()).select(
            "event_id", F.col(key).alias("idempotency_key"), F.col("reason").alias("error_class"), body.alias("payload"), F.col(attempts).cast("int").alias("attempts"))

    return reduce(DataFrame.unionByName, map(shaped, rejected))


PAYLOAD_TIME = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"


def rebuilt(dlq: DataFrame, schema: str) -> DataFrame:
    """The events of dead letters, from their payload."""
    return dlq.select(F.from_json("payload", schema, {"timestampNTZFormat": PAYLOAD_TIME}).alias("_event")).select("_event.*")


def replay(dlq: DataFrame, accepted: DataFrame, cap: int) -> DataFrame:
    """Add `state`: replayable below the attempt cap, exhausted at it, already_accepted when the key got through."""
    done = accepted.select("idempotency_key").distinct().withColumn("_done", F.lit(True))
    state = (F.when(F.col("_done"), F.lit("already_accepted"))
             .when(F.col("attempts") >= cap, F.lit("exhausted")).otherwise(F.lit("replayable")))
    return dlq.join(done, "idempotency_key", "left").withColumn("state", state).drop("_done")


def batch_receipts(df: DataFrame) -> DataFrame:
    """Counts per batch: accepted, duplicate, rejected. `df` carries batch_id and `reason`."""
    valid = df.where(F.col("reason").isNull())
    winners = dedupe(valid.select("tenant_id", "idempotency_key", *ARRIVAL, "batch_id")).groupBy("batch_id").agg(F.count(F.lit(1)).alias("accepted"))
    totals = df.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.count("reason").alias("rejected"))
    joined = totals.join(winners, "batch_id", "left").withColumn("accepted", F.coalesce("accepted", F.lit(0).cast("long")))
    state = F.when(F.col("accepted") == F.col("n"), F.lit("complete")).when(F.col("accepted") > 0, F.lit("partial")).otherwise(F.lit("rejected"))
    return joined.select("batch_id", "n", "accepted", (F.col("n") - F.col("accepted") - F.col("rejected")).alias("duplicate"),
                         "rejected", state.alias("state"))


def changed_keys(sent: DataFrame, landed: DataFrame, key: str, columns: Sequence[str], leaves: DataFrame | None = None) -> DataFrame:
    """key, verdict of the keys whose rows differ: changed, missing or extra, comparing the multisets of rows on both sides.

    Two digest trees are compared level by level; only rows of ranges that differ are opened. `leaves` are those ranges
    where they are known already, as from trees that were written beside the tables.
    """
    if leaves is None:
        leaves = differing_leaves(digest_tree(sent, key, columns), digest_tree(landed, key, columns))

    def shaped(d: DataFrame, is_sent: bool) -> DataFrame:
        return rows_in(d, key, leaves).select(F.col(key).alias("key"), F.sha2(framed(*columns), 256).alias("checksum"), F.lit(int(is_sent)).alias("_s"), F.lit(int(not is_sent)).alias("_l"))

    both = shaped(sent, True).unionByName(shaped(landed, False))
    rows = both.groupBy("key", "checksum").agg(F.sum("_s").alias("_s"), F.sum("_l").alias("_l"))
    per_key = rows.groupBy("key").agg(F.sum("_s").alias("sent"), F.sum("_l").alias("landed"), F.bool_or(F.col("_s") != F.col("_l")).alias("_differs"))
    verdict = F.when(F.col("landed") == 0, F.lit("missing")).when(F.col("sent") == 0, F.lit("extra")).otherwise(F.lit("changed"))
    return per_key.where("_differs").select("key", verdict.alias("verdict"))


def reconcile_checksums(sent: DataFrame, landed: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Per key: match, changed, missing or extra, comparing the multiset of rows on both sides; see `changed_keys`."""
    changed = settle(changed_keys(sent, landed, key, columns))
    matched = join_on(sent.select(F.col(key).alias("key")).distinct(), changed.select("key", F.lit(True).alias("_changed")), ["key"], "left").where("_changed IS NULL")
    return matched.select("key", F.lit("match").alias("verdict")).unionByName(changed)


def quarantine_outliers(df: DataFrame, keys: Sequence[str] = ("tenant_id", "service_id"), value: str = "latency_ms",
                        k: float = 1.5) -> DataFrame:
    """Add `is_outlier`: outside the interquartile fence of the row's group."""
    fences = exact_percentiles(df, list(keys), value, {"_q1": 0.25, "_q3": 0.75}).drop("n")
    joined = join_on(df, settled_lookup(fences), list(keys), "left")
    spread = F.col("_q3") - F.col("_q1")
    outside = (F.col(value) < F.col("_q1") - k * spread) | (F.col(value) > F.col("_q3") + k * spread)
    return joined.withColumn("is_outlier", F.coalesce(outside, F.lit(False))).drop("_q1", "_q3")


# fixed values: patterns of personal data, masked in this order
PII_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ipv4": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
    "phone": r"\+?[0-9][0-9() -]{7,}[0-9]",
}


def redact_pii(df: DataFrame, column: str = "text", key: str = "doc_id") -> DataFrame:
    """Mask e-mail, IPv4 and phone-like strings; `n_hits` counts the masks set."""
    df = spread(df, key)
    text, hits = F.col(column), F.lit(0)
    for name, pattern in PII_PATTERNS.items():
        hits = hits + F.regexp_count(text, F.lit(pattern))
        text = F.regexp_replace(text, pattern, f"<{name}>")
    return df.withColumn("n_hits", hits.cast("int")).withColumn(column, text)


def session_spans(df: DataFrame, user: str, time: str, gap_seconds: int) -> DataFrame:
    """user, chunk, session_no, session_start, session_end, n.

    Two events in one gap-wide chunk always share a session, so events collapse to one row per
    (user, chunk) before any ordering; the window runs over chunks, not over events.
    """
    from pyspark.sql import Window

    chunks = (df.withColumn("chunk", bucket(time, gap_seconds)).groupBy(user, "chunk")
              .agg(F.min(time).alias("first_at"), F.max(time).alias("last_at"), F.count(F.lit(1)).alias("n")))
    by_user = Window.partitionBy(user).orderBy("chunk")
    gap = F.expr(f"INTERVAL '{gap_seconds}' SECOND")
    opens = F.coalesce(F.col("first_at") > F.lag("last_at").over(by_user) + gap, F.lit(True))
    numbered = chunks.withColumn("_opens", opens.cast("int")).withColumn("session_no", F.sum("_opens").over(by_user))
    in_session = Window.partitionBy(user, "session_no")
    return numbered.select(user, "chunk", "session_no", F.min("first_at").over(in_session).alias("session_start"),
                           F.max("last_at").over(in_session).alias("session_end"), "n")


def minimise_ips(df: DataFrame, as_of: str, gap_seconds: int = 1800, user: str = "user_id", time: str = "event_time",
                 ip: str = "client_ip") -> DataFrame:
    """Drop the raw address once the row's session has ended before `as_of`; network and country stay."""
    spans = session_spans(df, user, time, gap_seconds).select(F.col(user).alias("_u"), F.col("chunk").alias("_c"), "session_end")
    keyed = df.withColumn("_chunk", bucket(time, gap_seconds))
    joined = keyed.join(spans, F.col(user).eqNullSafe(F.col("_u")) & (F.col("_chunk") == F.col("_c")), "left")
    ended = F.col("session_end") + F.expr(f"INTERVAL '{gap_seconds}' SECOND") < F.lit(as_of).cast("timestamp_ntz")
    return joined.withColumn(ip, F.when(~ended, F.col(ip))).drop("_chunk", "_u", "_c", "session_end")


def consent_as_of(df: DataFrame, consent: DataFrame, user: str = "user_id", time: str = "event_time") -> DataFrame:
    """Add `consented`: the newest analytical consent at or before the event; none counts as refusal, and so does a NULL user."""
    decisions = (consent.where(F.col(user).isNotNull()).groupBy(F.col(user).alias("_u"), F.col("decided_at").alias("_t"))
                 .agg(F.bool_and("analytical").alias("_consent"))
                 .select("_u", "_t", F.lit(0).alias("_kind"), "_consent"))
    rows = df.select(F.col(user).alias("_u"), F.col(time).alias("_t"), F.lit(1).alias("_kind"), F.struct(*df.columns).alias("_row"))
    both = rows.unionByName(decisions, allowMissingColumns=True)
    filled = last_known(both, ["_u"], ["_t", "_kind"], "_consent", "consented")
    return (filled.where(F.col("_kind") == 1)
            .select("_row.*", F.coalesce("consented", F.lit(False)).alias("consented")))


def consent_gate(df: DataFrame, consent: DataFrame) -> DataFrame:
    """Rows of consenting users, identity kept."""
    return consent_as_of(df, consent).where("consented").drop("consented")


def anonymous_counts(df: DataFrame, consent: DataFrame) -> DataFrame:
    """What the remaining rows may feed: counts per tenant and day without identity."""
    rest = consent_as_of(df, consent).where(~F.col("consented"))
    return rest.groupBy("tenant_id", F.to_date("event_time").alias("day")).agg(F.count(F.lit(1)).alias("n"))


# fixed values: analytics cookie names, `*` stands for any suffix
TRACKING_COOKIES = ("_ga", "_ga_*", "_gid", "_gat*", "_gcl_*", "_clck", "_clsk")


def strip_tracking_cookies(df: DataFrame, header: str = "cookie_header", consented: str = "analytical") -> DataFrame:
    """Remove analytics cookies from logged headers of users without consent."""
    pattern = "^(" + "|".join(name.replace("*", ".*") for name in TRACKING_COOKIES) + ")$"
    parts = F.transform(F.split(F.col(header), ";"), lambda c: F.trim(c))
    kept = F.filter(parts, lambda c: (c != "") & ~F.trim(F.split_part(c, F.lit("="), F.lit(1))).rlike(pattern))
    return df.withColumn(header, F.when(F.coalesce(F.col(consented), F.lit(False)), F.col(header))
                         .otherwise(F.array_join(kept, "; ")))
