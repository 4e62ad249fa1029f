"""Coverage, repair, retention, archiving, erasure and subject requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from optelem.functions.times import trunc, ts
from optelem.operators.rollups import failed, hourly_rollup
from optelem.plans.lookups import lookup_side, settled_lookup
from optelem.sources.sinks import drop_rows, read_if_present


def coverage_gaps(df: DataFrame, rollups: DataFrame) -> DataFrame:
    """tenant_id, hour, problem: hours whose rollup is missing, outdated, mismatching or without rows.

    `rollups` holds tenant_id, hour, requests, errors, refreshed_at.
    """
    source = df.groupBy("tenant_id", trunc("hour", "event_time").alias("hour")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(failed()).alias("_e"), F.max("event_time").alias("_newest"))
    both = source.join(rollups.select("tenant_id", "hour", "requests", "errors", "refreshed_at"), ["tenant_id", "hour"], "full_outer")
    problem = (F.when(F.col("requests").isNull(), F.lit("missing")).when(F.col("_n").isNull(), F.lit("orphan"))
               .when(F.col("_newest") > F.col("refreshed_at"), F.lit("outdated"))
               .when((F.col("_n") != F.col("requests")) | (F.col("_e") != F.col("errors")), F.lit("mismatch")))
    return both.select("tenant_id", "hour", problem.alias("problem")).where(F.col("problem").isNotNull())


def repair_rollups(df: DataFrame, rollups: DataFrame, gaps: DataFrame) -> DataFrame:
    """Rollups with only the gap hours recomputed; rollups without rows disappear."""
    keys = settled_lookup(gaps.select("tenant_id", "hour").distinct())
    touched = df.withColumn("hour", trunc("hour", "event_time")).join(keys, ["tenant_id", "hour"], "left_semi")
    good = rollups.join(keys, ["tenant_id", "hour"], "left_anti").select("tenant_id", "hour", "avg_latency", "requests", "errors")
    return good.unionByName(hourly_rollup(touched))


# fixed values: seconds a class is kept, None for as long as the account exists
RETENTION_SECONDS = {
    "audit": 30 * 86400,
    "telemetry": 30 * 86400,
    "rate_limit_key": 60,
    "ip_block": 86400,
    "api_key": None,
    "billing": None,
    "tenant_mapping": None,
    "issue_report": None,
}


def retention_sweep(rows: DataFrame, gaps: DataFrame, as_of: str, policy: dict[str, int | None] | None = None,
                    time: str = "event_time", cls: str = "class") -> DataFrame:
    """Add `verdict`: kept, purged, or held when the row is too old but its hour has no sound rollup.

    A class the policy does not name is kept.
    """
    policy = RETENTION_SECONDS if policy is None else policy
    limit = F.lit(None).cast("long")
    for name, seconds in policy.items():
        if seconds is not None:
            limit = F.when(F.col(cls) == name, F.lit(seconds)).otherwise(limit)
    age = F.expr(f"timestampdiff(SECOND, {time}, CAST('{as_of}' AS TIMESTAMP_NTZ))")
    old = F.coalesce(age > limit, F.lit(False))
    open_hours = gaps.select(F.col("tenant_id").alias("_t"), F.col("hour").alias("_h")).distinct()
    keyed = rows.withColumn("_hour", trunc("hour", time))
    joined = keyed.join(settled_lookup(open_hours), (F.col("tenant_id") == F.col("_t")) & (F.col("_hour") == F.col("_h")), "left")
    verdict = F.when(~old, F.lit("kept")).when(F.col("_t").isNotNull(), F.lit("held")).otherwise(F.lit("purged"))
    return joined.select(*rows.columns, verdict.alias("verdict"))


def table_checksum(df: DataFrame) -> DataFrame:
    """One row: rows and an order-independent checksum over all columns."""
    h = F.xxhash64(*df.columns)
    return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string").alias("sum"),
                  F.coalesce(F.bit_xor(h), F.lit(0).cast("long")).alias("xor"))


def past_age(as_of: str, max_age_seconds: int, time: str = "at") -> Column:
    return F.coalesce(F.col(time) < ts(as_of) - F.expr(f"INTERVAL '{max_age_seconds}' SECOND"), F.lit(False))


def due_rows(df: DataFrame, as_of: str, max_age_seconds: int, time: str = "at") -> tuple[DataFrame, DataFrame]:
    """(rows past their age, the others); rows without a time stay."""
    old = past_age(as_of, max_age_seconds, time)
    return df.where(old), df.where(~old)


def archive_then_prune(spark: SparkSession, table: str, archive: str, as_of: str, max_age_seconds: int, time: str = "at", partition: str | None = None) -> int:
    """Copy rows past their age to a folder of `archive` for this run, compare what was read back, and only then rewrite `table` without them.

    Returns the number of archived rows. A run's folder is never replaced: a run without due rows writes none, and one
    that is repeated after a crash goes on if its folder holds just the due rows. A failed comparison raises and
    leaves the table as it was. `spark.read.parquet(archive)` reads all runs. With the table's partition column only
    partitions with due rows are rewritten.
    """
    audit = spark.read.parquet(table)
    due, _ = due_rows(audit, as_of, max_age_seconds, time)
    wanted = table_checksum(due).first()
    if not wanted["n"]:
        return 0
    folder = f"{archive.rstrip('/')}/run={''.join(c for c in as_of if c.isdigit())}"
    if read_if_present(spark, folder, due.schema) is None:
        due.write.mode("errorifexists").parquet(folder)
    found = table_checksum(spark.read.schema(due.schema).parquet(folder)).first()
    if wanted != found:
        raise RuntimeError(f"archive {folder} differs from its source: {found} for {wanted}")
    drop_rows(spark, table, past_age(as_of, max_age_seconds, time), partition)
    return wanted["n"]


def erase_tenant(tables: dict[str, DataFrame], tenant: str) -> dict[str, DataFrame]:
    """What is left of every table without the tenant; rows without a tenant stay."""
    return {name: df.where(~F.col("tenant_id").eqNullSafe(F.lit(tenant))) for name, df in tables.items()}


def erase_receipt(before: dict[str, DataFrame], after: dict[str, DataFrame], tenant: str) -> DataFrame:
    """table_name, removed, kept, remaining per table; remaining must be 0."""
    receipts = []
    for name, df in before.items():
        mine = F.col("tenant_id").eqNullSafe(F.lit(tenant))
        tagged = df.select(mine.alias("_m"), F.lit(0).alias("_after")).unionByName(after[name].select(mine.alias("_m"), F.lit(1).alias("_after")))
        receipts.append(tagged.agg(
            F.count_if(F.col("_m") & (F.col("_after") == 0)).alias("removed"), F.count_if(F.col("_after") == 1).alias("kept"),
            F.count_if(F.col("_m") & (F.col("_after") == 1)).alias("remaining")).select(F.lit(name).alias("table_name"), "removed", "kept", "remaining"))
    out = receipts[0]
    for r in receipts[1:]:
        out = out.unionByName(r)
    return out


def erase_tenant_files(spark: SparkSession, paths: dict[str, str], tenant: str, partitions: dict[str, str] | None = None) -> DataFrame:
    """Take the tenant out of every Parquet table and prove it: rows left raise before any receipt.

    `partitions` names the partition column of tables that have one; of those only partitions with rows of the tenant
    are rewritten.
    """
    counts = []
    mine = F.col("tenant_id").eqNullSafe(F.lit(tenant))
    for name, path in paths.items():
        schema = spark.read.parquet(path).schema
        before = spark.read.schema(schema).parquet(path).agg(F.count_if(mine).alias("mine"), F.count_if(~mine).alias("others")).first()
        if before["mine"]:
            drop_rows(spark, path, mine, (partitions or {}).get(name))
        after = spark.read.schema(schema).parquet(path).agg(F.count_if(mine).alias("mine"), F.count_if(~mine).alias("others")).first()
        if after["mine"] or after["others"] != before["others"]:
            raise RuntimeError(f"{name}: {after['mine']} rows of {tenant} left, {after['others']} of {before['others']} others")
        counts.append((name, before["mine"], after["others"], 0))
    return spark.createDataFrame(counts, "table_name string, removed long, kept long, remaining long")


def subject_export(tables: dict[str, DataFrame], subject: int, key: str = "user_id") -> DataFrame:
    """Everything held about a person: table_name and the row as JSON."""
    parts = [df.where(F.col(key) == F.lit(subject)).select(F.lit(name).alias("table_name"), F.to_json(F.struct(*df.columns)).alias("row_json"))
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def subject_delete(df: DataFrame, subject: int, key: str = "user_id") -> DataFrame:
    return df.where(~F.col(key).eqNullSafe(F.lit(subject)))


def subject_rectify(df: DataFrame, patch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Non-null values of `patch` (one row per key) replace those of the matching rows."""
    fields = [c for c in patch.columns if c not in keys]
    side = lookup_side(patch.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in fields]))
    joined = df.join(side, list(keys), "left")

    def patched(c: str) -> Column:
        return F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in fields else F.col(c)

    return joined.select(*[patched(c) for c in df.columns])
