import pytest
from pyspark.sql import functions as F

from optelem.operators import lifecycle, rollups
from tests.conftest import events, rows


def sample(spark):
    return events(spark, [("t1", "s", 1, 1, "2024-01-01 00:10:00", 200, 1.0), ("t1", "s", 1, 2, "2024-01-01 01:10:00", 500, 2.0),
                          ("t2", "s", 2, 3, "2024-01-01 00:10:00", 200, 3.0), ("t2", "s", None, 4, "2024-03-01 00:10:00", 200, 4.0)])


def test_gaps_and_repair(spark):
    df = sample(spark)
    full = rollups.hourly_rollup(df)
    stale = (full.where("NOT (tenant_id = 't2' AND hour < '2024-02-01')").withColumn("requests", F.when(F.hour("hour") == 1, 9).otherwise(F.col("requests")).cast("long"))
             .unionByName(full.where("tenant_id = 't2' AND hour > '2024-02-01'").withColumn("tenant_id", F.lit("t9")))
             .withColumn("refreshed_at", F.col("hour") + F.expr("INTERVAL 1 HOUR")))
    gaps = lifecycle.coverage_gaps(df, stale)
    assert rows(gaps, "tenant_id", "problem") == [("t1", "mismatch"), ("t2", "missing"), ("t9", "orphan")]
    assert rows(lifecycle.repair_rollups(df, stale, gaps)) == rows(full)
    fresh = full.withColumn("refreshed_at", F.col("hour") + F.expr("INTERVAL 1 HOUR"))
    assert lifecycle.coverage_gaps(df, fresh).count() == 0
    early = full.withColumn("refreshed_at", F.col("hour"))
    assert rows(lifecycle.coverage_gaps(df, early), "problem") == [("outdated",)] * 4


def test_retention_holds_unmaterialised_hours(spark):
    df = sample(spark).withColumn("class", F.when(F.col("event_id") == 2, "billing").otherwise("telemetry"))
    gaps = spark.createDataFrame([("t2", "2024-01-01 00:00:00")], "tenant_id string, h string").select("tenant_id", F.col("h").cast("timestamp_ntz").alias("hour"))
    assert rows(lifecycle.retention_sweep(df, gaps, "2024-03-01 01:00:00"), "event_id", "verdict") == [(1, "purged"), (2, "kept"), (3, "held"), (4, "kept")]
    edge = lifecycle.retention_sweep(df, gaps.where("false"), "2024-01-31 00:10:00")
    assert rows(edge.where("event_id IN (1, 3)"), "verdict") == [("kept",), ("kept",)]


def test_archive_then_prune(spark, tmp_path):
    table, archive = str(tmp_path / "audit"), str(tmp_path / "archive")
    df = sample(spark).withColumnRenamed("event_time", "at")
    df.write.parquet(table)
    assert lifecycle.archive_then_prune(spark, table, archive, "2024-03-01 01:00:00", 86400) == 3
    assert rows(spark.read.parquet(table), "event_id") == [(4,)] and rows(spark.read.parquet(archive), "event_id") == [(1,), (2,), (3,)]


def test_failed_archive_keeps_rows(spark, tmp_path, monkeypatch):
    table = str(tmp_path / "audit")
    sample(spark).withColumnRenamed("event_time", "at").write.parquet(table)
    real = lifecycle.table_checksum
    calls = []
    monkeypatch.setattr(lifecycle, "table_checksum", lambda df: (calls.append(1), real(df.limit(1) if len(calls) > 1 else df))[1])
    with pytest.raises(RuntimeError):
        lifecycle.archive_then_prune(spark, table, str(tmp_path / "archive"), "2024-03-01 01:00:00", 86400)
    assert spark.read.parquet(table).count() == 4


def test_erase(spark, tmp_path):
    df = sample(spark).withColumn("tenant_id", F.when(F.col("event_id") == 4, F.lit(None)).otherwise(F.col("tenant_id")))
    kept = lifecycle.erase_tenant({"a": df}, "t1")
    assert rows(kept["a"], "event_id") == [(3,), (4,)]
    assert rows(lifecycle.erase_receipt({"a": df}, kept, "t1")) == [("a", 2, 2, 0)]
    path = str(tmp_path / "a")
    df.write.parquet(path)
    assert rows(lifecycle.erase_tenant_files(spark, {"a": path}, "t1")) == [("a", 2, 2, 0)]
    assert rows(spark.read.parquet(path), "event_id") == [(3,), (4,)]


def test_subject_requests(spark):
    df = sample(spark)
    assert lifecycle.subject_export({"tel": df.drop("event_time")}, 1).count() == 2
    assert rows(lifecycle.subject_delete(df, 1), "event_id") == [(3,), (4,)]
    patch = spark.createDataFrame([(3, "fixed", None)], "event_id long, service_id string, status_code int")
    assert rows(lifecycle.subject_rectify(df, patch, ["event_id"]), "event_id", "service_id", "status_code") == [(1, "s", 200), (2, "s", 500), (3, "fixed", 200), (4, "s", 200)]


def test_archive_runs_keep_earlier_ones(spark, tmp_path):
    table, archive = str(tmp_path / "audit"), str(tmp_path / "archive")
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-02-01 00:00:00"), (3, "2024-03-01 00:00:00"), (4, None)], "id long, at string").selectExpr("id", "CAST(at AS timestamp_ntz) AS at")
    df.write.parquet(table)
    assert lifecycle.archive_then_prune(spark, table, archive, "2024-01-15 00:00:00", 86400) == 1
    assert lifecycle.archive_then_prune(spark, table, archive, "2024-01-15 00:00:00", 86400) == 0
    assert lifecycle.archive_then_prune(spark, table, archive, "2024-02-15 00:00:00", 86400) == 1
    assert rows(spark.read.parquet(archive), "id") == [(1,), (2,)] and rows(spark.read.parquet(table), "id") == [(3,), (4,)]


def test_archive_goes_on_after_a_crash_before_the_prune(spark, tmp_path):
    table, archive = str(tmp_path / "audit"), str(tmp_path / "archive")
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-02-01 00:00:00")], "id long, at string").selectExpr("id", "CAST(at AS timestamp_ntz) AS at")
    df.write.parquet(table)
    df.where("id = 1").write.parquet(f"{archive}/run=20240115000000")
    assert lifecycle.archive_then_prune(spark, table, archive, "2024-01-15 00:00:00", 86400) == 1
    assert rows(spark.read.parquet(table), "id") == [(2,)] and rows(spark.read.parquet(archive), "id") == [(1,)]


def files_of(folder):
    return {p: p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_untouched_partitions_keep_their_files(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "d1"), ("b", 2, "d1"), ("b", 3, "d2"), ("a", 4, "d3"), (None, 5, None)], "tenant_id string, n int, day string")
    df.write.partitionBy("day").parquet(str(tmp_path / "t"))
    before = files_of(tmp_path / "t")
    receipt = lifecycle.erase_tenant_files(spark, {"t": str(tmp_path / "t")}, "a", {"t": "day"})
    assert rows(receipt) == [("t", 2, 3, 0)]
    assert rows(spark.read.parquet(str(tmp_path / "t")), "tenant_id", "n", "day") == sorted([("b", 2, "d1"), ("b", 3, "d2"), (None, 5, None)], key=repr)
    after = files_of(tmp_path / "t")
    assert {p for p in before if "day=d2" in str(p) or "DEFAULT" in str(p)} == {p for p in after if before.get(p) == after[p]}
    assert not (tmp_path / "t" / "day=d3").exists()
    assert rows(lifecycle.erase_tenant_files(spark, {"t": str(tmp_path / "t")}, "a", {"t": "day"})) == [("t", 0, 3, 0)]


def test_archive_of_a_partitioned_table(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00", "d1"), (2, "2024-03-01 00:00:00", "d1"), (3, "2024-03-01 00:00:00", "d2")], "id long, at string, day string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    df.write.partitionBy("day").parquet(str(tmp_path / "t"))
    kept = files_of(tmp_path / "t" / "day=d2")
    assert lifecycle.archive_then_prune(spark, str(tmp_path / "t"), str(tmp_path / "a"), "2024-02-01 00:00:00", 86400, partition="day") == 1
    assert rows(spark.read.parquet(str(tmp_path / "t")), "id") == [(2,), (3,)] and files_of(tmp_path / "t" / "day=d2") == kept
