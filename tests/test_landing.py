"""Receipts and ticks that are counted while their rows are written."""


from pyspark.sql import functions as F

from optelem.operators import quality
from optelem.sources import landing
from tests.conftest import SMALL, rows
from tests.test_quality import raw


def judged(spark, data):
    return quality.check_contract(raw(spark, data))


DATA = [(1, "t1", "t1", "h", "a", 1, "2024-01-01 00:00:00", 1.0, 200), (1, "t1", "t1", "h", "a", 2, "2024-01-01 00:01:00", 1.0, 200),
        (1, "t1", "t1", "h", "a", 1, "2024-01-01 00:00:00", 1.0, 200), (2, "t1", "t1", "h", "b", 1, "2024-01-01 00:00:00", None, 200), (3, "t2", "t2", "h", "a", 1, "2024-01-01 00:00:00", 2.0, 200)]


def test_receipt_equals_the_batch_operator(spark, tmp_path):
    batch = judged(spark, DATA)
    for _ in range(2):
        receipt = landing.land_batch(batch, "x", str(tmp_path / "good"), str(tmp_path / "bad"))
        want = quality.batch_receipts(batch.withColumn("batch_id", F.lit("x")))
        assert rows(receipt, *want.columns) == rows(want) == [("x", 5, 2, 2, 1, "partial")]
    good = spark.read.parquet(str(tmp_path / "good"))
    assert rows(good, "event_id", "delivery") == [(1, 1), (3, 1)] and good.columns == [c for c in batch.columns if c != "reason"]
    assert rows(spark.read.parquet(str(tmp_path / "bad")), "event_id", "error_class") == [(2, "missing_latency")]


def test_receipt_of_odd_batches(spark, tmp_path):
    batch = judged(spark, DATA)
    empty = landing.land_batch(batch.where("false"), "e", str(tmp_path / "a"), str(tmp_path / "b"))
    assert rows(empty) == [("e", 0, 0, 0, 0, "rejected")]
    whole = landing.land_batch(batch.where("event_id = 3"), "w", str(tmp_path / "a"), str(tmp_path / "b"))
    assert rows(whole) == [("w", 1, 1, 0, 0, "complete")]
    # rows without a key repeat nothing, even equal ones
    keyless = batch.where("event_id = 1").withColumn("idempotency_key", F.lit(None).cast("string"))
    assert rows(landing.land_batch(keyless, "k", str(tmp_path / "a"), str(tmp_path / "b"))) == [("k", 3, 3, 0, 0, "complete")]


def test_many_partitions_and_copies(spark, tmp_path):
    batch = judged(spark, DATA).crossJoin(spark.range(300).select(F.col("id").alias("_i"))).drop("_i").repartition(40)
    receipt = landing.land_batch(batch, "m", str(tmp_path / "a"), str(tmp_path / "b"))
    assert rows(receipt) == [("m", 1500, 2, 1198, 300, "partial")]


def test_no_scan_but_the_two_writes(spark, tmp_path):
    """Two jobs' worth of reads: the source is read once for the accepted rows and once for the dead letters."""
    judged(spark, DATA).write.parquet(str(tmp_path / "in"))
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    source = spark.read.parquet(str(tmp_path / "in"))
    counted = source.mapInPandas(count, source.schema)
    landing.land_batch(counted, "x", str(tmp_path / "good"), str(tmp_path / "bad")).collect()
    assert read.value == 2 * len(DATA)


def test_ticks_come_after_their_rows(spark, tmp_path):
    source = spark.read.parquet(f"{SMALL}/events.parquet").select("event_id").repartition(3)
    source.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        landing.ticking_batches(stream, "event_id", str(tmp_path / "rows"), str(tmp_path / "ticks"), str(tmp_path / "ck")).awaitTermination(240)
    ticks, written = spark.read.parquet(str(tmp_path / "ticks")), spark.read.parquet(str(tmp_path / "rows"))
    assert rows(ticks.select("batch", "count", "cursor")) == rows(written.groupBy("batch").agg(F.count("*").alias("count"), F.max("event_id").alias("cursor")))
    assert ticks.count() == 3 and written.count() == source.count()
