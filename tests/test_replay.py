from pyspark.sql import functions as F

from optelem.streaming.replay import read_out, replay, to_files
from tests.conftest import rows


def test_replay_feeds_every_row_once_in_order(spark):
    df = spark.range(30).select("id", F.when(F.col("id") != 5, F.timestamp_seconds(F.lit(1_700_000_000) - F.col("id")).cast("timestamp_ntz")).alias("at"))
    seen = []

    def start(stream, folders):
        def write(batch, batch_id):
            seen.append(sorted(r["id"] for r in batch.collect()))
            batch.write.mode("append").parquet(folders.out)

        return stream.writeStream.foreachBatch(write).option("checkpointLocation", folders.checkpoint).trigger(availableNow=True).start()

    folders = replay(df, "at", start)
    assert rows(read_out(spark, folders), "id") == sorted(((i,) for i in range(30)), key=repr)
    assert len(seen) == 3 and 5 in seen[0] and 29 in seen[0] and 0 in seen[2]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    again = replay(df, "at", to_files(lambda s: s.where("id < 4")), slices=2, conf={"spark.sql.shuffle.partitions": "3"})
    assert read_out(spark, again).count() == 4 and spark.conf.get("spark.sql.shuffle.partitions") == before
