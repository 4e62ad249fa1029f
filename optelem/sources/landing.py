"""Writes that count themselves: receipts and ticks come from metrics observed in the pass that writes, not from a second scan.

A metric is observed behind the last shuffle of its write, in the stage that writes the files. Spark counts each task of
that stage once, however often it runs; a metric ahead of a shuffle would count tasks again that a lost executor repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from optelem.operators.quality import ARRIVAL, dead_letters


def write_counted(df: DataFrame, path: str, metrics: dict[str, Column], leave_out: tuple[str, ...] = (), fmt: str = "parquet", mode: str = "overwrite",
                  **options) -> dict:
    """Write `df` without the columns `leave_out` and return `metrics`, aggregates over the rows written."""
    seen = Observation()
    observed = df.observe(seen, *[m.alias(name) for name, m in metrics.items()]).drop(*leave_out)
    observed.write.mode(mode).format(fmt).options(**options).save(path)
    return seen.get


def land_batch(judged: DataFrame, batch_id: str, accepted: str, rejected: str) -> DataFrame:
    """Write the first arrivals and the dead letters of one batch; its receipt (as `batch_receipts` gives it) counts in those two writes.

    judged: rows with `reason`. Both targets are replaced, so a batch that runs again gives the same files and receipt.
    An empty batch is rejected with zero rows. Rows without a key repeat nothing.
    """
    valid = judged.where(F.col("reason").isNull()).drop("reason")
    alone = F.when(F.col("idempotency_key").isNull(), F.struct(*ARRIVAL, F.xxhash64(*valid.columns)))
    picked = valid.groupBy("tenant_id", "idempotency_key", alone.alias("_alone")).agg(
        F.min_by(F.struct(*valid.columns), F.struct(*ARRIVAL)).alias("_row"), F.count(F.lit(1)).alias("_copies"))
    kept = F.when(F.col("_alone").isNotNull(), F.col("_copies")).otherwise(F.lit(1))
    firsts = picked.withColumn("_kept", kept).select("_row.*", F.explode(F.sequence(F.lit(1).cast("long"), "_kept")).alias("_nth"), "_copies", "_kept")
    counts = {"accepted": F.count(F.lit(1)), "duplicate": F.sum(F.when(F.col("_nth") == 1, F.col("_copies") - F.col("_kept")))}
    won = write_counted(firsts, accepted, counts, ("_nth", "_copies", "_kept"))
    lost = write_counted(dead_letters(judged), rejected, {"rejected": F.count(F.lit(1))})
    good, twice, bad = won["accepted"] or 0, won["duplicate"] or 0, lost["rejected"] or 0
    n = good + twice + bad
    state = "rejected" if not good else "complete" if good == n else "partial"
    return judged.sparkSession.range(1).select(
        F.lit(batch_id).alias("batch_id"), *[F.lit(v).cast("long").alias(c) for c, v in (("n", n), ("accepted", good), ("duplicate", twice), ("rejected", bad))],
        F.lit(state).alias("state"))


def ticking_batches(stream: DataFrame, cursor: str, out: str, ticks: str, checkpoint: str, **trigger) -> StreamingQuery:
    """`write_batches` and `live_ticks` in one pass: a folder of rows per micro-batch in `out`, its {count, cursor} row in `ticks`.

    A tick is written after its rows, so it never announces rows that are not there; a batch that runs again replaces both.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        seen = write_counted(batch, f"{out}/batch={batch_id}", {"count": F.count(F.lit(1)), "cursor": F.max(cursor)})
        top = batch.schema[cursor].dataType
        tick = batch.sparkSession.range(1).select(F.lit(seen["count"]).cast("long").alias("count"), F.lit(seen["cursor"]).cast(top).alias("cursor"))
        tick.coalesce(1).write.mode("overwrite").parquet(f"{ticks}/batch={batch_id}")

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
