"""Skew-safe building blocks against plain windows and percentiles, with one hot key; and plan shapes."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
import registry
from optelem.plans.lookups import lookup_side
from optelem.plans.ordered import last_known, previous_row, running_sum
from optelem.plans.percentiles import exact_percentiles
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def skewed(spark):
    """3000 rows, one key with two thirds of them, ties in time, NULL values, a NULL key."""
    rng = random.Random(3)
    data = []
    for i in range(3000):
        key = "hot" if rng.random() < 0.66 else rng.choice(["a", "b", None])
        data.append((key, i, rng.randrange(0, 40_000), rng.choice([None, 0.0, -3.5, 1.25, round(rng.expovariate(0.01), 2)])))
    df = spark.createDataFrame(data, "k string, id long, sec long, v double")
    return df.withColumn("t", F.timestamp_seconds(F.col("sec") + 1_700_000_000).cast("timestamp_ntz")).cache()


def by_key():
    return Window.partitionBy("k").orderBy("t", "id")


def keyed(df, col):
    return {r["id"]: r[col] for r in df.select("id", col).collect()}


def test_running_sum(skewed):
    plain = skewed.withColumn("x", F.coalesce(F.sum("sec").over(by_key().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    assert skewed.where("k IS NULL").count() > 1
    assert keyed(running_sum(skewed, ["k"], ["t", "id"], F.col("sec"), "x", 600), "x") == keyed(plain, "x")


def test_previous_row(skewed):
    plain = skewed.withColumn("x", F.lag("id").over(by_key()))
    assert keyed(previous_row(skewed, ["k"], ["t", "id"], {"x": "id"}, 60), "x") == keyed(plain, "x")


def test_last_known(skewed):
    plain = skewed.withColumn("x", F.last("v", ignorenulls=True).over(by_key().rowsBetween(Window.unboundedPreceding, 0)))
    assert keyed(last_known(skewed, ["k"], ["t", "id"], "v", "x", 300), "x") == keyed(plain, "x")


def test_percentiles(skewed):
    probs = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = {r["k"]: r for r in exact_percentiles(skewed, ["k"], "v", probs).collect()}
    want = skewed.groupBy("k").agg(F.count("v").alias("n"), *[F.percentile("v", p).alias(n) for n, p in probs.items()]).collect()
    assert len(got) == len(want) == 4
    for r in want:
        assert got[r["k"]]["n"] == r["n"]
        for name in probs:
            assert got[r["k"]][name] == pytest.approx(r[name], rel=1e-12)


def test_percentiles_of_one_key_with_tiny_values(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("k"), (F.rand(3) * 1e-8 + F.when(F.col("id") % 5 == 0, 1e-8).otherwise(0)).alias("v")).cache()
    probs = {"p1": 0.01, "p50": 0.5, "p999": 0.999}
    got = exact_percentiles(df, ["k"], "v", probs).first()
    want = df.agg(*[F.percentile("v", p).alias(n) for n, p in probs.items()]).first()
    for name in probs:
        assert got[name] == pytest.approx(want[name], rel=1e-12) and got[name] > 0


def test_percentiles_order_slivers_only(spark, monkeypatch):
    from optelem.plans import percentiles
    seen = []
    real = percentiles._holding
    monkeypatch.setattr(percentiles, "_holding", lambda sums, keys, order, probs: seen.append((order, sums)) or real(sums, keys, order, probs))
    df = spark.range(200_000).select(F.lit("hot").alias("k"), F.rand(5).alias("v"))
    exact_percentiles(df, ["k"], "v", {"p50": 0.5}).collect()
    assert dict(seen)["_v"].count() < 100


def test_grouped_percentiles(skewed):
    df = skewed.withColumn("even", (F.col("id") % 2).cast("string"))
    got = exact_percentiles(df, ["k", "even"], "v", {"p": 0.7}, groupings=[["k", "even"], ["k"], []])
    want = df.cube("k", "even").agg(F.percentile("v", 0.7).alias("p"), F.count("v").alias("n"), F.grouping_id("k", "even").cast("int").alias("level")).where("level IN (0, 1, 3)")
    shaped = lambda d: sorted((repr((r["k"], r["even"], r["level"], r["n"])), r["p"]) for r in d.collect())
    for (a, x), (b, y) in zip(shaped(got), shaped(want), strict=True):
        assert a == b and x == pytest.approx(y, rel=1e-12)


def test_weighted_percentiles(skewed):
    counted = skewed.where("v IS NOT NULL").groupBy("k", "v").agg(F.count("*").alias("w"))
    a = exact_percentiles(counted, ["k"], "v", {"p": 0.9}, weight="w").collect()
    assert sorted(a, key=repr) == sorted(exact_percentiles(skewed, ["k"], "v", {"p": 0.9}).collect(), key=repr)


def test_percentiles_of_nothing(skewed):
    assert exact_percentiles(skewed.where("false"), ["k"], "v", {"p": 0.5}).count() == 0


def test_lookup_side_is_checked(spark):
    small, large = spark.range(5), spark.range(50)
    joined = spark.range(10).join(lookup_side(small, 10), "id")
    assert "broadcast" in joined._jdf.queryExecution().logical().toString().lower()
    joined = spark.range(10).join(lookup_side(large, 10), "id")
    assert "broadcast" not in joined._jdf.queryExecution().logical().toString().lower()


PYTHON_ALLOWED = {"token_bucket_audit", "odd_limits", "vector_index_recall", "nearest_to_table", "odd_token_bucket", "pack_batches", "train_per_tenant"}


def plan_of(spark, name):
    return entry_module.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_plan_shape(spark, name):
    execution = entry_module.queries()[name](spark, SMALL)._jdf.queryExecution()
    plan = execution.executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan
    if name not in PYTHON_ALLOWED:
        assert "MapInPandas" not in plan and "FlatMapGroupsInPandas" not in plan and "ArrowEvalPython" not in plan
    # no window orders all rows in one task
    for line in execution.optimizedPlan().toString().splitlines():
        if "Window [" in line:
            parts = line.split("], [")
            assert len(parts) >= 2 and parts[1].strip() and not line.rstrip().endswith("[], []"), line[:300]


def test_pushdown(spark):
    plan = plan_of(spark, "changes_since")
    assert "GreaterThan(event_id,100)" in plan and "ReadSchema: struct<event_id:bigint>" in plan
    plan = plan_of(spark, "hourly_rollup")
    assert "ReadSchema: struct<" in plan and "event_type" in plan
