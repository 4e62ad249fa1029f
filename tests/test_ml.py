import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from optelem.operators import ml, rollups
from tests.conftest import events, rows


def separable(spark, n=200):
    rng = random.Random(9)
    data = []
    for i in range(n):
        x = [rng.random(), rng.random(), rng.random()]
        data.append((f"t{i % 3}", i, x, int(x[0] + x[1] > 1)))
    return spark.createDataFrame(data, "tenant_id string, hour long, features array<double>, label int")


def roll(spark, values, tenant="t"):
    data = [(tenant, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float(v), 10, int(e)) for i, (v, e) in enumerate(values)]
    df = spark.createDataFrame(data, "tenant_id string, h timestamp, avg_latency double, requests long, errors long")
    return df.select("tenant_id", F.col("h").cast("timestamp_ntz").alias("hour"), "avg_latency", "requests", "errors")


def test_features(spark):
    df = events(spark, [("t", "s", 1, 1, "2024-01-01 05:00:00", 200, 10.0), ("t", "s", 1, 2, "2024-01-01 05:10:00", 500, 20.0), ("t", "s", 1, 3, "2024-01-01 07:00:00", 200, 40.0)])
    first, second = ml.window_features(df).orderBy("hour").collect()
    assert (first["latency_delta"], first["latency_variance"], first["error_rate"], first["hour_of_day"], first["peak_share"]) == (None, 50.0, 0.5, 5, 1.0)
    assert (second["moving_avg_latency"], second["latency_delta"], second["latency_variance"], second["peak_share"]) == (27.5, 25.0, None, 0.5)
    arrays = ml.labelled(ml.window_features(df), 0.25).orderBy("hour").collect()
    assert [(r["hour"].hour, r["label"]) for r in arrays] == [(5, 0)] and len(arrays[0]["features"]) == len(ml.FEATURES)


def test_pages(spark):
    rows_ = ml.feature_pages(separable(spark, 10), 2).where("tenant_id = 't0'").orderBy("hour").collect()
    assert [(r["page"], r["pos"]) for r in rows_] == [(0, 0), (0, 1), (1, 0), (1, 1)]


@pytest.mark.parametrize("fit", [ml.fit_sla_model, ml.fit_threat_model])
def test_classifiers_learn(spark, fit):
    data = separable(spark)
    scored = ml.probabilities(data, fit(data))
    right = scored.where((F.col("score") > 0.5) == (F.col("label") == 1)).count()
    assert right >= 190 and scored.where("score < 0 OR score > 1").count() == 0


def test_ces_model_is_clamped(spark):
    data = spark.createDataFrame([(i / 50, i / 100, float(i % 5), 150.0 - 6 * i) for i in range(40)], "failure_rate double, suspicious_ratio double, incidents double, target double")
    out = ml.ces_predictions(data, ml.fit_ces_model(data))
    assert out.where("score < 0 OR score > 100").count() == 0 and out.agg(F.max("score") - F.min("score")).first()[0] > 50


def test_forecast_extremes(spark):
    flat = ml.spike_forecast(roll(spark, [(5, 0)] * 30)).collect()
    assert {r["forecast"] for r in flat} == {0.0}
    busy = ml.spike_forecast(roll(spark, [(0, 0)] + [(100, 10)] * 40)).orderBy("hour").collect()
    assert busy[-1]["forecast"] == 1.0
    burst = ml.spike_forecast(roll(spark, [(0, 0)] * 10 + [(100, 10)] + [(0, 0)] * 10), seq_len=24).orderBy("hour").collect()
    assert burst[9]["forecast"] == 0 and burst[10]["forecast"] == pytest.approx(1 / 12, abs=1e-6)


def test_anomaly(spark):
    out = ml.anomaly_scores(roll(spark, [(10, 0), (11, 0), (9, 0), (10, 0), (12, 0), (100, 0)])).orderBy("hour").collect()
    assert out[-1]["score"] == 1.0 and all(r["score"] < 0.5 for r in out[:-1])
    assert {r["score"] for r in ml.anomaly_scores(roll(spark, [(5, 0)] * 4)).collect()} == {0.0}


def test_projection(spark):
    df = events(spark, [("t", "s", 1, d * 10 + i, f"2024-01-{d:02d} 00:00:00", 200, 1.0) for d in range(1, 6) for i in range(10)])
    df = df.withColumn("is_malicious", F.col("event_id") % 10 < F.dayofmonth("event_time"))
    out = ml.forecast_30d(df, 7).orderBy("day").collect()
    assert [r["forecast"] for r in out] == [0.6, 0.7, 0.8, 0.9, 1.0, 1.0, 1.0] and out[0]["day"] == dt.date(2024, 1, 6)


def test_grid_search_finds_the_known_best(spark):
    rng = random.Random(1)
    data = []
    for _ in range(150):
        x = [rng.random(), rng.random()]
        data.append((x, 3 * x[0] - x[1]))
    df = spark.createDataFrame(data, "features array<double>, label double")
    table, best = ml.grid_search(df, {"regParam": [0.0, 1.0, 10.0]}, folds=3)
    assert best["regParam"] == 0.0 and table.count() == 3 and table.where("is_best").count() == 1
    assert table.where("is_best").first()["loss"] == table.agg(F.min("loss")).first()[0]


def test_grid_search_against_fitted_models(spark):
    """Losses by sums equal those of Spark's own regression fitted and judged fold by fold; a constant feature, an offset one and odd rows are in it."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression
    rng = random.Random(9)
    data = []
    for i in range(240):
        x = [rng.gauss(0, 1), 50 + rng.gauss(0, 4), 7.0, rng.random()]
        data.append((i, x + [x[0] * 0.5 + rng.gauss(0, 0.3)], 2 * x[0] - 0.3 * x[1] + rng.gauss(0, 1)))
    df = spark.createDataFrame(data, "i int, features array<double>, label double")
    odd = spark.createDataFrame([(0, None, 1.0), (1, [1.0, float("nan"), 7.0, 0.0, 0.0], 1.0), (2, [1.0, 1.0, 7.0, 0.0, 0.0], None), (3, [1.0, None, 7.0, 0.0, 0.0], 2.0)], df.schema)
    grid = {"regParam": [0.0, 0.3, 2.0], "elasticNetParam": [0.0, 0.5, 1.0]}
    table, best = ml.grid_search(df.unionByName(odd), grid, fold=F.col("i") % 3)
    got = {r["params"]: r["loss"] for r in table.collect()}
    shaped = df.withColumn("v", array_to_vector("features")).cache()
    for reg in grid["regParam"]:
        for alpha in grid["elasticNetParam"]:
            losses = []
            for held in range(3):
                model = LinearRegression(featuresCol="v", regParam=reg, elasticNetParam=alpha, solver="normal", maxIter=1000, tol=1e-12).fit(shaped.where(F.col("i") % 3 != held))
                losses.append(model.evaluate(shaped.where(F.col("i") % 3 == held)).rootMeanSquaredError)
            assert got[str(sorted({"regParam": reg, "elasticNetParam": alpha}.items()))] == pytest.approx(sum(losses) / 3, rel=1e-5)
    assert got[str(sorted(best.items()))] == min(got.values()) and len(got) == 9


def test_grid_search_of_odd_tables(spark):
    df = spark.createDataFrame([([1.0, 2.0], 1.0), ([2.0, 2.0], 1.0), ([3.0, 2.0], 1.0), ([4.0, 2.0], 1.0)] * 5, "features array<double>, label double")
    table, best = ml.grid_search(df.withColumn("i", F.monotonically_increasing_id()), {"regParam": [0.5, 1.0]}, fold=F.col("features")[0].cast("int") % 2)
    assert best == {"regParam": 0.5} and [r["loss"] for r in table.collect()] == [0.0, 0.0]  # a label that never changes; ties to the first
    with pytest.raises(ValueError, match="two folds"):
        ml.grid_search(df.where("false"), {"regParam": [0.0]})
    with pytest.raises(ValueError, match="maxDepth"):
        ml.grid_search(df, {"maxDepth": [3]})


def test_batch_predict_pins_the_version(spark):
    data = separable(spark)
    out = ml.batch_predict(data.withColumnRenamed("features", "inputs"), ml.fit_threat_model(data), "v7")
    assert out.select("model_version").distinct().collect()[0][0] == "v7" and out.where(F.abs(F.col("outputs")[0] + F.col("outputs")[1] - 1) > 1e-9).count() == 0


def test_training_runs_never_collide(spark, tmp_path):
    runs = spark.createDataFrame([("r1", "sla", "t1"), ("r2", "temporal", "t1"), ("r3", "sla", "t2"), ("r4", "threat", "t1")], "run_id string, model_type string, tenant_id string")
    catalog = str(tmp_path / "runs")
    assert ml.training_runs(runs, catalog).select("path").distinct().count() == 4
    assert ml.training_runs(runs, catalog).count() == 4
    assert ml.training_runs(runs, catalog).where("path LIKE '%t1%'").count() == 0


def test_per_tenant_ridge(spark):
    import numpy as np
    data = separable(spark)
    got = {r["tenant_id"]: r for r in ml.train_per_tenant(data, 1.0).collect()}
    assert set(got) == {"t0", "t1", "t2"}
    mine = [r for r in data.collect() if r["tenant_id"] == "t1"]
    x = np.array([[1, *r["features"]] for r in mine])
    y = np.array([r["label"] for r in mine])
    p = np.eye(4)
    p[0, 0] = 1e-9
    w = np.linalg.solve(x.T @ x + p, x.T @ y)
    assert np.allclose(got["t1"]["coefficients"], w) and got["t1"]["loss"] == pytest.approx(float(np.mean((x @ w - y) ** 2)))


def test_distil(spark):
    data = separable(spark)
    teacher = data.select("hour", (F.col("features")[0] * 0.5).alias("teacher_score"))
    report = ml.distil(data.select("hour", "features"), teacher, ["hour"])[1].first()
    assert report["n"] == 200 and report["mae"] < 0.05


def test_drift(spark):
    rng = random.Random(6)
    data = [(f"2024-01-{1 + i % 20:02d} 00:00:00", rng.random() + (5 if i % 20 >= 10 else 0), rng.random()) for i in range(2000)]
    df = spark.createDataFrame(data, "h string, moved double, still double").withColumn("hour", F.col("h").cast("timestamp_ntz"))
    psi = {r["feature"]: r["psi"] for r in ml.drift(df, ["moved", "still"], "2024-01-11 00:00:00").collect()}
    assert psi["moved"] > 1 and psi["still"] < 0.1


def test_thresholds(spark):
    df = spark.createDataFrame([(0.9, 1), (0.5, 0), (0.2, 1), (0.1, 0), (None, 1)], "score double, label int")
    out = {r["threshold"]: r for r in ml.threshold_report(df, [0.5, 0.95], 10, 1).collect()}
    assert (out[0.5]["tp"], out[0.5]["fp"], out[0.5]["fn"], out[0.5]["tn"], out[0.5]["cost"]) == (1, 1, 2, 1, 21.0)
    assert out[0.95]["precision"] is None and out[0.95]["recall"] == 0.0


def test_nearest(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    out = ml.nearest_vectors(df, [(1, [1.0, 0.0])], 3)
    assert rows(out, "rank", "vec_id", "score") == [(1, 1, 1.0), (2, 2, 0.707107), (3, 4, -1.0)]


def test_labels_and_losses_look_ahead(spark):
    data = [("t", "s", 1, i, f"2024-01-01 {i:02d}:00:00", 500 if i % 2 else 200, 1.0) for i in range(6)]
    rows_ = ml.labelled(ml.window_features(events(spark, data)), 0.25).orderBy("hour").collect()
    errors = [r["features"][ml.FEATURES.index("error_rate")] for r in rows_]
    assert [r["label"] for r in rows_] == [1, 0, 1, 0, 1] and errors == [0.0, 1.0, 0.0, 1.0, 0.0]
    early, late = ml.split_by_time(ml.window_features(events(spark, data)), "2024-01-01 04:00:00")
    assert (early.count(), late.count()) == (4, 2)
    scored = spark.createDataFrame([(1, 0.9), (0, 0.2)], "label int, score double")
    found = ml.held_out_loss(scored, 0.5).first()
    assert found["n"] == 2 and found["loss"] < found["prior_loss"]


def test_threat_labels_come_after_the_features(spark):
    df = spark.createDataFrame([("t", 1, "2024-01-01", "DE", "view", 0, False), ("t", 1, "2024-01-09", "DE", "view", 99, True), ("t", 2, "2024-01-01", "DE", "signup", 99, True), ("t", 3, "2024-01-09", "DE", "view", 99, True)],
                               "tenant_id string, user_id long, event_time string, country string, event_type string, abuse_score int, is_malicious boolean").withColumn("event_time", F.col("event_time").cast("timestamp_ntz"))
    flags = spark.createDataFrame([(1, True)], "user_id long, is_automated boolean")
    places = spark.createDataFrame([("t", "DE", 1.0)], "tenant_id string, country string, weight double")
    got = ml.threat_features(df, flags, places, "2024-01-05")
    assert [(r["user_id"], r["label"], list(r["features"])) for r in got.orderBy("user_id").collect()] == [(1, 1, [0.0, 1.0, 0.0, 1.0]), (2, 0, [0.99, 0.0, 1.0, 1.0])]
    assert got.where("label = 1").count() == 1 and ml.threat_features(df, flags, places, "2024-01-05", "2024-01-06").where("label = 1").count() == 0
