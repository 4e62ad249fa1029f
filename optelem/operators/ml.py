"""Features, models, scores, drift and nearest vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark import SparkContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from optelem.functions.exact import as_micros, mean_ms
from optelem.functions.times import trunc
from optelem.operators.rollups import failed
from optelem.plans.keys import join_on
from optelem.plans.lookups import lookup_side, settle, settled_lookup
from optelem.plans.percentiles import exact_percentiles

FEATURES = ("moving_avg_latency", "latency_delta", "latency_variance", "error_rate", "hour_of_day", "peak_share")


def window_features(df: DataFrame, window_hours: int = 24) -> DataFrame:
    """Hourly features per tenant: moving average, delta and variance of latency, error rate, hour, share of peak use.

    Raw rows collapse to hours first; the windows run over hours of a tenant.
    """
    us = as_micros("latency_ms")
    hourly = df.groupBy("tenant_id", trunc("hour", "event_time").alias("hour")).agg(
        mean_ms("latency_ms").alias("avg_latency"), F.count(F.lit(1)).alias("requests"), F.count_if(failed()).alias("errors"),
        F.sum(us).alias("_s"), F.count(us).alias("_k"), F.sum(us.cast("decimal(19,0)") * us.cast("decimal(19,0)")).alias("_q"))
    by_hour = Window.partitionBy("tenant_id").orderBy("hour")
    recent = by_hour.rowsBetween(-(window_hours - 1), 0)
    n, k = F.col("requests").cast("double"), F.nullif(F.col("_k").cast("double"), F.lit(0e0))
    variance = (F.col("_q").cast("double") - F.col("_s").cast("double") * F.col("_s").cast("double") / k) / F.nullif(k - 1, F.lit(0e0)) / F.lit(1e6)
    return hourly.select(
        "tenant_id", "hour", "requests",
        F.round(F.avg("avg_latency").over(recent), 9).alias("moving_avg_latency"),
        F.round(F.col("avg_latency") - F.lag("avg_latency").over(by_hour), 9).alias("latency_delta"),
        variance.alias("latency_variance"),
        (F.col("errors").cast("double") / n).alias("error_rate"),
        F.hour("hour").alias("hour_of_day"),
        (n / F.max("requests").over(recent)).alias("peak_share"))


def labelled(features: DataFrame, max_error: float = 0.25) -> DataFrame:
    """Feature arrays without NULLs and the label: does the tenant's next hour break its error budget.

    The label looks at an hour that the features have not seen; a tenant's newest hour has none yet and is left out.
    """
    array = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0e0)) for c in FEATURES])
    coming = F.lead("error_rate").over(Window.partitionBy("tenant_id").orderBy("hour"))
    return (features.select("tenant_id", "hour", array.alias("features"), (coming > max_error).cast("int").alias("label"))
            .where("label IS NOT NULL"))


def split_by_time(rows: DataFrame, cut: str, time: str = "hour") -> tuple[DataFrame, DataFrame]:
    """(rows to fit on, rows to be judged on): before `cut`, and from it on."""
    early = F.col(time) < F.lit(cut).cast("timestamp_ntz")
    return rows.where(early), rows.where(~early)


def held_out_loss(scored: DataFrame, prior: float) -> DataFrame:
    """One row: n, log loss of `score` against `label`, and the loss of always saying `prior`."""
    def loss(p: Column) -> Column:
        p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))
        return F.avg(-F.when(F.col("label") == 1, F.ln(p)).otherwise(F.ln(F.lit(1e0) - p)))

    return scored.agg(F.count(F.lit(1)).alias("n"), loss(F.col("score")).alias("loss"), loss(F.lit(float(prior))).alias("prior_loss"))


def feature_pages(rows: DataFrame, page_size: int) -> DataFrame:
    """tenant_id, page, pos, features, label: stable pages of a tenant in hour order (one row per hour bounds a tenant)."""
    number = F.row_number().over(Window.partitionBy("tenant_id").orderBy("hour")) - 1
    return (rows.withColumn("_no", number).withColumn("page", F.floor(F.col("_no") / page_size).cast("long"))
            .withColumn("pos", (F.col("_no") % page_size).cast("int")).select("tenant_id", "page", "pos", "hour", "features", "label"))


def _vectors(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_raw", array_to_vector("features"))


def _without_summary(model: PipelineModel) -> PipelineModel:
    """The model without its training summary, which holds the session; a session that has observed a metric cannot go to tasks."""
    last = model.stages[-1]
    last._java_obj.setSummary(SparkContext._active_spark_context._jvm.scala.Option.empty())
    return model


def fit_sla_model(rows: DataFrame, hidden: int = 8, seed: int = 7, max_iter: int = 60) -> PipelineModel:
    """Perceptron on (features, label) whose class-1 probability is the breach probability."""
    width = rows.select(F.size("features")).first()[0]
    net = MultilayerPerceptronClassifier(layers=[width, hidden, 2], featuresCol="_scaled", labelCol="label", seed=seed, maxIter=max_iter)
    return _without_summary(Pipeline(stages=[StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True), net]).fit(_vectors(rows)))


def fit_threat_model(rows: DataFrame, reg: float = 0.01) -> PipelineModel:
    """Logistic model of the access threat probability on (features, label)."""
    model = LogisticRegression(featuresCol="_scaled", labelCol="label", regParam=reg)
    return _without_summary(Pipeline(stages=[StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True), model]).fit(_vectors(rows)))


def probabilities(rows: DataFrame, model: PipelineModel) -> DataFrame:
    """Add `score`, the class-1 probability."""
    return (model.transform(_vectors(rows)).withColumn("score", vector_to_array("probability")[1])
            .select(*rows.columns, "score"))


SENSITIVE_ROUTES = ("purchase", "signup")


def threat_features(df: DataFrame, behaviour: DataFrame, locations: DataFrame, cut: str, end: str | None = None) -> DataFrame:
    """Accesses before `cut` collapsed to (tenant, user): indicator share, automation, sensitive-route share, location weight.

    The label is whether the user hits an indicator from `cut` on (before `end`), so no feature has seen it.
    df: user_id, tenant_id, event_time, country, event_type, abuse_score, is_malicious. locations: tenant_id, country,
    weight. `behaviour` and `locations` should come from rows before `cut` too.
    """
    start, stop = (F.lit(x).cast("timestamp_ntz") for x in (cut, end))
    later = df.where((F.col("event_time") >= start) & (stop.isNull() | (F.col("event_time") < stop)))
    hits = later.groupBy("tenant_id", "user_id").agg(F.bool_or("is_malicious").alias("_hit"))
    placed = df.where(F.col("event_time") < start).join(lookup_side(locations), ["tenant_id", "country"], "left")
    per_user = placed.groupBy("tenant_id", "user_id").agg(
        (F.avg("abuse_score") / 100).alias("_abuse"), (F.count_if(F.col("event_type").isin(*SENSITIVE_ROUTES)).cast("double") / F.count(F.lit(1))).alias("_routes"),
        F.avg(F.coalesce("weight", F.lit(0e0))).alias("_place"))
    flags = behaviour.select("user_id", F.col("is_automated").cast("double").alias("_auto"))
    joined = join_on(join_on(per_user, flags, ["user_id"], "left"), hits, ["tenant_id", "user_id"], "left")
    array = F.array(F.round("_abuse", 6), F.coalesce("_auto", F.lit(0e0)), F.round("_routes", 6), F.round("_place", 6))
    return joined.select("tenant_id", "user_id", array.alias("features"), F.coalesce("_hit", F.lit(False)).cast("int").alias("label"))


def location_weights(df: DataFrame) -> DataFrame:
    """Share of a tenant's traffic by country."""
    counts = df.groupBy("tenant_id", "country").agg(F.count(F.lit(1)).alias("_n"))
    total = F.sum("_n").over(Window.partitionBy("tenant_id"))
    return counts.select("tenant_id", "country", (F.col("_n").cast("double") / total).alias("weight"))


def platform_features(df: DataFrame, incidents: DataFrame) -> DataFrame:
    """One row per day over all tenants: failure rate, suspicious ratio, incidents; score = rule-based effectiveness."""
    daily = df.groupBy(F.to_date("event_time").alias("day")).agg(
        (F.count_if(failed()).cast("double") / F.count(F.lit(1))).alias("failure_rate"),
        (F.count_if("is_malicious").cast("double") / F.count(F.lit(1))).alias("suspicious_ratio"))
    opened = incidents.groupBy(F.to_date("started_at").alias("day")).agg(F.count(F.lit(1)).cast("double").alias("incidents"))
    joined = daily.join(opened, "day", "left").fillna(0e0, ["incidents"])
    score = F.greatest(F.lit(0e0), 100 * (1 - F.col("failure_rate")) * (1 - F.col("suspicious_ratio")) - F.col("incidents"))
    return joined.withColumn("target", score)


def fit_ces_model(rows: DataFrame, seed: int = 7) -> PipelineModel:
    """Boosted trees on the platform features; trained across tenants, without identifiers."""
    assembler = VectorAssembler(inputCols=["failure_rate", "suspicious_ratio", "incidents"], outputCol="_raw")
    return Pipeline(stages=[assembler, GBTRegressor(featuresCol="_raw", labelCol="target", maxIter=10, maxDepth=3, seed=seed)]).fit(rows)


def ces_predictions(rows: DataFrame, model: PipelineModel) -> DataFrame:
    """Add `score`, clamped to 0..100."""
    return model.transform(rows).withColumn("score", F.greatest(F.lit(0e0), F.least(F.lit(100e0), F.col("prediction")))).drop("_raw", "prediction")


def spike_forecast(rollup: DataFrame, seq_len: int = 24, leak: float = 0.9, threshold: float = 1.0) -> DataFrame:
    """0..1 forecast per tenant and hour from a leaky integrate-and-fire pass over the last `seq_len` hours.

    Latency and error rate are scaled to 0..1 within the tenant and averaged to the input current.
    """
    rate = rollup.withColumn("_err", F.col("errors").cast("double") / F.col("requests"))
    whole = Window.partitionBy("tenant_id")

    def scaled(c: str) -> Column:
        low, high = F.min(c).over(whole), F.max(c).over(whole)
        return F.coalesce(F.try_divide(F.col(c) - low, F.nullif(high - low, F.lit(0e0))), F.lit(0e0))

    currents = rate.withColumn("_x", (scaled("avg_latency") + scaled("_err")) / 2)
    recent = whole.orderBy("hour").rowsBetween(-(seq_len - 1), 0)
    rows = currents.withColumn("_seq", F.collect_list("_x").over(recent))
    start = F.struct(F.lit(0e0).alias("v"), F.lit(0e0).alias("spikes"))

    def step(state: Column, x: Column) -> Column:
        charged = state["v"] * leak + x
        fired = charged >= threshold
        return F.struct(F.when(fired, F.lit(0e0)).otherwise(charged).alias("v"), (state["spikes"] + fired.cast("double")).alias("spikes"))

    end = F.aggregate("_seq", start, step)
    forecast = F.least(F.lit(1e0), (end["spikes"] + end["v"]) / F.lit(seq_len / 2))
    return rows.select("tenant_id", "hour", F.round(forecast, 6).alias("forecast"))


def anomaly_scores(rollup: DataFrame, value: str = "avg_latency") -> DataFrame:
    """Robust z and 0..1 score per tenant and hour; a group is one tenant's hours."""
    rollup = settle(rollup)  # one row per tenant and hour, read several times below
    center = exact_percentiles(rollup, ["tenant_id"], value, {"_median": 0.5}).drop("n")
    off = join_on(rollup, settled_lookup(center), ["tenant_id"]).withColumn("_off", F.abs(F.col(value) - F.col("_median")))
    spread = exact_percentiles(off, ["tenant_id"], "_off", {"_mad": 0.5}).drop("n")
    joined = join_on(off, settled_lookup(spread), ["tenant_id"])
    z = F.coalesce(F.try_divide(F.lit(0.6745) * (F.col(value) - F.col("_median")), F.nullif(F.col("_mad"), F.lit(0e0))), F.lit(0e0))
    return joined.select("tenant_id", "hour", F.round(z, 4).alias("z"), F.round(F.least(F.lit(1e0), F.abs(z) / 6), 4).alias("score"))


def forecast_30d(df: DataFrame, days: int = 30) -> DataFrame:
    """tenant_id, day, forecast: linear projection of the daily share of flagged requests."""
    daily = df.groupBy("tenant_id", F.to_date("event_time").alias("day")).agg(
        (F.count_if("is_malicious").cast("double") / F.count(F.lit(1))).alias("risk"))
    x = F.datediff("day", F.lit("1970-01-01").cast("date")).cast("double")
    fit = daily.withColumn("_x", x).groupBy("tenant_id").agg(
        F.regr_slope("risk", "_x").alias("_a"), F.regr_intercept("risk", "_x").alias("_b"), F.max("day").alias("_last"))
    ahead = fit.withColumn("day", F.explode(F.sequence(F.date_add("_last", 1), F.date_add("_last", days))))
    value = F.col("_a") * x + F.col("_b")
    return ahead.select("tenant_id", "day", F.round(F.greatest(F.lit(0e0), F.least(F.lit(1e0), value)), 5).alias("forecast"))


# fixed values: parameters of a grid and their values where it does not name them
GRID_DEFAULTS = {"regParam": 0.0, "elasticNetParam": 0.0}


def fold_sums(rows: DataFrame, fold: Column) -> DataFrame:
    """_fold, n and the sums of all products of (1, features, label) per fold, in one pass with map-side sums.

    Rows whose features or label are NULL or not finite take no part. Sums grow with the square of the width, so this is
    for up to about a hundred features.
    """
    width = rows.select(F.max(F.size("features"))).first()[0] or 0
    x = [F.lit(1e0), *[F.get("_x", F.lit(i)) for i in range(width)], F.col("_y")]
    shaped = rows.select(fold.alias("_fold"), F.col("features").cast("array<double>").alias("_x"), F.col("label").cast("double").alias("_y"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    sound = finite(F.col("_y")) & (F.size("_x") == width) & F.forall("_x", finite)
    sums = [F.sum(x[i] * x[j]).alias(f"_s_{i}_{j}") for i in range(width + 2) for j in range(i, width + 2)]
    return shaped.where(sound).groupBy("_fold").agg(*sums)


def elastic_net(gram: np.ndarray, reg: float, alpha: float, tolerance: float = 1e-13, rounds: int = 200_000) -> np.ndarray:
    """Coefficients (intercept first) from the sums of products of (1, features, label).

    They minimise the mean squared error / 2 + reg * (alpha * |w|_1 + (1 - alpha) / (2 * sd of the label) * |w|_2^2) over
    coefficients w of standardised features; that is Spark's LinearRegression. Constant features get 0. Without an L1
    part the system is solved at once, with one by coordinate descent.
    """
    n, width = gram[0, 0], len(gram) - 2
    mean = gram[0] / n
    cov = gram / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0e0))
    live = np.flatnonzero(sd[1:-1] > 1e-12 * (1 + np.abs(mean[1:-1]))) + 1
    out = np.zeros(width + 1)
    if len(live) and sd[-1] > 1e-12 * (1 + abs(mean[-1])):
        r = cov[np.ix_(live, live)] / np.outer(sd[live], sd[live])
        c = cov[live, -1] / sd[live]
        l1, l2 = reg * alpha, reg * (1 - alpha) / sd[-1]
        if l1 == 0:
            w = np.linalg.lstsq(r + l2 * np.eye(len(live)), c, rcond=1e-12)[0]
        else:
            w = np.zeros(len(live))
            for _ in range(rounds):
                before = w.copy()
                for i in range(len(live)):
                    pull = c[i] - r[i] @ w + r[i, i] * w[i]
                    w[i] = np.sign(pull) * max(abs(pull) - l1, 0e0) / (r[i, i] + l2)
                if np.max(np.abs(w - before)) <= tolerance * (1 + np.max(np.abs(w))):
                    break
        out[live] = w / sd[live]
    out[0] = mean[-1] - out[1:] @ mean[1:-1]
    return out


def squared_error(gram: np.ndarray, w: np.ndarray) -> float:
    """Mean squared error of coefficients `w` over the rows whose sums of products are `gram`."""
    v = np.append(-w, 1e0)
    return max(0e0, float(v @ gram @ v) / gram[0, 0])


def grid_search(rows: DataFrame, grid: dict[str, Sequence], folds: int = 3, seed: int = 7, fold: Column | None = None) -> tuple[DataFrame, dict]:
    """(loss per parameter combination, best parameters) of a linear regression; exhaustive, k folds, the lowest mean RMSE wins, ties to the first.

    rows: features array, label. grid: regParam and elasticNetParam. One pass sums the products per fold; every fit and
    every held-out error of the grid comes from those few numbers, so the table is read once however large the grid.
    `fold` numbers the fold of a row, by default a hash of its values, so equal rows share one. Folds without rows do not
    count; fewer than two with rows are an error.
    """
    unknown = grid.keys() - GRID_DEFAULTS.keys()
    if unknown:
        raise ValueError(f"a grid has no parameters {sorted(unknown)}")
    chosen = F.pmod(F.xxhash64("features", "label", F.lit(seed)), F.lit(folds)) if fold is None else fold
    sums = fold_sums(rows, chosen)
    width = int(max((name.split("_")[2] for name in sums.columns if name.startswith("_s_")), key=int)) + 1
    grams = []
    for row in sums.orderBy("_fold").toLocalIterator():  # one row of sums per fold
        gram = np.zeros((width, width))
        for i in range(width):
            for j in range(i, width):
                gram[i, j] = gram[j, i] = row[f"_s_{i}_{j}"]
        grams.append(gram)
    if len(grams) < 2:
        raise ValueError("a grid search needs rows in two folds")
    whole = sum(grams)
    table = []
    for values in product(*grid.values()):
        params = dict(zip(grid, map(float, values)))
        asked = GRID_DEFAULTS | params
        fits = [elastic_net(whole - held, asked["regParam"], asked["elasticNetParam"]) for held in grams]
        table.append((params, float(np.mean([np.sqrt(squared_error(held, w)) for held, w in zip(grams, fits)]))))
    best = min(table, key=lambda t: t[1])[0]
    lines = F.array(*[F.struct(F.lit(str(sorted(p.items()))).alias("params"), F.lit(loss).alias("loss"), F.lit(p == best).alias("is_best")) for p, loss in table])
    return rows.sparkSession.range(1).select(F.inline(lines)), best


def batch_predict(rows: DataFrame, model: PipelineModel, model_version: str) -> DataFrame:
    """Outputs of one pinned model version for a whole table: adds `outputs`, `model_version`."""
    scored = model.transform(rows.withColumn("_raw", array_to_vector("inputs")))
    return scored.select(*rows.columns, vector_to_array("probability").alias("outputs"), F.lit(model_version).alias("model_version"))


# fixed values: artefact folders by model type; platform-wide models carry no tenant hash
MODEL_FOLDERS = {"sla": "sla_models", "temporal": "temporal_models", "threat": "threat_models", "ces": "ces_models"}
PLATFORM_MODELS = ("threat", "ces")


def artefact_path(model_type: str, slug: str) -> Column:
    """Folder and hashed tenant slug, so a path tells nothing about the tenant; model types cannot collide."""
    folder = F.lit(None).cast("string")
    for name, value in MODEL_FOLDERS.items():
        folder = F.when(F.col(model_type) == name, F.lit(value)).otherwise(folder)
    owner = F.when(F.col(model_type).isin(*PLATFORM_MODELS), F.lit("platform")).otherwise(F.sha2(F.col(slug).cast("binary"), 256))
    return F.concat(folder, F.lit("/"), owner, F.lit("_"), F.col(model_type), F.lit("_model"))


def training_runs(runs: DataFrame, catalog: str) -> DataFrame:
    """Append run rows (run_id, model_type, tenant_id, params, loss, trained_at) with their artefact path; a run id is written once."""
    spark = runs.sparkSession
    shaped = runs.withColumn("path", artefact_path("model_type", "tenant_id"))
    from optelem.sources.sinks import read_if_present

    known = read_if_present(spark, catalog, shaped.schema)
    fresh = shaped if known is None else shaped.join(known.select("run_id"), "run_id", "left_anti").select(*shaped.columns)
    fresh.write.mode("append").parquet(catalog)
    return spark.read.schema(shaped.schema).parquet(catalog)


def train_per_tenant(rows: DataFrame, penalty: float = 1.0) -> DataFrame:
    """tenant_id, n, coefficients (intercept first), loss: one ridge regression per tenant, isolated by group.

    Each tenant reduces to sums of products inside Spark; only those few numbers reach the solver.
    """
    width = rows.select(F.size("features")).first()[0]
    x = [F.lit(1e0)] + [F.col("features")[i] for i in range(width)]
    y = F.col("label").cast("double")
    sums = [F.sum(x[i] * x[j]).alias(f"_xx_{i}_{j}") for i in range(width + 1) for j in range(i, width + 1)]
    sums += [F.sum(x[i] * y).alias(f"_xy_{i}") for i in range(width + 1)]
    stats = rows.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n"), F.sum(y * y).alias("_yy"), *sums)
    schema = "tenant_id string, n long, coefficients array<double>, loss double"

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                a = np.zeros((width + 1, width + 1))
                for i in range(width + 1):
                    for j in range(i, width + 1):
                        a[i, j] = a[j, i] = row[f"_xx_{i}_{j}"]
                b = np.array([row[f"_xy_{i}"] for i in range(width + 1)])
                ridge = penalty * np.eye(width + 1)
                ridge[0, 0] = 1e-9
                w = np.linalg.solve(a + ridge, b)
                loss = (row["_yy"] - 2 * w @ b + w @ a @ w) / row["n"]
                out.append((row["tenant_id"], row["n"], [float(v) for v in w], float(loss)))
            yield pd.DataFrame(out, columns=["tenant_id", "n", "coefficients", "loss"])

    return stats.mapInPandas(solve, schema)


def distil(features: DataFrame, teacher: DataFrame, key: Sequence[str], seed: int = 7) -> tuple[PipelineModel, DataFrame]:
    """Fit a student on teacher scores (a column, never a call). Returns the model and one row: n, mae, bias.

    features: key + features array. teacher: key + teacher_score.
    """
    rows = _vectors(features.join(teacher, list(key))).select("_raw", F.col("teacher_score").cast("double").alias("teacher_score"))
    model = Pipeline(stages=[GBTRegressor(featuresCol="_raw", labelCol="teacher_score", maxIter=10, maxDepth=3, seed=seed)]).fit(rows)
    gap = F.col("prediction") - F.col("teacher_score")
    report = model.transform(rows).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(gap)).alias("mae"), F.avg(gap).alias("bias"))
    return model, report


def drift(features: DataFrame, columns: Sequence[str], cut: str, time: str = "hour", bins: int = 10, epsilon: float = 1e-4) -> DataFrame:
    """feature, psi: shift of each feature between the rows before and from `cut`, over deciles of the earlier ones."""
    long = features.select((F.col(time) >= F.lit(cut).cast("timestamp_ntz")).alias("_late"),
                           *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(["_late"], list(columns), "feature", "_v").where("_v IS NOT NULL")
    probs = {f"_q{i}": i / bins for i in range(1, bins)}
    edges = exact_percentiles(long.where(~F.col("_late")), ["feature"], "_v", probs).drop("n")
    binned = long.join(lookup_side(edges, max_rows=10_000), "feature").withColumn(
        "_bin", reduce(lambda a, b: a + b, [(F.col("_v") > F.col(q)).cast("int") for q in probs]))
    counts = binned.groupBy("feature", "_bin").agg(F.count_if(~F.col("_late")).alias("_base"), F.count_if("_late").alias("_now"))
    grid = counts.select("feature").distinct().withColumn("_bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    filled = grid.join(counts, ["feature", "_bin"], "left").fillna(0, ["_base", "_now"])
    whole = Window.partitionBy("feature")

    def part(c: str) -> Column:
        return F.greatest(F.lit(epsilon), F.coalesce(F.try_divide(F.col(c).cast("double"), F.sum(c).over(whole)), F.lit(0e0)))

    term = (F.col("_p") - F.col("_b")) * F.ln(F.col("_p") / F.col("_b"))
    shares = filled.withColumn("_b", part("_base")).withColumn("_p", part("_now"))
    return shares.groupBy("feature").agg(F.round(F.sum(term), 6).alias("psi"))


def threshold_report(scores: DataFrame, thresholds: Sequence[float], fn_cost: float, fp_cost: float) -> DataFrame:
    """Confusion counts, precision, recall and cost per threshold; flagged means score >= threshold.

    Rows collapse to (thresholds passed, label) counts; thresholds then sum those.
    """
    ladder = sorted(thresholds)
    passed = reduce(lambda a, b: a + b, [F.coalesce(F.col("score") >= t, F.lit(False)).cast("int") for t in ladder])
    counts = scores.groupBy(passed.alias("_passed")).agg(F.count_if(F.col("label") == 1).alias("_pos"), F.count_if(F.col("label") == 0).alias("_neg"))
    steps = counts.withColumn("t", F.explode(F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(float(t)).alias("threshold")) for i, t in enumerate(ladder)])))
    hit = F.col("_passed") >= F.col("t.i")
    table = steps.groupBy(F.col("t.threshold").alias("threshold")).agg(
        F.sum(F.when(hit, F.col("_pos")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("_neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~hit, F.col("_pos")).otherwise(0)).alias("fn"), F.sum(F.when(~hit, F.col("_neg")).otherwise(0)).alias("tn"))
    return (table.withColumn("precision", F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")))
            .withColumn("recall", F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")))
            .withColumn("cost", F.col("fn") * F.lit(float(fn_cost)) + F.col("fp") * F.lit(float(fp_cost))))


def nearest_vectors(catalog: DataFrame, queries: Sequence[tuple[int, Sequence[float]]], k: int) -> DataFrame:
    """query_id, vec_id, score, rank: cosine top-k of a short list of query vectors in the whole catalog.

    Queries ride along as literals; the top-k filter runs in each task before the shuffle.
    """
    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0e0), lambda s, v: s + v)

    wanted = F.array(*[F.struct(F.lit(int(q)).cast("long").alias("query_id"), F.array(*[F.lit(float(v)) for v in vec]).alias("qv")) for q, vec in queries])
    rows = catalog.select("vec_id", F.col("embedding").alias("_e"), F.sqrt(dot(F.col("embedding"), F.col("embedding"))).alias("_n"), F.explode(wanted).alias("_q"))
    scores = rows.select(F.col("_q.query_id").alias("query_id"), "vec_id", F.round(
        F.try_divide(dot(F.col("_e"), F.col("_q.qv")), F.col("_n") * F.sqrt(dot(F.col("_q.qv"), F.col("_q.qv")))), 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
