"""Registered queries and oracles: features, models, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from optelem.fixtures import query, table, view, with_views
from optelem.operators import enrich, ml, rollups, vectors
from registry.rollups import ROLLUP
from registry.threat import FLAGGED, flagged

EARLY_CUT, CUT = "2024-01-11 00:00:00", "2024-01-16 00:00:00"
LABELLED_SCORES = "SELECT event_id, k / 100e0 AS score, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label FROM tel"
GRID = {"regParam": [0.0, 0.1, 1.0], "elasticNetParam": [0.0, 0.5]}
THRESHOLDS = (0.1, 0.3, 0.5, 0.7, 0.9)
RUNS = "SELECT o_orderkey AS run_id, CASE o_orderkey % 4 WHEN 0 THEN 'sla' WHEN 1 THEN 'temporal' WHEN 2 THEN 'threat' ELSE 'ces' END AS model_type, concat('t', CAST(o_custkey % 8 AS STRING)) AS tenant_id FROM orders"


def _tel(spark, d):
    return view(spark, d, "tel")


def _features(spark, d):
    return ml.window_features(_tel(spark, d))


def _rows(spark, d):
    return ml.labelled(_features(spark, d))


def _rollup(spark, d):
    return rollups.hourly_rollup(_tel(spark, d))


def _rounded(df, column="score", places=3):
    return df.withColumn(column, F.round(column, places))


def _in_range(column="score", low=0.0, high=1.0):
    return F.coalesce(F.col(column).between(low, high), F.lit(False)).alias("in_range")


def _sla_scores(spark, d):
    """Hours from CUT on, scored by a model of the hours before."""
    early, late = ml.split_by_time(_rows(spark, d), CUT)
    return ml.probabilities(late, ml.fit_sla_model(early)), early


def _sla(spark, d):
    return _sla_scores(spark, d)[0].select("tenant_id", "hour", "label", _in_range())


def _sla_loss(spark, d):
    scored, early = _sla_scores(spark, d)
    return ml.held_out_loss(scored, early.agg(F.avg("label")).first()[0])


def _threat_rows(spark, d, cut, end=None):
    traffic = flagged(spark, d)
    known = traffic.where(F.col("event_time") < F.lit(cut).cast("timestamp_ntz"))
    return ml.threat_features(traffic, enrich.behaviour_flags(known, 0.9, 0.3), ml.location_weights(known), cut, end)


def _threat(spark, d):
    """Fitted on what the days before CUT show of the ten days from it on; judged on the days after those."""
    model = ml.fit_threat_model(_threat_rows(spark, d, EARLY_CUT, CUT))
    return ml.probabilities(_threat_rows(spark, d, CUT), model).select("tenant_id", "user_id", "label", _in_range())


def _ces(spark, d):
    rows = ml.platform_features(flagged(spark, d), rollups.incident_intervals(_tel(spark, d)))
    early, late = ml.split_by_time(rows, CUT, "day")
    return ml.ces_predictions(late, ml.fit_ces_model(early)).select("day", _in_range("score", 0.0, 100.0))


def _predict(spark, d):
    early, late = ml.split_by_time(_rows(spark, d), CUT)
    asked = late.select("tenant_id", "hour", F.col("features").alias("inputs"))
    out = ml.batch_predict(asked, ml.fit_threat_model(early), "threat-1")
    return out.select("tenant_id", "hour", F.coalesce(F.abs(F.col("outputs")[0] + F.col("outputs")[1] - 1) < 1e-9, F.lit(False)).alias("sums_to_one"), "model_version")


def _ridge(spark, d):
    """Per tenant whether the coefficients solve the normal equations of the ridge regression."""
    rows = _rows(spark, d)
    fitted = ml.train_per_tenant(rows)
    x = F.concat(F.array(F.lit(1e0)), F.col("features"))
    gap = F.col("label") - F.aggregate(F.zip_with(x, F.col("coefficients"), lambda a, b: a * b), F.lit(0e0), lambda s, v: s + v)
    long = rows.join(fitted, "tenant_id").select("tenant_id", "n", "coefficients", F.posexplode(x).alias("i", "_x"), gap.alias("_gap"))
    sums = long.groupBy("tenant_id", "n", "i").agg(F.sum(F.col("_x") * F.col("_gap")).alias("_r"), F.sum(F.abs(F.col("_x") * F.col("_gap"))).alias("_size"), F.first(F.get("coefficients", F.col("i"))).alias("_w"))
    residual = F.abs(F.col("_r") - F.when(F.col("i") > 0, F.col("_w")).otherwise(0e0)) / (1 + F.col("_size"))
    return sums.groupBy("tenant_id", "n").agg((F.max(residual) < 1e-6).alias("solved"))


def _sketch_ranks(spark, d):
    """Per tenant whether the percentiles of merged sketches lie within two percent of their rank."""
    tel = _tel(spark, d)
    merged = rollups.merged_percentiles(rollups.latency_sketches(tel), ["tenant_id"], {"p50": 0.5, "p95": 0.95})
    joined = tel.join(merged.select("tenant_id", "p50", "p95"), "tenant_id")

    def near(p, q):
        below, at_most = F.avg((F.col("latency_ms") < F.col(p)).cast("double")), F.avg((F.col("latency_ms") <= F.col(p)).cast("double"))
        return ((below <= q + 0.02) & (at_most >= q - 0.02)).alias(f"{p}_near")

    return joined.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n"), near("p50", 0.5), near("p95", 0.95))


def _distil(spark, d):
    rows = _rows(spark, d)
    teacher = ml.spike_forecast(_rollup(spark, d)).withColumnRenamed("forecast", "teacher_score")
    return ml.distil(rows.select("tenant_id", "hour", "features"), teacher, ["tenant_id", "hour"])[1]


def _nearest(spark, d):
    catalog = table(spark, d, "embeddings")
    wanted = catalog.where("vec_id IN (0, 17, 101)").orderBy("vec_id").limit(3).collect()
    return ml.nearest_vectors(catalog, [(r["vec_id"], r["embedding"]) for r in wanted], 10)


def _asked(spark, d):
    return table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _recall(spark, d):
    """Do the probed cells hold nine of ten true neighbours of all the queries together?"""
    catalog, asked = table(spark, d, "embeddings"), _asked(spark, d)
    index = vectors.build_index(catalog)
    found = vectors.nearest_by_index(index, asked, 10, index.probes(0.97))
    recall = vectors.recall_at(found, vectors.nearest_to_table(catalog, asked, 10), 10)
    return recall.agg(F.count(F.lit(1)).alias("queries"), (F.avg("recall") >= 0.9).alias("recall_reached"))


QUERIES = {
    "window_features": _features,
    "feature_pages": lambda s, d: ml.feature_pages(_rows(s, d), 100).select("tenant_id", "page", "pos", "hour", "label", F.col("features")[3].alias("error_rate")),
    "sla_model": _sla,
    "sla_model_loss": _sla_loss,
    "threat_model": _threat,
    "ces_model": _ces,
    "spike_forecast": lambda s, d: ml.spike_forecast(_rollup(s, d)),
    "anomaly_scores": lambda s, d: ml.anomaly_scores(_rollup(s, d)),
    "forecast_30d": lambda s, d: ml.forecast_30d(flagged(s, d)),
    "grid_search": lambda s, d: _rounded(ml.grid_search(_rows(s, d), GRID, fold=F.dayofmonth("hour") % 3)[0], "loss", 6),
    "batch_predict": _predict,
    "artefact_path": lambda s, d: query(s, d, RUNS).withColumn("path", ml.artefact_path("model_type", "tenant_id")),
    "train_per_tenant": _ridge,
    "latency_sketches": _sketch_ranks,
    "distil": _distil,
    "drift": lambda s, d: ml.drift(_features(s, d), ["moving_avg_latency", "error_rate", "peak_share"], CUT),
    "threshold_report": lambda s, d: ml.threshold_report(query(s, d, LABELLED_SCORES), THRESHOLDS, 5.0, 1.0),
    "nearest_vectors": _nearest,
    "nearest_to_table": lambda s, d: vectors.nearest_to_table(table(s, d, "embeddings"), _asked(s, d), 10),
    "vector_index_recall": _recall,
}

FEATURES = f"""h AS (SELECT tenant_id, date_trunc('hour', event_time) AS hour, CAST(sum(CAST(round(latency_ms * 1000) AS BIGINT)) AS DOUBLE) / (1e3 * count(latency_ms)) AS avg_latency, count(*) AS requests,
  count(CASE WHEN status_code >= 500 THEN 1 END) AS errors, CAST(sum(CAST(round(latency_ms * 1000) AS HUGEINT)) AS DOUBLE) AS s, CAST(sum(CAST(round(latency_ms * 1000) AS HUGEINT) * CAST(round(latency_ms * 1000) AS HUGEINT)) AS DOUBLE) AS q FROM tel GROUP BY ALL),
 feat AS (SELECT tenant_id, hour, requests, round(avg(avg_latency) OVER r, 9) AS moving_avg_latency, round(avg_latency - lag(avg_latency) OVER w, 9) AS latency_delta, (q - s * s / CAST(requests AS DOUBLE)) / nullif(CAST(requests AS DOUBLE) - 1, 0) / 1e6 AS latency_variance,
  CAST(errors AS DOUBLE) / requests AS error_rate, CAST(EXTRACT(HOUR FROM hour) AS INTEGER) AS hour_of_day, CAST(requests AS DOUBLE) / max(requests) OVER r AS peak_share
  FROM h WINDOW w AS (PARTITION BY tenant_id ORDER BY hour), r AS (PARTITION BY tenant_id ORDER BY hour ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))"""
LIT_T = ", ".join(f"({t}e0)" for t in THRESHOLDS)

# the same losses by proximal gradient steps: one list of coefficients per (held-out fold, parameters) and step
GRID_SQL = f"""WITH RECURSIVE {FEATURES}, l AS (SELECT day(hour) % 3 AS f, [1e0, coalesce(moving_avg_latency, 0e0), coalesce(latency_delta, 0e0), coalesce(latency_variance, 0e0), coalesce(error_rate, 0e0), CAST(hour_of_day AS DOUBLE), coalesce(peak_share, 0e0),
   CAST(CAST(lead(error_rate) OVER (PARTITION BY tenant_id ORDER BY hour) > 0.25 AS INTEGER) AS DOUBLE)] AS z FROM feat),
 known AS (SELECT * FROM l WHERE z[8] IS NOT NULL), held(t) AS (VALUES (0), (1), (2)),
 means AS (SELECT t, i, avg(z[i]) AS m FROM known, held, range(1, 9) r(i) WHERE f <> t GROUP BY ALL),
 cov AS (SELECT h.t, a.i, b.i AS j, avg((z[a.i] - a.m) * (z[b.i] - b.m)) AS v FROM known, held h JOIN means a ON a.t = h.t JOIN means b ON b.t = h.t WHERE f <> h.t AND a.i > 1 AND b.i > 1 GROUP BY ALL),
 sd AS (SELECT t, i, sqrt(v) AS s FROM cov WHERE i = j),
 cor AS (SELECT cov.t, cov.i, list(v / (a.s * b.s) ORDER BY cov.j) AS row FROM cov JOIN sd a ON a.t = cov.t AND a.i = cov.i JOIN sd b ON b.t = cov.t AND b.i = cov.j WHERE cov.i < 8 AND cov.j < 8 GROUP BY ALL),
 pull AS (SELECT cov.t, list(v / s ORDER BY cov.i) AS r, list(s ORDER BY cov.i) AS s FROM cov JOIN sd ON sd.t = cov.t AND sd.i = cov.i WHERE cov.i < 8 AND cov.j = 8 GROUP BY ALL),
 sys AS (SELECT cor.t, lam, alpha, no, list(row ORDER BY cor.i) AS q, any_value(r) AS r, lam * alpha AS l1, lam * (1 - alpha) / any_value(y.s) AS l2, 1 / max(list_sum([abs(c) for c in row])) AS step
   FROM cor JOIN pull ON pull.t = cor.t JOIN sd y ON y.t = cor.t AND y.i = 8, (VALUES (0e0, 0e0, 0), (0e0, 0.5e0, 1), (0.1e0, 0e0, 2), (0.1e0, 0.5e0, 3), (1e0, 0e0, 4), (1e0, 0.5e0, 5)) g(lam, alpha, no) GROUP BY cor.t, lam, alpha, no),
 steps AS (SELECT 0 AS k, t, no, [0e0, 0e0, 0e0, 0e0, 0e0, 0e0] AS w FROM sys
   UNION ALL SELECT k + 1, steps.t, steps.no, [sign(w[i] - step * (list_dot_product(q[i], w) - r[i])) * greatest(abs(w[i] - step * (list_dot_product(q[i], w) - r[i])) - step * l1, 0e0) / (1 + step * l2) for i in range(1, 7)]
   FROM steps JOIN sys ON sys.t = steps.t AND sys.no = steps.no WHERE k < 2500),
 fit AS (SELECT st.t, st.no, [w[i] / s[i] for i in range(1, 7)] AS b, any_value(y.m) - list_sum(list(w[x.i - 1] / s[x.i - 1] * x.m)) AS b0 FROM steps st JOIN pull ON pull.t = st.t JOIN means x ON x.t = st.t AND x.i BETWEEN 2 AND 7 JOIN means y ON y.t = st.t AND y.i = 8 WHERE k = 2500 GROUP BY st.t, st.no, w, s),
 err AS (SELECT no, t, sqrt(avg(pow(z[8] - b0 - list_dot_product(b, z[2:7]), 2))) AS rmse FROM known JOIN fit ON f = t GROUP BY ALL),
 losses AS (SELECT no, avg(rmse) AS loss FROM err GROUP BY no)
 SELECT '[(''elasticNetParam'', ' || (CASE alpha WHEN 0 THEN '0.0' ELSE '0.5' END) || '), (''regParam'', ' || (CASE lam WHEN 0 THEN '0.0' WHEN 1 THEN '1.0' ELSE '0.1' END) || ')]' AS params, round(loss, 6) AS loss,
   losses.no = (SELECT no FROM losses ORDER BY round(loss, 10), no LIMIT 1) AS is_best FROM losses JOIN (SELECT DISTINCT no, lam, alpha FROM sys) g ON g.no = losses.no"""

ORACLES = {
    "grid_search": GRID_SQL,
    "window_features": f"WITH {FEATURES} SELECT * FROM feat",
    "feature_pages": f"""WITH {FEATURES}, n AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY hour) - 1 AS no FROM feat)
      SELECT tenant_id, CAST(no // 100 AS BIGINT) AS page, CAST(no % 100 AS INTEGER) AS pos, hour, label, error_rate FROM (SELECT *, CAST(lead(error_rate) OVER (PARTITION BY tenant_id ORDER BY hour) > 0.25 AS INTEGER) AS label FROM n) l WHERE label IS NOT NULL""",
    "sla_model": f"""WITH {FEATURES}, l AS (SELECT tenant_id, hour, CAST(lead(error_rate) OVER (PARTITION BY tenant_id ORDER BY hour) > 0.25 AS INTEGER) AS label FROM feat)
      SELECT *, true AS in_range FROM l WHERE label IS NOT NULL AND hour >= TIMESTAMP '{CUT}'""",
    "batch_predict": f"""WITH {FEATURES}, l AS (SELECT tenant_id, hour, lead(error_rate) OVER (PARTITION BY tenant_id ORDER BY hour) AS coming FROM feat)
      SELECT tenant_id, hour, true AS sums_to_one, 'threat-1' AS model_version FROM l WHERE coming IS NOT NULL AND hour >= TIMESTAMP '{CUT}'""",
    "threat_model": f"""WITH {FLAGGED}, u AS (SELECT DISTINCT tenant_id, user_id FROM fl WHERE event_time < TIMESTAMP '{CUT}'), h AS (SELECT DISTINCT tenant_id, user_id FROM fl WHERE event_time >= TIMESTAMP '{CUT}' AND is_malicious)
      SELECT u.tenant_id, u.user_id, CAST(h.user_id IS NOT NULL AS INTEGER) AS label, true AS in_range FROM u LEFT JOIN h ON h.tenant_id = u.tenant_id AND h.user_id = u.user_id""",
    "ces_model": f"SELECT DISTINCT CAST(event_time AS DATE) AS day, true AS in_range FROM tel WHERE event_time >= TIMESTAMP '{CUT}'",
    "train_per_tenant": f"""WITH {FEATURES}, l AS (SELECT tenant_id, lead(error_rate) OVER (PARTITION BY tenant_id ORDER BY hour) AS coming FROM feat)
      SELECT tenant_id, count(*) AS n, true AS solved FROM l WHERE coming IS NOT NULL GROUP BY tenant_id""",
    "latency_sketches": "SELECT tenant_id, count(*) AS n, true AS p50_near, true AS p95_near FROM tel GROUP BY tenant_id",
    "anomaly_scores": f"""WITH {ROLLUP}, c AS (SELECT tenant_id, quantile_cont(avg_latency, 0.5) AS m FROM roll GROUP BY tenant_id),
      o AS (SELECT roll.*, m, abs(avg_latency - m) AS off FROM roll JOIN c ON c.tenant_id = roll.tenant_id), s AS (SELECT tenant_id, quantile_cont(off, 0.5) AS mad FROM o GROUP BY tenant_id),
      z AS (SELECT o.tenant_id, hour, coalesce(0.6745e0 * (avg_latency - m) / nullif(mad, 0), 0) AS z FROM o JOIN s ON s.tenant_id = o.tenant_id)
      SELECT tenant_id, hour, round(z, 4) AS z, round(least(1e0, abs(z) / 6), 4) AS score FROM z""",
    "spike_forecast": f"""WITH {ROLLUP}, e AS (SELECT *, CAST(errors AS DOUBLE) / requests AS err FROM roll),
      x AS (SELECT tenant_id, hour, (coalesce((avg_latency - min(avg_latency) OVER t) / nullif(max(avg_latency) OVER t - min(avg_latency) OVER t, 0), 0) + coalesce((err - min(err) OVER t) / nullif(max(err) OVER t - min(err) OVER t, 0), 0)) / 2 AS x FROM e WINDOW t AS (PARTITION BY tenant_id)),
      q AS (SELECT tenant_id, hour, list({{'v': x, 's': 0e0}}) OVER (PARTITION BY tenant_id ORDER BY hour ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS seq FROM x),
      f AS (SELECT tenant_id, hour, list_reduce(seq, lambda a, b: {{'v': CASE WHEN a.v * 0.9e0 + b.v >= 1 THEN 0e0 ELSE a.v * 0.9e0 + b.v END, 's': a.s + CASE WHEN a.v * 0.9e0 + b.v >= 1 THEN 1e0 ELSE 0e0 END}}, {{'v': 0e0, 's': 0e0}}) AS st FROM q)
      SELECT tenant_id, hour, round(least(1e0, (st.s + st.v) / 12e0), 6) AS forecast FROM f""",
    "forecast_30d": f"""WITH {FLAGGED}, dd AS (SELECT tenant_id, CAST(event_time AS DATE) AS day, CAST(count(CASE WHEN is_malicious THEN 1 END) AS DOUBLE) / count(*) AS risk FROM fl GROUP BY ALL),
      f AS (SELECT tenant_id, regr_slope(risk, date_diff('day', DATE '1970-01-01', day)) AS a, regr_intercept(risk, date_diff('day', DATE '1970-01-01', day)) AS b, max(day) AS last FROM dd GROUP BY tenant_id),
      e AS (SELECT tenant_id, a, b, CAST(last + CAST(i AS INTEGER) AS DATE) AS day FROM f, range(1, 31) r(i))
      SELECT tenant_id, day, round(greatest(0, least(1, a * date_diff('day', DATE '1970-01-01', day) + b)), 5) AS forecast FROM e""",
    "artefact_path": f"""SELECT *, CASE model_type WHEN 'sla' THEN 'sla_models/' || sha256(tenant_id) || '_sla_model' WHEN 'temporal' THEN 'temporal_models/' || sha256(tenant_id) || '_temporal_model'
      WHEN 'threat' THEN 'threat_models/platform_threat_model' ELSE 'ces_models/platform_ces_model' END AS path FROM ({RUNS}) r""",
    "drift": f"""WITH {FEATURES}, lng AS (SELECT hour >= TIMESTAMP '{CUT}' AS late, 'moving_avg_latency' AS feature, moving_avg_latency AS v FROM feat UNION ALL SELECT hour >= TIMESTAMP '{CUT}', 'error_rate', error_rate FROM feat UNION ALL SELECT hour >= TIMESTAMP '{CUT}', 'peak_share', peak_share FROM feat),
      e AS (SELECT feature, quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS qs FROM lng WHERE NOT late GROUP BY feature),
      b AS (SELECT late, l.feature, len([q FOR q IN qs IF v > q]) AS bin FROM lng l JOIN e ON e.feature = l.feature WHERE v IS NOT NULL),
      g AS (SELECT feature, i AS bin FROM e, range(10) r(i)), c AS (SELECT g.feature, g.bin, count(CASE WHEN NOT late THEN 1 END) AS base, count(CASE WHEN late THEN 1 END) AS cur FROM g LEFT JOIN b ON b.feature = g.feature AND b.bin = g.bin GROUP BY ALL),
      s AS (SELECT feature, greatest(1e-4, base / CAST(sum(base) OVER (PARTITION BY feature) AS DOUBLE)) AS pb, greatest(1e-4, cur / CAST(sum(cur) OVER (PARTITION BY feature) AS DOUBLE)) AS pn FROM c)
      SELECT feature, round(sum((pn - pb) * ln(pn / pb)), 6) AS psi FROM s GROUP BY feature""",
    "threshold_report": f"""WITH sc AS ({LABELLED_SCORES}), t(threshold) AS (VALUES {LIT_T}), c AS (SELECT threshold, count(CASE WHEN score >= threshold AND label = 1 THEN 1 END) AS tp, count(CASE WHEN score >= threshold AND label = 0 THEN 1 END) AS fp,
      count(CASE WHEN score < threshold AND label = 1 THEN 1 END) AS fn, count(CASE WHEN score < threshold AND label = 0 THEN 1 END) AS tn FROM sc, t GROUP BY threshold)
      SELECT *, CAST(tp AS DOUBLE) / nullif(tp + fp, 0) AS "precision", CAST(tp AS DOUBLE) / nullif(tp + fn, 0) AS recall, fn * 5e0 + fp * 1e0 AS cost FROM c""",
    "nearest_vectors": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, c.vec_id, round(list_cosine_similarity(q.e, c.e), 6) AS score FROM v q, v c WHERE q.vec_id IN (0, 17, 101)),
      r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) SELECT * FROM r WHERE rank <= 10""",
}
ORACLES["vector_index_recall"] = "SELECT count(*) AS queries, true AS recall_reached FROM embeddings WHERE vec_id % 50 = 0"
ORACLES["nearest_to_table"] = ORACLES["nearest_vectors"].replace("q.vec_id IN (0, 17, 101)", "q.vec_id % 50 = 0")
ORACLES = {k: with_views(v) for k, v in ORACLES.items()}
