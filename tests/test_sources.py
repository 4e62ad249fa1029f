import json
import time

import pytest
from pyspark.sql import functions as F

from optelem.operators import quality
from optelem.sources import documents, sinks, tables
from optelem.sources.ingest_format import TelemetryIngest
from tests.conftest import SMALL, events, rows


def test_scan_from_path_and_table(spark):
    df = tables.scan_events(spark, f"{SMALL}/events.parquet")
    df.createOrReplaceTempView("events_for_scan")
    assert tables.scan_events(spark, "events_for_scan").count() == df.count() > 0


def test_changes(spark):
    df = spark.createDataFrame([(1,), (5,), (9,)], "id long")
    assert rows(tables.changes_since(df, "id", 4)) == [(2, 9)] and rows(tables.changes_since(df, "id", 9)) == [(0, 9)]


def test_stale(spark, tmp_path):
    for name in ("in/a.md", "out/a.html", "in/b.md"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    import os
    now = time.time()
    os.utime(tmp_path / "in/a.md", (now, now))
    os.utime(tmp_path / "out/a.html", (now - 100, now - 100))

    def listed(folder):
        return tables.file_times(spark, str(tmp_path / folder)).select(F.regexp_extract("path", r"([a-z]+)\.[a-z]+$", 1).alias("dataset"), "modified_at")

    assert rows(tables.stale_outputs(listed("in"), listed("out"))) == [("a", True), ("b", True)]
    os.utime(tmp_path / "out/a.html", (now, now))
    assert rows(tables.stale_outputs(listed("in"), listed("out"))) == [("a", False), ("b", True)]


def test_batches_keep_unknown_keys(spark, tmp_path):
    docs = [{"source": "k8s", "cluster_id": "c", "batch_id": "b1", "records": [{"pod": "p", "n": 1}, {"pod": "q", "extra": {"x": [1]}}]},
            {"source": "spark", "records": []}, {"source": "wh", "records": [{"tenant": "t"}]}]
    (tmp_path / "f.json").write_text("\n".join(json.dumps(d) for d in docs) + "\nnot json\n\n[1]\n{\"records\": 5}\n")
    out = documents.scan_batches(spark, str(tmp_path))
    lost = out.where("reason IS NOT NULL")
    assert rows(lost, "reason", "raw", "pos") == sorted([("no_records", json.dumps(docs[1]), None), ("malformed_json", "not json", None), ("empty_document", "", None),
                                                         ("no_records", "[1]", None), ("no_records", '{"records": 5}', None)], key=repr)
    letters = documents.batch_dead_letters(out)
    other = quality.dead_letters(spark.createDataFrame([(1, "k", 2, "bad_status")], "event_id long, idempotency_key string, delivery int, reason string"))
    assert letters.unionByName(other).count() == 6 and rows(letters.where("payload = 'not json'"), "error_class", "attempts") == [("malformed_json", 1)]
    assert rows(out.where("reason IS NULL").select("source", "cluster_id", "batch_id", "pos", F.to_json("record"))) == sorted([
        ("k8s", "c", "b1", 0, '{"n":1,"pod":"p"}'), ("k8s", "c", "b1", 1, '{"extra":{"x":[1]},"pod":"q"}'), ("wh", None, None, 0, '{"tenant":"t"}')], key=repr)


def test_predictions(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"score":0.5,"tenant_id":"t","scored_at":"2024-01-01T10:00:00"}\n{"tenant_id":"u","scored_at":"soon"}\n')
    out = documents.load_predictions(spark, str(tmp_path), {"tenant_id": "string", "score": "double", "scored_at": "string"}, ["scored_at"])
    assert [(r["tenant_id"], r["score"], r["scored_at"] and r["scored_at"].hour) for r in out.orderBy("tenant_id").collect()] == [("t", 0.5, 10), ("u", None, None)]


def test_notes(spark, tmp_path):
    head = "---\ntitle: \"T: x\"\nsummary: s\npublishedAt: {d}\nnote: Note 9\n{c}{x}---\n\n{b}"
    cats = "categories:\n  - Data\n  - 'Ops'\n"
    body = "## One\n\ntext\n\n## Two\n"
    (tmp_path / "ok.md").write_text(head.format(d="2024-01-05", c=cats, x="featured: true\n", b=body))
    (tmp_path / "inline.md").write_text(head.format(d="2024-01-05", c="categories: [A, \"B\"]\n", x="updatedAt: 2024-02-01\n", b=body))
    (tmp_path / "nocat.md").write_text(head.format(d="2024-01-05", c="", x="", b=body))
    (tmp_path / "short.md").write_text(head.format(d="2024-01-05", c=cats, x="", b="## One\n"))
    (tmp_path / "draft.md").write_text(head.format(d="2024-01-05", c=cats, x="draft: true\n", b="x"))
    (tmp_path / "date.md").write_text(head.format(d="soon", c=cats, x="", b=body))
    (tmp_path / "bare.md").write_text("# no front matter\n")
    (tmp_path / "skip.txt").write_text("x")
    out = {r["id"]: r for r in documents.scan_notes(spark, str(tmp_path)).collect()}
    assert {k: r["error"] for k, r in out.items()} == {"ok": None, "inline": None, "nocat": "no_categories", "short": "too_few_sections", "draft": None, "date": "bad_date", "bare": "no_front_matter"}
    assert (out["ok"]["title"], out["ok"]["categories"], out["ok"]["featured"], out["ok"]["draft"]) == ("T: x", ["Data", "Ops"], True, False)
    assert out["inline"]["categories"] == ["A", "B"] and str(out["inline"]["updated_at"]) == "2024-02-01 00:00:00" and out["ok"]["body"].startswith("## One")


def test_lockfiles(spark, tmp_path):
    (tmp_path / "r.txt").write_text("A-b==1.2 ; x\n# c\n\n- `left`: ^3.4\nuvicorn[standard]==0.30.1\nplain>=2\n")
    assert rows(documents.lockfile_inventory(spark, str(tmp_path)), "ecosystem", "package", "version") == [
        ("npm", "left", "3.4"), ("pypi", "a-b", "1.2"), ("pypi", "uvicorn", "0.30.1")]


def records(spark, n, size=10, tenant="t"):
    df = spark.range(n).select(F.lit(tenant).alias("tenant_id"), F.lit("s").alias("source"), F.col("id").alias("event_id"))
    return df.withColumn("record", F.concat(F.lit('{"a":"'), F.repeat(F.lit("x"), size - 8), F.lit('"}')))


def test_packing_limits_and_hot_source(spark):
    df = records(spark, 1000).unionByName(records(spark, 26, tenant="u"))
    out = sinks.pack_batches(df, bucket_rows=300).cache()
    assert out.count() == 1026 and out.select("tenant_id", "event_id").distinct().count() == 1026
    sizes = out.groupBy("tenant_id", "batch_id").agg(F.count("*").alias("n"), F.max("pos").alias("p"))
    assert sizes.agg(F.max("n")).first()[0] == 25 and sizes.where("p <> n - 1").count() == 0
    assert sorted(r["n"] for r in sizes.where("tenant_id = 'u'").collect()) == [1, 25]
    assert rows(out) == rows(sinks.pack_batches(df, bucket_rows=300))


def test_packing_by_bytes(spark):
    big = records(spark, 5, size=60)
    out = sinks.pack_batches(big.unionByName(records(spark, 1, size=101).withColumn("event_id", F.lit(99).cast("long"))), max_bytes=220)
    assert rows(out.groupBy("batch_id").count(), "count") == [(1,)] * 5
    assert all(len(r["document"].encode()) <= 220 for r in sinks.batch_documents(out).collect())
    full = sinks.batch_documents(sinks.pack_batches(records(spark, 40, size=17), max_bytes=500))
    assert max(len(r["document"]) for r in full.collect()) in range(483, 501)
    assert sinks.oversized(records(spark, 1, size=101), max_bytes=100).count() == 1
    document = sinks.batch_documents(sinks.pack_batches(records(spark, 3))).first()["document"]
    assert len(json.loads(document)["records"]) == 3


def test_upsert(spark, tmp_path):
    target = str(tmp_path / "t")

    def batch(data):
        return spark.createDataFrame(data, "k string, version long, v string, day string")

    for _ in range(2):
        sinks.upsert_results(batch([("a", 1, "old", "d1"), ("b", 1, "x", "d2"), ("a", 2, "new", "d1")]), target, ["k"], ["version"])
    sinks.upsert_results(batch([("a", 1, "late", "d1"), ("c", 1, "c", "d1")]), target, ["k"], ["version"])
    schema = batch([("a", 1, "", "")]).schema

    def now():
        return rows(sinks.read_results(spark, target, schema, ["k"], ["version"]), "k", "v")

    assert now() == [("a", "new"), ("b", "x"), ("c", "c")]
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    assert len(files) == 4  # a repeated batch adds nothing: two days of the first, two keys of the other
    sinks.upsert_results(batch([("b", 2, "y", "d2")]), target, ["k"], ["version"], batch_id=7)
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    assert len(after) == 5 and files.items() <= after.items()  # no older file is written
    assert not list(tmp_path.rglob("*__staged*")) and now() == [("a", "new"), ("b", "y"), ("c", "c")]
    assert sinks.compact_results(spark, target, schema, ["k"], ["version"], most=1) == 2  # the buckets of a and b
    left = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    assert now() == [("a", "new"), ("b", "y"), ("c", "c")] and len(left) == 3 and len(left.items() & after.items()) == 1
    assert sinks.compact_results(spark, target, schema, ["k"], ["version"], most=1) == 0
    assert rows(sinks.read_results(spark, str(tmp_path / "none"), schema, ["k"], ["version"])) == []


def test_export(spark, tmp_path):
    df = spark.createDataFrame([("t", 1), ("t", 2)], "tenant_id string, n int")
    for fmt in ("csv", "json", "parquet"):
        job = sinks.export_tenant(df, "t", f"job-{fmt}", str(tmp_path), fmt).first()
        assert job["n"] == 2 and (tmp_path / "tenants/t/exports" / f"job-{fmt}").exists()
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        sinks.export_tenant(df, "t", "job-csv", str(tmp_path), "csv")
    with pytest.raises(PermissionError):
        sinks.export_tenant(df.unionAll(spark.createDataFrame([(None, 3)], df.schema)), "t", "j2", str(tmp_path))


def test_unload(spark, tmp_path):
    from optelem.operators import rollups
    roll = rollups.hourly_rollup(events(spark, [("t", "s", 1, 1, "2024-01-01 00:10:00", 200, 1.0), ("t", "s", 1, 2, "2024-01-05 00:10:00", 200, 2.0)]))
    for _ in range(2):
        sinks.unload_recent(roll, "2024-01-05 12:00:00", str(tmp_path / "u"))
    assert rows(spark.read.parquet(str(tmp_path / "u")), "metric_name", "metric_value") == [("avg_latency", 2.0), ("errors", 0.0), ("requests", 1.0)]


def test_ingest_format(spark, tmp_path):
    spark.dataSource.register(TelemetryIngest)
    path = str(tmp_path / "landing")
    spark.range(60).select("id", F.lit("é").alias("s"), F.current_date().alias("d")).coalesce(1).write.format("telemetry_ingest").mode("append").option("path", path).option("source", "unit").save()
    back = documents.scan_batches(spark, path)
    assert rows(back.groupBy("batch_id").count(), "count") == [(10,), (25,), (25,)]
    assert back.where(F.expr("variant_get(record, '$.s', 'string')") == "é").count() == 60 and back.first()["source"] == "unit"
    again = f"file://{tmp_path}/again"
    spark.range(60).select("id", F.lit("é").alias("s"), F.current_date().alias("d")).coalesce(1).write.format("telemetry_ingest").mode("append").option("path", again).option("source", "unit").save()
    assert rows(documents.scan_batches(spark, again).select("batch_id").distinct()) == rows(back.select("batch_id").distinct())


def test_results_of_distinct_keys_and_named_columns(spark, tmp_path):
    """A batch without repeats is dealt out once, and readers that name columns shuffle no others."""
    schema = spark.createDataFrame([], "k string, version int, v string, day string").schema
    target = str(tmp_path / "t")
    first = spark.createDataFrame([("a", 1, "x", "d1"), ("b", 1, "y", "d1"), (None, 3, "z", "d2")], schema)
    sinks.upsert_results(first, target, ["k"], ["version"], batch_id=1, buckets=2, distinct=True)
    sinks.upsert_results(spark.createDataFrame([("a", 2, "new", "d1")], schema), target, ["k"], ["version"], batch_id=2, buckets=2, distinct=True)
    found = sinks.read_results(spark, target, schema, ["k"], ["version"], ["v"])
    assert found.columns == ["v"] and rows(found) == [("new",), ("y",), ("z",)]
    narrow = sinks.read_results(spark, target, schema, ["k"], ["version"], ["k"])
    read = narrow._jdf.queryExecution().executedPlan().toString()
    assert "v#" not in read.split("ReadSchema")[0] and rows(narrow) == [("a",), ("b",), (None,)]
    assert sinks.read_results(spark, str(tmp_path / "none"), schema, ["k"], ["version"], ["v"]).columns == ["v"]
