"""Readers of posted batches, scored results, Markdown notes and dependency manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_batches(spark: SparkSession, folder: str) -> DataFrame:
    """`parse_batches` of the files of a folder."""
    return parse_batches(spark.read.text(folder))


def parse_batches(lines: DataFrame) -> DataFrame:
    """source, cluster_id, batch_id, pos, record, reason, raw: one row per record of posted batch documents, a JSON document per `value`.

    Records keep every key as Variant. A document without records leaves one row, with the `reason` and its text in
    `raw`: empty_document, malformed_json, or no_records (none listed, or no list).
    """
    schema = "source string, cluster_id string, batch_id string, records array<variant>"
    parsed = lines.select("value", F.from_json("value", schema).alias("b"))
    whole = F.try_parse_json("value")
    reason = (F.when(F.trim(F.coalesce("value", F.lit(""))) == "", "empty_document").when(whole.isNull(), "malformed_json")
              .when(F.coalesce(F.size("b.records"), F.lit(0)) <= 0, "no_records"))
    judged = parsed.withColumn("reason", reason)
    records = F.when(F.col("reason").isNull(), F.col("b.records"))
    return judged.select("b.source", "b.cluster_id", "b.batch_id", F.posexplode_outer(records).alias("pos", "record"), "reason",
                         F.when(F.col("reason").isNotNull(), F.coalesce("value", F.lit(""))).alias("raw"))


def batch_dead_letters(batches: DataFrame) -> DataFrame:
    """Documents of `parse_batches` without records, in the columns of `quality.dead_letters`: the payload is the text as it came, its hash the key."""
    return batches.where("reason IS NOT NULL").select(F.lit(None).cast("long").alias("event_id"), F.sha2("raw", 256).alias("idempotency_key"),
                                                      F.col("reason").alias("error_class"), F.col("raw").alias("payload"), F.lit(1).alias("attempts"))


def load_predictions(spark: SparkSession, folder: str, fields: dict[str, str], times: list[str]) -> DataFrame:
    """`parse_predictions` of the files of a folder."""
    return parse_predictions(spark.read.text(folder), fields, times)


def parse_predictions(lines: DataFrame, fields: dict[str, str], times: list[str]) -> DataFrame:
    """Scored results, a JSON object per `value`; columns match by name, `times` are parsed where they can be."""
    schema = ", ".join(f"{n} {'string' if n in times else t}" for n, t in fields.items())
    rows = lines.select(F.from_json("value", schema).alias("r")).select("r.*")
    return rows.select(*[F.try_to_timestamp(F.col(n)).alias(n) if n in times else F.col(n) for n in fields])


def _front(name: str):
    """Value of a top-level front-matter line, without quotes."""
    raw = F.regexp_extract("_front", rf"(?m)^{name}:[ \t]*(.*?)[ \t]*$", 1)
    bare = F.regexp_replace(raw, r"""^(["'])(.*)\1$""", "$2")
    return F.nullif(bare, F.lit(""))


def scan_notes(spark: SparkSession, folder: str) -> DataFrame:
    """`parse_notes` of the Markdown files of a folder."""
    return parse_notes(spark.read.text(folder, wholetext=True, pathGlobFilter="*.md").select(F.input_file_name().alias("path"), "value"))


def parse_notes(files: DataFrame) -> DataFrame:
    """Markdown notes (path, value) as id, title, summary, published_at, updated_at, note, categories, featured, draft, body, error.

    Dates may carry a time of day, by which notes are ordered. `error` names the first broken rule: front matter, a required field, a date, categories, or
    (for notes that are no drafts) fewer than two level-two sections.
    """
    fence = r"(?s)^---\r?\n(.*?)\r?\n---\r?\n(.*)$"
    parts = (files.withColumn("_has", F.col("value").rlike(fence))
             .withColumn("_front", F.regexp_extract("value", fence, 1)).withColumn("body", F.regexp_replace(F.regexp_extract("value", fence, 2), r"^\s+|\s+$", "")))
    block = F.regexp_extract("_front", r"(?m)^categories:[ \t]*\r?\n((?:[ \t]*-[ \t]+.*(?:\r?\n|$))+)", 1)
    inline = F.regexp_extract("_front", r"(?m)^categories:[ \t]*\[(.*?)\][ \t]*$", 1)
    listed = F.when(block != "", F.regexp_extract_all(block, F.lit(r"(?m)^[ \t]*-[ \t]+(.*?)[ \t]*$"), 1)).otherwise(F.split(inline, ","))
    categories = F.filter(F.transform(listed, lambda c: F.regexp_replace(F.trim(c), r"""^["']|["']$""", "")), lambda c: c != "")
    rows = parts.select(
        F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("id"), _front("title").alias("title"), _front("summary").alias("summary"),
        _front("publishedAt").try_cast("timestamp_ntz").alias("published_at"), _front("updatedAt").alias("_updated"),
        _front("note").alias("note"), categories.alias("categories"), _front("featured").alias("_featured"), _front("draft").alias("_draft"), "body", "_has")
    rows = (rows.withColumn("updated_at", F.col("_updated").try_cast("timestamp_ntz"))
            .withColumn("featured", F.coalesce(F.col("_featured").try_cast("boolean"), F.lit(False)))
            .withColumn("draft", F.coalesce(F.col("_draft").try_cast("boolean"), F.lit(False))))
    sections = F.regexp_count("body", F.lit(r"(?m)^##\s+\S.*$"))
    error = (F.when(~F.col("_has"), F.lit("no_front_matter"))
             .when(F.col("title").isNull(), F.lit("no_title")).when(F.col("summary").isNull(), F.lit("no_summary"))
             .when(F.col("published_at").isNull(), F.lit("bad_date")).when(F.col("_updated").isNotNull() & F.col("updated_at").isNull(), F.lit("bad_date"))
             .when(F.col("note").isNull(), F.lit("no_note")).when(F.size("categories") == 0, F.lit("no_categories"))
             .when(~F.col("draft") & (sections < 2), F.lit("too_few_sections")))
    return rows.select("id", "title", "summary", "published_at", "updated_at", "note", "categories", "featured", "draft", "body", error.alias("error"))


def lockfile_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """`parse_manifests` of the files below a folder."""
    return parse_manifests(spark.read.text(folder, recursiveFileLookup=True).select(F.input_file_name().alias("path"), "value"))


def parse_manifests(lines: DataFrame) -> DataFrame:
    """path, ecosystem, package, version from manifest lines (path, value) `name==version` and - `name`: version."""
    lines = lines.select("path", F.trim("value").alias("line"))
    pinned, listed = r"^([A-Za-z0-9._-]+)(?:\[[^\]]*\])?==([^\s;#]+)", r"^(?:[-*]\s+)?`([^`]+)`:\s*[~^>=<v]*\s*([0-9][^\s,;]*)"
    is_pinned = F.col("line").rlike(pinned)
    package = F.when(is_pinned, F.regexp_extract("line", pinned, 1)).otherwise(F.regexp_extract("line", listed, 1))
    version = F.when(is_pinned, F.regexp_extract("line", pinned, 2)).otherwise(F.regexp_extract("line", listed, 2))
    ecosystem = F.when(is_pinned, F.lit("pypi")).otherwise(F.lit("npm"))
    return lines.where(is_pinned | F.col("line").rlike(listed)).select("path", ecosystem.alias("ecosystem"), F.lower(package).alias("package"), version.alias("version"))
