"""Registered queries of the operators; their DuckDB oracles are in oracles.py."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from optelem.llm import audit, caps, licenses, mixing, packing, phrases, quality_rules, sharding, simhash, site_templates, toxicity, warc
from optelem.llm.bpe import Tokenizer
from optelem.session import ensure_checkpoint_dir

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
SHINGLE, MAX_BITS = 4, 4
SEQUENCE = 2048


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(spark: SparkSession) -> Tokenizer:
    return Tokenizer(spark, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_rules(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words",
                         F.sha2("clean_text", 256).alias("clean_sha256"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = packing.library_ids(spark, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return packing.pack(_table(spark, sf_dir, "documents").select("doc_id", ids(F.col("text")).alias("ids")), capacity=SEQUENCE)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = tokenizer(spark)
    coded = codec.decode(codec.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "ids"), "ids", "decoded")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.groups(_table(spark, sf_dir, "embeddings"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(_table(spark, sf_dir, "documents"))


def op9_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(_table(spark, sf_dir, "pages"), folder)
    found = warc.read(spark.read.format("binaryFile").load(folder), payloads=False).where("gap_reason IS NULL")

    def page(uri: str):
        return F.nullif(F.regexp_extract(uri, "^<urn:page:(.*)>$", 1), F.lit("")).cast("long")

    return found.select(page("record_id").alias("page_id"), "payload_bytes", F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"),
                        "record_type", page("refers_to").alias("refers_to"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(_table(spark, sf_dir, "documents"), shingle=SHINGLE, max_bits=MAX_BITS)
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op13_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_templates.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_quality_rules, op3_packing, op4_license_scan, op5_source_mix, op6_byte_bpe,
                                   op7_embedding_dedup, op8_sharding, op9_warc_salvage, op10_simhash_dedup, op11_filter_audit, op12_phrase_collocations, op13_html_main_text)}
