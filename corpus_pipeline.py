"""The corpus pipeline: documents through quality rules, toxicity, near-duplicates, mixing and tokenization.

Every stage takes any columns beside those of documents, whatever their names, and returns them; empty tables stay empty.
NULL and empty texts fail the quality rules; a later stage that is given some scores them as wordless, puts them into one
near-duplicate group, takes none of their words and gives them no tokens. Rows that repeat a document are judged alike;
one of them passes the near-duplicate stage. A row with a NULL id passes it only where its group has no other. NULL is a
source of its own to the mixture. Texts are never cut.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from optelem.llm import mixing, quality_rules, simhash, toxicity
from optelem.llm.queries import MAX_BITS, SHINGLE, tokenizer
from optelem.session import ensure_checkpoint_dir


def _packed(docs: DataFrame, *needed: str) -> DataFrame:
    """Whole rows in one column beside those that an operator needs, so that no name of its results can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *needed)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the lines that fail them; n_chars follows the text."""
    clean = quality_rules.apply_rules(_packed(docs, "text")).where("kept").select("_row.*", F.col("clean_text").alias("_clean"))
    new = {"text": F.col("_clean"), "n_chars": F.length("_clean")}
    return clean.select(*[new[c].cast(kind).alias(c) if c in new else F.col(f"`{c}`") for c, kind in docs.dtypes])


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled ones among them, scores below one half."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(_packed(docs, "text"), model).where("predicted = 0").select("_row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group."""
    return simhash.one_per_group(_packed(docs, "doc_id", "text"), shingle=SHINGLE, max_bits=MAX_BITS).select("_row.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it."""
    return mixing.repeat_rows(mixing.mix(_packed(docs, "doc_id", "source", "text")), ["_row"]).select("_row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of the decoded bytes."""
    codec = tokenizer(spark)
    coded = codec.decode(codec.encode(docs.select("doc_id", "source", "text"), "text", "ids"), "ids", "decoded")
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("toxicity", civil),
    ("near copies", near_copies),
    ("mixture", mixture),
    ("tokens", tokens),
]
#: Toxicity and SimHash groups are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the checkpoint folder as Parquet and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return STAGES[-1][1](spark, docs, sf_dir)
