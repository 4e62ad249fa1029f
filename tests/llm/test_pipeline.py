"""The pipeline: each stage on its own input, and the whole against a brute-force version."""

import hashlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
import corpus_pipeline
from optelem.llm import queries, quality_rules, toxicity
from optelem.llm.bpe import read_ranks
from tests.llm.test_groups import brute_fingerprint, union
from tests.llm.test_texts import brute_mix

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The result of every stage, written and read again."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages_keep_the_columns(stages):
    assert len(corpus_pipeline.STAGES) == 5
    for df in stages[:-1]:
        assert df.dtypes == stages[0].dtypes
    counts = [df.count() for df in stages]
    assert counts[0] > counts[1] > counts[2] > counts[3] > 0


def test_quality_and_toxicity_stages(spark, stages):
    judged = {r["doc_id"]: quality_rules.judge((r["text"] or "").encode()) for r in stages[0].collect()}
    kept = {d: j[-1] for d, j in judged.items() if j[6]}
    assert {r["doc_id"]: r["text"] for r in stages[1].collect()} == kept
    model = toxicity.fit(stages[1], spark.read.parquet(f"{SF}/labels.parquet"))
    civil = {d for d, p in zip(kept, model.scores(list(kept.values()))) if p < 0.5}
    assert {r["doc_id"] for r in stages[2].collect()} == civil


def test_copies_mixture_and_tokens_by_brute_force(stages):
    data = [(r["doc_id"], r["text"], r["source"]) for r in stages[2].collect()]
    prints = [brute_fingerprint(t) for _, t, _ in data]
    root = union(len(data), [(i, j) for i in range(len(data)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
    least = {}
    for (d, *_), r in zip(data, root):
        least[r] = min(least.get(r, d), d)
    single = [x for x in data if x[0] in set(least.values())]
    assert sorted(r["doc_id"] for r in stages[3].collect()) == sorted(x[0] for x in single)
    sizes = {x[0]: len(x[1].encode().split()) for x in single}
    words = sum(taken for *_, taken in brute_mix(single))
    taken = [r["doc_id"] for r in stages[4].collect()]
    assert sum(sizes[d] for d in taken) == words and max(taken.count(d) for d in set(taken)) <= 3
    with open(public_tokenizers.path(queries.VOCABULARY), "rb") as f:
        library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(f.read()), special_tokens={})
    text = {x[0]: x[1] for x in single}
    for r in stages[5].collect():
        assert r["ids"] == library.encode_ordinary(text[r["doc_id"]]) and r["n_tokens"] == len(r["ids"])
        assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()


def test_run_equals_the_written_stages(spark, stages):
    columns = ["doc_id", "n_tokens", "decoded_sha256"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select(*columns).collect())) == sorted(map(tuple, stages[-1].select(*columns).collect()))
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" in entry_module.queries() and "pipeline" not in entry_module.oracle_sql()


def test_stages_of_odd_tables(spark):
    good = " ".join(f"Word{i} goes {i * 7} ways." for i in range(40))
    data = [(1, good, "en", "a", 9), (1, good, "en", "a", 9), (None, good + " More.", None, None, None), (2, None, None, "b", 0), (3, "", "en", None, 0), (4, " ".join(f"Long{i} text{i}." for i in range(30_000)), "en", "a", 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumn("score", F.lit("s")).withColumn("size", F.lit("z")).withColumn("kept", F.lit("k")).withColumn("clean_text", F.lit("c")).withColumn("fp", F.lit("f"))
    for empty in (False, True):
        df = docs.limit(0) if empty else docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            df = stage(spark, df, SF)
            assert df.columns == docs.columns
        assert (corpus_pipeline.STAGES[-1][1](spark, df, SF).count() == 0) == empty


def test_ten_operators_are_registered():
    names = [n for n in entry_module.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n[2].isdigit()) == list(range(1, 14))
