"""Byte-level BPE against the tokenizer library, packing against its input."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from optelem.llm import packing, queries
from optelem.llm.bpe import Codec, PerfectHash, read_ranks

PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def ranks():
    with open(public_tokenizers.path(queries.VOCABULARY), "rb") as f:
        return read_ranks(f.read())


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(codec, text):
    return np.frombuffer(codec.encode(text), dtype="<i4").tolist()


@pytest.mark.parametrize("n", [0, 1, 2, 5, 300])
def test_perfect_hash_is_minimal(n):
    keys = [f"key {i}".encode() for i in range(n)]
    table = PerfectHash(keys)
    assert sorted(table.find(k) for k in keys) == list(range(n))
    assert table.find(b"other") == -1


def test_vocabulary_resolves_in_the_first_tier(ranks):
    codec = Codec(ranks, PATTERN)
    assert all(codec.slot_id[codec.table.find(t)] == r for t, r in list(ranks.items())[::37])


def test_encoding_equals_the_library(ranks, library):
    codec, chance = Codec(ranks, PATTERN), random.Random(4)
    for alphabet in ("ab \n'sтé😀z1", "the of and", "\x1c\x85\xa0²ªß ", "".join(map(chr, range(0x250, 0x2000, 13))), "࢏\U00016ea0a1 "):
        for _ in range(150):
            text = "".join(chance.choice(alphabet) for _ in range(chance.randint(0, 50)))
            assert ids(codec, text) == library.encode_ordinary(text), repr(text)
            assert codec.decode(ids(codec, text)) == text.encode()
    for text in ("a" * 50_000, "xyz " * 20_000, "<|endoftext|>", ""):
        assert ids(codec, text) == library.encode_ordinary(text)


def test_round_trip_of_odd_rows(spark, library):
    coder = queries.tokenizer(spark)
    data = [(1, "Hello  world\n\n you're 42"), (1, "Hello  world\n\n you're 42"), (2, None), (None, ""), (3, "é " * 30_000)]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("IDS", F.lit("old"))
    found = coder.decode(coder.encode(df)).collect()
    assert len(found) == 5 and "IDS" not in found[0].asDict()
    for r in found:
        assert r["ids"] == library.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
    strange = spark.createDataFrame([([1, 60_000],), ([None],), (None,), ([-1],), ([],)], "ids array<int>")
    assert [r["decoded"] and bytes(r["decoded"]) for r in coder.decode(strange).collect()] == [None, None, None, None, b""]
    assert coder.encode(df.limit(0)).count() == 0


def test_op6_equals_the_library(spark, sf, library):
    import hashlib
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op6_byte_bpe(spark, sf).collect():
        own = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(own)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, own)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def plain_best_fit(lengths, capacity):
    room = []
    for n in lengths:
        fits = [(r, k) for k, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits)[1]] -= n
        else:
            room.append(capacity - n)
    return sorted(room)


@pytest.mark.parametrize("capacity", [1, 2, 7, 8, 100, 2048])
def test_best_fit_by_brute_force(capacity):
    chance = random.Random(capacity)
    for _ in range(40):
        lengths = sorted((chance.randint(1, capacity) for _ in range(chance.randint(0, 60))), reverse=True)
        found = packing.best_fit(lengths, capacity)
        assert sorted(p for r in found for p in r) == list(range(len(lengths)))
        assert sorted(capacity - sum(lengths[p] for p in r) for r in found) == plain_best_fit(lengths, capacity)


def unpacked(packed):
    """Tokens of each document, put together from the segments."""
    parts = {}
    for r in packed:
        matrix, position = np.frombuffer(r["input_ids"], "<u2"), np.frombuffer(r["position_ids"], "<u2")
        assert r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] == r["n_tokens"] <= len(matrix)
        assert not matrix[r["n_tokens"]:].any() and not position[r["n_tokens"]:].any()
        for d, at, a, b in zip(r["doc_ids"], r["first_tokens"], r["cu_seqlens"], r["cu_seqlens"][1:]):
            assert position[a:b].tolist() == list(range(b - a))
            parts.setdefault(d, []).append((at, matrix[a:b].tolist()))
    return {d: sorted(p) for d, p in parts.items()}


def test_packing_loses_nothing(spark, sf, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    packed = queries.op3_packing(spark, sf).collect()
    found = unpacked(packed)
    for d, text in texts.items():
        own = library.encode_ordinary(text)
        assert [t for _, part in found.get(d, []) for t in part] == own
    assert sum(r["n_tokens"] for r in packed) > 0.97 * queries.SEQUENCE * (len(packed) - 2)


def test_packing_refuses_what_does_not_fit(spark, monkeypatch, tmp_path):
    for bad in (65_536, -1, None):
        df = spark.createDataFrame([(1, [5, 65_535]), (2, [7, bad])], "doc_id long, ids array<int>")
        with pytest.raises(Exception, match="do not fit <u2"):
            packing.pack(df, capacity=8).collect()
    wide = spark.createDataFrame([(1, [5, 65_536])], "doc_id long, ids array<int>")
    assert unpacked(packing.pack(wide.limit(0), capacity=8).collect()) == {} and packing.pack(wide, capacity=8, dtype="<u4").count() == 1
    monkeypatch.setattr(packing, "MAX_VOCABULARY_BYTES", 10)
    (tmp_path / "ranks").write_bytes(b"x" * 11)
    with pytest.raises(ValueError, match="larger"):
        packing.library_ids(spark, str(tmp_path / "ranks"), ".")


def test_packing_of_odd_tables(spark, monkeypatch):
    data = [(1, [5] * 10), (1, [5] * 10), (2, None), (3, []), (None, [7, 8, 9]), (4, list(range(23)))]
    df = spark.createDataFrame(data, "doc_id long, ids array<int>").withColumn("shard", F.lit("x"))
    packed = packing.pack(df, capacity=8).collect()
    found = unpacked(packed)
    assert [t for _, p in found[4] for t in p] == list(range(23)) and found[None] == [(0, [7, 8, 9])]
    assert sum(len(p) for _, p in found[1]) == 20 and set(found) == {1, None, 4}
    assert packing.pack(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, capacity=70_000)
