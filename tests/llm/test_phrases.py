"""Phrase collocations against a plain count of all word sequences."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from optelem.llm import phrases

DOCS = "doc_id long, text string, lang string"


def brute(data, least, top, longest=5):
    f, n = Counter(), Counter()
    for _, text, lang in data:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i:i + m])] += 1
    f = {p: c for p, c in f.items() if c >= least}
    longer = {}
    for (lang, p), c in f.items():
        for i in range(len(p)):
            for j in range(i + 2, len(p) + 1):
                if j - i < len(p):
                    longer[lang, p[i:j]] = max(c, longer.get((lang, p[i:j]), 0))
    rows = {}
    for (lang, p), a in f.items():
        if len(p) < 2 or 100 * longer.get((lang, p), 0) >= 100 * a:
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        rows.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, rank, p.decode(), -a, left, right, n[lang], -s) for lang, found in rows.items() for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1))


def found(df, **settings):
    result = phrases.collocations(df, **settings)
    assert result.dtypes == [("lang", "string"), ("rank", "bigint"), ("phrase", "string"), ("a", "bigint"), ("l", "bigint"), ("r", "bigint"), ("n", "bigint"), ("score", "bigint")]
    return sorted(tuple(r) for r in result.collect())


def texts(seed, n, vocabulary=9):
    random = np.random.default_rng(seed)
    words = ["the", "The", "of", "é", "É", "a\x01", "a", "\x00", "x\xa0y", "ﬀ", "𝐀", "zz", "q"][:vocabulary]
    gaps = [" ", " ", " ", "\t", "  ", ", ", ".", "\n", " ;", "\x0b", "!"]
    out = []
    for _ in range(n):
        size = int(random.integers(0, 80))
        out.append("".join(words[min(int(random.exponential(2)), vocabulary - 1)] + gaps[random.integers(len(gaps))] for _ in range(size)))
    return out


@pytest.mark.parametrize(("filter_bits", "budget"), [(27, 200_000), (3, 200_000), (27, 16), (12, 60)])
def test_phrases_equal_brute_force(spark, filter_bits, budget):
    data = [(i, t, ["en", None, "und", "de", ""][i % 5]) for i, t in enumerate(texts(filter_bits, 300, 13))] + [(1, None, "en"), (2, "", None), (3, "again and again", "fr")] + [(4, "in the end we all say so. ", "es")] * 150
    expected = brute(data, 10, 40)
    assert len(expected) > 100
    df = spark.createDataFrame(data, DOCS).repartition(5)
    assert found(df, least=10, top=40, filter_bits=filter_bits, budget=budget) == expected


def test_long_text_is_read_whole_and_block_size_is_not_seen(spark, monkeypatch):
    data = [(1, " ".join(texts(8, 800)), "en"), (2, "of the é " * 5000, "en"), (3, "w" * 100_000 + " of the", "en")]
    batch = spark.createDataFrame(data, DOCS).select("lang", F.col("text").cast("binary")).toArrow().to_batches()
    whole = [Counter(), Counter()]
    for size, count in ((phrases.BLOCK_BYTES, whole[0]), (1000, whole[1])):
        monkeypatch.setattr(phrases, "BLOCK_BYTES", size)
        for words in phrases.blocks(batch):
            for kind, n in enumerate(words.counts.tolist()):
                count[words.langs[kind], words.texts[kind]] += n
    assert whole[0] == whole[1]
    assert found(spark.createDataFrame(data, DOCS), least=5, top=5000) == brute(data, 5, 5000)


def test_prefixes_above_the_budget_are_extended():
    def marked(*cells):
        bits = np.zeros(1 << 17, dtype=np.uint8)
        for cell in cells:
            bits[cell >> 3] |= 1 << (cell & 7)
        return phrases.Bitmap(20, zlib.compress(bits))

    data = b"a b c1. a b c2. a d. e a"
    words = phrases.split_words(["en"], np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    h = dict(zip(words.texts, words.hashes()))
    every = phrases.Bitmap(20, zlib.compress(np.full(1 << 17, 255, np.uint8)))
    a, ab = phrases.word_cells(np.array([h[b"a"]]), 20)[0], phrases.pair_cells(np.array([h[b"a"]]), np.array([h[b"b"]]), 20)[0]
    found = sorted(phrases.windows_of(words, phrases.Filters(every, marked(a), every, marked(ab)), 5))
    assert [(w, depth, n) for _, w, depth, n in found] == [(b"a ", 2, 1), (b"a b c1 ", 6, 1), (b"a b c2 ", 6, 1), (b"a d ", 2, 1), (b"b c1 ", 1, 1), (b"b c2 ", 1, 1),
                                                           (b"c1 ", 1, 1), (b"c2 ", 1, 1), (b"d ", 1, 1), (b"e a ", 1, 1)]
    group = [phrases.prefix_group("en", w, d, 5, 1 << 40) for _, w, d, _ in found]
    assert group[4] == group[5] and len(set(group)) == len(group) - 1


def test_node_counts_are_sums_of_leaves():
    leaves = {b"a b c ": [3, 2], b"a b ": [1, 2], b"a\x01 ": [2, 1], b"a ": [5, 2], b"b ": [4, 1]}
    assert sorted(phrases.subtree_counts(leaves, 3)) == [(b"a", 1, 9, False), (b"a b", 2, 4, True), (b"a b c", 3, 3, True), (b"b", 1, 4, True)]


def test_no_phrases(spark):
    assert found(spark.createDataFrame([], DOCS)) == []
    assert found(spark.createDataFrame([(1, None, None), (2, " . ", "en"), (3, "one two", "en")], DOCS)) == []


def test_further_columns_and_ties(spark):
    data = [(i, t, "en") for i, t in enumerate(["a b. c d. e f. a b"] * 20)]
    df = spark.createDataFrame(data, DOCS).withColumns({c: F.lit("x") for c in ("win", "n", "phrase", "LANG_", "f", "group_no")})
    assert found(df, least=20, top=2) == brute(data, 20, 2)
    assert [r[2] for r in found(df, least=20, top=3)] == ["c d", "e f", "a b"]


def test_scores_beyond_64_bits(spark):
    numbers = [(10 ** 13, 10 ** 15, 10 ** 13 + 7, 3 * 10 ** 13 + 1), (100, 9 * 10 ** 18, 10 ** 9, 10 ** 9), (2 ** 57, 2 ** 57, 2 ** 57, 2 ** 57)]
    df = spark.createDataFrame(numbers, "a long, n long, l long, r long").select("a", "n", "l", "r", phrases.floor_score().alias("s"))
    assert all(r.s == 1000 * r.a * r.n // (r.l * r.r) for r in df.collect())
