"""Quality rules, toxicity, licences, mixing: small hand-made tables."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from optelem.llm import licenses, mixing, quality_rules, toxicity
from optelem.llm.license_rules import Rule, all_rules
from tests.conftest import rows

DOCS = "doc_id long, text string, source string"
GOOD = "The quick brown fox walks over the hill and looks at the river below. " * 1 + " ".join(f"Word{i} follows." for i in range(60))


def documents(spark, data):
    return spark.createDataFrame(data, DOCS)


def judged(spark, *texts, **extra):
    df = documents(spark, [(i, t, "s") for i, t in enumerate(texts)])
    for name, value in extra.items():
        df = df.withColumn(name, F.lit(value))
    return [r.asDict() for r in quality_rules.apply_rules(df).orderBy("doc_id").collect()]


def test_quality_figures_of_odd_texts(spark):
    found = judged(spark, None, "", " \t\n\x0b\f\r ", "a b c a b c", "é x #|\ny\ny\n\n", "x " * 3)
    assert [(r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in found] == [
        (0, 0, 0, 0, 0), (0, 0, 0, 0, 0), (0, 0, 0, 0, 0), (6, 6, 0, 0, 6), (4, 7, 2, 1, 0), (3, 3, 0, 0, 0)]
    assert all(r["base_failed"] and not r["kept"] for r in found)


def test_quality_repeats_by_brute_force():
    random = np.random.default_rng(1)
    for _ in range(200):
        words = [bytes([97 + x]) for x in random.integers(0, 3, random.integers(0, 15))]
        windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
        covered = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in (i, i + 1, i + 2)}
        assert quality_rules.repeated_words(words) == len(covered)


@pytest.mark.parametrize(("line", "rule"), [
    ("Home | News | Sport | Weather", "navigation"), ("a### b$$$ c&&& d%%%.", "symbols"), ("All rights reserved.", "boilerplate"),
    ("We use cookies. Accept all cookies.", "boilerplate"), ("BUY THIS NOW!! FREE!!", "shouting"), ("no sentence ends here", "punctuation"),
    ("It ends. but goes on", None), ("A line that ends well.", None), ("„Ja“, sagte er. »Gut!«", None)])
def test_quality_line_rules(line, rule):
    lower = line.lower()
    searches = [search for hint, search in quality_rules._boilerplate if hint in lower]
    assert quality_rules.line_failure(line, line.encode().split(), searches) == rule


def test_quality_removes_lines_then_rejects_documents(spark):
    junk = "Home | News | Sport | Weather | Travel"
    lightly, heavily = GOOD + "\n" + junk + "\nThe end.", "\n".join([GOOD] + [junk] * 30)
    found = judged(spark, lightly, heavily, kept="old", Clean_Text=1)
    assert [r["kept"] for r in found] == [True, False]
    assert found[0]["clean_text"] == GOOD + "\nThe end."
    assert found[0]["lost_words"] == len(junk.split()) and found[1]["worst_rule"] == "navigation"
    assert "Clean_Text" not in found[0]
    assert judged(spark)[:1] == []


def test_toxicity_learns_jointly_and_knows_misspellings():
    random = np.random.default_rng(3)
    plain = ["".join(random.choice(list("aeioulnrst"), random.integers(3, 8))) for _ in range(400)]
    bad = ["grubwitz", "flumphead", "skraggle"]

    def text(toxic, n):
        words = list(random.choice(plain, n))
        for at in random.integers(0, n, 2 if toxic else 0):
            words[at] = str(random.choice(bad))
        return " ".join(words)

    labels = [int(x) for x in random.integers(0, 2, 400)]
    model = toxicity.train([text(y, int(random.integers(5, 60))) for y in labels], labels)
    held = [int(x) for x in random.integers(0, 2, 200)]
    scores = model.scores([text(y, int(random.integers(5, 200))) for y in held])
    assert np.mean([(p >= 0.5) == y for p, y in zip(scores, held)]) > 0.95
    spelt, clean = model.scores(["aeol ristu grubwittz nolar", "aeol ristu solanat nolar"])
    assert spelt > 2 * clean
    long = " ".join(random.choice(plain, 20_000))
    assert model.scores([long + " flumphead skraggle grubwitz"])[0] > 0.5 > model.scores([long])[0]
    few = toxicity.train([text(y, 30) for y in [0] * 60 + [1] * 20], [0] * 60 + [1] * 20)
    assert 0 <= few.scores(["", " \n"])[0] <= 0.26


def test_toxicity_of_odd_tables(spark):
    docs = documents(spark, [(1, "good words here", "s"), (1, "good words here", "s"), (2, None, "s"), (None, "", None), (3, "good", "s")]).withColumn("Score", F.lit("x"))
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, None), (3, 1, 1), (3, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    found = toxicity.score(docs, model)
    assert found.columns == ["doc_id", "text", "source", "score", "predicted"]
    only = {r["predicted"] for r in found.collect()}
    assert len(only) == 1 and found.count() == 5
    assert toxicity.score(docs.limit(0), model).count() == 0
    nothing = toxicity.fit(docs, labels.limit(0))
    assert [r["predicted"] for r in toxicity.score(docs, nothing).collect()] == [0] * 5


def test_toxicity_held_out_rows(spark):
    ids = spark.range(200).withColumn("held", toxicity.held_out(F.col("id")))
    assert all(r["held"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in ids.collect())


def test_toxicity_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels, s=toxicity.Settings(epochs=8))
    known = labels.where(toxicity.held_out(F.col("doc_id"))).select("doc_id", "toxic")
    found = toxicity.score(docs.join(known, "doc_id"), model).select("toxic", "predicted").collect()
    caught = [r["predicted"] for r in found if r["toxic"]]
    blamed = [r["predicted"] for r in found if not r["toxic"]]
    assert np.mean(caught) > 0.8 and np.mean(blamed) < 0.03


def brute_labels(text, rules):
    import re
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    spaced = "".join(f" {w} " for w in words)
    hits = []
    for i, r in enumerate(rules):
        if not set(r.keyword.split("|")) & set(words):
            continue
        for m in re.finditer(licenses.pattern(r), spaced):
            first = spaced[:m.start()].count(" ") // 2
            hits.append((first, first + m[0].count(" ") // 2 - 1, r.priority, i))
    free = [h for h in hits if not any(o != h and o[2] <= h[2] and o[0] <= h[0] and o[1] >= h[1] and (o[:2] != h[:2] or o[2:] < h[2:]) for o in hits)]
    base = [h for h in hits if rules[h[3]].base]
    return (len(words), len(base), min((h[0] for h in base), default=None), max((h[0] for h in base), default=None),
            ",".join(sorted({rules[h[3]].label for h in base})), ",".join(sorted({rules[h[3]].label for h in free + base})),
            max((rules[h[3]].confidence for h in free), default=0.0), len(free))


LICENCES = [
    None, "", "no licence at all", "Licensed under CC BY-NC 4.0. All rights reserved.", "GNU General Public License, version 3", "CC BY CC BY cc-by, CC\nBY",
    "GNU Lesser General Public License v2.1 or the GNU GPL version 2 or any later version", "SPDX-License-Identifier: Apache-2.0", "Apache License 2.0 and MIT License",
    "général public license", "general public license general public license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "x " * 5000 + "released under the MIT license " * 300]


def test_licences_by_brute_force(spark):
    rules = all_rules()
    df = documents(spark, [(i, t, "s") for i, t in enumerate(LICENCES)] + [(3, LICENCES[3], "s"), (None, LICENCES[4], None)]).withColumn("Labels", F.lit(1)).withColumn("rule", F.lit(2))
    found = licenses.scan(df)
    assert found.columns == ["doc_id", "text", "source", "rule", *licenses.RESULTS]
    for r in found.collect():
        assert tuple(r[c] for c in licenses.RESULTS) == brute_labels(r["text"], rules), r["text"]
    assert licenses.scan(df.limit(0)).count() == 0


def spelt_out(regex):
    """A sentence for each way through the alternatives, options and classes of a rule; repeats as often as they must, and once."""
    from re import _parser as parser

    def ways(parts):
        out = [""]
        for kind, value in parts:
            if kind is parser.LITERAL:
                own = [chr(value)]
            elif kind is parser.IN:
                own = [chr(v) if k is parser.LITERAL else "7" if v is parser.CATEGORY_DIGIT else "word" for k, v in value]
            elif kind is parser.BRANCH:
                own = [w for branch in value[1] for w in ways(branch)]
            elif kind is parser.SUBPATTERN:
                own = ways(value[3])
            else:
                assert kind in (parser.MAX_REPEAT, parser.MIN_REPEAT), kind
                least, most, inner = value
                own = [w * n for n in {least, min(most, max(least, 1))} for w in (ways(inner) if n else [""])]
            out = list(dict.fromkeys(a + b for a in out for b in own))
        return out

    return ways(parser.parse(regex))


def test_licence_keywords_are_in_every_alternative(spark):
    rules = all_rules()
    sentences = {}
    for r in rules:
        for sentence in spelt_out(r.regex):
            assert set(r.keyword.split("|")) & set(sentence.split()), (r.label, r.keyword, sentence)
            sentences.setdefault(sentence, r)
    shortest = {}
    for sentence, r in sentences.items():  # Spark and the version without a prefilter: one for each rule and keyword
        shortest.setdefault((r, *sorted(set(r.keyword.split("|")) & set(sentence.split()))), sentence)
    for i, found in enumerate(licenses.scan(documents(spark, [(i, t, "s") for i, t in enumerate(shortest.values())])).orderBy("doc_id").collect()):
        words = "|".join(found["text"].split())
        assert tuple(found[c] for c in licenses.RESULTS) == brute_labels(found["text"], [r._replace(keyword=words) for r in rules]), (i, found["text"])


@pytest.mark.parametrize(("text", "label"), [
    ("This is under the General Public Licence.", "gpl"), ("Usage of the works is permitted provided that this instrument is retained with the works", "fair"),
    ("GNU Lesser General Public Licence", "lgpl"), ("The accompanying program is provided under the terms of this Common Public Licence", "cpl-1.0"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\"", "0bsd")])
def test_licence_wordings(text, label):
    assert brute_labels(text, all_rules())[5] == label


def test_licence_rules_are_sound():
    rules = all_rules()
    assert len(rules) > 200 and len({licenses.pattern(r) for r in rules}) > 200
    for r in rules:
        assert r.keyword == r.keyword.lower() and 0 < r.confidence <= 1


def test_licence_priority_and_containment(spark):
    rules = [Rule("long", 2, 0.5, "a", "a b c"), Rule("inner", 2, 0.9, "b", "b c"), Rule("better", 1, 0.4, "b", "b"), Rule("crossing", 3, 0.3, "c", "c d")]
    found = licenses.scan(documents(spark, [(1, "a b c d", "s")]), rules=rules).first()
    assert (found["labels"], found["n_detections"], found["score"]) == ("better,crossing,long", 3, 0.5)


def test_licence_scan_is_native(spark):
    plan = licenses.scan(documents(spark, [(1, "a", "s")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def brute_mix(data, weights=(1, 2, 3), cap=3):
    sizes = [len((t or "").encode().split()) for _, t, _ in data]
    sources = sorted({s for *_, s in data}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, d in zip(sizes, data) if d[2] == s) for s in sources}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    capped: set = set()
    while True:
        rest, share = sum(total.values()) - sum(cap * total[s] for s in capped), sum(weight[s] for s in sources if s not in capped)
        target = {s: cap * total[s] if s in capped else weight[s] * rest / share for s in sources}
        above = {s for s in sources if s not in capped and target[s] > cap * total[s]}
        if not above:
            break
        capped |= above
    out = []
    for s in sources:
        own = [(int(hashlib.md5(str(d[0] if d[0] is not None else "").encode()).hexdigest()[:15], 16), n) for d, n in zip(data, sizes) if d[2] == s]
        full = int(target[s] // total[s]) if total[s] else 0
        budget, before, edge = target[s] - full * total[s], 0, 0
        for h in sorted({h for h, n in own if n}):
            here = sum(n for g, n in own if g == h)
            if before + here > budget:
                edge = h + (before + here - budget < budget - before)
                break
            before += here
        out += [(n, total[s], target[s], n * (full + (total[s] > 0 and h < edge))) for h, n in own]
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mixture_by_brute_force(spark, seed):
    random = np.random.default_rng(seed)
    data = [(int(random.integers(0, 60)), "w " * int(random.integers(0, 40)), str(random.choice(["a", "b", "c", "d"], p=[0.7, 0.2, 0.05, 0.05]))) for _ in range(90)]
    data += [(7, None, "a"), (None, "x y", None), (8, "x", None), (9, "w " * 3000, "b"), (10, "", "e")]
    found = mixing.mix(documents(spark, data).withColumn("Size", F.lit("z"))).select("size", "source_size", "target", "taken").collect()
    key = lambda x: tuple(round(float(v), 6) for v in x)
    assert sorted(map(key, found)) == sorted(map(key, brute_mix(data)))


def test_mixture_targets_and_copies(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('w ', CAST(id % 17 AS INT)) AS text", "IF(id % 3 = 0, 'big', concat('s', CAST(id % 4 AS STRING))) AS source")
    mixed = mixing.mix(docs)
    got = mixed.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("size"), F.max(F.col("taken") - 3 * F.col("size")).alias("over"))
    for r in got.collect():
        assert abs(r["taken"] - r["target"]) <= 17 and r["target"] <= 3 * r["size"] and r["over"] <= 0
    assert rows(mixed, "doc_id", "taken") == rows(mixing.mix(docs.repartition(5)), "doc_id", "taken")
    again = mixing.repeat_rows(mixed, docs.columns)
    assert again.columns == docs.columns and again.count() == mixed.agg(F.sum("copies")).first()[0]
    assert mixing.mix(docs.limit(0)).count() == 0
