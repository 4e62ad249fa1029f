"""The filter interaction audit against a plain count over all orders."""

from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from optelem.llm import audit
from tests.conftest import rows

DOCS, LABELS = "doc_id long, text string, lang string", "doc_id long, quality int, toxic int"
NUMBERS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def fails(row, data):
    text = row[1] or ""
    words = [w for w in "".join(" " if c in " \t\n\x0b\f\r" else c for c in text).split(" ") if w]
    found = set()
    if len(words) < 200:
        found.add("A")
    if 100 * len(set(words)) < 50 * len(words):
        found.add("B")
    if 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text):
        found.add("C")
    if any(c in "#$%&*|" for c in text):
        found.add("D")
    if row[0] is not None and any(o[0] is not None and o[0] < row[0] and (o[1] or "") == text for o in data):
        found.add("E")
    return found


def brute(data, labels):
    good, toxic = ({i for i, *l in labels if i is not None and l[k] == 1} for k in (0, 1))
    out = {}
    for part in {row[2] or "" for row in data}:
        docs = [(row[0], fails(row, data)) for row in data if (row[2] or "") == part]
        removed = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                out[part, "".join(order), step] = [len(left), len(gone), sum(f in d[1] for d in docs) - len(gone), sum(d[1] == {f} for d in docs),
                                                   sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone)]
                removed[f] += len(gone)
        for (p, order, step), numbers in out.items():
            if p == part:
                numbers.append(removed[order[step - 1]])
    return out


def found(spark, data, labels, extra=()):
    docs = spark.createDataFrame(data, DOCS)
    for name in extra:
        docs = docs.withColumn(name, F.lit("x"))
    result = audit.audit(docs, spark.createDataFrame(labels, LABELS))
    return {(r.part, r.filter_order, r.step): [r[c] for c in NUMBERS] for r in result.collect()}


def test_audit_equals_brute_force(spark):
    random = np.random.default_rng(5)
    long = [" ".join(f"w{x}" for x in random.integers(0, size, n)) for size, n in ((1000, 250), (20, 250), (5000, 3000), (90, 200), (100, 199))]
    texts = [None, "", " \t\n", "a # b", "ABC", "ÀÉ Ab", "x\x00y | z", "a\x1fb a\xa0b", *long, long[0] + " %", long[1] + " " + "Q" * 200]
    data = [(int(random.integers(0, 60)) if random.random() < 0.95 else None, texts[random.integers(len(texts))], [None, "", "en", "de", "x'y"][random.integers(5)]) for _ in range(150)]
    data += [(7, long[0], "en"), (7, long[0], "de"), (7, "other", "en")] + [(1000 + i, long[2], "hot") for i in range(80)]
    labels = [(int(i), [None, 0, 1][random.integers(3)], [None, 0, 1][random.integers(3)]) for i in random.integers(0, 1100, 400)] + [(None, 1, 1)]
    expected = brute(data, labels)
    assert len(expected) == 600 * 5  # NULL and the empty string are one part
    assert found(spark, data, labels) == expected
    assert found(spark, data, labels, extra=("part", "_id", "mask", "n", "PREFIX")) == expected


def test_audit_of_an_empty_table(spark):
    assert found(spark, [], []) == {}
    one = found(spark, [(1, "a", "en")], [])
    assert len(one) == 600 and one["en", "ABCDE", 1][:2] == [0, 1] and one["en", "BACDE", 2] == [0, 1, 0, 1, 0, 0, 120]


def test_recursion_has_every_prefix_once(spark):
    steps = audit.prefix_steps(spark, "ABCDE")
    assert steps.count() == 325 * 32 and steps.select("prefix").distinct().count() == 325
    assert rows(audit.prefix_steps(spark, "XY").where("mask = 3"), "prefix", "alive", "fails", "only") == [
        ("X", True, True, False), ("XY", False, True, False), ("Y", True, True, False), ("YX", False, True, False)]
    with pytest.raises(ValueError):
        audit.prefix_steps(spark, "AA")


def test_plan_has_no_cross_join_and_shuffles_no_text(spark):
    docs = spark.createDataFrame([(1, "a", "en")], DOCS)
    plan = audit.mask_cells(docs, spark.createDataFrame([(1, 1, 0)], LABELS))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
