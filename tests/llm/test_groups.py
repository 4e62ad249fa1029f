"""Near-duplicates, components, shards: against brute force on small tables."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from optelem.llm import caps, cells, components, queries, sharding, simhash
from tests.conftest import rows


def union(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components_by_brute_force(spark):
    random = np.random.default_rng(5)
    for edges in ([(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 80)], [tuple(map(int, random.integers(0, 100, 2))) for _ in range(70)], []):
        n = 101
        want = union(n, edges)
        linked = {x for a, b in edges if a != b for x in (a, b)}
        df = spark.createDataFrame([*edges, (3, 3), (None, 1)], "u long, v long")
        assert dict(rows(components.components(df))) == {x: want[x] for x in linked}


def brute_fingerprint(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(data):
    prints = [brute_fingerprint(t) for _, t in data]
    edges = [(i, j) for i in range(len(data)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 4]
    root = union(len(data), edges)
    least = {}
    for (d, _), r in zip(data, root):
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return [(d, f"{p:016x}", least[r]) for (d, _), p, r in zip(data, prints, root)]


def near_texts(seed, n=40):
    random = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(n):
        base = list(random.choice(words, random.integers(1, 200)))
        texts.append(" ".join(base))
        for _ in range(random.integers(0, 4)):
            other = list(base)
            other[random.integers(0, len(other))] = str(random.choice(words))
            texts.append(" ".join(other))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_simhash_by_brute_force(spark, seed):
    data = list(enumerate(near_texts(seed))) + [(900, None), (901, ""), (902, " \n"), (0, "One Two"), (0, "one two"), (None, "one two"), (None, "é Ü"), (903, "a b " * 20_000)]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    found = simhash.groups(df).select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")
    assert rows(found) == sorted(brute_groups(data), key=repr)
    assert simhash.groups(df.limit(0)).count() == 0


def test_simhash_finds_all_close_fingerprints(spark):
    random = np.random.default_rng(7)
    prints = [int(x) for x in random.integers(-(1 << 63), 1 << 63, 300)]
    for base in prints[:120]:
        flipped = base & ((1 << 64) - 1)
        for bit in random.choice(64, random.integers(1, 6), replace=False):
            flipped ^= 1 << int(bit)
        prints.append(flipped - (1 << 64) if flipped >> 63 else flipped)
    prints = sorted(set(prints))
    edges = [(i, j) for i in range(len(prints)) for j in range(i) if bin((prints[i] ^ prints[j]) & ((1 << 64) - 1)).count("1") <= 4]
    found = components.components(simhash.linked(spark.createDataFrame([(p,) for p in prints], "fp long")))
    want = union(len(prints), edges)
    got = dict(rows(found))
    assert [got.get(p, p) for p in prints] == [prints[r] for r in want]


def test_one_row_per_group(spark):
    data = [(5, "a b c d e"), (2, "a b c d e"), (2, "A B C D E"), (9, "other words entirely here now"), (None, "a b c d e"), (None, "only nameless text"), (None, "only nameless text")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("component_id", F.lit("x"))
    kept = simhash.one_per_group(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or -1, (r["text"] or "").lower()) for r in kept.collect()) == [(-1, "only nameless text"), (2, "a b c d e"), (9, "other words entirely here now")]


def test_tiles_meet_every_pair_once(spark):
    members = [(int(c), int(m)) for c, n in ((1, 50), (2, 3), (3, 1)) for m in range(n)]
    dealt = cells.tiled(spark.createDataFrame(members, "cell long, fp long"), "fp", tile=8).toArrow().to_batches()
    seen, groups = [], {}
    for table, group in cells.chunks(dealt):
        part, low, high, fp, cell = (table[c].to_numpy() for c in ("part", "low", "high", "fp", "cell"))
        for i, j in cells.pairs(group, part, low, high):
            seen += [(c, *sorted((a, b))) for c, a, b in zip(cell[i].tolist(), fp[i].tolist(), fp[j].tolist())]
        for c in zip(cell, low, high):
            groups[c] = groups.get(c, 0) + 1
    assert sorted(seen) == sorted((c, a, b) for c, b in members for d, a in members if c == d and a < b)
    assert max(groups.values()) < 40


def brute_links(vectors, cosine=0.9):
    ok = [v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    edges = []
    for i in range(len(vectors)):
        for j in range(i):
            if ok[i] and ok[j] and len(vectors[i]) == len(vectors[j]):
                a, b = (np.array(vectors[k], dtype=float) for k in (i, j))
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine:
                    edges.append((i, j))
    return edges


def test_one_per_group_of_ids_in_several_groups(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    data = [(1, a), (1, b), (2, a), (3, b), (4, c), (5, c), (5, a), (4, c)]
    kept = simhash.one_per_group(spark.createDataFrame(data, "doc_id long, text string").repartition(3))
    assert rows(kept) == sorted([(1, a), (1, b), (4, c)], key=repr)
    kept = simhash.one_per_group(spark.createDataFrame([(2, a), (2, b), (1, b)], "doc_id long, text string"))
    assert rows(kept) == sorted([(2, a), (1, b)], key=repr)


def test_caps_by_brute_force(spark):
    random = np.random.default_rng(11)
    base = random.standard_normal((120, 16))
    near = base[random.integers(0, 120, 200)] + random.standard_normal((200, 16)) * 0.15
    vectors = [v.astype(np.float32).tolist() for v in np.concatenate([base, near])]
    vectors += [vectors[0]] * 5 + [None, [0.0] * 16, [float("nan")] * 16, [1.0, None] + [0.0] * 14, [float("inf")] + [0.0] * 15, [1e30] * 16, [1.0] * 16, [1.0, 0.0], [2.0, 0.0], []]
    edges = brute_links(vectors)
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").withColumn("kept", F.lit("x"))
    found = caps.groups(df).collect()
    degree = np.bincount([x for e in edges for x in e], minlength=len(vectors))
    want = union(len(vectors), edges)
    got = {r["vec_id"]: r for r in found}
    assert len(found) == len(vectors)
    assert all(r["n_links"] <= degree[r["vec_id"]] for r in found)
    assert sum(r["n_links"] for r in found) >= 0.97 * degree.sum()
    assert np.mean([got[i]["component_id"] == want[i] for i in range(len(vectors))]) > 0.97
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found)
    for i in range(325, 332):
        assert got[i]["n_links"] == degree[i]
    assert caps.groups(df.limit(0)).count() == 0


def test_caps_recall_on_the_table(spark):
    random = np.random.default_rng(8)
    vectors = np.array([r["embedding"] for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()])
    near = vectors[random.integers(0, len(vectors), 2000)]
    noise = random.standard_normal(near.shape)
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    near = near / np.linalg.norm(near, axis=1, keepdims=True) + noise * random.uniform(0.1, 0.5, (len(near), 1))
    data = dict(enumerate(np.concatenate([vectors, near]).astype(np.float32).astype(float)))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in data.items()], "vec_id long, embedding array<float>")
    ids = sorted(data)
    unit = np.stack([data[i] / np.linalg.norm(data[i]) for i in ids])
    degree = dict(zip(ids, ((unit @ unit.T >= 0.9).sum(1) - 1).tolist()))
    found = {r["vec_id"]: r["n_links"] for r in caps.groups(table).collect()}
    assert sum(degree.values()) > 0 and all(found[i] <= degree[i] for i in ids)
    assert sum(found.values()) >= 0.98 * sum(degree.values())


def test_caps_of_nameless_and_repeated_rows(spark):
    data = [(1, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 3.0]), (None, [1.0, 2.0, 3.0]), (None, [9.0, -1.0, 0.0]), (4, [3.0, 2.0, 1.0])]
    found = rows(caps.groups(spark.createDataFrame(data, "vec_id long, embedding array<double>")))
    assert found == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (None, 0, None, True), (4, 0, 4, True)], key=repr)


@pytest.mark.parametrize("vectors", [51_282, 262_500, 1_000_000, 10_000_000])
def test_caps_recall_does_not_fall_with_the_table(vectors):
    x, y = caps.planted(64, 0.9, 600, 77)
    settings = caps.Caps()
    missed = np.ones(len(x), dtype=bool)
    for code in range(caps.codes_for(64, vectors, 0.9, settings)):
        missed &= ~caps.meets(caps.Filters(64, vectors, settings, code), x, y)
    assert missed.mean() <= 0.01


def test_cap_height_is_the_quantile():
    random = np.random.default_rng(2).standard_normal((200_000, 12))
    first = random[:, 0] / np.linalg.norm(random, axis=1)
    for share in (0.3, 0.01):
        assert abs(np.mean(first >= caps.cap_height(12, share)) - share) < share * 0.1


@pytest.mark.parametrize("dimensions", [1, 2, 3, 4, 5, 8])
def test_few_dimensions_take_few_caps(dimensions):
    """Caps per vector stay alike from two thousand vectors to two hundred thousand, and pairs at the threshold are found."""
    x, _ = caps.planted(dimensions, 0.9, 2_000, 5)
    for vectors in (2_000, 20_000, 200_000):
        filters = caps.Filters(dimensions, vectors, caps.Caps())
        assert len(filters.decode(x)[0]) < 40 * len(x)
    codes = caps.codes_for(dimensions, 20_000, 0.9, caps.Caps())
    a, b = caps.planted(dimensions, 0.9, 1_000, 77)
    found = np.zeros(len(a), dtype=bool)
    for code in range(codes):
        found |= caps.meets(caps.Filters(dimensions, 20_000, caps.Caps(), code), a, b)
    assert found.mean() >= 0.99 and codes <= 64


@pytest.mark.parametrize("dimensions", [1, 2, 3])
def test_links_in_few_dimensions(spark, dimensions):
    random = np.random.default_rng(dimensions)
    vectors = random.standard_normal((240, dimensions))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    got = {r["vec_id"]: r["n_links"] for r in caps.groups(df).collect()}
    assert sum(got.values()) >= 0.99 * want.sum() and all(got[i] <= want[i] for i in got)


def shards_of(spark, data):
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("shard", F.lit("clash")).withColumn("node", F.lit(1))
    return sharding.shard_rows(df).collect()


def check_shards(found, data, slack):
    import zlib
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"], r["text_crc32"]) for r in found) == sorted(
        (d if d is not None else -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in data)
    loads = [0] * 16
    for s in range(16):
        own = [r for r in found if r["shard"] == s]
        loads[s] = sum(r["size"] for r in own)
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    assert max(loads) - min(loads) <= slack, loads
    assert {r["law"] for r in found} <= {"bytes"} and {r["grown_shard"] for r in found} <= {None}


def test_shards_are_even_and_keep_copies_together(spark):
    random = np.random.default_rng(3)
    data = [(i, "x" * int(random.integers(0, 400)) + str(i)) for i in range(3000)]
    for g in range(150):
        data += [(10_000 + g * 10 + k, f"copy {g} " + "y" * 150) for k in range(int(random.integers(2, 8)))]
    found = shards_of(spark, data)
    check_shards(found, data, 1200)
    where = {}
    for r in found:
        if r["doc_id"] >= 10_000:
            where.setdefault((r["doc_id"] - 10_000) // 10, set()).add(r["shard"])
    assert np.mean([len(s) == 1 for s in where.values()]) > 0.95


def test_shards_with_a_hot_group_and_odd_rows(spark):
    data = [(i, "the same text in a third of all rows") for i in range(1500)] + [(5000 + i, f"own text number {i} " * 3) for i in range(2000)]
    data += [(1, "the same text in a third of all rows"), (None, None), (None, None), (7000, ""), (7001, "z" * 3000)]
    found = shards_of(spark, data)
    check_shards(found, data, 3200)
    hot = [r["shard"] for r in found if r["size"] == 37]
    assert len(set(hot)) <= 10
    assert shards_of(spark, data[:3]) and shards_of(spark, []) == []


def test_shards_do_not_follow_the_layout(spark):
    """The same rows from one partition, from eleven and in another order lie in the same shards and slots, repeats included."""
    data = [(i, f"text {i % 160} " * (1 + i % 9)) for i in range(400)] + [(3, "text 3 " * 4)] * 5 + [(None, None)] * 3 + [(900, "w" * 20_000)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    shards = [rows(sharding.shard_rows(d, shards=4)) for d in (df.coalesce(1), df.repartition(11), df.orderBy(F.desc("text"), "doc_id").coalesce(2))]
    assert shards[0] == shards[1] == shards[2] and len(shards[0]) == len(data)


def test_sharding_is_native(spark, monkeypatch):
    from optelem.plans import lookups
    plans = []
    real = lookups.settle
    monkeypatch.setattr(sharding, "settle", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    df = sharding.shard_rows(spark.createDataFrame([(i, f"t{i % 50}") for i in range(200)], "doc_id long, text string"))
    plans.append(df._jdf.queryExecution().executedPlan().toString())
    assert not [p for p in plans if re.search("Python|Arrow|Pandas", p)]


def test_registered_groups_on_the_small_tables(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(queries.op10_simhash_dedup(spark, sf)) == sorted(brute_groups(docs), key=repr)
    check_shards(queries.op8_sharding(spark, sf).collect(), docs, 2 * max(len((t or "").encode()) for _, t in docs))


def test_one_per_group_joins_its_groups_once(spark):
    """Its branches read the settled groups; a plan that makes them anew in each keeps hundreds of stages in the driver."""
    plan = simhash.one_per_group(spark.createDataFrame([(1, "a b c"), (2, "a b c")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 16
