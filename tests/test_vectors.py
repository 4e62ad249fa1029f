import numpy as np
import pytest

from optelem.operators import vectors
from tests.conftest import rows

SCHEMA = "vec_id long, embedding array<float>"
ODD = [None, [0.0] * 5, [1.0, 2.0], [float("nan")] * 5, [float("inf"), 1.0, 1.0, 1.0, 1.0], [], [2.0, 4.0], [None, 1.0, 1.0, 1.0, 1.0], [1e38] * 5]


def tables(spark, data):
    catalog = spark.createDataFrame(list(enumerate(data)), SCHEMA).repartition(5)
    return catalog, catalog.where("vec_id % 10 = 0").selectExpr("vec_id AS query_id", "embedding")


def brute(data, asked, k):
    unit = {i: np.array(v, dtype=float) / np.linalg.norm(np.array(v, dtype=float)) for i, v in enumerate(data)
            if v and None not in v and np.isfinite(v).all() and any(v)}
    out = []
    for q in asked:
        if q in unit:
            scores = sorted((-round(float(unit[i] @ unit[q]), 6), i) for i in unit if len(unit[i]) == len(unit[q]))
            out += [(q, n + 1, i) for n, (_, i) in enumerate(scores[:k])]
    return sorted(out, key=repr)


def clustered(n, size=8, seed=2):
    random = np.random.default_rng(seed)
    centres = random.standard_normal((25, size))
    return (centres[random.integers(0, 25, n)] + 0.3 * random.standard_normal((n, size))).astype(np.float32).tolist()


@pytest.mark.parametrize("data", ["random", "clustered", "copies", "short"])
def test_nearest_to_a_table_is_exact(spark, monkeypatch, data):
    monkeypatch.setattr(vectors, "TILE", 16)
    monkeypatch.setattr(vectors, "QUERY_TILE", 4)
    made = {"random": np.random.default_rng(4).standard_normal((300, 5)).astype(np.float32).tolist() + ODD, "clustered": clustered(300),
            "copies": [[1.0, 2.0, 3.0]] * 200 + [[3.0, 1.0, 2.0]] * 3, "short": [[float(x)] for x in (1, -2, 3)] * 4}[data]
    catalog, asked = tables(spark, made)
    got = rows(vectors.nearest_to_table(catalog, asked, 3), "query_id", "rank", "vec_id")
    assert got == brute(made, range(0, len(made), 10), 3)
    assert rows(vectors.nearest_to_table(catalog, asked.limit(0), 3)) == [] == rows(vectors.nearest_to_table(catalog.limit(0), asked, 3))


def test_index_holds_every_row_and_finds_its_recall(spark):
    data = clustered(2000)
    catalog, asked = tables(spark, data + ODD)
    index = vectors.build_index(catalog, sample=500, checked=200)
    assert rows(index.rows, "id") == sorted(((i,) for i in [*range(2000), 2002, 2006, 2008]), key=repr)
    probes = index.probes(0.95)
    assert 1 <= probes < len(index.centroids) / 2 and index.probes(1.1) == len(index.centroids) and (np.diff(index.found_within) >= 0).all()
    found = vectors.nearest_by_index(index, asked, 10, probes)
    true = vectors.nearest_to_table(catalog, asked, 10)
    recall = [r.recall for r in vectors.recall_at(found, true, 10).collect()]
    assert len(recall) == 200 and np.mean(recall) >= 0.9
    everything = vectors.nearest_by_index(index, asked, 10, len(index.centroids))
    assert rows(everything, "query_id", "rank", "vec_id", "score") == rows(true, "query_id", "rank", "vec_id", "score")


def test_a_popular_cell_is_dealt_to_tiles(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 50)
    catalog, asked = tables(spark, [[1.0, 0.0]] * 900 + [[0.0, 1.0]] * 100)

    found = vectors.nearest_by_index(vectors.build_index(catalog), asked, 2, 1)
    assert rows(found.where("query_id < 900"), "vec_id") == sorted([(0,), (1,)] * 90, key=repr)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [cell" in plan and "tile" in plan and "Cartesian" not in plan
