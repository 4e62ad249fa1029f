"""Nearest vectors through an inverted file: k-means cells fitted on a bounded sample, every row assigned to one, probed by an equi-join.

The catalog and the queries stay tables throughout. The driver holds the centroids, whose number is bounded, and the
sample that they are fitted on. A cell with more rows than a tile is dealt to tiles by hash, so neither a popular cell
nor a popular query cell makes a large task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from optelem.plans.lookups import settle

MAX_CELLS = 4_096  # with 1,024 components of 8 bytes 32 MB
SAMPLE, SAMPLE_BYTES = 100_000, 64 << 20  # rows that the cells are fitted on
CHECKED = 500  # sampled rows whose true neighbours tell how many cells a query has to probe
TILE, QUERY_TILE = 8_192, 1_024
ROUNDING = 2e-6  # scores are rounded to six places before they are ranked


@dataclass(frozen=True)
class VectorIndex:
    """`rows` (cell, id, vec): every usable vector of the catalog, of unit length, in its cell; a checkpoint.

    Cells 0 and up belong to the commonest vector length, `centroids` are theirs and `reach` is the largest angle between
    a centroid and a row of its cell. Vectors of any other length n are in cell -n. `probes` maps a number of cells to
    the share of true neighbours that the sampled rows find in their nearest so many cells.
    """

    rows: DataFrame
    centroids: np.ndarray
    reach: np.ndarray
    found_within: np.ndarray

    def probes(self, recall: float) -> int:
        """The least number of cells with which the sampled rows find the share `recall` of their true neighbours."""
        enough = np.flatnonzero(self.found_within >= recall)
        return int(enough[0]) + 1 if len(enough) else len(self.centroids)


def unit_vectors(df: DataFrame, row_id: str, vector: str) -> DataFrame:
    """id, vec (array<double>) of the rows whose vector is usable: not NULL, empty or zero, all components finite."""
    read = df.select(F.col(f"`{row_id}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    largest = F.array_max(F.transform("vec", F.abs))
    scaled = read.where("vec IS NOT NULL").where(finite).where(largest > 0).select("id", F.transform("vec", lambda x: x / largest).alias("vec"))  # squares stay in range
    norm = F.sqrt(F.aggregate("vec", F.lit(0e0), lambda s, x: s + x * x))
    return scaled.select("id", F.transform("vec", lambda x: x / norm).alias("vec"))


def fit_cells(sample: np.ndarray, cells: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means of unit vectors: `cells` unit centroids, or as many as there are different vectors."""
    random = np.random.default_rng(7)
    different = np.unique(sample, axis=0)
    centroids = different[random.permutation(len(different))[:cells]]
    for _ in range(rounds):
        own = np.concatenate([np.argmax(sample[i:i + 4096] @ centroids.T, axis=1) for i in range(0, len(sample), 4096)])
        order = np.argsort(own, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(own[order]) > 0))
        sums = np.add.reduceat(sample[order], first, axis=0)
        norms = np.linalg.norm(sums, axis=1)
        moved = own[order][first][norms > 1e-12]
        centroids[moved] = sums[norms > 1e-12] / norms[norms > 1e-12, None]
    return centroids


def _matrices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix for each vector length in a batch."""
    vectors = batch.column(column)
    offsets = vectors.offsets.to_numpy()
    values = vectors.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        yield rows, values[offsets[rows][:, None] + np.arange(n)]


def _placed(centroids: np.ndarray, pick: Callable[[np.ndarray, np.ndarray], list[np.ndarray]], extra: str | None = None) -> Callable:
    """(cell, id, vec, cos): each vector in the cells that `pick` takes from its cosines with all centroids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                for rows, matrix in _matrices(part, "vec") if part.num_rows else ():
                    if matrix.shape[1] == centroids.shape[1]:
                        cosines = matrix @ centroids.T
                        cells = pick(cosines, part.column(extra).to_numpy()[rows] if extra else rows)
                        times = np.array([len(c) for c in cells])
                        at = np.repeat(np.arange(len(rows)), times)
                        cell = np.concatenate(cells).astype(np.int32) if len(at) else np.zeros(0, np.int32)
                        cos = cosines[at, cell]
                    else:
                        at, cell, cos = np.arange(len(rows)), np.full(len(rows), -matrix.shape[1], dtype=np.int32), np.ones(len(rows))
                    taken = part.take(pa.array(rows[at]))
                    yield pa.RecordBatch.from_arrays([pa.array(cell), taken.column("id"), taken.column("vec"), pa.array(cos)], names=["cell", "id", "vec", "cos"])

    return run


PLACED = "cell int, id long, vec array<double>, cos double"


def _nearest_cells(n: int) -> Callable[[np.ndarray, np.ndarray], list[np.ndarray]]:
    def pick(cosines: np.ndarray, _: np.ndarray) -> list[np.ndarray]:
        if n == 1:
            return list(np.argmax(cosines, axis=1)[:, None])
        return list(np.argpartition(-cosines, min(n, cosines.shape[1]) - 1, axis=1)[:, :n])

    return pick


def build_index(catalog: DataFrame, row_id: str = "vec_id", vector: str = "embedding", cells: int | None = None, sample: int = SAMPLE, checked: int = CHECKED, k: int = 10) -> VectorIndex:
    """Index every usable row of `catalog`.

    The cells, by default the square root of the number of rows but at most MAX_CELLS, are fitted on about `sample` rows
    (SAMPLE_BYTES at most) with the smallest hashes, which bounds what the driver holds. `checked` rows are compared with
    all rows to measure how many cells hold a given share of the `k` nearest. An empty catalog gives an index without cells.
    """
    vectors = settle(unit_vectors(catalog, row_id, vector).withColumn("_size", F.size("vec")))
    lengths = vectors.groupBy("_size").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "_size").limit(1).collect()
    if not lengths:
        return VectorIndex(settle(vectors.select(F.lit(0).alias("cell"), "id", "vec")), np.zeros((0, 0)), np.zeros(0), np.zeros(0))
    size, n = lengths[0]
    own = vectors.where(F.col("_size") == size).select("id", "vec")

    def some(wanted: int) -> np.ndarray:
        share = int((1 << 31) * min(1.0, 1.1 * wanted / n + 20 / n))
        taken = own.where(F.pmod(F.xxhash64("id", "vec"), F.lit(1 << 31)) <= share).limit(wanted).toArrow().combine_chunks()
        return next(_matrices(taken.to_batches()[0], "vec"))[1] if len(taken) else np.zeros((0, size))

    matrix = some(max(1, min(sample, SAMPLE_BYTES // (8 * size))))
    if not len(matrix):  # by chance, of a small table
        matrix = next(_matrices(own.limit(100).toArrow().combine_chunks().to_batches()[0], "vec"))[1]
    centroids = fit_cells(matrix, min(cells or int(n ** 0.5) + 1, MAX_CELLS, max(1, len(matrix) // 4)))
    rows = settle(vectors.select("id", "vec").mapInArrow(_placed(centroids, _nearest_cells(1)), PLACED))
    least = {r["cell"]: r["cos"] for r in rows.where("cell >= 0").groupBy("cell").agg(F.min("cos").alias("cos")).collect()}  # a number per cell
    reach = np.array([np.arccos(np.clip(least.get(c, 1.0) - 1e-9, -1, 1)) for c in range(len(centroids))])
    index = VectorIndex(rows.select("cell", "id", "vec"), centroids, reach, np.ones(len(centroids)))
    if checked:
        asked = some(checked)
        found = rows.where("cell >= 0").select("id", "cell", "vec").mapInArrow(_best_of_all(asked, k), "query_no int, cell int, score double")
        w = Window.partitionBy("query_no").orderBy(F.desc("score"), "cell")
        true = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_no", "cell").toPandas()  # checked * k rows at most
        cosines = asked[true["query_no"].to_numpy(dtype=int)] @ centroids.T
        needed = (cosines > cosines[np.arange(len(true)), true["cell"].to_numpy(dtype=int)][:, None]).sum(1)  # cells probed before
        index.found_within[:] = np.cumsum(np.bincount(needed, minlength=len(centroids))) / max(1, len(true))
    return index


def _best_of_all(queries: np.ndarray, k: int) -> Callable:
    """(query_no, cell, score): the best k rows of a task for each of a few queries."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, cells = np.zeros((len(queries), 0)), np.zeros((len(queries), 0), dtype=np.int32)
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                new = queries @ next(_matrices(part, "vec"))[1].T
                score = np.concatenate([score, new], axis=1)
                cells = np.concatenate([cells, np.broadcast_to(part.column("cell").to_numpy(), new.shape)], axis=1)
                order = np.argsort(-score, axis=1, kind="stable")[:, :k]
                score, cells = np.take_along_axis(score, order, axis=1), np.take_along_axis(cells, order, axis=1)
        at = np.repeat(np.arange(len(queries), dtype=np.int32), score.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(cells.ravel()), pa.array(score.ravel())], names=["query_no", "cell", "score"])

    return run


def _top_in_tiles(k: int) -> Callable:
    """(query_id, vec_id, score): the best k of each tile for each query in it, from rows sorted by tile, queries first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = asked = queries = score = names = None

        def best() -> pa.RecordBatch:
            there = np.isfinite(score)
            return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(asked[:, None], score.shape)[there]), pa.array(names[there]), pa.array(score[there])], names=["query_id", "vec_id", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("cell", "tile", "query_tile", "kind")], axis=1)
            ids = batch.column("id").to_numpy()
            cuts = np.append(np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1))), len(keys))
            for low, high in zip(cuts[:-1], cuts[1:]):
                matrix = next(_matrices(batch.slice(low, high - low), "vec"))[1]
                if key != tuple(keys[low, :3]):
                    if asked is not None:
                        yield best()
                    key, asked = tuple(keys[low, :3]), None
                if keys[low, 3] == 0:
                    asked = ids[low:high] if asked is None else np.concatenate([asked, ids[low:high]])
                    queries = matrix if len(asked) == high - low else np.concatenate([queries, matrix])
                    score, names = np.zeros((len(asked), 0)), np.zeros((len(asked), 0), dtype=np.int64)
                elif asked is not None:
                    for i in range(0, len(matrix), 1024):
                        new = np.round(queries @ matrix[i:i + 1024].T, 6)
                        score = np.concatenate([score, new], axis=1)
                        names = np.concatenate([names, np.broadcast_to(ids[low + i:low + i + new.shape[1]], new.shape)], axis=1)
                        order = np.lexsort((names, -score), axis=1)[:, :k]
                        score, names = np.take_along_axis(score, order, axis=1), np.take_along_axis(names, order, axis=1)
        if asked is not None:
            yield best()

    return run


def _best(index: VectorIndex, placed: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score, rank: the best k rows for each query in the cells that it is placed in."""
    def parts(df: DataFrame, tile: int, name: str) -> DataFrame:  # a row per cell, at most MAX_CELLS and the other lengths
        return df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias(name))

    placed = settle(placed.select("cell", "id", "vec"))
    tiles = settle(parts(index.rows, TILE, "_tiles").join(parts(placed, QUERY_TILE, "_query_tiles"), "cell"))

    def dealt(df: DataFrame, kind: int, own: str, own_tiles: str, other: str, other_tiles: str) -> DataFrame:
        return (df.join(F.broadcast(tiles), "cell").withColumn(own, F.pmod(F.xxhash64("id"), F.col(own_tiles)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_tiles) - 1))).select("cell", "tile", "query_tile", F.lit(kind).alias("kind"), "id", "vec"))

    both = dealt(placed, 0, "query_tile", "_query_tiles", "tile", "_tiles").unionByName(dealt(index.rows, 1, "tile", "_tiles", "query_tile", "_query_tiles"))
    ordered = both.repartition("cell", "tile", "query_tile").sortWithinPartitions("cell", "tile", "query_tile", "kind")
    found = ordered.mapInArrow(_top_in_tiles(k), "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest_by_index(index: VectorIndex, queries: DataFrame, k: int, probes: int, row_id: str = "query_id", vector: str = "embedding") -> DataFrame:
    """query_id, vec_id, score, rank: cosine top-k of a table of queries among the rows of the `probes` nearest cells of each.

    Ties go to the smaller vec_id. Vectors of another length than all rows match nothing, nor do NULL, zero or infinite ones.
    """
    return _best(index, unit_vectors(queries, row_id, vector).mapInArrow(_placed(index.centroids, _nearest_cells(probes)), PLACED), k)


def nearest_to_table(catalog: DataFrame, queries: DataFrame, k: int, cells: int | None = None) -> DataFrame:
    """query_id, vec_id, score, rank: cosine top-k of a table of queries (query_id, embedding) in the whole catalog, exact.

    A first search in a few cells finds for each query a score that its k-th neighbour reaches. A cell can be left out
    if its angle to the query, less its reach, is wider than that; all others are searched. Vectors that are NULL, zero
    or of another length match nothing; ties go to the smaller vec_id.
    """
    index = build_index(catalog, cells=cells, checked=0)
    vectors = settle(unit_vectors(queries, "query_id", "embedding"))
    if not len(index.centroids):
        return _best(index, vectors.select(F.lit(0).alias("cell"), "id", "vec"), k)
    first = _best(index, vectors.mapInArrow(_placed(index.centroids, _nearest_cells(4)), PLACED), k)
    reached = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least")).groupBy("id").agg(F.min("least").alias("least"))
    bounded = vectors.join(reached, "id", "left").withColumn("least", F.coalesce("least", F.lit(-2e0)))
    reach = index.reach

    def possible(cosines: np.ndarray, least: np.ndarray) -> list[np.ndarray]:
        nearest = np.cos(np.maximum(np.arccos(np.clip(cosines, -1, 1)) - reach, 0))
        return [np.flatnonzero(row >= bound - ROUNDING) for row, bound in zip(nearest, least)]

    return _best(index, bounded.mapInArrow(_placed(index.centroids, possible, "least"), PLACED), k)


def recall_at(found: DataFrame, true: DataFrame, k: int) -> DataFrame:
    """query_id, recall: the share of each query's true neighbours among those found. Scores as good as the k-th true one count."""
    bar = true.groupBy("query_id").agg(F.min("score").alias("_bar"), F.count(F.lit(1)).alias("_n"))
    hits = found.where(F.col("rank") <= k).join(bar, "query_id").where(F.col("score") >= F.col("_bar")).groupBy("query_id").agg(F.count(F.lit(1)).alias("_hits"))
    return bar.join(hits, "query_id", "left").select("query_id", (F.coalesce("_hits", F.lit(0)) / F.col("_n")).alias("recall"))
