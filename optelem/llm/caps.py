"""Near-duplicate vectors by spherical-cap filters.

Filters are directions on the sphere, built as products: after a random rotation a vector is cut into blocks, each
block has a small random code, and every combination of one code word per block is a filter. A vector belongs to all
filters whose cap of angle it lies in; they are list-decoded block by block, dropping combinations that cannot reach
the cap any more, so the work follows the output and not the number of filters. Vectors that share a filter are
compared exactly in double precision. The number of filters grows with the number of vectors, which keeps the
expected number of vectors per cap constant at any size. The caps narrow with it, so one code finds fewer of the pairs;
the number of codes grows until the expected recall of pairs at the threshold is the wanted one.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from optelem.llm.cells import chunks, pairs, tiled
from optelem.llm.components import components
from optelem.plans.lookups import settle


@dataclass(frozen=True)
class Caps:
    """Settings of the filters: in each code a vector of a uniform set lies in about `per_vector` caps, and a cap holds about `per_cap` vectors.

    Filters of one product code share their code words, so a pair that one code misses is likely to be found by
    another; several small codes find more than a large one. There are `codes` of them or as many more as `recall`
    takes (see `codes_for`). Two blocks spread the caps over the vectors more evenly than three, so they serve up to
    a thousand million filters.
    """

    codes: int = 8
    recall: float = 0.998
    per_vector: float = 8.0
    per_cap: float = 8.0
    code_words: int = 32768  # per block at most; more filters take more blocks
    seed: int = 20


def cap_height(dimensions: int, share: float) -> float:
    """The inner product that a random unit vector reaches with the given probability."""
    u = np.linspace(-1.0, 1.0, 200_001)[1:-1]
    density = (1 - u * u) ** ((dimensions - 3) / 2)
    above = np.cumsum(density[::-1])[::-1]
    return float(u[np.searchsorted(-above, -share * above[0])])


class Filters:
    """One of the product codes for vectors of one dimension."""

    def __init__(self, dimensions: int, vectors: int, caps: Caps, code: int = 0):
        wanted = max(64.0, vectors * caps.per_vector / caps.per_cap)
        blocks = max(2, math.ceil(math.log(wanted) / math.log(caps.code_words)))
        space = max(dimensions, _LIFTED)  # the rotation turns fewer dimensions into a subspace of this one
        self.blocks = min(blocks, space)
        self.words = math.ceil(wanted ** (1 / self.blocks))
        total = float(self.words) ** self.blocks
        self.height = cap_height(space, min(0.5, caps.per_vector / total))
        random = np.random.default_rng([caps.seed, dimensions, self.blocks, code])
        self.rotation = np.linalg.qr(random.standard_normal((space, space)))[0][:dimensions]
        edges = np.linspace(0, space, self.blocks + 1).astype(int)
        self.spans = list(zip(edges[:-1], edges[1:]))
        self.codes = []
        for a, b in self.spans:
            words = random.standard_normal((self.words, b - a))
            self.codes.append((words / np.linalg.norm(words, axis=1, keepdims=True) / math.sqrt(self.blocks)).astype(np.float32))

    def size(self) -> int:
        return self.rotation.nbytes + sum(c.nbytes for c in self.codes)

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and filter numbers of all caps that the unit vectors (rows) lie in."""
        turned = (unit @ self.rotation).astype(np.float32)
        step = max(1, _SCORES // self.words)
        parts = [self._decoded(turned[start:start + step], start) for start in range(0, len(unit), step)]
        return np.concatenate([np.zeros(0, int), *(p[0] for p in parts)]), np.concatenate([np.zeros(0, np.int64), *(p[1] for p in parts)])

    def _decoded(self, turned: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
        scores = [turned[:, a:b] @ code.T for (a, b), code in zip(self.spans, self.codes)]
        best = np.stack([s.max(axis=1) for s in scores], axis=1).astype(np.float64)
        rest = np.concatenate([np.cumsum(best[:, ::-1], axis=1)[:, ::-1][:, 1:], np.zeros((len(turned), 1))], axis=1)
        least = self.height - (best.sum(axis=1, keepdims=True) - best)
        row = np.arange(len(turned))
        sums, number = np.zeros(len(row)), np.zeros(len(row), dtype=np.int64)
        for b, score in enumerate(scores):
            of, word = np.nonzero(score >= least[:, b, None])
            own = score[of, word].astype(np.float64)
            falling = np.lexsort((-own, of))
            word, own = word[falling], own[falling]
            first = np.searchsorted(of, np.arange(len(turned)))
            # Scores lie within -1 and 1, so rows stay apart in one ascending key.
            counts = np.maximum(0, np.searchsorted(of * 4.0 - own, row * 4.0 - (self.height - rest[row, b] - sums), side="right") - first[row])
            parent = np.repeat(np.arange(len(row)), counts)
            child = np.arange(len(parent)) - np.repeat(np.cumsum(counts) - counts, counts) + first[row[parent]]
            sums = sums[parent] + own[child]
            number = number[parent] * self.words + word[child]
            row = row[parent]
        return row + start, number


_LIFTED = 16  # dimensions; products of smaller blocks would leave many directions without a filter
_SCORES = 1 << 21  # of one block that are held at a time
_PLANTED = 1000


def planted(dimensions: int, cosine: float, pairs: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Random pairs of unit vectors at exactly this cosine; on a line, where only 1 and -1 occur, pairs of equal ones."""
    random = np.random.default_rng([seed, dimensions])
    x, z = random.standard_normal((2, pairs, dimensions))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if dimensions == 1:
        return x, x.copy()
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    return x, cosine * x + math.sqrt(max(0.0, 1 - cosine * cosine)) * z


def meets(filters: Filters, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which rows of x and y share a cap."""
    (a, m), (b, n) = filters.decode(x), filters.decode(y)
    total = filters.words ** filters.blocks
    if total * len(x) >= 1 << 63:
        shared = [r for r, _ in set(zip(a.tolist(), m.tolist())) & set(zip(b.tolist(), n.tolist()))]
    else:
        shared = np.intersect1d(a * total + m, b * total + n) // total
    out = np.zeros(len(x), dtype=bool)
    out[np.asarray(shared, dtype=int)] = True
    return out


@lru_cache(maxsize=64)
def codes_for(dimensions: int, vectors: int, cosine: float, caps: Caps) -> int:
    """Codes that find the wanted share of the pairs at this cosine.

    A code is turned at random, so it finds any pair at one cosine with the same probability, whatever the vectors
    are, and codes miss independently. The probability is measured with planted pairs in the first four codes, and
    two standard errors are taken off; links above the threshold are found more often.
    """
    rates = [meets(Filters(dimensions, vectors, caps, code), *planted(dimensions, cosine, _PLANTED, caps.seed + code)).mean() for code in range(4)]
    rate = float(np.mean(rates))
    rate -= 2 * math.sqrt(max(rate * (1 - rate), 1e-4) / (4 * _PLANTED))
    return max(caps.codes, math.ceil(math.log(1 - caps.recall) / math.log1p(-max(rate, 1 / (4 * _PLANTED)))))


def units(vectors: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and unit vectors in double precision, by dimension."""
    lengths = np.diff(vectors.offsets.to_numpy())
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(lengths) - lengths
    out = []
    for dimension in np.unique(lengths):
        rows = np.flatnonzero(lengths == dimension)
        own = values[starts[rows][:, None] + np.arange(dimension)[None, :]]
        own = own / np.abs(own).max(axis=1, keepdims=True)
        out.append((rows, own / np.linalg.norm(own, axis=1, keepdims=True)))
    return out


_SLICE = 1024
_HELD = 1 << 28  # bytes of filters that a task keeps


def _decoded(vectors: int, caps: Caps, cosine: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters: dict[tuple[int, int], Filters] = {}
        held = 0
        for whole in batches:
            for start in range(0, whole.num_rows, _SLICE):
                batch = whole.slice(start, _SLICE)
                column = batch.column(batch.schema.get_field_index("vector"))
                for rows, unit in units(column):
                    dimension = unit.shape[1]
                    for code in range(codes_for(dimension, vectors, cosine, caps)):
                        own = filters.get((dimension, code))
                        if own is None:
                            own = Filters(dimension, vectors, caps, code)
                            if held + own.size() <= _HELD:  # others are made again for each slice
                                filters[dimension, code] = own
                                held += own.size()
                        at, number = own.decode(unit)
                        cell = (number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((dimension << 16) + code)).view(np.int64)
                        take = pa.array(rows[at])
                        yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column(batch.schema.get_field_index("node")).take(take), column.take(take)],
                                                         names=["cell", "node", "vector"])

    return run


def _verified(cosine: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in chunks(batches):
            nodes = table["node"].to_numpy()
            part, low, high = (table[c].to_numpy() for c in ("part", "low", "high"))
            vectors = table["vector"].combine_chunks()
            placed = units(vectors)
            matrix = np.zeros((len(nodes), max(u.shape[1] for _, u in placed)))  # one cell never mixes dimensions
            for rows, unit in placed:
                matrix[rows, : unit.shape[1]] = unit
            held = []
            for i, j in pairs(group, part, low, high):
                near = np.einsum("ij,ij->i", matrix[i], matrix[j]) >= cosine
                held.append(np.stack([np.minimum(nodes[i[near]], nodes[j[near]]), np.maximum(nodes[i[near]], nodes[j[near]])], axis=1))
            if held:
                found = np.unique(np.concatenate(held), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["u", "v"])

    return run


def usable(vector: Column) -> Column:
    """Not NULL, without NULL, infinite or NaN components, not all zero."""
    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def links(nodes: DataFrame, cosine: float = 0.9, caps: Caps = Caps()) -> DataFrame:
    """Distinct pairs (u, v), u < v, of `nodes` (node long, vector array) at the given cosine or above, as far as filters find them."""
    kind = nodes.schema["vector"].dataType.simpleString()
    cells = nodes.select("node", "vector").mapInArrow(_decoded(nodes.count(), caps, cosine), f"cell long, node long, vector {kind}")
    return tiled(cells, "node").mapInArrow(_verified(cosine), "u long, v long").distinct()


def groups(df: DataFrame, row_id: str = "vec_id", vector: str = "embedding", cosine: float = 0.9, caps: Caps = Caps()) -> DataFrame:
    """row_id, n_links, component_id, kept of every row of `df`.

    Equal vectors form one class first; links are searched between classes and counted with their members, so a
    vector with thousands of copies costs one search. Vectors that are NULL, zero or hold NULL or non-finite
    components, and vectors of different length, link with nothing. Ids that are NULL are no candidates for a
    component's smallest; `kept` is false for them unless their component has no id at all. An empty table has no groups.
    """
    rows = settle(df.select(F.col(row_id).alias("_id"), F.when(usable(F.col(vector)), F.col(vector)).alias("vector")))
    classes = settle(rows.where("vector IS NOT NULL").groupBy("vector").agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_n"))
                     .withColumn("node", F.monotonically_increasing_id()))
    found = settle(links(classes, cosine, caps))
    both = found.unionByName(found.select(F.col("v").alias("u"), F.col("u").alias("v")))
    others = both.join(classes.select(F.col("node").alias("v"), "_n"), "v").groupBy(F.col("u").alias("node")).agg(F.sum("_n").alias("_others"))
    member = classes.join(others, "node", "left").join(components(found), "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = member.groupBy("root").agg(F.min("_least").alias("component_id"))
    placed = member.join(smallest, "root").select("vector", (F.col("_n") - 1 + F.coalesce("_others", F.lit(0))).cast("long").alias("n_links"), "component_id")
    linked = rows.where("vector IS NOT NULL").join(placed, "vector").select("_id", "n_links", "component_id")
    alone = rows.where("vector IS NULL").select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("_id").alias(row_id), "n_links", "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))
