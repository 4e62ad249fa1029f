"""Pairs of members that share a cell, without gathering a cell in one task.

A cell with more members than a tile holds is dealt to tiles: its members fall into parts by hash, and every two
parts (a part with itself included) meet in one tile, so each pair of members meets exactly once in the cell and no
group is larger than about two parts. Tasks read their rows sorted by cell and work on chunks of whole groups.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from optelem.plans.lookups import settled_lookup

TILE = 1024
CHUNK_ROWS = 100_000
MAX_LARGE_CELLS = 200_000  # of those that are broadcast, two numbers each; more of them join by shuffle


def tiled(cells: DataFrame, member: str, tile: int = TILE) -> DataFrame:
    """`cells` (cell long, ...) with `part`, `low`, `high`, dealt out and sorted by (cell, low, high)."""
    large = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > tile)
    large = settled_lookup(large.select("cell", F.ceil(F.col("_n") / tile).cast("int").alias("_parts")), MAX_LARGE_CELLS)
    dealt = cells.join(large, "cell", "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64(member), F.col("_parts")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    dealt = dealt.withColumn("low", F.least("part", "_other")).withColumn("high", F.greatest("part", "_other")).drop("_parts", "_other")
    return dealt.repartition("cell", "low", "high").sortWithinPartitions("cell", "low", "high")


def chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, and the number of each row's group in its table. Groups of one row are left out."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def cut(last: bool) -> tuple[pa.Table, np.ndarray, pa.Table]:
        table = pa.Table.from_batches(held)
        new = np.ones(len(table) + 1, dtype=bool)
        new[1:-1] = False
        for name in ("cell", "low", "high"):
            column = table[name].to_numpy()
            new[1:-1] |= column[1:] != column[:-1]
        group = np.cumsum(new[:-1]) - 1
        end = len(table) if last else int(np.flatnonzero(group == group[-1])[0])
        shared = ~(new[:-1] & new[1:])[:end]
        return table.slice(0, end).filter(pa.array(shared)), group[:end][shared], table.slice(end)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= CHUNK_ROWS:
            table, group, rest = cut(False)
            if len(group):
                yield table, group
            held, rows = rest.to_batches(), len(rest)
    if rows:
        table, group, _ = cut(True)
        if len(group):
            yield table, group


def pairs(group: np.ndarray, part: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of all pairs within groups; between two parts only, where a tile joins two parts."""
    at = np.arange(len(group))
    distance = 1
    while True:
        at = at[at + distance < len(group)]
        at = at[group[at] == group[at + distance]]
        if not len(at):
            return
        other = at + distance
        meets = (low[at] == high[at]) | (part[at] != part[other])
        yield at[meets], other[meets]
        distance += 1


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every node of the given edges to the smallest node that it reaches through them."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = place[: len(a)], place[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, root[a], low)
        np.minimum.at(after, root[b], low)
        after = np.minimum(after, after[after])
        if (after == root).all():
            break
        root = after
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]
