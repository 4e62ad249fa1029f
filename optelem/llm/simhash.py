"""SimHash near-duplicates by a segment-popcount grid.

A fingerprint is mapped to the bit counts of its short segments. Flipping one bit changes one count by one, so the
Manhattan distance of two count vectors never exceeds the Hamming distance. The vector is cut into bands; two
fingerprints at most `max_bits` apart are at most max_bits // bands apart in some band. There they share a point of
the grid that is half that distance from both, so every fingerprint is put into the cells around its own (a range
join as an equi-join), members of one cell are compared exactly, and the links are joined into components.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from optelem.llm.cells import chunks, forest, pairs, tiled
from optelem.llm.components import components
from optelem.llm.texts import LOWER_AZ, per_text
from optelem.plans.lookups import settle

BANDS = 2
SEGMENT_BITS = 2  # counts 0 to 2, in two bits of the cell number
HELD_EDGES = 500_000
BLOCK = 8192  # shingles whose bits are counted at once


def fingerprint_of(data: bytes, shingle: int) -> int:
    """SimHash of the UTF-8 text as a signed 64-bit number, zero without words."""
    words = data.translate(LOWER_AZ).split()
    if not words:
        return 0
    line = b" ".join(words)
    starts = [0]
    for w in words:
        starts.append(starts[-1] + len(w) + 1)
    digest = xxhash.xxh64_intdigest
    k = min(shingle, len(words))
    n = len(words) - k + 1
    ones = np.zeros(64, dtype=np.int64)
    for first in range(0, n, BLOCK):
        last = min(n, first + BLOCK)
        h = np.array([digest(line[a:b - 1], 42) for a, b in zip(starts[first:last], starts[first + k:last + k])], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little", signed=True)


def fingerprint(text: Column, shingle: int = 4) -> Column:
    """A long column; NULL and empty texts have the fingerprint zero, texts below `shingle` words have one shingle."""
    return per_text("struct<f:long>", lambda data: (fingerprint_of(data, shingle),))(text)["f"]


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def grid_cells(fps: DataFrame) -> DataFrame:
    """cell, fp: for every band the cell of the fingerprint's counts and all cells one step away."""
    width = 64 // BANDS
    cells = []
    for band in range(BANDS):
        half = F.shiftrightunsigned("fp", band * width).bitwiseAND(F.lit((1 << width) - 1))
        counts = half - F.shiftrightunsigned(half, 1).bitwiseAND(F.lit(int("01" * (width // 2), 2)))  # each pair of bits becomes its count
        base = F.lit(band << width)
        cells.append(F.array(counts + base))
        for segment in range(width // SEGMENT_BITS):
            unit = 1 << (segment * SEGMENT_BITS)
            here = F.shiftrightunsigned(counts, segment * SEGMENT_BITS).bitwiseAND(F.lit(3))
            cells.append(F.when(here == 1, F.array(counts + base - unit, counts + base + unit))
                         .when(here == 0, F.array(counts + base + unit)).otherwise(F.array(counts + base - unit)))
    return fps.select("fp", F.explode(F.concat(*cells)).alias("cell"))


def _linked(max_bits: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in chunks(batches):
            fps = table["fp"].to_numpy()
            bits = fps.view(np.uint64)
            part, low, high = (table[c].to_numpy() for c in ("part", "low", "high"))
            held, size = [], 0
            for i, j in pairs(group, part, low, high):
                near = np.bitwise_count(bits[i] ^ bits[j]) <= max_bits
                held.append((fps[i[near]], fps[j[near]]))
                size += int(near.sum())
                if size > HELD_EDGES:
                    held = [forest(*map(np.concatenate, zip(*held)))]
                    size = 0
            if held:
                u, v = forest(*map(np.concatenate, zip(*held)))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return run


def linked(fps: DataFrame, max_bits: int = 4) -> DataFrame:
    """Edges (u, v) that join all distinct fingerprints `fp` at most `max_bits` apart, directly or through others.

    A task returns a forest of the links in its cells, so a group of near copies yields as many edges as members.
    """
    if max_bits // BANDS > 2:
        raise ValueError("cells one step away find distances up to 2 in a band")
    return tiled(grid_cells(fps), "fp").mapInArrow(_linked(max_bits), "u long, v long")


def groups(df: DataFrame, row_id: str = "doc_id", text: str = "text", shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """row_id, fp, root, component_id of every row of `df`.

    Equal fingerprints form one class before anything is joined, whatever their number. `component_id` is the
    smallest id reachable, ignoring NULL ids (NULL if a group has no other); `root` names the group even then.
    Empty and NULL texts share the fingerprint zero and link like any other. An empty table has no groups.
    """
    prints = settle(df.select(F.col(row_id), fingerprint(F.col(text), shingle).alias("fp")))
    classes = settle(prints.groupBy("fp").agg(F.min(row_id).alias("_least")))
    found = components(linked(classes.select("fp"), max_bits)).withColumnRenamed("node", "fp")
    member = classes.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    member = settle(member)
    smallest = member.groupBy("root").agg(F.min("_least").alias("component_id"))
    return prints.join(member.join(smallest, "root").select("fp", "root", "component_id"), "fp").select(row_id, "fp", "root", "component_id")


def one_per_group(df: DataFrame, row_id: str = "doc_id", text: str = "text", shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """The rows of `df` whose id is the smallest of their group, one row per group, with the columns of `df`.

    An id may stand on rows of several groups; it represents those of which it is the smallest. Rows that repeat an id
    within a group are all alike to the operator, one of them stays. A row with a NULL id stays only where its whole
    group has none.
    """
    found = settle(groups(df, row_id, text, shingle, max_bits))  # four numbers a row, read by every branch below
    least = F.col(row_id) == F.col("component_id")
    kept = found.where(F.col(row_id).isNotNull()).groupBy(F.col(row_id).alias("_id")).agg(F.count(F.lit(1)).alias("_rows"), F.max(least).alias("_least")).where("_least")
    joined = df.join(kept, F.col(row_id) == F.col("_id"))
    once = joined.where("_rows = 1")
    places = found.where(least).select(F.col(row_id).alias("_id"), F.col("fp").alias("_fp"), F.col("root").alias("_root")).distinct()
    repeated = joined.where("_rows > 1").withColumn("_fp", fingerprint(F.col(text), shingle))
    often = repeated.join(places, ["_id", "_fp"]).dropDuplicates(["_id", "_root"])
    nameless = df.where(F.col(row_id).isNull()).withColumn("_fp", fingerprint(F.col(text), shingle))
    orphans = found.where("component_id IS NULL").select(F.col("fp").alias("_fp"), F.col("root").alias("_root")).distinct()
    alone = nameless.join(orphans, "_fp").dropDuplicates(["_root"])
    return once.select(*df.columns).unionByName(often.select(*df.columns)).unionByName(alone.select(*df.columns))
