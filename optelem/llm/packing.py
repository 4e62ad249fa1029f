"""Packing token ids into rows of equal length by best fit decreasing.

Documents are dealt to shards by hash, and each shard is packed alone, so no task sees more than a shard. Documents
longer than a row are cut into full rows and a remainder, without losing a token. The pieces of a shard are placed
from the longest to the shortest, each into the open row with the least room that still fits; a segment tree over
the possible rooms finds it in a logarithmic number of steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from optelem.llm.bpe import MAX_VOCABULARY_BYTES, read_ranks

ROWS_PER_SHARD = 2000  # documents, on average
WINDOW_TOKENS = 8_000_000  # a shard with more is packed in several windows, so memory is bounded


class Rooms:
    """Open rows by the room they have left; a segment tree tells which rooms occur."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.leaves)  # rows below each node
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """The row with the smallest room of at least `least`, and that room."""
        node = self.leaves + least
        if not self.tree[node]:
            while node > 1 and (node & 1 or not self.tree[node + 1]):  # up to the first ancestor with something to its right
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.tree[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._add(room, -1)
        return self.rows[room].pop(), room

    def _add(self, room: int, by: int) -> None:
        node = self.leaves + room
        while node:
            self.tree[node] += by
            node >>= 1


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Pieces of each row; `lengths` must fall and none may pass the capacity."""
    rooms, rows = Rooms(capacity), []
    for piece, length in enumerate(lengths):
        found = rooms.take(length)
        if found:
            row, room = found
            rows[row].append(piece)
        else:
            row, room = len(rows), capacity
            rows.append([piece])
        if room > length:
            rooms.put(room - length, row)
    return rows


def cut(tokens: list[np.ndarray], capacity: int) -> list[tuple[int, int, int]]:
    """(document, first token, length) of all pieces, the longest first, else in order."""
    pieces = [(d, at, min(capacity, len(t) - at)) for d, t in enumerate(tokens) for at in range(0, len(t), capacity)]
    return sorted(pieces, key=lambda p: (-p[2], p[0], p[1]))


_ROW = "shard int, window int, row int, n_tokens int, doc_ids array<long>, first_tokens array<int>, cu_seqlens array<int>, input_ids binary, position_ids binary"
_TYPES = {"int": pa.int32(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "binary": pa.binary()}
_SCHEMA = pa.schema([(n, _TYPES[k]) for n, k in (x.split() for x in _ROW.split(", "))])


def _packed(capacity: int, pad: int, dtype: str, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids: list[int | None] = []
    tokens: list[np.ndarray] = []
    shard, window, size = None, 0, 0

    def rows() -> Iterator[pa.RecordBatch]:
        pieces = cut(tokens, capacity)
        found: list[list] = [[] for _ in _SCHEMA.names]
        for number, row in enumerate(best_fit([p[2] for p in pieces], capacity)):
            matrix, position = np.full(capacity, pad, dtype=dtype), np.zeros(capacity, dtype=dtype)
            ends = [0]
            for d, at, length in (pieces[k] for k in row):
                span = slice(ends[-1], ends[-1] + length)
                matrix[span] = tokens[d][at:at + length]
                position[span] = np.arange(length)
                ends.append(span.stop)
            values = (shard, window, number, ends[-1], [ids[pieces[k][0]] for k in row], [pieces[k][1] for k in row], ends, matrix.tobytes(), position.tobytes())
            for column, value in zip(found, values):
                column.append(value)
            if len(found[0]) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(found, _SCHEMA)], schema=_SCHEMA)
                found = [[] for _ in _SCHEMA.names]
        if found[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(found, _SCHEMA)], schema=_SCHEMA)

    for batch in batches:
        lists = batch.column(batch.schema.get_field_index("ids"))
        for number, row_id, own in zip(batch.column(batch.schema.get_field_index("shard")).to_pylist(), batch.column(batch.schema.get_field_index("id")).to_pylist(), lists):
            if shard is not None and (number != shard or size >= WINDOW_TOKENS):
                yield from rows()
                window = window + 1 if number == shard else 0
                ids, tokens, size = [], [], 0
            shard = number
            ids.append(row_id)
            values = own.values.to_numpy(zero_copy_only=False)
            if not (values.min() >= 0 and values.max() <= np.iinfo(dtype).max):  # NULL is NaN here
                raise ValueError(f"ids of document {row_id} do not fit {dtype}")
            tokens.append(values.astype(dtype))
            size += len(tokens[-1])
    if ids:
        yield from rows()


def pack(df: DataFrame, row_id: str = "doc_id", ids: str = "ids", capacity: int = 2048, pad: int = 0, dtype: str = "<u2") -> DataFrame:
    """Rows of `capacity` token ids, from the array column `ids`.

    Per row: its shard, window and number, the tokens used, the document and first token of each segment, cumulative
    segment lengths from 0, and as binary arrays of `dtype` the ids, padded with `pad`, and positions that start from 0
    in each segment. Every token occurs once. NULL and empty id lists take no room. Repeated rows and NULL ids are
    packed like others. `dtype` must hold every id and the capacity, else it raises.
    """
    if capacity > np.iinfo(dtype).max:
        raise ValueError("positions do not fit the type")
    filled = df.where(F.size(ids) > 0).select(F.col(row_id).cast("long").alias("id"), F.col(ids).alias("ids"))
    shards = max(1, -(-df.count() // ROWS_PER_SHARD))
    dealt = filled.withColumn("shard", F.pmod(F.xxhash64("id", F.size("ids"), F.element_at("ids", 1)), F.lit(shards)).cast("int"))
    return dealt.repartition("shard").sortWithinPartitions("shard", "id").mapInArrow(partial(_packed, capacity, pad, dtype), _ROW)


def library_ids(spark: SparkSession, rank_file: str, pattern: str) -> Callable[[Column], Column]:
    """Token ids by the installed tokenizer library: the input of `pack` where ids are only a means.

    Declared nondeterministic, though it is not, so that a filter on the ids does not tokenize twice.
    """
    with open(rank_file, "rb") as f:
        blob = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(blob) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{rank_file} is larger than a vocabulary may be")
    data = spark.sparkContext.broadcast(blob)
    made: dict[str, tiktoken.Encoding] = {}

    @arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        if not made:
            made["coder"] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(data.value), special_tokens={})
        found, offsets = [], [0]
        for t in texts:
            found.append(made["coder"].encode_to_numpy((t.as_py() or b"").decode("utf-8", "replace"), disallowed_special=()).astype(np.int32))
            offsets.append(offsets[-1] + len(found[-1]))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32)))

    once = run.asNondeterministic()
    return lambda text: once(text.cast("binary"))
