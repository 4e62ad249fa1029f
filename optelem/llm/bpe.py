"""Byte-level BPE: encoding by a two-tier lookup, and decoding.

Tier one is a minimal perfect hash over the vocabulary: keys are split into buckets, each bucket stores the
displacement that sends its keys to free slots, and a slot holds the one token that can be there; a pre-token equal
to it is one id. Tier two takes the misses: the bytes form a linked list, a heap holds the ranks of neighbouring
pairs, and the lowest rank (the leftmost of equal ones) is joined until no pair is left, in n log n steps for a
pre-token of any length. Pairs are looked up by their two ids.

The table (a bounded vocabulary file) is read by the driver and broadcast; each Python worker builds it once and
remembers recent pre-tokens in a table of bounded size.
"""

from __future__ import annotations

import base64
import re
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from optelem.llm.texts import add_columns

REMEMBERED = 700_000  # pre-tokens a worker keeps, about 110 MB
MAX_VOCABULARY_BYTES = 64_000_000  # of the file that is broadcast
_SPREAD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


# Letters and digits that Unicode has taken in after version 16, as a character class.
YOUNG = (r"\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c\uab6d"
         r"\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
         r"\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8"
         r"\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
         r"\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
         r"\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
         r"\U0001e6e0-\U0001e6e2\U0001e6e4\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe\U0001e6ff"
         r"\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f")
_beyond_latin = re.compile("[^\\x00-\\u024f]").search
_young = re.compile(f"[{YOUNG}]").search


# The members of the classes below U+0250, for texts that hold nothing beyond.
LATIN = {r"\p{L}": r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"\p{N}": r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\s": r"\t-\r \x85\xa0"}


def latin(pattern: str) -> str:
    """The pattern with classes written out for Latin text, which the faster engine of the standard library takes."""
    out, in_class = [], False
    for part in re.split(r"(\\p\{[LN]\}|\\.|\[\^?|\])", pattern):
        if part in LATIN:
            part = LATIN[part] if in_class else f"[{LATIN[part]}]"
        elif part == r"\S":
            part = "[^" + LATIN[r"\s"] + "]"
        elif part.startswith("["):
            in_class = True
        elif part == "]":
            in_class = False
        out.append(part)
    return "".join(out)


def _slot(key_hash: int, displacement: int, size: int) -> int:
    x = (key_hash ^ (displacement * _SPREAD & _MASK)) * 0xBF58476D1CE4E5B9 & _MASK
    return (x >> 32) * size >> 32


class PerfectHash:
    """A minimal perfect hash: n distinct byte strings to the slots 0..n-1, by one displacement per bucket."""

    KEYS_PER_BUCKET = 4

    def __init__(self, keys: list[bytes]):
        self.size = len(keys)
        self.buckets = max(1, self.size // self.KEYS_PER_BUCKET)
        hashes = np.array([xxhash.xxh64_intdigest(k) for k in keys], dtype=np.uint64)
        by_bucket: dict[int, list[int]] = {}
        for i, h in enumerate(hashes.tolist()):
            by_bucket.setdefault(h % self.buckets, []).append(i)
        free = np.ones(self.size, dtype=bool)
        self.displacement = [0] * self.buckets
        self.keys: list[bytes | None] = [None] * self.size
        step = np.arange(256, dtype=np.uint64)
        spread, scale, n = np.uint64(_SPREAD), np.uint64(0xBF58476D1CE4E5B9), np.uint64(self.size)
        half = np.uint64(32)
        ordered = sorted(by_bucket.items(), key=lambda x: -len(x[1]))
        for bucket, members in ordered:
            if len(members) == 1:
                break
            own, start, slots = hashes[members], 1, None
            while slots is None:
                x = (own[None, :] ^ ((step + np.uint64(start)) * spread)[:, None]) * scale
                tried = ((x >> half) * n >> half).astype(np.int64)
                for row in np.flatnonzero(free[tried].all(1)):
                    if len(set(tried[row].tolist())) == len(members):
                        slots, self.displacement[bucket] = tried[row].tolist(), start + int(row)
                        break
                start += len(step)
            for i, slot in zip(members, slots):
                free[slot], self.keys[slot] = False, keys[i]
        singles = [(bucket, members[0]) for bucket, members in ordered if len(members) == 1]
        for (bucket, i), slot in zip(singles, np.flatnonzero(free).tolist()):  # any slot will do: stored as -1 - slot
            self.displacement[bucket], self.keys[slot] = -1 - slot, keys[i]

    def find(self, key: bytes) -> int:
        """The slot of the key, -1 if it is none of the keys."""
        if not self.size:
            return -1
        h = xxhash.xxh64_intdigest(key)
        d = self.displacement[h % self.buckets]
        slot = -1 - d if d < 0 else _slot(h, d, self.size)
        return slot if self.keys[slot] == key else -1


class Remembered(dict):
    """Ids of pre-tokens as bytes, worked out when first asked for."""

    def __init__(self, codec: Codec):
        super().__init__()
        self._piece = codec.piece

    def __missing__(self, piece: str) -> bytes:
        ids = self._piece(piece.encode())
        found = self[piece] = pack(f"<{len(ids)}i", *ids)
        return found


class Codec:
    """Vocabulary of one rank file, the pattern of pre-tokens, and the two tiers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self._latin = re.compile(latin(pattern)).findall
        self._any = regex.compile(pattern).findall
        self._with_young = regex.compile("(?V1)" + pattern.replace(r"\p{L}", f"[\\p{{L}}--[{YOUNG}]]").replace(r"\p{N}", f"[\\p{{N}}--[{YOUNG}]]")).findall
        tokens = sorted(ranks, key=ranks.get)
        self.table = PerfectHash(tokens)
        self.slot_id = [ranks[k] for k in self.table.keys]
        self.byte_id = [ranks[bytes([b])] for b in range(256)]
        self.width = max(ranks.values()).bit_length()
        self.pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << self.width | right] = rank
        self.first = [self.pairs.get(self.byte_id[a] << self.width | self.byte_id[b], -1) for a in range(256) for b in range(256)]
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.known = Remembered(self)

    def split(self, text: str) -> list[str]:
        """Pre-tokens; letters and digits younger than Unicode 16 are symbols, as they are in the published tokenizers."""
        if text.isascii() or not _beyond_latin(text):
            return self._latin(text)
        return self._with_young(text) if _young(text) else self._any(text)

    def piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        slot = self.table.find(piece)
        return [self.slot_id[slot]] if slot >= 0 else self.merge(piece)

    def merge(self, piece: bytes) -> list[int]:
        """Joins the pair of lowest rank, the leftmost of equal ones, until none is left; heap entries are rank << 32 | place."""
        pairs, width, first = self.pairs, self.width, self.first
        rank = [first[a << 8 | b] for a, b in zip(piece, piece[1:])]  # of the pair that starts at a place, -1 without one
        heap = [r << 32 | i for i, r in enumerate(rank) if r >= 0]
        if not heap:
            return [self.byte_id[b] for b in piece]
        heapify(heap)
        ids = [self.byte_id[b] for b in piece]
        n = len(ids)
        rank.append(-1)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            entry = heappop(heap)
            i = entry & 0xFFFFFFFF
            joined = entry >> 32
            if rank[i] != joined:
                continue  # one of the two has been joined to another since
            j = after[i]
            k = after[j]
            ids[i], after[i], rank[j], rank[i] = joined, k, -1, -1
            if k < n:
                before[k] = i
                r = pairs.get(joined << width | ids[k], -1)
                if r >= 0:
                    rank[i] = r
                    heappush(heap, r << 32 | i)
            h = before[i]
            if h >= 0:
                r = rank[h] = pairs.get(ids[h] << width | joined, -1)
                if r >= 0:
                    heappush(heap, r << 32 | h)
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit numbers."""
        known = self.known
        ids = b"".join(map(known.__getitem__, self.split(text)))
        if len(known) > REMEMBERED:
            known.clear()
        return ids

    def decode(self, ids: list[int]) -> bytes | None:
        """Bytes of the ids; None if one of them is no id of the vocabulary."""
        if ids and not 0 <= min(ids) <= max(ids) < len(self.bytes_of):
            return None
        return b"".join(map(self.bytes_of.__getitem__, ids))


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


_built: dict[tuple, Codec] = {}


def _codec(blob, pattern: str) -> Codec:
    key = (blob.id if hasattr(blob, "id") else id(blob), pattern)
    if key not in _built:
        _built.clear()
        _built[key] = Codec(read_ranks(blob.value), pattern)
    return _built[key]


class Tokenizer:
    """A rank file and a pattern, ready for encode() and decode() on data frames."""

    def __init__(self, spark: SparkSession, rank_file: str, pattern: str):
        with open(rank_file, "rb") as f:
            data = f.read(MAX_VOCABULARY_BYTES + 1)
        if len(data) > MAX_VOCABULARY_BYTES:
            raise ValueError(f"{rank_file} is larger than a vocabulary may be")
        self._blob, self._pattern = spark.sparkContext.broadcast(data), pattern

    def encode(self, df: DataFrame, text: str = "text", out: str = "ids") -> DataFrame:
        """`df` with the ids of each whole text as array<int>; NULL and empty texts have none. A column `out` is replaced."""
        blob, pattern = self._blob, self._pattern

        @arrow_udf("array<int>")
        def run(texts: pa.Array) -> pa.Array:
            codec = _codec(blob, pattern)
            ids, offsets = bytearray(), [0]
            for t in texts:
                ids += codec.encode((t.as_py() or b"").decode("utf-8", "replace"))
                offsets.append(len(ids) // 4)
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(ids)]))

        return add_columns(df, {out: run(F.col(text).cast("binary"))})

    def decode(self, df: DataFrame, ids: str = "ids", out: str = "decoded") -> DataFrame:
        """`df` with the bytes of each id list; NULL if the list is, or holds a number that is no id. A column `out` is replaced."""
        blob, pattern = self._blob, self._pattern

        @arrow_udf("binary")
        def run(lists: pa.Array) -> pa.Array:
            codec = _codec(blob, pattern)
            return pa.array((codec.decode(x.values.to_numpy().tolist()) if x.is_valid and not x.values.null_count else None for x in lists), type=pa.binary())

        return add_columns(df, {out: run(F.col(ids))})
