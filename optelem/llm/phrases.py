"""Phrase collocations: frequent word sequences of every language, counted in suffix trees that are built prefix by prefix.

A window is the text that follows a word in its piece, cut at the longest phrase of interest: the suffix of the text,
truncated in depth. Windows that begin alike share a branch of the suffix tree, so the tree can be cut into subtrees by
prefix: a prefix with more windows than an eighth of a group's budget is extended by a word, and the prefixes that
result are dealt to groups of about the memory budget. Each group is built by itself; a subtree's node count is the sum
of its leaves. Only prefixes above the budget span groups, their partial sums are added up.

Before that, two passes sum the words and then the word pairs by hash cell. Bitmaps of fixed size mark the cells that
reach the least frequency, or the budget; a window ends before a pair whose cell does not reach it. Cells add up what
collides, so a bitmap never hides a frequent pair, and every count that is returned is exact.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from optelem.plans.lookups import settle, settled_lookup

FILTER_BITS = 27  # 16 MB as a bitmap
BLOCK_BYTES = 2 << 20  # of text worked on at once, or one longer text
HELD = 400_000  # cells or windows that a task holds before it passes them on
GROUP_WINDOWS = 500_000  # the memory budget of a group, about 100 MB
SALTS = 64
_CLASS = np.zeros(256, dtype=np.uint8)  # 0 in a word, 1 between words, 2 between pieces
_CLASS[[0x20, 0x09]] = 1
_CLASS[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class Words:
    """The words of a block: `kind` numbers distinct (lang, word) pairs, `joined[i]` says that word i + 1 follows i in its piece."""

    kind: np.ndarray
    joined: np.ndarray
    counts: np.ndarray
    langs: list[str]  # of each kind
    texts: list[bytes]  # of each kind

    def hashes(self) -> np.ndarray:
        seeds = {lang: xxhash.xxh32_intdigest(lang.encode()) for lang in set(self.langs)}
        return np.array([xxhash.xxh64_intdigest(t, seeds[lang]) for lang, t in zip(self.langs, self.texts)], dtype=np.uint64)


def distinct(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys below `size`, the place of each key among them, and how often each occurs."""
    if size > 4 * len(keys) + 1_000_000:
        return np.unique(keys, return_inverse=True, return_counts=True)
    counts = np.bincount(keys, minlength=size)
    found = np.flatnonzero(counts)
    place = np.zeros(size, dtype=np.int64)
    place[found] = np.arange(len(found))
    return found, place[keys], counts[found]


def split_words(langs: list[str], data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of texts that lie one after the other in `data`; text i is data[offsets[i]:offsets[i + 1]]."""
    kinds = _CLASS[data]
    inside = kinds == 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[first] = inside[first]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return Words(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64), [], [])
    ends = np.append((np.cumsum(inside, dtype=np.int64) - 1)[starts], np.count_nonzero(inside)).astype(np.int32)
    chars = _LOWER[data[inside]]
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(chars)]).dictionary_encode()
    text = np.searchsorted(offsets, starts, side="right") - 1
    piece = np.cumsum(kinds == 2, dtype=np.int64)[starts]
    names = sorted(set(langs))
    code = np.array([names.index(lang) for lang in langs] if len(names) < 50 else [{n: i for i, n in enumerate(names)}[lang] for lang in langs], dtype=np.int64)
    size = len(words.dictionary)
    found, kind, counts = distinct(code[text] * size + words.indices.to_numpy(), size * len(names))
    spelled = words.dictionary.take(pa.array(found % size)).to_pylist()
    return Words(kind, (text[1:] == text[:-1]) & (piece[1:] == piece[:-1]), counts, [names[i] for i in found // size], spelled)


def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[Words]:
    """Blocks of whole texts from batches of (lang string, text binary), none NULL."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(1)
        offsets = np.frombuffer(text.buffers()[1], dtype=np.int32)[text.offset: text.offset + len(text) + 1].astype(np.int64)
        data = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)
        langs = batch.column(0).to_pylist()
        row = 0
        while row < len(langs):
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK_BYTES, side="right")) - 1)
            yield split_words(langs[row:end], data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row])
            row = end


class Bitmap:
    """Marked cells; travels compressed, since most of it is empty."""

    def __init__(self, bits: int, packed: bytes):
        self.bits, self.packed, self.cells = bits, packed, None

    def __getstate__(self):
        return self.bits, self.packed

    def __setstate__(self, state):
        self.bits, self.packed = state
        self.cells = None

    def __getitem__(self, cell: np.ndarray) -> np.ndarray:
        if self.cells is None:
            self.cells = np.frombuffer(zlib.decompress(self.packed), dtype=np.uint8)
        return (self.cells[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)


def word_cells(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def pair_cells(left: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    mixed = (left * np.uint64(0x9E3779B97F4A7C15) ^ right) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed ^= mixed >> np.uint64(29)
    return word_cells(mixed * np.uint64(0x165667B19E3779F9), bits)


class _Sums:
    """Counts by cell, passed on when they are many."""

    def __init__(self):
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, cells: np.ndarray, counts: np.ndarray) -> None:
        self.held.append((cells, counts))
        self.size += len(cells)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        cells, place = np.unique(np.concatenate([c for c, _ in self.held]), return_inverse=True)
        counts = np.bincount(place, np.concatenate([n for _, n in self.held]), len(cells)).astype(np.int64)
        self.held, self.size = [(cells, counts)], len(cells)
        return cells, counts

    def drain(self, bound: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.size > bound and (len(self.merged()[0]) > bound // 2 or not bound):
            cells, counts = self.merged()
            self.held, self.size = [], 0
            for i in range(0, len(cells), 50_000):
                yield cells[i:i + 50_000], counts[i:i + 50_000]


COUNTS = "bucket int, cells binary, counts binary, lang string, n long"
BUCKET_BITS = 15


def _packed(cells: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Sorted cells and their counts, one row for each bucket of 2 ** 15 neighbouring cells."""
    bucket = cells >> BUCKET_BITS
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    ends = np.append(first, len(cells))
    low = (cells & (1 << BUCKET_BITS) - 1).astype("<u2")
    binary = [pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((ends * v.itemsize).astype(np.int32)), pa.py_buffer(v)]) for v in (low, counts.astype("<i8"))]
    none = pa.nulls(len(first))
    return pa.RecordBatch.from_arrays([pa.array(bucket[first], pa.int32()), *binary, none.cast(pa.string()), none.cast(pa.int64())], names=["bucket", "cells", "counts", "lang", "n"])


def _cell_counts(bits: int, known: Bitmap | None) -> Callable:
    """Sums by cell of the words, or of the pairs of known words, packed by bucket; and rows (lang, n) of all words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, totals = _Sums(), {}

        def words_by_lang() -> pa.RecordBatch:
            none = pa.nulls(len(totals))
            return pa.RecordBatch.from_arrays([none.cast(pa.int32()), none.cast(pa.binary()), none.cast(pa.binary()), pa.array(list(totals), pa.string()),
                                               pa.array(list(totals.values()), pa.int64())], names=["bucket", "cells", "counts", "lang", "n"])

        for words in blocks(batches):
            if not len(words.kind):
                continue
            hashes = words.hashes()
            if known is None:
                sums.add(word_cells(hashes, bits), words.counts)
                for lang, n in zip(words.langs, words.counts.tolist()):
                    totals[lang] = totals.get(lang, 0) + n
                if len(totals) > 10_000:
                    yield words_by_lang()
                    totals.clear()
            else:
                often = known[word_cells(hashes, bits)][words.kind]
                at = np.flatnonzero(words.joined & often[:-1] & often[1:])
                sums.add(*np.unique(pair_cells(hashes[words.kind[at]], hashes[words.kind[at + 1]], bits), return_counts=True))
            for cells, counts in sums.drain(HELD):
                yield _packed(cells, counts)
        for cells, counts in sums.drain(0):
            yield _packed(cells, counts)
        yield words_by_lang()

    return run


def _marks(bits: int, levels: list[int]) -> Callable:
    """(level, bucket, bitmap) from packed counts sorted by bucket: the cells whose sum reaches levels[level]."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sums = None, np.zeros(1 << BUCKET_BITS, dtype=np.int64)

        def marked() -> Iterator[pa.RecordBatch]:
            for level, least in enumerate(levels):
                reached = sums >= least
                if current is not None and reached.any():
                    yield pa.RecordBatch.from_arrays([pa.array([level], pa.int32()), pa.array([current], pa.int32()), pa.array([np.packbits(reached, bitorder="little").tobytes()], pa.binary())],
                                                     names=["level", "bucket", "bitmap"])

        for batch in batches:
            for bucket, cells, counts in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                if bucket != current:
                    yield from marked()
                    current = bucket
                    sums[:] = 0
                sums[np.frombuffer(cells, dtype="<u2")] += np.frombuffer(counts, dtype="<i8")  # cells of a row are distinct
        yield from marked()

    return run


def _bitmaps(packed: DataFrame, bits: int, levels: list[int]) -> list[Bitmap]:
    """For each level the cells whose sum reaches it. Of any table the driver sees at most 2 ** bits bits a level."""
    by_bucket = packed.repartition("bucket").sortWithinPartitions("bucket")
    cells = [np.zeros(max(1 << BUCKET_BITS, 1 << bits) >> 3, dtype=np.uint8) for _ in levels]
    for level, bucket, bitmap in by_bucket.mapInArrow(_marks(bits, levels), "level int, bucket int, bitmap binary").toLocalIterator():
        cells[level][bucket << BUCKET_BITS - 3: bucket + 1 << BUCKET_BITS - 3] = np.frombuffer(bytes(bitmap), dtype=np.uint8)
    return [Bitmap(bits, zlib.compress(c, 1)) for c in cells]


@dataclass(frozen=True)
class Filters:
    """Cells of words and pairs that are frequent, and of those that are too frequent for one group."""

    words: Bitmap
    heavy_words: Bitmap
    pairs: Bitmap
    heavy_pairs: Bitmap


def windows_of(words: Words, filters: Filters, longest: int) -> Iterator[tuple[str, bytes, int, int]]:
    """(lang, window, depth, n): distinct windows of a block, words with a blank after each, and the depth of their prefix.

    They begin at frequent words and run on over frequent pairs, `longest` words at most. The prefix is the first word;
    two words where that word is heavy; the whole window where the pair is heavy too, which `depth` above `longest` says.
    """
    hashes = words.hashes()
    cells = word_cells(hashes, filters.words.bits)
    often = filters.words[cells][words.kind]
    linked = words.joined & often[:-1] & often[1:]
    at = np.flatnonzero(linked)
    pair = pair_cells(hashes[words.kind[at]], hashes[words.kind[at + 1]], filters.pairs.bits)
    linked[at] = filters.pairs[pair]
    heavy_pair = np.zeros(len(often), dtype=bool)
    heavy_pair[at] = filters.heavy_pairs[pair]
    run = np.zeros(len(often), dtype=np.int64)  # pairs that a window goes on for
    for _ in range(longest - 1):
        run[:-1] = np.where(linked, np.minimum(run[1:] + 1, longest - 1), 0)
    at = np.flatnonzero(often)
    paths = [t + b" " for t in words.texts]
    langs, spelled, depths = words.langs, paths, np.where(filters.heavy_words[cells], 2, 1)
    place = words.kind[at]
    for depth in range(longest):
        ends = run[at] == depth
        found, _, counts = distinct(place[ends], len(spelled))
        for i, n in zip(found.tolist(), counts.tolist()):
            yield langs[i], spelled[i], int(depths[i]), n
        at, place = at[~ends], place[~ends]
        if not len(at):
            return
        found, place, _ = distinct(place * len(paths) + words.kind[at + depth + 1], len(spelled) * len(paths))
        before, after = found // len(paths), found % len(paths)
        langs, spelled, depths = [langs[i] for i in before], [spelled[i] + paths[j] for i, j in zip(before, after)], depths[before]
        if depth == 0:
            example = np.zeros(len(found), dtype=np.int64)
            example[place] = at
            depths = np.where((depths == 2) & heavy_pair[example], longest + 1, depths)


def prefix_group(lang: str, window: bytes, depth: int, longest: int, groups: int) -> int:
    prefix = window if depth > longest else b" ".join(window.split(b" ", depth)[:depth])
    return xxhash.xxh64_intdigest(prefix, xxhash.xxh32_intdigest(lang.encode())) % groups


def _grouped_windows(filters: Filters, longest: int, groups: int) -> Callable:
    """(group_no, lang, depth, windows, counts): a task's windows, sorted, one row per group, language and depth."""
    names = ["group_no", "lang", "depth", "windows", "counts"]
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int, bytes], int] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            dealt: dict[tuple[int, str, int], list] = {}
            for (lang, depth, window), n in held.items():
                dealt.setdefault((prefix_group(lang, window, depth, longest, groups), lang, depth), []).append((window, n))
            held.clear()
            out = []
            for key in sorted(dealt):
                part = sorted(dealt.pop(key))
                out.append((*key, b"\n".join([w for w, _ in part]), np.array([n for _, n in part], dtype="<i8").tobytes()))
                if len(out) == 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

        size = 0
        for words in blocks(batches):
            if not len(words.kind):
                continue
            for lang, window, depth, n in windows_of(words, filters, longest):
                key = lang, depth, window
                before = held.get(key)
                if before is None:
                    size += len(window) + 150
                held[key] = n + (before or 0)
            if size > 200 * HELD:
                yield from rows()
                size = 0
        yield from rows()

    return run


def subtree_counts(leaves: dict[bytes, list[int]], least: int) -> Iterator[tuple[bytes, int, int, bool]]:
    """(phrase, words, f, whole) of the nodes of the subtrees whose leaves are `leaves`, window: [n, depth].

    The path to the current leaf is a stack; a node's total goes to its parent when the path leaves it. Nodes as deep as
    the prefix are `whole`, and returned if they reach `least`; shallower ones are this group's share.
    """
    path, totals, depths = [], [], []

    def leave(down_to: int) -> Iterator[tuple[bytes, int, int, bool]]:
        while len(path) > down_to:
            n, whole = totals[-1], len(path) >= depths[-1]
            if n >= least or not whole:
                yield b" ".join(path), len(path), n, whole
            path.pop(), totals.pop(), depths.pop()
            if totals:
                totals[-1] += n

    for window in sorted(leaves):
        n, depth = leaves[window]
        words = window[:-1].split(b" ")
        same = 0
        for a, b in zip(path, words):
            if a != b:
                break
            same += 1
        yield from leave(same)
        for word in words[same:]:
            path.append(word), totals.append(0), depths.append(depth)
        totals[-1] += n
    yield from leave(0)


def _subtrees(least: int) -> Callable:
    """(lang, phrase, words, f, whole) from rows of `_grouped_windows` sorted by group and language, one group in memory."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, leaves = None, {}

        def rows() -> Iterator[pa.RecordBatch]:
            found = list(subtree_counts(leaves, least))
            leaves.clear()
            for i in range(0, len(found), 50_000):
                columns = list(zip(*found[i:i + 50_000]))
                kinds = (pa.binary(), pa.int32(), pa.int64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array([key[1]] * len(columns[0]), pa.string()), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                                                 names=["lang", "phrase", "words", "f", "whole"])

        for batch in batches:
            for group, lang, depth, windows, counts in zip(*[batch.column(i) for i in range(5)]):
                here = group.as_py(), lang.as_py()
                if key != here:
                    if key:
                        yield from rows()
                    key = here
                depth = depth.as_py()
                for window, n in zip(windows.as_py().split(b"\n"), np.frombuffer(counts.as_py(), dtype="<i8").tolist()):
                    leaf = leaves.get(window)
                    if leaf is None:
                        leaves[window] = [n, depth]
                    else:
                        leaf[0] += n
        if key:
            yield from rows()

    return run


def frequent_phrases(df: DataFrame, text: str = "text", lang: str = "lang", longest: int = 5, least: int = 100, filter_bits: int = FILTER_BITS,
                     budget: int = GROUP_WINDOWS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of 1 to `longest` words that occur `least` times or more, and (lang, n).

    `n` counts all words of a language. Both tables are checkpoints.
    """
    texts = df.select(F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text"))
    levels = [least, max(least, budget // 8)]
    counted = settle(texts.mapInArrow(_cell_counts(filter_bits, None), COUNTS))
    totals = settle(counted.where("bucket IS NULL").groupBy("lang").agg(F.sum("n").alias("n")))
    words, heavy_words = _bitmaps(counted.where("bucket IS NOT NULL").select("bucket", "cells", "counts"), filter_bits, levels)
    paired = texts.mapInArrow(_cell_counts(filter_bits, words), COUNTS).where("bucket IS NOT NULL")
    pairs, heavy_pairs = _bitmaps(paired.select("bucket", "cells", "counts"), filter_bits, levels)
    groups = max(1, -(-(totals.agg(F.sum("n")).first()[0] or 0) // budget))
    windows = texts.mapInArrow(_grouped_windows(Filters(words, heavy_words, pairs, heavy_pairs), longest, groups), "group_no long, lang string, depth int, windows binary, counts binary")
    nodes = settle(windows.repartition("group_no").sortWithinPartitions("group_no", "lang").mapInArrow(_subtrees(least), "lang string, phrase binary, words int, f long, whole boolean"))
    shared = nodes.where("NOT whole").groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    found = nodes.where("whole").drop("whole").unionByName(shared).withColumn("phrase", F.col("phrase").cast("string"))
    return settle(found), totals


def floor_score(a: str = "a", n: str = "n", left: str = "l", right: str = "r") -> F.Column:
    """floor(1000 * a * n / (l * r)) of longs, whole numbers throughout; products have 38 digits, enough for counts up to 3 * 10 ** 17."""
    a, n, left, right = (f"CAST({c} AS DECIMAL(19,0))" for c in (a, n, left, right))
    return F.expr(f"(CAST(1000 AS DECIMAL(4,0)) * {a} * {n}) div ({left} * {right})").cast("long")


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", longest: int = 5, least: int = 100, top: int = 2000, filter_bits: int = FILTER_BITS,
                 budget: int = GROUP_WINDOWS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best `top` phrases of every language.

    A phrase scores as its worst cut in two: how much likelier it is than its parts side by side. A phrase that occurs
    only within a longer one, `longest` words at most, goes; then the word before or after it is always the same, so
    one word more decides it. NULL texts are empty and a NULL language is `und`, like texts that say so. Texts of any
    length are read whole, a task holds one text or 2 MB. Rows that repeat a text count again. Equal scores rank by
    `a`, then by the phrase's bytes. A table without such phrases has no rows. Other columns are ignored.
    """
    phrases, totals = frequent_phrases(df, text, lang, longest, least, filter_bits, budget)
    candidates = phrases.where("words > 1").withColumnRenamed("f", "a")
    inner = F.explode(F.array(F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring_index(phrase, ' ', 1 - words)")))
    within = candidates.where("words > 2").select("lang", inner.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    kept = candidates.join(within, ["lang", "phrase"], "left").where("_longer IS NULL OR _longer < a").drop("_longer")
    cuts = kept.withColumn("k", F.explode(F.expr("sequence(1, words - 1)"))).withColumns(
        {"_left": F.expr("substring_index(phrase, ' ', k)"), "_right": F.expr("substring_index(phrase, ' ', k - words)")})
    left = phrases.select("lang", F.col("phrase").alias("_left"), F.col("f").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("_right"), F.col("f").alias("r"))
    scored = cuts.join(left, ["lang", "_left"]).join(right, ["lang", "_right"]).join(settled_lookup(totals), "lang")
    scored = scored.withColumn("_cut", F.struct(floor_score().alias("score"), "k", "l", "r"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min("_cut").alias("_cut")).select("lang", "phrase", "a", "_cut.l", "_cut.r", "n", "_cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = Window.partitionBy("lang", "_salt").orderBy(*order)  # first the best of each share, so that no task orders a whole language
    best = best.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
