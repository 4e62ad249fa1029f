"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the set of hashed character n-grams of `<word>` and the word itself; its embedding is their mean, a window
of words is the mean of its words, and two linear outputs with a softmax give the probability. Embeddings and outputs
are trained together in numpy. A misspelling that was never seen shares most n-grams with the word it is made from.

A long text is a sequence of overlapping windows, and its probability is that of its worst window, in training and in
scoring, so a short insult in a long text is not averaged away. For scoring, the trained tables collapse into one
number per n-gram bucket, a few hundred kilobytes that are broadcast whatever the size of the corpus.
"""

from __future__ import annotations

import math
from array import array
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from optelem.llm.texts import per_batch, replaced


def _words(text: str) -> list[str]:
    """Lower-case words of the text; one that repeats the word before it counts once."""
    found = text.lower().split()
    return [w for w, last in zip(found, [None, *found]) if w != last]


_PUNCTUATION = ".,;:!?…\"'`´“”‘’«»()[]{}<>*_~-–—/\\|#"
GROUP, TEXTS = 2000, 256  # words that are hashed, and texts that are taken apart, at a time
_BASE, _MIX = np.uint64(1_000_003), np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 17
    shortest: int = 3  # n-grams in characters
    longest: int = 5
    dimensions: int = 8
    window: int = 4  # words
    step: int = 2
    rows_per_class: int = 2500  # bound of the training sample, per class
    longest_text: int = 20_000  # bytes of a training text; longer labelled texts are not sampled, all are scored
    misspelt: float = 0.3  # share of training words that are misspelt at random
    epochs: int = 12
    least_steps: int = 400  # small samples take more epochs, until so many batches are seen
    batch: int = 128  # documents
    rate: float = 0.5
    out_rate: float = 0.2
    decay: float = 1e-4
    sharpness: float = 8.0  # of the weights of windows at the last step
    seed: int = 7


def subwords(words: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of `<word>` and of the whole, words one after the other, and their number per word.

    Punctuation around a word is left out, unless it has nothing else. An n-gram's bucket is a polynomial of its characters.
    """
    marked = [f"<{w.strip(_PUNCTUATION) or w}>" for w in words]
    points = np.frombuffer("".join(marked).encode("utf-32-le", "replace"), dtype="<u4").astype(np.uint64)
    sizes = np.array([len(m) for m in marked])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(points)) - starts[owner]
    left = sizes[owner] - place  # characters from here to the end of the word
    powers = np.cumprod(np.concatenate([[1], np.full(int(sizes.max()) if len(sizes) else 0, _BASE, dtype=np.uint64)]).astype(np.uint64))
    hashes, owners = [np.add.reduceat((points + np.uint64(1)) * powers[place], starts) + np.uint64(7)] if len(words) else [], [np.arange(len(words))]
    rolling = np.zeros(len(points), dtype=np.uint64)
    for n in range(1, s.longest + 1):
        rolling[: len(points) - n + 1] += (points[n - 1:] + np.uint64(1)) * powers[min(n - 1, len(powers) - 1)]
        if n >= s.shortest:
            full = np.flatnonzero(left >= n)
            hashes.append(rolling[full] + np.uint64(n))
            owners.append(owner[full])
    hashed = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    owned = np.concatenate(owners)
    mixed = (hashed ^ (hashed >> np.uint64(31))) * _MIX
    buckets = (mixed >> np.uint64(40)) % np.uint64(s.buckets)
    order = np.argsort(owned, kind="stable")
    return buckets[order].astype(np.int32), np.bincount(owned, minlength=len(words))


def windows(words: int, s: Settings) -> np.ndarray:
    """Word numbers of the overlapping windows that cover a text, a row for each; a short text is one window."""
    if words <= s.window:
        return np.arange(words)[None, :]
    starts = np.append(np.arange(0, words - s.window, s.step), words - s.window)
    return starts[:, None] + np.arange(s.window)[None, :]


class Model:
    """Bucket values and bias of the trained network, collapsed to the difference of its two outputs.

    `wordless` is the logit of texts without words.
    """

    REMEMBERED = 200_000  # words whose value a worker keeps

    def __init__(self, values: np.ndarray, bias: float, settings: Settings, wordless: float):
        self.values, self.bias, self.settings, self.wordless = values, bias, settings, wordless
        self._known: dict[str, float] = {}

    def __getstate__(self):
        return self.values, self.bias, self.settings, self.wordless

    def __setstate__(self, state):
        self.__init__(*state)

    def _learn(self, words: set[str]) -> None:
        new = sorted(words.difference(self._known))
        if new:
            buckets, counts = subwords(new, self.settings)
            self._known.update(zip(new, (np.add.reduceat(self.values[buckets], np.cumsum(counts) - counts) / counts).tolist()))

    def _logit(self, words: list[str]) -> float:
        s = self.settings
        if not words:
            return self.wordless
        each = np.array([self._known[w] for w in words])
        if len(words) <= s.window:
            return float(each.mean()) + self.bias
        sums = np.concatenate([[0.0], np.cumsum(each)])
        starts = np.append(np.arange(0, len(words) - s.window, s.step), len(words) - s.window)
        return float((sums[starts + s.window] - sums[starts]).max()) / s.window + self.bias

    def scores(self, texts: list[str | bytes]) -> list[float]:
        """Probabilities of the texts (or their UTF-8 bytes)."""
        out: list[float] = []
        for first in range(0, len(texts), TEXTS):
            split = [_words(t if isinstance(t, str) else t.decode("utf-8", "replace")) for t in texts[first:first + TEXTS]]
            self._learn(set().union(*split))
            out += [1.0 / (1.0 + math.exp(-min(60.0, max(-60.0, self._logit(w))))) for w in split]
            if len(self._known) > self.REMEMBERED:
                self._known.clear()
        return out


def misspelt(word: str, random: np.random.Generator) -> str:
    """The word with one letter left out, doubled, replaced or swapped with the next; words below four letters stay."""
    if len(word) < 4:
        return word
    at, how = int(random.integers(1, len(word) - 1)), int(random.integers(4))
    middle = ("", word[at] * 2, "abcdefghijklmnopqrstuvwxyz0134$@*"[int(random.integers(33))], word[at + 1] + word[at])[how]
    return word[:at] + middle + word[at + (2 if how == 3 else 1):]


def train(texts: list[str], labels: list[int], s: Settings = Settings()) -> Model:
    """Gradient steps on the cross entropy of each text; a sample with one class or none gives that constant.

    The margin of a text is a mean of its windows' margins, weighted by a softmax that sharpens from step to step, so
    training starts with the average of the text and ends with the worst window. A text without words is no likelier
    to be toxic than the sample's share. A margin depends on an embedding only
    through the difference of the two outputs, so a step needs one number per bucket and not one vector per word.
    """
    if len(set(labels)) < 2:
        always = 20.0 if 1 in labels else -20.0
        return Model(np.zeros(s.buckets, np.float32), always, s, always)
    random = np.random.default_rng(s.seed)
    vocabulary: dict[str, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in _words(text)], dtype=np.int32) for text in texts]
    known = list(vocabulary)
    del vocabulary
    held, sizes = array("i"), []  # grows in place, so the buckets of all words are never there twice
    for spell in (lambda w: w, lambda w: misspelt(w, random)):
        for i in range(0, len(known), GROUP):
            own, each = subwords([spell(w) for w in known[i:i + GROUP]], s)
            held.frombytes(own.tobytes())
            sizes.append(each)
    buckets, counts = np.frombuffer(held, dtype=np.int32), np.concatenate(sizes or [np.zeros(0, np.int32)])
    heads = np.cumsum(counts) - counts
    n_known = len(known)
    del known, sizes
    y = np.array(labels, dtype=float)
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    table = np.zeros((s.buckets, s.dimensions), np.float32)
    out = random.standard_normal((s.dimensions, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen = np.full(s.buckets, 1e-8, np.float32)  # squared gradients so far, one per embedding
    usable = np.array([i for i, words in enumerate(docs) if len(words)])
    epochs = max(s.epochs, math.ceil(s.least_steps * s.batch / max(1, len(usable))))
    steps = epochs * math.ceil(len(usable) / s.batch)
    step = 0
    for _ in range(epochs):
        order = random.permutation(usable)
        for first in range(0, len(order), s.batch):
            chosen = order[first:first + s.batch]
            step += 1
            own = [docs[d] + n_known * (random.random(len(docs[d])) < s.misspelt) for d in chosen]
            spans = [x[windows(len(x), s)] for x in own]  # a row per window
            owners = np.repeat(np.arange(len(chosen)), [len(x) for x in spans])
            sizes = np.repeat([x.shape[1] for x in spans], [len(x) for x in spans])
            words, place = np.unique(np.concatenate([x.ravel() for x in spans]), return_inverse=True)
            lengths = counts[words]
            flat = buckets[np.repeat(heads[words] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())]
            apart = out[:, 1] - out[:, 0]
            of_word = np.add.reduceat((table @ apart)[flat], np.cumsum(lengths) - lengths) / lengths
            margin = np.add.reduceat(of_word[place], np.cumsum(sizes) - sizes) / sizes + bias[1] - bias[0]
            starts = np.flatnonzero(np.diff(owners, prepend=-1))
            sharp = s.sharpness * step / steps
            share = np.exp(sharp * (margin - np.maximum.reduceat(margin, starts)[owners]))
            share /= np.add.reduceat(share, starts)[owners]
            pooled = np.add.reduceat(share * margin, starts)
            wrong = (1 / (1 + np.exp(-np.clip(pooled, -30, 30))) - y[chosen]) * weight[chosen] / len(chosen)
            of_place = np.repeat(wrong[owners] * share / sizes, sizes)
            per_word = np.bincount(place, weights=of_place, minlength=len(words)) / lengths
            pulls = np.bincount(flat, weights=np.repeat(per_word, lengths), minlength=s.buckets)
            touched = np.flatnonzero(pulls)
            pull, rows = pulls[touched].astype(np.float32), table[touched]
            seen[touched] += pull * pull
            pace = s.rate / np.sqrt(seen[touched].mean() + seen[touched])
            turn = (pull @ rows).astype(np.float32)
            table[touched] = rows * (1 - s.decay) - (pace * pull)[:, None] * apart
            out -= s.out_rate * np.stack([-turn, turn], axis=1)
            bias -= s.out_rate * wrong.sum() * np.array([-1, 1], np.float32)
    offset, share = float(bias[1] - bias[0]), float(y.mean())
    return Model(table @ (out[:, 1] - out[:, 0]), offset, s, min(offset, math.log(share / (1 - share))))


def held_out(row_id: Column) -> Column:
    """Rows that no model is fitted on: one in five by the CRC-32 of the id's text."""
    return F.crc32(F.coalesce(row_id.cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, row_id: str = "doc_id", text: str = "text", label: str = "toxic", s: Settings = Settings()) -> Model:
    """Train on at most `rows_per_class` labelled texts per class, the first by a hash of the id, none held out.

    A document with differing labels, a NULL label or id, or a text over `longest_text` bytes is not sampled. A sample
    of one class gives a model that always says that class, an empty one a model that always says 0.
    """
    known = (labels.where(F.col(label).isin(0, 1) & F.col(row_id).isNotNull() & ~held_out(F.col(row_id))).groupBy(row_id)
             .agg(F.min(label).alias("_label"), F.max(label).alias("_other")).where("_label = _other").select(row_id, "_label"))
    usable = docs.where(F.octet_length(text) <= s.longest_text)
    there = known.join(usable.select(row_id).distinct(), row_id)
    first = [there.where(F.col("_label") == c).orderBy(F.xxhash64(row_id), row_id).limit(s.rows_per_class) for c in (0, 1)]
    chosen = first[0].unionByName(first[1])  # a bounded number of ids
    sample = usable.select(row_id, text).join(F.broadcast(chosen), row_id).groupBy(row_id, "_label").agg(F.min(text).alias("_text")).collect()
    sample.sort(key=lambda r: r[0])
    return train([r["_text"] for r in sample], [int(r["_label"]) for r in sample], s)


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`df` with score (0 to 1) and predicted (1 from 0.5 on) of every whole text; NULL counts as empty.

    Columns of `df` with these names are replaced. Equal texts get equal scores.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def compute(texts: list[bytes]) -> list[tuple]:
        return [(p, int(p >= 0.5)) for p in shared.value.scores(texts)]

    return replaced(df, per_batch("struct<score:double,predicted:int>", compute)(F.col(text)), ["score", "predicted"])
