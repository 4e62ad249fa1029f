"""Line-first quality rules.

Every line with a word is judged alone, by punctuation, navigation, symbols, shouting and boilerplate; failed lines
go, and a document that loses too many of its words, or fails the base limits on length and repetition, is rejected.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from optelem.llm.texts import per_text, replaced

SYMBOLS = b"#*$%&|<>"
SENTENCE_END = "[.!?…。！？][\"'”’»)\\]]*(?:\\s|$)"
SEPARATORS = ("|", "»", "›", "•", "·", "/", ">", ">>", "->", "::")
# Wordings of boilerplate, each with a lower-case part that a text must hold before the regex is tried.
BOILERPLATE = (
    ("rights reserved", r"\ball rights reserved\b"),
    ("cookie", r"\b(?:accept|used?|uses|enable) (?:all )?cookies\b|\bcookie (?:policy|settings|notice)\b"),
    ("privacy", r"\bprivacy policy\b"),
    ("terms", r"\bterms (?:of (?:use|service)|and conditions)\b"),
    ("javascript", r"\benable javascript\b"),
    ("lorem", r"\blorem ipsum\b"),
    ("powered by", r"\bpowered by\b"),
    ("click here", r"\bclick here\b"),
    ("account", r"\b(?:sign|log) ?(?:in|up)\b.{0,40}\baccount\b"),
    ("subscribe", r"\bsubscribe (?:to|now)\b"),
    ("share", r"^\s*share (?:this|on)\b"),
    ("skip to", r"\bskip to (?:main )?content\b"),
    ("copyright", r"^\s*copyright (?:\(c\) |© ?)?\d{4}"),
    ("©", r"^\s*© ?\d{4}"),
    ("page ", r"\bpage \d+ of \d+\b"),
    (";", r"^[^.]*[{};]\s*$"),
    ("}", r"^[^.]*[{}]\s*$"),
    ("{", r"^[^.]*[{}]\s*$"),
)
_separators = tuple(s.encode() for s in SEPARATORS)
_sentence_end = re.compile(SENTENCE_END, re.ASCII).search
_boilerplate = tuple((hint, re.compile(regex, re.ASCII | re.IGNORECASE).search) for hint, regex in BOILERPLATE)


@dataclass(frozen=True)
class Limits:
    """Limits of the line rules and of the verdict; shares are of words."""

    separators: int = 3  # a navigation line has so many separators standing alone ...
    separator_share: float = 0.125  # ... and they are such a share of its words
    symbol_share: float = 0.5  # symbols per word
    shout_words: int = 4  # lines of capitals count as shouting from so many words on
    lost_share: float = 0.4  # a document that loses more words is rejected


def line_failure(line: str, words: list[bytes], boilerplate: list, limits: Limits = Limits()) -> str | None:
    """The first rule that a line with words breaks; `boilerplate` are the searches that its text may meet."""
    n = len(words)
    separators = sum(map(words.count, _separators)) if n >= limits.separators else 0
    if separators >= limits.separators and separators >= limits.separator_share * n:
        return "navigation"
    if sum(map(line.count, "#*$%&|<>")) > limits.symbol_share * n:
        return "symbols"
    if any(search(line) for search in boilerplate):
        return "boilerplate"
    if n >= limits.shout_words and line.isupper():
        return "shouting"
    return None if _sentence_end(line) else "punctuation"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    first: dict[tuple, int] = {}
    covered = bytearray(len(words))
    for i, window in enumerate(windows):
        j = first.setdefault(window, i)
        if j != i:
            covered[i:i + 3] = covered[j:j + 3] = b"\1\1\1"
    return sum(covered)


def judge(data: bytes, limits: Limits = Limits()) -> tuple:
    """Figures, verdict and cleaned text of one document."""
    words = data.split()  # bytes split at ASCII white space only
    n = len(words)
    lines = data.split(b"\n")
    full = [line for line in lines if line.strip()]
    repeats = repeated_words(words)
    base_failed = n < 50 or 100 * repeats > 50 * n
    kept, lost, failures = [], 0, {}
    lower = data.decode("utf-8", "replace").lower()
    boilerplate = [search for hint, search in _boilerplate if hint in lower]
    for line in lines:
        own = line.split()
        failure = line_failure(line.strip().decode("utf-8", "replace"), own, boilerplate, limits) if own else None
        if failure:
            lost += len(own)
            failures[failure] = failures.get(failure, 0) + 1
        else:
            kept.append(line)
    worst = max(sorted(failures), key=failures.get, default=None)
    return (n, len(b"".join(words).decode("utf-8", "replace")), len(data) - len(data.translate(None, SYMBOLS)), len(full) - len(set(full)), repeats,
            base_failed, not base_failed and lost <= limits.lost_share * n, lost, worst, b"\n".join(kept).decode("utf-8", "replace"))


FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words", "worst_rule", "clean_text"]
_DDL = ("struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long,"
        "base_failed:boolean,kept:boolean,lost_words:long,worst_rule:string,clean_text:string>")


def apply_rules(df: DataFrame, text: str | Column = "text", limits: Limits = Limits()) -> DataFrame:
    """`df` with the figures of every whole text, `kept`, the words in failed lines, the most frequent failure and the text without them.

    NULL and empty texts have no words, fail the base limits and get an empty clean text. Columns of `df` with the
    names of the results are replaced. Each row is judged alone, so repeated rows get equal verdicts.
    """
    text = F.col(text) if isinstance(text, str) else text
    return replaced(df, per_text(_DDL, lambda data: judge(data, limits))(text), FIGURES)
