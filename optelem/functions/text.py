"""Slugs, heading keys and link paths as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folds() -> tuple[str, str]:
    """Characters whose compatibility decomposition is one ASCII letter or digit plus marks, and that letter."""
    source, target = [], []
    for code in range(0x80, 0x110000):
        if 0xD800 <= code <= 0xDFFF:
            continue
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not 0x300 <= ord(c) <= 0x36F)
        if len(plain) == 1 and plain.isascii() and plain.isalnum():
            source.append(chr(code))
            target.append(plain)
    return "".join(source), "".join(target)


def _spelt_out() -> dict[str, str]:
    """Characters whose compatibility decomposition is several characters with ASCII letters or digits among them, as in a ligature; marks left out."""
    found = {}
    for code in range(0x80, 0x110000):
        if not 0xD800 <= code <= 0xDFFF:
            plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not 0x300 <= ord(c) <= 0x36F)
            if len(plain) > 1 and any(c.isascii() and c.isalnum() for c in plain):
                found[chr(code)] = plain
    return found


FOLD_FROM, FOLD_TO = _folds()
SPELT_OUT = _spelt_out()
_SPELT_CLASS = "[" + "".join(SPELT_OUT) + "]"


def _spell_out(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in SPELT_OUT.items() for x in pair])
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(_SPELT_CLASS), 0))
    return F.when(c.rlike(_SPELT_CLASS), F.aggregate(found, c, lambda text, x: F.replace(text, x, F.element_at(table, x)))).otherwise(c)


def fold_accents(c: Column) -> Column:
    """Accents off, ligatures and signs spelt out; combining marks that stand alone are dropped too."""
    return F.regexp_replace(F.translate(_spell_out(c), FOLD_FROM, FOLD_TO), "[\\u0300-\\u036f]", "")


def hyphenate(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def slug(title: Column, default: str = "chapter") -> Column:
    bare = hyphenate(F.lower(F.trim(F.regexp_replace(title, r"^##\s+", ""))))
    return F.when(bare == "", F.lit(default)).otherwise(bare)


def anchor_key(text: Column) -> Column:
    """Stable key of a heading or fragment: escapes, accents, entities, tags and punctuation removed."""
    plain = fold_accents(F.coalesce(F.try_url_decode(F.regexp_replace(text, r"\+", "%2B")), text))
    plain = F.regexp_replace(plain, "(?i)&(amp|lt|gt|quot|#39);", " ")  # fixed values: the entities that keys leave out
    plain = F.regexp_replace(plain, "<[^>]*>", " ")
    return hyphenate(F.lower(plain))


def normal_path(path: Column) -> Column:
    """Path with `.` and `..` resolved, no empty segments, no trailing slash; the root is ''."""
    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part == "..", up).when((part == ".") | (part == ""), done).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def route_key(path: Column) -> Column:
    """One key for the spellings of a page: a/, a, a.html, a/index.html."""
    return F.regexp_replace(F.regexp_replace(normal_path(path), r"(^|/)index\.html$", ""), r"\.html$", "")


# fixed values: the entities that attribute values are written with
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#34;": '"', "&#39;": "'", "&#x27;": "'", "&apos;": "'", "&#38;": "&", "&amp;": "&"}


def plain_entities(c: Column) -> Column:
    for entity, plain in ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(plain))
    return c


def markup(html: str) -> Column:
    """Page source without comments and without the bodies of scripts and styles."""
    bare = F.regexp_replace(html, "(?s)<!--.*?-->", "")
    return F.regexp_replace(bare, r"(?is)(<(?:script|style)\b[^>]*>).*?</(?:script|style)\s*>", "$1")
