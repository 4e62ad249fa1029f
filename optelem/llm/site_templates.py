"""Main text of web pages: page furniture goes by its element, role or name, and what a site repeats goes as its template.

Every element subtree of a page's article is hashed. Spark counts per host on how many different pages a subtree
stands; subtrees that recur on half of the pages of a host, and on ten at least, are the site's template and are deleted
before the text is put together. Copies of a page are one page to the counts, and a passage that some articles of a site
share stays far below half, so neither takes an article's text away.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from optelem.llm.html_tree import Page
from optelem.llm.texts import add_columns
from optelem.plans.lookups import settle, settled_lookup

MIN_PAGES = 10
MIN_SHARE = 0.5
MAX_HOSTS = 100_000  # hosts with a template that are broadcast; more of them join by shuffle


def host(url: Column) -> Column:
    """Host of an absolute url in lower case, without user and port; NULL for any other url."""
    found = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^:/?#]+)", 1)
    return F.lower(F.nullif(found, F.lit("")))


def _page(html: bytes | None) -> Page:
    return Page((html or b"").decode("utf-8", "replace"))


def subtree_hashes(html: bytes | None) -> list[int]:
    """A hash of the whole article, then one for each different subtree of it that has text; none without text."""
    page = _page(html)
    hashes = page.hashes()
    whole = [hashes[e] for e in page.containers if hashes[e]]
    if not whole:
        return []
    inner = {hashes[e]: None for e in page.within(page.containers) if hashes[e]}
    digest = whole[0] if len(whole) == 1 else hash(tuple(whole))  # of integers, so alike in every process
    return [digest, *inner]


def main_text(html: bytes | None, template: list[int] | None = None) -> str:
    """The blocks of the article, a line each, without subtrees whose hash is in `template`, unless nothing would remain."""
    page = _page(html)
    if template:
        known = set(template)
        hashes = page.hashes()
        kept = "\n".join(page.blocks(page.containers, {e for e in page.within(page.containers) if hashes[e] in known}))
        if kept:
            return kept
    return "\n".join(page.blocks(page.containers))


@arrow_udf(T.ArrayType(T.LongType()))
def _subtrees(html: pa.Array) -> pa.Array:
    return pa.array([subtree_hashes(h) for h in html.to_pylist()], pa.list_(pa.int64()))


@arrow_udf(T.StringType())
def _text(html: pa.Array, template: pa.Array) -> pa.Array:
    return pa.array([main_text(h, t) for h, t in zip(html.to_pylist(), template.to_pylist())], pa.string())


_text_once = _text.asNondeterministic()  # it is not; a filter on the text must not compute it twice


def site_templates(pages: DataFrame, url: str = "url", html: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """host, template (array of subtree hashes), hosts with one only.

    As each of them stands on a share of the host's pages, a host has at most 1 / min_share times as many as a page of it
    has elements on average, whatever the number of its pages. The counts are combined before they are shuffled.
    """
    if not 0 < min_share <= 1:
        raise ValueError("min_share is above 0 and at most 1")
    read = pages.select(host(F.col(f"`{url}`")).alias("host"), F.col(f"`{html}`").cast("binary").alias("_html")).where("host IS NOT NULL")
    seen = read.select("host", _subtrees.asNondeterministic()("_html").alias("_all")).where("size(_all) > 0")
    different = settle(seen.groupBy("host", F.element_at("_all", 1).alias("_digest")).agg(F.any_value("_all").alias("_all")))
    sizes = different.groupBy("host").agg(F.count(F.lit(1)).alias("_pages")).where(F.col("_pages") >= min_pages)
    counts = different.select("host", F.explode(F.slice("_all", 2, F.size("_all"))).alias("_hash")).groupBy("host", "_hash").agg(F.count(F.lit(1)).alias("_n"))
    often = settle(counts.where(F.col("_n") >= min_pages)).join(settled_lookup(sizes), "host").where(F.col("_n") >= min_share * F.col("_pages"))
    return often.groupBy("host").agg(F.sort_array(F.collect_list("_hash")).alias("template"))


def extract(pages: DataFrame, url: str = "url", html: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """`pages` with `text`, the main text, and `n_chars`, its code points; columns of these names are replaced.

    The article is what the page marks as such (article, main, articleBody), else the whole page. Menus, headers, footers,
    sidebars, notices, adverts, forms, scripts, styles, hidden elements and comments are left out, then the site's
    template. A heading in the article's own header stays. Character references are decoded, white space in a block (a
    line break element too) becomes one blank, blocks are trimmed and joined by line feeds. NULL and empty pages have
    the empty text. Pages of any length are read whole. A page without a host belongs to no site. Rows that repeat a
    page give the same text each and count once. A page that is all template keeps its text.
    """
    templates = settled_lookup(site_templates(pages, url, html, min_pages, min_share).withColumnsRenamed({"host": "_host", "template": "_template"}), MAX_HOSTS)
    packed = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("_row"), host(F.col(f"`{url}`")).alias("_key"))
    joined = packed.join(templates, F.col("_key") == F.col("_host"), "left")
    found = joined.select("_row", _text_once(F.col(f"_row.`{html}`").cast("binary"), F.coalesce("_template", F.array().cast("array<long>"))).alias("_text"))
    out = found.select("_row.*", F.col("_text"))
    return add_columns(out, {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}).drop("_text")
