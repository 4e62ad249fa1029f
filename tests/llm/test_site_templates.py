"""Main text of pages: the reader on odd markup, and site templates against a plain count."""

import html as escapes
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from optelem.llm import site_templates
from optelem.llm.html_tree import Page
from optelem.llm.site_templates import extract, host, main_text, subtree_hashes
from tests.conftest import rows

PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize(("html", "text"), [
    ("", ""), (None, ""), ("plain &amp; simple", "plain & simple"), ("a < b <p>c", "a < b\nc"), ("&am &ampx &#228;&nbsp;&bogus; &lt;p&gt;", "&am &x ä &bogus; <p>"),
    ("<p title='x>y'>q</p><a href=\"1>2\">z</a>", "q\nz"), ("<p>one\n\t two<br>three<b>fo</b>ur", "one two threefour"),
    ("<p>t<script>if (a</p>b)</script>u</p><style>x", "tu"), ("<p>a<!-- <p>no</p> -->b<!-->c", "abc"), ("<p>unclosed <a href='x", "unclosed"),
    ("<head><title>t</title><body><p>b", "b"), ("<head><title>t</title><p>b", "b"), ("<ul><li>a<li>b<ul><li>c</ul></ul>d", "a\nb\nc\nd"),
    ("<table><tr><td>a<td>b<tr><th>c</table>", "a\nb\nc"), ("<dl><dt>a<dd>b<dt>c</dl>", "a\nb\nc"), ("</p></div>x</body>y</html>z", "xyz"),
    ("<nav>m</nav><header>h</header><article><h1>T</h1>x</article><aside>s</aside><footer>f</footer>", "T\nx"),
    ("<article><header><h1>T</h1><p>by</p><div><h2>S</h2><nav>n</nav></div></header>x<footer>f</footer></article>", "T\nS\nx"),
    ("<article>x<article>reply</article>y</article>", "x\ny"), ("<article>teaser</article><article><h1>t</h1>z</article>", "t\nz"),
    ("<main><p>a</p><div class='share-box'>s</div></main>rest", "a"), ("<div itemprop=articleBody>a</div>b", "a"), ("<div role=main>a</div>b", "a"),
    ("<form><main>a<form>inner</form></main></form>b", "a"), ("<form><p>all</p></form>", "all"), ("<div class=popup><article>a</article></div>", "a"),
    ("<div class='ad'>x</div><div class='post has-sidebar'>a</div><div id='comments'>c</div><div class=cookieNotice>k</div>", "a"),
    ("<article class='post with-comments'>a</article>", "a"), ("<article>a</article><section class=comments><article>b</article></section>", "a"),
    ("<p hidden>h</p><p style='display: none'>i</p><p aria-hidden=true>j</p><div role=navigation>k</div>a", "a"),
    ("<article><p>a<button>x</button><select><option>o</select><textarea>t</p></textarea>b</article>", "ab"), ("<h1>a<h2>b</h1>c", "a\nb\nc"),
    ("<ARTICLE><P>É</ARTICLE>", "É"), ("<svg><text>x</text></svg>a", "a"), ("<p>a\x00b</p>", "a\x00b"), ("<>a</ b><3", "<>a<3"), ("<p>a<select><optgroup><option>x</select>b", "ab")])
def test_text_of_odd_pages(html, text):
    assert main_text(None if html is None else html.encode()) == text


def test_deep_and_long_pages_are_read_whole():
    deep = "<div>" * 20_000 + "x" + "</div>" * 20_000 + "y"
    assert main_text(deep.encode()) == "x\ny"
    lines = [f"w{i} é &" for i in range(50_000)]
    assert main_text("".join(f"<p>{escapes.escape(x)}" for x in lines).encode()) == "\n".join(lines)
    assert main_text(b"<div " + b"a='" * 30_000) == ""


def test_hash_is_of_name_class_text_and_order():
    def top(html):
        return subtree_hashes(html.encode())[0]

    base = top("<p class=a>x <b>y</b>")
    assert base == top("<p  CLASS='a'>x\n<b>y</b><script>1</script></p>") and len({base, top("<p class=b>x <b>y</b>"), top("<p class=a><b>y</b>x"), top("<p class=a>x y")}) == 4
    assert subtree_hashes(b"<script>x</script> ") == [] and subtree_hashes(None) == []


def pages_of(seed):
    """Hosts with boxes on all, many or few of their pages, copied pages and paragraphs that some pages share."""
    random = np.random.default_rng(seed)
    out = []
    for h, n in (("a.example", 40), ("B.example:80", 25), ("small.example", 6), ("copies.example", 30), (None, 20)):
        for i in range(n):
            words = [f"{h}w{x}" for x in random.integers(0, 1000, 30)]
            boxes = ["<div class=q>Always <b>here</b></div>"] + ["<p>half the time</p>"] * int(i % 10 < 6) + ["<p>seldom</p>"] * int(i % 10 < 3)
            body = f"<h1>{words[0]}</h1><p>{' '.join(words)}</p>" + "".join(boxes) + ("<p>shared passage</p>" if random.random() < 0.2 else "")
            if h == "copies.example":
                body = f"<h1>same</h1><p>same text {i % 5}</p>"
            out.append((f"https://u@{h}/p{i}?x" if h else None, f"<body><nav>m{i}</nav><article>{body}</article>"))
    return [(i, *page) for i, page in enumerate(out)]


def brute(pages, min_pages, min_share):
    """Blocks of these flat pages; a line that stands on enough different articles of its host goes."""
    articles = {i: [" ".join(re.sub("<[^>]*>", "", b).split()) for b in re.split("</?(?:p|h1|div)[^>]*>", re.search("<article>(.*)</article>", h)[1])] for i, _, h in pages}
    by_host = defaultdict(set)
    for i, url, h in pages:
        if url:
            by_host[url.split("@")[1].split("/")[0].split(":")[0].lower()].add(tuple(articles[i]))
    out = []
    for i, url, _ in pages:
        site = by_host[url.split("@")[1].split("/")[0].split(":")[0].lower()] if url else set()

        def stays(line):
            n = sum(line in a for a in site)
            return not (n >= min_pages and n >= min_share * len(site))

        lines = [x for x in articles[i] if x]
        text = "\n".join(x for x in lines if stays(x)) or "\n".join(lines)
        out.append((i, url, text, len(text)))
    return out


@pytest.mark.parametrize(("min_pages", "min_share"), [(10, 0.5), (2, 0.25), (10, 1.0), (1, 0.01)])
def test_templates_equal_a_plain_count(spark, min_pages, min_share):
    pages = pages_of(4)
    expected = brute(pages, min_pages, min_share)
    df = spark.createDataFrame(pages, PAGES).repartition(7)
    found = extract(df, min_pages=min_pages, min_share=min_share)
    assert sorted(tuple(r) for r in found.select("page_id", "url", "text", "n_chars").collect()) == sorted(expected, key=lambda r: r[0])
    if (min_pages, min_share) == (10, 0.5):
        text = {i: t for i, _, t, _ in expected}
        assert "Always" not in text[0] and "half" not in text[0] and "seldom" in text[0] and "Always" in text[66] and text[75].startswith("same\n") and "Always" in text[110]


def test_templates_join_by_shuffle_too(spark, monkeypatch):
    monkeypatch.setattr(site_templates, "MAX_HOSTS", 0)
    pages = pages_of(5)
    found = extract(spark.createDataFrame(pages, PAGES))
    assert rows(found, "page_id", "url", "text", "n_chars") == sorted(brute(pages, 10, 0.5), key=repr)


def test_unmarked_pages_lose_their_template(spark):
    pages = [(i, f"http://x/{i}", f"<div class=z1><a>Home</a> <a>News</a></div><div class=z2><p>Story {i} begins.</p><p>Ends {i}.</p></div><div class=z3>Imprint</div>") for i in range(12)]
    assert rows(extract(spark.createDataFrame(pages, PAGES)), "page_id", "text") == sorted(((i, f"Story {i} begins.\nEnds {i}.") for i in range(12)), key=repr)


def test_odd_rows_and_names(spark):
    data = [(1, None, None), (1, "http://h/", ""), (None, "no url", "<p>a</p>"), (2, "http://h/", "<p>a</p>"), (2, "http://h/", "<p>a</p>")]
    df = spark.createDataFrame(data, PAGES).withColumns({"TEXT": F.lit(1), "host": F.lit("x"), "_row": F.lit("y"), "template": F.lit(2)})
    found = extract(df)
    assert found.columns == ["page_id", "url", "html", "host", "_row", "template", "text", "n_chars"]
    assert rows(found, "page_id", "text", "n_chars", "host") == sorted([(1, "", 0, "x"), (1, "", 0, "x"), (None, "a", 1, "x"), (2, "a", 1, "x"), (2, "a", 1, "x")], key=repr)
    assert extract(spark.createDataFrame([], PAGES)).count() == 0


def test_hosts(spark):
    urls = ["http://A.b:80/x", "https://u:p@c.d?q", "//e.f/", "mailto:x@y", "ftp://[::1]:21/", "http:///p", None, "HTTP://é.x#t"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(host(F.col("u"))).collect()] == ["a.b", "c.d", None, None, "[::1]", None, None, "é.x"]


def test_containers():
    page = Page("<form><div><article><p>x</article></div></form><article class='related-post'><h1>no</h1></article>")
    assert [page.tags[e] for e in page.containers] == ["article"] and list(page.blocks(page.containers)) == ["x"]
