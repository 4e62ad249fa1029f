"""Registered queries and oracles: document and page jobs."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from optelem.fixtures import query, table, with_views
from optelem.operators import docs

# one Markdown document per conversation turn, with an introduction, a repeated chapter title and an appendix
BOOKS = """SELECT conv_id * 1000 + turn AS doc_id, concat('Preface by ', role, chr(10), chr(10), '## Chapter ', CAST(turn + 1 AS STRING), ': ', role, chr(10), chr(10), text, chr(10), chr(10),
 '## Appendix B: Notes', chr(10), chr(10), 'see above', chr(10), chr(10), '## Chapter ', CAST(turn + 1 AS STRING), ': ', role, chr(10), chr(10), 'again', chr(10)) AS text FROM conversations"""
PAPERS = """SELECT conv_id * 1000 + turn AS doc_id, concat('# Paper', chr(10), chr(10), '## ', CAST(turn + 1 AS STRING), '. The ', role, chr(10), chr(10), text, chr(10), '## Annex', chr(10)) AS text FROM conversations"""
NOTES = """SELECT concat('note-', CAST(doc_id AS STRING)) AS id, date_add(DATE '2025-01-01', CAST(doc_id % 40 AS INT)) AS published_at, concat('Note ', CAST(doc_id % 13 AS STRING)) AS note, doc_id % 9 = 0 AS draft FROM documents"""
REDIRECTS = ("^/th[a-z]*$",)


def _sections(spark, d):
    return docs.split_sections(query(spark, d, BOOKS))


def _headings(spark, d):
    return docs.heading_index(docs.unique_slugs(_sections(spark, d)))


def _links(spark, d):
    return query(spark, d, """SELECT conv_id * 1000 + turn AS doc_id, concat(CASE turn % 3 WHEN 0 THEN '#chapter-' WHEN 1 THEN 'MANUAL.md#appendix-b-' ELSE 'docs/guide.md#' END, CASE turn % 3 WHEN 0 THEN concat(CAST(turn + 1 AS STRING), '--', role) ELSE 'notes' END) AS href FROM conversations""")


RULES = docs.LinkRules(book={"manual.md": "/book/"}, owners=((r"^docs/", "https://code.example.com/docs-owner"), (r".", "https://code.example.com/site")))

QUERIES = {
    "split_sections": _sections,
    "numbered_sections": lambda s, d: docs.numbered_sections(query(s, d, PAPERS)),
    "unique_slugs": lambda s, d: docs.unique_slugs(_sections(s, d)).select("doc_id", "idx", "slug"),
    "heading_index": _headings,
    "resolve_links": lambda s, d: docs.resolve_links(_links(s, d), docs.heading_targets(_headings(s, d)), RULES),
    "ordered_notes": lambda s, d: docs.ordered_notes(query(s, d, NOTES)),
    "page_counts": lambda s, d: docs.page_counts(table(s, d, "pages")),
    "page_audit": lambda s, d: docs.page_audit(table(s, d, "pages")),
    "page_tree_checks": lambda s, d: docs.page_tree_checks(query(s, d, FORMS), NAMELESS),
    "link_audit": lambda s, d: docs.link_audit(table(s, d, "pages"), REDIRECTS),
}

MARKUP = r"regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)(<(?:script|style)\b[^>]*>).*?</(?:script|style)\s*>', '\1', 'g')"
TRIMMED = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
SECTIONS = rf"""base AS (SELECT conv_id * 1000 + turn AS doc_id, turn, role, {TRIMMED} AS text, concat('Chapter ', CAST(turn + 1 AS STRING), ': ', role) AS chapter, lpad(CAST(turn + 1 AS STRING), CAST(greatest(2, length(CAST(turn + 1 AS STRING))) AS INTEGER), '0') AS no FROM conversations),
 sections AS (SELECT doc_id, 0 AS idx, 'Cover' AS title, 'Front Matter' AS grp, '' AS num, 'Cover' AS short_title, '' AS body FROM base
 UNION ALL SELECT doc_id, 1, 'Introduction', 'Front Matter', '01', 'Introduction', concat('Preface by ', role) FROM base
 UNION ALL SELECT doc_id, 2, chapter, 'Chapters', no, role, concat('## ', chapter, chr(10), chr(10), regexp_replace(text, '\s+$', '')) FROM (SELECT * REPLACE (raw AS text) FROM base JOIN (SELECT conv_id * 1000 + turn AS doc_id, text AS raw FROM conversations) c USING (doc_id)) b
 UNION ALL SELECT doc_id, 3, 'Appendix B: Notes', 'Appendices', 'B', 'Notes', concat('## Appendix B: Notes', chr(10), chr(10), 'see above') FROM base
 UNION ALL SELECT doc_id, 4, chapter, 'Chapters', no, role, concat('## ', chapter, chr(10), chr(10), 'again') FROM base)"""
SLUGS = """slugs AS (SELECT doc_id, idx, title, CASE WHEN nth = 1 THEN s ELSE s || '-' || nth END AS slug FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, s ORDER BY idx) AS nth FROM
  (SELECT *, trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM sections) a) b)"""
HEADS = """heads AS (SELECT doc_id, idx, 0 AS pos, 2 AS depth, title AS text, trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') AS key, slug FROM slugs WHERE idx >= 2)"""

# every page of the table with fields, buttons, references and links in place of some of its tags
FORMS = """SELECT page_id, replace(replace(replace(replace(html, '<p>', concat('<p id="p', CAST(page_id % 3 AS STRING), '" aria-controls="p1 q">')), '<b>', '<button>'), '</b>', '</button>'),
 '<div class="ad">', '<label for="p2"><input name=""><input id=free><select name=s></select><a target=_blank rel=noopener href="/x?a=1&amp;b=2"><i title="<button> id=z"></i></button><button aria-label=" &amp;"></button><button> </button><button>')  AS html FROM pages"""
NAMELESS = ("free",)


def _linear(pattern: str) -> str:
    """A pattern without possessive marks, as a SQL literal."""
    return "'" + re.sub(r"([*+?])\+", r"\1", pattern).replace("'", "''") + "'"


def _tree_sql(source: str, nameless: tuple[str, ...] = ()) -> str:
    free = "".join(f" AND coalesce(id, '') <> '{n}'" for n in nameless)
    return rf"""tok AS (SELECT page_id, regexp_extract_all(html, {_linear(docs.PAGE_TOKEN)}) AS toks FROM (SELECT page_id, {MARKUP} AS html FROM ({source}) src) m),
      tt AS (SELECT page_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i FROM tok),
      tk AS (SELECT *, CASE WHEN regexp_matches(tok, '^<[a-zA-Z]') THEN 'open' WHEN tok LIKE '</%' THEN 'close' WHEN regexp_matches(tok, '^<[!?]') OR regexp_matches(tok, {_linear(docs.BLANK_TEXT)}) THEN 'none' ELSE 'text' END AS kind,
        lower(regexp_extract(tok, '^</?([a-zA-Z][^\s/>]*)', 1)) AS tag FROM tt),
      aa AS (SELECT page_id, i, unnest(al) AS a, generate_subscripts(al, 1) AS o FROM (SELECT page_id, i, regexp_extract_all(regexp_replace(tok, '^<[^\s/>]*', ''), {_linear(docs.TAG_ATTRIBUTE)}) AS al FROM tk WHERE kind = 'open') x),
      av AS (SELECT page_id, i, o, lower(regexp_extract(a, '^[^\s=]*')) AS name, replace(regexp_replace(regexp_replace(a, '^[^=]*=?\s*', ''), '(?s)^"(.*)"$|^''(.*)''$', '\1\2'), '&amp;', '&') AS v FROM aa),
      att AS (SELECT * FROM av QUALIFY row_number() OVER (PARTITION BY page_id, i, name ORDER BY o) = 1),
      tg AS (SELECT tk.page_id, tk.i, tk.tag, {", ".join(f"max(CASE WHEN name = '{n}' THEN v END) AS {n}" for n in ("id", "target", "rel", "type", "name", "disabled"))}, max(CASE WHEN name = 'aria-label' THEN v END) AS label
        FROM tk LEFT JOIN att ON att.page_id = tk.page_id AND att.i = tk.i WHERE kind = 'open' GROUP BY ALL),
      ids AS (SELECT DISTINCT page_id, id FROM tg WHERE id <> ''),
      wanted AS (SELECT page_id, unnest(regexp_split_to_array(v, '\s+')) AS w FROM att WHERE name IN {docs.REFERENCES}),
      folded AS (SELECT page_id, list_reduce(list({{'k': kind, 's': [trim(coalesce(label, '')) <> ''], 'n': 0}} ORDER BY i), lambda st, t: {{'k': '', 's': CASE WHEN t.k = 'text' THEN list_transform(st.s, lambda x: true) WHEN t.k = 'open' THEN list_concat(t.s, st.s)
          WHEN t.k = 'close' THEN st.s[2:] ELSE st.s END, 'n': st.n + CASE WHEN t.k = 'close' AND len(st.s) > 0 AND NOT st.s[1] THEN 1 ELSE 0 END}}, {{'k': '', 's': []::BOOLEAN[], 'n': 0}}) AS st
        FROM (SELECT tk.*, label FROM tk LEFT JOIN tg ON tg.page_id = tk.page_id AND tg.i = tk.i WHERE kind = 'text' OR tk.tag = 'button') r GROUP BY page_id),
      tree AS (SELECT page_id, 'duplicate_id' AS "check", count(*) - count(DISTINCT id) AS n FROM tg WHERE id <> '' GROUP BY page_id
        UNION ALL SELECT page_id, 'dangling_reference', count(*) FROM wanted ANTI JOIN ids ON ids.page_id = wanted.page_id AND ids.id = w WHERE w <> '' GROUP BY page_id
        UNION ALL SELECT page_id, 'label_without_control', count(*) FROM att ANTI JOIN ids ON ids.page_id = att.page_id AND ids.id = v WHERE name = 'for' AND v <> '' AND EXISTS (SELECT 1 FROM tg WHERE tg.page_id = att.page_id AND tg.i = att.i AND tag = 'label') GROUP BY page_id
        UNION ALL SELECT page_id, 'unsafe_blank_link', count(*) FROM tg WHERE tag = 'a' AND target = '_blank' AND NOT (list_has_all(regexp_split_to_array(coalesce(rel, ''), '\s+'), ['noopener', 'noreferrer'])) GROUP BY page_id
        UNION ALL SELECT page_id, 'control_without_name', count(*) FROM tg WHERE tag IN {docs.CONTROLS} AND coalesce(type, '') <> 'hidden' AND disabled IS NULL AND coalesce(name, '') = ''{free} GROUP BY page_id
        UNION ALL SELECT page_id, 'unnamed_button', st.n + len(list_filter(st.s, lambda x: NOT x)) FROM folded)"""


ORACLES = {
    "page_tree_checks": f"""WITH {_tree_sql(FORMS, NAMELESS)} SELECT page_id, "check", CAST(n AS INTEGER) AS n FROM tree WHERE n > 0""",
    "split_sections": f"WITH {SECTIONS} SELECT * FROM sections",
    "numbered_sections": rf"""WITH c AS (SELECT conv_id * 1000 + turn AS doc_id, turn + 1 AS n, role, text FROM conversations)
      SELECT doc_id, 0 AS idx, 'Overview' AS title, '' AS num, 'Overview' AS label, 'section-overview' AS anchor, '# Paper' AS body FROM c
      UNION ALL SELECT doc_id, 1, n || '. The ' || role, CAST(n AS STRING), 'The ' || role, 'section-' || n || '-the-' || role, regexp_replace('## ' || n || '. The ' || role || chr(10) || chr(10) || text, '\s+$', '') FROM c
      UNION ALL SELECT doc_id, 2, 'Annex', '', 'Annex', 'section-annex', '## Annex' FROM c""",
    "unique_slugs": f"WITH {SECTIONS}, {SLUGS} SELECT doc_id, idx, slug FROM slugs",
    "heading_index": f"WITH {SECTIONS}, {SLUGS}, {HEADS} SELECT doc_id, idx, pos, depth, text, key, key AS id, '/book/' || slug || '/#' || key AS target FROM heads",
    "resolve_links": """SELECT conv_id * 1000 + turn AS doc_id, CASE turn % 3 WHEN 0 THEN '#chapter-' || (turn + 1) || '--' || role WHEN 1 THEN 'MANUAL.md#appendix-b-notes' ELSE 'docs/guide.md#notes' END AS href,
      CASE turn % 3 WHEN 0 THEN '/book/chapter-' || (turn + 1) || '-' || role || '/#chapter-' || (turn + 1) || '-' || role WHEN 1 THEN '/book/appendix-b-notes/#appendix-b-notes' ELSE 'https://code.example.com/docs-owner/docs/guide.md#notes' END AS new_href,
      CASE turn % 3 WHEN 0 THEN 'heading' WHEN 1 THEN 'document' ELSE 'repository' END AS how FROM conversations""",
    "ordered_notes": """WITH n AS (SELECT concat('note-', CAST(doc_id AS STRING)) AS id, CAST(DATE '2025-01-01' + CAST(doc_id % 40 AS INTEGER) AS DATE) AS published_at, concat('Note ', CAST(doc_id % 13 AS STRING)) AS note, doc_id % 13 AS no, doc_id % 9 = 0 AS draft FROM documents),
      r AS (SELECT *, row_number() OVER (ORDER BY published_at DESC, no DESC, id DESC) AS rank FROM n WHERE NOT draft)
      SELECT id, published_at, note, draft, rank, lag(id) OVER (ORDER BY rank) AS prev_id, lead(id) OVER (ORDER BY rank) AS next_id, CAST(round(rank / CAST((SELECT count(*) FROM r) AS DOUBLE) * 100) AS INTEGER) AS progress_pct FROM r""",
    "page_counts": """SELECT page_id, "check", n, n = 1 AS ok FROM (""" + " UNION ALL ".join(
        f"""SELECT page_id, '{name}' AS "check", CAST(len(regexp_extract_all(html, '{p.replace("'", "''")}')) AS INTEGER) AS n FROM (SELECT page_id, {MARKUP} AS html FROM pages) m""" for name, p in docs.PAGE_COUNTS.items()) + ") x",
    "link_audit": r"""WITH p AS (SELECT page_id, lower(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)) AS origin, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, """ + MARKUP + r""" AS html FROM pages),
      l AS (SELECT DISTINCT page_id, origin, unnest(regexp_extract_all(html, '(?i)\s(?:href|src)\s*=\s*["'']([^"'']*)["'']', 1)) AS link FROM p),
      r AS (SELECT DISTINCT origin, trim(regexp_replace(path, '\.html$', ''), '/') AS key FROM p)
      SELECT page_id, link, 'missing_page' AS problem FROM l WHERE link LIKE '/%' AND NOT link LIKE '//%' AND NOT EXISTS (SELECT 1 FROM r WHERE r.origin = l.origin AND r.key = trim(regexp_replace(regexp_replace(link, '[?#].*$', ''), '\.html$', ''), '/'))
      AND NOT regexp_matches('/' || trim(regexp_replace(link, '[?#].*$', ''), '/'), '^/th[a-z]*$')""",
}
ORACLES["page_audit"] = f"""WITH {_tree_sql("SELECT page_id, html FROM pages")} SELECT page_id, "check", n FROM ({ORACLES["page_counts"]}) c WHERE NOT ok UNION ALL SELECT page_id, "check", CAST(n AS INTEGER) FROM tree WHERE n > 0"""
ORACLES = {k: with_views(v) for k, v in ORACLES.items()}
