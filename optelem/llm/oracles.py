"""DuckDB statements for the rows of those queries that SQL can express."""

from __future__ import annotations

from optelem.llm.license_rules import all_rules
from optelem.llm.licenses import pattern
from optelem.llm.quality_rules import BOILERPLATE, SENTENCE_END, SEPARATORS, Limits

WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def quality_rules() -> str:
    limits = Limits()
    symbols = "len(regexp_extract_all({0}, '[#*$%&|<>]'))"
    boilerplate = " OR ".join(f"(contains(lower, {quoted(hint)}) AND regexp_matches(line, {quoted('(?i)' + regex)}))" for hint, regex in BOILERPLATE)
    separators = f"len(list_filter(words, lambda w: list_contains([{', '.join(map(quoted, SEPARATORS))}], w)))"
    return rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
 w AS (SELECT rid, doc_id, t, lower(t) AS lower, {WORDS.format('t')} AS words FROM d),
 three AS (SELECT rid, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w) x),
 often AS (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM three) x WHERE n > 1),
 repeats AS (SELECT rid, count(DISTINCT p) AS n FROM often GROUP BY rid),
 parts AS (SELECT rid, lower, unnest(string_split(t, chr(10))) AS raw, unnest(range(len(string_split(t, chr(10))))) AS no FROM w),
 lines AS (SELECT rid, lower, raw, no, regexp_replace(raw, '^[ \x09-\x0D]+|[ \x09-\x0D]+$', '', 'g') AS line, {WORDS.format('raw')} AS words FROM parts),
 judged AS (SELECT rid, raw, no, len(words) AS n, len(words) > 0 AND (({separators} >= {limits.separators} AND {separators} >= {limits.separator_share} * len(words))
   OR {symbols.format('line')} > {limits.symbol_share} * len(words) OR {boilerplate}
   OR (len(words) >= {limits.shout_words} AND regexp_matches(line, '\p{{Lu}}') AND NOT regexp_matches(line, '\p{{Ll}}'))
   OR NOT regexp_matches(line, {quoted(SENTENCE_END)})) AS failed FROM lines),
 sums AS (SELECT rid, coalesce(sum(n) FILTER (failed), 0) AS lost, count(*) FILTER (n > 0) - count(DISTINCT raw) FILTER (n > 0) AS dup,
   coalesce(string_agg(raw, chr(10) ORDER BY no) FILTER (NOT failed), '') AS clean FROM judged GROUP BY rid),
 out AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST({symbols.format('t')} AS BIGINT) AS n_symbols,
   CAST(dup AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(lost AS BIGINT) AS lost_words, sha256(clean) AS clean_sha256
   FROM w JOIN sums USING (rid) LEFT JOIN repeats r USING (rid))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
 NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost_words <= {limits.lost_share} * n_words AS kept FROM out"""


def license_scan() -> str:
    rules = ",\n".join(f"({i}, [{', '.join(map(quoted, r.keyword.split('|')))}], {quoted(pattern(r))}, {r.priority}, {quoted(r.label)}, CAST({r.confidence} AS DOUBLE), {r.base})"
                       for i, r in enumerate(all_rules()))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""WITH r(rule, keywords, pattern, priority, label, confidence, base) AS (VALUES {rules}),
 d AS (SELECT row_number() OVER () AS rid, doc_id, trim(regexp_replace(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')) AS bare FROM documents),
 s AS (SELECT rid, doc_id, CASE WHEN bare = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(bare, ' ') END AS words, ' ' || replace(bare, ' ', '  ') || ' ' AS spaced FROM d),
 m AS (SELECT rid, r.*, string_split(trim(regexp_replace(spaced, pattern, ' ' || chr(1) || '\1' || chr(2) || ' ', 'g')), '  ') AS w FROM s JOIN r ON list_has_any(s.words, r.keywords)),
 f AS (SELECT rid, rule, priority, label, confidence, base, unnest(list_filter(range(len(w)), lambda i: starts_with(w[i + 1], chr(1)))) AS a,
   unnest(list_filter(range(len(w)), lambda i: suffix(w[i + 1], chr(2)))) AS b FROM m),
 k AS (SELECT * FROM f x WHERE NOT EXISTS (SELECT 1 FROM f y WHERE y.rid = x.rid AND y.priority <= x.priority AND y.a <= x.a AND y.b >= x.b
   AND (y.a, -y.b, y.priority, y.rule) < (x.a, -x.b, x.priority, x.rule))),
 b AS (SELECT rid, count(*) AS n, min(a) AS first_word, max(a) AS last_word, list(label) AS labels FROM f WHERE base GROUP BY rid),
 v AS (SELECT rid, count(*) AS n, max(confidence) AS score, list(label) AS labels FROM k GROUP BY rid),
 none AS (SELECT CAST([] AS VARCHAR[]) AS empty)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
 array_to_string(list_sort(list_distinct(coalesce(b.labels, empty))), ',') AS base_labels,
 array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, empty), coalesce(v.labels, empty)))), ',') AS labels,
 coalesce(v.score, CAST(0 AS DOUBLE)) AS score, CAST(coalesce(v.n, 0) AS BIGINT) AS n_detections FROM s CROSS JOIN none LEFT JOIN b USING (rid) LEFT JOIN v USING (rid)"""


def source_mix() -> str:
    return rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, len({WORDS.format("coalesce(text, '')")}) AS size, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h FROM documents),
 s AS (SELECT source, CAST(sum(size) AS HUGEINT) AS total, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS HUGEINT) AS w FROM d GROUP BY source),
 o AS (SELECT *, sum(total) OVER () AS everything, coalesce(sum(3 * total) OVER (ORDER BY 3 * total / CAST(w AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
   sum(w) OVER (ORDER BY 3 * total / CAST(w AS DOUBLE), source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM s),
 c AS (SELECT *, (everything - caps) * w > 3 * total * ws AS capped FROM o),
 t AS (SELECT source, CAST(total AS DOUBLE) AS total, CASE WHEN capped THEN CAST(3 * total AS DOUBLE)
   ELSE CAST(w * (everything - coalesce(sum(3 * total) FILTER (capped) OVER (), 0)) AS DOUBLE) / CAST(sum(w) FILTER (NOT capped) OVER () AS DOUBLE) END AS target FROM c),
 b AS (SELECT *, CASE WHEN total > 0 THEN floor(target / total) ELSE 0 END AS full_copies FROM t),
 g AS (SELECT source, h, sum(size) AS here FROM d WHERE size > 0 GROUP BY source, h),
 a AS (SELECT source, h, here, coalesce(sum(here) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g),
 e AS (SELECT b.source, min(h) AS h, min_by(here, h) AS here, min_by(before, h) AS before FROM b JOIN a ON a.source IS NOT DISTINCT FROM b.source
   WHERE before + here > target - full_copies * total GROUP BY b.source),
 x AS (SELECT b.*, e.h AS edge, before + here - (target - full_copies * total) < (target - full_copies * total) - before AS nearer FROM b LEFT JOIN e ON e.source IS NOT DISTINCT FROM b.source),
 y AS (SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(total AS BIGINT) AS source_size, target, CAST(full_copies + CASE WHEN d.h < edge OR (d.h = edge AND nearer) THEN 1 ELSE 0 END AS BIGINT) AS copies
   FROM d JOIN x ON x.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM y"""


def warc_salvage() -> str:
    return """WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS bytes FROM pages),
 q AS (SELECT *, CASE WHEN bytes >= 1000 THEN max(page_id) OVER (PARTITION BY digest) END AS last FROM p)
SELECT page_id, CAST(bytes AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN last <> page_id THEN CAST(last AS BIGINT) END AS refers_to FROM q"""


def filter_audit() -> str:
    words = WORDS.format("t")
    return rf"""WITH RECURSIVE letters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
 orders(filter_order, applied, step) AS (SELECT letter, bit, 1 FROM letters UNION ALL
   SELECT filter_order || letter, applied | bit, step + 1 FROM orders JOIN letters ON applied & bit = 0),
 steps AS (SELECT filter_order, s.step, l.letter, l.bit, coalesce((SELECT sum(b.bit) FROM letters b WHERE contains(filter_order[:s.step - 1], b.letter)), 0)::INT AS before
   FROM orders, (SELECT unnest(range(1, 6)) AS step) s JOIN letters l ON l.letter = filter_order[s.step] WHERE orders.step = 5),
 d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
 w AS (SELECT doc_id, part, t, {words} AS words, doc_id > min(doc_id) OVER (PARTITION BY t) AS copied FROM d),
 m AS (SELECT doc_id, part, (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
   + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(copied, false)::INT AS mask FROM w),
 l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
 c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
 r AS (SELECT part, filter_order, step, letter, sum(n) FILTER (mask & (before | bit) = 0) AS kept, sum(n) FILTER (mask & before = 0 AND mask & bit > 0) AS removed,
   sum(n) FILTER (mask & before > 0 AND mask & bit > 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
   sum(good) FILTER (mask & before = 0 AND mask & bit > 0) AS good_lost, sum(toxic) FILTER (mask & before = 0 AND mask & bit > 0) AS toxic_lost FROM c, steps GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
 CAST(coalesce(sum(removed) OVER (PARTITION BY part, letter), 0) AS BIGINT) AS shapley FROM r"""


def phrase_collocations() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{upper}', '{lower}') AS t FROM documents),
 p AS (SELECT rid, lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
 w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
 g AS (SELECT lang, m, array_to_string(words[i:i + m - 1], ' ') AS phrase, words FROM (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w) x, (SELECT unnest(range(1, 6)) AS m) s
   WHERE i + m - 1 <= len(words)),
 f AS (SELECT lang, phrase, m, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
 n AS (SELECT lang, sum(len(words)) AS n FROM w GROUP BY lang),
 c AS (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS words FROM f WHERE m > 1),
 i AS (SELECT lang, array_to_string(words[i:i + s - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT *, unnest(range(2, m)) AS s FROM c) x, (SELECT unnest(range(1, 5)) AS i) y
   WHERE i + s - 1 <= m GROUP BY ALL),
 k AS (SELECT c.*, unnest(range(1, m)) AS k FROM c LEFT JOIN i USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a),
 s AS (SELECT k.lang, k.phrase, a, k, l.f AS l, r.f AS r, n, CAST(1000 AS HUGEINT) * a * n // (CAST(l.f AS HUGEINT) * r.f) AS score FROM k JOIN n USING (lang)
   JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(words[1:k], ' ') JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(words[k + 1:], ' ')),
 b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
 CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM b QUALIFY rank <= 2000"""


def html_main_text() -> str:
    """For pages of the form that the table has: one article element of h1 and p elements with inline markup."""
    return rf"""WITH d AS (SELECT row_number() OVER () AS rid, page_id, url, coalesce(html, '') AS h, regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1) AS host FROM pages),
 a AS (SELECT rid, host, regexp_replace(regexp_extract(h, '(?s)<article>(.*)', 1), '(?s)</article>.*', '') AS body FROM d),
 p AS (SELECT rid, host, body, unnest(string_split_regex(body, '</?(?:p|h1)>')) AS part, unnest(range(len(string_split_regex(body, '</?(?:p|h1)>')))) AS no FROM a),
 b AS (SELECT rid, host, body, no, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_replace(part, '<[^>]*>', '', 'g'), '&quot;', '"'), '&#x27;', chr(39)), '&lt;', '<'), '&gt;', '>'),
   '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS line FROM p),
 s AS (SELECT host, count(DISTINCT body) AS pages FROM a WHERE host <> '' GROUP BY host),
 t AS (SELECT host, line FROM b JOIN s USING (host) WHERE line <> '' GROUP BY host, line, pages HAVING count(DISTINCT body) >= 10 AND count(DISTINCT body) >= 0.5 * pages),
 f AS (SELECT rid, string_agg(line, chr(10) ORDER BY no) AS text FROM b WHERE line <> '' AND NOT EXISTS (SELECT 1 FROM t WHERE t.host = b.host AND t.line = b.line) GROUP BY rid)
SELECT page_id, url, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars FROM d LEFT JOIN f USING (rid)"""


ORACLES = {"op2_quality_rules": quality_rules(), "op4_license_scan": license_scan(), "op5_source_mix": source_mix(), "op9_warc_salvage": warc_salvage(),
           "op11_filter_audit": filter_audit(),
           "op12_phrase_collocations": phrase_collocations(), "op13_html_main_text": html_main_text()}
