"""Queries: facts from Markdown and HTML pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import vocab
from codeloom.operators import evidence as V, extract_docs as M
from codeloom.plans import duck as D
from codeloom.plans.catalog import Data, query

MD, OPEN = D.MD, D.OPEN_MD

#: table rows of md_lines: the first header of each block of `|` lines and its body
TABLES = rf"""(WITH o AS (SELECT page, line_no, line, is_fence, in_fence, lead(line) OVER (PARTITION BY page ORDER BY line_no) AS nx FROM {MD} m),
 v AS (SELECT *, coalesce(last_value(nullif(trim(regexp_extract(line, '^#{{2,3}}\s+(.{{1,80}})', 1)), '') IGNORE NULLS) OVER (PARTITION BY page ORDER BY line_no), '') AS section FROM o WHERE NOT is_fence AND NOT in_fence),
 b AS (SELECT *, line_no - row_number() OVER (PARTITION BY page ORDER BY line_no) AS block FROM v WHERE starts_with(trim(line), '|')),
 h AS (SELECT *, min(CASE WHEN ends_with(trim(line), '|') AND regexp_matches(nx, '{vocab.TABLE_RULE}') AND contains(nx, '-') THEN line_no END) OVER (PARTITION BY page, block) AS table_line FROM b),
 r AS (SELECT *, sum(CASE WHEN regexp_matches(trim(line), '^\|[\s:|-]+\|?$') AND line_no > table_line + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY page, block ORDER BY line_no) AS rules FROM h WHERE line_no >= table_line)
 SELECT page, table_line, CASE WHEN line_no = table_line THEN 0 ELSE line_no - table_line - 1 END AS row_no, section, {D.cells('line')} AS cells, line_no FROM r WHERE rules = 0 AND line_no <> table_line + 1)"""
TERMS = f"(SELECT DISTINCT page, trim(t) AS term FROM (SELECT page, unnest(regexp_extract_all(line, '`([^`\n]{{1,60}})`', 1)) AS t FROM {OPEN} o) q WHERE length(trim(t)) >= 2)"
CLAIMS = rf"""(SELECT page, raw, chain, regexp_extract(chain, '([^.]*)$', 1) AS name, min(line_no) AS line_no, arg_min(match_no, line_no * 10000 + match_no) AS match_no FROM (
 SELECT page, line_no, match_no, trim(r) AS raw, regexp_replace(trim(r), '\(\s*\)$', '') AS chain FROM (SELECT page, line_no, unnest(regexp_extract_all(line, '`([^`]+)`', 1)) AS r, generate_subscripts(regexp_extract_all(line, '`([^`]+)`', 1), 1) - 1 AS match_no FROM {OPEN} o) q) z
 WHERE regexp_matches(chain, '^[A-Za-z_$][A-Za-z0-9_$]*(?:\.[A-Za-z_$][A-Za-z0-9_$]*)*$') AND length(regexp_extract(chain, '([^.]*)$', 1)) >= 3
 AND chain NOT IN {D.values(vocab.NON_CLAIM_WORDS)} AND regexp_extract(chain, '([^.]*)$', 1) NOT IN {D.values(vocab.NON_CLAIM_WORDS)} GROUP BY 1, 2, 3, 4)"""
FILE_ANCHORS = rf"""(SELECT page, line_no, regexp_extract(a, '^`?(.*):\d+`?$', 1) AS path, CAST(regexp_extract(a, ':(\d+)`?$', 1) AS INT) AS target_line, line FROM (SELECT page, line_no, line, unnest(regexp_extract_all(line, {D.rx(vocab.ANCHOR)})) AS a FROM {OPEN} o) q)"""
ANCHORS = rf"""(SELECT page, anchor FROM (SELECT page, trim(cells[4]) AS anchor FROM {TABLES} t WHERE row_no > 0 AND len(cells) = 4 AND contains(cells[4], ':'))
 UNION SELECT page, anchor FROM (SELECT page, unnest(regexp_extract_all(line, 'commit:[0-9a-f]{{7,40}}')) AS anchor FROM md_lines) c)"""
LINKS = rf"""(SELECT page, line_no, regexp_extract(m, '^\[([^\]]*)\]', 1) AS label, regexp_extract(m, '\]\(([^)\s]+?)(?:#[^)]*)?\)$', 1) AS target FROM (SELECT page, line_no, unnest(regexp_extract_all(line, {D.rx(M.MD_LINK)})) AS m FROM md_lines) q)"""
SLUGS = rf"""(SELECT DISTINCT page, regexp_replace(trim(regexp_replace(lower(trim(regexp_extract(line, '^#{{1,6}}\s+(.+)$', 1))), '[^\p{{L}}\p{{N}}\s_-]', '', 'g')), '\s+', '-', 'g') AS slug FROM md_lines WHERE regexp_matches(line, '^#{{1,6}}\s+(.+)$'))"""


@query("extract_tables", f"""SELECT page, table_line, max(section) FILTER (row_no = 0) AS section, max(array_to_string(cells, '|')) FILTER (row_no = 0) AS header, count(*) FILTER (row_no > 0) AS n_rows,
 count(DISTINCT nullif(cells[1], '')) FILTER (row_no > 0) AS first_values FROM {TABLES} t GROUP BY 1, 2""")
def extract_tables(d: Data):
    return M.extract_tables(d("md_lines"))


NUMERIC = rf"""(WITH t AS {TABLES}, c AS (SELECT page, table_line, row_no, unnest(cells) AS cell, generate_subscripts(cells, 1) AS col FROM t WHERE row_no > 0),
 n AS (SELECT page, table_line, count(*) AS n_rows FROM t WHERE row_no > 0 GROUP BY 1, 2),
 s AS (SELECT page, table_line, col, count(*) AS n, string_agg(regexp_replace(CAST(CAST(cell AS DOUBLE) AS VARCHAR), '\.0$', ''), ',' ORDER BY row_no) AS sequence FROM c WHERE regexp_matches(cell, '^\d+(?:\.\d+)?$') GROUP BY 1, 2, 3)
 SELECT s.page, s.table_line, h.cells[s.col] AS header, s.n, s.sequence FROM s JOIN n USING (page, table_line) JOIN t h ON h.page = s.page AND h.table_line = s.table_line AND h.row_no = 0 WHERE s.n >= 5 AND s.n >= n_rows * 0.8 AND n_rows >= 5)"""


@query("numeric_columns", f"SELECT * FROM {NUMERIC} x")
def numeric_columns(d: Data):
    return M.numeric_columns(d("md_lines"))


@query("extract_terms", f"SELECT * FROM {TERMS} t")
def extract_terms(d: Data):
    return M.extract_terms(d("md_lines"))


@query("dep_mentions", f"SELECT term, count(*) AS pages FROM {TERMS} t WHERE regexp_matches(term, '^(?:@[A-Za-z0-9_.-]+/)?[A-Za-z0-9_][A-Za-z0-9_.-]*$') GROUP BY 1")
def dep_mentions(d: Data):
    return M.dep_mentions(M.extract_terms(d("md_lines")))


@query("evidence_anchors", f"SELECT * FROM {ANCHORS} a")
def evidence_anchors(d: Data):
    return M.evidence_anchors(d("md_lines"))


def page_files(d: Data):
    """Source files each page names in a file anchor."""
    found = M.extract_anchors(d("md_lines")).filter("kind = 'file'")
    return found.select("page", F.col("path").alias("file")).join(d("files").select(F.col("path").alias("file")), "file", "left_semi").distinct()


PAGE_FILES = f"(SELECT DISTINCT page, path AS file FROM {FILE_ANCHORS} a WHERE path IN (SELECT path FROM files))"


@query("page_fingerprints", f"""SELECT p.page, coalesce(t.n, 0) AS tables, coalesce(e.n, 0) AS terms, coalesce(a.n, 0) AS anchors, coalesce(f.n, 0) AS files FROM (SELECT DISTINCT page FROM md_lines) p
 LEFT JOIN (SELECT page, count(DISTINCT table_line) AS n FROM {TABLES} t GROUP BY 1) t USING (page) LEFT JOIN (SELECT page, count(*) AS n FROM {TERMS} t GROUP BY 1) e USING (page)
 LEFT JOIN (SELECT page, count(*) AS n FROM {ANCHORS} t GROUP BY 1) a USING (page) LEFT JOIN (SELECT page, count(*) AS n FROM {PAGE_FILES} t GROUP BY 1) f USING (page)""")
def page_fingerprints(d: Data):
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).alias(c)
    return M.page_fingerprints(d("md_lines"), page_files(d)).select("page", size("tables"), size("terms"), size("anchors"), size("files"))


@query("extract_claims", f"SELECT * FROM {CLAIMS} c")
def extract_claims(d: Data):
    return M.extract_claims(d("md_lines"))


@query("extract_anchors", rf"""SELECT page, line_no, 'file' AS kind, path, target_line FROM {FILE_ANCHORS} f
 UNION ALL SELECT page, line_no, 'commit', regexp_extract(line, {D.rx(vocab.COMMIT_ANCHOR)}), NULL FROM {OPEN} o WHERE regexp_matches(line, {D.rx(vocab.COMMIT_ANCHOR)})
 UNION ALL SELECT page, line_no, 'doc', unnest(regexp_extract_all(line, {D.rx(vocab.DOC_ANCHOR.replace('(?i)', ''))})), NULL FROM {OPEN} o""")
def extract_anchors(d: Data):
    return M.extract_anchors(d("md_lines"))


@query("extract_links", rf"""SELECT page, line_no, label, target, CASE WHEN starts_with(target, '#') THEN 'fragment' WHEN regexp_matches(target, '(?i)^(?:[a-z][a-z0-9+.-]*:|//)') THEN 'external' WHEN ends_with(target, '.md') THEN 'page' ELSE 'other' END AS link_class FROM {LINKS} l""")
def extract_links(d: Data):
    return M.extract_links(d("md_lines"))


@query("html_links", """SELECT page_id, target, CASE WHEN starts_with(target, '#') THEN 'fragment' WHEN regexp_matches(target, '(?i)^(?:[a-z][a-z0-9+.-]*:|//)') THEN 'external' WHEN ends_with(target, '.md') THEN 'page' ELSE 'other' END AS link_class
 FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages) t""")
def html_links(d: Data):
    return M.html_links(d("pages"))


@query("heading_slugs", f"SELECT * FROM {SLUGS} s")
def heading_slugs(d: Data):
    return M.heading_slugs(d("md_lines"))


@query("title_slugs", r"""SELECT page_id, regexp_replace(trim(regexp_replace(lower(trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1))), '[^\p{L}\p{N}\s_-]', '', 'g')), '\s+', '-', 'g') AS slug FROM pages""")
def title_slugs(d: Data):
    from codeloom.functions import text as X

    return d("pages").select("page_id", X.heading_slug(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)).alias("slug"))


@query("doc_sections", rf"""WITH r AS (SELECT page, line_no, trim(line) AS t, length(regexp_extract(line, '^(#{{1,3}})\s', 1)) AS lv, trim(regexp_extract(line, '^#{{1,3}}\s+(.{{1,80}})', 1)) AS title FROM md_lines),
 s AS (SELECT h.page, h.line_no, h.lv, h.title, (SELECT min(e.line_no) FROM r e WHERE e.page = h.page AND e.line_no > h.line_no AND e.lv BETWEEN 1 AND h.lv) AS fin FROM r h WHERE h.lv > 0 AND h.title <> ''),
 f AS (SELECT s.*, (SELECT min(x.line_no) FROM r x WHERE x.page = s.page AND x.line_no > s.line_no AND x.lv = 0 AND x.t <> '' AND (s.fin IS NULL OR x.line_no < s.fin)) AS beg FROM s),
 g AS (SELECT f.*, (SELECT min(x.line_no) FROM r x WHERE x.page = f.page AND x.line_no > f.beg AND x.lv = 0 AND x.t = '') AS stop FROM f WHERE beg IS NOT NULL),
 e AS (SELECT g.page, g.line_no, g.title, rtrim(substr(string_agg(r.t, ' ' ORDER BY r.line_no), 1, 200)) AS ex FROM g JOIN r ON r.page = g.page AND r.lv = 0 AND r.t <> '' AND r.line_no >= g.beg AND (g.stop IS NULL OR r.line_no < g.stop) AND (g.fin IS NULL OR r.line_no < g.fin) GROUP BY 1, 2, 3),
 k AS (SELECT * FROM e WHERE length(ex) >= 10)
 SELECT page AS file, line_no, title || '：' || ex AS text, page || '#' || regexp_replace(trim(regexp_replace(lower(trim(title)), '[^\p{{L}}\p{{N}}\s_-]', '', 'g')), '\s+', '-', 'g') AS anchor FROM k""")
def doc_sections(d: Data):
    return V.doc_sections(d("md_lines"))


@query("readme_prereqs", rf"""WITH r AS (SELECT page, line_no, line, nullif(trim(regexp_extract(line, '^#{{1,4}}\s+(.+)$', 1)), '') AS title FROM md_lines),
 s AS (SELECT *, count(title) OVER (PARTITION BY page ORDER BY line_no) AS sec FROM r),
 b AS (SELECT page, sec, regexp_replace(string_agg(line, chr(10) ORDER BY line_no), '^\s+|\s+$', '', 'g') AS body FROM s WHERE title IS NULL AND sec > 0 GROUP BY 1, 2)
 SELECT s.page, s.title, b.body AS text FROM s JOIN b ON s.page = b.page AND s.sec = b.sec WHERE s.title IS NOT NULL AND regexp_matches(s.title, {D.rx(vocab.PREREQ_HEADING)}) AND b.body <> ''""")
def readme_prereqs(d: Data):
    return V.readme_prereqs(d("md_lines"))


@query("doc_titles", r"SELECT page, arg_min(trim(regexp_extract(line, '^#\s+(.{1,80})', 1)), line_no) AS title FROM md_lines WHERE regexp_matches(line, '^#\s+\S') GROUP BY 1")
def doc_titles(d: Data):
    return V.doc_titles(d("md_lines"))


@query("excerpt", r"""SELECT doc_id, CASE WHEN length(text) <= 600 THEN text ELSE regexp_replace(CASE WHEN pos > 300 THEN substr(cut, 1, pos) ELSE cut END, '\s+$', '') || chr(10) || chr(10) || '（已截断）' END AS excerpt FROM (
 SELECT doc_id, text, cut, CASE WHEN r > 0 THEN length(cut) - r - 1 ELSE -1 END AS pos FROM (SELECT doc_id, text, substr(text, 1, 600) AS cut, instr(reverse(substr(text, 1, 600)), chr(10) || chr(10)) AS r FROM documents) a) b""")
def excerpt(d: Data):
    return V.excerpt(d("documents"), 600).select("doc_id", "excerpt")


@query("identifier_universe", """SELECT DISTINCT identifier FROM (SELECT 'kind' AS identifier UNION ALL SELECT event_type FROM events UNION ALL SELECT 'deep' UNION ALL SELECT 'user_' || user_id FROM events UNION ALL SELECT 'props') t""")
def identifier_universe(d: Data):
    body = F.concat(F.lit('{"kind":"'), "event_type", F.lit('","deep":{"id":"user_'), "user_id", F.lit('"},"props":'), "props", F.lit("}"))
    return M.identifier_universe(d("events").select(body.alias("j")), "j")
