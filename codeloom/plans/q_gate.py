"""Queries: quality rules, the gate, cross-page review and outlines."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import vocab
from codeloom.operators import aggregate as G, anchors as A, extract_docs as M, joins as J, outline as O, pages as Pg, quality as Q, similarity as S
from codeloom.plans import duck as D, q_graph
from codeloom.plans.catalog import Data, query
from codeloom.plans.fixtures import path_of
from codeloom.plans.q_aggs import COVERAGE, SUPPORT, _block_sql, _inner, block_lines
from codeloom.plans.q_docs import SLUGS, TABLES  # noqa: F401
from codeloom.plans.q_joins import CHECKED, absent_names, page_paths, verdicts
from codeloom.plans.q_sets import linked_pages
from codeloom.operators.lines import rebuild
from codeloom.session import cut_lineage
from codeloom.sources import sinks


def document_lines(d: Data):
    """Whole documents as pages: with a title line, as headings only, with nothing but white space, and as they are."""
    from codeloom.operators.lines import line_table

    k = F.col("doc_id") % 4
    content = F.when(k == 0, F.concat(F.lit("# T\n"), "text")).when(k == 1, F.regexp_replace("text", "(?m)^", "# h ")).when(k == 2, F.regexp_replace("text", r"\S", "")).otherwise(F.col("text"))
    return line_table(d("documents").select(F.concat(F.lit("p"), "doc_id").alias("page"), content.alias("content")), "page", "content")


EMPTY = """(SELECT 'p' || doc_id AS page, 'empty-shell' AS rule, 'error' AS severity, CASE doc_id % 4 WHEN 2 THEN '内容为空' WHEN 3 THEN '缺少 Markdown 标题结构' ELSE '仅有标题无正文，判定为空壳页' END AS message FROM documents WHERE doc_id % 4 > 0 AND NOT (doc_id % 4 = 3 AND regexp_matches(text, '(?m)^\\s*#{1,6}\\s')))"""


@query("rule_empty_shell", f"SELECT * FROM {EMPTY} e")
def rule_empty_shell(d: Data):
    return Q.rule_empty_shell(document_lines(d))


def document_pages(d: Data):
    return d("documents").select(F.concat(F.lit("p"), "doc_id").alias("page"), F.col("text").alias("content"))


_SECRET = " ".join(f"WHEN regexp_matches(text, {D.rx(p)}) THEN '{label}（第 ' || (length(regexp_split_to_array(text, {D.rx(p)})[1]) - length(replace(regexp_split_to_array(text, {D.rx(p)})[1], chr(10), '')) + 1) || ' 行，值不回显）'" for label, p in vocab.SECRET_PATTERNS)
SECRET = f"(SELECT * FROM (SELECT 'p' || doc_id AS page, 'secret' AS rule, 'error' AS severity, CASE {_SECRET} END AS message FROM documents) t WHERE message IS NOT NULL)"


@query("rule_secret", f"SELECT * FROM {SECRET} s")
def rule_secret(d: Data):
    return Q.rule_secret(document_pages(d))


def tiers(d: Data):
    return d("documents").select(F.concat(F.lit("p"), "doc_id").alias("page"), F.when(F.col("doc_id") % 2 == 0, "structure").otherwise("operations").alias("tier"))


THIN = """(SELECT page, 'thin-evidence' AS rule, 'warn' AS severity, '证据锚定块仅 2 个源文件（< 3），页面叙述依据可能不足' AS message FROM (SELECT DISTINCT page FROM md_lines) p WHERE CAST(substr(page, 2) AS INT) % 6 = 0)"""


@query("rule_thin_evidence", f"SELECT * FROM {THIN} t")
def rule_thin_evidence(d: Data):
    return Q.rule_thin_evidence(block_lines(d), tiers(d))


COVERAGE_ISSUES = f"(SELECT page, 'evidence-coverage' AS rule, 'warn' AS severity, '正文引用文件 ' || cited || ' 个，锚定块仅覆盖 ' || covered || ' 个' AS message FROM {COVERAGE} c WHERE cited >= 3 AND covered < cited AND uncited > 0)"


@query("rule_evidence_coverage", f"SELECT * FROM {COVERAGE_ISSUES} c")
def rule_evidence_coverage(d: Data):
    return Q.rule_evidence_coverage(block_lines(d), d("files"))


_MERMAID = f"(SELECT page, line_no, line FROM (SELECT *, last_value(CASE WHEN is_fence THEN line = '```mermaid' END IGNORE NULLS) OVER (PARTITION BY page ORDER BY line_no) AS mm FROM {D.MD} m) x WHERE in_fence AND NOT is_fence AND mm)"
DIAGRAM = f"(SELECT DISTINCT page, 'diagram-misuse' AS rule, 'warn' AS severity, 'sequenceDiagram 仅允许出现在 calls 页（R2 边表优于时序图）' AS message FROM {_MERMAID} m WHERE regexp_matches(line, '^\\s*sequenceDiagram'))"


@query("rule_diagram_misuse", f"SELECT * FROM {DIAGRAM} d")
def rule_diagram_misuse(d: Data):
    return Q.rule_diagram_misuse(d("md_lines"))


def _anchored(line: str) -> str:
    return f"(regexp_matches({line}, {D.rx(vocab.ANCHOR)}) OR regexp_matches({line}, {D.rx(vocab.COMMIT_ANCHOR)}) OR regexp_matches({line}, {D.rx(vocab.DOC_ANCHOR)}))"


RATIONALE = rf"""(SELECT h.page, 'unanchored-rationale' AS rule, 'warn' AS severity, '动机类小节「' || h.title || '」未引用任何 file:line 或 commit 证据（R7），叙述可能为无据推断' AS message FROM (WITH s AS (SELECT *, count(title) OVER (PARTITION BY page ORDER BY line_no) AS sec FROM (SELECT page, line_no, line, nullif(trim(regexp_extract(line, '^##\s+(.{{1,60}})', 1)), '') AS title FROM md_lines) x)
 SELECT a.page, a.title, bool_or(trim(b.line) <> '') AS filled, bool_or({_anchored('b.line')}) AS anchored FROM s a JOIN s b ON b.page = a.page AND b.sec = a.sec AND b.title IS NULL WHERE a.title IS NOT NULL AND regexp_matches(a.title, '{vocab.RATIONALE}') GROUP BY a.page, a.sec, a.title) h WHERE filled AND NOT anchored)"""


@query("rule_unanchored_rationale", f"SELECT * FROM {RATIONALE} r")
def rule_unanchored_rationale(d: Data):
    return Q.rule_unanchored_rationale(d("md_lines"))


def _incomplete_sql(source: str, key: str, extra: str = "") -> str:
    return rf"""(WITH f AS (SELECT {key} AS page, line_no, line, regexp_matches(line, '^\s*```') AS fe, sum(CASE WHEN regexp_matches(line, '^\s*```') THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY line_no) % 2 = 1 AS inf FROM {source} z {extra}),
 g AS (SELECT page, count(*) FILTER (fe) % 2 = 1 AS uncl, arg_max(line, line_no) FILTER (trim(line) <> '') AS last FROM f GROUP BY 1),
 b AS (SELECT *, line_no - row_number() OVER (PARTITION BY page ORDER BY line_no) AS block FROM f WHERE starts_with(ltrim(line), '|') AND NOT inf),
 o AS (SELECT page, min(line_no) - 1 AS orphan FROM (SELECT *, row_number() OVER (PARTITION BY page, block ORDER BY line_no) AS k FROM b) q WHERE k = 2 AND NOT regexp_matches(line, '^\s*\|?\s*:?-{{1,}}:?\s*(\|\s*:?-{{1,}}:?\s*)*\|?\s*$') GROUP BY 1),
 s AS (SELECT g.page, concat_ws('、', CASE WHEN uncl THEN '未闭合代码块' END, CASE WHEN starts_with(ltrim(last), '|') AND NOT ends_with(rtrim(last), '|') THEN '末尾表格残行' END, CASE WHEN orphan IS NOT NULL THEN '中段无表头表格块（第 ' || orphan || ' 行起）' END) AS s FROM g LEFT JOIN o ON o.page = g.page)
 SELECT page, 'incomplete-page' AS rule, 'warn' AS severity, '疑似截断残页（' || s || '）' AS message FROM s WHERE s <> '')"""


INCOMPLETE = _incomplete_sql("md_lines", "page")


@query("rule_incomplete_page", f"SELECT page, rule, CASE WHEN page LIKE '%3' THEN 'error' ELSE severity END AS severity, message || CASE WHEN page LIKE '%3' THEN '：续写耗尽后仍截断' ELSE '' END AS message FROM {INCOMPLETE} i")
def rule_incomplete_page(d: Data):
    truncated = d("documents").select(F.concat(F.lit("p"), "doc_id").alias("page")).filter("page LIKE '%3'")
    return Q.rule_incomplete_page(d("md_lines"), truncated)


@query("rule_incomplete_documents", "SELECT * FROM " + _incomplete_sql("(SELECT 'p' || doc_id AS page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)", "page") + " i")
def rule_incomplete_documents(d: Data):
    from codeloom.operators.lines import line_table

    return Q.rule_incomplete_page(line_table(document_pages(d), "page", "content"))


_DEP = rf"""(WITH s AS (SELECT *, last_value(title IGNORE NULLS) OVER (PARTITION BY page ORDER BY line_no) AS sec FROM (SELECT page, line_no, line, nullif(trim(regexp_extract(line, '^##\s+(.{{1,40}})', 1)), '') AS title FROM md_lines) x),
 c AS (SELECT page, line_no, line, list_filter(list_transform(string_split(trim(line), '|'), lambda x: trim(x)), lambda x: x <> '') AS cells FROM s WHERE title IS NULL AND regexp_matches(sec, '{vocab.DEPENDENCY_SECTIONS}') AND starts_with(trim(line), '|'))
 SELECT page, line_no, substr(list_filter(cells, lambda x: NOT regexp_matches(x, '^\d'))[1], 1, 30) AS name FROM c WHERE len(cells) > 0 AND len(list_filter(cells, lambda x: NOT regexp_matches(x, '^:?-{{2,}}:?$'))) > 0
 AND NOT regexp_matches(trim(line), '依赖|版本|import') AND NOT regexp_matches(trim(line), {D.rx(Q.IMPORT_ANCHOR)}))"""
DEPENDENCY = f"""(SELECT page, 'unanchored-dependency' AS rule, 'warn' AS severity, '依赖表格行缺 import 点锚点（R3）：' || arg_min(name, line_no) || CASE WHEN count(*) > 1 THEN ' 等 ' || count(*) || ' 行' ELSE '' END AS message FROM {_DEP} d WHERE name IS NOT NULL GROUP BY 1)"""


@query("rule_unanchored_dependency", f"SELECT * FROM {DEPENDENCY} d")
def rule_unanchored_dependency(d: Data):
    return Q.rule_unanchored_dependency(d("md_lines"), page=None)


def suspects(d: Data):
    return d("part").filter("p_partkey % 3 = 0").select(F.concat(F.lit("inv_"), "p_partkey").alias("name"))


ABSENCE = r"""(SELECT page, 'unverified-absence' AS rule, 'warn' AS severity, '对口径局限嫌疑对象下了否定性结论（须标「扫描口径局限」）：' || min(n) || CASE WHEN count(*) > 1 THEN ' 等 ' || count(*) || ' 个' ELSE '' END AS message FROM (SELECT DISTINCT page, unnest(regexp_extract_all(line, '`([^`\n]+)`', 1)) AS n FROM md_lines WHERE contains(line, '未被调用')) t
 WHERE n IN (SELECT 'inv_' || p_partkey FROM part WHERE p_partkey % 3 = 0) GROUP BY 1)"""


@query("rule_unverified_absence", f"SELECT * FROM {ABSENCE} a")
def rule_unverified_absence(d: Data):
    return Q.rule_unverified_absence(d("md_lines"), suspects(d))


FILLER = "(SELECT page, 'filler-noise' AS rule, 'error' AS severity, '「数据未提供」类填充行 ' || count(*) || ' 行（>10）：页面疑似数据工件转储，已降级规则路径' AS message FROM md_lines WHERE contains(line, '数据未提供') GROUP BY 1 HAVING count(*) > 10)"


@query("rule_filler_noise", f"SELECT * FROM {FILLER} f")
def rule_filler_noise(d: Data):
    return Q.rule_filler_noise(d("md_lines"))


def owned_headers(d: Data):
    """md_lines whose metric tables carry another page's header on every third page."""
    swap = F.when(F.expr("CAST(substr(page, 2) AS INT) % 3 = 0") & F.col("line").startswith("| symbol |"), "| 依赖 | 版本 | anchor |").otherwise(F.col("line"))
    return d("md_lines").withColumn("line", swap)


@query("rule_scope_overlap", f"""SELECT page, 'page-scope-overlap' AS rule, 'warn' AS severity, '出现 tech-stack 页的专属表头「依赖 | 版本」（' || arg_min(n, table_line) || ' 行），疑似职责越界，建议让位并链接 tech-stack.md' AS message FROM (SELECT page, table_line, count(*) FILTER (row_no > 0) AS n, max(array_to_string(cells, '|')) FILTER (row_no = 0) AS header FROM {TABLES} t GROUP BY 1, 2) h
 WHERE CAST(substr(page, 2) AS INT) % 3 = 0 AND starts_with(header, 'symbol|') AND n > 0 GROUP BY 1""")
def rule_scope_overlap(d: Data):
    return Q.rule_scope_overlap(M.extract_tables(owned_headers(d)))


def all_issues(d: Data):
    """The whole gate over md_lines, once a query."""
    if "issues" not in d._stored:
        d._stored["issues"] = cut_lineage(_all_issues(d))
    return d._stored["issues"]


def resolved_anchors(d: Data):
    """The file anchors of md_lines, once a query."""
    if "resolved" not in d._stored:
        d._stored["resolved"] = cut_lineage(A.file_anchors(d.stored("md_lines"), d("files")))
    return d._stored["resolved"]


def _all_issues(d: Data):
    lines, files, code = d.stored("md_lines"), d("files"), d.stored("code_lines")
    resolved = resolved_anchors(d)
    checked = A.anchor_line_check(resolved, code)
    slugs = M.heading_slugs(lines)
    docs = slugs.select(F.concat(F.lit("docs/"), "page", F.lit(".md")).alias("doc"), "slug")
    mismatch = A.anchor_symbol_mismatch(resolved, lines, code, d("symbols"))
    known = d("documents").filter("doc_id % 3 = 0").select(F.concat(F.lit("p"), "doc_id", F.lit(".md")).alias("path"))
    anchors = (checked, mismatch, A.doc_anchor_check(M.extract_anchors(lines), docs), A.fragment_check(lines, slugs))
    return Q.page_gate(
        lines, rebuild(lines), block_lines(d, lines), tiers(d), files, A.dead_links(lines, page_paths(d), page_paths(d), known),
        A.mermaid_ghosts(lines, files), anchors, suspects(d), dependency_page=None)


_MD_EMPTY = r"""(SELECT page, 'empty-shell' AS rule, 'error' AS severity, CASE WHEN n = 0 THEN '内容为空' WHEN b = n THEN '缺少 Markdown 标题结构' ELSE '仅有标题无正文，判定为空壳页' END AS message FROM (SELECT page, count(*) FILTER (trim(line) <> '') AS n, count(*) FILTER (trim(line) <> '' AND NOT regexp_matches(trim(line), '^#{1,6}\s')) AS b FROM md_lines GROUP BY 1) t WHERE n = 0 OR b = n OR b = 0)"""
_MD_SECRET = f"(SELECT * FROM (SELECT page, 'secret' AS rule, 'error' AS severity, CASE {_SECRET} END AS message FROM (SELECT page, string_agg(line, chr(10) ORDER BY line_no) AS text FROM md_lines GROUP BY 1) x) t WHERE message IS NOT NULL)"
ISSUES = f"""(SELECT * FROM {_MD_EMPTY} a UNION ALL SELECT * FROM {_MD_SECRET} sx UNION ALL SELECT * FROM {RATIONALE} ra UNION ALL SELECT * FROM {THIN} th UNION ALL SELECT * FROM {COVERAGE_ISSUES} co UNION ALL SELECT page, 'claim-support', 'warn', '事实句支撑率 ' || supported || '/' || factual || '（<50%）' FROM {SUPPORT} s WHERE factual >= 5 AND supported * 2 < factual
 UNION ALL SELECT DISTINCT page, 'dead-link', 'warn', '相对链接目标本次未产出: ' || target FROM {_inner('dead_links')} l UNION ALL SELECT * FROM {DIAGRAM} b UNION ALL SELECT page, 'mermaid-ghost', 'warn', 'Mermaid 图引用未知文件: ' || file FROM {_inner('mermaid_ghosts')} m
 UNION ALL SELECT * FROM {INCOMPLETE} i UNION ALL SELECT * FROM {DEPENDENCY} dp UNION ALL SELECT * FROM {ABSENCE} ab UNION ALL SELECT * FROM {FILLER} fi
 UNION ALL SELECT DISTINCT page, 'broken-anchor', 'warn', CASE state WHEN 'broken' THEN '残缺锚点（缺少行号）: ' || path || ':' || target_line WHEN 'unknown' THEN '锚点路径不在扫描文件清单中: ' || path ELSE '锚点行号超出文件范围: ' || path || ':' || target_line END FROM {CHECKED} c WHERE state IN ('broken', 'unknown', 'out-of-range')
 UNION ALL SELECT DISTINCT page, 'broken-anchor', 'warn', '锚点文件与符号定义文件不符: ' || name || ' @ ' || path || ':' || target_line FROM {_inner('anchor_symbol_mismatch')} x UNION ALL SELECT DISTINCT page, 'broken-anchor', 'warn', '文档锚点目标不存在: ' || anchor FROM {_inner('doc_anchor_check')} y
 UNION ALL SELECT DISTINCT page, 'broken-anchor', 'warn', '页内锚链接目标不存在: #' || slug FROM {_inner('fragment_check')} z)"""


@query("quality_gate", f"SELECT * FROM {ISSUES} i")
def quality_gate(d: Data):
    return all_issues(d)


@query("page_passed", f"""SELECT p.page, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, coalesce(errors, 0) = 0 AS passed FROM (SELECT DISTINCT page FROM md_lines) p LEFT JOIN (SELECT page, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warn') AS warnings FROM {ISSUES} i GROUP BY 1) c ON c.page = p.page""")
def page_passed(d: Data):
    return Q.page_passed(d.stored("md_lines"), all_issues(d))


@query("failing_reasons", f"SELECT page, string_agg(message, '; ' ORDER BY rule, message) AS reason FROM {ISSUES} e WHERE severity = 'error' GROUP BY 1")
def failing_reasons(d: Data):
    return Q.failing_reasons(all_issues(d))


@query("build_report", f"""SELECT 'pages.' || status AS counter, count(*) AS n FROM {_inner('sink_with_status')} s GROUP BY 1 UNION ALL SELECT 'issues.' || severity || '.' || rule, count(*) FROM {ISSUES} e GROUP BY 1
 UNION ALL SELECT 'claims.' || k, v FROM (UNPIVOT (SELECT sum(total) AS total, sum(verified) AS verified, sum(unverified) AS unverified, sum(mention_only) AS mention_only, sum(ambiguous) AS ambiguous, sum(skipped) AS skipped FROM {_inner('claim_stats')} c) ON total, verified, unverified, mention_only, ambiguous, skipped INTO NAME k VALUE v) u
 UNION ALL SELECT 'anchors.' || k, v FROM (UNPIVOT (SELECT sum(total) AS total, sum(valid) AS valid, sum(out_of_range) AS out_of_range, sum(comment) AS comment FROM {_inner('anchor_stats')} c) ON total, valid, out_of_range, comment INTO NAME k VALUE v) u
 UNION ALL SELECT 'support.' || k, v FROM (UNPIVOT (SELECT sum(factual) AS factual, sum(supported) AS supported FROM {SUPPORT} c) ON factual, supported INTO NAME k VALUE v) u""")
def build_report(d: Data):
    from codeloom.plans.q_basics import sink_with_status

    lines = d.stored("md_lines")
    checked = A.anchor_line_check(resolved_anchors(d), d.stored("code_lines"))
    return Q.build_report(sink_with_status(d), all_issues(d), J.claim_stats(verdicts(d, d.stored), J.symbol_index(d("symbols"))), A.anchor_stats(checked), G.claim_support(lines))


@query("crosspage_review", f"""SELECT a AS page, 'table-duplication' AS rule, 'warn' AS severity, '与 ' || b || ' 表格首列重合度 ' || CAST(round(overlap * 100) AS INT) || '%（≥50%）' AS message FROM {_inner('table_overlap')} t WHERE duplicated
 UNION ALL SELECT first_a, 'intent-evidence-duplication', 'warn', '与 ' || first_b || ' 意图证据锚点重合度 ' || CAST(round(jaccard * 100) AS INT) || '%（≥70%）' FROM {_inner('anchor_overlap')} a
 UNION ALL SELECT page, 'term-inconsistency', 'warn', '术语 `' || term || '` 与 glossary 规范形 `' || standard || '` 仅大小写/分隔符不同，建议统一' FROM {_inner('term_variants')} v
 UNION ALL SELECT 'overview', 'dep-consistency', 'warn', '依赖 `' || name || '` 归类矛盾' FROM {_inner('dep_consistency')} c
 UNION ALL SELECT min(first_page), 'metric-mismatch', 'warn', '同一数值序列（' || n || ' 项）在多处以不同语义渲染' FROM {_inner('same_numbers')} s GROUP BY sequence, headers, pages, n""")
def crosspage_review(d: Data):
    from codeloom.plans import q_joins, q_sets

    lines = d("md_lines")
    return Q.crosspage_review(lines, q_sets.table_overlap(d), q_sets.anchor_overlap(d), q_joins.term_variants(d), q_joins.dep_consistency(d), S.same_numbers(M.numeric_columns(lines)))


@query("precheck_pages", f"""WITH {q_graph.MOVES_CTE}, located AS (SELECT DISTINCT file, module FROM symbols), m AS (SELECT DISTINCT module FROM symbols), c AS (SELECT module, count(*) AS n FROM symbols WHERE label = 'Class' GROUP BY 1), g AS (SELECT module, count(*) AS n FROM symbols WHERE docstring IS NOT NULL GROUP BY 1),
 q AS (SELECT DISTINCT module FROM located WHERE file IN (SELECT caller_file FROM fl WHERE is_entry)), st AS (SELECT DISTINCT module FROM located WHERE file IN (SELECT file FROM sg)), ms AS (SELECT DISTINCT module FROM located WHERE file IN (SELECT caller_file FROM mv WHERE carries)), dc AS (SELECT module FROM commits)
 SELECT module, 'classes' AS page, 'too few classes' AS reason FROM m WHERE coalesce((SELECT n FROM c WHERE c.module = m.module), 0) < 3 UNION ALL SELECT module, 'glossary', 'too few documented symbols' FROM m WHERE coalesce((SELECT n FROM g WHERE g.module = m.module), 0) < 3
 UNION ALL SELECT module, 'data-flow', CASE WHEN module NOT IN (SELECT module FROM q) THEN 'no sequences' ELSE 'control flow only' END FROM m WHERE module NOT IN (SELECT module FROM q) OR module NOT IN (SELECT module FROM st) OR module NOT IN (SELECT module FROM ms)
 UNION ALL SELECT module, 'decisions', 'no decision evidence' FROM m WHERE module NOT IN (SELECT module FROM dc)""")
def precheck_pages(d: Data):
    s = d("symbols")
    at = s.select("file", "module").distinct()
    known = s.select("module").distinct()
    sequences = q_graph.flow_edges(d).filter("is_entry").select(F.col("caller_file").alias("file")).distinct().join(at, "file")
    staged = q_graph.stages(d).select("file").join(at, "file")
    moved = q_graph.moves(d).select(F.col("caller_file").alias("file"), "carries").join(at, "file")
    every = moved.select("module", "carries").unionByName(known.withColumn("carries", F.lit(False)))  # a row for each module
    return Pg.precheck_pages(s.filter("label = 'Class'"), s.filter("docstring IS NOT NULL"), sequences, staged, every, d("commits").join(known, "module", "left_semi"))


def outline_tables(d: Data):
    """An outline per fifty documents: ten chapters of five pages with four files each."""
    k = F.col("doc_id")
    at = [F.floor(k / 50).alias("outline"), F.floor(k % 50 / 5).cast("int").alias("chapter_ord"), (k % 5).cast("int").alias("page_ord")]
    chapters = d("documents").filter("doc_id % 5 = 0").select(*at[:2], F.when(k % 30 == 10, "Bad Chapter").when(k % 50 == 20, "ch-0").otherwise(F.concat(F.lit("ch-"), F.floor(k % 50 / 5))).alias("chapter_id"), F.when(k % 35 == 15, " ").otherwise(F.concat(F.lit("Chapter "), F.floor(k % 50 / 5))).alias("title"))
    pages = d("documents").select(*at, F.when(k % 7 == 3, "Bad_Id").when(k % 11 == 4, "p-0").otherwise(F.concat(F.lit("p-"), k % 5)).alias("page_id"), F.when(k % 13 == 5, "").otherwise(F.concat(F.lit("Page "), k % 3)).alias("title"), F.when(k % 17 == 6, " ").otherwise(F.col("source")).alias("brief"))
    file = lambda i: F.expr(path_of(f"(doc_id + {i})"))
    listed = F.array(*[F.struct(F.lit(i).alias("file_ord"), (F.concat(file(i), F.lit(".gone")) if i == 3 else F.when((k % 9 == 2) & F.lit(i > 1), F.concat(file(i), F.lit(".gone"))).otherwise(file(i))).alias("file")) for i in range(4)])
    files = d("documents").select(*at, F.inline(listed))
    return chapters, pages, files


def _outline_cte() -> str:
    paths = " ".join(f"UNION ALL SELECT doc_id, {i}, {path_of(f'(doc_id + {i})')} || CASE WHEN {i} = 3 OR (doc_id % 9 = 2 AND {i} > 1) THEN '.gone' ELSE '' END FROM documents" for i in range(1, 4))
    return f"""WITH pf AS (SELECT doc_id, 0 AS o, {path_of('doc_id')} AS file FROM documents {paths}), nf AS (SELECT doc_id, count(DISTINCT file) AS n FROM pf WHERE file IN (SELECT path FROM files WHERE NOT {D.is_test('path')}) GROUP BY 1),
 p0 AS (SELECT d.doc_id, CAST(floor(d.doc_id / 50) AS BIGINT) AS outline, CAST(floor(d.doc_id % 50 / 5) AS INT) AS chapter_ord, CAST(d.doc_id % 5 AS INT) AS page_ord, CASE WHEN d.doc_id % 7 = 3 THEN 'Bad_Id' WHEN d.doc_id % 11 = 4 THEN 'p-0' ELSE 'p-' || d.doc_id % 5 END AS page_id,
  CASE WHEN d.doc_id % 13 = 5 THEN '' ELSE 'Page ' || d.doc_id % 3 END AS title, CASE WHEN d.doc_id % 7 = 3 THEN 'bad id' WHEN d.doc_id % 13 = 5 THEN 'no title' WHEN d.doc_id % 17 = 6 THEN 'no brief' WHEN coalesce(n, 0) < 3 THEN 'too few files' END AS bad FROM documents d LEFT JOIN nf ON nf.doc_id = d.doc_id),
 p1 AS (SELECT * REPLACE (CASE WHEN bad IS NULL AND row_number() OVER (PARTITION BY outline, chapter_ord, bad IS NULL, page_id ORDER BY page_ord) > 1 THEN 'duplicate id' ELSE bad END AS bad) FROM p0), p2 AS (SELECT *, count(*) FILTER (bad IS NULL) OVER (PARTITION BY outline, chapter_ord ORDER BY page_ord) AS nth FROM p1),
 c0 AS (SELECT CAST(floor(doc_id / 50) AS BIGINT) AS outline, CAST(floor(doc_id % 50 / 5) AS INT) AS chapter_ord, CASE WHEN doc_id % 30 = 10 THEN 'Bad Chapter' WHEN doc_id % 50 = 20 THEN 'ch-0' ELSE 'ch-' || CAST(floor(doc_id % 50 / 5) AS INT) END AS chapter_id, doc_id % 35 = 15 AS untitled FROM documents WHERE doc_id % 5 = 0),
 c1 AS (SELECT c.*, least(6, (SELECT count(*) FROM p2 p WHERE p.outline = c.outline AND p.chapter_ord = c.chapter_ord AND p.bad IS NULL)) AS usable FROM c0 c),
 c2 AS (SELECT *, CASE WHEN chapter_id = 'Bad Chapter' THEN 'bad chapter id' WHEN untitled THEN 'no chapter title' WHEN usable = 0 THEN 'no valid page' END AS w FROM c1),
 c3 AS (SELECT * REPLACE (CASE WHEN w IS NULL AND row_number() OVER (PARTITION BY outline, w IS NULL, chapter_id ORDER BY chapter_ord) > 1 THEN 'duplicate chapter id' ELSE w END AS w) FROM c2),
 c4 AS (SELECT *, 16 - coalesce(sum(CASE WHEN w IS NULL THEN usable ELSE 0 END) OVER (PARTITION BY outline ORDER BY chapter_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lp, count(*) FILTER (w IS NULL) OVER (PARTITION BY outline ORDER BY chapter_ord) AS cn FROM c3),
 r AS (SELECT p.outline, p.chapter_ord, c.chapter_id, p.page_ord, p.page_id, p.title, CASE WHEN w IS NOT NULL THEN w WHEN cn > 8 THEN 'too many chapters' WHEN lp <= 0 THEN 'no valid page' WHEN nth - CASE WHEN bad IS NULL THEN 1 ELSE 0 END >= lp THEN 'too many pages' WHEN nth - CASE WHEN bad IS NULL THEN 1 ELSE 0 END >= 6 THEN 'too many chapter pages' ELSE bad END AS reason
  FROM p2 p JOIN c4 c ON c.outline = p.outline AND c.chapter_ord = p.chapter_ord)"""


@query("validate_outline", f"{_outline_cte()} SELECT outline, chapter_ord, chapter_id, page_ord, page_id, title, reason IS NULL AS kept, reason FROM r")
def validate_outline(d: Data):
    chapters, pages, files = outline_tables(d)
    return O.outline_pages(chapters, pages, files, d("files"))


@query("outline_warnings")
def outline_warnings(d: Data):
    chapters, pages, files = outline_tables(d)
    kept = O.outline_pages(chapters, pages, files, d("files"))
    refs = pages.select("outline", "chapter_ord", "page_ord", (F.length("title") % 2 == 0).alias("known"))
    return O.outline_warnings(kept, chapters, files, refs, d("files"), d("files").select("path", "module"))
