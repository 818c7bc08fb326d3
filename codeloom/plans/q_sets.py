"""Queries: set overlap, set operations and page relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import vocab
from codeloom.operators import extract_docs as M, similarity as S
from codeloom.plans import duck as D
from codeloom.plans.catalog import Data, query
from codeloom.plans.q_code import PROD
from codeloom.plans.q_docs import ANCHORS, NUMERIC, PAGE_FILES, TABLES, TERMS, page_files
from codeloom.session import fixed_table

LINKED = "(SELECT 'p' || doc_id AS a, 'p' || (doc_id + 1) AS b FROM documents UNION SELECT 'p' || (doc_id + 1), 'p' || doc_id FROM documents)"


def linked_pages(d: Data):
    """Pages and their successors, both ways."""
    here, after = F.concat(F.lit("p"), "doc_id"), F.concat(F.lit("p"), F.col("doc_id") + 1)
    return d("documents").select(F.inline(F.array(F.struct(here.alias("a"), after.alias("b")), F.struct(after.alias("a"), here.alias("b"))))).distinct()


@query("jaccard_given", """WITH n AS (SELECT doc_id, count(*) AS n FROM doc_words GROUP BY 1), s AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM doc_words x JOIN doc_words y ON y.word = x.word AND y.doc_id = x.doc_id + 1 GROUP BY 1, 2)
 SELECT d.doc_id AS a, d.doc_id + 1 AS b, coalesce(shared, 0) AS shared, round(coalesce(shared / (na.n + nb.n - shared), 0), 6) AS jaccard FROM documents d LEFT JOIN s ON s.a = d.doc_id LEFT JOIN n na ON na.doc_id = d.doc_id LEFT JOIN n nb ON nb.doc_id = d.doc_id + 1""")
def jaccard_given(d: Data):
    pairs = d("documents").select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b"))
    return S.jaccard(pairs, d("doc_words"), "doc_id", "word")


def _groups_sql(members: str, key: str, element: str, cond: str) -> str:
    """Brute force over distinct sets: first owner and owner count of both sides."""
    return f"""WITH m AS (SELECT DISTINCT {key} AS k, {element} AS e FROM {members} x), g AS (SELECT k, string_agg(e, chr(1) ORDER BY e) AS sig, count(*) AS n FROM m GROUP BY 1),
 s AS (SELECT sig, n, min(k) AS k, count(*) AS owners FROM g GROUP BY 1, 2), p AS (SELECT x.k AS a, y.k AS b, count(*) AS shared FROM s x JOIN m mx ON mx.k = x.k JOIN m my ON my.e = mx.e JOIN s y ON y.k = my.k WHERE x.k < y.k GROUP BY 1, 2)
 SELECT a AS first_a, b AS first_b, x.owners AS owners_a, y.owners AS owners_b, round(shared / (x.n + y.n - shared), 6) AS jaccard FROM p JOIN s x ON x.k = a JOIN s y ON y.k = b WHERE shared / (x.n + y.n - shared) {cond}
 UNION ALL SELECT k, k, owners, owners, 1.0 FROM s WHERE owners > 1"""


@query("jaccard_pairs", _groups_sql("doc_words", "doc_id", "word", ">= 0.6 - 1e-12"))
def jaccard_pairs(d: Data):
    return S.overlap_groups(d("doc_words"), "doc_id", "word", 0.6)


@query("page_overlaps", _groups_sql("(SELECT l_orderkey, CAST(floor(l_partkey / 4) AS BIGINT) AS part FROM lineitem)", "l_orderkey", "CAST(part AS VARCHAR)", "> 0.5"))
def page_overlaps(d: Data):
    sets = d("lineitem").select("l_orderkey", F.floor(F.col("l_partkey") / 4).cast("string").alias("part"))
    return S.overlap_groups(sets, "l_orderkey", "part", 0.5, strict=True)


@query("anchor_overlap", _groups_sql(f"(SELECT * FROM {ANCHORS} a WHERE page IN (SELECT page FROM {ANCHORS} b GROUP BY 1 HAVING count(*) >= 3))", "page", "anchor", ">= 0.7 - 1e-12"))
def anchor_overlap(d: Data):
    anchors = M.evidence_anchors(d("md_lines"))
    enough = anchors.groupBy("page").agg(F.count("*").alias("n")).filter("n >= 3")
    return S.overlap_groups(anchors.join(enough, "page", "left_semi"), "page", "anchor", 0.7)


FIRST = f"""(SELECT DISTINCT t.page, t.table_line, h.header, t.cells[1] AS value FROM {TABLES} t JOIN (SELECT page, table_line, array_to_string(cells, '|') AS header FROM {TABLES} x WHERE row_no = 0) h USING (page, table_line) WHERE row_no > 0 AND t.cells[1] <> '')"""


@query("table_overlap", f"""WITH c AS {FIRST}, n AS (SELECT page, table_line, count(*) AS n FROM c GROUP BY 1, 2), s AS (SELECT l.a, x.table_line AS ta, l.b, y.table_line AS tb, count(*) AS shared FROM {LINKED} l JOIN c x ON x.page = l.a JOIN c y ON y.page = l.b AND y.header = x.header AND y.value = x.value GROUP BY 1, 2, 3, 4)
 SELECT a, b, round(max(shared / (na.n + nb.n - shared)), 6) AS overlap, round(max(shared / (na.n + nb.n - shared)), 6) >= 0.5 AS duplicated FROM s JOIN n na ON na.page = a AND na.table_line = ta JOIN n nb ON nb.page = b AND nb.table_line = tb GROUP BY 1, 2""")
def table_overlap(d: Data):
    return S.table_overlap(M.first_columns(d("md_lines")), linked_pages(d))


EVIDENCE_TABLES = f"""(SELECT page, table_line, cells[4] AS anchor FROM {TABLES} t WHERE row_no > 0 AND len(cells) = 4 AND contains(cells[4], ':') AND (page, table_line) IN (SELECT (page, table_line) FROM {TABLES} h WHERE row_no = 0 AND array_to_string(cells, '|') = '证据|类型|目标|锚点'))"""


def evidence_tables(d: Data):
    rows = M.table_rows(d("md_lines"))
    heads = rows.filter((F.col("row_no") == 0) & (F.array_join("cells", "|") == "|".join(vocab.INTENT_HEADER))).select("page", "table_line")
    return rows.filter("row_no > 0").join(heads, ["page", "table_line"], "left_semi").select("page", "table_line", F.try_element_at("cells", F.lit(4)).alias("anchor")).filter(F.col("anchor").contains(":"))


@query("containment", f"""SELECT page, table_line, count(*) AS size, count(*) FILTER (hit) AS covered, count(*) FILTER (hit) / count(*) >= 0.7 AS fold FROM (SELECT DISTINCT page, table_line, anchor, anchor IN (SELECT anchor FROM {EVIDENCE_TABLES} b WHERE CAST(substr(page, 2) AS INT) % 2 = 0) AS hit FROM {EVIDENCE_TABLES} e) t GROUP BY 1, 2""")
def containment(d: Data):
    tables = evidence_tables(d)
    return S.containment(tables, tables.filter("CAST(substr(page, 2) AS INT) % 2 = 0"), ["page", "table_line"], "anchor")


AFFINITY = f"""(SELECT coalesce(f.a, t.a) AS a, coalesce(f.b, t.b) AS b, coalesce(f.n, 0) AS shared_files, coalesce(t.n, 0) AS shared_terms FROM (SELECT l.a, l.b, count(*) AS n FROM {LINKED} l JOIN {PAGE_FILES} x ON x.page = l.a JOIN {PAGE_FILES} y ON y.page = l.b AND y.file = x.file GROUP BY 1, 2) f
 FULL JOIN (SELECT l.a, l.b, count(*) AS n FROM {LINKED} l JOIN {TERMS} x ON x.page = l.a JOIN {TERMS} y ON y.page = l.b AND y.term = x.term GROUP BY 1, 2) t ON f.a = t.a AND f.b = t.b)"""


def affinities(d: Data):
    return S.affinity(page_files(d), M.extract_terms(d("md_lines")), linked_pages(d))


@query("affinity", f"SELECT * FROM {AFFINITY} a")
def affinity(d: Data):
    return affinities(d)


@query("related_links", f"""WITH p AS (SELECT 'p' || doc_id AS page, doc_id % 5 AS dir FROM documents WHERE doc_id % 7 > 0), c AS (SELECT 'p' || doc_id AS a, 'p' || (doc_id + 2) AS b FROM documents WHERE doc_id % 10 = 0), cc AS (SELECT a, b FROM c UNION SELECT b, a FROM c),
 r AS (SELECT f.a, f.b, shared_files, shared_terms, row_number() OVER (PARTITION BY f.a ORDER BY shared_files + shared_terms DESC, f.b) AS rank FROM {AFFINITY} f JOIN p x ON x.page = f.a JOIN p y ON y.page = f.b WHERE x.dir <> y.dir AND (f.a, f.b) NOT IN (SELECT (a, b) FROM cc) QUALIFY rank <= 3)
 SELECT a, b, 0 AS tier, '互补职责' AS reason, 0 AS rank FROM cc WHERE b IN (SELECT page FROM p) UNION ALL SELECT a, b, 1, concat_ws('、', CASE WHEN shared_files > 0 THEN '共享 ' || shared_files || ' 个源文件' END, CASE WHEN shared_terms > 0 THEN '共享 ' || shared_terms || ' 个符号' END), rank FROM r""")
def related_links(d: Data):
    name = F.concat(F.lit("p"), "doc_id")
    planned = d("documents").filter("doc_id % 7 > 0").select(name.alias("page"), (F.col("doc_id") % 5).alias("dir"))
    complements = d("documents").filter("doc_id % 10 = 0").select(name.alias("a"), F.concat(F.lit("p"), F.col("doc_id") + 2).alias("b"))
    return S.related_links(affinities(d), complements, planned)


SAME = f"""(SELECT s.sequence, c.headers, c.pages, c.n, s.header, min(s.page) AS first_page, count(DISTINCT s.page) AS header_pages FROM {NUMERIC} s JOIN (SELECT sequence, count(DISTINCT header) AS headers, count(DISTINCT page) AS pages, max(n) AS n FROM {NUMERIC} x GROUP BY 1 HAVING count(DISTINCT header) >= 2) c ON c.sequence = s.sequence GROUP BY 1, 2, 3, 4, 5)"""


@query("same_numbers", f"SELECT * FROM {SAME} s")
def same_numbers(d: Data):
    return S.same_numbers(M.numeric_columns(d("md_lines")))


@query("test_only", f"""SELECT DISTINCT name FROM (SELECT path, regexp_extract(line, 'const ([A-Z_]+) =', 1) AS name FROM code_lines) t WHERE name <> '' AND {D.is_test('path')} AND name NOT IN (SELECT regexp_extract(line, 'const ([A-Z_]+) =', 1) FROM {PROD} p)""")
def test_only(d: Data):
    from codeloom.functions import text as X

    name = F.regexp_extract("line", "const ([A-Z_]+) =", 1)
    return S.test_only(d("code_lines").select(name.alias("name"), X.is_test_path(F.col("path")).alias("is_test")).filter("name <> ''"))


@query("merge_pinned", """WITH t AS (SELECT module AS id, 'T ' || module AS title, path AS file, doc_id FROM files), d AS (SELECT * FROM t WHERE doc_id < (SELECT count(*) FROM documents) / 2)
 SELECT id, title, file, false AS pinned FROM d UNION ALL SELECT id, title, file, true FROM t WHERE id NOT IN (SELECT id FROM d) AND doc_id % 3 = 0""")
def merge_pinned(d: Data):
    half = d("documents").agg((F.count("*") / 2).alias("h")).select("h").scalar()
    topics = d("files").select(F.col("module").alias("id"), F.concat(F.lit("T "), "module").alias("title"), F.col("path").alias("file"), "doc_id")
    locked = topics.withColumn("pinned", F.col("doc_id") % 3 == 0)
    gone = F.when(F.col("doc_id") % 6 == 1, F.concat("file", F.lit(".old"))).otherwise(F.col("file"))
    return S.merge_pinned(topics.filter(F.col("doc_id") < half), locked.withColumn("file", gone), d("files"))


@query("merge_stack", "SELECT DISTINCT dep AS package, 'production' AS scope FROM manifests WHERE kind = 'prod' UNION ALL SELECT DISTINCT dep, 'test' FROM manifests WHERE kind = 'dev' AND dep NOT IN (SELECT dep FROM manifests WHERE kind = 'prod')")
def merge_stack(d: Data):
    m = d("manifests").select(F.col("dep").alias("package"), "kind")
    return S.merge_stack(m.filter("kind = 'prod'"), m.filter("kind = 'dev'"))


REGISTRY = "(VALUES " + ", ".join(f"('{n}', '{t}', '{dd}', '{a}')" for n, t, dd, a in vocab.PAGE_REGISTRY) + ") r(name, tier, dir, purpose)"


def registry(d: Data):
    return fixed_table(d.spark, "name, tier, dir, purpose", vocab.PAGE_REGISTRY)


def planned_names(d: Data):
    """Registered pages for the first documents, then one topic or chapter page per document."""
    names = [n for n, *_ in vocab.PAGE_REGISTRY]
    table = F.array(*[F.lit(n) for n in names])
    dynamic = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("topic:t"), "doc_id")).otherwise(F.concat(F.lit("chapter:c"), F.col("doc_id") % 8, F.lit("/p"), "doc_id"))
    return d("documents").select(F.coalesce(F.when(F.col("doc_id") % 3 > 0, F.try_element_at(table, (F.col("doc_id") + 1).cast("int"))), dynamic).alias("page"))


_NAMES = "[" + ", ".join(f"'{n}'" for n, *_ in vocab.PAGE_REGISTRY) + "]"
PLANNED = f"(SELECT coalesce(CASE WHEN doc_id % 3 > 0 THEN {_NAMES}[doc_id + 1] END, CASE WHEN doc_id % 2 = 0 THEN 'topic:t' || doc_id ELSE 'chapter:c' || doc_id % 8 || '/p' || doc_id END) AS page FROM documents)"


@query("readme_index", f"""SELECT CASE WHEN dir = '' THEN name || '.md' ELSE dir || '/' || name || '.md' END AS rel_path, dir, tier, purpose FROM {REGISTRY} WHERE name <> 'readme' AND name IN (SELECT page FROM {PLANNED} p)
 UNION ALL SELECT '08-topics/' || substr(page, 7) || '.md', '08-topics', 'structure', '仓库专属主题（图谱聚类推导）' FROM {PLANNED} p WHERE page LIKE 'topic:%'
 UNION ALL SELECT '09-chapters/' || substr(page, 9) || '.md', '09-chapters/' || regexp_extract(page, ':([^/]*)/', 1), 'structure', '仓库专属章节页（outline.json 锁定）' FROM {PLANNED} p WHERE page LIKE 'chapter:%'""")
def readme_index(d: Data):
    from codeloom.operators.pages import readme_index as run

    return run(registry(d), planned_names(d))


@query("pages_to_build", f"""WITH a AS (SELECT name AS page FROM {REGISTRY} WHERE tier <> 'surface' UNION SELECT 'routes' UNION SELECT 'db-schema' UNION SELECT page FROM {PLANNED} p WHERE page LIKE 'topic:%' OR page LIKE 'chapter:%'),
 legal AS (SELECT name AS page FROM {REGISTRY} UNION SELECT page FROM {PLANNED} p WHERE page LIKE 'topic:%' OR page LIKE 'chapter:%'), q AS (SELECT DISTINCT CASE WHEN doc_id % 5 = 0 THEN 'nope' || doc_id WHEN doc_id % 5 = 1 THEN {_NAMES}[doc_id % 26 + 1] ELSE 'topic:t' || doc_id END AS page FROM documents),
 v AS (SELECT page FROM q WHERE page IN (SELECT page FROM legal)) SELECT page FROM v UNION ALL SELECT page FROM a WHERE NOT EXISTS (SELECT 1 FROM v)""")
def pages_to_build(d: Data):
    from codeloom.operators.pages import pages_to_build as run

    table = F.array(*[F.lit(n) for n, *_ in vocab.PAGE_REGISTRY])
    k = F.col("doc_id") % 5
    asked = F.when(k == 0, F.concat(F.lit("nope"), "doc_id")).when(k == 1, F.element_at(table, (F.col("doc_id") % 26 + 1).cast("int"))).otherwise(F.concat(F.lit("topic:t"), "doc_id"))
    dynamic = planned_names(d).filter("page LIKE 'topic:%' OR page LIKE 'chapter:%'")
    return run(registry(d), dynamic, "backend", d("documents").select(asked.alias("page")).distinct())
