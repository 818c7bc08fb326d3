"""Queries: rankings, samples and top lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import text as X
from codeloom.operators import aggregate as G, evidence as V, joins as J, ranking as R
from codeloom.plans import duck as D
from codeloom.plans.catalog import ORACLES, Data, query
from codeloom.plans.q_aggs import BOUNDARIES, CALLS, _inner
from codeloom.plans.q_code import EVIDENCE_SQL
from codeloom.plans.q_docs import FILE_ANCHORS, PAGE_FILES, page_files
from codeloom.plans.q_joins import FAN_IN, calls, fan_in


def ranked(d: Data):
    path = F.col("path")
    files = d("files").filter(~X.is_test_path(path) & X.language_domain(path).isNotNull())
    edges = calls(d)
    inc = edges.groupBy(F.col("callee_file").alias("file")).agg(F.count("*").alias("n"))
    syms = G.symbol_count(d("symbols")).withColumnRenamed("symbols", "n")
    churn = d("commits").filter("NOT is_merge").groupBy("file").agg(F.count("*").alias("n"))
    entry = d("symbols").filter("is_exported AND label = 'Class'").select("file")
    edge_modules = G.module_boundaries(edges).filter("call_count >= 30")
    boundary = edge_modules.select(F.col("from_module").alias("module")).union(edge_modules.select("to_module"))
    docs = J.docs_mentions(d("files"), d("md_lines")).select(path.alias("file"))
    tested = J.test_pairs(d("files")).select(path.alias("file"))
    return R.rank_files(files, inc, syms, churn, entry, boundary, tested, docs)


def _norm(v: str, table: str) -> str:
    return f"CASE WHEN coalesce({v}, 0) > 0 THEN log2(1 + {v}) / log2(1 + (SELECT max(n) FROM {table})) ELSE 0.0 END"


RANKED = f"""(WITH fi AS (SELECT callee_file AS file, count(*) AS n FROM {CALLS} c GROUP BY 1), sy AS (SELECT file, count(*) AS n FROM symbols WHERE NOT is_test GROUP BY 1), ch AS (SELECT file, count(*) AS n FROM commits WHERE NOT is_merge GROUP BY 1),
 bo AS (SELECT from_module AS module FROM {BOUNDARIES} b WHERE call_count >= 30 UNION SELECT to_module FROM {BOUNDARIES} b WHERE call_count >= 30),
 f AS (SELECT f.path, f.size, coalesce(fi.n, 0) AS fan_in, coalesce(sy.n, 0) AS symbols, coalesce(ch.n, 0) AS churn, CASE WHEN f.path IN (SELECT file FROM symbols WHERE is_exported AND label = 'Class') THEN 1 ELSE 0 END AS entry,
  CASE WHEN f.path IN (SELECT path FROM {_inner('test_pairs')} t) THEN 1 ELSE 0 END AS tested, CASE WHEN f.path IN (SELECT path FROM {_inner('docs_mentions')} t) THEN 1 ELSE 0 END AS docs, CASE WHEN f.module IN (SELECT module FROM bo) THEN 1 ELSE 0 END AS boundary
  FROM files f LEFT JOIN fi ON fi.file = f.path LEFT JOIN sy ON sy.file = f.path LEFT JOIN ch ON ch.file = f.path WHERE NOT {D.is_test('f.path')} AND {D.domain('f.path')} IS NOT NULL)
 SELECT *, round(4 * {_norm('fan_in', 'fi')} + 3 * entry + 2 * boundary + 1 * {_norm('symbols', 'sy')} + 2 * tested + 1 * docs + 2 * {_norm('churn', 'ch')}, 9) AS score FROM f)"""


@query("rank_files", f"SELECT path, size, fan_in, symbols, churn, entry, tested, docs, boundary, round(score, 6) AS score FROM {RANKED} r")
def rank_files(d: Data):
    return ranked(d).drop("module").withColumn("score", F.round("score", 6))


@query("rank_stats", f"SELECT count(*) FILTER (entry = 1) AS top_entry, count(*) FILTER (tested = 1) AS top_tested, (SELECT count(*) FROM {RANKED} r) AS total FROM (SELECT * FROM {RANKED} r ORDER BY score DESC, size DESC, path LIMIT 30) t")
def rank_stats(d: Data):
    return R.rank_stats(ranked(d))


SAMPLE = f"""(WITH c AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY complexity DESC, file, start_line, id) AS c FROM symbols WHERE NOT is_test AND (docstring IS NOT NULL OR complexity > 0) AND label IN ('Class', 'Function', 'Method')),
 u AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY module, file, name, start_line ORDER BY c) = 1),
 s AS (SELECT *, complexity + CASE WHEN coalesce(docstring, '') <> '' THEN 4 ELSE 0 END + CASE WHEN name IN (SELECT name FROM (SELECT * FROM {FAN_IN} f ORDER BY fan_in DESC, id LIMIT 15) h) THEN 8 ELSE 0 END AS score FROM u),
 r AS (SELECT *, row_number() OVER (PARTITION BY module, file ORDER BY score DESC, name, start_line, id) AS rnd, max(score) OVER (PARTITION BY module, file) AS best FROM s QUALIFY rnd <= 5)
 SELECT module, row_number() OVER (PARTITION BY module ORDER BY rnd, best DESC, file) AS place, id, name, file, score FROM r QUALIFY place <= 10)"""


def sample(d: Data):
    hot = fan_in(d).orderBy(F.col("fan_in").desc(), "id").limit(15)
    return R.fair_sample(d("symbols"), hot)


@query("fair_sample", f"SELECT * FROM {SAMPLE} s")
def fair_sample(d: Data):
    return sample(d)


@query("representative_files", f"""SELECT f.module, row_number() OVER (PARTITION BY f.module ORDER BY p.place NULLS LAST, f.path) AS rank, f.path FROM files f LEFT JOIN (SELECT module, file, min(place) AS place FROM {SAMPLE} s GROUP BY 1, 2) p ON p.module = f.module AND p.file = f.path QUALIFY rank <= 12""")
def representative_files(d: Data):
    return R.representative_files(d("files"), sample(d))


def evidence_candidates(d: Data):
    """Files of a page by source: cited, defining a symbol of the page's module, or its own configuration."""
    cited = page_files(d).select("page", "file", F.lit(1).alias("tier"))
    doc = d("files").select(F.concat(F.lit("p"), "doc_id").alias("page"), "module", "path")
    defined = doc.join(d("symbols").filter("NOT is_test AND complexity > 40").select("module", "file").distinct(), "module").select("page", "file", F.lit(2).alias("tier"))
    own = doc.select("page", F.col("path").alias("file"), F.when(F.col("path").endswith(".json"), 5).otherwise(4).alias("tier"))
    return cited.unionByName(defined).unionByName(own)


CANDIDATES = f"""(SELECT page, file, 1 AS tier FROM {PAGE_FILES} p UNION ALL SELECT 'p' || f.doc_id, s.file, 2 FROM files f JOIN (SELECT DISTINCT module, file FROM symbols WHERE NOT is_test AND complexity > 40) s ON s.module = f.module
 UNION ALL SELECT 'p' || doc_id, path, CASE WHEN path LIKE '%.json' THEN 5 ELSE 4 END FROM files)"""


@query("rank_evidence", f"SELECT page, file, tier, row_number() OVER (PARTITION BY page ORDER BY tier, file) AS rank FROM (SELECT page, file, min(tier) AS tier FROM {CANDIDATES} c GROUP BY 1, 2) t")
def rank_evidence(d: Data):
    return R.rank_evidence(evidence_candidates(d))


@query("evidence_files", f"SELECT page, file, row_number() OVER (PARTITION BY page ORDER BY file) AS rank FROM {PAGE_FILES} p")
def evidence_files(d: Data):
    return R.evidence_files(page_files(d), d("files"))


@query("thin_pages", f"SELECT m.page, coalesce(n, 0) AS n FROM (SELECT DISTINCT page FROM md_lines) m LEFT JOIN (SELECT page, count(*) AS n FROM {PAGE_FILES} p GROUP BY 1) c ON c.page = m.page WHERE coalesce(n, 0) < 3")
def thin_pages(d: Data):
    return R.thin_pages(R.evidence_files(page_files(d), d("files")), d("md_lines"))


@query("supplemental_symbols", "SELECT id, name, file, complexity FROM symbols WHERE NOT is_test AND label IN ('Class', 'Method', 'Function') ORDER BY complexity DESC, id LIMIT 8")
def supplemental_symbols(d: Data):
    return R.supplemental_symbols(d("symbols"))


@query("dedupe_by_anchor", "SELECT min(event_id) AS event_id, event_type AS kind, file AS anchor FROM commits JOIN events USING (event_id) GROUP BY 2, 3")
def dedupe_by_anchor(d: Data):
    rows = d("commits").join(d("events").select("event_id", F.col("event_type").alias("kind")), "event_id").select("event_id", "kind", F.col("file").alias("anchor"))
    return V.dedupe_by_anchor(rows, ["event_id"])


def module_evidence(d: Data):
    """File headers, first commit and themes of every module, in that order."""
    heads = V.file_headers(d("code_lines").filter(~X.is_test_path(F.col("path")) & X.language_domain(F.col("path")).isNotNull()))
    heads = heads.withColumn("module", F.regexp_extract("file", r"/(m\d+)/", 1)).select("module", "kind", "file", "line_no", "text", "anchor", F.lit(1).alias("tier"))
    line = d("commits").filter("NOT is_merge")
    first = line.groupBy("module").agg(F.min(F.struct("date", "hash", "subject")).alias("f"))
    first = first.select("module", F.lit("git-commit").alias("kind"), F.lit("").alias("file"), F.lit(0).alias("line_no"), F.concat(F.lit("首次提交："), "f.subject").alias("text"), X.commit_anchor(F.col("f.hash"), F.col("f.date")).alias("anchor"), F.lit(2).alias("tier"))
    themes = G.module_timeline(d("commits")).filter("themes IS NOT NULL").select(
        "module", F.lit("git-theme").alias("kind"), F.lit("").alias("file"), F.lit(0).alias("line_no"), F.concat(F.lit("高频提交主题："), "themes").alias("text"), F.col("module").alias("anchor"), F.lit(3).alias("tier"))
    return heads.unionByName(first).unionByName(themes)


MODULE_EVIDENCE = rf"""(SELECT regexp_extract(file, '/(m\d+)/', 1) AS module, kind, file, line_no, text, anchor, 1 AS tier FROM {EVIDENCE_SQL} e WHERE kind = 'file-header'
 UNION ALL SELECT module, 'git-commit', '', 0, '首次提交：' || arg_min(subject, date || hash), arg_min('commit:' || substr(hash, 1, 8) || ' (' || date || ')', date || hash), 2 FROM commits WHERE NOT is_merge GROUP BY module
 UNION ALL SELECT module, 'git-theme', '', 0, '高频提交主题：' || themes, module, 3 FROM {_inner('module_timeline')} t WHERE themes IS NOT NULL)"""


@query("module_evidence_top", f"SELECT *, row_number() OVER (PARTITION BY module ORDER BY tier, file, line_no, kind, anchor) AS rank FROM {MODULE_EVIDENCE} e QUALIFY rank <= 6")
def module_evidence_top(d: Data):
    return R.evidence_top(module_evidence(d), "module", 6)


@query("page_evidence_top", f"""SELECT p.page, e.kind, e.file, e.line_no, e.text, e.anchor, 1 AS tier, row_number() OVER (PARTITION BY p.page ORDER BY e.file, e.line_no, e.kind, e.anchor) AS rank FROM {PAGE_FILES} p JOIN {EVIDENCE_SQL} e ON e.file = p.file
 QUALIFY rank <= 14""")
def page_evidence_top(d: Data):
    rows = page_files(d).join(V.comment_evidence(d("code_lines")), "file").select("page", "kind", "file", "line_no", "text", "anchor", F.lit(1).alias("tier"))
    return R.evidence_top(rows, "page", 14)


@query("why_marker_sample", f"SELECT kind, file, line_no, symbol, text, anchor FROM {EVIDENCE_SQL} e WHERE kind = 'why-marker' ORDER BY file, line_no LIMIT 8")
def why_marker_sample(d: Data):
    return V.why_marker_sample(V.comment_evidence(d("code_lines")), 8)


def topic_evidence(d: Data):
    """Symbols and cross-module calls of every module as evidence of a topic."""
    syms = d("symbols").select(F.col("module").alias("topic"), F.lit("symbol").alias("kind"), F.concat("name", F.lit("#"), "id").alias("name"), F.concat_ws(":", "file", "start_line").alias("anchor"))
    bounds = G.module_boundaries(calls(d)).select(F.col("from_module").alias("topic"), F.lit("boundary").alias("kind"), F.concat("from_module", F.lit("→"), "to_module").alias("name"), F.concat("from_module", F.lit("→"), "to_module").alias("anchor"))
    return syms.unionByName(bounds)


TOPIC_IDS = f"""(SELECT topic, kind, name, anchor, 'E' || row_number() OVER (PARTITION BY topic ORDER BY CASE kind WHEN 'symbol' THEN 0 ELSE 2 END, anchor, name) AS id FROM (
 SELECT module AS topic, 'symbol' AS kind, name || '#' || id AS name, file || ':' || start_line AS anchor FROM symbols UNION ALL SELECT from_module, 'boundary', from_module || '→' || to_module, from_module || '→' || to_module FROM {BOUNDARIES} b) t)"""


@query("assign_evidence_ids", f"SELECT * FROM {TOPIC_IDS} t")
def assign_evidence_ids(d: Data):
    return R.assign_evidence_ids(topic_evidence(d))


@query("hot_functions", "SELECT id, name, file, complexity FROM symbols WHERE NOT is_test AND complexity > 3 AND label IN ('Method', 'Function') ORDER BY complexity DESC, id LIMIT 20")
def hot_functions(d: Data):
    return R.hot_functions(d("symbols"))


@query("exported_functions", "SELECT id, name, file, complexity FROM symbols WHERE NOT is_test AND is_exported AND label IN ('Method', 'Function') ORDER BY complexity DESC, id LIMIT 15")
def exported_functions(d: Data):
    return R.exported_functions(d("symbols"))


GLOSSARY = """(WITH t AS (SELECT *, CASE label WHEN 'Class' THEN 0 WHEN 'Method' THEN 1 WHEN 'Function' THEN 2 ELSE 3 END AS o FROM symbols WHERE NOT is_test AND docstring IS NOT NULL),
 u AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY name ORDER BY o, complexity DESC, id) = 1) SELECT name, id, complexity FROM u ORDER BY o, complexity DESC, id LIMIT 30)"""


@query("glossary", f"SELECT * FROM {GLOSSARY} g")
def glossary(d: Data):
    return R.glossary(d("symbols"))


@query("planner_symbols", "SELECT id, name, file, complexity FROM symbols WHERE NOT is_test AND docstring IS NOT NULL AND label IN ('Class', 'Method', 'Function') ORDER BY complexity DESC, id LIMIT 60")
def planner_symbols(d: Data):
    return R.planner_symbols(d("symbols"))


@query("candidate_files", """WITH t AS (SELECT source AS module, path, 0 AS o FROM files WHERE doc_id % 4 > 0), u AS (SELECT '' AS module, path, 1 AS o FROM files WHERE doc_id % 4 = 0)
 SELECT module, path FROM (SELECT * FROM t UNION ALL SELECT * FROM u) x""")
def candidate_files(d: Data):
    return R.candidate_files(d("files").select(F.when(F.col("doc_id") % 4 > 0, F.col("source")).alias("module"), "path"))
