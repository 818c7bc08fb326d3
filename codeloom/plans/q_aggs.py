"""Queries: aggregations over graph, commits, claims and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import vocab
from codeloom.operators import aggregate as G, evidence as V, extract_code as E, extract_web as Wb, joins as J, lines as L
from codeloom.plans import duck as D
from codeloom.plans.catalog import ORACLES, Data, query
from codeloom.plans.q_code import EVIDENCE_SQL
from codeloom.plans.q_joins import SYM_EDGES, VERDICTS, absent_names, calls

CALLS = f"(SELECT * FROM {SYM_EDGES} s WHERE type = 'CALLS')"


def _degree_sql(level: str) -> str:
    return f"SELECT {level}, sum(i) AS fan_in, sum(o) AS fan_out FROM (SELECT caller_{level} AS {level}, 0 AS i, 1 AS o FROM {CALLS} c UNION ALL SELECT callee_{level}, 1, 0 FROM {CALLS} c) t GROUP BY 1"


@query("fan_in_out_symbols", _degree_sql("name"))
def fan_in_out_symbols(d: Data):
    return G.degrees(calls(d), "name")


@query("fan_in_out_files", _degree_sql("file"))
def fan_in_out_files(d: Data):
    return G.degrees(calls(d), "file")


@query("fan_in_out_modules", _degree_sql("module"))
def fan_in_out_modules(d: Data):
    return G.degrees(calls(d), "module")


@query("symbol_count", "SELECT file, count(*) AS symbols FROM symbols WHERE NOT is_test GROUP BY 1")
def symbol_count(d: Data):
    return G.symbol_count(d("symbols"))


BOUNDARIES = f"(SELECT caller_module AS from_module, callee_module AS to_module, count(*) AS call_count FROM {CALLS} c WHERE caller_module <> callee_module GROUP BY 1, 2)"


@query("module_boundaries", f"SELECT * FROM {BOUNDARIES} b")
def module_boundaries(d: Data):
    return G.module_boundaries(calls(d))


@query("top_callers", f"SELECT caller_name AS name, caller_file AS file, count(*) AS calls FROM {CALLS} c GROUP BY 1, 2 ORDER BY calls DESC, name, file LIMIT 15")
def top_callers(d: Data):
    return G.top_callers(calls(d))


@query("graph_profile", f"""SELECT 'nodes' AS what, 'total' AS key, count(*) AS n FROM symbols UNION ALL SELECT 'edges', 'total', count(*) FROM edges UNION ALL SELECT 'node_label', label, count(*) FROM symbols GROUP BY 2
 UNION ALL SELECT 'edge_type', type, count(*) FROM edges GROUP BY 2 UNION ALL SELECT 'language', {D.language('path')}, count(*) FROM files GROUP BY 2""")
def graph_profile(d: Data):
    return G.graph_profile(d("symbols"), d("edges"), d("files"))


_ANCHOR = "'commit:' || substr(hash, 1, 8) || ' (' || date || ')'"


@query("churn", f"SELECT file, count(*) AS commits, arg_max(subject, date || hash) AS subject, arg_max({_ANCHOR}, date || hash) AS anchor FROM commits WHERE NOT is_merge GROUP BY 1 ORDER BY commits DESC, file LIMIT 20")
def churn(d: Data):
    return G.churn(d("commits"))


@query("file_history", """SELECT file, count(*) AS commits, arg_min(hash, date || hash) AS first_hash, arg_min(subject, date || hash) AS first_subject, arg_max(hash, date || hash) AS last_hash,
 arg_max(subject, date || hash) AS last_subject, count(*) >= 200 AS long_log FROM commits WHERE NOT is_merge GROUP BY 1""")
def file_history(d: Data):
    return G.file_history(d("commits"))


def parents(d: Data):
    """Every commit follows its predecessor, but each thousandth starts a history."""
    return d("commits").filter("event_id % 1000 <> 0").select("hash")


@query("root_commits", "SELECT hash, date, subject FROM commits WHERE event_id % 1000 = 0")
def root_commits(d: Data):
    return G.root_commits(d("commits"), parents(d))


@query("oldest_in_window", "SELECT * FROM (SELECT hash, date, subject FROM commits) t ORDER BY date, hash LIMIT 1")
def oldest_in_window(d: Data):
    return G.oldest_in_window(d("commits"))


THEMES = f"""(SELECT module, theme, n, row_number() OVER (PARTITION BY module ORDER BY n DESC, theme) AS rank FROM (SELECT module, {D.subject('subject')} AS theme, count(*) AS n FROM commits WHERE NOT is_merge GROUP BY 1, 2) t WHERE length(theme) >= 4 AND n >= 2 QUALIFY rank <= 3)"""


@query("commit_themes", f"SELECT * FROM {THEMES} t")
def commit_themes(d: Data):
    return G.commit_themes(d("commits").filter("NOT is_merge"), "module")


@query("module_timeline", f"""SELECT b.*, t.themes FROM (SELECT module, count(*) AS commits, arg_min(subject, date || hash) AS first_subject, arg_max(subject, date || hash) AS last_subject, min(date) AS first_date, max(date) AS last_date
 FROM commits WHERE NOT is_merge GROUP BY 1) b LEFT JOIN (SELECT module, string_agg(theme || '（×' || n || '）', '、' ORDER BY rank) AS themes FROM {THEMES} t GROUP BY 1) t ON t.module = b.module""")
def module_timeline(d: Data):
    return G.module_timeline(d("commits"))


def modules(d: Data):
    """Modules with the numbers their importance needs."""
    nodes = d("symbols").groupBy("module").agg(F.count("*").alias("node_count"))
    files = d("files").groupBy("module").agg(F.count("*").alias("file_count"), F.min("doc_id").alias("ord"))
    out = files.join(nodes, "module", "left").join(G.degrees(calls(d), "module"), "module", "left")
    return out.na.fill(0, ["node_count", "fan_in", "fan_out"])


MODULES = f"""(SELECT f.module, f.file_count, f.ord, coalesce(n.node_count, 0) AS node_count, coalesce(d.fan_in, 0) AS fan_in, coalesce(d.fan_out, 0) AS fan_out FROM (SELECT module, count(*) AS file_count, min(doc_id) AS ord FROM files GROUP BY 1) f
 LEFT JOIN (SELECT module, count(*) AS node_count FROM symbols GROUP BY 1) n ON n.module = f.module LEFT JOIN ({_degree_sql('module')}) d ON d.module = f.module)"""


@query("module_importance", f"SELECT module, fan_in * 2 + fan_out + node_count + file_count AS importance, row_number() OVER (ORDER BY fan_in * 2 + fan_out + node_count + file_count DESC, ord) <= 12 AS detailed FROM {MODULES} m")
def module_importance(d: Data):
    return G.module_importance(modules(d))


SUPPORT = rf"""(SELECT page, count(*) AS factual, count(*) FILTER (regexp_matches(line, {D.rx(vocab.ANCHOR)}) OR regexp_matches(line, {D.rx(vocab.COMMIT_ANCHOR)}) OR regexp_matches(line, {D.rx(vocab.DOC_ANCHOR)}) OR contains(line, '推断')) AS supported
 FROM (SELECT page, trim(line) AS line FROM {D.OPEN_MD} o) l WHERE line <> '' AND NOT regexp_matches(line, '^#{{1,6}}\s') AND NOT regexp_matches(line, '^\|?[\s:|-]*\|?$') AND regexp_matches(line, '`[A-Za-z_$][A-Za-z0-9_$.-]{{2,}}`') GROUP BY 1)"""


@query("claim_support", f"SELECT *, factual >= 5 AND supported * 2 < factual AS weak FROM {SUPPORT} s")
def claim_support(d: Data):
    return G.claim_support(d("md_lines"))


#: pages with an evidence block of three files after the title
def block_lines(d: Data, lines=None):
    lines = d("md_lines") if lines is None else lines
    spaced = lines.select("page", (F.col("line_no") * 10).alias("line_no"), "line")
    doc = F.expr("CAST(substr(page, 2) AS BIGINT)")
    heads = lines.filter("line_no = 1").select("page", doc.alias("doc_id"))
    from codeloom.plans.fixtures import path_of

    body = F.array(F.lit("<details>"), F.lit(f"<summary>{vocab.SUMMARY}</summary>"), F.lit(""), *[F.concat(F.lit("- "), F.expr(path_of(f"(doc_id + {k})"))) for k in (0, 1, 5)], F.lit("</details>"))
    # every third page lists two files only
    block = heads.select("page", "doc_id", F.posexplode(body).alias("k", "line")).filter("NOT (k = 5 AND doc_id % 3 = 0)").select("page", (F.col("k") + 11).alias("line_no"), "line")
    return spaced.unionByName(block)


def _block_sql() -> str:
    from codeloom.plans.fixtures import path_of

    files = " UNION ALL ".join(f"SELECT page, {path_of(f'(doc_id + {k})')} AS file FROM h" + (" WHERE doc_id % 3 > 0" if k == 5 else "") for k in (0, 1, 5))
    return f"(WITH h AS (SELECT page, CAST(substr(page, 2) AS BIGINT) AS doc_id FROM md_lines WHERE line_no = 1) {files})"


CITED = rf"(SELECT DISTINCT page, file FROM (SELECT page, unnest(regexp_extract_all(line, {D.rx(G.CITED)}, 1)) AS file FROM md_lines) t WHERE regexp_matches(file, {D.rx(vocab.FILE_PATH)}) AND file IN (SELECT path FROM files))"
COVERAGE = f"""(SELECT page, count(*) FILTER (c) AS cited, count(*) FILTER (c AND b) AS covered, count(*) FILTER (c AND NOT b) AS missing, count(*) FILTER (NOT c) AS uncited, count(*) FILTER (b) AS listed FROM (
 SELECT page, file, bool_or(c) AS c, bool_or(NOT c) AS b FROM (SELECT page, file, true AS c FROM {CITED} x UNION ALL SELECT page, file, false FROM {_block_sql()} y) u GROUP BY 1, 2) v GROUP BY 1)"""


@query("evidence_coverage", f"SELECT * FROM {COVERAGE} c")
def evidence_coverage(d: Data):
    return G.evidence_coverage(block_lines(d), d("files"))


@query("intent_counts", f"SELECT file AS page, kind, count(*) AS n FROM {EVIDENCE_SQL} e GROUP BY 1, 2")
def intent_counts(d: Data):
    return V.intent_counts(V.comment_evidence(d("code_lines")).withColumnRenamed("file", "page"))


def _inner(name: str) -> str:
    """A registered oracle as a sub-select."""
    return f"({ORACLES[name]})"


@query("channel_stats", f"""SELECT verdict AS counter, count(*) AS n FROM (SELECT replace(verdict, '-', '_') AS verdict FROM {VERDICTS} v WHERE verdict <> 'ok') t GROUP BY 1
 UNION ALL SELECT 'components', count(*) FROM {_inner('component_facts')} c UNION ALL SELECT 'props', sum(props_count) FROM {_inner('component_facts')} c UNION ALL SELECT 'emits', sum(emits_count) FROM {_inner('component_facts')} c
 UNION ALL SELECT 'methods_resolved', count(*) FILTER (confidence = 'resolved') FROM {_inner('method_resolution')} m UNION ALL SELECT 'methods_ambiguous', count(*) FILTER (confidence = 'ambiguous') FROM {_inner('method_resolution')} m
 UNION ALL SELECT 'suspect', count(DISTINCT (name, side)) FILTER (verdict = 'suspect') FROM {_inner('verify_absence')} a UNION ALL SELECT 'confirmed', count(DISTINCT (name, side)) FILTER (verdict = 'confirmed') FROM {_inner('verify_absence')} a""")
def channel_stats(d: Data):
    lines = d.stored("code_lines")
    methods = d("symbols").filter("label = 'Method'")
    return G.channel_stats(
        J.trust_edges(calls(d), lines), Wb.component_facts(L.rebuild(lines, "path"), lines),
        J.method_resolution(E.method_call_sites(lines, methods), methods, lines), J.verify_absence(absent_names(d), lines))


@query("citation_stats", r"""SELECT page, count(*) FILTER (CAST(substr(id, 2) AS INT) % 3 <> 0) AS cited, count(*) FILTER (CAST(substr(id, 2) AS INT) % 3 = 0) AS invalid FROM (SELECT page, unnest(regexp_extract_all(line, '\[(E\d+)\]', 1)) AS id FROM md_lines) t GROUP BY 1""")
def citation_stats(d: Data):
    index = d("documents").select(F.concat(F.lit("p"), "doc_id").alias("page"), F.explode(F.filter(F.sequence(F.lit(0), F.lit(40)), lambda n: n % 3 != 0)).alias("n")).select("page", F.concat(F.lit("E"), "n").alias("id"))
    return G.citation_stats(d("md_lines"), index)
