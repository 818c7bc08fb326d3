"""Queries: report pages composed from the operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import text as X, vocab
from codeloom.operators import aggregate as G, classify as C, evidence as V, extract_code as E, joins as J, ranking as K, similarity as S
from codeloom.plans import duck as D, q_aggs, q_basics, q_code, q_graph, q_joins, q_ranking, reports as R
from codeloom.plans.catalog import Data, query
from codeloom.plans.q_aggs import _inner


def _sec(name: str, key: str, detail: str, source: str, tail: str = "") -> str:
    return f"SELECT '{name}' AS section, CAST({key} AS VARCHAR) AS key, CAST({detail} AS VARCHAR) AS detail FROM {source} t {tail}"


def _all(*parts: str) -> str:
    return " UNION ALL ".join(parts)


_B = "CASE WHEN {} THEN 'true' ELSE 'false' END"
ENTRIES = f"(SELECT path FROM files WHERE NOT {D.is_test('path')} AND {D.basename('path')} IN ('f1.ts', 'f2.ts', 'f30.ts'))"


def entries(d: Data):
    return R.entry_files(d("files"), ("f1.ts", "f2.ts", "f30.ts"))


@query("report_overview", _all(
    _sec("files", "k", "v", f"(UNPIVOT {_inner('scope_counts')} ON total, production, test INTO NAME k VALUE v)"),
    _sec("language", "language", "file_count", f"(SELECT DISTINCT language, file_count FROM {_inner('language_mix')} m)"),
    _sec("entry", "path", "''", ENTRIES), _sec("hotspot", "name", "fan_in", _inner("hotspot_files")), _sec("dependency", "name", "usage", _inner("dep_usage"))))
def report_overview(d: Data):
    return R.overview(C.scope_counts(d("files")), C.language_mix(d("files")), entries(d), q_joins.hotspot_files(d), q_joins.usage(d))


@query("report_architecture", _all(
    _sec("module", "module", "files", _inner("production_modules")), _sec("symbol", "module", "place || '#' || id", _inner("fair_sample"), "WHERE place <= 6"),
    _sec("relation", "module || ':' || direction", "neighbour", _inner("module_relations")), _sec("boundary", "from_module || '→' || to_module", "call_count", _inner("module_boundaries")),
    _sec("layer", "name", "reason", _inner("trusted_layers")), _sec("cluster", "id", "members", "clusters")))
def report_architecture(d: Data):
    return R.architecture(q_joins.production_modules(d), q_ranking.sample(d), q_joins.module_relations(d), q_aggs.module_boundaries(d), q_basics.trusted_layers(d), d("clusters"))


@query("report_modules", _all(
    _sec("detailed", "module", "importance", _inner("module_importance"), "WHERE detailed"), _sec("summary", "module", "importance", _inner("module_importance"), "WHERE NOT detailed"),
    _sec("symbol", "module", "place || '#' || id", _inner("fair_sample"), f"WHERE module IN (SELECT module FROM {_inner('module_importance')} i WHERE detailed)"),
    _sec("relation", "module || ':' || direction", "neighbour", _inner("module_relations"), f"WHERE module IN (SELECT module FROM {_inner('module_importance')} i WHERE detailed)")))
def report_modules(d: Data):
    return R.modules_page(q_aggs.module_importance(d), q_ranking.sample(d), q_joins.module_relations(d))


@query("report_api", _all(
    _sec("command", "CASE id % 3 WHEN 0 THEN 'registerLoad' || name || 'Command' ELSE 'runCommandOf' || name END", "CASE id % 3 WHEN 0 THEN 'load' || name ELSE 'runcommandof' || name END", "symbols", "WHERE id % 3 < 2"),
    _sec("function", "name", "complexity", _inner("exported_functions")), _sec("surface", "ipc_kind || ':' || key", "calls || '/' || defines || '/' || listeners || '/' || emits", _inner("ipc_match"))))
def report_api(d: Data):
    commands = C.classify_command_entries(d("symbols").select("id", F.expr(q_basics._ENTRY).alias("name"))).filter("entry_kind = 'command'")
    return R.api(commands, K.exported_functions(d("symbols")), q_joins.ipc_match(d))


@query("report_data_flow", _all(
    _sec("stage", "name || '@' || file", "role", _inner("build_stages")), _sec("transition", "caller_name || '→' || callee_name", "call_line", _inner("transitions"), "WHERE carries"),
    _sec("type", "name", "kind", _inner("type_definitions")), _sec("coverage", "counter", "n", _inner("dataflow_coverage"))))
def report_data_flow(d: Data):
    return R.data_flow(q_graph.stages(d), q_graph.moves(d), q_graph.type_definitions(d), q_graph.dataflow_coverage(d))


@query("report_onboarding", _all(
    _sec("entry", "path", "''", ENTRIES), _sec("directory", "dir", "file_count", f"(SELECT split_part(path, '/', 1) AS dir, count(*) AS file_count FROM files WHERE NOT {D.is_test('path')} GROUP BY 1)"),
    _sec("file", "dir", "path", f"(SELECT split_part(path, '/', 1) AS dir, path FROM files WHERE NOT {D.is_test('path')} QUALIFY row_number() OVER (PARTITION BY split_part(path, '/', 1) ORDER BY path) <= 8)"),
    _sec("env", "name", _B.format("sensitive"), f"(SELECT DISTINCT name, sensitive FROM {_inner('env_var_census')} e)"), _sec("prerequisite", "page", "title", _inner("readme_prereqs"))))
def report_onboarding(d: Data):
    from codeloom.plans.q_docs import readme_prereqs

    dirs = C.source_dirs(d("files"))
    path = F.col("path")
    placed = d("files").filter(~X.is_test_path(path)).select(F.substring_index(path, "/", 1).alias("dir"), "path").join(dirs.select("dir"), "dir", "left_semi")
    return R.onboarding(entries(d), dirs, C.top_per_group(placed, ["dir"], [path], 8), E.env_var_census(d("code_lines")), readme_prereqs(d))


@query("report_troubleshooting", _all(
    _sec("marker", "anchor", "text", _inner("why_marker_sample")), _sec("churn", "file", "commits", _inner("churn")),
    _sec("constant", "name", "n", f"(SELECT name, count(*) AS n FROM {_inner('constants_census')} c GROUP BY 1)")))
def report_troubleshooting(d: Data):
    return R.troubleshooting(q_ranking.why_marker_sample(d), q_aggs.churn(d), E.constants_census(d("code_lines")))


@query("report_constraints", _all(
    _sec("constant", "path || ':' || line_no", "value", _inner("constants_census")), _sec("hot", "id", "complexity", _inner("hot_functions")),
    _sec("comment", "anchor", "text", _inner("comment_evidence"), "WHERE kind = 'const-comment'")))
def report_constraints(d: Data):
    return R.constraints(E.constants_census(d("code_lines")), K.hot_functions(d("symbols")), V.comment_evidence(d("code_lines")))


@query("report_decisions", _all(
    _sec("module", "module", "commits", _inner("module_timeline")), _sec("document", "anchor", "text", _inner("doc_sections")),
    _sec("churn", "file", "commits", f"(SELECT * FROM {_inner('churn')} c ORDER BY commits DESC, file LIMIT 10)"), _sec("dependency", "name", "anchor", _inner("dep_commits"))))
def report_decisions(d: Data):
    from codeloom.plans.q_docs import doc_sections

    return R.decisions(q_aggs.module_timeline(d), doc_sections(d), G.churn(d("commits"), 10), q_joins.dep_commits(d))


@query("report_tech_stack", _all(
    _sec("dependency", "name", '"group"', _inner("dep_partition")), _sec("crate", "name", _B.format("used"), _inner("crate_usage")),
    _sec("commit", "name", "anchor", _inner("dep_commits")), _sec("tool", "pkg", "build_tool", _inner("build_tool"))))
def report_tech_stack(d: Data):
    return R.tech_stack(q_joins.dep_partition(d), q_joins.crate_usage(d), q_joins.dep_commits(d), q_basics.build_tool(d))


@query("report_cli", _all(
    _sec("command", "path", "description", _inner("cli_descriptions")), _sec("option", "path || ':' || flag", "description", _inner("cli_options")), _sec("exit", "path || ':' || line_no", "code", _inner("exit_code_census"))))
def report_cli(d: Data):
    return R.cli(E.cli_descriptions(d("code_lines")), E.cli_options(d("code_lines")), E.exit_code_census(d("code_lines")))


@query("report_topic", _all(
    _sec("symbol", "topic", "rank || '#' || id", _inner("subgraph_symbols")), _sec("edge", "topic", "caller_name || '→' || callee_name", _inner("subgraph_edges")),
    _sec("boundary", "topic", "from_module || '→' || to_module", _inner("subgraph_boundaries")), _sec("evidence", "topic || ':' || id", "anchor", _inner("assign_evidence_ids"))))
def report_topic(d: Data):
    return R.topic(q_graph.subgraph_symbols(d), q_graph.subgraph_edges(d), q_graph.subgraph_boundaries(d), q_ranking.assign_evidence_ids(d))


@query("report_testing", _all(
    _sec("directory", "dir", "''", r"(SELECT DISTINCT 'tests' AS dir FROM files WHERE path LIKE 'tests/%' UNION SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) FROM files WHERE path LIKE '%.test.ts')"),
    _sec("env", "name", "''", f"(SELECT DISTINCT name FROM {q_code._ENV} e WHERE name IS NOT NULL AND {D.is_test('path')} AND name NOT IN (SELECT name FROM {_inner('env_var_census')} p))"),
    _sec("constant", "name", "''", f"(SELECT DISTINCT name FROM {_inner('constants_census')} c WHERE {D.is_test('path')} AND name NOT IN (SELECT name FROM {_inner('constants_census')} p WHERE NOT {D.is_test('path')}))"),
    _sec("dependency", "name", "''", _inner("test_only_deps"))))
def report_testing(d: Data):
    flag = lambda df: df.select("name", X.is_test_path(F.col("path")).alias("is_test"))
    return R.testing(
        R.test_dirs(d("files")), S.test_only(flag(E.env_refs(d("code_lines")))), S.test_only(flag(E.constants_census(d("code_lines")))), q_joins.test_only_deps(d))


_ROOT = """CASE c_custkey % 9 WHEN 0 THEN 'package.json' WHEN 1 THEN 'pnpm-lock.yaml' WHEN 2 THEN 'yarn.lock' WHEN 3 THEN 'go.mod' WHEN 4 THEN 'pom.xml' WHEN 5 THEN 'biome.json' WHEN 6 THEN 'eslint.config.js' WHEN 7 THEN 'README.md' ELSE 'bun.lock' END"""
_REPO = "CAST(floor(c_custkey / 4) AS BIGINT)"


def root_files(d: Data):
    return d("customer").select(F.expr(_REPO).alias("repo"), F.expr(_ROOT).alias("path"))


@query("report_environment", f"""WITH f AS (SELECT {_REPO} AS repo, {_ROOT} AS path FROM customer), r AS (SELECT repo, bool_or(path = 'package.json') AS node, min(CASE path WHEN 'bun.lock' THEN 1 WHEN 'pnpm-lock.yaml' THEN 2 WHEN 'yarn.lock' THEN 3 END) AS l, min(CASE path WHEN 'go.mod' THEN 1 WHEN 'pom.xml' THEN 2 END) AS n FROM f GROUP BY 1)
 SELECT repo, CASE WHEN NOT node AND n IS NOT NULL THEN CASE n WHEN 1 THEN 'Go' ELSE 'JVM' END ELSE 'Node' END AS runtime, CASE WHEN NOT node AND n IS NOT NULL THEN CASE n WHEN 1 THEN 'go modules' ELSE 'maven' END
 ELSE coalesce(CASE WHEN repo % 6 = 0 THEN 'deno' END, CASE l WHEN 1 THEN 'bun' WHEN 2 THEN 'pnpm' WHEN 3 THEN 'yarn' END, 'npm') END AS package_manager FROM r""")
def report_environment(d: Data):
    files = root_files(d)
    declared = files.filter("repo % 6 = 0").select("repo", F.lit("deno@2.1").alias("manager")).distinct()
    return R.environment(files, declared)


@query("report_conventions", f"""WITH f AS (SELECT {_REPO} AS repo, {_ROOT} AS path FROM customer) SELECT repo, coalesce(CASE min(CASE path WHEN 'eslint.config.js' THEN 1 WHEN 'biome.json' THEN 2 END) WHEN 1 THEN 'eslint.config.js' WHEN 2 THEN 'biome.json' END, CASE WHEN repo % 5 = 0 THEN 'scripts.lint: ruff' END) AS linter FROM f GROUP BY 1""")
def report_conventions(d: Data):
    files = root_files(d)
    scripts = files.select("repo", F.when(F.col("repo") % 5 == 0, "lint").otherwise("build").alias("script"), F.lit("ruff check .").alias("command"))
    return R.conventions(files, scripts)
