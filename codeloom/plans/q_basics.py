"""Queries: sources, sinks, projections and classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import vocab
from codeloom.operators import classify as C
from codeloom.plans import duck as D
from codeloom.plans.catalog import Data, query
from codeloom.session import fixed_table
from codeloom.sources import readers as R, sinks as S

_TREE = "CASE WHEN doc_id % 13 = 0 THEN 'node_modules/' || path WHEN doc_id % 17 = 0 THEN '.cache/' || path WHEN doc_id % 19 = 0 THEN path || '.bin' ELSE path END"


@query("file_inventory", f"""SELECT path, size, {D.ext('path')} AS ext, {D.language('path')} AS language,
 CASE WHEN {D.is_test('path')} THEN 'test' ELSE 'production' END AS scope
 FROM (SELECT {_TREE} AS path, size FROM files) t
 WHERE NOT starts_with(path, 'node_modules/') AND NOT starts_with(path, '.cache/') AND NOT path LIKE '%.bin'""")
def file_inventory(d: Data):
    return R.tag_inventory(d("files").select(F.expr(_TREE).alias("path"), "size"))


@query("load_graph", """SELECT CAST(p_partkey AS BIGINT) AS id, coalesce(CASE WHEN p_partkey % 2 = 0 THEN p_size + 1 END, p_size) AS node_count,
 name, qualified_name FROM (SELECT p_partkey, p_size, name, qualified_name FROM part JOIN symbols ON id = p_partkey) t""")
def load_graph(d: Data):
    rows = d("symbols").select(
        F.array(F.lit("id"), F.lit("nodes"), F.lit("qn"), F.lit("node_count")).alias("cols"),
        F.array(F.array(F.col("id").cast("string"), F.col("complexity").cast("string"), F.col("qualified_name"),
                        F.when(F.col("id") % 2 == 0, (F.col("complexity") + 1).cast("string")))).alias("rows"))
    out = R.modern_names(R.columnar_rows(rows, ["id", "nodes", "qn", "node_count", "qualified_name"]))
    return out.select(F.col("id").cast("bigint").alias("id"), F.col("node_count").cast("int").alias("node_count"), "name", "qualified_name")


@query("load_commits", """SELECT hash, date, substr(CASE WHEN event_id % 7 = 0 THEN 'a' || chr(9) || subject ELSE subject END, 1, 120) AS subject
 FROM commits WHERE event_id % 11 <> 0""")
def load_commits(d: Data):
    subject = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("a\t"), "subject")).otherwise(F.col("subject"))
    log = F.when(F.col("event_id") % 11 == 0, F.concat("hash", F.lit("\t"), F.col("date").cast("string"), F.lit("\t "))).otherwise(
        F.concat("hash", F.lit("\t"), F.col("date").cast("string"), F.lit("\t"), subject))
    return R.parse_commits(d("commits").select(log.alias("value")))


def _manifest_json(d: Data):
    """One manifest per customer; the first of each nation is its root."""
    deps = F.create_map(F.concat(F.lit("@s/p"), F.col("c_custkey") % 997), F.concat(F.lit("^"), F.col("c_custkey") % 5))
    dev = F.create_map(F.lit("vite"), F.lit("^1"), F.concat(F.lit("@t/"), F.col("c_custkey") % 11), F.lit("2"))
    body = F.struct(
        F.when(F.col("c_custkey") % 9 != 0, F.col("c_name")).alias("name"), F.lit("1.0").alias("version"),
        (F.col("c_custkey") % 2 == 0).alias("private"), deps.alias("dependencies"),
        F.when(F.col("c_custkey") % 3 == 0, dev).alias("devDependencies"))
    where = F.when(F.col("c_custkey") < 30, ".").otherwise(F.concat(F.lit("packages/c"), F.col("c_custkey")))
    return d("customer").select(F.col("c_nationkey").alias("repo"), where.alias("pkg_dir"), F.to_json(body).alias("content"))


_MANIFEST_CTE = """SELECT c_nationkey AS repo, CASE WHEN c_custkey < 30 THEN '.' ELSE 'packages/c' || c_custkey END AS pkg_dir, c_name AS name,
 '1.0' AS version, c_custkey, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer"""


@query("load_manifest", f"""WITH m AS ({_MANIFEST_CTE}), k AS (SELECT * FROM m WHERE c_custkey % 9 <> 0 AND (pkg_dir <> '.' OR n = 1))
 SELECT repo, pkg_dir, name, version, '@s/p' || c_custkey % 997 AS dep, '^' || c_custkey % 5 AS dep_version, 'prod' AS kind FROM k
 UNION ALL SELECT repo, pkg_dir, name, version, 'vite', '^1', 'dev' FROM k WHERE c_custkey % 3 = 0
 UNION ALL SELECT repo, pkg_dir, name, version, '@t/' || c_custkey % 11, '2', 'dev' FROM k WHERE c_custkey % 3 = 0""")
def load_manifest(d: Data):
    return R.manifest_deps(_manifest_json(d))


_TOML_SQL = r"""SELECT path, line_no, section, name, version FROM (
 SELECT path, line_no, section,
  coalesce(nullif(regexp_extract(trim(line), '^([A-Za-z0-9_-]+)\s*=\s*"([^"]+)"', 1), ''), nullif(regexp_extract(trim(line), '^([A-Za-z0-9_-]+)\s*=\s*\{\s*version\s*=\s*"([^"]+)"', 1), '')) AS name,
  coalesce(nullif(regexp_extract(trim(line), '^([A-Za-z0-9_-]+)\s*=\s*"([^"]+)"', 2), ''), nullif(regexp_extract(trim(line), '^([A-Za-z0-9_-]+)\s*=\s*\{\s*version\s*=\s*"([^"]+)"', 2), '')) AS version
 FROM (SELECT path, line_no, line, last_value(nullif(regexp_extract(trim(line), '^\[([^\]]+)\]$', 1), '') IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no) AS section FROM toml_lines) a
 WHERE section IN ('dependencies', 'dev-dependencies', 'build-dependencies')) b WHERE name IS NOT NULL"""


@query("load_toml_deps", _TOML_SQL)
def load_toml_deps(d: Data):
    return R.toml_deps(d("toml_lines"))


@query("flatten_exports", """SELECT p_partkey AS package, './import' AS key, p_name || '.mjs' AS value FROM part WHERE p_partkey % 3 > 0
 UNION ALL SELECT p_partkey, './types/default', p_type || '.d.ts' FROM part WHERE p_partkey % 3 > 0
 UNION ALL SELECT p_partkey, p_brand, 'y.js' FROM part WHERE p_partkey % 3 > 0
 UNION ALL SELECT p_partkey, '.', p_name FROM part WHERE p_partkey % 3 = 0""")
def flatten_exports(d: Data):
    nested = F.concat(
        F.lit('{".":{"import":"'), "p_name", F.lit('.mjs","types":{"default":"'), "p_type", F.lit('.d.ts"}},"'), "p_brand", F.lit('":"y.js"}'))
    exports = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(nested)
    return R.flatten_exports(d("part").select(F.col("p_partkey").alias("package"), exports.alias("exports")))


@query("sink_with_status", """SELECT 'p' || doc_id AS page, source || '/p' || doc_id || '.md' AS rel_path,
 CASE WHEN doc_id % 7 = 0 THEN 'created' WHEN doc_id % 5 = 0 THEN 'updated' ELSE 'unchanged' END AS status FROM documents""")
def sink_with_status(d: Data):
    name = F.concat(F.lit("p"), "doc_id")
    rel = F.concat("source", F.lit("/"), name, F.lit(".md"))
    docs = d("documents")
    old = docs.filter("doc_id % 7 <> 0").select(
        rel.alias("rel_path"), F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("content"))
    return S.sink_with_status(docs.select(name.alias("page"), rel.alias("rel_path"), F.col("text").alias("content")), old)


_OUT = """CASE doc_id % 9 WHEN 0 THEN '08-topics/t' || doc_id || '.md' WHEN 1 THEN '09-chapters/c/p' || doc_id || '.md' WHEN 2 THEN '02-architecture/x' || doc_id || '.md'
 WHEN 3 THEN '77-old/x' || doc_id || '.md' WHEN 4 THEN 'notes/x' || doc_id || '.md' WHEN 5 THEN 'user' || doc_id || '.md' WHEN 6 THEN '05-guides/n' || doc_id || '.txt'
 WHEN 7 THEN '01-overview/project-overview.md' ELSE 'overview.md' END"""


@query("stale_outputs", f"""WITH o AS (SELECT doc_id, {_OUT} AS rel_path FROM files)
 SELECT rel_path, CASE WHEN rel_path = '01-overview/project-overview.md' THEN 'retired' WHEN rel_path = 'overview.md' THEN 'legacy-flat'
  WHEN starts_with(rel_path, '08') THEN 'stale-topic' WHEN starts_with(rel_path, '09') THEN 'stale-chapter' WHEN starts_with(rel_path, '02') THEN 'unplanned' ELSE 'unknown-directory' END AS reason
 FROM (SELECT DISTINCT rel_path FROM o) q WHERE rel_path NOT IN (SELECT rel_path FROM o WHERE doc_id % 2 = 0 AND rel_path NOT IN ('01-overview/project-overview.md', 'overview.md'))
 AND NOT starts_with(rel_path, 'notes') AND NOT starts_with(rel_path, 'user') AND NOT rel_path LIKE '%.txt'""")
def stale_outputs(d: Data):
    out = d("files").select("doc_id", F.expr(_OUT.replace("doc_id ||", "CAST(doc_id AS STRING) ||")).alias("rel_path"))
    planned = out.filter("doc_id % 2 = 0 AND rel_path NOT IN ('01-overview/project-overview.md', 'overview.md')")
    return S.stale_outputs(out.select("rel_path").distinct(), planned.select("rel_path").distinct())


@query("keep_latest_versions", "SELECT DISTINCT CAST(CAST(ts AS DATE) AS STRING) AS label FROM events ORDER BY label DESC LIMIT 5")
def keep_latest_versions(d: Data):
    return S.keep_latest_versions(d("events").select(F.col("ts").cast("date").cast("string").alias("label")))


@query("language_mix", f"""WITH t AS (SELECT path, {D.language('path')} AS language FROM files)
 SELECT language, count(*) OVER (PARTITION BY language) AS file_count, row_number() OVER (PARTITION BY language ORDER BY path) AS example_no, path AS example
 FROM t QUALIFY example_no <= 3""")
def language_mix(d: Data):
    return C.language_mix(d("files"))


@query("domain_top3", f"""SELECT module, domain, file_count, row_number() OVER (PARTITION BY module ORDER BY file_count DESC, domain) AS rank FROM (
 SELECT module, coalesce({D.domain('path')}, 'other') AS domain, count(*) AS file_count FROM files GROUP BY 1, 2) t QUALIFY rank <= 3""")
def domain_top3(d: Data):
    return C.domain_top3(d("files"))


@query("scope_counts", f"SELECT count(*) AS total, count(*) FILTER (NOT {D.is_test('path')}) AS production, count(*) FILTER ({D.is_test('path')}) AS test FROM files")
def scope_counts(d: Data):
    return C.scope_counts(d("files"))


_SPEC = "CASE doc_id % 5 WHEN 0 THEN '@s/p' || CAST(doc_id % 97 AS STRING) || '/deep/x' WHEN 1 THEN './rel/' || lang WHEN 2 THEN '../node_modules/@n/q' || CAST(doc_id % 7 AS STRING) || '/d.css' WHEN 3 THEN source || '/sub' ELSE '/abs' END"


@query("imports_by_package", f"SELECT package, count(*) AS uses FROM (SELECT {D.package('spec')} AS package FROM (SELECT {_SPEC} AS spec FROM files) a) b WHERE package IS NOT NULL GROUP BY 1")
def imports_by_package(d: Data):
    return C.imports_by_package(d("files").select(F.expr(_SPEC).alias("specifier")))


_HOLDER = "CASE id % 6 WHEN 0 THEN 'No top-level symbols detected' WHEN 1 THEN 'no edges traced ' WHEN 2 THEN 'noFound' ELSE name END"


@query("drop_placeholders", f"SELECT id, n AS name FROM (SELECT id, {_HOLDER} AS n FROM symbols) t WHERE NOT (starts_with(lower(n), 'no ') AND (n LIKE '%detected' OR n LIKE '%traced %'))")
def drop_placeholders(d: Data):
    return C.drop_placeholders(d("symbols").select("id", F.expr(_HOLDER).alias("name")))


_QN = "CASE id % 4 WHEN 0 THEN 'a-b-repo.' || replace(regexp_replace(file, '[.][^.]*$', ''), '/', '.') || '.' || name WHEN 1 THEN 'a.b.repo.Outer.' || name WHEN 2 THEN name ELSE 'src.zz.' || name END"


@query("normalize_qualified_name", f"""SELECT id, CASE id % 4 WHEN 0 THEN name WHEN 1 THEN 'Outer.' || name WHEN 2 THEN name ELSE CASE WHEN starts_with(file, 'src/') THEN 'zz.' || name ELSE 'src.zz.' || name END END AS normalized FROM symbols
 WHERE NOT (id % 4 = 0 AND file LIKE '%.test.ts')""")
def normalize_qualified_name(d: Data):
    rows = d("symbols").filter("NOT (id % 4 = 0 AND file LIKE '%.test.ts')").select("id", "file", F.expr(_QN).alias("qualified_name"))
    return C.normalize_qualified_name(rows, "/a/b/repo").select("id", "normalized")


@query("merge_signature", r"""SELECT id, CASE WHEN signature IS NULL THEN return_type WHEN return_type IS NULL OR NOT regexp_matches(sig, '\)\s*$') THEN sig
 ELSE sig || CASE WHEN file LIKE '%.rs' THEN ' -> ' ELSE ': ' END || return_type END AS merged_signature
 FROM (SELECT *, trim(regexp_replace(signature, '\s+', ' ', 'g')) AS sig FROM symbols) t""")
def merge_signature(d: Data):
    return C.merge_signature(d("symbols")).select("id", "merged_signature")


@query("symbol_kind", f"SELECT {D.case('label', vocab.SYMBOL_KIND)} AS kind, count(*) AS symbols FROM symbols GROUP BY 1")
def symbol_kind(d: Data):
    return C.symbol_kind(d("symbols")).groupBy("kind").agg(F.count("*").alias("symbols"))


@query("app_entry_points", f"""SELECT s.id, s.file, s.name FROM symbols s WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.dst = s.id)
 AND file IN (SELECT path FROM files WHERE NOT {D.is_test('path')} AND {D.domain('path')} IS NOT NULL)""")
def app_entry_points(d: Data):
    entries = d("symbols").select("id", "file", "name").join(d("edges").select(F.col("dst").alias("id")), "id", "left_anti")
    return C.app_entry_points(entries, d("files")).select("id", "file", "name")


@query("classify_comment_lines", f"""SELECT path, CASE WHEN {D.comment('line', 'path')} THEN 'mention' ELSE 'usage' END AS evidence, count(*) AS lines FROM code_lines GROUP BY 1, 2""")
def classify_comment_lines(d: Data):
    return C.classify_comment_lines(d("code_lines")).groupBy("path", "evidence").agg(F.count("*").alias("lines"))


_ENTRY = "CASE id % 3 WHEN 0 THEN 'registerLoad' || name || 'Command' WHEN 1 THEN 'runCommandOf' || name ELSE name END"


@query("classify_command_entries", """SELECT id, CASE WHEN id % 3 < 2 THEN 'command' ELSE 'function' END AS entry_kind,
 CASE id % 3 WHEN 0 THEN 'load' || name WHEN 1 THEN 'runcommandof' || name END AS command FROM symbols""")
def classify_command_entries(d: Data):
    return C.classify_command_entries(d("symbols").select("id", F.expr(_ENTRY).alias("name"))).select("id", "entry_kind", "command")


_STACK = "CASE p_partkey % 9 WHEN 0 THEN 'express' WHEN 1 THEN 'react' WHEN 2 THEN 'vue' WHEN 3 THEN 'commander' WHEN 4 THEN 'mastra' WHEN 5 THEN 'swiftui' ELSE p_name END"


@query("project_type", f"""WITH s AS (SELECT CAST(floor(p_partkey / 4) AS BIGINT) AS repo, {_STACK} AS package FROM part),
 k AS (SELECT repo, CASE WHEN package = 'express' THEN 0 WHEN package IN ('react', 'vue') THEN 1 WHEN package = 'mastra' THEN 2 WHEN package = 'commander' THEN 3 WHEN package = 'swiftui' THEN 4 END AS o, count(DISTINCT package) AS score FROM s GROUP BY 1, 2),
 b AS (SELECT repo, o, score FROM k WHERE o IS NOT NULL QUALIFY row_number() OVER (PARTITION BY repo ORDER BY score DESC, o) = 1)
 SELECT r.repo, coalesce(CASE o WHEN 0 THEN 'backend' WHEN 1 THEN 'frontend' WHEN 2 THEN 'agent' WHEN 3 THEN 'cli' WHEN 4 THEN 'desktop' END, CASE WHEN r.repo % 5 = 0 THEN 'library' END, 'unknown') AS project_type, coalesce(score, 0) AS score
 FROM (SELECT DISTINCT repo FROM s) r LEFT JOIN b ON r.repo = b.repo""")
def project_type(d: Data):
    stacks = d("part").select(F.expr("CAST(floor(p_partkey / 4) AS BIGINT)").alias("repo"), F.expr(_STACK).alias("package"))
    return C.project_type(stacks, libraries=stacks.filter("repo % 5 = 0").select("repo"))


@query("source_dirs", f"""SELECT split_part(p, '/', 1) AS dir, count(*) AS file_count, dir IN {D.values(vocab.KNOWN_SOURCE_DIRS)} AS is_known
 FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN source || '/' || path ELSE path END AS p FROM files) t WHERE p LIKE '%/%' AND NOT {D.is_test('p')} GROUP BY 1 HAVING is_known OR count(*) >= 3""")
def source_dirs(d: Data):
    return C.source_dirs(d("files").select(F.expr("CASE WHEN doc_id % 3 = 0 THEN source || '/' || path ELSE path END").alias("path")))


_LAYER = "SELECT module AS name, CASE WHEN doc_id % 2 = 0 THEN 'HTTP route handlers' ELSE 'fan-in' END AS reason, doc_id FROM files"


@query("trusted_layers", f"""SELECT name, reason, doc_id FROM ({_LAYER}) l WHERE name IN (SELECT module FROM symbols) AND (reason <> 'HTTP route handlers' OR EXISTS (SELECT 1 FROM manifests WHERE regexp_matches(dep, '(?i)express|nest')))""")
def trusted_layers(d: Data):
    layers = d("files").select(F.col("module").alias("name"), F.expr("CASE WHEN doc_id % 2 = 0 THEN 'HTTP route handlers' ELSE 'fan-in' END").alias("reason"), "doc_id")
    packages = d("symbols").select(F.col("module").alias("name")).distinct()
    return C.trusted_layers(layers, packages, d("manifests").select(F.col("dep").alias("package"))).select("name", "reason", "doc_id")


@query("redact_long_tokens", """SELECT doc_id, rtrim(substr(regexp_replace(text, '[A-Za-z0-9+/=_-]{40,}', '[REDACTED]', 'g'), 1, 240)) AS redacted,
 len(regexp_extract_all(text, '[A-Za-z0-9+/=_-]{40,}')) AS hits FROM documents""")
def redact_long_tokens(d: Data):
    return C.redact_long_tokens(d("documents")).select("doc_id", "redacted", "hits")


@query("files_per_module", r"""SELECT CASE WHEN regexp_matches(path, '(^|/)src/') THEN regexp_extract(path, '(?:^|/)src/([^/]*)', 1) WHEN path LIKE '%/%' THEN split_part(path, '/', 1) ELSE path END AS module_key,
 count(*) AS file_count FROM files GROUP BY 1""")
def files_per_module(d: Data):
    return C.files_per_module(d("files"))


_TOOL = "CASE c_custkey % 8 WHEN 0 THEN 'esbuild' WHEN 1 THEN 'vite' WHEN 2 THEN 'rollup' WHEN 3 THEN 'tsup' ELSE c_name END"


@query("build_tool", f"""SELECT pkg, coalesce(CASE min(CASE dep WHEN 'tsup' THEN 1 WHEN 'vite' THEN 2 WHEN 'webpack' THEN 3 WHEN 'rollup' THEN 4 WHEN 'esbuild' THEN 5 END) WHEN 1 THEN 'tsup' WHEN 2 THEN 'vite' WHEN 3 THEN 'webpack' WHEN 4 THEN 'rollup' WHEN 5 THEN 'esbuild' END, 'unknown') AS build_tool
 FROM (SELECT CAST(floor(c_custkey / 3) AS BIGINT) AS pkg, {_TOOL} AS dep FROM customer) t GROUP BY 1""")
def build_tool(d: Data):
    return C.build_tool(d("customer").select(F.expr("CAST(floor(c_custkey / 3) AS BIGINT)").alias("pkg"), F.expr(_TOOL).alias("dep")))


_ARG = "CASE event_id % 8 WHEN 0 THEN props WHEN 1 THEN '''' || event_type || '''' WHEN 2 THEN CAST(value AS STRING) WHEN 3 THEN 'true' WHEN 4 THEN 'null' WHEN 5 THEN '[' || event_type || ']' WHEN 6 THEN 'undefined' ELSE event_type END"


@query("literal_shape", """SELECT CASE event_id % 8 WHEN 0 THEN 'object literal' WHEN 1 THEN 'string' WHEN 2 THEN 'number' WHEN 3 THEN 'boolean' WHEN 4 THEN 'null' WHEN 5 THEN 'array literal' WHEN 6 THEN 'undefined' ELSE 'none' END AS shape, count(*) AS uses FROM events GROUP BY 1""")
def literal_shape(d: Data):
    return C.shape_counts(d("events").select(F.expr(_ARG.replace("''''", "chr(39)")).alias("expression")))
