"""Queries: matches between files, packages, symbols, edges, pages and commits."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import patterns as P, vocab
from codeloom.operators import anchors as A, extract_code as E, extract_docs as M, extract_web as G, joins as J
from codeloom.plans import duck as D
from codeloom.plans.catalog import Data, query
from codeloom.session import cut_lineage
from codeloom.plans.q_code import _IPC, _IMPORTS, _WORDS, ipc_texts
from codeloom.plans.q_docs import CLAIMS, FILE_ANCHORS, LINKS, SLUGS, TERMS

WORDS = r"(SELECT DISTINCT path, unnest(regexp_extract_all(line, '([A-Za-z0-9_$]+)', 1)) AS word FROM code_lines)"
SYM_EDGES = """(SELECT e.src, e.dst, e.type, e.call_line, e.args, a.name AS caller_name, a.file AS caller_file, a.module AS caller_module, a.label AS caller_label, a.start_line AS caller_line,
 b.name AS callee_name, b.file AS callee_file, b.module AS callee_module, b.label AS callee_label, b.start_line AS callee_line FROM edges e JOIN symbols a ON e.src = a.id JOIN symbols b ON e.dst = b.id WHERE NOT a.is_test AND NOT b.is_test)"""


def packages(d: Data):
    """Module names and some two-segment ones, numbered by their first file."""
    p = d("files").groupBy(F.col("module").alias("name")).agg(F.min("doc_id").alias("ord"))
    return p.unionByName(p.select(F.concat("name", F.lit("/core")).alias("name"), (F.col("ord") + 1).alias("ord")))


PACKAGES = "(SELECT module AS name, min(doc_id) AS ord FROM files GROUP BY 1 UNION ALL SELECT module || '/core', min(doc_id) + 1 FROM files GROUP BY module)"


@query("assign_module", "SELECT path, CASE WHEN path LIKE 'src/%/core/%' THEN module || '/core' ELSE module END AS module FROM files")
def assign_module(d: Data):
    return J.assign_module(d("files").select("path"), packages(d))


@query("production_modules", f"SELECT CASE WHEN path LIKE 'src/%/core/%' THEN module || '/core' ELSE module END AS module, count(*) AS files FROM files WHERE NOT {D.is_test('path')} GROUP BY 1")
def production_modules(d: Data):
    return J.production_modules(d("files"), packages(d)).groupBy("module").agg(F.count("*").alias("files"))


def calls(d: Data):
    return J.symbol_edges(d("edges").filter("type = 'CALLS'"), d("symbols"))


VERDICTS = f"""(SELECT s.*, CASE WHEN {D.domain('caller_file')} IS NULL OR {D.domain('callee_file')} IS NULL THEN 'non-code' WHEN {D.domain('caller_file')} <> {D.domain('callee_file')} THEN 'cross-language'
 WHEN w.word IS NOT NULL OR NOT EXISTS (SELECT 1 FROM files f WHERE f.path = caller_file) THEN 'ok' ELSE 'no-lexical-evidence' END AS verdict FROM {SYM_EDGES} s LEFT JOIN {WORDS} w ON w.path = s.caller_file AND w.word = s.callee_name WHERE type = 'CALLS')"""


@query("trust_edges", f"SELECT src, dst, call_line, verdict, count(*) AS n FROM {VERDICTS} v GROUP BY 1, 2, 3, 4")
def trust_edges(d: Data):
    return J.trust_edges(calls(d), d("code_lines")).groupBy("src", "dst", "call_line", "verdict").agg(F.count("*").alias("n"))


@query("symbol_index", "SELECT name, count(DISTINCT file) AS files, count(DISTINCT qualified_name) AS qualified, count(DISTINCT file) > 1 AS ambiguous FROM symbols GROUP BY 1")
def symbol_index(d: Data):
    return J.symbol_index(d("symbols"))


KNOWN = f"""(SELECT DISTINCT chain FROM (SELECT chain, CASE k WHEN 0 THEN chain WHEN 1 THEN regexp_replace(chain, '^[^.]*\\.', '') ELSE regexp_replace(regexp_replace(chain, '^[^.]*\\.', ''), '^[^.]*\\.', '') END AS cand FROM {CLAIMS} c, (SELECT unnest([0, 1, 2]) AS k) n) x
 WHERE cand IN (SELECT name FROM symbols UNION SELECT qualified_name FROM symbols UNION SELECT regexp_replace(qualified_name, '^proj\\.', '') FROM symbols UNION SELECT {D.stem('path')} FROM files))"""


def confirmed(d: Data):
    return M.extract_claims(d("md_lines")).filter("raw LIKE '%7'").select("raw").distinct()


@query("resolve_claims", f"SELECT page, raw, chain, name, line_no, match_no, chain IN (SELECT chain FROM {KNOWN} k) AS known FROM {CLAIMS} c WHERE raw NOT LIKE '%7'")
def resolve_claims(d: Data):
    return J.resolve_claims(M.extract_claims(d("md_lines")), d("symbols"), d("files"), confirmed(d))


PROBES = f"""(SELECT word AS name, CASE WHEN bool_or(code) THEN 'usage' ELSE 'mention' END AS evidence FROM (SELECT NOT {D.comment('line', 'path')} AS code, unnest(regexp_extract_all(line, '([A-Za-z0-9_$]+)', 1)) AS word FROM code_lines) t GROUP BY 1)"""


@query("probe_evidence", f"SELECT * FROM {PROBES} p WHERE name IN (SELECT name FROM {CLAIMS} c)")
def probe_evidence(d: Data):
    return J.probe_evidence(M.extract_claims(d("md_lines")).select("name"), d("code_lines"))


CLAIM_VERDICTS = f"""(WITH c AS MATERIALIZED (SELECT *, chain IN (SELECT chain FROM {KNOWN} k) AS known FROM {CLAIMS} c),
 f AS (SELECT page, name, min(line_no * 10000 + match_no) AS pos FROM c WHERE NOT known GROUP BY 1, 2), t AS (SELECT page, name, true AS probed FROM f)
 SELECT c.page, c.raw, c.chain, c.name, c.line_no, c.match_no, CASE WHEN known THEN 'verified' WHEN NOT probed THEN 'skipped' WHEN evidence = 'usage' THEN 'verified' WHEN evidence = 'mention' THEN 'mention' ELSE 'unverified' END AS verdict
 FROM c LEFT JOIN t ON c.page = t.page AND c.name = t.name LEFT JOIN {PROBES} p ON p.name = c.name)"""


def verdicts(d: Data, view=None):
    """Verdicts of the claims; a query that reads the lines more often gives `d.stored` as view."""
    view = view or d
    return J.verify_claims(M.extract_claims(view("md_lines")), d("symbols"), d("files"), view("code_lines"))


@query("verify_claims", f"SELECT * FROM {CLAIM_VERDICTS} v")
def verify_claims(d: Data):
    return verdicts(d)


@query("claim_stats", f"""SELECT page, count(*) AS total, count(*) FILTER (verdict IN ('mention', 'unverified')) AS unverified, count(DISTINCT v.name) FILTER (verdict = 'mention') AS mention_only,
 count(DISTINCT v.name) FILTER (i.n > 1) AS ambiguous, count(DISTINCT v.name) FILTER (verdict = 'skipped') AS skipped, count(*) - count(*) FILTER (verdict IN ('mention', 'unverified')) - count(DISTINCT v.name) FILTER (verdict = 'skipped') AS verified
 FROM {CLAIM_VERDICTS} v LEFT JOIN (SELECT name, count(DISTINCT file) AS n FROM symbols GROUP BY 1) i ON i.name = v.name GROUP BY 1""")
def claim_stats(d: Data):
    return J.claim_stats(verdicts(d), J.symbol_index(d("symbols")))


RESOLVED = f"""(SELECT a.page, a.line_no, a.path, a.target_line, a.line, coalesce(f.path, b.only) AS resolved FROM {FILE_ANCHORS} a LEFT JOIN files f ON f.path = a.path
 LEFT JOIN (SELECT {D.basename('path')} AS base, min(path) AS only FROM files GROUP BY 1 HAVING count(*) = 1) b ON b.base = a.path)"""


@query("resolve_anchor_files", f"SELECT page, line_no, path, target_line, resolved FROM {RESOLVED} r")
def resolve_anchor_files(d: Data):
    return A.file_anchors(d("md_lines"), d("files")).drop("kind")


CHECKED = f"""(SELECT r.page, r.line_no, r.path, r.target_line, r.resolved, r.line AS page_line, c.line AS target, CASE WHEN r.target_line = 0 THEN 'broken' WHEN r.resolved IS NULL THEN 'unknown' WHEN c.line IS NULL THEN 'out-of-range' WHEN {D.comment('c.line', 'r.resolved')} THEN 'comment' ELSE 'usage' END AS state
 FROM {RESOLVED} r LEFT JOIN code_lines c ON c.path = r.resolved AND c.line_no = r.target_line)"""


@query("anchor_line_check", f"SELECT page, line_no, path, target_line, state FROM {CHECKED} c")
def anchor_line_check(d: Data):
    return A.anchor_line_check(A.file_anchors(d("md_lines"), d("files")), d("code_lines")).select("page", "line_no", "path", "target_line", "state")


@query("anchor_stats", f"""SELECT page, count(*) AS total, count(*) FILTER (state IN ('out-of-range', 'comment', 'usage')) AS valid, count(*) FILTER (state = 'out-of-range') AS out_of_range,
 count(*) FILTER (state = 'comment') AS comment, count(*) FILTER (state = 'usage') AS usage FROM {CHECKED} c GROUP BY 1""")
def anchor_stats(d: Data):
    return A.anchor_stats(A.anchor_line_check(A.file_anchors(d("md_lines"), d("files")), d("code_lines")))


@query("anchor_symbol_mismatch", f"""WITH n AS (SELECT DISTINCT page, line_no, path, target_line, resolved, target, regexp_extract(raw, '([^.]*)$', 1) AS name FROM (
 SELECT *, unnest(regexp_extract_all(page_line, '`([A-Za-z_$][A-Za-z0-9_$]*(?:\\.[A-Za-z_$][A-Za-z0-9_$]*)*)`', 1)) AS raw FROM {CHECKED} c WHERE target IS NOT NULL AND target_line > 0) x)
 SELECT DISTINCT page, line_no, name, path, target_line FROM n WHERE NOT contains(target, name) AND name IN (SELECT name FROM symbols) AND NOT EXISTS (SELECT 1 FROM symbols s WHERE s.name = n.name AND s.file = n.resolved)""")
def anchor_symbol_mismatch(d: Data):
    return A.anchor_symbol_mismatch(A.file_anchors(d("md_lines"), d("files")), d("md_lines"), d("code_lines"), d("symbols"))


@query("doc_anchor_check", f"""SELECT DISTINCT page, path AS anchor, split_part(path, '#', 1) AS doc, substr(path, instr(path, '#') + 1) AS slug FROM (SELECT page, unnest(regexp_extract_all(line, {D.rx(vocab.DOC_ANCHOR.replace('(?i)', ''))})) AS path FROM {D.OPEN_MD} o) a
 WHERE split_part(path, '#', 1) IN (SELECT 'docs/' || page || '.md' FROM {SLUGS} s) AND (split_part(path, '#', 1), substr(path, instr(path, '#') + 1)) NOT IN (SELECT ('docs/' || page || '.md', slug) FROM {SLUGS} s)""")
def doc_anchor_check(d: Data):
    slugs = M.heading_slugs(d("md_lines")).select(F.concat(F.lit("docs/"), "page", F.lit(".md")).alias("doc"), "slug")
    return A.doc_anchor_check(M.extract_anchors(d("md_lines")), slugs)


@query("fragment_check", f"SELECT DISTINCT page, slug FROM (SELECT page, unnest(regexp_extract_all(line, '\\]\\(#([^)]+)\\)', 1)) AS slug FROM md_lines) a WHERE (page, slug) NOT IN (SELECT (page, slug) FROM {SLUGS} s)")
def fragment_check(d: Data):
    return A.fragment_check(d("md_lines"), M.heading_slugs(d("md_lines")))


def page_paths(d: Data):
    """Where each page of md_lines is written."""
    p = d("documents").select(F.concat(F.lit("p"), "doc_id").alias("page"), F.expr("'0' || CAST(doc_id % 7 AS STRING) || '-part/p' || CAST(doc_id AS STRING) || '.md'").alias("rel_path"))
    return p


PATHS = "(SELECT 'p' || doc_id AS page, '0' || doc_id % 7 || '-part/p' || doc_id || '.md' AS rel_path FROM documents)"


@query("dead_links", f"""SELECT DISTINCT l.page, target, regexp_extract(rel_path, '^(.*/)', 1) || target AS resolved FROM {LINKS} l JOIN {PATHS} p ON p.page = l.page WHERE ends_with(target, '.md') AND NOT starts_with(target, '#')
 AND regexp_extract(rel_path, '^(.*/)', 1) || target NOT IN (SELECT rel_path FROM {PATHS} q) AND target NOT IN (SELECT 'p' || doc_id || '.md' FROM documents WHERE doc_id % 3 = 0)""")
def dead_links(d: Data):
    files = d("documents").filter("doc_id % 3 = 0").select(F.concat(F.lit("p"), "doc_id", F.lit(".md")).alias("path"))
    return A.dead_links(d("md_lines"), page_paths(d), page_paths(d), files)


@query("ghost_links", r"SELECT page, line_no, regexp_replace(line, '\[([^\]]+)\]\(routing\.md\)', '\1') AS line, 1 AS stripped FROM md_lines WHERE line LIKE '%[routing](routing.md)%'")
def ghost_links(d: Data):
    return A.ghost_links(d("md_lines"), page_paths(d))


@query("repo_link_rewrite", r"SELECT page, line_no, regexp_replace(line, '\[(src|ref)\]\(', '[\1](../../') AS line, 1 AS fixed FROM md_lines WHERE regexp_extract(line, '\[(?:src|ref)\]\(([^)]+)\)', 1) IN (SELECT path FROM files)")
def repo_link_rewrite(d: Data):
    return A.repo_link_rewrite(d("md_lines"), page_paths(d), d("files"))


@query("mermaid_ghosts", f"""SELECT page, line_no, file FROM (SELECT page, line_no, unnest(regexp_extract_all(line, {D.rx(vocab.MERMAID_FILE)}, 1)) AS file FROM (
 SELECT *, last_value(CASE WHEN is_fence THEN line = '```mermaid' END IGNORE NULLS) OVER (PARTITION BY page ORDER BY line_no) AS mm FROM {D.MD} m) x WHERE in_fence AND NOT is_fence AND mm) y WHERE file NOT IN (SELECT path FROM files)""")
def mermaid_ghosts(d: Data):
    return A.mermaid_ghosts(d("md_lines"), d("files"))


@query("test_pairs", f"""SELECT path FROM files WHERE NOT {D.is_test('path')} AND regexp_replace(regexp_replace({D.basename('path')}, '\\.[cm]?[jt]sx?$', ''), '\\.(?:rs|py|go)$', '') IN (SELECT regexp_replace({D.basename('path')}, '\\.test\\.ts$', '') FROM files WHERE path LIKE '%.test.ts')""")
def test_pairs(d: Data):
    return J.test_pairs(d("files"))


@query("test_targets", f"""WITH t AS (SELECT path AS test, regexp_extract(path, '([^/]*)\\.test\\.ts$', 1) AS stem, string_split(path, '/') AS td FROM files WHERE path LIKE '%.test.ts'),
 s AS (SELECT path AS source, {D.stem('path')} AS stem, string_split(path, '/') AS sd FROM files WHERE NOT {D.is_test('path')} AND {D.domain('path')} IS NOT NULL)
 SELECT t.test, coalesce(s.source, t.test) AS target FROM t LEFT JOIN s ON s.stem = t.stem QUALIFY row_number() OVER (PARTITION BY t.test ORDER BY (CASE WHEN len(sd) > 2 AND len(td) > 2 AND sd[2] = td[2] THEN 1 ELSE 0 END) DESC, s.source) = 1""")
def test_targets(d: Data):
    return J.test_targets(d("files"))


@query("docs_mentions", f"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(line, '([A-Za-z0-9_@./-]*[A-Za-z0-9_])', 1)) AS token FROM md_lines)
 SELECT path FROM files WHERE NOT {D.is_test('path')} AND (path IN (SELECT token FROM w) OR {D.basename('path')} IN (SELECT token FROM w))""")
def docs_mentions(d: Data):
    return J.docs_mentions(d("files"), d("md_lines"))


def deps(d: Data):
    return d("manifests").select(F.col("dep").alias("name"), "version", "kind")


def scripts(d: Data):
    """One script per part; its command names a package now and then."""
    return d("part").select(
        F.expr("CASE p_partkey % 3 WHEN 0 THEN 'test' WHEN 1 THEN 'test:unit' ELSE 'build' END").alias("script"),
        F.expr("p_name || ' run x@s/p' || CAST(p_partkey % 1200 AS STRING) || ' --now'").alias("command"))


_SCRIPTS = "(SELECT CASE p_partkey % 3 WHEN 0 THEN 'test' WHEN 1 THEN 'test:unit' ELSE 'build' END AS script, '@s/p' || p_partkey % 1200 AS dep FROM part)"
_IMPORT_PAIRS = f"(SELECT DISTINCT path, {D.package('spec')} AS package FROM ({_IMPORTS}) t WHERE {D.package('spec')} IS NOT NULL)"
USAGE = f"""(SELECT m.name, CASE WHEN coalesce(i.prod, 0) > 0 THEN 'import' WHEN coalesce(i.test, 0) > 0 THEN 'test' WHEN m.name IN (SELECT dep FROM {_SCRIPTS} s) THEN 'script' ELSE 'none' END AS usage,
 CASE WHEN coalesce(i.prod, 0) > 0 THEN i.prod WHEN coalesce(i.test, 0) > 0 THEN i.test ELSE 0 END AS import_count FROM (SELECT DISTINCT dep AS name FROM manifests) m
 LEFT JOIN (SELECT package, count(*) FILTER (NOT {D.is_test('path')}) AS prod, count(*) FILTER ({D.is_test('path')}) AS test FROM {_IMPORT_PAIRS} p GROUP BY 1) i ON i.package = m.name)"""


def usage(d: Data):
    return J.dep_usage(deps(d), E.extract_imports(d("code_lines")), scripts(d))


@query("dep_usage", f"""SELECT u.*, coalesce(list_filter(f.files, lambda x: u.usage IN ('import', 'test') AND {D.is_test('x')} = (u.usage = 'test')), []) AS import_files FROM {USAGE} u
 LEFT JOIN (SELECT package, list(path ORDER BY path) AS files FROM {_IMPORT_PAIRS} p GROUP BY 1) f ON f.package = u.name""")
def dep_usage(d: Data):
    return usage(d)


@query("dep_files", f"SELECT package, path, row_number() OVER (PARTITION BY package ORDER BY {D.is_test('path')}, path) AS rank FROM {_IMPORT_PAIRS} p QUALIFY rank <= 5")
def dep_files(d: Data):
    return J.dep_files(E.extract_imports(d("code_lines")))


PARTITION = f"""(SELECT m.name, m.version, usage, CASE WHEN usage = 'test' THEN 'test' WHEN usage = 'none' THEN 'unused' WHEN kind = 'prod' AND usage = 'import' THEN 'core' WHEN kind = 'dev' AND usage IN ('import', 'script') THEN 'dev' END AS "group"
 FROM (SELECT dep AS name, arg_min(version, CASE kind WHEN 'prod' THEN '0' ELSE '1' END || version) AS version, arg_min(kind, CASE kind WHEN 'prod' THEN '0' ELSE '1' END || version) AS kind FROM manifests GROUP BY 1) m JOIN {USAGE} u ON u.name = m.name)"""


@query("dep_partition", f"""SELECT * FROM {PARTITION} p WHERE "group" IS NOT NULL""")
def dep_partition(d: Data):
    return J.dep_partition(deps(d), usage(d))


@query("test_only_deps", f"""SELECT DISTINCT dep AS name FROM manifests WHERE dep NOT IN (SELECT package FROM {_IMPORT_PAIRS} p WHERE NOT {D.is_test('path')}) AND dep IN (SELECT package FROM {_IMPORT_PAIRS} p WHERE {D.is_test('path')}) AND dep NOT IN (SELECT dep FROM {_SCRIPTS} s WHERE script = 'build')""")
def test_only_deps(d: Data):
    return J.test_only_deps(deps(d), E.extract_imports(d("code_lines")), scripts(d))


def crates(d: Data):
    from codeloom.sources.readers import toml_deps

    return toml_deps(d("toml_lines"))


@query("crate_usage", r"""WITH c AS (SELECT DISTINCT regexp_extract(trim(line), '^([A-Za-z0-9_-]+)', 1) AS name FROM (SELECT path, line_no, line, last_value(nullif(regexp_extract(trim(line), '^\[([^\]]+)\]$', 1), '') IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no) AS section FROM toml_lines) a
  WHERE section IN ('dependencies', 'dev-dependencies') AND regexp_matches(trim(line), '^[A-Za-z0-9_-]+\s*='))
 SELECT name, replace(name, '-', '_') IN (SELECT regexp_extract(line, 'use ([A-Za-z0-9_]+)::', 1) FROM code_lines WHERE path LIKE '%.rs' UNION SELECT 'fs' UNION SELECT regexp_extract(line, '::(Value)', 1) FROM code_lines WHERE path LIKE '%.rs' UNION SELECT regexp_extract(line, '(tauri)::', 1) FROM code_lines WHERE path LIKE '%.rs') AS used FROM c""")
def crate_usage(d: Data):
    return J.crate_usage(crates(d), d("code_lines"))


@query("dep_commits", """WITH d AS (SELECT DISTINCT event_type AS name FROM events), h AS (SELECT name, hash, date, subject, row_number() OVER (PARTITION BY name ORDER BY date DESC, hash DESC) AS rank FROM d JOIN commits ON contains(subject, name || ' ') QUALIFY rank <= 2)
 SELECT name, rank, subject, 'commit:' || substr(hash, 1, 8) || ' (' || date || ')' AS anchor FROM h""")
def dep_commits(d: Data):
    return J.dep_commits(d("events").select(F.col("event_type").alias("name")).distinct(), d("commits"))


def workspace(d: Data):
    p = d("files").groupBy("module").agg(F.min("doc_id").alias("ord"))
    return p.select(F.col("module").alias("name"), F.concat(F.lit("src/"), "module").alias("dir"), "ord")


def flat_imports(d: Data):
    """Cross-module imports with one step up, as the path rewrite resolves them."""
    line = F.regexp_replace("line", r"'\.\./\.\./(m\d+)/", "'../$1/")
    return d("code_lines").select(F.regexp_replace("path", r"^(src/m\d+)/(?:core/|api/)?", "$1/").alias("path"), "line_no", line.alias("line"))


PKG_EDGES = r"""(SELECT f AS from_pkg, t AS to_pkg, count(*) AS import_count, (f, t) IN (SELECT (pkg, 'm' || regexp_extract(dep, '(\d+)$', 1)) FROM manifests) AS declared FROM (
 SELECT regexp_extract(path, '^src/(m\d+)/', 1) AS f, regexp_extract(line, '''\.\./\.\./(m\d+)/', 1) AS t FROM code_lines WHERE path LIKE 'src/%' AND regexp_matches(path, '\.(?:ts|tsx|js|jsx|vue|mjs|cjs)$') AND regexp_matches(line, '^import .*''\.\./\.\./m\d+/')) x
 WHERE f <> t AND t IN (SELECT module FROM files) GROUP BY 1, 2)"""


def pkg_edges(d: Data):
    declared = d("manifests").select(F.col("pkg").alias("name"), F.concat(F.lit("m"), F.regexp_extract("dep", r"(\d+)$", 1)).alias("dep"))
    return J.package_edges(flat_imports(d), workspace(d), declared)


@query("package_edges", f"SELECT * FROM {PKG_EDGES} e")
def package_edges(d: Data):
    return pkg_edges(d)


@query("undeclared_edges", f"SELECT from_pkg, to_pkg, import_count FROM {PKG_EDGES} e WHERE NOT declared")
def undeclared_edges(d: Data):
    return J.undeclared_edges(pkg_edges(d))


MATCHED = f"""(SELECT CASE WHEN role IN ('call', 'define') THEN 'command' ELSE 'event' END AS ipc_kind, {D.snake('name')} AS key, arg_min(name, CASE role WHEN 'define' THEN '0' ELSE '1' END || path || lpad(CAST(line_no AS VARCHAR), 9, '0')) AS name,
 count(*) FILTER (role = 'call') AS calls, count(*) FILTER (role = 'define') AS defines, count(*) FILTER (role = 'listen') AS listeners, count(*) FILTER (role = 'emit') AS emits FROM {_IPC} p GROUP BY 1, 2)"""


@query("ipc_match", f"SELECT * FROM {MATCHED} m")
def ipc_match(d: Data):
    return J.ipc_match(G.ipc_points(ipc_texts(d)))


#: names looked for: every symbol in camel form, and some with punctuation
_ABSENT = "(SELECT DISTINCT CASE WHEN id % 40 = 0 THEN 'evt-' || docstring ELSE 'fn' || upper(substr(name, 4, 1)) || substr(name, 5) END AS name, CASE id % 60 WHEN 0 THEN 'any' WHEN 20 THEN 'rust' ELSE 'frontend' END AS side FROM symbols WHERE docstring IS NOT NULL)"


def absent_names(d: Data):
    d("symbols").createOrReplaceTempView("symbols")
    return d.spark.sql(f"SELECT * FROM {_ABSENT} t")


def _forms(names: str) -> str:
    return f"(SELECT name, side, name AS form FROM {names} a UNION SELECT name, side, {D.snake('name')} FROM {names} b UNION SELECT name, side, name FROM {names} c)"


@query("verify_absence", f"""WITH n AS MATERIALIZED {_ABSENT}, f AS {_forms('n')}, c AS (SELECT path, line_no, line FROM code_lines WHERE NOT regexp_matches(line, '^\\s*(?://|/\\*|\\*|#)')),
 h AS (SELECT DISTINCT f.name, f.side, c.path, c.line_no FROM f JOIN c ON contains(c.line, f.form) WHERE f.side = 'any' OR (f.side = 'rust') = (c.path LIKE '%.rs')),
 t AS (SELECT *, row_number() OVER (PARTITION BY name, side ORDER BY path, line_no) AS ref_no FROM h QUALIFY ref_no <= 3)
 SELECT n.name, n.side, CASE WHEN t.path IS NULL THEN 'confirmed' ELSE 'suspect' END AS verdict, t.ref_no, t.path, t.line_no FROM n LEFT JOIN t ON n.name = t.name AND n.side = t.side""")
def verify_absence(d: Data):
    return J.verify_absence(absent_names(d), d("code_lines"))


@query("ipc_reconcile", f"""WITH m AS {MATCHED}, g AS (SELECT ipc_kind, name, 'frontend' AS side, 'call' AS missing FROM m WHERE ipc_kind = 'command' AND calls = 0 UNION ALL SELECT ipc_kind, name, 'rust', 'define' FROM m WHERE ipc_kind = 'command' AND defines = 0
  UNION ALL SELECT ipc_kind, name, 'any', 'emit' FROM m WHERE ipc_kind = 'event' AND emits = 0 UNION ALL SELECT ipc_kind, name, 'frontend', 'listen' FROM m WHERE ipc_kind = 'event' AND listeners = 0),
 f AS (SELECT DISTINCT name, side, name AS form FROM g UNION SELECT name, side, 'cmd' || upper(substr(name, 5, 1)) || regexp_replace(substr(name, 6), '_(\\d)', '\\1') FROM g WHERE ipc_kind = 'command'),
 c AS (SELECT path, line_no, line FROM code_lines WHERE NOT regexp_matches(line, '^\\s*(?://|/\\*|\\*|#)')),
 h AS (SELECT DISTINCT f.name, f.side FROM f JOIN c ON contains(c.line, f.form) WHERE (f.side = 'any' OR (f.side = 'rust') = (c.path LIKE '%.rs')) AND NOT (c.line LIKE 'listen(%' AND contains(c.line, '''' || f.name || '''')))
 SELECT g.ipc_kind, g.name, g.missing, CASE WHEN h.name IS NULL THEN 'orphan' ELSE 'scan-limit' END AS state FROM g LEFT JOIN h ON g.name = h.name AND g.side = h.side""")
def ipc_reconcile(d: Data):
    points = cut_lineage(G.ipc_points(ipc_texts(d)))
    return J.ipc_reconcile(cut_lineage(J.ipc_match(points)), points, d("code_lines"))


@query("method_resolution", rf"""WITH defs AS (SELECT DISTINCT name AS method, file FROM symbols WHERE label = 'Method' AND NOT {D.is_test('file')}), t AS (SELECT method, count(*) AS candidates FROM defs GROUP BY 1),
 s AS (SELECT path, line_no, method FROM (SELECT path, line_no, unnest(regexp_extract_all(line, {D.rx(P.METHOD_CALL)}, 1)) AS method FROM code_lines) q WHERE method NOT IN {D.values(vocab.BUILTIN_METHODS)}),
 u AS (SELECT DISTINCT path, regexp_extract(line, 'use\s+([A-Za-z0-9_:]+);', 1) AS used FROM code_lines WHERE regexp_matches(line, 'use\s+[A-Za-z0-9_:]+;')),
 p AS (SELECT s.path, s.method, d.file, len(list_filter(string_split(d.file, '/'), lambda x: x <> 'src' AND NOT ends_with(x, '.rs'))) = 0 OR EXISTS (SELECT 1 FROM u WHERE u.path = s.path AND len(list_filter(string_split(d.file, '/'), lambda x: x <> 'src' AND NOT ends_with(x, '.rs') AND contains(u.used, x))) > 0) AS ok
  FROM (SELECT DISTINCT path, method FROM s) s JOIN defs d ON d.method = s.method)
 SELECT s.path, s.line_no, s.method, t.candidates, CASE WHEN t.candidates = 1 OR (SELECT bool_and(ok) FROM p WHERE p.path = s.path AND p.method = s.method) THEN 'resolved' ELSE 'ambiguous' END AS confidence FROM s JOIN t ON t.method = s.method""")
def method_resolution(d: Data):
    methods = d("symbols").filter("label = 'Method'")
    return J.method_resolution(E.method_call_sites(d("code_lines"), methods), methods, d("code_lines"))


@query("dep_consistency", f"""SELECT l.name, l.usage AS left_usage, r.usage AS right_usage FROM {USAGE} l JOIN (SELECT p.name, CASE WHEN regexp_matches(p.name, '5$') THEN 'none' ELSE p.usage END AS usage FROM {PARTITION} p WHERE "group" IS NOT NULL) r ON r.name = l.name
 WHERE (l.usage = 'import') <> (r.usage = 'import')""")
def dep_consistency(d: Data):
    right = J.dep_partition(deps(d), usage(d)).withColumn("usage", F.when(F.col("name").rlike("5$"), "none").otherwise(F.col("usage")))
    return J.dep_consistency(usage(d), right)


@query("term_variants", f"""SELECT page, norm, standard, min(term) AS term FROM (SELECT t.page, t.term, lower(regexp_replace(t.term, '[^A-Za-z0-9]', '', 'g')) AS norm FROM {TERMS} t) t
 JOIN (SELECT lower(regexp_replace(name, '[^A-Za-z0-9]', '', 'g')) AS n, min(name) AS standard FROM symbols GROUP BY 1) g ON g.n = t.norm WHERE t.term <> g.standard AND length(norm) >= 3 GROUP BY 1, 2, 3""")
def term_variants(d: Data):
    return J.term_variants(M.extract_terms(d("md_lines")), d("symbols").select(F.col("name").alias("term")), limit=None)


@query("evaluate_confirmations", """SELECT 'c' || doc_id AS raw, CASE doc_id % 4 WHEN 0 THEN doc_id % 8 = 0 WHEN 1 THEN true WHEN 2 THEN false ELSE false END AS valid FROM documents""")
def evaluate_confirmations(d: Data):
    name = F.concat(F.lit("d"), "doc_id")
    k = F.col("doc_id") % 4
    # no files: judged by head; own hash: valid; changed text: stale; unknown file: stale
    files = F.when(k == 0, F.array().cast("array<string>")).when(k == 3, F.array(F.lit("gone"))).otherwise(F.array(name))
    hashes = F.when(k == 0, F.array().cast("array<string>")).when(k == 2, F.array(F.sha2(F.concat("text", F.lit("x")), 256))).otherwise(F.array(F.sha2("text", 256)))
    store = d("documents").select(F.concat(F.lit("c"), "doc_id").alias("raw"), files.alias("files"), hashes.alias("hashes"), F.when(F.col("doc_id") % 8 == 0, "h1").otherwise("h0").alias("head"))
    return J.evaluate_confirmations(store, d("documents").select(name.alias("path"), "text"), "h1")


FAN_IN = "(SELECT s.id, s.name, s.qualified_name, count(*) AS fan_in FROM edges e JOIN symbols s ON e.dst = s.id WHERE e.type = 'CALLS' GROUP BY 1, 2, 3)"


def fan_in(d: Data):
    counts = d("edges").filter("type = 'CALLS'").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("fan_in"))
    return counts.join(d("symbols").select("id", "name", "qualified_name"), "id")


@query("hotspot_files", f"""WITH h AS (SELECT * FROM {FAN_IN} f ORDER BY fan_in DESC, id LIMIT 15) SELECT h.id, h.name, h.qualified_name, h.fan_in, (SELECT min(s.file) FROM symbols s WHERE s.name = h.name AND NOT s.is_test AND s.file IN (SELECT path FROM files)) AS file FROM h""")
def hotspot_files(d: Data):
    return J.hotspot_files(fan_in(d), d("symbols"), d("files"))


@query("class_methods", """SELECT DISTINCT c.name AS class_name, c.file AS class_file, c.start_line AS class_line, m.name AS method, m.file AS method_file, m.start_line AS method_line
 FROM (SELECT DISTINCT src, dst FROM edges WHERE type = 'DEFINES_METHOD') e JOIN symbols c ON c.id = e.src JOIN symbols m ON m.id = e.dst WHERE c.label = 'Class' AND NOT c.is_test AND m.label = 'Method'""")
def class_methods(d: Data):
    return J.class_methods(d("symbols"), d("edges"), limit=None).distinct()


@query("module_relations", f"""WITH k AS (SELECT DISTINCT caller_module AS f, callee_module AS t FROM {SYM_EDGES} s WHERE type = 'CALLS' AND caller_module <> callee_module)
 SELECT f AS module, 'outgoing' AS direction, t AS neighbour FROM k UNION ALL SELECT t, 'incoming', f FROM k""")
def module_relations(d: Data):
    from codeloom.operators.aggregate import module_boundaries

    return J.module_relations(module_boundaries(calls(d)), d("files").select("module"))
