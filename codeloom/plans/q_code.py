"""Queries: facts from source lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import patterns as P, vocab
from codeloom.operators import evidence as V, extract_code as E, extract_web as G, lines as L
from codeloom.plans import duck as D
from codeloom.plans.catalog import Data, query
from codeloom.session import cut_lineage

PROD = f"(SELECT * FROM code_lines WHERE NOT {D.is_test('path')})"
JS = r"regexp_matches(path, '\.(?:vue|ts|tsx|js|jsx)$')"


@query("line_table", """SELECT doc_id AS path, CAST(generate_subscripts(ls, 1) AS INT) AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) t""")
def line_table(d: Data):
    return L.line_table(d("documents").select(F.col("doc_id").alias("path"), "text"))


@query("line_context", f"""SELECT page, count(*) AS open_lines, count(*) FILTER (in_details) AS detail_lines FROM (
 SELECT page, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY page ORDER BY line_no), false) OR mark IS NOT NULL AS in_details
 FROM (SELECT page, line_no, CASE WHEN line LIKE '%anchor |' THEN true WHEN line LIKE 'See [next]%' THEN false END AS mark FROM {D.OPEN_MD} o) a) b GROUP BY 1""")
def line_context(d: Data):
    line = F.when(F.col("line").endswith("anchor |"), "<details>").when(F.col("line").startswith("See [next]"), "</details>").otherwise(F.col("line"))
    rows = L.with_details(d("md_lines").withColumn("line", line))
    return rows.groupBy("page").agg(F.count("*").alias("open_lines"), F.count_if("in_details").alias("detail_lines"))


_IMPORTS = f"""SELECT path, line_no, unnest(regexp_extract_all(line, {D.rx(P.ES_IMPORT)}, 1)) AS spec FROM code_lines WHERE {D.ext('path')} IN {D.values(vocab.CODE_EXTENSIONS)}"""


@query("extract_imports", f"SELECT DISTINCT path, {D.package('spec')} AS package FROM ({_IMPORTS}) t WHERE {D.package('spec')} IS NOT NULL")
def extract_imports(d: Data):
    return E.extract_imports(d("code_lines"))


@query("extract_native_imports", """SELECT stack, count(DISTINCT path) AS files FROM (SELECT path, CASE WHEN path LIKE '%.py' AND line = 'from flask import Flask' THEN 'flask' WHEN path LIKE '%.py' AND line = 'import requests, os' THEN 'requests'
 WHEN path LIKE '%.go' AND line LIKE '%gin-gonic/gin"' THEN 'gin' END AS stack FROM code_lines) t WHERE stack IS NOT NULL GROUP BY 1""")
def extract_native_imports(d: Data):
    return E.extract_native_imports(d("code_lines"))


_ENV = r"""(SELECT path, line_no, line, coalesce(nullif(regexp_extract(line, 'process\.env\.([A-Z_][A-Z0-9_]*)', 1), ''), nullif(regexp_extract(line, 'os\.getenv\(\s*[''"]([A-Z_][A-Z0-9_]*)[''"]', 1), ''), nullif(regexp_extract(line, 'os\.Getenv\(\s*"([A-Z_][A-Z0-9_]*)"', 1), '')) AS name
 FROM code_lines WHERE NOT """ + D.plain_comment("line") + ")"


@query("env_var_census", f"""SELECT DISTINCT name, path, regexp_matches(name, '(?i)KEY|SECRET|TOKEN|PASSWORD|CREDENTIAL') AS sensitive FROM {_ENV} e WHERE name IS NOT NULL AND NOT {D.is_test('path')}""")
def env_var_census(d: Data):
    return E.env_var_census(d("code_lines"))


def _env_samples(d: Data):
    line = F.expr("CASE i % 3 WHEN 0 THEN '# use of ' || w WHEN 1 THEN 'GO_KEY_' || upper(w) || '=1' ELSE '' END")
    return d("sentences").select(F.expr("'pkg' || CAST(doc_id AS STRING) || '/.env.example'").alias("path"), (F.col("i") + 1).cast("int").alias("line_no"), line.alias("line"))


@query("env_var_purpose", rf"""WITH placed AS (SELECT path, line_no, line, lag(line) OVER w AS p1, lag(line, 2) OVER w AS p2, lag(line, 3) OVER w AS p3 FROM code_lines WINDOW w AS (PARTITION BY path ORDER BY line_no)),
 near AS (SELECT path, line_no, coalesce(nullif(trim(p1), ''), nullif(trim(p2), ''), nullif(trim(p3), '')) AS a FROM placed),
 above AS (SELECT path, line_no, nullif(CASE WHEN starts_with(a, '//') THEN trim(substr(a, 3)) WHEN starts_with(a, '*') THEN trim(regexp_replace(a, '^\*+', '')) WHEN starts_with(a, '#') THEN trim(substr(a, 2)) END, '') AS above FROM near),
 refs AS (SELECT e.name, e.path, e.line_no, trim(regexp_replace(coalesce(nullif(regexp_extract(e.line, '(?://|#)\s*(.{{2,100}})\s*$', 1), ''), x.above), '^\s*[*#]*\s*', '')) AS comment,
  coalesce(nullif(regexp_extract(e.line, 'process\.env\.[A-Z_][A-Z0-9_]*\s*(?:\?\?|\|\|)\s*([''"`][^''"`]*[''"`]|true|false|\d+)', 1), ''), nullif(regexp_extract(e.line, 'os\.getenv\(\s*[''"][A-Z_][A-Z0-9_]*[''"]\s*,\s*([^)]+)\)', 1), '')) AS dflt
  FROM {_ENV} e LEFT JOIN above x ON e.path = x.path AND e.line_no = x.line_no WHERE e.name IS NOT NULL),
 found AS (SELECT name, 0 AS src, path, line_no, CASE WHEN length(comment) >= 2 THEN substr(comment, 1, 100) WHEN dflt IS NOT NULL THEN '缺省值 ' || dflt END AS purpose FROM refs
  UNION ALL SELECT 'GO_KEY_' || upper(w), 1, 'pkg' || doc_id || '/.env.example', i + 1, substr('.env.example：use of ' || prev, 1, 100) FROM (SELECT doc_id, i, w, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM sentences) q WHERE i % 3 = 1),
 best AS (SELECT name, purpose FROM found WHERE purpose IS NOT NULL QUALIFY row_number() OVER (PARTITION BY name ORDER BY src, path, line_no) = 1)
 SELECT w.name, b.purpose FROM (SELECT DISTINCT name FROM {_ENV} e WHERE name IS NOT NULL AND NOT {D.is_test('path')}) w LEFT JOIN best b ON w.name = b.name""")
def env_var_purpose(d: Data):
    return E.env_var_purpose(d("code_lines"), _env_samples(d))


@query("constants_census", rf"""SELECT path, line_no, name, trim(value) AS value FROM (SELECT path, line_no,
 CASE WHEN path LIKE '%.py' THEN regexp_extract(line, '^([A-Z0-9_]*?(?:MAX|MIN|LIMIT|TIMEOUT|DEPTH|SIZE|COUNT|THRESHOLD|RETRY|CACHE)[A-Z0-9_]*)\s*=\s*([^#\n]+)', 1) WHEN path LIKE '%.go' THEN regexp_extract(line, '^const\s+([A-Za-z0-9_]*)\s*=\s*([^;\n]+)', 1) ELSE regexp_extract(line, {D.rx(P.CONSTANT)}, 1) END AS name,
 CASE WHEN path LIKE '%.py' THEN regexp_extract(line, '^([A-Z0-9_]*?(?:MAX|MIN|LIMIT|TIMEOUT|DEPTH|SIZE|COUNT|THRESHOLD|RETRY|CACHE)[A-Z0-9_]*)\s*=\s*([^#\n]+)', 2) WHEN path LIKE '%.go' THEN regexp_extract(line, '^const\s+([A-Za-z0-9_]*)\s*=\s*([^;\n]+)', 2) ELSE regexp_extract(line, {D.rx(P.CONSTANT)}, 2) END AS value
 FROM code_lines WHERE NOT {D.plain_comment('line')}) t WHERE name <> ''""")
def constants_census(d: Data):
    return E.constants_census(d("code_lines"))


@query("exit_code_census", rf"SELECT path, line_no, CAST(regexp_extract(line, 'process\.exit\((\d+)\)', 1) AS INT) AS code, substr(trim(line), 1, 80) AS context FROM {PROD} c WHERE path LIKE '%.ts' AND regexp_matches(line, 'process\.exit\(\d+\)')")
def exit_code_census(d: Data):
    return E.exit_code_census(d("code_lines"))


@query("cli_options", rf"SELECT path, line_no, 0 AS match_no, regexp_extract(line, '\.option\(''([^'']+)'', ''([^'']+)''', 1) AS flag, regexp_extract(line, '\.option\(''([^'']+)'', ''([^'']+)''', 2) AS description FROM code_lines WHERE line LIKE '%.option(%'")
def cli_options(d: Data):
    return E.cli_options(d("code_lines"))


@query("cli_descriptions", r"""SELECT path, arg_min(regexp_extract(line, '\.command\(''[^'']+'', ''([^'']+)''', 1), line_no) AS description FROM code_lines WHERE line LIKE 'program.command(%' GROUP BY 1""")
def cli_descriptions(d: Data):
    return E.cli_descriptions(d("code_lines"))


_IO_SQL = r"""SELECT path, line_no, kind, direction, expression, medium FROM (
 SELECT path, line_no, 'config' AS kind, 'input' AS direction, regexp_extract(line, '(JSON\.parse\(readFileSync\([^()]*\)\))', 1) AS expression, regexp_extract(line, 'readFileSync\(([^,()]*),', 1) AS medium FROM code_lines WHERE line LIKE '%JSON.parse(readFileSync(%'
 UNION ALL SELECT path, line_no, 'fs-write', 'output', regexp_extract(line, '(writeFileSync\([^()]*\([^()]*\)\))', 1), regexp_extract(line, 'writeFileSync\(([^,()]*),', 1) FROM code_lines WHERE line LIKE '%writeFileSync(%'
 UNION ALL SELECT path, line_no, 'env', 'input', regexp_extract(line, '(process\.env\.[A-Za-z0-9_]+)', 1), regexp_extract(line, '(process\.env\.[A-Za-z0-9_]+)', 1) FROM code_lines WHERE line LIKE '%process.env.%' AND regexp_matches(path, '\.(ts|tsx|vue)$')
 UNION ALL SELECT path, line_no, 'stdout', 'output', regexp_extract(line, '(console\.log\([^()]*\))', 1), regexp_extract(line, 'console\.log\(([^()]*)\)', 1) FROM code_lines WHERE line LIKE '%console.log(%'
 UNION ALL SELECT path, line_no, 'fs-read', 'input', 'fs::read_to_string(p)', 'p' FROM code_lines WHERE line LIKE '%fs::read_to_string(p)%'
 UNION ALL SELECT path, line_no, 'fs-read', 'input', 'open(a)', 'a' FROM code_lines WHERE line LIKE '%print(open(a))%'
 UNION ALL SELECT path, line_no, 'stdout', 'output', 'print(open(a))', 'open(a)' FROM code_lines WHERE line LIKE '%print(open(a))%'
 UNION ALL SELECT path, line_no, 'env', 'input', regexp_extract(line, '(os\.getenv\(''[A-Z_]+)', 1), 'process.env.' || regexp_extract(line, 'os\.getenv\(''([A-Z_]+)', 1) FROM code_lines WHERE line LIKE '%os.getenv(%'
 UNION ALL SELECT path, line_no, 'env', 'input', regexp_extract(line, '(os\.Getenv\("[A-Z_]+)', 1), 'process.env.' || regexp_extract(line, 'os\.Getenv\("([A-Z_]+)', 1) FROM code_lines WHERE line LIKE '%os.Getenv(%') t"""


@query("io_event_census", _IO_SQL)
def io_event_census(d: Data):
    return E.io_event_census(d("code_lines"))


_BODIES = """bodies AS (
 WITH n AS (SELECT path, max(line_no) AS n_lines FROM code_lines GROUP BY 1),
 p AS (SELECT id, file AS path, start_line, end_line, n_lines FROM symbols JOIN n ON file = path WHERE start_line <= n_lines),
 k AS (SELECT id, path, start_line AS from_line, least(end_line, n_lines) AS to_line, false AS approximated FROM p WHERE end_line > start_line),
 r AS (SELECT id, path, start_line AS from_line, n_lines, (SELECT min(q.start_line) - 1 FROM symbols q WHERE q.file = p.path AND q.start_line > p.start_line) AS before_next FROM p WHERE end_line IS NULL OR end_line <= start_line),
 b AS (SELECT path, line_no, unnest(cs) AS br, generate_subscripts(cs, 1) AS k FROM (SELECT path, line_no, regexp_extract_all(regexp_replace(regexp_replace(line, '''(?:[^''\\\\]|\\\\.)*''|"(?:[^"\\\\]|\\\\.)*"|`[^`]*`', '', 'g'), '//.*$', ''), '[{}]') AS cs FROM code_lines) z WHERE len(cs) > 0),
 bd AS MATERIALIZED (SELECT path, line_no, br, sum(CASE br WHEN '{' THEN 1 ELSE -1 END) OVER w AS d, row_number() OVER w AS pos FROM b WINDOW w AS (PARTITION BY path ORDER BY line_no, k)),
 s AS (SELECT id, r.path, coalesce(arg_max(d, pos) FILTER (bd.line_no < from_line), 0) AS d0, min(pos) FILTER (bd.line_no >= from_line AND br = '{') AS o FROM r LEFT JOIN bd ON bd.path = r.path GROUP BY 1, 2),
 e AS (SELECT s.id, min(bd.line_no) AS close_line FROM s JOIN bd ON bd.path = s.path AND bd.pos > s.o AND bd.br = '}' AND bd.d = s.d0 GROUP BY 1)
 SELECT * FROM k UNION ALL SELECT r.id, path, from_line, coalesce(close_line, before_next, n_lines), close_line IS NULL FROM r LEFT JOIN e ON r.id = e.id)"""


@query("body_ranges", f"WITH {_BODIES} SELECT * FROM bodies")
def body_ranges(d: Data):
    return E.body_ranges(d("symbols"), d("code_lines"))


@query("io_in_bodies", f"WITH {_BODIES}, io AS ({_IO_SQL}) SELECT id, kind, count(*) AS events FROM bodies b JOIN io ON b.path = io.path AND io.line_no BETWEEN from_line AND to_line GROUP BY 1, 2")
def io_in_bodies(d: Data):
    bodies = E.body_ranges(d("symbols"), d("code_lines"))
    return E.io_event_census(d("code_lines"), bodies).groupBy("id", "kind").agg(F.count("*").alias("events"))


@query("return_literals", rf"""WITH {_BODIES}, r AS (SELECT path, line_no, trim(regexp_extract(line, '\breturn\s+([^;\n]+)', 1)) AS expression FROM code_lines WHERE regexp_matches(line, '\breturn\s')),
 t AS (SELECT *, CASE WHEN regexp_matches(expression, '^''[^'']*''$') THEN 'string' WHEN regexp_matches(expression, '^-?\d+$') THEN 'number' WHEN expression IN ('true', 'false') THEN 'boolean' END AS shape FROM r)
 SELECT id, t.line_no, expression, shape FROM bodies b JOIN t ON b.path = t.path AND t.line_no BETWEEN from_line AND to_line WHERE shape IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY t.line_no) = 1""")
def return_literals(d: Data):
    return E.return_literals(E.body_ranges(d("symbols"), d("code_lines")), d("code_lines"))


@query("symbol_snippets", f"""WITH {_BODIES} SELECT s.id, s.qualified_name, x.start_line, nullif(x.source, '') AS source FROM symbols s LEFT JOIN (
 SELECT b.id, b.from_line AS start_line, string_agg(c.line, chr(10) ORDER BY c.line_no) AS source FROM bodies b JOIN code_lines c ON b.path = c.path AND c.line_no BETWEEN from_line AND to_line GROUP BY 1, 2) x ON s.id = x.id""")
def symbol_snippets(d: Data):
    return E.symbol_snippets(d("symbols"), d("code_lines"), E.body_ranges(d("symbols"), d("code_lines")))


def _duck_definition(group: str) -> str:
    """Definition name or kind by domain, for the domains the views hold."""
    arms = []
    for domain, rules in P.DEFINITIONS.items():
        plain = [(p.replace("(?!=)", ""), k) for p, k in rules]
        if group == "name":
            body = "coalesce(" + ", ".join(f"nullif(regexp_extract(trim(line), {D.rx(p)}, 1), '')" for p, _ in plain) + ")"
        else:
            body = "CASE " + " ".join(f"WHEN regexp_matches(trim(line), {D.rx(p)}) THEN '{k}'" for p, k in plain) + " END"
        arms.append(f"WHEN '{domain}' THEN {body}")
    hidden = rf"{D.domain('path')} IN ('python', 'go', 'jvm', 'swift') AND regexp_matches(trim(line), '^(?://|/\*|\*|#)')"
    return f"CASE WHEN {hidden} THEN NULL ELSE CASE {D.domain('path')} {' '.join(arms)} END END"


_DEFS = f"(SELECT path, line_no, line, {_duck_definition('name')} AS name, {_duck_definition('kind')} AS type FROM code_lines)"


@query("defined_names", f"SELECT name, type, count(*) AS places FROM {_DEFS} d WHERE name IS NOT NULL GROUP BY 1, 2")
def defined_names(d: Data):
    return E.defined_names(d("code_lines")).groupBy("name", "type").agg(F.count("*").alias("places"))


@query("find_definitions", f"""SELECT name, type, path, line_no, substr(trim(line), 1, 160) AS signature FROM {_DEFS} d WHERE NOT {D.is_test('path')} AND name IN (SELECT name FROM symbols WHERE length(name) >= 3)
 QUALIFY row_number() OVER (PARTITION BY name ORDER BY path, line_no) = 1""")
def find_definitions(d: Data):
    return E.find_definitions(d("code_lines"), d("symbols").select("name"))


@query("search_code", "SELECT path, line_no FROM code_lines WHERE contains(line, 'fn_10')")
def search_code(d: Data):
    return E.search_code(d("code_lines"), "fn_10")


@query("search_totals", "SELECT count(*) AS total, count(DISTINCT doc_id) AS files FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) t WHERE contains(line, 'the')")
def search_totals(d: Data):
    return E.search_totals(L.line_table(d("documents").select(F.col("doc_id").alias("path"), "text")), "the")


@query("method_call_sites", rf"""SELECT path, line_no, method FROM (SELECT path, line_no, unnest(regexp_extract_all(line, {D.rx(P.METHOD_CALL)}, 1)) AS method FROM code_lines) t
 WHERE method NOT IN {D.values(vocab.BUILTIN_METHODS)} AND method IN (SELECT name FROM symbols WHERE label = 'Method')""")
def method_call_sites(d: Data):
    return E.method_call_sites(d("code_lines"), d("symbols").filter("label = 'Method'")).drop("match_no")


@query("reexport_graph", """SELECT path, line_no, CASE WHEN line LIKE 'export *%' THEN 'star' ELSE 'named' END AS kind, regexp_extract(line, 'from ''([^'']+)''', 1) AS target FROM code_lines
 WHERE line LIKE 'export * from %' OR line LIKE 'export { c } from %'""")
def reexport_graph(d: Data):
    return E.reexport_graph(d("code_lines"))


@query("exported_declarations", f"""SELECT path, line_no, regexp_extract(line, {D.rx(P.EXPORT_DECL)}, 1) AS name FROM code_lines WHERE regexp_matches(line, {D.rx(P.EXPORT_DECL)})""")
def exported_declarations(d: Data):
    return E.exported_declarations(d("code_lines"))


@query("reexport_shells", f"""SELECT path FROM code_lines WHERE NOT (trim(line) = '' OR starts_with(trim(line), '//') OR starts_with(trim(line), '/*') OR starts_with(trim(line), '*'))
 GROUP BY 1 HAVING bool_and(regexp_matches(trim(line), {D.rx(P.REEXPORT_LINE)}))""")
def reexport_shells(d: Data):
    return E.reexport_shells(d("code_lines"))


@query("test_titles", f"""SELECT path, line_no, regexp_extract(line, '(?:describe|it|test)\\(''([^'']+)''', 1) AS title FROM code_lines WHERE regexp_matches(path, {D.rx(vocab.TEST_FILE_SUFFIX)}) AND regexp_matches(line, '(?:describe|it|test)\\(''([^'']+)''')""")
def test_titles(d: Data):
    return E.test_titles(d("code_lines"))


@query("edge_args", """SELECT l_returnflag AS flag, e AS expression, v AS value, count(*) AS uses FROM (SELECT l_returnflag, 'x' AS e, NULL AS v FROM lineitem WHERE l_linenumber = 2 UNION ALL SELECT l_returnflag, l_returnflag, '1' FROM lineitem WHERE l_linenumber = 2) t GROUP BY 1, 2, 3""")
def edge_args(d: Data):
    edges = d("edges").withColumn("flag", F.regexp_extract("args", r'"e":"(.)"', 1))
    return E.edge_args(edges).groupBy("flag", "expression", "value").agg(F.count("*").alias("uses"))


@query("signature_census", """SELECT id, module, pos, name, type, optional, rest FROM (
 SELECT id, module, signature, return_type, id % 5 AS k, substr(signature, 5, length(signature)) AS tail FROM symbols) s, LATERAL (
 SELECT 0 AS pos, 'a' AS name, substr(regexp_extract(signature, '^[(]a: ([^,]*),', 1), 1) AS type, false AS optional, false AS rest WHERE k = 1
 UNION ALL SELECT 1, 'b', regexp_extract(signature, 'b[?]: (Map<string, [^>]*>)', 1), true, false WHERE k = 1
 UNION ALL SELECT 0, 'xs', 'string[]', false, true WHERE k = 2
 UNION ALL SELECT 1, '{ a, b }', 'Opts', false, false WHERE k = 2
 UNION ALL SELECT 0, 'a', NULL, false, false WHERE k = 4
 UNION ALL SELECT 1, 'b', NULL, false, false WHERE k = 4) x""")
def signature_census(d: Data):
    return E.signature_census(d("symbols"))


@query("signature_counts", """SELECT module, sum(CASE id % 5 WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE 0 END) AS typed, sum(CASE id % 5 WHEN 4 THEN 2 ELSE 0 END) AS untyped FROM symbols WHERE id % 5 IN (1, 2, 4) GROUP BY 1""")
def signature_counts(d: Data):
    return E.signature_counts(d("symbols"))


@query("type_references", r"""WITH t AS (SELECT id, 'Promise<' || return_type || ' | Map<string, C_' || module || '>>' AS ty FROM symbols)
 SELECT DISTINCT id, r AS reference FROM (SELECT id, unnest(regexp_extract_all(ty, '([A-Za-z_$][A-Za-z0-9_$]*)', 1)) AS r FROM t) u WHERE regexp_matches(r, '^[A-Z]') AND r NOT IN ('Promise', 'Map')""")
def type_references(d: Data):
    ty = F.concat(F.lit("Promise<"), "return_type", F.lit(" | Map<string, C_"), "module", F.lit(">>"))
    return E.type_references(d("symbols").select("id", ty.alias("type")))


@query("routes_table", f"""WITH f AS (SELECT path, bool_or(regexp_matches(line, '\\bexpress\\b')) AS ex FROM code_lines GROUP BY 1)
 SELECT c.path, c.line_no, 'express' AS framework, upper(regexp_extract(line, '^(?:router|app)\\.(get|post)', 1)) AS method, regexp_extract(line, '\\(''([^'']+)''', 1) AS route,
  regexp_extract(line, '(handler\\d+|save\\d+)', 1) AS handler, CASE WHEN line LIKE 'router%' THEN 'auth,limit' ELSE '' END AS middleware
 FROM code_lines c JOIN f ON c.path = f.path WHERE ex AND regexp_matches(line, '^(?:router|app)\\.(get|post)') AND NOT {D.is_test('c.path')}
 UNION ALL SELECT path, line_no, 'fastapi', 'GET', regexp_extract(line, '''([^'']+)''', 1), coalesce(nullif(regexp_extract(nx, 'def\\s+([A-Za-z_][A-Za-z0-9_]*)', 1), ''), '（handler 未检出）'), '' FROM (
  SELECT path, line_no, line, lead(line) OVER (PARTITION BY path ORDER BY line_no) AS nx FROM code_lines WHERE path LIKE '%.py') p WHERE line LIKE '@app.get(%'
 UNION ALL SELECT path, line_no, 'go-http', 'GET', regexp_extract(line, '"([^"]+)"', 1), regexp_extract(line, '(handle\\d+)', 1), '' FROM code_lines WHERE line LIKE '%r.GET(%'""")
def routes_table(d: Data):
    return G.routes_table(d("code_lines"))


@query("frontend_routes", f"""SELECT path, line_no, regexp_extract(line, 'path: ''([^'']+)''', 1) AS route, coalesce(nullif(regexp_extract(nx, 'component: ([A-Za-z0-9]+)', 1), ''), '（组件未检出）') AS component, 'vue-router' AS source FROM (
 SELECT path, line_no, line, lead(line) OVER (PARTITION BY path ORDER BY line_no) AS nx, bool_or(line LIKE '%''vue-router''%') OVER (PARTITION BY path) AS v FROM code_lines WHERE path LIKE '%.tsx') t WHERE v AND line LIKE '%path: ''%'""")
def frontend_routes(d: Data):
    return G.frontend_routes(d("code_lines"))


@query("db_models", r"""WITH s AS (SELECT path, line_no, line, (line_no - 1) // 10 AS cycle, (line_no - 1) % 10 AS k FROM ddl_lines)
 SELECT m.path, m.kind, m.model, m.model_line, f.field, f.type, f.attrs FROM (
  SELECT path, cycle, 'sql' AS kind, regexp_extract(line, 'app\.([A-Za-z0-9_]+)', 1) AS model, line_no AS model_line FROM s WHERE path LIKE '%.sql' AND k = 0
  UNION ALL SELECT path, cycle, 'prisma', regexp_extract(line, '^model (\w+)', 1), line_no FROM s WHERE path LIKE '%.prisma' AND k = 6) m
 LEFT JOIN (SELECT path, cycle, 'sql' AS kind, CASE k WHEN 1 THEN 'id' ELSE regexp_extract(line, '^  (\w+)', 1) END AS field, CASE k WHEN 1 THEN 'INT' ELSE 'VARCHAR(20)' END AS type, CASE k WHEN 1 THEN 'NOT NULL' ELSE 'DEFAULT ''x''' END AS attrs FROM s WHERE path LIKE '%.sql' AND k IN (1, 2)
   AND NOT (k = 2 AND regexp_matches(line, '(?i)^  (?:PRIMARY|FOREIGN|UNIQUE|CONSTRAINT|INDEX|KEY|CHECK|CREATE)'))
  UNION ALL SELECT path, cycle, 'prisma', CASE k WHEN 7 THEN 'id' ELSE regexp_extract(line, '^  (\w+)', 1) END, CASE k WHEN 7 THEN 'Int' ELSE 'String?' END, CASE k WHEN 7 THEN '@id' ELSE '@unique' END FROM s WHERE path LIKE '%.prisma' AND k IN (7, 8)) f
 ON m.path = f.path AND m.cycle = f.cycle AND m.kind = f.kind""")
def db_models(d: Data):
    return G.db_models(d("ddl_lines"))


_WORDS = f"(SELECT DISTINCT path, unnest(regexp_extract_all(line, '([A-Za-z_$][A-Za-z0-9_$]*)', 1)) AS word FROM code_lines)"


@query("lexical_use_count", f"SELECT s.name, count(w.word) AS files FROM (SELECT DISTINCT name FROM symbols) s LEFT JOIN {_WORDS} w ON s.name = w.word GROUP BY 1")
def lexical_use_count(d: Data):
    return G.lexical_use_count(d("symbols").select("name"), d("code_lines"))


@query("component_facts", f"""WITH t AS (SELECT path, string_agg(line, chr(10) ORDER BY line_no) AS content FROM code_lines WHERE NOT {D.is_test('path')} GROUP BY 1),
 c AS (SELECT path, regexp_extract({D.basename('path')}, '^(.*)\\.vue$', 1) AS name, 'vue' AS framework, CASE WHEN content LIKE '%defineProps%' THEN 2 ELSE 0 END AS props_count,
  CASE WHEN content LIKE '%defineEmits%' THEN CASE WHEN regexp_extract(content, 'change'', ''([a-z]+)''', 1) = 'change' THEN 1 ELSE 2 END ELSE 0 END AS emits_count FROM t WHERE path LIKE '%.vue' AND (content LIKE '%<script%' OR content LIKE '%<template%')),
 w AS (SELECT word, count(*) AS n FROM {_WORDS} x WHERE {JS} AND NOT {D.is_test('path')} GROUP BY 1)
 SELECT path, name, framework, props_count, emits_count, name IN (SELECT regexp_extract(path, '([^/]*)\\.test\\.ts$', 1) FROM code_lines) AS test_paired, coalesce(n, 0) AS used_by FROM c LEFT JOIN w ON name = word""")
def component_facts(d: Data):
    lines = d("code_lines")
    return G.component_facts(L.rebuild(lines, "path"), lines)


_STORES = f"""(SELECT path, line_no, CASE WHEN line LIKE '%defineStore(%' THEN regexp_extract(line, 'defineStore\\(''([^'']+)''', 1) ELSE regexp_extract(line, '(use[A-Z]+State)', 1) END AS name,
 CASE WHEN line LIKE '%defineStore(%' THEN 'pinia' ELSE 'composable' END AS kind FROM code_lines WHERE {JS} AND NOT {D.is_test('path')} AND (line LIKE '%defineStore(%' OR regexp_matches(line, 'export const use[A-Z]+State ')))"""


@query("store_census", f"SELECT * FROM {_STORES} s")
def store_census(d: Data):
    return G.store_census(d("code_lines"))


@query("store_consumers", f"""WITH calls AS (SELECT DISTINCT path, unnest(regexp_extract_all(line, '([A-Za-z_$][A-Za-z0-9_$]*)\\s*\\(', 1)) AS word FROM code_lines WHERE {JS} AND NOT {D.is_test('path')})
 SELECT s.path, s.line_no, s.name, s.kind, count(DISTINCT c.path) AS consumers FROM {_STORES} s LEFT JOIN calls c ON c.path <> s.path AND c.word = CASE s.kind WHEN 'pinia' THEN 'use' || upper(substr(s.name, 1, 1)) || substr(s.name, 2) || 'Store' ELSE s.name END GROUP BY 1, 2, 3, 4""")
def store_consumers(d: Data):
    return G.store_consumers(G.store_census(d("code_lines")), d("code_lines"))


@query("state_keys", f"""SELECT s.path, s.name, s.kind, s.line_no, count(*) FILTER (regexp_matches(c.line, '^\\s{{2,}}[A-Za-z_$][A-Za-z0-9_$]*\\s*[:,]')) AS state_keys FROM {_STORES} s JOIN code_lines c ON c.path = s.path AND c.line_no >= s.line_no AND c.line_no < coalesce((SELECT min(n.line_no) FROM {_STORES} n WHERE n.path = s.path AND n.line_no > s.line_no), 1000000000) GROUP BY 1, 2, 3, 4""")
def state_keys(d: Data):
    return G.state_keys(G.store_census(d("code_lines")), d("code_lines"))


_IPC = rf"""(SELECT CASE WHEN path LIKE '%.rs' THEN 'src-tauri/' || path ELSE path END AS path, line_no, name, role, side FROM (
 SELECT path, line_no, regexp_extract(line, 'invoke\(''([^'']+)''', 1) AS name, 'call' AS role, 'frontend' AS side FROM code_lines WHERE line LIKE 'invoke(%'
 UNION ALL SELECT path, line_no, regexp_extract(line, 'listen\(''([^'']+)''', 1), 'listen', 'frontend' FROM code_lines WHERE line LIKE 'listen(%'
 UNION ALL SELECT path, line_no, regexp_extract(line, 'emit\("([^"]+)"', 1), 'emit', 'rust' FROM code_lines WHERE line LIKE '%app.emit(%'
 UNION ALL SELECT path, line_no, regexp_extract(line, 'fn (\w+)', 1), 'define', 'rust' FROM code_lines WHERE path LIKE '%.rs' AND line LIKE 'pub async fn %') t)"""


def ipc_texts(d: Data):
    texts = cut_lineage(L.rebuild(d("code_lines"), "path"))
    return texts.withColumn("path", F.when(F.col("path").endswith(".rs"), F.concat(F.lit("src-tauri/"), "path")).otherwise(F.col("path")))


@query("ipc_points", f"SELECT * FROM {_IPC} p")
def ipc_points(d: Data):
    return G.ipc_points(ipc_texts(d))


_CMT = r"""CASE WHEN starts_with(trim(line), '#!') THEN NULL WHEN starts_with(trim(line), '#') THEN substr(trim(line), 2) WHEN starts_with(trim(line), '//') THEN substr(trim(line), 3)
 WHEN starts_with(trim(line), '/*') THEN regexp_replace(regexp_replace(trim(line), '^/\*\*?', ''), '\*/$', '') WHEN starts_with(trim(line), '*') THEN regexp_replace(regexp_replace(trim(line), '^\* ?', ''), '\*/$', '') END"""


def _duck_clean(x: str) -> str:
    for p in (r"^/\*\*?", r"\*/$", r"^\s*//+", r"^\s*\*? ?", r"^\s*#+ ?"):
        x = f"regexp_replace({x}, '{p}', '')"
    x = rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"
    return f"rtrim(substr(regexp_replace({x}, '[A-Za-z0-9+/=_-]{{40,}}', '[REDACTED]', 'g'), 1, 240))"


def _duck_domain_extract(table: dict[str, str], default: str = "''") -> str:
    arms = " ".join(f"WHEN '{k}' THEN regexp_extract(line, {D.rx(p)}, 1)" for k, p in table.items())
    return f"CASE {D.domain('path')} {arms} ELSE {default} END"


EVIDENCE_SQL = rf"""(WITH r AS (SELECT path, line_no, line, {_CMT} AS c, {_duck_domain_extract(P.TOPLEVEL)} AS def, {_duck_domain_extract(P.NATIVE_CONSTANT, f"regexp_extract(line, {D.rx(P.COMMENTED_CONSTANT)}, 1)")} AS con FROM {PROD} q WHERE {D.domain('path')} IS NOT NULL),
 l AS (SELECT *, lag(c) OVER w AS c1, lag(c, 2) OVER w AS c2, lag(c, 3) OVER w AS c3,
   coalesce(sum(CASE WHEN c IS NULL AND trim(line) <> '' THEN 1 ELSE 0 END) OVER w, 0) AS stops, sum(CASE WHEN c IS NOT NULL THEN 1 ELSE 0 END) OVER w AS seen FROM r WINDOW w AS (PARTITION BY path ORDER BY line_no)),
 h0 AS (SELECT *, sum(CASE WHEN trim(line) = '' AND seen > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line_no) AS blanks FROM l),
 h AS (SELECT path, {_duck_clean("string_agg(c, ' ' ORDER BY line_no)")} AS text FROM h0 WHERE stops = 0 AND blanks = 0 AND c IS NOT NULL AND NOT regexp_matches(trim(c), '(?i)^(copyright|licensed|spdx|@license)') GROUP BY 1)
 SELECT 'file-header' AS kind, path AS file, 1 AS line_no, NULL AS symbol, text, path || ':1' AS anchor FROM h WHERE length(text) >= 12 AND text <> path AND NOT ends_with(text, {D.basename('path')})
 UNION ALL (SELECT 'symbol-comment', path, line_no, def, text, path || ':' || line_no FROM (SELECT *, {_duck_clean("CASE WHEN c2 IS NULL THEN c1 WHEN c3 IS NULL THEN c2 || ' ' || c1 ELSE c3 || ' ' || c2 || ' ' || c1 END")} AS text FROM l WHERE c1 IS NOT NULL AND def <> '') s WHERE length(text) >= 8)
 UNION ALL (SELECT 'why-marker', path, line_no, NULL, text, path || ':' || line_no FROM (SELECT *, {_duck_clean(chr(39).join(["regexp_extract(c, ", r"\b(TODO|FIXME|HACK|NOTE|WHY|SAFETY|PERF|GOTCHA|XXX)\b\s*[:：]?\s*(.*)", ", 1) || ", ": ", " || regexp_extract(c, ", r"\b(TODO|FIXME|HACK|NOTE|WHY|SAFETY|PERF|GOTCHA|XXX)\b\s*[:：]?\s*(.*)", ", 2)"]))} AS text FROM l WHERE regexp_matches(c, '\b(TODO|FIXME|HACK|NOTE|WHY|SAFETY|PERF|GOTCHA|XXX)\b')) s WHERE length(text) >= 6)
 UNION ALL SELECT 'const-comment', path, line_no, con, text, path || ':' || line_no FROM (SELECT *, {_duck_clean("coalesce(nullif(regexp_extract(line, '(?://|#)\\s*(.+)$', 1), ''), nullif(c1, ''))")} AS text FROM l WHERE con <> '') s WHERE length(text) >= 4)"""


@query("comment_evidence", f"SELECT * FROM {EVIDENCE_SQL} e")
def comment_evidence(d: Data):
    return V.comment_evidence(d("code_lines"))
