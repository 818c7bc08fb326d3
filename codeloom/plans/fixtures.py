"""Views that give the given tables the shape of a source repository.

Every view is derived row by row from one table, so it grows with that table, and
a file or page is never larger than the one document it comes from.  The same SQL
text is used for the Spark view and for the oracle; only the two explodes differ.
"""

from __future__ import annotations

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def text(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


def module_of(doc: str) -> str:
    """Twenty-five files make one module."""
    return f"('m' || {text(f'CAST(floor({doc} / 25) AS BIGINT)')})"


def path_of(doc: str) -> str:
    """Path of the file made from one document; every eleventh is the test of its predecessor."""
    ext = (
        f"CASE {doc} % 10 WHEN 4 THEN '.json' WHEN 5 THEN '.rs' WHEN 6 THEN '.py' WHEN 7 THEN '.go'"
        f" WHEN 8 THEN '.vue' WHEN 9 THEN '.tsx' ELSE '.ts' END"
    )
    sub = f"CASE {doc} % 3 WHEN 0 THEN 'core/' WHEN 1 THEN 'api/' ELSE '' END"
    return (
        f"(CASE WHEN {doc} % 11 = 0 AND {doc} > 0"
        f" THEN 'tests/' || {module_of(doc)} || '/f' || {text(f'{doc} - 1')} || '.test.ts'"
        f" ELSE 'src/' || {module_of(doc)} || '/' || {sub} || 'f' || {text(doc)} || {ext} END)"
    )


def name_of(part: str) -> str:
    """Symbol name; some pairs of symbols share one."""
    return f"('fn_' || {text(f'CASE WHEN {part} % 4 < 2 THEN {part} - {part} % 2 ELSE {part} END')})"


def _numbered(view: str, path: str, body: str) -> str:
    return f"SELECT {path} AS path, CAST(i + 1 AS INT) AS line_no, {body} AS line FROM {view}"


_TS = f"""CASE i % 24
 WHEN 0 THEN '// ' || s
 WHEN 1 THEN 'import {{ a }} from ''@s/p' || {text('(doc_id + i) % 997')} || '/x'';'
 WHEN 2 THEN 'import {{ b }} from ''../../m' || {text('CAST(floor(doc_id / 25) AS BIGINT) + i % 3')} || '/api/f' || {text('doc_id + i')} || ''';'
 WHEN 3 THEN CASE doc_id % 2 WHEN 0 THEN 'export * from ''./f' || {text('doc_id + 1')} || ''';' ELSE 'export {{ c }} from ''./f' || {text('doc_id + 2')} || ''';' END
 WHEN 4 THEN '// ' || w || ' bound of the run'
 WHEN 5 THEN 'export const MAX_' || upper(w) || '_SIZE = ' || {text('doc_id * 10')} || CASE doc_id % 3 WHEN 0 THEN '; // cap for ' || w ELSE ';' END
 WHEN 6 THEN '// helper of ' || w || ' and ' || s
 WHEN 7 THEN 'export async function fn_' || {text('doc_id + i')} || '(a: string, b?: ' || upper(w) || '): Promise<void> {{'
 WHEN 8 THEN '  const k = process.env.APP_TOKEN_' || upper(w) || CASE doc_id % 3 WHEN 0 THEN '; // token of ' || w WHEN 1 THEN ' ?? ''d'';' ELSE ';' END
 WHEN 9 THEN '  const raw = JSON.parse(readFileSync(cfg' || {text('i')} || ', ''utf-8''));'
 WHEN 10 THEN '  writeFileSync(out' || {text('doc_id % 3')} || ', JSON.stringify(a));'
 WHEN 11 THEN '  return fn_' || {text('doc_id + 7 * i')} || '(raw, ''' || w || ''');'
 WHEN 12 THEN '}}'
 WHEN 13 THEN ''
 WHEN 14 THEN '// TODO: check ' || w || ' of ' || lang
 WHEN 15 THEN CASE doc_id % 2 WHEN 0 THEN 'router.get(''/o/' || {text('doc_id + i')} || ''', [auth, limit], handler' || {text('i')} || ');' ELSE 'app.post(''/p/' || w || ''', save' || {text('i')} || '); // express' END
 WHEN 16 THEN CASE WHEN doc_id % 11 = 0 THEN 'describe(''' || w || ' works'', () => {{' ELSE 'class C' || {text('doc_id + i')} || ' {{' END
 WHEN 17 THEN '  run_step(fn_' || {text('doc_id + 7 * (i - 13)')} || ') {{'
 WHEN 18 THEN '    if (fn_' || {text('doc_id + 7 * (i - 17)')} || '(x)) process.exit(' || {text('i % 5')} || ');'
 WHEN 19 THEN '    this.store.fn_' || {text('doc_id + 3')} || '(x).map(y);'
 WHEN 20 THEN '    return ''' || w || ''';'
 WHEN 21 THEN '  }}'
 WHEN 22 THEN '}}'
 ELSE CASE doc_id % 4 WHEN 0 THEN 'export const use' || upper(w) || 'Store = defineStore(''' || w || ''', () => {{}});'
   WHEN 1 THEN 'program.command(''' || w || ''', ''runs ' || w || ''').option(''-' || substr(w, 1, 1) || ''', ''' || w || ' option'')'
   WHEN 2 THEN 'export const use' || upper(w) || 'State = () => 1;' ELSE 'it(''keeps ' || w || ''', () => {{}});' END
END"""

_RUST = f"""CASE i % 12
 WHEN 0 THEN '// ' || s
 WHEN 1 THEN 'use serde_' || w || '::Value;'
 WHEN 2 THEN 'pub const MAX_' || upper(w) || ': usize = ' || {text('doc_id')} || ';'
 WHEN 3 THEN '#[tauri::command]'
 WHEN 4 THEN '/// ' || w
 WHEN 5 THEN 'pub async fn cmd_' || w || '_' || {text('doc_id % 50')} || '(a: String) -> Result<bool, String> {{'
 WHEN 6 THEN '    let x = fs::read_to_string(p)?;'
 WHEN 7 THEN '    state.fn_' || {text('doc_id + 3')} || '(x).unwrap();'
 WHEN 8 THEN '    app.emit("evt-' || w || '", x);'
 WHEN 9 THEN '    return true;'
 WHEN 10 THEN '}}'
 ELSE '' END"""

_PY = f"""CASE i % 10
 WHEN 0 THEN '# ' || s
 WHEN 1 THEN CASE doc_id % 3 WHEN 0 THEN 'from flask import Flask' WHEN 1 THEN 'import requests, os' ELSE 'import ' || w END
 WHEN 2 THEN 'MAX_' || upper(w) || '_COUNT = ' || {text('i')}
 WHEN 3 THEN '@app.get(''/py/' || w || ''')'
 WHEN 4 THEN 'def fn_' || {text('doc_id + i')} || '(a):'
 WHEN 5 THEN '    k = os.getenv(''APP_SECRET_' || upper(w) || ''', ''x'')'
 WHEN 6 THEN '    print(open(a))'
 WHEN 7 THEN '    return 1'
 WHEN 8 THEN '# FIXME ' || w
 ELSE '' END"""

_GO = f"""CASE i % 8
 WHEN 0 THEN '// ' || s
 WHEN 1 THEN CASE doc_id % 4 WHEN 0 THEN '    "github.com/gin-gonic/gin"' WHEN 2 THEN 'import "github.com/gin-gonic/gin"' ELSE 'import "github.com/x/' || w || '"' END
 WHEN 2 THEN 'const Max' || upper(w) || 'Size = ' || {text('i')}
 WHEN 3 THEN 'func (s *S) fn_' || {text('doc_id + i')} || '(a int) {{'
 WHEN 4 THEN '  r.GET("/go/' || w || '", handle' || {text('i')} || ')'
 WHEN 5 THEN '  v := os.Getenv("GO_KEY_' || upper(w) || '")'
 WHEN 6 THEN '}}'
 ELSE '' END"""

_VUE = f"""CASE i % 10
 WHEN 0 THEN '<script setup>'
 WHEN 1 THEN 'import {{ listen }} from ''@tauri-apps/api/event'';'
 WHEN 2 THEN 'const props = defineProps<{{ name: string; kind' || {text('i')} || '?: number }}>();'
 WHEN 3 THEN 'const emit = defineEmits([''change'', ''' || w || ''']);'
 WHEN 4 THEN 'invoke(''cmd_' || w || '_' || {text('doc_id % 50')} || ''', {{}});'
 WHEN 5 THEN 'listen(''evt-' || w || ''', f);'
 WHEN 6 THEN 'import F from ''./F' || {text('doc_id % 20')} || '.vue'';'
 WHEN 7 THEN '</script>'
 WHEN 8 THEN '<template><F' || {text('doc_id')} || ' /></template>'
 ELSE '' END"""

_TSX = f"""CASE i % 10
 WHEN 0 THEN 'import {{ Route }} from ''react-router-dom'';'
 WHEN 1 THEN 'import {{ createRouter }} from ''vue-router'';'
 WHEN 2 THEN 'interface ViewProps {{ a: string; b: number }}'
 WHEN 3 THEN 'export default function View' || {text('doc_id')} || '(p) {{'
 WHEN 4 THEN '  const r = {{ path: ''/' || w || ''','
 WHEN 5 THEN '    component: Comp' || {text('doc_id + i')} || ','
 WHEN 6 THEN '  }};'
 WHEN 7 THEN '  console.log(''' || w || ''');'
 WHEN 8 THEN '}}'
 ELSE '' END"""

#: a file that only hands on what others export
_SHELL = f"""CASE i % 4
 WHEN 0 THEN 'export * from ''./f' || {text('doc_id + 1')} || ''';'
 WHEN 1 THEN 'export {{ c }} from ''./f' || {text('doc_id + 2')} || ''';'
 WHEN 2 THEN '// ' || w
 ELSE '' END"""

_CODE = f"""CASE WHEN doc_id % 11 = 0 AND doc_id > 0 THEN {_TS}
 WHEN doc_id % 20 = 10 THEN {_SHELL}
 WHEN doc_id % 10 = 4 THEN '{{"' || w || '": ' || {text('i')} || '}}'
 WHEN doc_id % 10 = 5 THEN {_RUST} WHEN doc_id % 10 = 6 THEN {_PY} WHEN doc_id % 10 = 7 THEN {_GO}
 WHEN doc_id % 10 = 8 THEN {_VUE} WHEN doc_id % 10 = 9 THEN {_TSX} ELSE {_TS} END"""

_ROW = "i % 32"
_MD = f"""CASE WHEN i = 0 THEN '# ' || w || ' page ' || {text('doc_id')} ELSE CASE {_ROW}
 WHEN 0 THEN '## ' || CASE doc_id % 4 WHEN 0 THEN '设计 ' WHEN 1 THEN 'Install ' WHEN 2 THEN '核心依赖 ' ELSE 'About ' END || w
 WHEN 1 THEN ''
 WHEN 2 THEN 'Calls `fn_' || {text('doc_id * 2 + i % 5')} || '` and `m.' || w || '.fn_' || {text('doc_id + i')} || '()`' || CASE WHEN doc_id % 3 = 0 THEN '.' ELSE ' in (' || {path_of('doc_id')} || ':' || {text('i % 70')} || ').' END
 WHEN 3 THEN s
 WHEN 4 THEN '| symbol | ' || CASE doc_id % 2 WHEN 0 THEN 'fan-in' ELSE 'complexity' END || ' | anchor |'
 WHEN 5 THEN '| --- | ---: | --- |'
 WHEN 6 THEN '| `fn_' || {text('doc_id')} || '` | ' || {text('doc_id % 7')} || ' | ' || {path_of('doc_id')} || ':1 |'
 WHEN 7 THEN '| `fn_' || {text('doc_id + 1')} || '` | 4 | f' || {text('doc_id')} || '.ts:' || {text('doc_id % 90')} || ' |'
 WHEN 8 THEN '| `fn_' || {text('doc_id + 2')} || '` | 9 | src/none.ts:3 |'
 WHEN 9 THEN '| `' || w || '` | 11 | ' || {path_of('(doc_id + 1)')} || ':0 |'
 WHEN 10 THEN '| `fn_' || {text('doc_id + 4')} || '` | ' || {text('doc_id % 3')} || ' | (' || {path_of('(doc_id + 2)')} || ':9) |'
 WHEN 11 THEN '| `FN_' || {text('doc_id + 4')} || '` | 2 | - |'
 WHEN 12 THEN ''
 WHEN 13 THEN 'See [next](p' || {text('doc_id + 1')} || '.md), [gone](gone' || {text('doc_id % 7')} || '.md#top), [routing](routing.md), [src](' || {path_of('doc_id')} || ') and [part](#' || w || ').'
 WHEN 14 THEN CASE doc_id % 5 WHEN 0 THEN '```mermaid' WHEN 1 THEN '```sh' ELSE 'plain [ref](' || {path_of('(doc_id + 1)')} || ') ' || s END
 WHEN 15 THEN CASE doc_id % 5 WHEN 0 THEN CASE doc_id % 2 WHEN 0 THEN 'sequenceDiagram' ELSE '  A --> src/ghost' || {text('doc_id')} || '.ts' END ELSE '# ' || w END
 WHEN 16 THEN CASE doc_id % 5 WHEN 0 THEN '  A --> ' || {path_of('doc_id')} WHEN 1 THEN '| a | b |' ELSE '' END
 WHEN 17 THEN CASE doc_id % 5 WHEN 0 THEN '```' WHEN 1 THEN '```' ELSE '1. step `' || w || '`' END
 WHEN 18 THEN '### 依据 ' || w
 WHEN 19 THEN '| 证据 | 类型 | 目标 | 锚点 |'
 WHEN 20 THEN '| --- | --- | --- | --- |'
 WHEN 21 THEN '| ' || w || ' | a | b | ' || {path_of('doc_id - doc_id % 4')} || ':2 |'
 WHEN 22 THEN '| ' || w || ' | a | c | commit:abc' || {text('1000 + doc_id - doc_id % 4')} || ' (2024-01-02) |'
 WHEN 23 THEN '| ' || w || ' | a | d | x:' || {text('i')} || ' |'
 WHEN 24 THEN ''
 WHEN 25 THEN '> ⚠️ **待确认**：' || w || '（证据不足，禁止猜测）'
 WHEN 26 THEN '`inv_' || {text('doc_id % 20')} || '` 未被调用 [E' || {text('doc_id % 40')} || ']'
 WHEN 27 THEN '数据未提供（' || w || '）'
 WHEN 28 THEN '| ' || w || ' | ⚠️ 待确认 |'
 WHEN 29 THEN '`@s/p' || {text('doc_id % 997')} || '` 待确认 token = "' || CASE doc_id % 13 WHEN 0 THEN 'abcdefghijklmnopqrstuvwxyz0123456789ABCDEF' ELSE w END || '"'
 WHEN 30 THEN 'docs/p' || {text('doc_id')} || '.md#' || w
 ELSE '' END END"""

_DDL = f"""CASE i % 10
 WHEN 0 THEN 'CREATE TABLE app.t_' || w || ' ('
 WHEN 1 THEN '  id INT NOT NULL,'
 WHEN 2 THEN '  ' || w || ' VARCHAR(20) DEFAULT ''x'','
 WHEN 3 THEN '  CONSTRAINT c_' || w || ' CHECK (id > 0),'
 WHEN 4 THEN '  PRIMARY KEY (id)'
 WHEN 5 THEN ');'
 WHEN 6 THEN 'model M' || upper(w) || ' {{'
 WHEN 7 THEN '  id Int @id'
 WHEN 8 THEN '  ' || w || ' String? @unique'
 ELSE '}}' END"""

_TOML = f"""CASE i % 7
 WHEN 0 THEN CASE doc_id % 2 WHEN 0 THEN '[dependencies]' ELSE '[package]' END
 WHEN 1 THEN 'serde_' || w || ' = "' || {text('i')} || '"'
 WHEN 2 THEN w || ' = {{ version = "' || {text('doc_id')} || '", features = ["a"] }}'
 WHEN 3 THEN '[dev-dependencies]'
 WHEN 4 THEN '# ' || w || ' = "1"'
 WHEN 5 THEN w || '-x = "2"'
 ELSE '' END"""

#: documents, one row per sentence; the explode is the only engine-specific part.
SENTENCES_SPARK = """SELECT doc_id, source, lang, CAST(i AS BIGINT) AS i, s,
 coalesce(nullif(regexp_extract(lower(s), '[a-z]{3,}', 0), ''), 'nil') AS w
 FROM documents LATERAL VIEW posexplode(split(text, '[.\\\\n] ?', -1)) AS i, s"""
SENTENCES_DUCK = """SELECT doc_id, source, lang, CAST(i - 1 AS BIGINT) AS i, s,
 coalesce(nullif(regexp_extract(lower(s), '[a-z]{3,}', 0), ''), 'nil') AS w
 FROM (SELECT doc_id, source, lang, unnest(parts) AS s, generate_subscripts(parts, 1) AS i
  FROM (SELECT doc_id, source, lang, regexp_split_to_array(text, '[.\n] ?') AS parts FROM documents) p) q"""

#: documents, one row per word, kept as written.
WORDS_SPARK = """SELECT DISTINCT doc_id, lower(w) AS word FROM documents
 LATERAL VIEW explode(regexp_extract_all(text, '[A-Za-z]{2,}', 0)) AS w"""
WORDS_DUCK = """SELECT DISTINCT doc_id, lower(w) AS word
 FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]{2,}')) AS w FROM documents) q"""

_NDOCS = "(SELECT count(*) FROM documents)"
_NPARTS = "(SELECT count(*) FROM part)"

VIEWS: dict[str, str] = {
    "files": f"""SELECT doc_id, {path_of('doc_id')} AS path, {module_of('doc_id')} AS module,
 n_chars AS size, lang, source FROM documents""",
    "code_lines": _numbered("sentences", path_of("doc_id"), _CODE),
    "md_lines": f"""SELECT 'p' || {text('doc_id')} AS page, CAST(i + 1 AS INT) AS line_no, {_MD} AS line FROM sentences""",
    "ddl_lines": _numbered("sentences", f"('db/s' || {text('doc_id')} || CASE doc_id % 2 WHEN 0 THEN '.sql' ELSE '.prisma' END)", _DDL),
    "toml_lines": _numbered("sentences", f"('crates/c' || {text('doc_id')} || '/Cargo.toml')", _TOML),
    "symbols": f"""SELECT p_partkey AS id, {name_of('p_partkey')} AS name,
 'proj.' || {module_of(f'(p_partkey % {_NDOCS})')} || '.' || {name_of('p_partkey')} AS qualified_name,
 CASE p_partkey % 4 WHEN 0 THEN 'Class' WHEN 1 THEN 'Method' WHEN 2 THEN 'Function' ELSE 'Interface' END AS label,
 {module_of(f'(p_partkey % {_NDOCS})')} AS module, {path_of(f'(p_partkey % {_NDOCS})')} AS file,
 CAST(p_partkey % 20 + 1 AS INT) AS start_line,
 CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey % 20 + 5 AS INT) END AS end_line,
 p_size AS complexity, (p_partkey % {_NDOCS}) % 11 = 0 AND (p_partkey % {_NDOCS}) > 0 AS is_test,
 CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_name END AS docstring,
 CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '(a: ' || p_type || ', b?: Map<string, ' || p_type || '>)'
  WHEN 2 THEN '(...xs: string[], {{ a, b }}: Opts = {{}})' WHEN 3 THEN '() => ' || p_type ELSE '(a, b = "x,y")' END AS signature,
 CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'void' ELSE p_type END AS return_type,
 p_partkey % 2 = 0 AS is_exported FROM part""",
    "edges": f"""SELECT l_partkey AS src, (l_partkey + l_suppkey * 7) % {_NPARTS} AS dst,
 CASE WHEN l_linenumber = 1 THEN 'DEFINES_METHOD' ELSE 'CALLS' END AS type,
 CAST(l_linenumber AS INT) AS call_line,
 CASE l_linenumber WHEN 2 THEN '["x", {{"e":"' || l_returnflag || '","v":"1"}}]' WHEN 3 THEN 'bad' WHEN 4 THEN '[]' END AS args,
 l_quantity AS weight FROM lineitem""",
    "commits": f"""SELECT event_id, lpad({text('event_id')}, 8, '0') AS hash, CAST(ts AS DATE) AS date,
 CASE event_type WHEN 'error' THEN 'fix(core): ' WHEN 'signup' THEN 'feat: ' ELSE '' END || event_type || ' step '
 || {text('event_id % 5')} || CASE WHEN event_id % 3 = 0 THEN ' (#12)' ELSE '' END AS subject,
 {path_of('user_id')} AS file, {module_of('user_id')} AS module, event_id % 17 = 0 AS is_merge FROM events""",
    "manifests": f"""SELECT DISTINCT 'm' || {text('CAST(floor(c_custkey / 40) AS BIGINT)')} AS pkg,
 '@s/p' || {text('c_custkey % 997')} AS dep, '^' || {text('c_custkey % 5')} AS version,
 CASE WHEN c_custkey % 997 % 3 < 2 THEN 'prod' ELSE 'dev' END AS kind FROM customer""",
    "clusters": """SELECT l_suppkey AS id, count(DISTINCT l_partkey) AS members,
 round(avg(l_discount) * 10, 3) AS cohesion FROM lineitem GROUP BY l_suppkey""",
}

#: Views another view reads.
NEEDS: dict[str, tuple[str, ...]] = {
    "code_lines": ("sentences",), "md_lines": ("sentences",),
    "ddl_lines": ("sentences",), "toml_lines": ("sentences",),
}
