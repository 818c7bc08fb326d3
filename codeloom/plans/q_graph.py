"""Queries: call chains, data-flow stages and topics."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from codeloom.operators import aggregate as A, extract_code as E, graph as G, joins as J
from codeloom.plans import duck as D
from codeloom.plans.catalog import Data, query
from codeloom.plans.q_aggs import BOUNDARIES, CALLS, _inner
from codeloom.plans.q_code import _BODIES, _IO_SQL
from codeloom.plans.q_joins import FAN_IN, VERDICTS, calls, fan_in
from codeloom.functions import text as X
from codeloom.session import cut_lineage

TRUSTED = f"(SELECT DISTINCT caller_name, caller_file, callee_name, callee_file, callee_line FROM {VERDICTS} v WHERE verdict = 'ok')"


def trusted(d: Data):
    return J.trusted_edges(calls(d), d("code_lines"))


def roots(d: Data):
    """Exported production classes are the entries."""
    s = d("symbols").filter("NOT is_test AND is_exported AND label = 'Class'")
    return s.select(F.concat_ws("@", "name", "file").alias("root"), "name", "file").distinct()


_ROOTS = "(SELECT DISTINCT name || '@' || file AS root, name, file FROM symbols WHERE NOT is_test AND is_exported AND label = 'Class')"
_ORD = "caller_name, caller_file, callee_name, callee_file, callee_line"


def _bfs(by_file: bool, roots_sql: str) -> str:
    """Three unrolled levels."""
    seen = "(root, name, file)" if by_file else "(root, name)"
    fresh = "root, name, file" if by_file else "root, name, min(file) AS file"
    group = "GROUP BY 1, 2, 3" if by_file else "GROUP BY 1, 2"
    def level(k: int) -> str:
        return f"""l{k} AS MATERIALIZED (SELECT f.root, {k} AS depth, s.* FROM f{k} f JOIN st s ON s.caller_name = f.name AND s.caller_file = f.file)"""
    def frontier(k: int) -> str:
        old = " UNION ALL ".join(f"SELECT {seen} FROM f{j}" for j in range(k))
        return f"""f{k} AS MATERIALIZED (SELECT {fresh} FROM (SELECT DISTINCT root, callee_name AS name, callee_file AS file FROM l{k - 1}) q WHERE {seen} NOT IN ({old}) {group})"""
    return f"""st AS MATERIALIZED (SELECT * FROM {TRUSTED} t WHERE caller_name <> callee_name), f0 AS MATERIALIZED (SELECT DISTINCT root, name, file FROM {roots_sql} r), {level(0)}, {frontier(1)}, {level(1)}, {frontier(2)}, {level(2)}"""


CHAIN = "SELECT root, depth, caller_name, caller_file, callee_name, callee_file, callee_line FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2) u"


@query("call_chain", f"WITH {_bfs(False, _ROOTS)} {CHAIN}")
def call_chain(d: Data):
    return G.call_chain(trusted(d), roots(d))


@query("call_groups", f"""WITH {_bfs(True, _ROOTS)}, u AS ({CHAIN}) SELECT *, 'entry' AS kind FROM u QUALIFY row_number() OVER (PARTITION BY root, caller_name, callee_name ORDER BY depth, caller_file, callee_file, callee_line) = 1""")
def call_groups(d: Data):
    top = A.top_callers(calls(d)).select("name", "file", F.lit(0).alias("ord"))
    return G.call_groups(trusted(d), roots(d).select("name", "file", F.lit(0).alias("ord")), top)


@query("call_group_entries", f"""WITH {_bfs(True, _ROOTS)}, u AS ({CHAIN}) SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY root, caller_name, callee_name ORDER BY depth, caller_file, callee_file, callee_line) = 1""")
def call_group_entries(d: Data):
    found = G.call_chain(trusted(d), roots(d), by_file=True)
    first = F.row_number().over(Window.partitionBy("root", "caller_name", "callee_name").orderBy("depth", "caller_file", "callee_file", "callee_line"))
    return found.withColumn("_rn", first).filter("_rn = 1").drop("_rn")


@query("hop_table", """WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM edges WHERE type = 'CALLS'), l AS (SELECT 'callee' AS direction, src, dst FROM e UNION ALL SELECT 'caller', dst, src FROM e),
 r AS (SELECT d.direction, p_partkey AS id, 0 AS hops FROM part, (SELECT unnest(['callee', 'caller']) AS direction) d WHERE p_size = 1 UNION SELECT r.direction, l.dst, r.hops + 1 FROM r JOIN l ON l.src = r.id AND l.direction = r.direction WHERE r.hops < 6)
 SELECT direction, id, min(hops) AS hops FROM r GROUP BY 1, 2 HAVING min(hops) > 0""")
def hop_table(d: Data):
    edges = d("edges").filter("type = 'CALLS'")
    return G.hop_table(edges, d("part").filter("p_size = 1").select(F.col("p_partkey").alias("id")))


def once(d: Data, name: str, make):
    """A result written once per query, for the steps that share it."""
    if name not in d._stored:
        d._stored[name] = cut_lineage(make())
    return d._stored[name]


def flow_entries(d: Data):
    """Exported production classes in the order of the graph."""
    s = d("symbols").filter("NOT is_test AND is_exported AND label = 'Class'")
    return s.groupBy("name", "file").agg(F.min("id").alias("ord"))


def flow_trusted(d: Data):
    return once(d, "flow_trusted", lambda: _flow_trusted(d))


def _flow_trusted(d: Data):
    n_args = F.when(F.col("args").startswith("["), F.size(F.from_json("args", "ARRAY<STRING>"))).otherwise(0)
    edges = calls(d).select("src", "dst", "caller_name", "caller_file", "callee_name", "callee_file", "callee_line", "call_line", n_args.alias("n_args"))
    return J.trusted_edges(edges, d("code_lines"))


def flow_sequences(d: Data):
    """Calls of the execution sequences, from the entries and, where these are few, from the symbols that call most."""
    order = Window.orderBy(F.col("calls").desc(), "name", "file")  # of the fifteen top callers
    anchors = A.top_callers(calls(d)).select("name", "file", F.row_number().over(order).alias("ord"))
    return once(d, "flow_sequences", lambda: G.flow_sequences(flow_trusted(d), flow_entries(d), anchors))


def flow_edges(d: Data):
    """Trusted calls of the sequences with their order and number of arguments."""
    return once(d, "flow_edges", lambda: _flow_edges(d))


def _flow_edges(d: Data):
    return G.flow_facts(flow_trusted(d), flow_sequences(d))


_ENTRY_PLACES = "(SELECT name || '@' || file AS root, name, file, min(id) AS ord FROM symbols WHERE NOT is_test AND is_exported AND label = 'Class' GROUP BY 1, 2, 3)"
#: The entries one after another, each with all names met so far; `fs` are the calls of those that no name met covers.
SEQUENCES_CTE = f"""{_bfs(False, _ENTRY_PLACES)}, u AS MATERIALIZED ({CHAIN}), met AS (SELECT root, list(DISTINCT n) AS names FROM (SELECT root, unnest([caller_name, callee_name]) AS n FROM u) x GROUP BY 1),
 turn AS MATERIALIZED (SELECT row_number() OVER (ORDER BY ord) AS k, e.root, name, ord, names FROM {_ENTRY_PLACES} e JOIN met ON met.root = e.root),
 walk AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS seen, CAST(NULL AS VARCHAR) AS root, CAST(NULL AS BIGINT) AS ord UNION ALL
  SELECT t.k, CASE WHEN list_contains(seen, name) THEN seen ELSE list_distinct(list_concat(seen, names)) END, CASE WHEN NOT list_contains(seen, name) THEN t.root END, t.ord FROM walk w JOIN turn t ON t.k = w.k + 1),
 fs AS MATERIALIZED (SELECT u.*, w.ord AS sequence FROM u JOIN walk w ON w.root = u.root)"""
FLOW = f"""(WITH RECURSIVE {SEQUENCES_CTE}, first AS (SELECT {_ORD}, min(sequence) AS sequence, min(depth) AS depth, min(lpad(sequence::VARCHAR, 19, '0') || '.' || depth) AS step, bool_or(depth = 0) AS is_entry FROM fs GROUP BY ALL)
 SELECT src, dst, v.caller_name, v.caller_file, v.callee_name, v.callee_file, v.callee_line, call_line, CASE WHEN args LIKE '["x%' THEN 2 ELSE 0 END AS n_args, sequence, depth, step || '.' || lpad(src::VARCHAR, 19, '0') || '.' || lpad(dst::VARCHAR, 19, '0') AS ord, is_entry
 FROM {VERDICTS} v JOIN first f USING ({_ORD}) WHERE verdict = 'ok')"""
KEYS = """(SELECT name, file, min(sequence) AS sequence, min(depth) AS depth, coalesce(min(call_line), 0) AS call_line, min(ord) AS first_seen, bool_or(is_entry) AS is_entry, max(c) = 0 OR max(k) = 0 AS is_terminal FROM (
 SELECT sequence, depth, ord, caller_name AS name, caller_file AS file, CASE WHEN call_line > 0 THEN call_line END AS call_line, is_entry, 1 AS c, 0 AS k FROM fl UNION ALL SELECT sequence, depth, ord, callee_name, callee_file, NULL, false, 0, 1 FROM fl) t GROUP BY 1, 2)"""


@query("flow_sequences", f"WITH RECURSIVE {SEQUENCES_CTE} SELECT root, sequence, depth, {_ORD} FROM fs")
def flow_sequences_query(d: Data):
    return flow_sequences(d)


@query("stage_keys", f"WITH fl AS MATERIALIZED {FLOW} SELECT * FROM {KEYS} k")
def stage_keys(d: Data):
    return G.stage_keys(flow_edges(d))


def bodies(d: Data):
    """Bodies of functions and methods."""
    return once(d, "bodies", lambda: E.body_ranges(d("symbols").filter("label IN ('Function', 'Method')"), d("code_lines"), starts=d("symbols")))


def symbol_io(d: Data):
    """I/O calls inside the bodies of functions and methods."""
    return once(d, "symbol_io", lambda: E.io_event_census(d("code_lines"), bodies(d)).select("id", "kind"))


def stages(d: Data):
    return once(d, "stages", lambda: _stages(d))


def _stages(d: Data):
    edges = flow_edges(d)
    args = edges.filter("n_args > 0").select(F.col("dst").alias("id"))
    return G.build_stages(G.stage_keys(edges), d("symbols"), E.signature_census(d("symbols")).select("id", "type"), args, symbol_io(d))


_IO = f"(SELECT b.id, i.kind FROM bodies b JOIN symbols s ON s.id = b.id JOIN ({_IO_SQL}) i ON i.path = b.path AND i.line_no BETWEEN b.from_line AND b.to_line WHERE s.label IN ('Function', 'Method'))"
STAGES_CTE = f"""{_BODIES}, io AS MATERIALIZED {_IO}, fl AS MATERIALIZED {FLOW}, ky AS MATERIALIZED {KEYS},
 fx AS (SELECT k.*, s.id, s.start_line, s.return_type, CASE WHEN s.id % 5 IN (1, 2) THEN 1 ELSE 0 END AS typed, coalesce(a.n, 0) AS n_args, coalesce(o.n, 0) AS n_io, coalesce(o.reads, false) AS reads, coalesce(o.writes, false) AS writes
  FROM ky k LEFT JOIN symbols s ON s.name = k.name AND s.file = k.file LEFT JOIN (SELECT dst, count(*) AS n FROM fl WHERE n_args > 0 GROUP BY 1) a ON a.dst = s.id
  LEFT JOIN (SELECT id, count(*) AS n, bool_or(kind IN ('fs-read', 'config', 'env')) AS reads, bool_or(kind IN ('fs-write', 'stdout')) AS writes FROM io GROUP BY 1) o ON o.id = s.id),
 sg AS MATERIALIZED (SELECT name, file, id, sequence, depth, call_line, coalesce(start_line, 0) AS start_line, is_entry, CASE WHEN is_entry THEN 'entry' WHEN reads THEN 'io-boundary' WHEN writes THEN 'output' ELSE 'transform' END AS role,
  CASE WHEN n_args > 0 THEN 'args' WHEN typed > 0 THEN 'params' WHEN reads THEN 'io' ELSE 'none' END AS input, CASE WHEN coalesce(return_type, '') <> '' THEN 'return' WHEN writes THEN 'io' ELSE 'none' END AS output
  FROM fx WHERE typed > 0 OR (coalesce(return_type, '') NOT IN ('', 'void')) OR n_args > 0 OR n_io > 0 OR is_entry OR is_terminal)"""


@query("build_stages", f"WITH {STAGES_CTE} SELECT *, input <> 'none' AND output <> 'none' AS known FROM sg")
def build_stages(d: Data):
    return stages(d)


@query("stage_order", f"WITH {STAGES_CTE} SELECT *, input <> 'none' AND output <> 'none' AS known FROM sg ORDER BY is_entry DESC, sequence, depth, CASE WHEN call_line > 0 THEN call_line ELSE start_line END, name, file, id LIMIT 24")
def stage_order(d: Data):
    return G.stage_order(stages(d))


def shape_evidence(d: Data):
    """Per symbol: does it have I/O, typed parameters or a business return."""
    io = symbol_io(d).select("id", F.lit(True).alias("io")).distinct()
    typed = E.signature_census(d("symbols")).filter("type IS NOT NULL").select("id", F.lit(True).alias("typed")).distinct()
    rows = d("symbols").join(io, "id", "left").join(typed, "id", "left")
    business = F.coalesce((F.col("return_type") != "") & ~F.col("return_type").rlike(G.VOID), F.lit(False))
    return rows.groupBy("name", "file").agg(F.bool_or(F.coalesce("io", F.lit(False))).alias("io"), F.bool_or(F.coalesce("typed", F.lit(False)) | business).alias("shaped"))


MOVES_CTE = f"""{STAGES_CTE}, ev AS (SELECT name, file, bool_or(id IN (SELECT id FROM io)) AS io, bool_or(id % 5 IN (1, 2) OR coalesce(return_type, '') NOT IN ('', 'void')) AS shaped FROM symbols GROUP BY 1, 2),
 mv AS (SELECT f.caller_name, f.caller_file, f.callee_name, f.callee_file, f.call_line, f.ord, f.n_args, (f.n_args > 0 OR coalesce(b.shaped, false) OR coalesce(a.io, false) OR coalesce(b.io, false))
  AND ((f.caller_name, f.caller_file) IN (SELECT (name, file) FROM sg) OR (f.callee_name, f.callee_file) IN (SELECT (name, file) FROM sg)) AS carries
  FROM (SELECT * FROM fl QUALIFY row_number() OVER (PARTITION BY caller_name, caller_file, callee_name, callee_file, call_line ORDER BY ord, n_args DESC) = 1) f
  LEFT JOIN ev a ON a.name = f.caller_name AND a.file = f.caller_file LEFT JOIN ev b ON b.name = f.callee_name AND b.file = f.callee_file)"""


def moves(d: Data):
    return once(d, "moves", lambda: _moves(d))


def _moves(d: Data):
    return G.transitions(flow_edges(d), stages(d), shape_evidence(d))


@query("transitions", f"WITH {MOVES_CTE} SELECT * FROM mv")
def transitions(d: Data):
    return moves(d)


@query("dataflow_coverage", f"""WITH {MOVES_CTE}, ap AS (SELECT b.* FROM bodies b JOIN symbols s ON s.id = b.id WHERE s.label IN ('Function', 'Method'))
 SELECT 'symbols_considered' AS counter, count(*) AS n FROM ky UNION ALL SELECT 'stages', count(*) FROM sg UNION ALL SELECT 'typed_stages', count(*) FILTER (input = 'params' OR output = 'return') FROM sg UNION ALL SELECT 'unknown_stages', count(*) FILTER (input = 'none' OR output = 'none') FROM sg
 UNION ALL SELECT 'transitions', count(*) FILTER (carries) FROM mv UNION ALL SELECT 'data_bearing_transitions', count(*) FILTER (carries) FROM mv UNION ALL SELECT 'control_only_transitions', count(*) FILTER (NOT carries) FROM mv
 UNION ALL SELECT 'io_events', count(*) FROM io WHERE id IN (SELECT id FROM sg) UNION ALL SELECT 'type_definitions', count(*) FROM symbols WHERE label IN ('Interface', 'Class') AND file IN (SELECT file FROM sg)
 UNION ALL SELECT 'approximated_bodies', count(*) FILTER (approximated) FROM ap WHERE id IN (SELECT id FROM sg)""")
def dataflow_coverage(d: Data):
    s = stages(d)
    types = d("symbols").filter("label IN ('Interface', 'Class')").join(s.select("file").distinct(), "file", "left_semi")
    return G.dataflow_coverage(s, moves(d), G.stage_keys(flow_edges(d)), symbol_io(d), types, bodies(d))


def type_nodes(d: Data):
    """All symbols as type nodes; half of the interfaces bear the name that signatures give a return type."""
    return d("symbols").withColumn("name", F.when((F.col("label") == "Interface") & (F.col("id") % 8 == 3), F.col("return_type")).otherwise(F.col("name")))


_TYPE_CLASS = "[A-Za-z_$][A-Za-z0-9_$]*"
_TYPES = f"""tn AS (SELECT * REPLACE (CASE WHEN label = 'Interface' AND id % 8 = 3 THEN return_type ELSE name END AS name) FROM symbols WHERE label IN ('Interface', 'Class')),
 rf AS (SELECT DISTINCT r FROM (SELECT unnest(regexp_extract_all(coalesce(CASE WHEN id % 5 = 1 THEN signature END, '') || ' ' || coalesce(return_type, ''), '{_TYPE_CLASS}')) AS r FROM symbols WHERE id IN (SELECT id FROM sg)) q WHERE regexp_matches(r, '^[A-Z]') AND r <> 'Map'),
 tk AS (SELECT *, file IN (SELECT file FROM sg) AS staged FROM tn), t1 AS (SELECT *, 1 AS tier FROM tk WHERE name IN (SELECT r FROM rf) QUALIFY row_number() OVER (PARTITION BY name ORDER BY staged DESC, id) = 1),
 ta AS (SELECT * FROM t1 UNION ALL SELECT *, 2 FROM tk WHERE staged AND label <> 'Class' AND name NOT IN (SELECT r FROM rf)),
 tx AS (SELECT b.id, regexp_replace(string_agg(l.line, chr(10) ORDER BY l.line_no), '^\\s+|\\s+$', '', 'g') AS body FROM bodies b JOIN code_lines l ON l.path = b.path AND l.line_no BETWEEN b.from_line AND b.to_line WHERE b.id IN (SELECT id FROM ta) GROUP BY 1)"""


@query("type_definitions", f"""WITH {STAGES_CTE}, {_TYPES} SELECT a.id, a.name, lower(a.label) AS kind, a.file, a.start_line, a.tier, CASE WHEN coalesce(body, '') <> '' THEN body
 ELSE lower(a.label) || ' ' || a.name || '（定义体不可读；' || CASE a.tier WHEN 1 THEN '签名显式引用' ELSE '阶段文件内本地定义' END || '）' END AS text FROM ta a LEFT JOIN tx ON tx.id = a.id""")
def type_definitions(d: Data):
    staged = d("symbols").join(stages(d).select("id").distinct(), "id", "left_semi")
    shapes = E.signature_census(staged).select("type").unionByName(staged.select(F.col("return_type").alias("type")))
    refs = E.type_references(shapes.filter("type IS NOT NULL")).distinct()
    return J.type_definitions(refs, type_nodes(d), stages(d).select("file"), d("code_lines"), starts=d("symbols"))


def topic_members(d: Data):
    """A topic per three modules: its production files."""
    topic = F.concat(F.lit("t"), F.floor(F.regexp_extract("module", r"(\d+)", 1).cast("bigint") / 3))
    return d("files").filter(~X.is_test_path(F.col("path"))).select(topic.alias("topic"), F.col("path").alias("file"), "module")


MEMBERS = rf"(SELECT 't' || CAST(floor(CAST(regexp_extract(module, '(\d+)', 1) AS BIGINT) / 3) AS BIGINT) AS topic, path AS file, module FROM files WHERE NOT {D.is_test('path')})"


@query("subgraph_symbols", f"SELECT m.topic, row_number() OVER (PARTITION BY m.topic ORDER BY complexity DESC, id) AS rank, id, name, s.file, complexity FROM {MEMBERS} m JOIN symbols s ON s.file = m.file WHERE NOT is_test AND (docstring IS NOT NULL OR complexity > 5) AND label IN ('Class', 'Method', 'Function')")
def subgraph_symbols(d: Data):
    return G.subgraph_symbols(d("symbols"), topic_members(d).select("topic", "file"))


SUB_EDGES = f"(SELECT a.topic, t.*, row_number() OVER (PARTITION BY a.topic ORDER BY {_ORD}) AS rank FROM {TRUSTED} t JOIN {MEMBERS} a ON a.file = t.caller_file JOIN {MEMBERS} b ON b.file = t.callee_file AND b.topic = a.topic)"


@query("subgraph_edges", f"SELECT * FROM {SUB_EDGES} s")
def subgraph_edges(d: Data):
    return G.subgraph_edges(trusted(d), topic_members(d).select("topic", "file"))


@query("subgraph_boundaries", f"""SELECT topic, from_module, to_module, call_count, row_number() OVER (PARTITION BY topic ORDER BY call_count DESC, from_module, to_module) AS rank FROM (SELECT DISTINCT m.topic, b.* FROM {BOUNDARIES} b JOIN {MEMBERS} m ON m.module IN (b.from_module, b.to_module)) t""")
def subgraph_boundaries(d: Data):
    return G.subgraph_boundaries(A.module_boundaries(calls(d)), topic_members(d).select("topic", "module"))


def top_nodes(d: Data):
    """Five heaviest symbols of every cluster."""
    from codeloom.operators.classify import top_per_group

    weights = d("lineitem").groupBy(F.col("l_suppkey").alias("id"), F.col("l_partkey").alias("part")).agg(F.sum("l_quantity").alias("w"))
    top = top_per_group(weights, ["id"], [F.col("w").desc(), F.col("part")], 5, "pos")
    return top.join(d("symbols").select(F.col("id").alias("part"), F.col("name").alias("node")), "part").select("id", "pos", "node")


TOP_NODES = "(SELECT t.id, t.pos, s.name AS node FROM (SELECT l_suppkey AS id, l_partkey AS part, row_number() OVER (PARTITION BY l_suppkey ORDER BY sum(l_quantity) DESC, l_partkey) AS pos FROM lineitem GROUP BY 1, 2 QUALIFY pos <= 5) t JOIN symbols s ON s.id = t.part)"
CLUSTER_FILES = f"(SELECT DISTINCT n.id, s.file, s.module FROM {TOP_NODES} n JOIN symbols s ON s.name = n.node WHERE NOT s.is_test AND s.file IN (SELECT path FROM files WHERE NOT {D.is_test('path')}))"
CANDIDATES = f"""(SELECT c.id, c.members, c.cohesion, round(c.members * c.cohesion, 6) AS weight, w.files, w.modules FROM (SELECT c.*, n.n FROM clusters c JOIN (SELECT id, count(*) AS n FROM {TOP_NODES} t GROUP BY 1) n ON n.id = c.id) c
 JOIN (SELECT id, count(DISTINCT file) AS files, count(DISTINCT module) AS modules, bool_or(file NOT IN (SELECT path FROM {_inner('reexport_shells')} r)) AS solid FROM {CLUSTER_FILES} f GROUP BY 1) w ON w.id = c.id
 WHERE c.members >= 5 AND c.n >= 3 AND w.files >= 3 AND w.modules >= 2 AND w.solid)"""


def cluster_files(d: Data):
    return G.topic_files(top_nodes(d), d("symbols"), d("files"))


def candidates(d: Data):
    sizes = d("clusters").join(top_nodes(d).groupBy("id").agg(F.count("*").alias("top_nodes")), "id")
    shells = E.reexport_shells(d("code_lines"))
    return G.topic_candidates(sizes, cluster_files(d), shells)


@query("topic_candidates", f"SELECT * FROM {CANDIDATES} c")
def topic_candidates(d: Data):
    return candidates(d)


def _greedy() -> str:
    """Four unrolled rounds: the heaviest candidate that no topic before it overlaps."""
    rounds = []
    for k in range(1, 5):
        taken = " ".join(f"AND id NOT IN (SELECT b FROM o JOIN p{j} ON o.a = p{j}.id)" for j in range(1, k))
        rounds.append(f"p{k} AS MATERIALIZED (SELECT {k} AS place, id, weight FROM c WHERE true {taken} ORDER BY weight DESC, id LIMIT 1)")
    return f"""WITH c AS MATERIALIZED (SELECT * FROM {CANDIDATES} x), f AS MATERIALIZED (SELECT DISTINCT id, file FROM {CLUSTER_FILES} y WHERE id IN (SELECT id FROM c)), n AS (SELECT id, count(*) AS n FROM f GROUP BY 1),
 o AS MATERIALIZED (SELECT s.a, s.b FROM (SELECT l.id AS a, r.id AS b, count(*) AS k FROM f l JOIN f r ON l.file = r.file GROUP BY 1, 2) s JOIN n x ON x.id = s.a JOIN n z ON z.id = s.b WHERE k / (x.n + z.n - k) > 0.5), {', '.join(rounds)}
 SELECT place, id, weight FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3 UNION ALL SELECT * FROM p4) t"""


@query("select_topics", _greedy())
def select_topics(d: Data):
    return G.select_topics(candidates(d), cluster_files(d))


@query("boundary_topic", f"""WITH b AS (SELECT from_module, to_module FROM {BOUNDARIES} x WHERE call_count > 0 ORDER BY call_count DESC, from_module, to_module LIMIT 1)
 SELECT 'topic-' || from_module || '-' || to_module AS id, from_module || ' ↔ ' || to_module || ' 协作' AS title, path AS file FROM b JOIN files f ON f.module IN (from_module, to_module) WHERE NOT {D.is_test('path')}""")
def boundary_topic(d: Data):
    return G.boundary_topic(A.module_boundaries(calls(d)), d("files"), E.reexport_shells(d("code_lines")))


@query("name_topics")
def name_topics(d: Data):
    topics = select_topics(d).select("id", "place")
    label = F.when(F.col("id") % 3 == 0, F.concat(F.lit("Cluster "), "id")).when(F.col("id") % 3 == 1, "m1").otherwise("a/b")
    labels = d("clusters").select("id", label.alias("label"))
    nodes = top_nodes(d).withColumn("node", F.when(F.col("id") % 2 == 0, F.concat(F.lit("Load"), F.regexp_replace("node", "fn_", ""))).otherwise(F.col("node")))
    return G.name_topics(topics, cluster_files(d), labels, nodes, d("files").select(F.substring_index("path", "/", 1).alias("dir")).distinct())
