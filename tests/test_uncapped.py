"""No cap drops rows unless the caller asks for one; rules by literal input."""

import time

from pyspark.sql import functions as F

from codeloom.operators import evidence as V, extract_code as E, extract_web as G, graph as H, joins as J, quality as Q
from codeloom.sources import readers


def code(spark, path, *texts):
    return spark.createDataFrame([(path, i + 1, t) for i, t in enumerate(texts)], "path STRING, line_no INT, line STRING")


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_more_rows_than_the_old_caps(spark):
    edges = spark.createDataFrame([("a", "f", f"b{i:02d}", "f", 1) for i in range(45)], "caller_name STRING, caller_file STRING, callee_name STRING, callee_file STRING, callee_line INT")
    roots = spark.createDataFrame([("r", "a", "f")], "root STRING, name STRING, file STRING")
    assert H.call_chain(edges, roots).count() == 45
    assert H.call_chain(edges, roots, fanout=40).count() == 40
    assert E.exported_declarations(code(spark, "a.ts", *[f"export const x{i} = 1;" for i in range(65)])).count() == 65
    assert E.reexport_graph(code(spark, "a.ts", *[f"export * from './m{i}';" for i in range(50)])).count() == 50
    assert E.test_titles(code(spark, "a.test.ts", *[f"it('case {i}', () => {{}});" for i in range(12)])).count() == 12
    fields = G.db_models(code(spark, "s.sql", "CREATE TABLE t (", *[f"  f{i} INT," for i in range(20)], ");"))
    assert fields.count() == 20
    notes = V.comment_evidence(code(spark, "src/a.ts", *[f"// TODO: look at number {i}" for i in range(9)]))
    assert notes.filter("kind = 'why-marker'").count() == 9


def test_exports_of_any_depth(spark):
    df = spark.createDataFrame([("p", '{"a":{"b":{"c":{"d":{"e":{"f":"deep"}}}}},"x":"top"}'), ("q", "plain")], "package STRING, exports STRING")
    assert rows(readers.flatten_exports(df), "package", "key", "value") == [("p", "a/b/c/d/e/f", "deep"), ("p", "x", "top"), ("q", ".", "plain")]


def test_call_groups_take_all_entries_and_fill_up(spark):
    pairs = [(f"e{i}", f"f{i}", f"c{i}", "z") for i in range(10)] + [("h1", "g1", "k1", "z"), ("h2", "g1", "k2", "z"), ("c1", "g3", "k3", "z"), ("h4", "g4", "k4", "z")]
    edges = spark.createDataFrame([(*p, 1) for p in pairs], "caller_name STRING, caller_file STRING, callee_name STRING, callee_file STRING, callee_line INT")
    point = lambda names: spark.createDataFrame([(n, f, i) for i, (n, f) in enumerate(names)], "name STRING, file STRING, ord INT")
    anchors = point([("h1", "g1"), ("h2", "g1"), ("c1", "g3"), ("h4", "g4")])
    all_entries = H.call_groups(edges, point([(f"e{i}", f"f{i}") for i in range(10)]), anchors)
    assert all_entries.select("root").distinct().count() == 10 and all_entries.filter("kind = 'hotspot'").count() == 0
    few = H.call_groups(edges, point([("e1", "f1")]), anchors)
    # h2 shares the file of h1, and c1 is covered by the group of e1
    assert rows(few.filter("kind = 'hotspot'"), "root") == [("h1@g1",), ("h4@g4",)]


def test_native_import_blocks(spark):
    block = code(spark, "a.go", "import (", '    "github.com/gin-gonic/gin"', ")")
    assert rows(E.extract_native_imports(block), "stack", "files") == [("gin", 1)]


def test_bodies_close_only_what_they_opened(spark):
    lines = code(spark, "a.ts", "class A {", "  const a = 1", "}", "const b = 2", "function f() {", "  if (x) {", "  }", "}", "tail")
    symbols = spark.createDataFrame([(1, "a.ts", 2, None), (2, "a.ts", 5, None), (3, "a.ts", 9, None), (4, "a.ts", 1, None)], "id INT, file STRING, start_line INT, end_line INT")
    assert rows(E.body_ranges(symbols, lines), "id", "to_line", "approximated") == [(1, 7, False), (2, 8, False), (3, 9, True), (4, 3, False)]


def test_bodies_longer_than_eighty_lines(spark):
    lines = code(spark, "a.ts", "function f() {", *["  x();"] * 200, "}")
    symbols = spark.createDataFrame([(1, "a.ts", 1, None)], "id INT, file STRING, start_line INT, end_line INT")
    assert rows(E.body_ranges(symbols, lines), "to_line", "approximated") == [(202, False)]
    assert rows(E.body_ranges(symbols, lines, within=80), "to_line", "approximated") == [(81, True)]


def test_route_objects_in_a_row(spark):
    def route(path):
        return ["fastify.route({", "  method: 'GET',", f"  url: '{path}',", "  handler,", "});", ""]
    got = G.routes_table(code(spark, "src/r.ts", *route("/a"), *route("/b"), *route("/c")))
    assert [r for (r,) in rows(got.filter("framework = 'fastify'"), "route")] == ["/a", "/b", "/c"]


def test_substrings_of_a_very_long_word(spark):
    start = time.time()
    lines = code(spark, "a.ts", "x" * 500_000 + "historyList" + "y" * 500_000, "ab", "nothing here")
    names = spark.createDataFrame([(n, "any") for n in ("history_list", "ab", "gone_name", "xyz", "a")] + [(f"name_{i}", "any") for i in range(12)], "name STRING, side STRING")
    got = J.verify_absence(names, lines).filter("verdict = 'suspect'")
    assert rows(got, "name", "path", "line_no") == [("a", "a.ts", 2), ("ab", "a.ts", 2), ("history_list", "a.ts", 1)]
    assert time.time() - start < 90


def test_a_leaked_key_fails_the_gate(spark):
    text = "# T\n\ntoken = \"" + "a1" * 20 + "\""
    page = spark.createDataFrame([("p", i + 1, t) for i, t in enumerate(text.split("\n"))], "page STRING, line_no INT, line STRING")
    content = spark.createDataFrame([("p", text)], "page STRING, content STRING")
    none = lambda schema: spark.createDataFrame([], schema)
    anchors = (none("page STRING, path STRING, target_line INT, state STRING"), none("page STRING, name STRING, path STRING, target_line INT"), none("page STRING, anchor STRING"), none("page STRING, slug STRING"))
    issues = Q.page_gate(page, content, page, none("page STRING, tier STRING"), none("path STRING"), none("page STRING, target STRING"), none("page STRING, file STRING"), anchors, none("name STRING"))
    assert rows(issues.filter("severity = 'error'"), "page", "rule") == [("p", "secret")]
    assert rows(Q.page_passed(page, issues), "page", "passed") == [("p", False)]


def test_process_and_file_rules_of_other_languages(spark):
    kinds = lambda path, line: {k for (k,) in rows(E.io_event_census(code(spark, path, line)), "kind")}
    assert "process" in kinds("A.java", "Process p = Runtime.getRuntime().exec(cmd);")
    assert kinds("a.swift", "let s = try String(contentsOfFile: p)") == {"fs-read"}
    assert kinds("a.swift", "let s = Data(contentsOf: url)") == {"fs-read"}
    assert kinds("a.swift", "let s = Data(contentsOfFile: p)") == set()


def test_boundary_topic(spark):
    edges = spark.createDataFrame([("services", "core", 5), ("core", "web", 2)], "from_module STRING, to_module STRING, call_count INT")
    files = lambda *ps: spark.createDataFrame([(p, p.split("/")[1]) for p in ps], "path STRING, module STRING")
    shells = lambda *ps: spark.createDataFrame([(p,) for p in ps], "path STRING")
    three = ("src/services/a.ts", "src/services/b.ts", "src/core/c.ts")
    assert rows(H.boundary_topic(edges, files(*three, "src/core/c.test.ts", "src/web/d.ts"), shells()), "id", "file") == [("topic-services-core", p) for p in sorted(three)]
    assert H.boundary_topic(edges, files(*three), shells(*three)).count() == 0
    assert H.boundary_topic(edges, files(*three[:2]), shells()).count() == 0


def test_flow_sequences_cover_later_entries_and_fill_up(spark):
    pairs = [("a", "fa", "b", "fb"), ("b", "fb", "c", "fc"), ("c", "fc", "d", "fd"), ("d", "fd", "e", "fe"), ("h", "fh", "k", "fk"), ("x", "fx", "h", "fh"), ("b", "f2", "z", "fz")]
    edges = spark.createDataFrame([(*p, 1, i, 100 + i) for i, p in enumerate(pairs)], "caller_name STRING, caller_file STRING, callee_name STRING, callee_file STRING, callee_line INT, src BIGINT, dst BIGINT")
    point = lambda names: spark.createDataFrame([(n, f, i) for i, (n, f) in enumerate(names)], "name STRING, file STRING, ord INT")
    # b and its namesake are met by a; c is met too; d is out of reach of a walk of two levels from a; "none" calls nothing
    entries = point([("none", "fn"), ("a", "fa"), ("b", "f2"), ("b", "fb"), ("c", "fc"), ("d", "fd")])
    got = H.flow_sequences(edges, entries, point([("c", "fc"), ("x", "fx"), ("h", "fh")]), least=3, depth=2)
    assert rows(got, "root", "sequence", "depth", "callee_name") == [
        ("a@fa", 1, 0, "b"), ("a@fa", 1, 1, "c"), ("d@fd", 5, 0, "e"), ("x@fx", 7, 0, "h"), ("x@fx", 7, 1, "k")]
    # a chain of coverings: a meets b, so b does not cover what only b meets
    chain = H.flow_sequences(edges, point([("a", "fa"), ("b", "fb"), ("d", "fd")]), point([("q", "q")]), least=0, depth=2)
    assert {r["root"] for r in chain.collect()} == {"a@fa", "d@fd"}
    facts = H.flow_facts(edges, got)
    assert rows(facts, "caller_name", "sequence", "depth", "is_entry") == [("a", 1, 0, True), ("b", 1, 1, False), ("d", 5, 0, True), ("h", 7, 1, False), ("x", 7, 0, True)]
    assert H.flow_sequences(edges.limit(0), entries, entries).count() == 0


def test_open_types_are_read_to_their_end(spark):
    body = ["interface Wide {", *[f"  field{i}: string" for i in range(60)], "}", "const after = 1"]
    types = spark.createDataFrame([(1, "Wide", "Interface", "a.ts", 1, None)], "id BIGINT, name STRING, label STRING, file STRING, start_line INT, end_line INT")
    asked = spark.createDataFrame([("Wide",)], "reference STRING")
    stages = spark.createDataFrame([("a.ts",)], "file STRING")
    text = J.type_definitions(asked, types, stages, code(spark, "a.ts", *body)).collect()[0]["text"]
    assert "field59" in text and text.endswith("}")
    short = J.type_definitions(asked, types, stages, code(spark, "a.ts", *body), text_cap=20).collect()[0]["text"]
    assert short.startswith("interface Wide {\n  f") and "field9" not in short


def test_dep_usage_gives_all_importing_files_and_reads_scripts_whole(spark):
    deps = spark.createDataFrame([("vue",), ("jest",), ("socket.io",), ("c.js",), ("left",)], "name string")
    imports = [("vue", f"src/f{i:02d}.ts") for i in range(9)] + [("vue", "tests/a.test.ts"), ("jest", "tests/b.test.ts"), ("jest", "tests/a.test.ts"), ("other", "src/f00.ts")]
    scripts = spark.createDataFrame([("start", "node socket.io --now"), ("dev", "run cxjs")], "script string, command string")
    pairs = spark.createDataFrame(imports, "package string, path string")
    found = {r["name"]: (r["usage"], r["import_count"], r["import_files"]) for r in J.dep_usage(deps, pairs, scripts).collect()}
    assert found == {
        "vue": ("import", 9, [f"src/f{i:02d}.ts" for i in range(9)]), "jest": ("test", 2, ["tests/a.test.ts", "tests/b.test.ts"]),
        "socket.io": ("script", 0, []), "c.js": ("none", 0, []), "left": ("none", 0, [])}
    assert {r["name"]: len(r["import_files"]) for r in J.dep_usage(deps, pairs, scripts, cap=5).collect()}["vue"] == 5
