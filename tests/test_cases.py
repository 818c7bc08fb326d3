"""Small literal cases with exact results."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import text as X
from codeloom.operators import anchors as A, classify as C, extract_code as E, extract_docs as M, graph as G, joins as J, lines as L, quality as Q, ranking as K, rewrite as W, similarity as S


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def page(spark, name, text):
    return L.line_table(spark.createDataFrame([(name, text)], "page STRING, content STRING"), "page", "content")


def one(spark, expr_of, *values):
    df = spark.createDataFrame([(v,) for v in values], "x STRING")
    return [r[0] for r in df.select(expr_of(F.col("x"))).collect()]


def test_paths(spark):
    assert one(spark, X.extension, "a/b.TS", ".env", "x/.env.example", "noext") == [".ts", "", ".example", ""]
    assert one(spark, X.language, "a.tsx", "b.zig") == ["tsx", "unknown"]
    assert one(spark, X.language_domain, "a.vue", "a.json", "b.kts") == ["ts", None, "jvm"]
    assert one(spark, X.is_test_path, "tests/a.ts", "src/a.test.ts", "src/test_a.py", "a/conftest.py", "x_test.go", "src/latest.ts") == [True] * 5 + [False]
    assert one(spark, X.module_key, "src/core/a.ts", "lib/a.ts", "a.ts") == ["core", "lib", "a.ts"]
    assert one(spark, X.package_name, "@a/b/c", "x/y", "./z", "/abs", "../node_modules/@s/n/dist/x.css") == ["@a/b", "x", None, None, "@s/n"]


def test_names(spark):
    assert one(spark, X.camel, "history_list", "a_B", "plain", "x_1y") == ["historyList", "a_B", "plain", "x1y"]
    assert one(spark, X.snake, "historyList", "HTTPServer") == ["history_list", "httpserver"]
    assert one(spark, X.heading_slug, " Hello, 世界 World! ") == ["hello-世界-world"]
    assert one(spark, X.normalized_subject, "fix(core): Add thing (#12)", "feat!: X #a/b", "Plain") == ["add thing", "x", "plain"]


def test_literal_shapes(spark):
    got = one(spark, X.literal_shape, "'a'", '"b"', "12", "-1.5e3", "true", "null", "undefined", "[1]", "{a}", "foo()", "")
    assert got == ["string", "string", "number", "number", "boolean", "null", "undefined", "array literal", "object literal", None, None]


def test_merge_signature(spark):
    data = [(1, "(path: &Path)", "bool", "a.rs"), (2, "(a: string)", "T", "a.ts"), (3, "(a): T", "U", "a.ts"), (4, "(a,\\n  b)", None, "a.ts"), (5, None, "R", "a.ts"), (6, None, None, "a.ts")]
    df = spark.createDataFrame(data, "id INT, signature STRING, return_type STRING, file STRING")
    assert [r[1] for r in rows(C.merge_signature(df), "id", "merged_signature")] == ["(path: &Path) -> bool", "(a: string): T", "(a): T", "(a, b)", "R", None]


def test_longest_module_match(spark):
    files = spark.createDataFrame([("src-tauri/src/x.rs",), ("src/x.ts",), ("a/b/c/d.ts",), ("top.ts",), ("p/q/p/z.ts",)], "path STRING")
    packages = spark.createDataFrame([("src", 0), ("src-tauri", 1), ("b/c", 2), ("a", 3), ("p", 4), ("q", 5)], "name STRING, ord INT")
    got = dict(rows(J.assign_module(files, packages), "path", "module"))
    # of one package only its shallowest place counts, so q at depth one beats p at depth zero
    assert got == {"src-tauri/src/x.rs": "src", "src/x.ts": "src", "a/b/c/d.ts": "b/c", "top.ts": None, "p/q/p/z.ts": "q"}


def test_edge_verdicts(spark):
    edges = spark.createDataFrame([("a.ts", "b.rs", "x"), ("a.ts", "b.json", "x"), ("a.ts", "b.ts", "known"), ("a.ts", "b.ts", "gone"), ("none.ts", "b.ts", "gone")], "caller_file STRING, callee_file STRING, callee_name STRING")
    lines = spark.createDataFrame([("a.ts", 1, "call known();"), ("a.ts", 2, "goneby();")], "path STRING, line_no INT, line STRING")
    got = rows(J.trust_edges(edges, lines), "caller_file", "callee_file", "callee_name", "verdict")
    assert got == [("a.ts", "b.json", "x", "non-code"), ("a.ts", "b.rs", "x", "cross-language"), ("a.ts", "b.ts", "gone", "no-lexical-evidence"), ("a.ts", "b.ts", "known", "ok"), ("none.ts", "b.ts", "gone", "ok")]


def test_absence(spark):
    lines = spark.createDataFrame([("a.ts", 1, "const x = historyListOf;"), ("a.ts", 2, "// alone_here"), ("b.rs", 1, 'emit("evt:one")'), ("c.ts", 1, "listen('only')")], "path STRING, line_no INT, line STRING")
    names = spark.createDataFrame([("history_list", "frontend"), ("alone_here", "any"), ("evt:one", "rust"), ("evt:one", "frontend"), ("only", "any")], "name STRING, side STRING")
    exclude = spark.createDataFrame([("only", "c.ts", 1)], "name STRING, path STRING, line_no INT")
    got = rows(J.verify_absence(names, lines, exclude), "name", "side", "verdict", "path", "line_no")
    assert got == [("alone_here", "any", "confirmed", None, None), ("evt:one", "frontend", "confirmed", None, None), ("evt:one", "rust", "suspect", "b.rs", 1), ("history_list", "frontend", "suspect", "a.ts", 1), ("only", "any", "confirmed", None, None)]


def test_claims(spark):
    text = "Use `load()` and `a.b.getData` in `src/x.ts`, `two words`, `ab`, `true`.\n```\n`hidden`\n```\nAgain `load()`."
    assert rows(M.extract_claims(page(spark, "p", text)), "raw", "chain", "name") == [("a.b.getData", "a.b.getData", "getData"), ("load()", "load", "load")]


def test_claim_budget(spark):
    text = " ".join(f"`missing{i:02d}`" for i in range(15))
    lines = page(spark, "p", text)
    none = spark.createDataFrame([], "name STRING, qualified_name STRING, file STRING")
    files = spark.createDataFrame([("a.ts",)], "path STRING")
    code = spark.createDataFrame([("a.ts", 1, "missing00();"), ("a.ts", 2, "// missing01")], "path STRING, line_no INT, line STRING")
    got = J.verify_claims(M.extract_claims(lines), none, files, code).groupBy("verdict").count()
    assert rows(got, "verdict", "count") == [("mention", 1), ("unverified", 13), ("verified", 1)]
    got = J.verify_claims(M.extract_claims(lines), none, files, code, budget=12).groupBy("verdict").count()
    assert rows(got, "verdict", "count") == [("mention", 1), ("skipped", 3), ("unverified", 10), ("verified", 1)]


def test_tables_and_numbers(spark):
    body = lambda head: f"## S\n| symbol | {head} |\n| --- | --- |\n" + "\n".join(f"| s{i} | {v} |" for i, v in enumerate((28, 27, 22, 14, 10)))
    fenced = "```\n| a | b |\n| --- | --- |\n| 1 | 2 |\n```"
    lines = page(spark, "p", body("fan-in")).unionByName(page(spark, "q", body("complexity"))).unionByName(page(spark, "r", fenced))
    assert rows(M.extract_tables(lines), "page", "section", "header", "n_rows", "first_values") == [("p", "S", "symbol|fan-in", 5, 5), ("q", "S", "symbol|complexity", 5, 5)]
    numbers = M.numeric_columns(lines)
    assert rows(S.same_numbers(numbers), "sequence", "headers", "pages", "header") == [("28,27,22,14,10", 2, 2, "complexity"), ("28,27,22,14,10", 2, 2, "fan-in")]
    assert S.same_numbers(numbers.withColumn("header", F.lit("one"))).count() == 0


def brute(sets, t, strict):
    keys = sorted(sets)
    out = []
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            if sets[a] == sets[b]:
                continue
            j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            if (j > t if strict else j >= t - 1e-12):
                out.append((a, b, round(j, 6)))
    return sorted(out)


def test_jaccard_join_is_exact_with_a_hot_element(spark):
    import random

    rng = random.Random(3)
    sets = {}
    for i in range(120):
        own = {f"e{rng.randint(0, 12)}" for _ in range(rng.randint(1, 6))}
        sets[f"k{i:03d}"] = own | ({"hot"} if i % 3 == 0 else set())
    df = spark.createDataFrame([(k, e) for k, es in sets.items() for e in es], "k STRING, e STRING")
    for t, strict in ((0.5, True), (0.5, False), (0.7, False)):
        owners, pairs = S.overlaps(df, "k", "e", t, strict)
        got = pairs.join(owners.select(F.col("set_id").alias("a"), F.col("k").alias("ka")), "a").join(owners.select(F.col("set_id").alias("b"), F.col("k").alias("kb")), "b")
        found = sorted((min(r.ka, r.kb), max(r.ka, r.kb), round(r.jaccard, 6)) for r in got.collect())
        assert found == brute(sets, t, strict)


def test_given_jaccard(spark):
    sets = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "a"), ("y", "b"), ("y", "c")], "k STRING, e STRING")
    pairs = spark.createDataFrame([("x", "y"), ("none", "x")], "a STRING, b STRING")
    assert rows(S.jaccard(pairs, sets, "k", "e"), "a", "b", "jaccard") == [("none", "x", 0.0), ("x", "y", 0.666667)]


def test_rank_small_hot_file_first(spark):
    files = spark.createDataFrame([("src/small.ts", 10, "m"), ("src/huge.ts", 9000, "m")] + [(f"src/{c}.ts", 5, "m") for c in "zam"], "path STRING, size INT, module STRING")
    n = lambda data: spark.createDataFrame(data, "file STRING, n INT")
    none = spark.createDataFrame([], "file STRING")
    out = K.rank_files(files, n([("src/small.ts", 50)]), n([]), n([]), none, spark.createDataFrame([], "module STRING"), none, none)
    assert [r.path for r in K.top_files(out).collect()] == ["src/small.ts", "src/huge.ts", "src/a.ts", "src/m.ts", "src/z.ts"]


def test_term_variant(spark):
    terms = spark.createDataFrame([("p", "FetchData"), ("p", "fetchData"), ("p", "other")], "page STRING, term STRING")
    glossary = spark.createDataFrame([("fetchData",)], "term STRING")
    assert rows(J.term_variants(terms, glossary), "page", "term", "standard") == [("p", "FetchData", "fetchData")]


def test_rules(spark):
    pages = {"empty": " \n", "heads": "# a\n\n## b", "plain": "text only", "good": "# a\nOne sentence."}
    lines = None
    for k, v in pages.items():
        part = page(spark, k, v)
        lines = part if lines is None else lines.unionByName(part)
    assert [r[0] for r in rows(Q.rule_empty_shell(lines), "page")] == ["empty", "heads", "plain"]
    secret = spark.createDataFrame([("p", "# a\n\nkey sk-abcdefghijklmnopqrstuvwx end"), ("q", "task-abcdefghijklmnopqrstuvwxyz")], "page STRING, content STRING")
    got = rows(Q.rule_secret(secret), "page", "message")
    assert got == [("p", "OpenAI API Key（第 3 行，值不回显）")] and "abcdef" not in got[0][1]
    broken = page(spark, "t", "# a\n| a | b |\n| c | d |\n\ntext\n```\nopen\n| x")
    assert rows(Q.rule_incomplete_page(broken), "message") == [("疑似截断残页（未闭合代码块、末尾表格残行、中段无表头表格块（第 2 行起））",)]


def test_anchor_states(spark):
    lines = page(spark, "p", "see `src/a.ts:1` `a.ts:9` `src/a.ts:0` `no.ts:2` `dup.ts:1`")
    files = spark.createDataFrame([("src/a.ts",), ("x/dup.ts",), ("y/dup.ts",)], "path STRING")
    code = spark.createDataFrame([("src/a.ts", 1, "// note")], "path STRING, line_no INT, line STRING")
    got = rows(A.anchor_line_check(A.file_anchors(lines, files), code), "path", "target_line", "state")
    assert got == [("a.ts", 9, "out-of-range"), ("dup.ts", 1, "unknown"), ("no.ts", 2, "unknown"), ("src/a.ts", 0, "broken"), ("src/a.ts", 1, "comment")]


def test_resolved_path(spark):
    df = spark.createDataFrame([("a/b/p.md", "../c.md"), ("p.md", "../x.md"), ("a/p.md", "./q/../r.md")], "base STRING, target STRING")
    assert [r[0] for r in df.select(A.resolved_path(F.col("base"), F.col("target"))).collect()] == ["a/c.md", "../x.md", "a/r.md"]


def test_body_and_io(spark):
    src = ["function f() {", "  const s = '}';", "  const c = JSON.parse(readFileSync(p, 'utf-8'));", "  if (x) { writeFileSync(out, fmt(a, b)); }", "  return 'ok';", "}", "readFileSync(q)"]
    lines = spark.createDataFrame([("a.ts", i + 1, s) for i, s in enumerate(src)], "path STRING, line_no INT, line STRING")
    symbols = spark.createDataFrame([(1, "a.ts", 1, None), (2, "a.ts", 7, None)], "id INT, file STRING, start_line INT, end_line INT")
    bodies = E.body_ranges(symbols, lines)
    assert rows(bodies, "id", "from_line", "to_line", "approximated") == [(1, 1, 6, False), (2, 7, 7, True)]
    io = E.io_event_census(lines, bodies.filter("id = 1"))
    assert rows(io, "kind", "expression", "medium") == [("config", "JSON.parse(readFileSync(p, 'utf-8'))", "p"), ("fs-write", "writeFileSync(out, fmt(a, b))", "out")]
    assert rows(E.return_literals(bodies, lines), "id", "expression", "shape") == [(1, "'ok'", "string")]


def test_call_chain_skips_self_and_visited(spark):
    e = [("a", "b"), ("b", "c"), ("c", "a"), ("b", "b"), ("c", "d"), ("d", "e")]
    edges = spark.createDataFrame([(x, "f", y, "f", 1) for x, y in e], "caller_name STRING, caller_file STRING, callee_name STRING, callee_file STRING, callee_line INT")
    roots = spark.createDataFrame([("r", "a", "f")], "root STRING, name STRING, file STRING")
    assert rows(G.call_chain(edges, roots), "depth", "caller_name", "callee_name") == [(0, "a", "b"), (1, "b", "c"), (2, "c", "a"), (2, "c", "d")]


def test_rewrites(spark):
    df = spark.createDataFrame([("a", "好的，作为专家\n# T\nx"), ("b", "```md\n# T\n```"), ("c", "| `x` |\n\nrest | more |"), ("d", "# T")], "page STRING, content STRING")
    assert rows(W.sanitize_pages(df), "page", "content", "changed") == [("a", "# T\nx", True), ("b", "# T", True), ("c", "| `x` | rest | more |", True), ("d", "# T", False)]
    parts = spark.createDataFrame([(1, 1, "# A\none\n"), (1, 2, "# a\ntwo\n```\n# A\n```")], "c INT, t INT, text STRING")
    assert rows(W.assemble_sections(parts, "c", "t"), "content") == [("# A\none\n\ntwo\n```\n# A\n```",)]
    ids = one(spark, lambda c: W.decode_identity(W.encode_identity(c)), "a.b", "缺少 证据", "x" * 20)
    assert ids == ["a.b", "缺少 证据", "x" * 20]
    docs = spark.createDataFrame([("/** Loads\n * a|b\n *\n * more */",), ("- one\n- two",), ("",)], "d STRING")
    assert [r[0] for r in W.summarize_doc(docs, "d").select("summary").collect()] == ["Loads a\\|b", "- one<br>- two", "—"]


def test_inventory_reads_a_tree(spark, tmp_path):
    from codeloom.sources.readers import file_inventory, read_texts

    for rel in ("src/a.ts", "node_modules/x/b.js", ".git/c.py", "tests/a.test.ts", "pic.png"):
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_text("x\n")
    assert rows(file_inventory(spark, str(tmp_path)), "path", "scope") == [("src/a.ts", "production"), ("tests/a.test.ts", "test")]
    assert ("src/a.ts", "x\n") in rows(read_texts(spark, str(tmp_path)), "path", "text")


def test_topics_are_greedy(spark):
    cand = spark.createDataFrame([(1, 9.0), (2, 8.0), (3, 7.0), (4, 6.0)], "id BIGINT, weight DOUBLE")
    files = {1: "abcd", 2: "abce", 3: "wxyz", 4: "wxq"}
    df = spark.createDataFrame([(k, f) for k, fs in files.items() for f in fs], "id BIGINT, file STRING")
    assert rows(G.select_topics(cand, df), "place", "id") == [(1, 1), (2, 3), (3, 4)]
