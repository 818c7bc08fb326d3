"""Steps that must not grow faster than their input."""

from __future__ import annotations

import random

from codeloom.operators import extract_code as E, joins as J, quality as Q, similarity as S
from codeloom.operators.lines import rebuild


def test_mentions_broadcast_no_words(spark, tmp_path):
    spark.createDataFrame([(i, f"tool run x@s/p{i % 7} --now") for i in range(50)], "id int, command string").write.parquet(str(tmp_path / "texts"))
    names = spark.createDataFrame([("@s/p3",), ("@s/p",)], "name string")
    hits = J.mentions(names, spark.read.parquet(str(tmp_path / "texts")), "command")
    assert "BroadcastExchange" not in hits._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["name"], r["id"]) for r in hits.collect()) == [("@s/p3", i) for i in range(50) if i % 7 == 3]


def test_small_sets_meet_by_two_elements(spark):
    rng = random.Random(5)
    sets = {}
    for i in range(160):  # sizes on both sides of PAIRED, with near copies
        base = sets[rng.randrange(i)] if i and rng.random() < 0.5 else set(rng.sample(range(40), rng.choice((1, 2, 3, 4, 5, 7, 8, 9, 12, 15))))
        sets[i] = {x for x in base if rng.random() < 0.9} | set(rng.sample(range(40), rng.randrange(3))) or {rng.randrange(40)}
    df = spark.createDataFrame([(k, str(x)) for k, v in sets.items() for x in v], "k long, e string")
    first = {k: min(j for j in sets if sets[j] == sets[k]) for k in sets}
    for t, strict in ((0.5, True), (0.5, False), (0.6, False), (0.8, False)):
        score = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and first[a] == a and first[b] == b}
        want = {p for p, j in score.items() if (j > t if strict else j >= t - 1e-12)}
        found = S.jaccard_sets(S.set_groups(df, "k", "e")[1], t, strict).collect()
        assert len(found) == len(want) and {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in found} == want


def test_pairs_of_frequent_elements_are_rare(spark):
    # lines of a grid: every element stands in 22 sets, but no two sets share two of them
    rows = [(23 * a + b, f"{x}:{(a * x + b) % 23}", x, 22, 4) for a in range(1, 23) for b in range(23) for x in range(4)]
    placed = spark.createDataFrame([(k, e, 4, x + 1) for k, e, x, _, _ in rows], "set_id long, element string, size long, pos int")
    assert S._by_pairs(placed, 0.5, True, S.PAIRED).isEmpty()


def test_forms_are_looked_up_by_their_rarest_word(spark):
    forms = spark.createDataFrame([(f"evt-w{i}", "any", f"evt-w{i}", False, p) for i in range(9) for p in ("evt", f"w{i}")] + [("evt-gone", "any", "evt-gone", False, "evt"), ("evt-gone", "any", "evt-gone", False, "gone")], "name string, side string, form string, plain boolean, part string")
    words = spark.createDataFrame([("evt", 9)] + [(f"w{i}", 1) for i in range(9)], "word string, n long")
    got = J._rarest_part(forms, J.substrings(words, forms), words).collect()
    assert sorted((r["form"], r["part"]) for r in got) == [(f"evt-w{i}", f"w{i}") for i in range(9)]
    lines = spark.createDataFrame([(f"f{i}.ts", 1, f"emit('evt-w{i}', x);") for i in range(9)], "path string, line_no int, line string")
    found = J.verify_absence(spark.createDataFrame([(f"evt-w{i}", "any") for i in range(8)] + [("w-evt", "any"), ("evt-gone", "any")], "name string, side string"), lines).collect()
    assert {(r["name"], r["verdict"], r["path"]) for r in found} == {(f"evt-w{i}", "suspect", f"f{i}.ts") for i in range(8)} | {("w-evt", "confirmed", None), ("evt-gone", "confirmed", None)}


def test_secret_patterns_read_a_rebuilt_page_once(spark):
    rows = [("a", 1, "clean"), ("a", 2, "x AKIA" + "0" * 16), ("a", 3, "sk-" + "a" * 25), ("b", 1, "clean"), ("b", 2, None), ("c", 1, "AKIA" + "Z" * 16 + " end")]
    rows += [("d", 1, "ghp_" + "b" * 20), ("e", 1, "xoxb-" + "1" * 10), ("f", 1, "Token = '" + "c" * 32 + "'"), ("g", 1, 'API_KEY:"' + "c" * 32 + '"')]
    found = Q.rule_secret(rebuild(spark.createDataFrame(rows, "page string, line_no int, line string")))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[0-9A-Z]{16}") == 1 and plan.count("array_join") == 1
    assert {(r["page"], r["message"]) for r in found.collect()} == {("a", "OpenAI API Key（第 3 行，值不回显）"), ("c", "AWS Access Key（第 1 行，值不回显）"), ("d", "GitHub Token（第 1 行，值不回显）"),
                                                                   ("e", "Slack Token（第 1 行，值不回显）"), ("f", "疑似密钥赋值（第 1 行，值不回显）"), ("g", "疑似密钥赋值（第 1 行，值不回显）")}
    assert Q.rule_secret(spark.createDataFrame([("a", None), ("b", "")], "page string, content string")).isEmpty()


def test_sets_with_common_elements_meet_in_bounded_tasks(spark, monkeypatch):
    """Tails that hundreds of sets share: meetings are dealt over tasks, and no pair is counted by grouping."""
    monkeypatch.setattr(S, "MEETINGS", 50)
    rng = random.Random(11)
    sets = {i: {f"own{i // 3}", f"file{i}"} | {f"x{j}" for j in range(rng.choice((8, 9, 12, 16)))} for i in range(90)}
    sets |= {100 + i: {f"y{j}" for j in range(70 + i)} for i in range(4)}  # beyond AT_HAND
    df = spark.createDataFrame([(k, x) for k, v in sets.items() for x in v], "k long, e string")
    plans, at_hand = [], S._at_hand
    monkeypatch.setattr(S, "_at_hand", lambda *a: plans.append(at_hand(*a)) or plans[-1])
    for t in (0.6, 0.8):
        want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t - 1e-12}
        found = S.jaccard_sets(S.set_groups(df, "k", "e")[1], t).collect()
        assert len(found) == len(want) and {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in found} == want
    for near in plans:
        assert not near.isEmpty() and near.distinct().count() == near.count()
        assert "Aggregate" not in near._jdf.queryExecution().optimizedPlan().toString() and near.rdd.getNumPartitions() > 8


def test_paths_end_before_words_meet_names(spark):
    from codeloom.operators.extract_web import lexical_use_count

    lines = spark.createDataFrame([("a.ts", "load load x"), ("a.ts", "load()"), ("b.ts", "x.load"), ("c.ts", "loader")], "path string, line string")
    found = lexical_use_count(spark.createDataFrame([("load",), ("none",), ("load",)], "name string"), lines)
    assert {(r["name"], r["files"]) for r in found.collect()} == {("load", 2), ("none", 0)} and found.count() == 2
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.index("Join ") < plan.index("path#")


def test_trusted_edges_are_those_found_ok(spark):
    rows = [("a.ts", "f", "b.ts"), ("a.ts", "g", "b.ts"), ("a.ts", "f", "b.rs"), ("a.ts", "f", "b.ts"), ("x.json", "f", "b.ts"), ("gone.ts", "g", "b.ts"), (None, "f", "b.ts"), ("a.ts", None, "b.ts"), ("gone.ts", None, "b.ts")]
    edges = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "src int, caller_file string, callee_name string, callee_file string")
    lines = spark.createDataFrame([("a.ts", "call f(1)"), ("b.ts", "g()")], "path string, line string")
    ok = sorted(r["src"] for r in J.trust_edges(edges, lines).filter("verdict = 'ok'").collect())
    found = J.trusted_edges(edges, lines)
    assert sorted(r["src"] for r in found.collect()) == ok == [0, 3, 5]
    assert "non-code" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_imports_of_scripts_and_styles_are_found_in_one_read(spark, tmp_path):
    rows = [
        ("a.ts", 1, "import x from '@s/p1'; require('p2')"), ("a.ts", 2, "@import url('p3');"), ("b.css", 1, "@import url('p4');"),
        ("b.css", 2, "@import 'p5'; @import 'p6'; import y from 'p7'"), ("c.md", 1, "import z from 'p8'"), ("d.CSS", 1, "@import './no'"), ("e.ts", 1, None), ("f.css", 1, None)]
    spark.createDataFrame(rows, "path string, line_no int, line string").write.parquet(str(tmp_path / "lines"))
    found = E.import_specifiers(spark.read.parquet(str(tmp_path / "lines")))
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert sorted((r["path"], r["line_no"], r["match_no"], r["specifier"]) for r in found.collect()) == [
        ("a.ts", 1, 0, "@s/p1"), ("a.ts", 1, 1, "p2"), ("b.css", 1, 0, "p4"), ("b.css", 2, 0, "p5"), ("b.css", 2, 1, "p6")]


def test_channel_stats_makes_its_lines_once(spark):
    from codeloom.plans import catalog

    plan = catalog.all_queries()["channel_stats"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "split(text" not in plan


def test_large_sets_meet_in_blocks(spark, monkeypatch):
    """Sets beyond AT_HAND over several parts and bands: all pairs are found, and none is grouped or written before it is counted."""
    monkeypatch.setattr(S, "BLOCK", 1500)
    monkeypatch.setattr(S, "AT_ONCE", 300)
    rng = random.Random(7)
    sets = {}
    for i in range(60):
        base = sets[rng.randrange(i)] if i and rng.random() < 0.7 else set(rng.sample(range(900), rng.randrange(60, 400)))
        sets[i] = {x for x in base if rng.random() < rng.choice((0.7, 0.9, 1))} | set(rng.sample(range(900), rng.randrange(12)))
    df = spark.createDataFrame([(k, str(x)) for k, v in sets.items() for x in v] + [(3, None), (5, None)], "k long, e string")
    none = lambda k: k in (3, 5)  # noqa: E731 - a null counts for the size and is equal to none
    score = {(a, b): len(sets[a] & sets[b]) / (len(sets[a] | sets[b]) + none(a) + none(b)) for a in sets for b in sets if a < b}
    for t, strict in ((0.3, False), (0.5, True), (0.6, False), (0.8, False)):
        found = S.jaccard_sets(S.set_groups(df, "k", "e")[1], t, strict)
        got = [((min(r["a"], r["b"]), max(r["a"], r["b"])), round(r["jaccard"], 9)) for r in found.collect()]
        assert sorted(got) == sorted((p, round(j, 9)) for p, j in score.items() if (j > t if strict else j >= t - 1e-12))
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "count(1)" not in plan and "FlatMapGroupsInPandas" in plan


def test_gate_makes_its_lines_once(spark, tmp_path):
    from codeloom.plans.catalog import Data, all_queries

    all_queries()
    from codeloom.plans import q_gate

    docs = [(i, "One. Calls `fn_1` here (src/m0/f1.ts:3). Two.\nThree", "en", "web", 40) for i in range(6)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, "a b", "T", 3) for i in range(4)], "p_partkey long, p_name string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    d = Data(spark, str(tmp_path))
    issues = q_gate._all_issues(d)
    assert "split(text" not in issues._jdf.queryExecution().optimizedPlan().toString()
    assert issues.filter("rule = 'thin-evidence'").count() == 1  # page p0
