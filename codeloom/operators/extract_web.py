"""Facts of applications: routes, data models, components, stores and two-sided calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from codeloom.functions import patterns as P, text as X, vocab
from codeloom.operators.extract_code import lines_within
from codeloom.operators.lines import all_matches, by_line, capped, first_match



def _ahead(n: int) -> Column:
    """The next n lines as one text."""
    return F.concat_ws("\n", *[F.lead("line", k).over(by_line("path")) for k in range(1, n + 1)])


def routes_table(lines: DataFrame) -> DataFrame:
    """HTTP routes with literal paths: calls, route objects, decorators of classes and functions, and `.on`."""
    whole = W.partitionBy("path")
    flag = lambda p: F.bool_or(F.col("line").rlike(p)).over(whole)
    code = lines.filter(F.col("path").rlike(r"\.(?:ts|js|mjs|cjs|tsx|py|go)$") & ~X.is_test_path(F.col("path")))
    code = (
        code.withColumn("express", flag(rf"{P.L}express{P.R}")).withColumn("fastify", flag("fastify"))
        .withColumn("objects", flag(r"\.route\s*\(\s*\{")).withColumn("routed", flag(r"\.route\s*\("))
        .withColumn("nested", flag(r"@Controller\s*\(")).withColumn("hono", flag(r"from\s+['\"]hono"))
        .withColumn("next3", _ahead(3)).withColumn("next5", _ahead(5))
    )
    base_class = F.regexp_extract("next3", rf"class\s+({P.NAME})", 1)
    base = F.when(F.col("line").rlike(P.CONTROLLER), F.struct(F.regexp_extract(F.col("line"), P.CONTROLLER, 1).alias("base"), base_class.alias("cls")))
    code = code.withColumn("ctl", F.last(base, ignorenulls=True).over(by_line("path")))
    none = F.lit("")
    def shaped(df, framework, method, route, handler, middleware=none):
        return df.select("path", "line_no", framework.alias("framework"), F.upper(method).alias("method"), route.alias("route"), handler.alias("handler"), middleware.alias("middleware"))

    called = code.filter((F.col("express") | F.col("fastify") | F.col("objects")) & F.col("line").rlike(P.ROUTE_CALL))
    calls = all_matches(called, P.ROUTE_CALL, ["m", "r", "rest"], keep=("path", "line_no", "fastify", "routed"))
    listed = F.regexp_extract("rest", r"^\s*\[([^\]]*)\]", 1)
    parts = F.filter(F.transform(F.split(listed, ","), lambda c: F.trim(c)), lambda s: s.rlike(r"^[A-Za-z_$][A-Za-z0-9_$.]*$"))
    handler = F.regexp_extract(F.regexp_replace("rest", r"^\s*\[[^\]]*\]", ""), rf"^\s*,?\s*({P.NAME})", 1)
    inline = lambda h: F.when(h == "", P.INLINE_HANDLER).otherwise(h)
    out = shaped(calls, F.when(F.col("fastify") | F.col("routed"), "fastify").otherwise("express"), F.col("m"), F.col("r"), inline(handler), F.array_join(parts, ","))

    here = F.concat_ws("\n", F.col("line"), F.col("next5"))
    url, method = F.regexp_extract(here, P.ROUTE_URL, 1), F.regexp_extract(here, P.ROUTE_METHOD, 1)
    # an accepted hit covers six lines, in which no other is accepted; the next may start right after them
    objects = code.filter("objects").withColumn("u", url).withColumn("m", method).filter("u <> '' AND m <> ''")
    hits = objects.groupBy("path").agg(F.array_sort(F.collect_list("line_no")).alias("hits"))
    taken = F.aggregate("hits", F.array().cast("array<int>"), lambda acc, at: F.when(
        (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) + 6 > at), acc).otherwise(F.concat(acc, F.array(at.cast("int")))))
    first = objects.join(hits.select("path", F.explode(taken).alias("line_no")), ["path", "line_no"])
    out = out.unionByName(shaped(first, F.lit("fastify"), F.col("m"), F.col("u"), F.lit(P.OBJECT_HANDLER)))

    slash = lambda c: F.when(c == "", "").otherwise(F.concat(F.lit("/"), F.regexp_replace(c, "^/", "")))
    members = code.filter(F.col("nested") & F.col("line").rlike(P.CONTROLLER_HANDLER) & ~F.col("line").rlike(P.CONTROLLER) & (F.col("ctl.cls") != ""))
    fn = F.regexp_extract("next3", rf"(?:async\s+)?({P.NAME})\s*\(", 1)
    full = F.concat(slash(F.col("ctl.base")), slash(F.regexp_extract(F.col("line"), P.CONTROLLER_HANDLER, 2)))
    out = out.unionByName(shaped(
        members, F.lit("nest"), F.regexp_extract(F.col("line"), P.CONTROLLER_HANDLER, 1), F.when(full == "", "/").otherwise(full),
        F.concat(F.col("ctl.cls"), F.lit("."), F.when(fn == "", "（方法名未检出）").otherwise(fn))))

    py = code.filter(F.col("path").endswith(".py") & F.col("line").rlike(P.PY_ROUTE))
    fn = F.regexp_extract("next3", rf"def\s+({P.WORD})", 1)
    out = out.unionByName(shaped(py, F.lit("fastapi"), F.regexp_extract(F.col("line"), P.PY_ROUTE, 1), F.regexp_extract(F.col("line"), P.PY_ROUTE, 2), F.when(fn == "", "（handler 未检出）").otherwise(fn)))

    go = all_matches(code.filter(F.col("path").endswith(".go")), P.GO_ROUTE, ["m", "r", "h"])
    out = out.unionByName(shaped(go, F.lit("go-http"), F.when(F.col("m") == "Any", "ALL").otherwise(F.col("m")), F.col("r"), inline(F.coalesce("h", F.lit("")))))
    on = all_matches(code.filter("hono"), P.ON_ROUTE, ["m", "r", "h"])
    return out.unionByName(shaped(on, F.lit("hono"), F.col("m"), F.col("r"), inline(F.coalesce("h", F.lit("")))))


def _before_next() -> Column:
    """The line before the next start in the same file; null for the last."""
    return F.lead("line_no").over(by_line("path")) - 1


def _owned(spans: DataFrame, rows: DataFrame) -> DataFrame:
    """rows with the span that starts last at or before them in their file: spans of a file do not overlap."""
    starts = spans.select("path", F.col("from_line").alias("line_no"), F.col("from_line").alias("_start"), F.lit(0).alias("_o")).distinct()
    mixed = rows.withColumn("_o", F.lit(1)).unionByName(starts, allowMissingColumns=True)
    order = W.partitionBy("path").orderBy("line_no", "_o")
    placed = mixed.withColumn("from_line", F.last("_start", True).over(order)).filter("_o = 1 AND from_line IS NOT NULL").drop("_start", "_o")
    return spans.drop("to_line").join(placed, ["path", "from_line"])


def frontend_routes(lines: DataFrame) -> DataFrame:
    """Route path and component, looked for on the next lines; a file with both routers counts as the first."""
    whole = W.partitionBy("path")
    code = lines.filter(F.col("path").rlike(r"\.(?:vue|ts|tsx|js|jsx)$") & ~X.is_test_path(F.col("path")))
    code = (
        code.withColumn("vue", F.bool_or(F.col("line").rlike(r"['\"]vue-router['\"]")).over(whole))
        .withColumn("react", F.bool_or(F.col("line").rlike(r"['\"]react-router(?:-dom)?['\"]")).over(whole))
        .withColumn("near", F.concat_ws("\n", F.col("line"), _ahead(3))).withColumn("near2", F.concat_ws("\n", F.col("line"), _ahead(1)))
    )
    route = F.when(F.col("vue"), F.regexp_extract(F.col("line"), P.VUE_PATH, 1)).when(F.col("react"), F.regexp_extract(F.col("line"), P.JSX_PATH, 1))
    comp = F.when(F.col("vue"), first_match(F.col("near"), [(P.VUE_COMPONENT, 1), (P.VUE_COMPONENT, 2)])).otherwise(
        first_match(F.col("near2"), [(P.JSX_COMPONENT, 1), (P.JSX_COMPONENT, 2)]))
    found = code.withColumn("route", route).withColumn("component", F.coalesce(comp, F.lit(P.NO_COMPONENT)))
    source = F.when(F.col("vue"), "vue-router").otherwise("react-router")
    return found.filter("route <> ''").select("path", "line_no", "route", "component", source.alias("source"))


def _block_fields(lines: DataFrame, start: str, close: str, field: str, kind: str, usable, cap: int | None) -> DataFrame:
    """Fields between a start line and its closing line."""
    order = by_line("path")
    name = F.nullif(F.regexp_extract("line", start, 1), F.lit(""))
    rows = lines.withColumn("model", name).withColumn("block", F.count("model").over(order)).filter("block > 0")
    inner = W.partitionBy("path", "block").orderBy("line_no")
    rows = rows.withColumn("shut", F.max(F.col("model").isNull() & F.col("line").rlike(close)).over(inner)).filter(~F.col("shut"))
    models = rows.filter("model IS NOT NULL").select("path", "block", "model", F.col("line_no").alias("model_line"))
    f = lambda g: F.regexp_extract("line", field, g)
    fields = rows.filter("model IS NULL").select("path", "block", "line_no", f(1).alias("field"), f(2).alias("type"), F.substring(F.regexp_replace(F.trim(f(3)), ",$", ""), 1, 60).alias("attrs"))
    fields = capped(fields.filter((F.col("field") != "") & usable), ["path", "block"], [F.col("line_no")], cap)
    return models.join(fields, ["path", "block"], "left").select("path", F.lit(kind).alias("kind"), F.substring_index("model", ".", -1).alias("model"), "model_line", "field", "type", "attrs")


def db_models(lines: DataFrame, cap: int | None = None) -> DataFrame:
    """Data models and their fields from DDL, model files, entity classes and table builders; `cap` fields a model, if given."""
    sql = _block_fields(lines.filter(F.col("path").endswith(".sql")), P.SQL_TABLE, r"^\s*\)", P.SQL_FIELD, "sql", ~F.col("field").rlike(P.SQL_SKIP), cap)
    prisma = _block_fields(lines.filter(F.col("path").endswith(".prisma")), P.PRISMA_MODEL, r"^\s*\}", P.PRISMA_FIELD, "prisma", F.lit(True), cap)
    code = lines.filter(F.col("path").rlike(r"\.(?:ts|js)$") & ~F.col("path").rlike(r"\.test\.|\.spec\."))
    built = code.withColumn("model", F.regexp_extract("line", P.DRIZZLE_TABLE, 1)).filter("model <> ''")
    spans = built.select("path", "model", F.col("line_no").alias("from_line"), _before_next().alias("to_line"))
    f = lambda p, g: F.regexp_extract("line", p, g)
    columns = code.select("path", "line_no", f(P.DRIZZLE_FIELD, 1).alias("field"), f(P.DRIZZLE_FIELD, 2).alias("type"), F.substring(F.trim(f(P.DRIZZLE_FIELD, 3)), 1, 60).alias("attrs")).filter("field <> ''")
    drizzle = capped(_owned(spans, columns), ["path", "from_line"], [F.col("line_no")], cap)
    spans = spans.select("path", "model", "from_line")
    drizzle = spans.join(drizzle.select("path", "from_line", "field", "type", "attrs"), ["path", "from_line"], "left").select(
        "path", F.lit("drizzle").alias("kind"), "model", F.col("from_line").alias("model_line"), "field", "type", "attrs")
    near = F.concat_ws("\n", F.col("line"), F.lead("line", 1).over(by_line("path")))
    entity = code.withColumn("cls", F.when(F.col("line").rlike(P.ENTITY), F.regexp_extract(near, P.ENTITY_CLASS, 1))).filter("cls <> ''")
    entity = entity.groupBy("path").agg(F.min_by("cls", "line_no").alias("model"))
    member = code.withColumn("col", F.regexp_extract("line", P.ENTITY_COLUMN, 1)).withColumn("n1", F.lead("line", 1).over(by_line("path"))).withColumn("n2", F.lead("line", 2).over(by_line("path"))).filter("col <> ''")
    pick = lambda g: first_match(F.col("n1"), [(P.ENTITY_FIELD, g)])
    pick2 = lambda g: first_match(F.col("n2"), [(P.ENTITY_FIELD, g)])
    member = member.select("path", "line_no", F.coalesce(pick(1), pick2(1)).alias("field"), F.coalesce(pick(2), pick2(2)).alias("type"), F.col("col").alias("attrs")).filter("field IS NOT NULL")
    member = capped(member, ["path"], [F.col("line_no")], cap).drop("line_no")
    typeorm = entity.join(member, "path", "left").select("path", F.lit("typeorm").alias("kind"), "model", F.lit(1).alias("model_line"), "field", "type", "attrs")
    return sql.unionByName(prisma).unionByName(drizzle).unionByName(typeorm)


def word_files(lines: DataFrame, pattern: str = r"[A-Za-z_$][A-Za-z0-9_$]*") -> DataFrame:
    """Distinct (path, word) pairs."""
    return lines.select("path", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(f"({pattern})"), F.lit(1)))).alias("word")).distinct()


def lexical_use_count(names: DataFrame, lines: DataFrame) -> DataFrame:
    """Number of files that mention each name as a whole word."""
    wanted = names.select("name").distinct()
    # paths end at the count: it meets the names as one row for each word
    counts = word_files(lines).groupBy(F.col("word").alias("name")).agg(F.count("*").alias("files"))
    return wanted.join(counts, "name", "left").select("name", F.coalesce("files", F.lit(0)).alias("files"))


# declarations inside brackets that nest two levels
_ANGLE = r"<((?:[^<>]|<(?:[^<>]|<[^<>]*+>)*+>)*+)>"
_PAREN = r"\(((?:[^()]|\((?:[^()]|\([^()]*+\))*+\))*+)\)"


def _macro(text: Column, name: str) -> Column:
    arg = F.regexp_extract(text, rf"{P.L}{name}\s*(?:{_ANGLE})?[^(]*{_PAREN}", 2)
    generic = F.regexp_extract(text, rf"{P.L}{name}\s*{_ANGLE}", 1)
    return F.when(F.trim(arg) != "", arg).otherwise(generic)


def _distinct(block: Column, pattern: str, groups=(1,)) -> Column:
    found = [F.regexp_extract_all(block, F.lit(pattern), F.lit(g)) for g in groups]
    if len(found) == 1:
        return F.size(F.array_distinct(found[0]))
    merged = F.transform(F.arrays_zip(*[f.alias(f"g{i}") for i, f in enumerate(found)]), lambda x: F.concat(*[F.coalesce(x[f"g{i}"], F.lit("")) for i in range(len(found))]))
    return F.size(F.array_distinct(merged))


_TYPED = rf"(?:^|[{{;,(])\s*(?:'([^']+)'|\"([^\"]+)\"|({P.NAME}))\??\s*:\s*[^\n;}},]+"
_LITERAL = r"['\"]([^'\"\n]+)['\"]"
_SIGNATURE = r"\(\s*[A-Za-z0-9_]+\s*\??\s*:\s*['\"]([^'\"\n]+)['\"]"


def component_facts(texts: DataFrame, lines: DataFrame) -> DataFrame:
    """Components with their props, events, test and number of files that use them."""
    base = X.basename(F.col("path"))
    name = F.regexp_replace(base, r"\.(?:vue|tsx|jsx|ts|js)$", "")
    vue = F.col("path").endswith(".vue") & F.col("content").rlike(r"<template|<script")
    react = F.col("path").rlike(r"\.(?:tsx|jsx)$") & name.rlike("^[A-Z]") & F.col("content").rlike(
        r"(?:function|const)\s+[A-Z][A-Za-z0-9_$]*\s*(?:=|\()|export\s+default\s+function\s+[A-Z]")
    props, emits = _macro(F.col("content"), "defineProps"), _macro(F.col("content"), "defineEmits")
    first = lambda *cs: F.coalesce(*[F.when(c > 0, c) for c in cs], F.lit(0))
    n_props = first(_distinct(props, _TYPED, (1, 2, 3)), _distinct(props, _LITERAL))
    n_emits = first(_distinct(emits, _SIGNATURE), _distinct(emits, _LITERAL), _distinct(emits, _TYPED, (1, 2, 3)))
    found = texts.filter(~X.is_test_path(F.col("path")) & (vue | react)).select(
        "path", name.alias("name"), F.when(vue, "vue").otherwise("react").alias("framework"),
        F.when(vue, n_props).otherwise(0).alias("props_count"), F.when(vue, n_emits).otherwise(0).alias("emits_count"))
    tests = texts.filter(F.col("path").rlike(vocab.TEST_FILE_SUFFIX)).select(F.regexp_replace(base, vocab.TEST_FILE_SUFFIX, "").alias("name"), F.lit(True).alias("t")).distinct()
    code = lines.filter(F.col("path").rlike(r"\.(?:vue|ts|tsx|js|jsx)$") & ~X.is_test_path(F.col("path")))
    uses = lexical_use_count(found.select("name"), code)
    return found.join(tests, "name", "left").join(uses, "name").select(
        "path", "name", "framework", "props_count", "emits_count", F.coalesce("t", F.lit(False)).alias("test_paired"), F.col("files").alias("used_by"))


def store_census(lines: DataFrame) -> DataFrame:
    """State stores; the first rule that matches a line names it."""
    hit = None
    for pattern, kind in P.STORES:
        got = F.struct(F.regexp_extract("line", pattern, 1).alias("name"), F.lit(kind).alias("kind"))
        usable = F.col("line").rlike(pattern)
        if kind == "zustand":
            usable = usable & F.col("zustand")
        hit = F.when(usable, got) if hit is None else hit.when(usable, got)
    code = lines.filter(F.col("path").rlike(r"\.(?:vue|ts|tsx|js|jsx)$") & ~X.is_test_path(F.col("path")))
    quick = "|".join(f"(?:{p})" for p, _ in P.STORES)
    flagged = code.withColumn("zustand", F.bool_or(F.col("line").rlike(r"zustand|create\s*<")).over(W.partitionBy("path")))
    stores = flagged.filter(F.col("line").rlike(quick)).withColumn("s", hit).filter("s IS NOT NULL")
    name = F.when(F.col("s.kind") == "vuex", F.concat(X.basename(F.col("path")), F.lit("（Vuex root）"))).otherwise(F.col("s.name"))
    return stores.select("path", "line_no", name.alias("name"), F.col("s.kind").alias("kind"))


def store_consumers(stores: DataFrame, lines: DataFrame) -> DataFrame:
    """Files that use each store: call form for hooks, whole word otherwise; the declaring file never counts for calls."""
    hook = F.concat(F.lit("use"), F.upper(F.left("name", F.lit(1))), F.regexp_replace(F.substr("name", F.lit(2)), "[^A-Za-z0-9]", ""), F.lit("Store"))
    called = F.col("kind").isin("pinia", "zustand", "composable")
    keyed = stores.withColumn("word", F.when(F.col("kind") == "pinia", hook).otherwise(F.col("name"))).withColumn("called", called)
    code = lines.filter(F.col("path").rlike(r"\.(?:vue|ts|tsx|js|jsx)$") & ~X.is_test_path(F.col("path")))
    calls = code.select("path", F.explode(F.regexp_extract_all("line", F.lit(rf"({P.NAME})\s*\("), F.lit(1))).alias("word")).distinct()
    words = word_files(code)
    wanted = keyed.select("word").distinct()
    used = calls.withColumn("called", F.lit(True)).unionByName(words.withColumn("called", F.lit(False))).join(wanted, "word", "left_semi")
    # count per word once; the store's own file is taken off afterwards, so a popular word is never expanded
    totals = used.groupBy("word", "called").agg(F.count("*").alias("n"))
    own = used.select("word", "called", "path", F.lit(1).alias("self"))
    out = keyed.join(totals, ["word", "called"], "left").join(own, ["word", "called", "path"], "left")
    minus = F.when(F.col("called"), F.coalesce("self", F.lit(0))).otherwise(0)
    return out.select("path", "line_no", "name", "kind", (F.coalesce("n", F.lit(0)) - minus).alias("consumers"))


def state_keys(stores: DataFrame, lines: DataFrame) -> DataFrame:
    """Declared keys after each store, up to the next store of its file."""
    starts = stores.select("path", "line_no").distinct().select("path", F.col("line_no").alias("from_line"), _before_next().alias("to_line"))
    spans = stores.select("path", "name", "kind", F.col("line_no").alias("from_line")).join(starts, ["path", "from_line"])
    reactive = F.col("line").rlike(r"^\s*(?:const|let)\s+[A-Za-z_$][A-Za-z0-9_$]*\s*=\s*(?:ref|reactive|computed|shallowRef|customRef)\s*[<(]")
    keyed = F.col("line").rlike(r"^\s{2,}[A-Za-z_$][A-Za-z0-9_$]*\s*[:,]")
    inside = _owned(spans, lines.select("path", "line_no", reactive.alias("r"), keyed.alias("k")))
    n = F.count_if(F.when(F.col("kind") == "pinia", F.col("r") | F.col("k")).otherwise(F.col("k")))
    return inside.groupBy("path", "name", "kind", "from_line").agg(n.alias("state_keys")).withColumnRenamed("from_line", "line_no")


def _points(texts: DataFrame, pattern: str, role: str, side: str) -> DataFrame:
    """Matches of a pattern over whole texts with the line of the captured literal."""
    cut = F.split(F.regexp_replace("content", f"(?={pattern})", "\u0001"), "\u0001", -1)
    pieces = texts.filter(F.col("content").rlike(pattern)).select("path", F.posexplode(cut).alias("pos", "piece"))
    breaks = F.regexp_count("piece", F.lit("\n"))
    before = F.coalesce(F.sum(breaks).over(W.partitionBy("path").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    found = pieces.withColumn("before", before).withColumn("name", F.regexp_extract("piece", f"^(?:{pattern})", 1))
    found = found.filter("name <> ''").withColumn("head", F.regexp_extract("piece", f"^(?:{pattern})", 0))
    lead = F.regexp_count(F.expr("split_part(head, name, 1)"), F.lit("\n"))
    return found.select("path", (F.col("before") + 1 + lead).cast("int").alias("line_no"), "name", F.lit(role).alias("role"), F.lit(side).alias("side"))


def ipc_points(texts: DataFrame, backend_root: str = "src-tauri/") -> DataFrame:
    """Calls, listeners, emits and command definitions on both sides of the boundary."""
    rust = F.col("path").endswith(".rs")
    inside = F.col("path").startswith(backend_root)
    usable = texts.filter((rust == inside) & X.language_domain(F.col("path")).isNotNull() & ~X.is_test_path(F.col("path")))
    back, front = usable.filter(rust), usable.filter(~rust)
    # generics between the name and its bracket carry no names
    plain = front.withColumn("content", F.regexp_replace("content", rf"{P.L}(invoke|listen|emit)(?:\s*<(?:[^<>\n]|<[^<>\n]*+>)*+>)++\s*\(", "$1("))
    events = plain.filter(F.col("content").rlike(P.EVENT_IMPORT))
    quiet = ~F.col("name").rlike(P.EVENT_NOISE)
    out = _points(plain, P.INVOKE, "call", "frontend")
    out = out.unionByName(_points(events, P.LISTEN, "listen", "frontend").filter(quiet)).unionByName(_points(events, P.EMIT, "emit", "frontend").filter(quiet))
    for pattern in (P.EMIT, P.EMIT_MANY):
        out = out.unionByName(_points(back, pattern, "emit", "rust"))
    lines = back.select("path", F.posexplode(F.split("content", "\n", -1)).alias("pos", "line")).withColumn("line_no", F.col("pos") + 1)
    t = F.trim("line")
    attr = t.rlike(P.COMMAND_ATTR)
    skipped = t.startswith("#") | t.startswith("///") | (t == "")
    before = by_line("path").rowsBetween(W.unboundedPreceding, -1)
    lines = lines.withColumn("attr_at", F.max(F.when(attr, F.col("line_no"))).over(before)).withColumn("code_at", F.max(F.when(~skipped, F.col("line_no"))).over(before))
    named = F.regexp_extract("line", P.RUST_FN, 1)
    defs = lines.filter(~skipped & (F.col("attr_at") > F.coalesce("code_at", F.lit(0)))).select(
        "path", "line_no", named.alias("name"), F.lit("define").alias("role"), F.lit("rust").alias("side")).filter("name <> ''")
    return out.unionByName(defs)
