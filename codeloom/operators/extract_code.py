"""Facts taken from source lines by rule tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from codeloom.functions import patterns as P, text as X, vocab
from codeloom.operators.lines import all_matches, by_domain, by_line, capped, first_match

JS = r"\.(?:ts|tsx|js|jsx|vue|mjs|cjs)$"


def production(lines: DataFrame) -> DataFrame:
    return lines.filter(~X.is_test_path(F.col("path")))


def import_specifiers(lines: DataFrame) -> DataFrame:
    """Every import specifier with its place; CSS files use `@import` only. The lines are read once for both."""
    css = X.extension(F.col("path")) == ".css"
    code = lines.filter(X.extension(F.col("path")).isin(*vocab.CODE_EXTENSIONS))
    found = lambda pattern: F.regexp_extract_all("line", F.lit(pattern), F.lit(1))
    hits = code.filter(F.when(css, F.col("line").rlike(P.CSS_IMPORT)).otherwise(F.col("line").rlike(P.ES_IMPORT)))
    return hits.select("path", "line_no", F.posexplode(F.when(css, found(P.CSS_IMPORT)).otherwise(found(P.ES_IMPORT))).alias("match_no", "specifier"))


def extract_imports(lines: DataFrame) -> DataFrame:
    """Distinct (package, file) pairs."""
    specs = import_specifiers(lines).select("path", X.package_name(F.col("specifier")).alias("package"))
    return specs.filter("package IS NOT NULL").distinct()


def extract_native_imports(lines: DataFrame) -> DataFrame:
    """Stack names that Python, Go and Swift imports prove, with the number of files."""
    root = F.trim(F.regexp_extract(first_match(F.col("line"), [(P.PY_IMPORT, 1), (P.PY_IMPORT, 2)]), r"^([^.,]*)", 1))
    parts = F.split(F.regexp_extract(F.col("line"), P.GO_IMPORT, 1), "/")
    suffixes = F.transform(
        F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))),
        lambda n: F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), n), "/"))
    known = F.filter(F.transform(suffixes, lambda s: X.lookup(vocab.NATIVE_IMPORTS, s)), lambda s: s.isNotNull())
    stack = F.when(X.extension(F.col("path")) == ".go", F.try_element_at(known, F.lit(1))).when(
        X.extension(F.col("path")) == ".py", X.lookup(vocab.NATIVE_IMPORTS, root)).when(
        X.extension(F.col("path")) == ".swift", X.lookup(vocab.NATIVE_IMPORTS, F.regexp_extract(F.col("line"), P.SWIFT_IMPORT, 1)))
    # a line of a Go import block holds no keyword, so only the file kind decides what is read
    found = lines.filter(F.col("path").rlike(r"\.(?:py|go|swift)$")).select("path", stack.alias("stack"))
    return found.filter("stack IS NOT NULL").distinct().groupBy("stack").agg(F.count("*").alias("files"))


def env_refs(lines: DataFrame) -> DataFrame:
    """Every environment variable reference outside comments."""
    code = lines.filter(~X.is_plain_comment(F.col("line")))
    groups = [f"g{i}" for i in range(1, P.ENV_FORMS + 1)]
    hits = all_matches(code, P.ENV_REF, groups, keep=("path", "line_no", "line"))
    name = F.coalesce(*[F.nullif(F.col(g), F.lit("")) for g in groups])
    return hits.select("path", "line_no", "line", name.alias("name"))


def env_var_census(lines: DataFrame) -> DataFrame:
    """Variables of production code with the files that read them, one row per pair."""
    pairs = env_refs(production(lines)).select("name", "path").distinct()
    return pairs.withColumn("sensitive", F.col("name").rlike(P.ENV_SENSITIVE))


def _comment_above() -> Column:
    order = by_line("path")
    above = F.coalesce(*[F.nullif(F.trim(F.lag("line", k).over(order)), F.lit("")) for k in (1, 2, 3)])
    rest = F.when(above.startswith("//"), F.trim(above.substr(F.lit(3), F.length(above)))).when(
        above.startswith("*"), F.trim(F.regexp_replace(above, r"^\*+", ""))).when(
        above.startswith("#"), F.trim(above.substr(F.lit(2), F.length(above))))
    return F.nullif(rest, F.lit(""))


def env_var_purpose(lines: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """First purpose found for each production variable: comment, default value, then the sample file."""
    wanted = env_refs(production(lines)).select("name").distinct()
    placed = lines.withColumn("above", _comment_above())
    above = placed.select("path", "line_no", "above").filter("above IS NOT NULL")
    refs = env_refs(lines).join(above, ["path", "line_no"], "left")
    trailing = F.nullif(F.regexp_extract("line", P.TRAILING_COMMENT, 1), F.lit(""))
    comment = F.trim(F.regexp_replace(F.coalesce(trailing, F.col("above")), r"^\s*[*#]*\s*", ""))
    default = first_match(F.col("line"), [(p, 1) for p in P.ENV_DEFAULTS])
    purpose = F.when(F.length(comment) >= 2, F.substring(comment, 1, 100)).when(default.isNotNull(), F.concat(F.lit("缺省值 "), default))
    found = refs.select("name", F.lit(0).alias("src"), "path", "line_no", purpose.alias("purpose"))
    if samples is not None:
        t = F.trim("line")
        note = F.trim(F.regexp_replace(t, r"^#+\s*", ""))
        declared = F.regexp_extract(t, r"^([A-Z_][A-Z0-9_]*)=", 1)
        mark = F.when(t.startswith("#") & (F.length(note) >= 2), note).when(declared != "", F.lit(""))
        before = by_line("path").rowsBetween(W.unboundedPreceding, -1)
        noted = samples.withColumn("mark", mark).withColumn("note", F.last("mark", ignorenulls=True).over(before)).withColumn("name", declared)
        text = F.substring(F.concat(X.basename(F.col("path")), F.lit("："), F.col("note")), 1, 100)
        found = found.unionByName(noted.filter("name <> '' AND note <> ''").select("name", F.lit(1).alias("src"), "path", "line_no", text.alias("purpose")))
    best = found.filter("purpose IS NOT NULL").groupBy("name").agg(F.min(F.struct("src", "path", "line_no", "purpose")).alias("b"))
    return wanted.join(best, "name", "left").select("name", F.col("b.purpose").alias("purpose"))


def constants_census(lines: DataFrame) -> DataFrame:
    """Limit constants with value, file and line."""
    code = lines.filter(~X.is_plain_comment(F.col("line"))).withColumn("domain", X.language_domain(F.col("path")))
    native = F.col("domain").isin(*P.NATIVE_CONSTANT)
    scripts = all_matches(code.filter(F.col("domain").isNull() | ~native), P.CONSTANT, ["name", "value"])
    name = by_domain(F.col("path"), {k: F.regexp_extract(F.col("line"), p, 1) for k, p in P.NATIVE_CONSTANT.items()})
    value = by_domain(F.col("path"), {k: F.regexp_extract(F.col("line"), p, 2) for k, p in P.NATIVE_CONSTANT.items()})
    others = code.filter(native).select("path", "line_no", name.alias("name"), value.alias("value")).filter("name <> ''")
    return scripts.select("path", "line_no", "name", F.trim("value").alias("value")).unionByName(
        others.withColumn("value", F.trim("value")))


def exit_code_census(lines: DataFrame, limit: int | None = None) -> DataFrame:
    """First exit call of each production script line."""
    code = F.regexp_extract("line", P.EXIT_CODE, 1)
    hits = production(lines).filter(F.col("path").rlike(r"\.(?:ts|js)$")).withColumn("c", code).filter("c <> ''")
    out = hits.select("path", "line_no", F.col("c").cast("int").alias("code"), F.substring(F.trim("line"), 1, 80).alias("context"))
    return out if limit is None else out.orderBy("path", "line_no").limit(limit)


def cli_options(lines: DataFrame) -> DataFrame:
    return all_matches(lines, P.CLI_OPTION, ["flag", "description"])


def cli_descriptions(lines: DataFrame) -> DataFrame:
    """Description of the first described command of each file; the two-argument form wins."""
    pair, chained = F.regexp_extract("line", P.CLI_COMMAND, 1), F.regexp_extract("line", P.CLI_DESCRIPTION, 1)
    found = lines.withColumn("d", F.when(pair != "", F.struct(F.lit(0).alias("o"), "line_no", pair.alias("t"))).when(
        chained != "", F.struct(F.lit(1).alias("o"), "line_no", chained.alias("t"))))
    return found.filter("d IS NOT NULL").groupBy("path").agg(F.min("d").alias("d")).select("path", F.col("d.t").alias("description"))


# balanced parentheses, three levels deep; quotes hide parentheses
_Q = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`"""
_P1 = rf"\((?:{_Q}|[^()'\"`])*+\)"
_P2 = rf"\((?:{_Q}|[^()'\"`]|{_P1})*+\)"
_BALANCED = rf"(?:{_Q}|[^()'\"`]|{_P2})*+"
_ARG = rf"(?:{_Q}|[^(),'\"`\[\]{{}}]|{_P2}|\[[^\[\]]*\]|\{{[^{{}}]*\}})*+"


def _cut(text: Column, cap: int = 120) -> Column:
    flat = X.squeeze(text)
    return F.when(F.length(flat) > cap, F.concat(F.substring(flat, 1, cap - 1), F.lit("…"))).otherwise(flat)


def io_event_census(lines: DataFrame, bodies: DataFrame | None = None) -> DataFrame:
    """I/O calls with kind, direction, expression and medium; with bodies, only inside symbol bodies."""
    def calls(outer: str, inner: str, kind: str, direction: str) -> Column:
        whole = rf"(?=({outer}(?:{_BALANCED}\)|.{{0,80}})))(?={outer}{inner}({_ARG})){outer}"
        found = F.arrays_zip(F.regexp_extract_all(F.col("line"), F.lit(whole), F.lit(1)).alias("e"), F.regexp_extract_all(F.col("line"), F.lit(whole), F.lit(2)).alias("m"))
        return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), F.lit(direction).alias("direction"), x["e"].alias("expression"), F.nullif(F.trim(x["m"]), F.lit("")).alias("medium")))

    def reads(pattern: str) -> Column:
        whole = rf"({pattern})"
        found = F.arrays_zip(F.regexp_extract_all(F.col("line"), F.lit(whole), F.lit(1)).alias("e"), F.regexp_extract_all(F.col("line"), F.lit(whole), F.lit(2)).alias("m"))
        return F.transform(found, lambda x: F.struct(F.lit("env").alias("kind"), F.lit("input").alias("direction"), x["e"].alias("expression"), F.concat(F.lit("process.env."), x["m"]).alias("medium")))

    # one pass: the rules of a line's domain are chosen in the row
    domain, chosen = F.coalesce(X.language_domain(F.col("path")), F.lit("ts")), None
    for name, rules in P.IO_RULES.items():
        quick = "|".join([r[0] for r in rules] + [e for e in [P.IO_ENV.get(name)] if e] + [c[0] for c in [P.IO_CONFIG.get(name)] if c])
        found = [calls(pattern, "", kind, direction) for pattern, kind, direction in rules]
        if name in P.IO_CONFIG:
            found.insert(0, calls(*P.IO_CONFIG[name], "config", "input"))
        if name in P.IO_ENV:
            found.append(reads(P.IO_ENV[name]))
        here, hits = (domain == name) & F.col("line").rlike(quick), F.flatten(F.array(*found))
        chosen = F.when(here, hits) if chosen is None else chosen.when(here, hits)
    out = lines.select("path", "line_no", F.inline(chosen))
    shown = out.withColumn("expression", _cut(F.col("expression"))).withColumn("medium", _cut(F.col("medium")))
    return shown if bodies is None else lines_within(bodies, shown)


#: lines per bucket of the range join
BUCKET = 64


def lines_within(ranges: DataFrame, lines: DataFrame) -> DataFrame:
    """Rows of `lines` inside [from_line, to_line] of the same path, as an equi-join on line buckets."""
    buckets = F.sequence(F.floor(F.col("from_line") / BUCKET), F.floor(F.col("to_line") / BUCKET))
    spread = ranges.filter("from_line <= to_line").withColumn("_b", F.explode(buckets))
    placed = lines.withColumn("_b", F.floor(F.col("line_no") / BUCKET))
    return spread.join(placed, ["path", "_b"]).filter("line_no BETWEEN from_line AND to_line").drop("_b")


def _braces(lines: DataFrame) -> DataFrame:
    """Braces outside strings and line comments: place within the file and nesting depth after each."""
    code = F.regexp_replace(F.regexp_replace("line", _Q, ""), "//.*$", "")
    marks = F.split(F.regexp_replace(code, r"[^{}]", ""), "")
    rows = lines.select("path", "line_no", F.posexplode(marks).alias("k", "brace")).filter("brace <> ''")
    order = W.partitionBy("path").orderBy("line_no", "k")
    step = F.when(F.col("brace") == "{", 1).otherwise(-1)
    return rows.withColumn("depth", F.sum(step).over(order)).withColumn("pos", F.row_number().over(order)).drop("k")


def body_ranges(symbols: DataFrame, lines: DataFrame, starts: DataFrame | None = None, within: int | None = None) -> DataFrame:
    """Body lines of each symbol: the graph's end line, else brace matching, else up to the next symbol, as approximate.

    A body closes at the first `}` that brings the depth back to that before the symbol, once a `{` was seen; `within`
    limits the search to so many lines. `starts` are the symbols that bound an unclosed body (default: symbols).
    """
    lengths = lines.groupBy("path").agg(F.max("line_no").alias("n_lines"))
    placed = symbols.select("id", F.col("file").alias("path"), "start_line", "end_line").join(lengths, "path").filter("start_line <= n_lines")
    graph = F.col("end_line") > F.col("start_line")
    known = placed.filter(graph).select("id", "path", F.col("start_line").alias("from_line"), F.least("end_line", "n_lines").alias("to_line"), F.lit(False).alias("approximated"))
    rest = placed.filter(~F.coalesce(graph, F.lit(False))).select("id", "path", F.col("start_line").alias("from_line"), "n_lines")
    bounds = (symbols if starts is None else starts).select(F.col("file").alias("path"), F.col("start_line").alias("from_line")).unionByName(rest.select("path", "from_line")).distinct()
    bounds = bounds.withColumn("next_line", F.lead("from_line").over(W.partitionBy("path").orderBy("from_line")))

    # each symbol takes its place among the braces of its file: depth before it, and the first `{` from it on
    braces = _braces(lines)
    none = lambda kind: F.lit(None).cast(kind)
    mixed = braces.select("path", "line_no", F.lit(1).alias("o"), "pos", "brace", "depth", none("bigint").alias("id")).unionByName(
        rest.select("path", F.col("from_line").alias("line_no"), F.lit(0).alias("o"), none("int").alias("pos"), none("string").alias("brace"), none("bigint").alias("depth"), F.col("id").cast("bigint")))
    before = W.partitionBy("path").orderBy("line_no", "o", "pos").rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy("path").orderBy(F.desc("line_no"), F.desc("o"), F.desc("pos")).rowsBetween(W.unboundedPreceding, -1)
    mixed = mixed.withColumn("level", F.coalesce(F.last("depth", True).over(before), F.lit(0)))
    mixed = mixed.withColumn("opened", F.last(F.when(F.col("brace") == "{", F.col("pos")), True).over(after))
    asked = mixed.filter("id IS NOT NULL AND opened IS NOT NULL").select("path", "level", F.col("opened").alias("pos"), "id", none("int").alias("line_no"))
    closers = braces.filter("brace = '}'").select("path", F.col("depth").alias("level"), "pos", none("bigint").alias("id"), "line_no")
    later = W.partitionBy("path", "level").orderBy(F.desc("pos")).rowsBetween(W.unboundedPreceding, -1)
    ends = asked.unionByName(closers).withColumn("close_line", F.last("line_no", True).over(later)).filter("id IS NOT NULL").select("id", "close_line")

    last = F.coalesce(F.col("next_line") - 1, F.col("n_lines"))
    shut = F.col("close_line")
    if within is not None:
        shut = F.when(shut <= F.col("from_line") + within, shut)
        last = F.least(last, F.col("from_line") + within)
    matched = rest.join(bounds, ["path", "from_line"], "left").join(ends, "id", "left").select(
        "id", "path", "from_line", F.least(F.coalesce(shut, last), "n_lines").alias("to_line"), shut.isNull().alias("approximated"))
    return known.unionByName(matched)


def return_literals(bodies: DataFrame, lines: DataFrame) -> DataFrame:
    """First `return <literal>` of each body."""
    expr = F.trim(F.regexp_extract("line", rf"{P.L}return\s+([^;\n]+)", 1))
    hits = lines.withColumn("expression", expr).filter("expression <> ''").withColumn("shape", X.literal_shape(F.col("expression")))
    inside = lines_within(bodies, hits.filter("shape IS NOT NULL").select("path", "line_no", "expression", "shape"))
    first = inside.groupBy("id").agg(F.min(F.struct("line_no", "expression", "shape")).alias("r"))
    return first.select("id", "r.line_no", _cut(F.col("r.expression")).alias("expression"), "r.shape")


def symbol_snippets(symbols: DataFrame, lines: DataFrame, bodies: DataFrame) -> DataFrame:
    """Source text of each symbol, by qualified name."""
    inside = lines_within(bodies.select("id", "path", "from_line", "to_line"), lines)
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    texts = inside.groupBy("id", "from_line").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("source"))
    return symbols.select("id", "qualified_name").join(texts, "id", "left").select(
        "id", "qualified_name", F.col("from_line").alias("start_line"), F.nullif("source", F.lit("")).alias("source"))


def definition(path: Column, line: Column) -> tuple[Column, Column]:
    """Name and kind defined on a line, by the rules of the file's domain; comment lines define nothing."""
    t = F.trim(line)
    names, kinds = {}, {}
    for domain, rules in P.DEFINITIONS.items():
        names[domain] = first_match(t, [(p, 1) for p, _ in rules])
        kind = None
        for p, k in rules:
            kind = F.when(t.rlike(p), k) if kind is None else kind.when(t.rlike(p), k)
        kinds[domain] = kind
    native = X.language_domain(path).isin("python", "go", "jvm", "swift")
    open_line = ~native | ~t.rlike(r"^(?://|/\*|\*|#)")
    return F.when(open_line, by_domain(path, names)), F.when(open_line, by_domain(path, kinds))


def defined_names(lines: DataFrame) -> DataFrame:
    """Every definition line with name and kind."""
    name, kind = definition(F.col("path"), F.col("line"))
    found = lines.filter(X.language_domain(F.col("path")).isNotNull()).select("path", "line_no", "line", name.alias("name"), kind.alias("type"))
    return found.filter("name IS NOT NULL")


def find_definitions(lines: DataFrame, names: DataFrame, signature_cap: int = 160) -> DataFrame:
    """First production definition of each wanted name."""
    found = defined_names(production(lines)).join(names.filter(F.length("name") >= 3).distinct(), "name", "left_semi")
    first = found.groupBy("name").agg(F.min(F.struct("path", "line_no", "type", "line")).alias("d"))
    return first.select("name", "d.type", "d.path", "d.line_no", F.substring(F.trim("d.line"), 1, signature_cap).alias("signature"))


def search_code(lines: DataFrame, needle: str) -> DataFrame:
    return lines.filter(F.col("line").contains(needle)).select("path", "line_no")


def search_totals(lines: DataFrame, needle: str) -> DataFrame:
    return search_code(lines, needle).agg(F.count("*").alias("total"), F.countDistinct("path").alias("files"))


def method_call_sites(lines: DataFrame, methods: DataFrame) -> DataFrame:
    """Receiver calls of known methods, standard names left out."""
    sites = all_matches(lines, P.METHOD_CALL, ["method"]).filter(~F.col("method").isin(*vocab.BUILTIN_METHODS))
    return sites.join(methods.select(F.col("name").alias("method")).distinct(), "method", "left_semi").select("path", "line_no", "match_no", "method")


def reexport_graph(lines: DataFrame, cap: int | None = None) -> DataFrame:
    """Re-export edges of each file."""
    star = all_matches(lines, P.EXPORT_STAR, ["target"]).withColumn("kind", F.lit("star"))
    named = all_matches(lines, P.EXPORT_NAMED, ["target"]).withColumn("kind", F.lit("named"))
    both = star.unionByName(named)
    return capped(both, ["path"], [F.col("line_no"), F.col("kind").desc(), F.col("match_no")], cap).select("path", "line_no", "kind", "target")


def exported_declarations(lines: DataFrame, cap: int | None = None) -> DataFrame:
    found = all_matches(lines, P.EXPORT_DECL, ["name"])
    return capped(found, ["path"], [F.col("line_no"), F.col("match_no")], cap).select("path", "line_no", "name")


def reexport_shells(lines: DataFrame) -> DataFrame:
    """Files that hold nothing but re-exports."""
    t = F.trim("line")
    counted = lines.filter(~((t == "") | t.startswith("//") | t.startswith("/*") | t.startswith("*")))
    return counted.groupBy("path").agg(F.bool_and(t.rlike(P.REEXPORT_LINE)).alias("shell")).filter("shell").select("path")


def test_titles(lines: DataFrame, cap: int | None = None) -> DataFrame:
    title = F.regexp_extract("line", P.TEST_TITLE, 1)
    found = lines.filter(F.col("path").rlike(vocab.TEST_FILE_SUFFIX)).select("path", "line_no", title.alias("title")).filter("title <> ''")
    return capped(found, ["path"], [F.col("line_no")], cap)


def edge_args(edges: DataFrame) -> DataFrame:
    """Arguments of call edges: strings or {e, v} objects; anything malformed gives none."""
    items = F.from_json("args", "ARRAY<STRING>", {"mode": "PERMISSIVE"})
    rows = edges.filter(F.col("args").startswith("[")).select(*edges.columns, F.posexplode(items).alias("arg_no", "item"))
    boxed = F.col("item").startswith("{")
    expr = F.when(boxed, F.get_json_object("item", "$.e")).otherwise(F.col("item"))
    value = F.when(boxed, F.nullif(F.trim(F.get_json_object("item", "$.v")), F.lit("")))
    out = rows.withColumn("expression", _cut(expr)).withColumn("value", _cut(value)).drop("item")
    return out.filter("expression <> ''")


# a parameter list: quotes and brackets, three levels deep, hide commas
_B1 = rf"[(\[{{<](?:{_Q}|[^()\[\]{{}}<>'\"`])*+[)\]}}>]"
_B2 = rf"[(\[{{<](?:{_Q}|[^()\[\]{{}}<>'\"`]|{_B1})*+[)\]}}>]"
_PARAM = rf"((?:{_Q}|[^,()\[\]{{}}<>'\"`]|{_B2}|[)\]}}>])++)"


def signature_census(symbols: DataFrame) -> DataFrame:
    """Parameters of every signature: name, type, optional and rest flags."""
    sig = X.one_line(F.col("signature"))
    inner = F.regexp_extract(sig, rf"^[^(]*\(({_BALANCED})\)", 1)
    raw = F.filter(F.transform(F.regexp_extract_all(inner, F.lit(_PARAM), F.lit(1)), lambda c: F.trim(c)), lambda p: p != "")
    rows = symbols.filter(sig.rlike(rf"^[^(]*\({_BALANCED}\)")).select("id", "module", F.posexplode(raw).alias("pos", "p"))
    p = F.regexp_replace("p", r"^(?:public|private|protected|readonly|override|static|abstract)\s+", "")
    rest = p.startswith("...")
    body = F.trim(F.when(rest, p.substr(F.lit(4), F.length(p))).otherwise(p))
    atom = rf"{_Q}|[^:()\[\]{{}}<>'\"`]|{_B2}"
    typed = body.rlike(rf"^(?:{atom})*+:")
    before = F.trim(F.when(typed, F.regexp_extract(body, rf"^((?:{atom})*+):", 1)).otherwise(F.regexp_extract(body, r"^(.*?)(?:(?<![=!<>])=(?![>=]).*)?$", 1)))
    after = F.regexp_extract(body, rf"^(?:{atom})*+:(.*)$", 1)
    kind = F.nullif(X.squeeze(F.regexp_extract(after, r"^(.*?)(?:(?<![=!<>])=(?![>=]).*)?$", 1)), F.lit(""))
    shaped = rows.withColumn("b", before).withColumn("type", F.when(typed, kind)).withColumn("rest", rest).withColumn("loose", body.rlike(r"[?]\s*[:=]"))
    optional = F.when(F.col("b").rlike(r"^[{\[]"), F.col("loose")).otherwise(F.col("b").endswith("?"))
    out = shaped.withColumn("name", F.trim(F.regexp_replace("b", r"\?$", ""))).withColumn("optional", optional)
    return out.filter("name <> ''").select("id", "module", "pos", "name", "type", "optional", "rest")


def signature_counts(symbols: DataFrame) -> DataFrame:
    """Typed and untyped parameters per module."""
    rows = signature_census(symbols)
    return rows.groupBy("module").agg(F.count_if(F.col("type").isNotNull()).alias("typed"), F.count_if(F.col("type").isNull()).alias("untyped"))


def type_references(types: DataFrame, column: str = "type", cap: int | None = None) -> DataFrame:
    """Capitalised type names a type expression refers to, standard names left out, in order."""
    words = F.array_distinct(F.regexp_extract_all(F.col(column), F.lit(rf"({P.NAME})"), F.lit(1)))
    named = F.filter(words, lambda w: w.rlike("^[A-Z]") & ~w.isin(*vocab.BUILTIN_TYPES))
    keep = [c for c in types.columns if c != column]
    return types.select(*keep, F.explode(named if cap is None else F.slice(named, 1, cap)).alias("reference"))
