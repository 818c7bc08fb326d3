"""Files, packages, dependencies and edges matched against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from codeloom.functions import patterns as P, text as X, vocab
from codeloom.operators.classify import top_per_group
from codeloom.operators.extract_code import import_specifiers
from codeloom.operators.lines import all_matches
from codeloom.session import cut_lineage


def assign_module(files: DataFrame, packages: DataFrame, path: str = "path") -> DataFrame:
    """Most specific package of each file: its segments occur in the directory path.

    Every contiguous run of directory segments is looked up, so the match is an equi-join.
    """
    dirs = F.filter(F.split(F.col(path), "/"), lambda s: F.lit(True))
    n_dirs = F.size(dirs) - 1
    spans = F.flatten(F.transform(F.sequence(F.lit(1), n_dirs), lambda start: F.transform(
        F.sequence(F.lit(1), n_dirs - start + 1),
        lambda n: F.struct(start.alias("start"), n.alias("n"), F.array_join(F.slice(dirs, start, n), "/").alias("name")))))
    runs = files.select(path).filter(F.col(path).contains("/")).distinct().select(path, F.inline(spans))
    named = packages.filter("name <> ''").groupBy("name").agg(F.min("ord").alias("ord"))
    first = runs.join(named, "name").groupBy(path, "name", "n", "ord").agg(F.min("start").alias("start"))
    best = first.groupBy(path).agg(F.max_by("name", F.struct(F.col("n"), F.col("start"), -F.col("ord"))).alias("module"))
    return files.join(best, path, "left")


def production_modules(files: DataFrame, packages: DataFrame) -> DataFrame:
    """Packages with at least one production file, and their files."""
    placed = assign_module(files.filter(~X.is_test_path(F.col("path"))).select("path"), packages)
    return placed.filter("module IS NOT NULL").select("module", "path")


def lexical_pairs(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """The (path, name) pairs whose file mentions the name as a whole word."""
    wanted = pairs.select("name").distinct()
    words = lines.select("path", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit("([A-Za-z0-9_$]+)"), F.lit(1)))).alias("name"))
    known = words.join(wanted, "name", "left_semi").distinct()
    return pairs.select("path", "name").distinct().join(known, ["path", "name"], "left_semi")


def trust_edges(edges: DataFrame, lines: DataFrame) -> DataFrame:
    """Verdict of every call edge: non-code, cross-language, no-lexical-evidence or ok."""
    caller, callee = X.language_domain(F.col("caller_file")), X.language_domain(F.col("callee_file"))
    verdict = F.when(caller.isNull() | callee.isNull(), "non-code").when(caller != callee, "cross-language")
    judged = edges.withColumn("verdict", verdict)
    pairs = judged.filter("verdict IS NULL").select(F.col("caller_file").alias("path"), F.col("callee_name").alias("name")).distinct()
    readable = lines.select("path").distinct()
    seen = lexical_pairs(pairs, lines).withColumn("seen", F.lit(True))
    ok = pairs.join(seen, ["path", "name"], "left").join(readable.withColumn("readable", F.lit(True)), "path", "left")
    lexical = F.coalesce("seen", F.lit(False)) | F.col("readable").isNull()
    ok = ok.select(F.col("path").alias("caller_file"), F.col("name").alias("callee_name"), F.when(lexical, "ok").otherwise("no-lexical-evidence").alias("found"))
    out = judged.join(ok, ["caller_file", "callee_name"], "left")
    return out.withColumn("verdict", F.coalesce("verdict", "found")).drop("found")


def trusted_edges(edges: DataFrame, lines: DataFrame) -> DataFrame:
    """The edges that `trust_edges` finds ok; the others leave before they are shuffled."""
    same = edges.filter(X.language_domain(F.col("caller_file")) == X.language_domain(F.col("callee_file")))
    pairs = same.select(F.col("caller_file").alias("path"), F.col("callee_name").alias("name")).distinct()
    unread = pairs.join(lines.select("path").distinct(), "path", "left_anti")
    ok = lexical_pairs(pairs, lines).unionByName(unread.select("path", "name"))
    return same.join(ok.select(F.col("path").alias("caller_file"), F.col("name").alias("callee_name")), ["caller_file", "callee_name"], "left_semi")


def symbol_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Call edges with both symbols' names, files and modules; tests on either side are dropped."""
    side = lambda p: symbols.filter("NOT is_test").select(
        F.col("id").alias("src" if p == "caller" else "dst"), F.col("name").alias(f"{p}_name"), F.col("file").alias(f"{p}_file"),
        F.col("module").alias(f"{p}_module"), F.col("label").alias(f"{p}_label"), F.col("start_line").alias(f"{p}_line"))
    return edges.join(side("caller"), "src").join(side("callee"), "dst")


def symbol_index(symbols: DataFrame) -> DataFrame:
    """Files and qualified names per symbol name; names of several files are ambiguous."""
    return symbols.groupBy("name").agg(
        F.countDistinct("file").alias("files"), F.countDistinct("qualified_name").alias("qualified")
    ).withColumn("ambiguous", F.col("files") > 1)


def _suffixes(value: Column) -> Column:
    parts = F.split(value, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def resolve_claims(claims: DataFrame, symbols: DataFrame, files: DataFrame, confirmed: DataFrame | None = None) -> DataFrame:
    """Claims with `known`: any suffix of the chain is a symbol, a qualified-name suffix or a file stem."""
    universe = (
        symbols.select("name").union(symbols.select(F.explode(_suffixes(F.col("qualified_name")))))
        .union(files.select(X.stem(F.col("path")))).distinct()
    )
    chains = claims.select("chain").distinct()
    hits = chains.select("chain", F.explode(_suffixes(F.col("chain"))).alias("name")).join(universe, "name", "left_semi")
    known = hits.select("chain", F.lit(True).alias("k")).distinct()
    open_claims = claims if confirmed is None else claims.join(confirmed.select("raw"), "raw", "left_anti")
    return open_claims.join(known, "chain", "left").withColumn("known", F.coalesce("k", F.lit(False))).drop("k")


def probe_evidence(names: DataFrame, lines: DataFrame) -> DataFrame:
    """usage / mention for every name found in the corpus as a whole word."""
    words = lines.withColumn("code", ~X.is_comment_line(F.col("line"), F.col("path"))).select(
        "code", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit("([A-Za-z0-9_$]+)"), F.lit(1)))).alias("name"))
    found = words.join(names.select("name").distinct(), "name", "left_semi").groupBy("name").agg(F.bool_or("code").alias("used"))
    return found.select("name", F.when(F.col("used"), "usage").otherwise("mention").alias("evidence"))


def verify_claims(claims: DataFrame, symbols: DataFrame, files: DataFrame, lines: DataFrame, budget: int | None = None,
                  confirmed: DataFrame | None = None) -> DataFrame:
    """Claims with verdict verified, mention, unverified, or skipped beyond a page's probe budget, if one is given."""
    # both are read several times, and to find claims takes a window over all lines
    resolved = cut_lineage(resolve_claims(cut_lineage(claims), symbols, files, confirmed))
    first = resolved.filter("NOT known").groupBy("page", "name").agg(F.min(F.struct("line_no", "match_no")).alias("at"))
    turn = F.row_number().over(W.partitionBy("page").orderBy("at"))
    probed = first.withColumn("turn", turn).select("page", "name", (F.lit(True) if budget is None else F.col("turn") <= budget).alias("probed"))
    kinds = probe_evidence(probed.filter("probed"), lines)
    out = resolved.join(probed, ["page", "name"], "left").join(kinds, "name", "left")
    verdict = (
        F.when(F.col("known"), "verified").when(~F.col("probed"), "skipped").when(F.col("evidence") == "usage", "verified")
        .when(F.col("evidence") == "mention", "mention").otherwise("unverified"))
    return out.select("page", "raw", "chain", "name", "line_no", "match_no", verdict.alias("verdict"))


def claim_stats(verdicts: DataFrame, index: DataFrame, confirmed: DataFrame | None = None) -> DataFrame:
    """Counters per page; `skipped` and `mention_only` count names, as the budget does."""
    rows = verdicts.join(index.select("name", "ambiguous"), "name", "left")
    bad = F.col("verdict").isin("mention", "unverified")
    named = lambda v: F.countDistinct(F.when(v, F.col("name")))
    out = rows.groupBy("page").agg(
        F.count("*").alias("total"), F.count_if(bad).alias("unverified"), named(F.col("verdict") == "mention").alias("mention_only"),
        named(F.col("ambiguous")).alias("ambiguous"), named(F.col("verdict") == "skipped").alias("skipped"))
    return out.withColumn("verified", F.col("total") - F.col("unverified") - F.col("skipped"))


def test_pairs(files: DataFrame) -> DataFrame:
    """Production files with a test of the same stem."""
    path, base = F.col("path"), X.basename(F.col("path"))
    tests = files.filter(X.is_test_path(path)).select(F.regexp_replace(F.regexp_replace(base, vocab.TEST_FILE_SUFFIX, ""), r"\.(?:test|spec)\.(?:rs|py|go)$", "").alias("stem")).distinct()
    own = F.regexp_replace(F.regexp_replace(base, r"\.[cm]?[jt]sx?$", ""), r"\.(?:rs|py|go)$", "")
    return files.filter(~X.is_test_path(path)).withColumn("stem", own).join(tests.filter("stem <> ''"), "stem", "left_semi").select("path")


def test_targets(files: DataFrame) -> DataFrame:
    """Source file each test speaks about: same stem, then most equal leading directories, else the test itself."""
    path = F.col("path")
    dirs = lambda c: F.slice(F.split(c, "/"), 1, F.greatest(F.size(F.split(c, "/")) - 1, F.lit(0)))
    tests = files.filter(path.rlike(vocab.TEST_FILE_SUFFIX)).select(
        path.alias("test"), F.regexp_replace(X.basename(path), vocab.TEST_FILE_SUFFIX, "").alias("stem"))
    sources = files.filter(~X.is_test_path(path) & X.language_domain(path).isNotNull()).select(path.alias("source"), X.stem(path).alias("stem"))
    pairs = tests.join(sources, "stem")
    score = F.size(F.filter(F.zip_with(dirs(F.col("source")), dirs(F.col("test")), lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x))
    best = pairs.groupBy("test").agg(F.min_by("source", F.struct(-score, F.col("source"))).alias("source"))
    return tests.select("test").join(best, "test", "left").select("test", F.coalesce("source", "test").alias("target"))


def docs_mentions(files: DataFrame, doc_lines: DataFrame) -> DataFrame:
    """Production files that documents name by path or base name, as whole path tokens."""
    tokens = doc_lines.select(F.explode(F.regexp_extract_all("line", F.lit(r"([A-Za-z0-9_@./-]*[A-Za-z0-9_])"), F.lit(1))).alias("token")).distinct()
    path = F.col("path")
    keys = files.filter(~X.is_test_path(path)).select("path", F.explode(F.array(path, X.basename(path))).alias("token"))
    return keys.join(tokens, "token", "left_semi").select("path").distinct()


def _whole_word(text: Column, name: Column) -> Column:
    """Name in text between word edges."""
    quoted = F.regexp_replace(name, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    edge = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
    return F.regexp_like(text, F.concat(F.lit(f"(?i){edge}"), quoted, F.lit(edge)))


def mentions(names: DataFrame, texts: DataFrame, text: str) -> DataFrame:
    """Texts that hold a name as a whole word, in any case: joined on the name's longest word, then tested.

    Words of texts are many more than the texts' size on disk lets the planner expect, so neither side is broadcast.
    """
    pieces = F.regexp_extract_all(F.lower("name"), F.lit(r"([a-z0-9_]+)"), F.lit(1))
    longest = F.array_max(F.transform(pieces, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9_]+)"), F.lit(1)))
    keyed = texts.select("*", F.explode(words).alias("_w"))
    hits = keyed.join(names.select("name", longest.alias("_w")).distinct().hint("merge"), "_w")
    return hits.filter(_whole_word(F.col(text), F.col("name"))).drop("_w")


def dep_usage(deps: DataFrame, imports: DataFrame, scripts: DataFrame, cap: int | None = None) -> DataFrame:
    """import / test / script / none for every declared dependency, with the importing files of that kind and their number.

    `imports` are distinct (package, path) pairs, `scripts` have name and command. Files come in path order, all without a cap.
    """
    test = X.is_test_path(F.col("path"))
    declared = deps.select("name").distinct()
    counts = imports.groupBy(F.col("package").alias("name")).agg(
        F.count_if(~test).alias("prod"), F.count_if(test).alias("test"),
        F.collect_list(F.when(~test, F.col("path"))).alias("prod_files"), F.collect_list(F.when(test, F.col("path"))).alias("test_files"))
    scripted = mentions(declared, scripts, "command").select("name", F.lit(True).alias("scripted")).distinct()
    out = declared.join(counts, "name", "left").join(scripted, "name", "left")
    kind = F.when(F.col("prod") > 0, "import").when(F.col("test") > 0, "test").when(F.col("scripted"), "script").otherwise("none")
    n = F.when(kind == "import", F.col("prod")).when(kind == "test", F.col("test")).otherwise(0)
    files = F.sort_array(F.when(kind == "import", F.col("prod_files")).when(kind == "test", F.col("test_files")).otherwise(F.array().cast("array<string>")))
    return out.select("name", kind.alias("usage"), n.alias("import_count"), (files if cap is None else F.slice(files, 1, cap)).alias("import_files"))


def dep_files(imports: DataFrame, cap: int = 5) -> DataFrame:
    """First importing files of each package, production before tests."""
    return top_per_group(imports.select("package", "path"), ["package"], [X.is_test_path(F.col("path")), F.col("path")], cap)


def dep_partition(deps: DataFrame, usage: DataFrame) -> DataFrame:
    """core / dev / test / unused group of every dependency."""
    best = deps.groupBy("name").agg(F.min(F.struct(F.when(F.col("kind") == "prod", 0).otherwise(1).alias("o"), F.col("version"))).alias("d"))
    rows = best.join(usage, "name")
    prod = F.col("d.o") == 0
    group = (
        F.when(F.col("usage") == "test", "test").when(F.col("usage") == "none", "unused")
        .when(prod & (F.col("usage") == "import"), "core").when(~prod & F.col("usage").isin("import", "script"), "dev"))
    return rows.select("name", F.col("d.version").alias("version"), "usage", group.alias("group")).filter("group IS NOT NULL")


def test_only_deps(deps: DataFrame, imports: DataFrame, scripts: DataFrame) -> DataFrame:
    """Declared, imported by tests only, and named in no other script."""
    test = X.is_test_path(F.col("path"))
    by_tests = imports.filter(test).select(F.col("package").alias("name"))
    by_code = imports.filter(~test).select(F.col("package").alias("name"))
    others = scripts.filter("script <> 'test' AND NOT startswith(script, 'test:')")
    left = deps.select("name").distinct().join(by_code, "name", "left_anti").join(by_tests, "name", "left_semi")
    return left.join(mentions(left, others, "command").select("name"), "name", "left_anti")


def crate_usage(deps: DataFrame, lines: DataFrame) -> DataFrame:
    """Whether any Rust file uses each crate."""
    rust = lines.filter(F.col("path").endswith(".rs") & ~X.is_test_path(F.col("path")))
    used = F.array_union(
        F.array_union(
            F.regexp_extract_all("line", F.lit(rf"({P.WORD})::"), F.lit(1)),
            F.split(F.regexp_extract("line", r"^\s*(?:pub\s+)?use\s+([A-Za-z0-9_:]+)", 1), "::")),
        F.array(F.regexp_extract("line", rf"extern\s+crate\s+({P.WORD})", 1)))
    words = rust.select(F.explode(used).alias("crate")).distinct()
    keyed = deps.select("name", F.regexp_replace("name", "-", "_").alias("crate")).distinct()
    return keyed.join(words.withColumn("u", F.lit(True)), "crate", "left").select("name", F.coalesce("u", F.lit(False)).alias("used"))


def dep_commits(deps: DataFrame, commits: DataFrame, per_dep: int = 2, total: int | None = None) -> DataFrame:
    """Newest commits that name each dependency."""
    hits = mentions(deps.select("name"), commits.select("hash", "date", "subject"), "subject")
    top = top_per_group(hits.distinct(), ["name"], [F.col("date").desc(), F.col("hash").desc()], per_dep)
    out = top.select("name", "rank", "subject", X.commit_anchor(F.col("hash"), F.col("date")).alias("anchor"))
    return out if total is None else out.orderBy("name", "rank").limit(total)


def package_edges(lines: DataFrame, packages: DataFrame, declared: DataFrame) -> DataFrame:
    """Imports between packages: [from, to, import_count, declared].

    `packages` have name, dir and ord; `declared` have name and dep.
    """
    code = lines.filter(F.col("path").rlike(r"\.(?:ts|tsx|js|jsx|vue|mjs|cjs)$") & ~X.is_test_path(F.col("path")))
    specs = import_specifiers(code).select("path", "specifier")
    def owner(df: DataFrame, path: str, name: str) -> DataFrame:
        segs = F.split(F.col(path), "/")
        prefixes = F.transform(F.sequence(F.lit(1), F.size(segs)), lambda n: F.array_join(F.slice(segs, F.lit(1), n), "/"))
        runs = df.select(path).distinct().select(path, F.explode(prefixes).alias("dir"))
        hit = runs.join(packages.filter("dir <> '.'").select("dir", "name", "ord"), "dir")
        return hit.groupBy(path).agg(F.min_by("name", "ord").alias(name))
    placed = specs.join(owner(specs, "path", "from_pkg"), "path")
    relative = F.col("specifier").startswith(".")
    joined = F.concat_ws("/", X.dirname(F.col("path")), "specifier")
    resolved = F.regexp_replace(F.regexp_replace(F.regexp_replace(joined, r"/\./", "/"), r"/[^/]+/\.\./", "/"), "/$", "")
    local = placed.filter(relative).withColumn("target", resolved)
    local = local.join(owner(local, "target", "to_pkg"), "target").select("from_pkg", "to_pkg")
    bare = F.regexp_replace(F.regexp_replace("specifier", "^(?:workspace:|npm:)", ""), r"(?<=.)@[^/]+$", "")
    outer = placed.filter(~relative).withColumn("to_pkg", bare).join(packages.select(F.col("name").alias("to_pkg")).distinct(), "to_pkg", "left_semi").select("from_pkg", "to_pkg")
    counts = local.unionByName(outer).filter("from_pkg <> to_pkg").groupBy("from_pkg", "to_pkg").agg(F.count("*").alias("import_count"))
    pairs = declared.select(F.col("name").alias("from_pkg"), F.col("dep").alias("to_pkg"), F.lit(True).alias("d")).distinct()
    return counts.join(pairs, ["from_pkg", "to_pkg"], "left").select("from_pkg", "to_pkg", "import_count", F.coalesce("d", F.lit(False)).alias("declared"))


def undeclared_edges(edges: DataFrame, limit: int | None = None) -> DataFrame:
    out = edges.filter("NOT declared").select("from_pkg", "to_pkg", "import_count")
    return out if limit is None else out.orderBy(F.col("import_count").desc(), "from_pkg", "to_pkg").limit(limit)


def method_resolution(sites: DataFrame, methods: DataFrame, lines: DataFrame) -> DataFrame:
    """Call sites with their confidence: one defining file, or every candidate proven by a `use` of the caller."""
    defs = methods.filter(~X.is_test_path(F.col("file"))).select(F.col("name").alias("method"), "file").distinct()
    totals = defs.groupBy("method").agg(F.count("*").alias("candidates"))
    placed = sites.join(totals, "method")
    several = placed.filter("candidates > 1").select("path", "method", "candidates").distinct()
    wanted = defs.join(several.select("method").distinct(), "method", "left_semi")
    segs = F.filter(F.split(F.regexp_replace("file", "^src-tauri/", ""), "/"), lambda s: (s != "src") & ~s.endswith(".rs"))
    with_segs = wanted.withColumn("segs", segs)
    free = with_segs.filter(F.size("segs") == 0).groupBy("method").agg(F.count("*").alias("free"))
    by_seg = with_segs.select("method", "file", F.explode("segs").alias("seg")).distinct()
    # segments occur inside the used path
    uses = all_matches(lines, r"use\s+([A-Za-z0-9_:]+);", ["used"]).select("path", F.explode(F.split("used", "::")).alias("word")).distinct()
    seen = substrings(uses, by_seg.select(F.col("seg").alias("part")))
    caller_segs = uses.join(seen, "word").select("path", F.col("part").alias("seg")).distinct()
    proven = several.join(by_seg, "method").join(caller_segs, ["path", "seg"], "left_semi").groupBy("path", "method").agg(F.countDistinct("file").alias("proven"))
    graded = several.join(proven, ["path", "method"], "left").join(free, "method", "left")
    full = F.coalesce("proven", F.lit(0)) + F.coalesce("free", F.lit(0)) >= F.col("candidates")
    graded = graded.select("path", "method", full.alias("full"))
    out = placed.join(graded, ["path", "method"], "left")
    return out.select("path", "line_no", "method", "candidates", F.when((F.col("candidates") == 1) | F.col("full"), "resolved").otherwise("ambiguous").alias("confidence"))


#: Length of the pieces by which substrings are looked up; shorter parts are looked up whole.
GRAM = 3


def _grams(column: str, size: int) -> Column:
    """Distinct pieces of `size` characters, in one pass over the text."""
    chars = F.filter(F.split(F.col(column), ""), lambda c: c != "")
    shifted = [F.slice(chars, F.lit(i + 1), F.greatest(F.size(chars) - i, F.lit(0))).alias(f"c{i}") for i in range(size)]
    whole = F.transform(F.arrays_zip(*shifted), lambda x: F.concat(*[x[f"c{i}"] for i in range(size)]))
    return F.array_distinct(F.filter(whole, lambda g: g.isNotNull()))


def substrings(words: DataFrame, parts: DataFrame) -> DataFrame:
    """(word, part) for every part that occurs in a word.

    Each part is looked up by its rarest piece of GRAM characters, and only the words with that piece are searched;
    the work is linear in the length of a word.
    """
    words, parts = words.select("word").distinct(), parts.select("part").filter("part <> ''").distinct()
    size = F.least(F.length("part"), F.lit(GRAM))
    sizes = sorted(r[0] for r in parts.select(size).distinct().collect())  # 1 to GRAM
    if not sizes:
        return words.limit(0).withColumn("part", F.lit(""))
    pieces, own = None, None
    for n in sizes:
        of_words = words.filter(F.length("word") >= n).select("word", F.explode(_grams("word", n)).alias("gram"))
        of_parts = parts.filter(size == n).select("part", F.explode(_grams("part", n)).alias("gram"))
        pieces = of_words if pieces is None else pieces.unionByName(of_words)
        own = of_parts if own is None else own.unionByName(of_parts)
    counts = pieces.join(own.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rated = own.join(counts, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = rated.groupBy("part").agg(F.min(F.struct("n", "gram")).alias("g")).filter("g.n > 0").select("part", F.col("g.gram").alias("gram"))
    return pieces.join(rarest, "gram").filter(F.col("word").contains(F.col("part"))).select("word", "part")


def _rarest_part(forms: DataFrame, seen: DataFrame, words: DataFrame) -> DataFrame:
    """Each form with the one of its parts that the fewest lines hold; forms with a part that no line holds are left out.

    `seen` has word and part, `words` the number of lines (n) that hold each word.
    """
    held = seen.join(words, "word").groupBy("part").agg(F.sum("n").alias("n"))
    rated = forms.join(held, "part", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = rated.groupBy("name", "side", "form", "plain").agg(F.min(F.struct("n", "part")).alias("p"))
    return rarest.filter("p.n > 0").select("name", "side", "form", "plain", "p.part")


def verify_absence(names: DataFrame, lines: DataFrame, exclude: DataFrame | None = None, max_refs: int = 3) -> DataFrame:
    """Second look before a name is called absent: suspect with up to three places, or confirmed.

    `names` have name and side (frontend, rust or any).  Forms are searched as substrings of
    code lines: inside the distinct words of the corpus first, then back to the lines.  A form of several words is looked
    up by the one that the fewest lines hold, so that forms with a common beginning do not all meet the same lines.
    """
    forms = names.select("name", "side", F.explode(F.array_distinct(F.array(F.col("name"), X.camel(F.col("name")), X.snake(F.col("name"))))).alias("form"))
    pieces = F.regexp_extract_all("form", F.lit("([A-Za-z0-9_$]+)"), F.lit(1))
    forms = forms.select("*", F.col("form").rlike("^[A-Za-z0-9_$]+$").alias("plain"), F.explode(F.array_distinct(pieces)).alias("part"))
    code = lines.filter(~F.col("line").rlike(r"^\s*(?://|/\*|\*|#)"))
    placed = code.select("path", "line_no", "line", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit("([A-Za-z0-9_$]+)"), F.lit(1)))).alias("word"))
    words = cut_lineage(placed.groupBy("word").agg(F.count("*").alias("n")))
    seen = cut_lineage(substrings(words, forms))
    hits = placed.join(seen.join(_rarest_part(forms, seen, words), "part"), "word")
    rust = F.col("path").endswith(".rs")
    hits = hits.filter(F.col("plain") | F.col("line").contains(F.col("form"))).filter((F.col("side") == "any") | ((F.col("side") == "rust") == rust))
    refs = hits.select("name", "side", "path", "line_no").distinct()
    if exclude is not None:
        refs = refs.join(exclude.select("name", "path", "line_no"), ["name", "path", "line_no"], "left_anti")
    top = top_per_group(refs, ["name", "side"], [F.col("path"), F.col("line_no")], max_refs, "ref_no")
    out = names.select("name", "side").distinct().join(top, ["name", "side"], "left")
    return out.select("name", "side", F.when(F.col("path").isNull(), "confirmed").otherwise("suspect").alias("verdict"), "ref_no", "path", "line_no")


def ipc_match(points: DataFrame) -> DataFrame:
    """Both sides of every command and event, keyed by snake_case name; orphans stay."""
    keyed = points.withColumn("ipc_kind", F.when(F.col("role").isin("call", "define"), "command").otherwise("event")).withColumn("key", X.snake(F.col("name")))
    n = lambda r: F.count_if(F.col("role") == r)
    shown = F.min_by("name", F.struct(F.when(F.col("role") == "define", 0).otherwise(1), "path", "line_no"))
    return keyed.groupBy("ipc_kind", "key").agg(
        shown.alias("name"), n("call").alias("calls"), n("define").alias("defines"), n("listen").alias("listeners"), n("emit").alias("emits"))


def ipc_reconcile(matched: DataFrame, points: DataFrame, lines: DataFrame) -> DataFrame:
    """Each missing side: scan-limit when the name occurs in the sources after all, else a true orphan."""
    def missing(cond: str, side: str, label: str) -> DataFrame:
        return matched.filter(cond).select("ipc_kind", "name", F.lit(side).alias("side"), F.lit(label).alias("missing"))
    gaps = (
        missing("ipc_kind = 'command' AND calls = 0", "frontend", "call").unionByName(missing("ipc_kind = 'command' AND defines = 0", "rust", "define"))
        .unionByName(missing("ipc_kind = 'event' AND emits = 0", "any", "emit")).unionByName(missing("ipc_kind = 'event' AND listeners = 0", "frontend", "listen")))
    listeners = points.filter("role = 'listen'").select("name", "path", "line_no")
    verdicts = verify_absence(gaps.select("name", "side").distinct(), lines, listeners)
    verdicts = verdicts.groupBy("name", "side").agg(F.max("verdict").alias("verdict"))
    return gaps.join(verdicts, ["name", "side"]).select("ipc_kind", "name", "missing", F.when(F.col("verdict") == "suspect", "scan-limit").otherwise("orphan").alias("state"))


def dep_consistency(left: DataFrame, right: DataFrame, limit: int | None = None) -> DataFrame:
    """Dependencies that count as production on one side only."""
    both = left.select("name", F.col("usage").alias("left_usage")).join(right.select("name", F.col("usage").alias("right_usage")), "name")
    odd = both.filter((F.col("left_usage") == "import") != (F.col("right_usage") == "import"))
    return odd if limit is None else odd.orderBy("name").limit(limit)


def term_variants(terms: DataFrame, glossary: DataFrame, limit: int | None = None) -> DataFrame:
    """Page terms that differ from a glossary term only in case or separators, one per page and norm."""
    norm = lambda df, c: df.select("*", X.normalized_term(F.col(c)).alias("norm"))
    canon = norm(glossary, "term").filter(F.length("norm") >= 3).groupBy("norm").agg(F.min("term").alias("standard"))
    hits = norm(terms, "term").join(canon, "norm").filter("term <> standard")
    out = hits.groupBy("page", "norm", "standard").agg(F.min("term").alias("term"))
    return out if limit is None else out.orderBy("page", "norm").limit(limit)


def evaluate_confirmations(store: DataFrame, texts: DataFrame, head: str) -> DataFrame:
    """Confirmed claims that still hold: all file hashes match, or without files the same head."""
    sized = F.size("files") == F.size("hashes")
    prints = store.filter(F.size("files") > 0).select("raw", sized.alias("sized"), F.explode(F.arrays_zip("files", "hashes")).alias("p"))
    now = texts.select(F.col("path"), F.sha2("text", 256).alias("now"))
    checked = prints.select("raw", "sized", F.col("p.files").alias("path"), F.col("p.hashes").alias("was")).join(now, "path", "left")
    same = checked.groupBy("raw").agg(F.bool_and(F.col("sized") & F.coalesce(F.col("now") == F.col("was"), F.lit(False))).alias("valid"))
    scoped = store.filter(F.size("files") == 0).select("raw", (F.col("head") == head).alias("valid"))
    return same.unionByName(scoped)


def hotspot_files(fan_in: DataFrame, symbols: DataFrame, files: DataFrame, n: int = 15) -> DataFrame:
    """The most called symbols with their first production file."""
    hot = fan_in.orderBy(F.col("fan_in").desc(), "id").limit(n)
    known = files.filter(~X.is_test_path(F.col("path"))).select(F.col("path").alias("file"))
    by_name = symbols.filter("NOT is_test").select("file", F.explode(F.array("name", "qualified_name")).alias("key"))
    wanted = hot.select("id", F.explode(F.array("name", "qualified_name")).alias("key")).distinct()
    placed = wanted.join(by_name, "key").join(known, "file", "left_semi").groupBy("id").agg(F.min("file").alias("file"))
    return hot.join(placed, "id", "left").select("id", "name", "qualified_name", "fan_in", "file")


def class_methods(symbols: DataFrame, edges: DataFrame, limit: int | None = None) -> DataFrame:
    """Types with their methods; structs, interfaces and actors count in Swift only."""
    swift = F.col("label").isin("Struct", "Interface", "Actor") & F.col("file").endswith(".swift")
    types = symbols.filter(~F.col("is_test") & ((F.col("label") == "Class") | swift)).select(
        F.col("id").alias("src"), F.col("name").alias("class_name"), F.col("file").alias("class_file"), F.col("start_line").alias("class_line"))
    methods = symbols.filter("label = 'Method'").select(F.col("id").alias("dst"), F.col("name").alias("method"), F.col("file").alias("method_file"), F.col("start_line").alias("method_line"))
    pairs = edges.filter("type = 'DEFINES_METHOD'").select("src", "dst").distinct().join(types, "src").join(methods, "dst")
    out = pairs.select("class_name", "class_file", "class_line", "method", "method_file", "method_line")
    return out if limit is None else out.orderBy("class_name", "method_line", "class_file", "method", "method_file").limit(limit)


def module_relations(boundaries: DataFrame, modules: DataFrame) -> DataFrame:
    """Neighbours of each production module, both ways."""
    names = modules.select("module").distinct()
    kept = boundaries.join(names.select(F.col("module").alias("from_module")), "from_module", "left_semi").join(
        names.select(F.col("module").alias("to_module")), "to_module", "left_semi").select("from_module", "to_module").distinct()
    out = kept.select(F.col("from_module").alias("module"), F.lit("outgoing").alias("direction"), F.col("to_module").alias("neighbour"))
    return out.unionByName(kept.select(F.col("to_module").alias("module"), F.lit("incoming").alias("direction"), F.col("from_module").alias("neighbour")))


def type_definitions(references: DataFrame, types: DataFrame, stage_files: DataFrame, lines: DataFrame, cap: int | None = None, text_cap: int | None = None, starts: DataFrame | None = None) -> DataFrame:
    """Types that stage signatures name (one definition each, in a stage file if there is one), then other local types.

    A type without end line ends where its braces close, else before the next symbol of `starts` (default: types).
    Texts are whole unless `text_cap` cuts them.
    """
    from codeloom.operators.extract_code import body_ranges, lines_within

    kinds = types.filter(F.col("label").isin("Interface", "Type", "Enum", "Class"))
    staged = stage_files.select("file").distinct().withColumn("staged", F.lit(True))
    kinds = kinds.join(staged, "file", "left").withColumn("staged", F.coalesce("staged", F.lit(False)))
    named = kinds.join(references.select(F.col("reference").alias("name")).distinct(), "name", "left_semi")
    first = top_per_group(named, ["name"], [F.col("staged").desc(), F.col("id")], 1).drop("rank").withColumn("tier", F.lit(1))
    others = kinds.filter(F.col("staged") & (F.col("label") != "Class")).join(references.select(F.col("reference").alias("name")), "name", "left_anti").withColumn("tier", F.lit(2))
    chosen = first.unionByName(others)
    if cap is not None:
        chosen = chosen.orderBy("tier", "file", "start_line", "id").limit(cap)
    spans = body_ranges(chosen, lines, starts=types if starts is None else starts)
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    texts = lines_within(spans, lines).groupBy("id").agg(F.trim(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")).alias("body"))
    out = chosen.join(texts, "id", "left").withColumn("body", F.regexp_replace("body", r"^\s+|\s+$", ""))
    missing = F.concat(F.lower("label"), F.lit(" "), "name", F.lit("（定义体不可读；"), F.when(F.col("tier") == 1, "签名显式引用").otherwise("阶段文件内本地定义"), F.lit("）"))
    text = F.when(F.coalesce("body", F.lit("")) == "", missing).otherwise(F.col("body"))
    if text_cap is not None:
        text = F.when(F.length(text) > text_cap, F.concat(F.substring(text, 1, text_cap), F.lit("\n// …（已截断）"))).otherwise(text)
    return out.select("id", "name", F.lower("label").alias("kind"), "file", "start_line", "tier", text.alias("text"))
