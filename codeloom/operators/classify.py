"""Projections, filters and classifiers over files, symbols and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from codeloom.functions import text as X, vocab
from codeloom.session import fixed_table


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int | None, rank: str = "rank") -> DataFrame:
    """First n rows per group, or all without n; Spark cuts each map output to n rows per group before the shuffle."""
    ranked = df.withColumn(rank, F.row_number().over(W.partitionBy(*group).orderBy(*order)))
    return ranked if n is None else ranked.filter(F.col(rank) <= n)


def language_mix(files: DataFrame, examples: int = 3) -> DataFrame:
    """Files per language, one row per example path (at most `examples`)."""
    tagged = files.select("path", X.language(F.col("path")).alias("language"))
    counts = tagged.groupBy("language").agg(F.count("*").alias("file_count"))
    top = top_per_group(tagged, ["language"], [F.col("path")], examples, "example_no")
    return counts.join(top, "language").select("language", "file_count", "example_no", F.col("path").alias("example"))


def domain_top3(files: DataFrame, n: int = 3) -> DataFrame:
    """The main code domains of each module."""
    domain = F.coalesce(X.language_domain(F.col("path")), F.lit("other")).alias("domain")
    counts = files.groupBy("module", domain).agg(F.count("*").alias("file_count"))
    return top_per_group(counts, ["module"], [F.col("file_count").desc(), F.col("domain")], n)


def scope_counts(files: DataFrame) -> DataFrame:
    test = X.is_test_path(F.col("path"))
    return files.agg(
        F.count("*").alias("total"), F.count_if(~test).alias("production"), F.count_if(test).alias("test"))


def imports_by_package(specs: DataFrame) -> DataFrame:
    pkg = X.package_name(F.col("specifier")).alias("package")
    return specs.select(pkg).filter("package IS NOT NULL").groupBy("package").agg(F.count("*").alias("uses"))


def drop_placeholders(symbols: DataFrame) -> DataFrame:
    """Drop rows whose name is a 'no … found' filler."""
    return symbols.filter(~F.trim("name").rlike(vocab.PLACEHOLDER) | F.col("name").isNull())


def normalize_qualified_name(symbols: DataFrame, root: str) -> DataFrame:
    """Strip a mangled root prefix, then the leading segments that equal the file path."""
    segs = [s for s in root.split("/") if s]
    value = F.col("qualified_name")
    for sep in (".", "-"):
        prefix = sep.join(segs) + "."
        if segs:
            value = F.when(F.col("qualified_name").startswith(prefix), F.col("qualified_name").substr(F.lit(len(prefix) + 1), F.length("qualified_name"))).otherwise(value)
    df = symbols.withColumn("_qn", value)
    names = F.split("_qn", r"\.")
    path = F.filter(F.split(F.regexp_replace("file", r"\.[^./]*$", ""), "/"), lambda p: p != "")
    same = F.zip_with(names, path, lambda a, b: F.coalesce(a == b, F.lit(False)))
    # first position that differs, never past the last name segment
    first_diff = F.array_position(same, False)
    cut = F.least(F.when(first_diff > 0, first_diff - 1).otherwise(F.size(same)), F.size(names) - 1).cast("int")
    kept = F.when(cut > 0, F.array_join(F.slice(names, cut + 1, F.size(names) - cut), ".")).otherwise(F.col("_qn"))
    return df.withColumn("normalized", F.when(F.col("file").isNull(), F.col("_qn")).otherwise(kept)).drop("_qn")


def merge_signature(symbols: DataFrame) -> DataFrame:
    """Signature with its return type, in the form of the file's language."""
    blank = lambda c: F.nullif(X.one_line(F.col(c)), F.lit(""))
    sig, ret = blank("signature"), blank("return_type")
    arrow = F.when(F.col("file").endswith(".rs"), " -> ").otherwise(": ")
    merged = (
        F.when(sig.isNull(), F.nullif(F.col("return_type"), F.lit("")))
        .when(ret.isNull() | ~sig.rlike(r"\)\s*$"), sig)
        .otherwise(F.concat(sig, arrow, ret))
    )
    return symbols.withColumn("merged_signature", merged)


def symbol_kind(symbols: DataFrame) -> DataFrame:
    return symbols.withColumn("kind", F.coalesce(X.lookup(vocab.SYMBOL_KIND, F.col("label")), F.lit("function")))


def is_build_script(path: Column) -> Column:
    return path.rlike(r"(^|/)(build|deps)\.rs$")


def app_entry_points(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Entries whose file is a production code file and no build script."""
    path = F.col("path")
    apps = files.filter(~X.is_test_path(path) & X.language_domain(path).isNotNull() & ~is_build_script(path))
    return entries.join(apps.select(path.alias("file")), "file", "left_semi")


def classify_comment_lines(lines: DataFrame) -> DataFrame:
    return lines.withColumn("evidence", F.when(X.is_comment_line(F.col("line"), F.col("path")), "mention").otherwise("usage"))


def classify_command_entries(entries: DataFrame) -> DataFrame:
    """Entries named like commands, with the command name; all others are exported functions."""
    command = F.col("name").startswith("register") | F.col("name").contains("Command")
    cleaned = F.lower(F.regexp_replace(F.regexp_replace("name", "^register", ""), "Command$", ""))
    shown = F.when(cleaned == "", F.col("name")).otherwise(cleaned)
    return entries.withColumn("entry_kind", F.when(command, "command").otherwise("function")).withColumn(
        "command", F.when(command, shown))


def project_type(stacks: DataFrame, monorepos: DataFrame | None = None, libraries: DataFrame | None = None) -> DataFrame:
    """Type of each repository by the number of indicator packages in its stack."""
    pairs = [(t, p, i) for i, (t, ps) in enumerate(vocab.PROJECT_TYPE_INDICATORS.items()) for p in ps]
    # fixed list of a few dozen pairs
    indicators = fixed_table(stacks.sparkSession, "type, package, type_order", pairs)
    scores = (
        stacks.select("repo", "package").distinct().join(F.broadcast(indicators), "package")
        .groupBy("repo", "type", "type_order").agg(F.count("*").alias("score"))
    )
    best = top_per_group(scores, ["repo"], [F.col("score").desc(), F.col("type_order")], 1)
    out = stacks.select("repo").distinct().join(best.select("repo", "type", "score"), "repo", "left")
    found = F.col("type")
    if libraries is not None:
        out = out.join(libraries.select("repo", F.lit(True).alias("is_library")).distinct(), "repo", "left")
        found = F.coalesce(found, F.when(F.col("is_library"), "library"))
    if monorepos is not None:
        out = out.join(monorepos.select("repo", F.lit(True).alias("is_mono")).distinct(), "repo", "left")
        found = F.when(F.col("is_mono"), "monorepo").otherwise(found)
    return out.select("repo", F.coalesce(found, F.lit("unknown")).alias("project_type"), F.coalesce("score", F.lit(0)).alias("score"))


def source_dirs(files: DataFrame, minimum: int = 3) -> DataFrame:
    """Known top directories, and any other with enough production files."""
    path = F.col("path")
    nested = files.filter(path.contains("/") & ~X.is_test_path(path))
    counts = nested.groupBy(F.substring_index(path, "/", 1).alias("dir")).agg(F.count("*").alias("file_count"))
    known = F.col("dir").isin(*vocab.KNOWN_SOURCE_DIRS)
    return counts.withColumn("is_known", known).filter(F.col("is_known") | (F.col("file_count") >= minimum))


HTTP_STACK = r"(?i)express|fastify|nest|koa|hono|apollo|restify"


def trusted_layers(layers: DataFrame, packages: DataFrame, stack: DataFrame) -> DataFrame:
    """Layers of real packages; 'HTTP route' reasons need an HTTP framework in the stack."""
    has_http = stack.agg(F.coalesce(F.bool_or(F.col("package").rlike(HTTP_STACK)), F.lit(False)).alias("h")).select("h").scalar()
    kept = layers.join(packages.select("name"), "name", "left_semi")
    return kept.filter(has_http | ~F.col("reason").rlike("(?i)HTTP route"))


def redact_long_tokens(texts: DataFrame, column: str = "text") -> DataFrame:
    hits = F.regexp_count(F.col(column), F.lit("[A-Za-z0-9+/=_-]{40,}"))
    return texts.withColumn("redacted", X.redact(F.col(column))).withColumn("hits", hits)


def files_per_module(files: DataFrame, path: str = "path") -> DataFrame:
    return files.groupBy(X.module_key(F.col(path)).alias("module_key")).agg(F.count("*").alias("file_count"))


def build_tool(deps: DataFrame) -> DataFrame:
    """First present build tool of each package, by fixed precedence."""
    rank = F.array_position(F.array(*[F.lit(t) for t in vocab.BUILD_TOOLS]), F.col("dep"))
    best = deps.groupBy("pkg").agg(F.min(F.when(rank > 0, rank)).alias("r"))
    names = F.array(*[F.lit(t) for t in vocab.BUILD_TOOLS])
    return best.select("pkg", F.coalesce(F.try_element_at(names, F.col("r").cast("int")), F.lit("unknown")).alias("build_tool"))


def shape_counts(args: DataFrame) -> DataFrame:
    shape = F.coalesce(X.literal_shape(F.col("expression")), F.lit("none")).alias("shape")
    return args.groupBy(shape).agg(F.count("*").alias("uses"))
