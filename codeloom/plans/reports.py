"""Report queries: one table of (section, key, detail) rows per page family."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from codeloom.functions import text as X, vocab


def section(df: DataFrame, name: str, key: Column | str, detail: Column | str) -> DataFrame:
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(F.lit(name).alias("section"), col(key).cast("string").alias("key"), col(detail).cast("string").alias("detail"))


def report(*sections: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, sections)


def entry_files(files: DataFrame, names: tuple[str, ...] = vocab.ENTRY_FILE_NAMES) -> DataFrame:
    """Production files with an entry file's name."""
    return files.filter(~X.is_test_path(F.col("path")) & X.basename(F.col("path")).isin(*names)).select("path")


def overview(totals: DataFrame, mix: DataFrame, entries: DataFrame, hotspots: DataFrame, usage: DataFrame) -> DataFrame:
    flat = totals.select(F.inline(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).alias("v")) for c in ("total", "production", "test")])))
    return report(
        section(flat, "files", "k", "v"), section(mix.select("language", "file_count").distinct(), "language", "language", "file_count"),
        section(entries, "entry", "path", F.lit("")), section(hotspots, "hotspot", "name", "fan_in"), section(usage, "dependency", "name", "usage"))


def architecture(modules: DataFrame, sample: DataFrame, relations: DataFrame, boundaries: DataFrame, layers: DataFrame, clusters: DataFrame, per_module: int = 6) -> DataFrame:
    return report(
        section(modules, "module", "module", "files"), section(sample.filter(F.col("place") <= per_module), "symbol", "module", F.concat_ws("#", "place", "id")),
        section(relations, "relation", F.concat_ws(":", "module", "direction"), "neighbour"), section(boundaries, "boundary", F.concat_ws("→", "from_module", "to_module"), "call_count"),
        section(layers, "layer", "name", "reason"), section(clusters, "cluster", "id", "members"))


def modules_page(importance: DataFrame, sample: DataFrame, relations: DataFrame) -> DataFrame:
    """Samples and neighbours for the detailed modules, totals for the others."""
    detailed = importance.filter("detailed").select("module")
    return report(
        section(importance.filter("detailed"), "detailed", "module", "importance"), section(importance.filter("NOT detailed"), "summary", "module", "importance"),
        section(sample.join(detailed, "module", "left_semi"), "symbol", "module", F.concat_ws("#", "place", "id")),
        section(relations.join(detailed, "module", "left_semi"), "relation", F.concat_ws(":", "module", "direction"), "neighbour"))


def api(commands: DataFrame, exported: DataFrame, surface: DataFrame) -> DataFrame:
    return report(section(commands, "command", "name", "command"), section(exported, "function", "name", "complexity"), section(surface, "surface", F.concat_ws(":", "ipc_kind", "key"), F.concat_ws("/", "calls", "defines", "listeners", "emits")))


def data_flow(stages: DataFrame, moves: DataFrame, types: DataFrame, coverage: DataFrame) -> DataFrame:
    return report(
        section(stages, "stage", F.concat_ws("@", "name", "file"), "role"), section(moves.filter("carries"), "transition", F.concat_ws("→", "caller_name", "callee_name"), "call_line"),
        section(types, "type", "name", "kind"), section(coverage, "coverage", "counter", "n"))


def onboarding(entries: DataFrame, dirs: DataFrame, dir_files: DataFrame, env: DataFrame, prereqs: DataFrame) -> DataFrame:
    return report(
        section(entries, "entry", "path", F.lit("")), section(dirs, "directory", "dir", "file_count"), section(dir_files, "file", "dir", "path"),
        section(env.select("name", "sensitive").distinct(), "env", "name", "sensitive"), section(prereqs, "prerequisite", "page", "title"))


def troubleshooting(markers: DataFrame, churn: DataFrame, constants: DataFrame) -> DataFrame:
    return report(section(markers, "marker", "anchor", "text"), section(churn, "churn", "file", "commits"), section(constants.groupBy("name").agg(F.count("*").alias("n")), "constant", "name", "n"))


def constraints(constants: DataFrame, hot: DataFrame, comments: DataFrame) -> DataFrame:
    return report(
        section(constants, "constant", F.concat_ws(":", "path", "line_no"), "value"), section(hot, "hot", "id", "complexity"),
        section(comments.filter("kind = 'const-comment'"), "comment", "anchor", "text"))


def decisions(timeline: DataFrame, docs: DataFrame, churn: DataFrame, commits: DataFrame) -> DataFrame:
    """Module history, document sections, busiest files and dependency commits; empty without any of them."""
    return report(
        section(timeline, "module", "module", "commits"), section(docs, "document", "anchor", "text"), section(churn, "churn", "file", "commits"), section(commits, "dependency", "name", "anchor"))


def tech_stack(partition: DataFrame, crates: DataFrame, commits: DataFrame, tools: DataFrame) -> DataFrame:
    return report(section(partition, "dependency", "name", "group"), section(crates, "crate", "name", "used"), section(commits, "commit", "name", "anchor"), section(tools, "tool", "pkg", "build_tool"))


def cli(descriptions: DataFrame, options: DataFrame, exits: DataFrame) -> DataFrame:
    return report(section(descriptions, "command", "path", "description"), section(options, "option", F.concat_ws(":", "path", "flag"), "description"), section(exits, "exit", F.concat_ws(":", "path", "line_no"), "code"))


def topic(symbols: DataFrame, edges: DataFrame, boundaries: DataFrame, ids: DataFrame) -> DataFrame:
    """Subgraph and numbered evidence of every topic or chapter page."""
    return report(
        section(symbols, "symbol", "topic", F.concat_ws("#", "rank", "id")), section(edges, "edge", "topic", F.concat("caller_name", F.lit("→"), "callee_name")),
        section(boundaries, "boundary", "topic", F.concat_ws("→", "from_module", "to_module")), section(ids, "evidence", F.concat_ws(":", "topic", "id"), "anchor"))


ROOT_TEST_DIRS = ("tests", "test", "__tests__", "spec")
TEST_FRAMEWORKS = ("vitest", "jest", "mocha", "@playwright/test", "ava")
LOCKFILES = (("bun.lock", "bun"), ("bun.lockb", "bun"), ("pnpm-lock.yaml", "pnpm"), ("yarn.lock", "yarn"))
NATIVE_MANIFESTS = (
    ("pyproject.toml", "Python", "pip"), ("requirements.txt", "Python", "pip"), ("go.mod", "Go", "go modules"), ("pom.xml", "JVM", "maven"),
    ("build.gradle", "JVM", "gradle"), ("build.gradle.kts", "JVM", "gradle"), ("Package.swift", "Swift", "swift package manager"), ("Podfile", "Swift", "cocoapods"))
LINT_CONFIGS = (
    "eslint.config.js", "eslint.config.mjs", "eslint.config.ts", "eslint.config.cjs", ".eslintrc.js", ".eslintrc.json", ".eslintrc.cjs", "biome.json", ".oxlintrc.json")


def test_dirs(files: DataFrame) -> DataFrame:
    """Root test directories, and the directories of test files beside their sources."""
    path = F.col("path")
    root = files.filter(F.substring_index(path, "/", 1).isin(*ROOT_TEST_DIRS) & path.contains("/")).select(F.substring_index(path, "/", 1).alias("dir"))
    beside = files.filter(path.rlike(vocab.TEST_FILE_SUFFIX) & path.contains("/")).select(X.dirname(path).alias("dir"))
    return root.union(beside).distinct()


def _first_of(files: DataFrame, names: list[str], values: list[str], column: str) -> DataFrame:
    """Value of the first listed file each repository has at its root; `files` have repo and path."""
    order = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("path"))
    best = files.filter(order > 0).groupBy("repo").agg(F.min(order).alias("o"))
    return best.select("repo", F.element_at(F.array(*[F.lit(v) for v in values]), F.col("o").cast("int")).alias(column))


def environment(files: DataFrame, declared: DataFrame) -> DataFrame:
    """Package manager and runtime of every repository.

    `files` have repo and path; `declared` repo and manager (the manifest's own field).  Precedence: the field,
    then lock files, then npm; without a manifest the first native manifest decides.
    """
    repos = files.select("repo").distinct()
    locks = _first_of(files, [n for n, _ in LOCKFILES], [m for _, m in LOCKFILES], "lock")
    native = _first_of(files, [n for n, *_ in NATIVE_MANIFESTS], [r for _, r, _ in NATIVE_MANIFESTS], "runtime")
    tool = _first_of(files, [n for n, *_ in NATIVE_MANIFESTS], [t for *_, t in NATIVE_MANIFESTS], "tool")
    node = files.filter("path = 'package.json'").select("repo", F.lit(True).alias("node")).distinct()
    rows = repos.join(node, "repo", "left").join(declared.select("repo", F.substring_index("manager", "@", 1).alias("own")), "repo", "left").join(locks, "repo", "left").join(native, "repo", "left").join(tool, "repo", "left")
    other = F.col("node").isNull() & F.col("runtime").isNotNull()
    return rows.select(
        "repo", F.when(other, F.col("runtime")).otherwise("Node").alias("runtime"),
        F.when(other, F.col("tool")).otherwise(F.coalesce("own", "lock", F.lit("npm"))).alias("package_manager"))


def conventions(files: DataFrame, scripts: DataFrame) -> DataFrame:
    """Lint configuration of every repository: a file, else the tool its lint script runs."""
    configs = _first_of(files, list(LINT_CONFIGS), list(LINT_CONFIGS), "config")
    tool = F.regexp_extract("command", r"(?<![A-Za-z0-9_])(oxlint|eslint|biome|ruff|deno(?:\s+lint)?)(?![A-Za-z0-9_])", 1)
    linted = scripts.filter("script = 'lint'").select("repo", F.concat(F.lit("scripts.lint: "), tool).alias("told"), tool.alias("t")).filter("t <> ''").groupBy("repo").agg(F.min("told").alias("told"))
    rows = files.select("repo").distinct().join(configs, "repo", "left").join(linted, "repo", "left")
    return rows.select("repo", F.coalesce("config", "told").alias("linter"))


def testing(dirs: DataFrame, only_env: DataFrame, only_constants: DataFrame, only_deps: DataFrame) -> DataFrame:
    return report(section(dirs, "directory", "dir", F.lit("")), section(only_env, "env", "name", F.lit("")), section(only_constants, "constant", "name", F.lit("")), section(only_deps, "dependency", "name", F.lit("")))
