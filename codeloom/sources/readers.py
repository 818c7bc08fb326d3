"""Sources: file trees, graphs, commit logs and manifests as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from codeloom.functions import text as X, vocab

DEPENDENCY_TABLES = ("dependencies", "dev-dependencies", "build-dependencies")


def tag_inventory(files: DataFrame, ignore_dirs: Sequence[str] = vocab.IGNORED_DIRS,
                  extensions: Sequence[str] = vocab.SUPPORTED_EXTENSIONS) -> DataFrame:
    """Keep supported files outside ignored and hidden directories; add ext, language and scope."""
    dirs = "|".join([d.replace(".", r"\.") for d in ignore_dirs] + [r"\.[^/]*"])
    path = F.col("path")
    return (
        files.filter(~path.rlike(f"(?:^|/)(?:{dirs})/"))
        .withColumn("ext", X.extension(path))
        .filter(F.col("ext").isin(*extensions))
        .withColumn("language", X.language(path))
        .withColumn("scope", F.when(X.is_test_path(path), "test").otherwise("production"))
    )


def file_inventory(spark: SparkSession, root: str, ignore_dirs: Sequence[str] = vocab.IGNORED_DIRS,
                   extensions: Sequence[str] = vocab.SUPPORTED_EXTENSIONS) -> DataFrame:
    """Files below a root; contents are pruned, so no bytes are read."""
    base = root.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    full = F.regexp_replace("path", "^file:/*", "/")
    relative = full.substr(F.lit(len(base) + 2), F.length(full))
    return tag_inventory(found.select(relative.alias("path"), F.col("length").alias("size")), ignore_dirs, extensions)


def read_texts(spark: SparkSession, root: str) -> DataFrame:
    """Whole text of every file below a root."""
    base = root.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    full = F.regexp_replace("path", "^file:/*", "/")
    return found.select(full.substr(F.lit(len(base) + 2), F.length(full)).alias("path"), F.decode("content", "UTF-8").alias("text"))


def columnar_rows(tables: DataFrame, fields: Sequence[str], cols: str = "cols", rows: str = "rows") -> DataFrame:
    """Rows of `{cols, rows}` tables as columns; missing fields are null."""
    exploded = tables.select(F.col(cols).alias("c"), F.explode(rows).alias("r"))
    row = F.map_from_arrays("c", "r")
    return exploded.select(*[F.try_element_at(row, F.lit(f)).alias(f) for f in fields])


def modern_names(rows: DataFrame) -> DataFrame:
    """Legacy graph keys under their present names."""
    renames = (("nodes", "node_count"), ("calls", "call_count"), ("files", "file_count"), ("qn", "qualified_name"))
    out = rows
    for old, new in renames:
        if old in out.columns:
            value = F.coalesce(F.col(new), F.col(old)) if new in out.columns else F.col(old)
            out = out.withColumn(new, value).drop(old)
    if "qualified_name" in out.columns:
        short = F.substring_index("qualified_name", ".", -1)
        out = out.withColumn("name", F.coalesce(F.col("name"), short) if "name" in out.columns else short)
    return out


def load_graph(spark: SparkSession, nodes_path: str, edges_path: str, fmt: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """Symbol nodes and typed edges."""
    return modern_names(spark.read.format(fmt).load(nodes_path)), spark.read.format(fmt).load(edges_path)


def parse_commits(lines: DataFrame, value: str = "value", subject_cap: int | None = None) -> DataFrame:
    """Tab-separated log lines; blank lines and lines without hash, date or subject are dropped."""
    parts = F.split(F.trim(F.col(value)), "\t", 3)
    parsed = lines.select(
        F.try_element_at(parts, F.lit(1)).alias("hash"),
        F.try_element_at(parts, F.lit(2)).alias("date"),
        F.trim(F.try_element_at(parts, F.lit(3))).alias("subject"),
    )
    kept = parsed.filter("hash <> '' AND date <> '' AND subject <> ''")
    return kept.select("hash", F.to_date("date").alias("date"), (F.col("subject") if subject_cap is None else F.substring("subject", 1, subject_cap)).alias("subject"))


def load_commits(spark: SparkSession, log_path: str) -> DataFrame:
    return parse_commits(spark.read.text(log_path))


MANIFEST = "name STRING, version STRING, private BOOLEAN, dependencies MAP<STRING,STRING>, devDependencies MAP<STRING,STRING>"


def packages(manifests: DataFrame, repo: str = "repo") -> DataFrame:
    """One row per package manifest: a root manifest counts only when its repository has no other."""
    parsed = manifests.select(repo, "pkg_dir", F.from_json("content", MANIFEST).alias("m"))
    sizes = manifests.groupBy(repo).agg(F.count("*").alias("n_manifests"))
    named = parsed.join(sizes, repo).filter((F.col("pkg_dir") != ".") | (F.col("n_manifests") == 1))
    return named.filter(F.col("m.name").isNotNull()).select(
        repo, "pkg_dir", "m.name", F.coalesce("m.version", F.lit("")).alias("version"),
        F.coalesce("m.private", F.lit(False)).alias("is_private"), "m.dependencies", "m.devDependencies",
    )


def manifest_deps(manifests: DataFrame, repo: str = "repo") -> DataFrame:
    """Declared dependencies of every package."""
    pkgs = packages(manifests, repo)
    def side(column: str, kind: str) -> DataFrame:
        return pkgs.select(repo, "pkg_dir", "name", "version", F.explode(column).alias("dep", "dep_version"), F.lit(kind).alias("kind"))
    return side("dependencies", "prod").unionByName(side("devDependencies", "dev"))


def toml_deps(lines: DataFrame) -> DataFrame:
    """Dependency rows of TOML lines, in plain and inline-table form."""
    t = F.trim("line")
    header = F.regexp_extract(t, r"^\[([^\]]+)\]$", 1)
    order = W.partitionBy("path").orderBy("line_no")
    sectioned = lines.withColumn("section", F.last(F.when(header != "", header), ignorenulls=True).over(order))
    plain = r'^([A-Za-z0-9_-]+)\s*=\s*"([^"]+)"'
    table = r'^([A-Za-z0-9_-]+)\s*=\s*\{\s*version\s*=\s*"([^"]+)"'
    rows = sectioned.filter(F.col("section").isin(*DEPENDENCY_TABLES)).withColumn("t", F.trim("line"))
    def pick(group: int):
        return F.coalesce(F.nullif(F.regexp_extract("t", plain, group), F.lit("")), F.nullif(F.regexp_extract("t", table, group), F.lit("")))
    return rows.select("path", "line_no", "section", pick(1).alias("name"), pick(2).alias("version")).filter("name IS NOT NULL")


def flatten_exports(manifests: DataFrame, cap: int | None = None) -> DataFrame:
    """Leaves of the `exports` field with `/`-joined keys, in document order; opens one level of objects at a time."""
    level = manifests.select("package", F.lit("").alias("key"), F.col("exports").alias("value"), F.array().cast("array<int>").alias("ord"))
    leaves, is_object = None, F.col("value").startswith("{")
    while True:
        done = level.filter(~is_object)
        leaves = done if leaves is None else leaves.unionByName(done)
        opened = level.filter(is_object)
        if opened.isEmpty():
            break
        opened = opened.select("package", F.col("key").alias("up"), "ord", F.posexplode(F.from_json("value", "MAP<STRING,STRING>")).alias("pos", "k", "value"))
        level = opened.select(
            "package", F.when(F.col("up") == "", F.col("k")).otherwise(F.concat_ws("/", "up", "k")).alias("key"), "value",
            F.concat("ord", F.array("pos")).alias("ord"))
    if cap is not None:
        leaves = leaves.withColumn("rn", F.row_number().over(W.partitionBy("package").orderBy("ord"))).filter(F.col("rn") <= cap)
    return leaves.select("package", F.when(F.col("key") == "", ".").otherwise(F.col("key")).alias("key"), "value")
