"""The line table and the pattern job every extractor uses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from codeloom.functions import text as X, vocab


def by_line(key: str):
    """All lines of one file; a file came from one text, so the group fits where the text did."""
    return W.partitionBy(key).orderBy("line_no")


def line_table(files: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """1-based lines of every file."""
    return files.select(key, F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "line")).select(
        key, (F.col("pos") + 1).alias("line_no"), "line")


def with_fences(lines: DataFrame, key: str = "page") -> DataFrame:
    """Add `is_fence` and `in_fence` (an odd number of fence lines before)."""
    fence = F.col("line").rlike(vocab.FENCE)
    seen = F.count_if(F.col("is_fence")).over(by_line(key))
    return lines.withColumn("is_fence", fence).withColumn("in_fence", seen % 2 == 1)


def outside_fences(lines: DataFrame, key: str = "page") -> DataFrame:
    return with_fences(lines, key).filter(~F.col("is_fence") & ~F.col("in_fence")).drop("is_fence", "in_fence")


def with_details(lines: DataFrame, key: str = "page") -> DataFrame:
    """Lines outside fences with `in_details`, true also on the two marker lines."""
    shut = F.col("line").rlike("</details>")
    opened = F.col("line").rlike(r"^\s*<details\b")
    marker = F.when(opened, True).when(shut, False)
    last = F.last(F.col("_mark"), ignorenulls=True).over(by_line(key))
    marked = outside_fences(lines, key).withColumn("_mark", marker)
    return marked.withColumn("in_details", F.coalesce(last, F.lit(False)) | F.col("_mark").isNotNull()).drop("_mark")


def all_matches(lines: DataFrame, pattern: str, names: Sequence[str], keep: Sequence[str] = ("path", "line_no"),
                column: str = "line", groups: Sequence[int] | None = None) -> DataFrame:
    """One row per match; a plain search drops the other lines first."""
    groups = groups or range(1, len(names) + 1)
    found = [F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in groups]
    hits = lines.filter(F.col(column).rlike(pattern)).select(*keep, F.posexplode(F.arrays_zip(*found)).alias("match_no", "m"))
    return hits.select(*keep, "match_no", *[F.col(f"m.g{g}").alias(n) for g, n in zip(groups, names)])


def first_match(column: Column, patterns: Sequence[tuple[str, int]]) -> Column:
    """Group of the first pattern that matches."""
    return F.coalesce(*[F.nullif(F.regexp_extract(column, p, g), F.lit("")) for p, g in patterns])


def by_domain(path: Column, table: dict[str, Column]) -> Column:
    """Pick an expression by the language domain of a path."""
    domain = X.language_domain(path)
    out = None
    for name, value in table.items():
        out = F.when(domain == name, value) if out is None else out.when(domain == name, value)
    return out


def rebuild(lines: DataFrame, key: str = "page", line: str = "line") -> DataFrame:
    """Text of each file from its lines; null lines vanish."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", F.col(line).alias("t"))))
    kept = lines.filter(F.col(line).isNotNull()).groupBy(key).agg(ordered.alias("ls"))
    return kept.select(key, F.array_join(F.transform("ls", lambda x: x["t"]), "\n").alias("content"))


def capped(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int | None) -> DataFrame:
    """First n rows per group, or all rows without a cap."""
    if n is None:
        return df
    rank = F.row_number().over(W.partitionBy(*group).orderBy(*order))
    return df.withColumn("_rn", rank).filter(F.col("_rn") <= n).drop("_rn")
