"""Anchors and links of pages checked against files, lines, symbols and planned pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codeloom.functions import text as X, vocab
from codeloom.operators.extract_docs import extract_anchors, extract_links
from codeloom.operators.lines import all_matches, by_line, outside_fences, with_fences
from codeloom.session import fixed_table


def resolve_anchor_files(anchors: DataFrame, files: DataFrame) -> DataFrame:
    """File of each anchor: exact path, else the only file of that base name, else none."""
    exact = files.select("path", F.col("path").alias("exact"))
    bases = files.groupBy(X.basename(F.col("path")).alias("base")).agg(F.count("*").alias("n"), F.min("path").alias("only"))
    single = bases.filter("n = 1").select(F.col("base").alias("path"), "only")
    return anchors.join(exact, "path", "left").join(single, "path", "left").withColumn("resolved", F.coalesce("exact", "only")).drop("exact", "only")


def anchor_line_check(anchors: DataFrame, lines: DataFrame) -> DataFrame:
    """State of resolved anchors: broken (line 0), unknown file, out-of-range, comment or usage."""
    placed = lines.select(F.col("path").alias("resolved"), F.col("line_no").alias("target_line"), F.col("line").alias("target"))
    joined = anchors.join(placed, ["resolved", "target_line"], "left")
    state = (
        F.when(F.col("target_line") == 0, "broken").when(F.col("resolved").isNull(), "unknown")
        .when(F.col("target").isNull(), "out-of-range").when(X.is_comment_line(F.col("target"), F.col("resolved")), "comment").otherwise("usage"))
    return joined.withColumn("state", state)


def anchor_symbol_mismatch(anchors: DataFrame, page_lines: DataFrame, lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """Anchors whose line shows no name of their page line, though the name is defined elsewhere only."""
    names = all_matches(outside_fences(page_lines), r"`([A-Za-z_$][A-Za-z0-9_$]*(?:\.[A-Za-z_$][A-Za-z0-9_$]*)*)`", ["raw"], keep=("page", "line_no"))
    names = names.select("page", "line_no", F.substring_index("raw", ".", -1).alias("name")).distinct()
    checked = anchor_line_check(anchors.filter("resolved IS NOT NULL AND target_line > 0"), lines).filter("target IS NOT NULL")
    pairs = checked.select("page", "line_no", "path", "target_line", "resolved", "target").distinct().join(names, ["page", "line_no"])
    absent = pairs.filter(~F.col("target").contains(F.col("name")))
    defined = symbols.select("name", F.col("file").alias("resolved")).distinct()
    elsewhere = absent.join(defined.select("name").distinct(), "name", "left_semi").join(defined, ["name", "resolved"], "left_anti")
    return elsewhere.select("page", "line_no", "name", "path", "target_line").distinct()


def doc_anchor_check(anchors: DataFrame, slugs: DataFrame) -> DataFrame:
    """Document anchors whose heading is absent; only documents with known slugs are judged."""
    parts = anchors.filter("kind = 'doc'").select("page", F.col("path").alias("anchor"), F.substring_index("path", "#", 1).alias("doc"), F.expr("substr(path, instr(path, '#') + 1)").alias("slug"))
    known = slugs.select("doc").distinct()
    judged = parts.join(known, "doc", "left_semi").distinct()
    return _without_slug(judged, slugs, ["doc"])


def _without_slug(judged: DataFrame, slugs: DataFrame, keys: list[str]) -> DataFrame:
    left = judged.join(slugs.select(*keys, "slug"), [*keys, "slug"], "left_anti")
    decoded = left.withColumn("raw", F.col("slug")).withColumn("slug", F.coalesce(F.try_url_decode("slug"), F.col("slug")))
    return decoded.join(slugs.select(*keys, "slug"), [*keys, "slug"], "left_anti").drop("slug").withColumnRenamed("raw", "slug")


def fragment_check(lines: DataFrame, slugs: DataFrame) -> DataFrame:
    """In-page fragment links whose heading is absent."""
    found = all_matches(lines, r"\]\(#([^)]+)\)", ["slug"], keep=("page", "line_no")).select("page", "slug").distinct()
    return _without_slug(found, slugs, ["page"])


def resolved_path(base: Column, target: Column) -> Column:
    """Path of a relative target seen from a page; `..` beyond the root stays."""
    parts = F.filter(F.split(F.concat_ws("/", F.nullif(X.dirname(base), F.lit("")), target), "/"), lambda s: (s != "") & (s != "."))
    up = lambda acc: (F.size(acc) > 0) & (F.element_at(acc, -1) != "..")
    folded = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, s: F.when(s != "..", F.concat(acc, F.array(s))).when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != ".."), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))))
    return F.array_join(folded, "/")


def dead_links(lines: DataFrame, page_paths: DataFrame, planned: DataFrame, files: DataFrame) -> DataFrame:
    """Relative page links that lead neither to a planned page nor to a known file."""
    links = extract_links(lines).filter("link_class = 'page'").select("page", "target").distinct()
    seen = links.join(page_paths.select("page", "rel_path"), "page").withColumn("resolved", resolved_path(F.col("rel_path"), F.col("target")))
    keys = seen.select("page", "target", F.explode(F.array_distinct(F.array("resolved", "target", F.regexp_replace("resolved", r"^(?:\.\./)+", "")))).alias("key"), "resolved")
    alive = keys.join(files.select(F.col("path").alias("key")), "key", "left_semi").select("page", "target")
    reached = seen.join(planned.select(F.col("rel_path").alias("resolved")), "resolved", "left_semi").select("page", "target")
    return seen.select("page", "target", "resolved").join(alive.union(reached).distinct(), ["page", "target"], "left_anti")


def ghost_candidates(planned: DataFrame) -> Column:
    """Registered page names that are not planned, as one array (the registry bounds it)."""
    spark = planned.sparkSession
    registry = fixed_table(spark, "base", [(f"{n}.md",) for n, _, _, _ in vocab.PAGE_REGISTRY])
    ghosts = registry.join(planned.select(X.basename(F.col("rel_path")).alias("base")), "base", "left_anti")
    return ghosts.agg(F.array_sort(F.collect_set("base")).alias("g")).select("g").scalar()


GHOST_LINK = r"\[([^\]]+)\]\(([^)\s]+\.md)\)"


def ghost_links(lines: DataFrame, planned: DataFrame) -> DataFrame:
    """Lines with links to registered but unplanned pages turned into their labels."""
    ghosts = ghost_candidates(planned)
    marked = lines.filter(F.col("line").rlike(GHOST_LINK)).select("page", "line_no", "line", F.regexp_extract_all("line", F.lit(f"({GHOST_LINK})"), F.lit(1)).alias("links"), ghosts.alias("ghosts"))
    target = lambda m: F.regexp_extract(m, GHOST_LINK, 2)
    ghost = lambda m: F.array_contains("ghosts", X.basename(target(m))) & ~target(m).startswith("../") & ~target(m).rlike("(?i)^[a-z]+://")
    hit = marked.withColumn("hits", F.filter("links", ghost)).filter(F.size("hits") > 0)
    out = F.aggregate("hits", F.col("line"), lambda acc, m: F.replace(acc, m, F.regexp_extract(m, GHOST_LINK, 1)))
    return hit.select("page", "line_no", out.alias("line"), F.size("hits").alias("stripped"))


ANY_LINK = r"\[[^\]]+\]\(([^)\s]+)\)"


def repo_link_rewrite(lines: DataFrame, page_paths: DataFrame, files: DataFrame) -> DataFrame:
    """Lines whose links to repository files got the prefix that leads out of the page's directory."""
    links = all_matches(lines, ANY_LINK, ["target"], keep=("page", "line_no"))
    odd = F.col("target").startswith("../") | F.col("target").startswith("#") | F.col("target").rlike("(?i)^[a-z]+://") | F.col("target").endswith(".md")
    real = links.filter(~odd).join(files.select(F.col("path").alias("target")), "target", "left_semi")
    # links of one line
    per_line = real.groupBy("page", "line_no").agg(F.array_sort(F.collect_set("target")).alias("targets"), F.count("*").alias("fixed"))
    depth = page_paths.select("page", F.repeat(F.lit("../"), F.size(F.split("rel_path", "/"))).alias("prefix"))
    rows = lines.join(per_line, ["page", "line_no"]).join(depth, "page")
    out = F.aggregate("targets", F.col("line"), lambda acc, t: F.replace(acc, F.concat(F.lit("]("), t, F.lit(")")), F.concat(F.lit("]("), F.col("prefix"), t, F.lit(")"))))
    return rows.select("page", "line_no", out.alias("line"), "fixed")


def mermaid_lines(lines: DataFrame) -> DataFrame:
    """Lines inside mermaid fences."""
    opened = F.when(F.col("is_fence"), F.col("line").rlike(r"```mermaid\s*$"))
    rows = with_fences(lines).withColumn("mermaid", F.last(opened, ignorenulls=True).over(by_line("page")))
    return rows.filter("in_fence AND NOT is_fence AND mermaid").select("page", "line_no", "line")


def mermaid_ghosts(lines: DataFrame, files: DataFrame) -> DataFrame:
    """File names in mermaid blocks that no known file has."""
    pattern = r"(?<![A-Za-z0-9_])((?:[A-Za-z0-9_.@-]+/)*[A-Za-z0-9_.@-]+\.(?:ts|tsx|js|jsx|mjs|cjs|cts|mts|py|go|java|rs|rb|php|cs|swift|kt|sql))(?![A-Za-z0-9_])"
    named = all_matches(mermaid_lines(lines), pattern, ["file"], keep=("page", "line_no"))
    return named.join(files.select(F.col("path").alias("file")), "file", "left_anti").select("page", "line_no", "file")


def file_anchors(lines: DataFrame, files: DataFrame) -> DataFrame:
    """file:line anchors of pages with the file they resolve to."""
    return resolve_anchor_files(extract_anchors(lines).filter("kind = 'file'"), files)


def anchor_stats(checked: DataFrame) -> DataFrame:
    """Anchor counters per page."""
    state = F.col("state")
    return checked.groupBy("page").agg(
        F.count("*").alias("total"), F.count_if(state.isin("out-of-range", "comment", "usage")).alias("valid"),
        F.count_if(state == "out-of-range").alias("out_of_range"), F.count_if(state == "comment").alias("comment"), F.count_if(state == "usage").alias("usage"))
