"""Facts of Markdown pages: tables, terms, claims, anchors, links and slugs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from codeloom.functions import text as X, vocab
from codeloom.functions.patterns import L, NAME
from codeloom.operators.lines import all_matches, by_line, outside_fences, with_fences

PAGE = ("page", "line_no")


def _is_header(line: Column, after: Column) -> Column:
    t = F.trim(line)
    return F.coalesce(t.startswith("|") & t.endswith("|") & after.rlike(vocab.TABLE_RULE) & after.contains("-"), F.lit(False))


def _marked(lines: DataFrame) -> DataFrame:
    """Lines with fence state, the next line and the current section."""
    order = by_line("page")
    rows = with_fences(lines).withColumn("after", F.lead("line").over(order))
    heading = F.nullif(F.trim(F.regexp_extract("line", r"^#{2,3}\s+(.{1,80})", 1)), F.lit(""))
    return rows.filter(~F.col("is_fence") & ~F.col("in_fence")).withColumn("section", F.coalesce(F.last(heading, ignorenulls=True).over(order), F.lit("")))


def table_rows(lines: DataFrame) -> DataFrame:
    """Header and body rows of every table outside fences: row 0 is the header.

    A table starts at the first line of a block of `|` lines that a rule follows, and ends
    at the next rule or at the end of the block.
    """
    order = by_line("page")
    t = F.trim("line")
    rows = _marked(lines).filter(t.startswith("|"))
    rows = rows.withColumn("block", F.col("line_no") - F.row_number().over(order))
    inner = W.partitionBy("page", "block").orderBy("line_no")
    rows = rows.withColumn("head_at", F.min(F.when(_is_header(F.col("line"), F.col("after")), F.col("line_no"))).over(W.partitionBy("page", "block")))
    rule = t.rlike(r"^\|[\s:|-]+\|?$")
    rows = rows.filter(F.col("line_no") >= F.col("head_at")).withColumn("rules", F.count_if(rule & (F.col("line_no") > F.col("head_at") + 1)).over(inner))
    kept = rows.filter((F.col("rules") == 0) & (F.col("line_no") != F.col("head_at") + 1))
    number = F.when(F.col("line_no") == F.col("head_at"), 0).otherwise(F.col("line_no") - F.col("head_at") - 1)
    return kept.select("page", F.col("head_at").alias("table_line"), number.alias("row_no"), "section", X.table_cells(F.col("line")).alias("cells"), "line_no", "line")


def extract_tables(lines: DataFrame) -> DataFrame:
    """One row per table: section, header and sizes."""
    rows = table_rows(lines)
    head = F.col("row_no") == 0
    first = F.nullif(F.col("cells")[0], F.lit(""))
    return rows.groupBy("page", "table_line").agg(
        F.max(F.when(head, F.col("section"))).alias("section"),
        F.max(F.when(head, F.array_join("cells", "|"))).alias("header"),
        F.count_if(~head).alias("n_rows"), F.countDistinct(F.when(~head, first)).alias("first_values"))


def first_columns(lines: DataFrame) -> DataFrame:
    """Distinct non-empty first cells of every table, with the table's header."""
    rows = table_rows(lines)
    heads = rows.filter("row_no = 0").select("page", "table_line", F.array_join("cells", "|").alias("header"))
    cells = rows.filter("row_no > 0").select("page", "table_line", F.col("cells")[0].alias("value")).filter("value <> ''").distinct()
    return cells.join(heads, ["page", "table_line"])


def _number(cell: Column) -> Column:
    return F.regexp_replace(cell.cast("double").cast("string"), r"\.0$", "")


def numeric_columns(lines: DataFrame, least: int = 5, share: float = 0.8) -> DataFrame:
    """Number sequences of table columns that are numeric enough; other cells close up."""
    rows = table_rows(lines)
    heads = rows.filter("row_no = 0").select("page", "table_line", F.posexplode("cells").alias("col", "header"))
    body = rows.filter("row_no > 0")
    sizes = body.groupBy("page", "table_line").agg(F.count("*").alias("n_rows")).filter(F.col("n_rows") >= least)
    cells = body.select("page", "table_line", "row_no", F.posexplode("cells").alias("col", "cell")).filter(F.col("cell").rlike(r"^\d+(?:\.\d+)?$"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("row_no", "cell"))), lambda x: _number(x["cell"]))
    found = cells.groupBy("page", "table_line", "col").agg(F.count("*").alias("n"), F.array_join(ordered, ",").alias("sequence"))
    kept = found.join(sizes, ["page", "table_line"]).filter((F.col("n") >= least) & (F.col("n") >= F.col("n_rows") * share))
    return kept.join(heads, ["page", "table_line", "col"]).select("page", "table_line", "header", "n", "sequence")


def extract_terms(lines: DataFrame) -> DataFrame:
    """Distinct backtick terms of each page."""
    found = all_matches(outside_fences(lines), r"`([^`\n]{1,60})`", ["term"], keep=PAGE)
    return found.select("page", F.trim("term").alias("term")).filter(F.length("term") >= 2).distinct()


def dep_mentions(terms: DataFrame) -> DataFrame:
    """Terms that look like a package name, with the number of pages."""
    shaped = terms.filter(F.col("term").rlike(r"^(?:@[A-Za-z0-9_.-]+/)?[A-Za-z0-9_][A-Za-z0-9_.-]*$"))
    return shaped.groupBy("term").agg(F.count("*").alias("pages"))


def evidence_anchors(lines: DataFrame) -> DataFrame:
    """Anchors of evidence tables, and commit anchors anywhere."""
    header = _is_header(F.col("line"), F.col("after"))
    rows = _marked(lines).withColumn("is_header", header)
    at = F.array_position(X.table_cells(F.col("line")), vocab.ANCHOR_COLUMN)
    rows = rows.withColumn("col", F.last(F.when(F.col("is_header"), at), ignorenulls=True).over(by_line("page")))
    cells = rows.filter(F.trim("line").startswith("|") & ~F.col("is_header") & (F.col("col") > 0))
    anchor = F.try_element_at(X.table_cells(F.col("line")), F.col("col").cast("int"))
    tabled = cells.select("page", anchor.alias("anchor")).filter(F.col("anchor").contains(":"))
    commits = all_matches(lines, r"(commit:[0-9a-f]{7,40})", ["anchor"], keep=PAGE).select("page", "anchor")
    return tabled.unionByName(commits).distinct()


def page_fingerprints(lines: DataFrame, page_files: DataFrame) -> DataFrame:
    """One row per page with its tables, terms and anchors as nested sets; a page bounds each set."""
    tables = extract_tables(lines).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("table_line", "header", "n_rows"))).alias("tables"))
    def gather(df: DataFrame, column: str, name: str) -> DataFrame:
        return df.groupBy("page").agg(F.array_sort(F.collect_set(column)).alias(name))
    out = lines.select("page").distinct()
    for part in (tables, gather(extract_terms(lines), "term", "terms"), gather(evidence_anchors(lines), "anchor", "anchors"), gather(page_files, "file", "files")):
        out = out.join(part, "page", "left")
    return out


CLAIM = rf"^{NAME}(?:\.{NAME})*$"


def extract_claims(lines: DataFrame) -> DataFrame:
    """Identifier claims in backticks, once per page and span, with the place of the first."""
    found = all_matches(outside_fences(lines), "`([^`]+)`", ["raw"], keep=PAGE)
    chain = F.regexp_replace("raw", r"\(\s*\)$", "")
    shaped = found.withColumn("raw", F.trim("raw")).withColumn("chain", chain)
    shaped = shaped.filter(F.col("chain").rlike(CLAIM)).withColumn("name", F.substring_index("chain", ".", -1))
    words = list(vocab.NON_CLAIM_WORDS)
    kept = shaped.filter((F.length("name") >= 3) & ~F.col("chain").isin(words) & ~F.col("name").isin(words))
    first = kept.groupBy("page", "raw", "chain", "name").agg(F.min(F.struct("line_no", "match_no")).alias("at"))
    return first.select("page", "raw", "chain", "name", "at.line_no", "at.match_no")


def extract_anchors(lines: DataFrame) -> DataFrame:
    """file:line, commit and document anchors outside fences."""
    visible = outside_fences(lines)
    files = all_matches(visible, vocab.ANCHOR, ["path", "target_line"], keep=PAGE).select(*PAGE, F.lit("file").alias("kind"), "path", F.col("target_line").cast("int").alias("target_line"))
    commits = visible.filter(F.col("line").rlike(vocab.COMMIT_ANCHOR)).select(*PAGE, F.lit("commit").alias("kind"), F.regexp_extract("line", vocab.COMMIT_ANCHOR, 0).alias("path"), F.lit(None).cast("int").alias("target_line"))
    docs = all_matches(visible, f"({vocab.DOC_ANCHOR})".replace("(?i)", ""), ["path"], keep=PAGE).select(*PAGE, F.lit("doc").alias("kind"), "path", F.lit(None).cast("int").alias("target_line"))
    return files.unionByName(commits).unionByName(docs)


MD_LINK = r"\[([^\]]*)\]\(([^)\s]+?)(?:#[^)]*)?\)"


def link_class(target: Column) -> Column:
    return (
        F.when(target.startswith("#"), "fragment").when(target.rlike(r"(?i)^(?:[a-z][a-z0-9+.-]*:|//)"), "external")
        .when(target.endswith(".md"), "page").otherwise("other"))


def extract_links(lines: DataFrame) -> DataFrame:
    """Markdown link targets without their fragment."""
    found = all_matches(lines, MD_LINK, ["label", "target"], keep=PAGE)
    return found.select(*PAGE, "label", "target", link_class(F.col("target")).alias("link_class"))


def html_links(pages: DataFrame) -> DataFrame:
    """`href` values of raw pages."""
    hrefs = F.regexp_extract_all("html", F.lit(r"href=\"([^\"]*)\""), F.lit(1))
    found = pages.select("page_id", F.explode(hrefs).alias("target"))
    return found.withColumn("link_class", link_class(F.col("target")))


def heading_slugs(lines: DataFrame, key: str = "page") -> DataFrame:
    title = F.regexp_extract("line", r"^#{1,6}\s+(.+)$", 1)
    return lines.select(key, X.heading_slug(title).alias("slug"), title.alias("t")).filter("t <> ''").select(key, "slug").distinct()


def identifier_universe(rows: DataFrame, column: str) -> DataFrame:
    """Field names and identifier-like values of JSON objects, down to three levels."""
    level = rows.select(F.explode(F.from_json(column, "MAP<STRING,STRING>")).alias("k", "v"))
    out = None
    for depth in range(3):
        keys = level.select(F.col("k").alias("identifier")).filter(F.length("identifier") >= 3)
        values = level.select(F.col("v").alias("identifier")).filter(F.col("identifier").rlike(r"^[A-Za-z_$][A-Za-z0-9_$.-]{2,63}$"))
        both = keys.unionByName(values)
        out = both if out is None else out.unionByName(both)
        if depth < 2:
            level = level.filter(F.col("v").startswith("{")).select(F.explode(F.from_json("v", "MAP<STRING,STRING>")).alias("k", "v"))
    return out.distinct()
