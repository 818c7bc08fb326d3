"""Comments, documents and tests mined for the reasons behind code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from codeloom.functions import patterns as P, text as X, vocab
from codeloom.operators.lines import by_domain, by_line, capped

SCHEMA = ("kind", "file", "line_no", "symbol", "text", "anchor")


def _evidence(df: DataFrame, kind: str, text: Column, symbol: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(
        F.lit(kind).alias("kind"), F.col("path").alias("file"), "line_no", (none if symbol is None else symbol).alias("symbol"),
        text.alias("text"), F.concat_ws(":", "path", "line_no").alias("anchor"))


def _clean(text: Column) -> Column:
    return X.redact(X.clean_comment(text))


def file_headers(lines: DataFrame) -> DataFrame:
    """Text of the first comment run of each file, when it says more than the file name."""
    t = F.trim("line")
    order = by_line("path")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    quoted = t.startswith('"""') | t.startswith("'''")
    shebang = t.startswith("#!")
    comment = t.startswith("//") | t.startswith("/*") | t.startswith("*") | t.startswith("#")
    rows = lines.withColumn("t", t).withColumn("doc", F.max(quoted).over(order))
    inner = F.regexp_replace(F.regexp_replace("t", r"^['\"]{0,3}", ""), r"['\"]{0,3}$", "")
    body = X.comment_body(F.col("line"))
    legal = F.trim(body).rlike("(?i)^(copyright|licensed|spdx|@license)")
    kept = F.when((F.col("t") == "") | shebang, F.lit(None).cast("string")).when(
        F.col("doc"), F.when(F.trim(inner) != "", inner)).when(comment & ~legal, body)
    rows = rows.withColumn("kept", kept)
    rows = rows.withColumn("started", F.coalesce(F.max(F.col("kept").isNotNull()).over(before), F.lit(False)))
    closes = (quoted & (F.expr("locate(left(t, 3), t, 4)") > 0)) | (~F.col("doc") & t.startswith("/*") & t.contains("*/"))
    stop = ((F.col("t") == "") & F.col("started")) | (~F.col("doc") & (F.col("t") != "") & ~shebang & ~comment) | F.coalesce(F.lag(closes).over(order), F.lit(False))
    rows = rows.withColumn("stop", stop)
    head = rows.withColumn("stopped", F.max("stop").over(order)).filter(~F.col("stopped") & F.col("kept").isNotNull())
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "kept"))), lambda x: x["kept"]), " ")
    texts = head.groupBy("path").agg(joined.alias("raw")).withColumn("text", _clean(F.col("raw"))).withColumn("line_no", F.lit(1))
    real = (F.length("text") >= 12) & (F.col("text") != F.col("path")) & ~F.col("text").endswith(X.basename(F.col("path")))
    return _evidence(texts.filter(real), "file-header", F.col("text"))


def comment_evidence(lines: DataFrame, symbol_cap: int | None = None, marker_cap: int | None = None) -> DataFrame:
    """File headers, symbol comments, why-markers and constant comments of production code."""
    code = lines.filter(~X.is_test_path(F.col("path")) & X.language_domain(F.col("path")).isNotNull())
    order = by_line("path")
    body = X.comment_body(F.col("line"))
    prev = [F.lag("c", k).over(order) for k in (1, 2, 3)]
    rows = code.withColumn("c", body).withColumn("c1", prev[0]).withColumn("c2", prev[1]).withColumn("c3", prev[2])
    defined = by_domain(F.col("path"), {d: F.regexp_extract("line", p, 1) for d, p in P.TOPLEVEL.items()})
    above = F.when(F.col("c2").isNull(), F.col("c1")).when(F.col("c3").isNull(), F.concat_ws(" ", "c2", "c1")).otherwise(F.concat_ws(" ", "c3", "c2", "c1"))
    mark = F.regexp_extract("c", P.WHY_MARKER, 1)
    said = F.concat(mark, F.lit(": "), F.regexp_extract("c", P.WHY_MARKER, 2))
    native = by_domain(F.col("path"), {d: F.regexp_extract("line", p, 1) for d, p in P.NATIVE_CONSTANT.items()})
    const = F.coalesce(native, F.regexp_extract("line", P.COMMENTED_CONSTANT, 1))
    inline = F.nullif(F.regexp_extract("line", r"(?://|#)\s*(.+)$", 1), F.lit(""))

    def found(kind: str, when: Column, symbol: Column, raw: Column, least: int) -> Column:
        text = _clean(raw)
        return F.struct(F.lit(kind).alias("kind"), symbol.alias("symbol"), F.when(when & (F.length(text) >= least), text).alias("text"))

    # one pass: every line gives its kinds as an array
    each = rows.select("path", "line_no", F.inline(F.array(
        found("symbol-comment", F.col("c1").isNotNull() & (defined != ""), defined, above, 8),
        found("why-marker", F.col("c").isNotNull() & (mark != ""), F.lit(None).cast("string"), said, 6),
        found("const-comment", const != "", const, F.coalesce(inline, F.nullif("c1", F.lit(""))), 4)))).filter("text IS NOT NULL")
    for kind, cap in (("symbol-comment", symbol_cap), ("why-marker", marker_cap)):
        if cap is not None:
            each = each.filter(F.col("kind") != kind).unionByName(capped(each.filter(F.col("kind") == kind), ["path"], [F.col("line_no")], cap))
    placed = each.select("kind", F.col("path").alias("file"), "line_no", "symbol", "text", F.concat_ws(":", "path", "line_no").alias("anchor"))
    return file_headers(code).unionByName(placed)


def doc_sections(lines: DataFrame, key: str = "page", caps: tuple[int, int] | None = None) -> DataFrame:
    """Heading and first paragraph of every section down to level three.

    A heading of a deeper level neither ends the search nor gives text; the next heading
    of the same or a higher level ends it.
    """
    level = F.length(F.regexp_extract("line", r"^(#{1,3})\s", 1))
    titled = F.regexp_extract("line", r"^#{1,3}\s+(.{1,80})", 1)
    rows = lines.select(F.col(key).alias("path"), "line_no", F.trim("line").alias("t"), level.alias("level"), F.trim(titled).alias("title"))
    order = by_line("path")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    # paragraphs: runs of body lines; a heading does not break a run, a blank line does
    text = (F.col("t") != "") & (F.col("level") == 0)
    blank = (F.col("t") == "") & (F.col("level") == 0)
    rows = rows.withColumn("para", F.count_if(blank).over(order)).withColumn("is_text", text)
    heads = rows.filter((F.col("level") > 0) & (F.col("title") != "")).select("path", "line_no", "level", "title")
    nexts = rows.filter("level > 0")
    # end of each section: first later heading of the same or a higher level
    ends = None
    for lv in (1, 2, 3):
        later = F.min(F.when((F.col("level") > 0) & (F.col("level") <= lv), F.col("line_no"))).over(order.rowsBetween(1, W.unboundedFollowing))
        part = rows.withColumn("end", later).withColumn("next_text", F.min(F.when(F.col("is_text"), F.struct("line_no", "para"))).over(order.rowsBetween(1, W.unboundedFollowing)))
        part = part.filter((F.col("level") == lv) & (F.col("title") != ""))
        part = part.select("path", "line_no", "title", "end", "next_text")
        ends = part if ends is None else ends.unionByName(part)
    opened = ends.filter("next_text IS NOT NULL AND (end IS NULL OR next_text.line_no < end)").select(
        "path", "line_no", "title", "end", F.col("next_text.para").alias("para"), F.col("next_text.line_no").alias("from_line"))
    body = rows.filter("is_text").select("path", "para", F.col("line_no").alias("at"), "t")
    joined = opened.join(body, ["path", "para"]).filter("at >= from_line AND (end IS NULL OR at < end)")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "t"))), lambda x: x["t"]), " ")
    out = joined.groupBy("path", "line_no", "title").agg(F.rtrim(F.substring(text, 1, 200)).alias("excerpt")).filter(F.length("excerpt") >= 10)
    if caps:
        design = F.col("path").rlike("(?i)adr|decision|design|spec|rfc|plan")
        rank = F.row_number().over(W.partitionBy("path").orderBy("line_no"))
        out = out.withColumn("rn", rank).filter(F.col("rn") <= F.when(design, caps[0]).otherwise(caps[1]))
    return out.select(
        F.col("path").alias("file"), "line_no", F.concat("title", F.lit("："), "excerpt").alias("text"),
        F.concat("path", F.lit("#"), X.heading_slug(F.col("title"))).alias("anchor"))


def readme_prereqs(lines: DataFrame, key: str = "page", cap: int | None = None, first_lines: int | None = None, chars: int | None = None) -> DataFrame:
    """Text of the sections about installing and requirements."""
    title = F.trim(F.regexp_extract("line", r"^#{1,4}\s+(.+)$", 1))
    order = W.partitionBy(key).orderBy("line_no")
    rows = lines.withColumn("title", F.nullif(title, F.lit(""))).withColumn("section", F.count("title").over(order)).filter("section > 0")
    heads = rows.filter("title IS NOT NULL").select(key, "section", "title").filter(F.col("title").rlike(vocab.PREREQ_HEADING))
    inside = rows.filter("title IS NULL").join(heads.select(key, "section"), [key, "section"], "left_semi")
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    body = F.regexp_replace(parts, r"^\s+|\s+$", "")
    text = body if first_lines is None else F.array_join(F.slice(F.split(body, "\n"), 1, first_lines), "\n")
    text = text if chars is None else F.substring(text, 1, chars)
    texts = inside.groupBy(key, "section").agg(text.alias("text")).filter("text <> ''")
    found = heads.join(texts, [key, "section"])
    return capped(found, [key], [F.col("section")], cap).select(key, "title", "text")


def doc_titles(lines: DataFrame, key: str = "page", within: int | None = None) -> DataFrame:
    title = F.trim(F.regexp_extract("line", r"^#\s+(.{1,80})", 1))
    found = (lines if within is None else lines.filter(F.col("line_no") <= within)).withColumn("title", title).filter("title <> ''")
    return found.groupBy(key).agg(F.min_by("title", "line_no").alias("title"))


def excerpt(texts: DataFrame, n: int, column: str = "text") -> DataFrame:
    """First n characters, cut at the last blank line or heading beyond the middle."""
    cut = F.substring(F.col(column), 1, n)
    def last_at(mark: str) -> Column:
        at = F.locate(mark[::-1], F.reverse(cut))
        return F.when(at > 0, F.length(cut) - at - len(mark) + 1).otherwise(-1)
    at = F.greatest(last_at("\n\n"), last_at("\n#"))
    kept = F.when(at > n * 0.5, F.substr(cut, F.lit(1), at)).otherwise(cut)
    short = F.length(column) <= n
    return texts.withColumn("excerpt", F.when(short, F.col(column)).otherwise(F.concat(F.regexp_replace(kept, r"\s+$", ""), F.lit("\n\n（已截断）"))))


def dedupe_by_anchor(evidence: DataFrame, order: list[str]) -> DataFrame:
    """First row per (kind, anchor)."""
    rank = F.row_number().over(W.partitionBy("kind", "anchor").orderBy(*order))
    return evidence.withColumn("_rn", rank).filter("_rn = 1").drop("_rn")


def intent_counts(evidence: DataFrame, page: str = "page") -> DataFrame:
    return evidence.groupBy(page, "kind").agg(F.count("*").alias("n"))


def why_marker_sample(evidence: DataFrame, n: int) -> DataFrame:
    return evidence.filter("kind = 'why-marker'").orderBy("file", "line_no").limit(n)
