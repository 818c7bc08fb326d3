"""Page text rewritten at table scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from codeloom.functions import text as X, vocab

from codeloom.operators.extract_docs import table_rows
from codeloom.operators.lines import all_matches, by_line, with_details, with_fences

MARKER = r"<!--\s*wiki:pending:(claim|cell|note|prose):([A-Za-z0-9_-]+)\s*-->"
NOTE = r"^>\s*⚠️\s*\*\*待确认\*\*：(.*)$"
STRUCTURE = r"(?m)^[ \t]*(?:#{1,6}\s|\||->|>|```|-\s|\d+\.\s)"


def encode_identity(text: Column) -> Column:
    """base64url without padding, of the first 180 characters."""
    raw = F.base64(F.encode(F.substring(text, 1, 180), "UTF-8"))
    return F.translate(F.regexp_replace(raw, r"[=\r\n]", ""), "+/", "-_")


def decode_identity(code: Column) -> Column:
    plain = F.translate(code, "-_", "+/")
    padded = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("="))
    return F.decode(F.unbase64(padded), "UTF-8")


def pending_marker(kind: str, identity: Column) -> Column:
    return F.concat(F.lit(f"<!-- wiki:pending:{kind}:"), encode_identity(identity), F.lit(" -->"))


def sanitize_pages(pages: DataFrame, column: str = "content") -> DataFrame:
    """Drop a greeting before the first structural line, unwrap a whole-page fence, join broken table rows, replace filler cells."""
    start = F.regexp_instr(F.col("_t"), F.lit(STRUCTURE))
    first_line = F.substring_index("_t", "\n", 1)
    head = F.trim(F.regexp_replace(F.left("_t", F.greatest(start - 1, F.lit(0))), r"\s+", " "))
    rest = F.when(F.locate("\n", F.col("_t")) > 0, F.substr(F.col("_t"), F.locate("\n", F.col("_t")) + 1)).otherwise("")
    inside_first = (start == 0) | (F.locate("\n", F.left("_t", F.greatest(start - 1, F.lit(0)))) == 0)
    cut = (
        F.when(inside_first & F.trim(first_line).rlike(vocab.PREAMBLE), F.regexp_replace(rest, r"^\s*\n", ""))
        .when(~inside_first & head.rlike(vocab.PREAMBLE), F.substr(F.col("_t"), start)).otherwise(F.col("_t")))
    out = pages.withColumn("_t", F.col(column)).withColumn("_t", cut)
    fence = r"^\s*```(?:markdown|md)?\s*\n([\s\S]*?)\n```\s*$"
    out = out.withColumn("_t", F.when(F.col("_t").rlike(fence), F.regexp_extract("_t", fence, 1)).otherwise(F.col("_t")))
    broken = r"(?m)^([ \t]*\|[^\n|]+\|[ \t]*)\n(?:[ \t]*\n)*(?![ \t]*(?:\||#{1,6}\s|[-*]\s|```))[ \t]*(?=[^\n]*\|)(\S[^\n]*?)[ \t]*$"
    out = out.withColumn("_t", F.regexp_replace("_t", broken, "$1 $2"))
    out = out.withColumn("_t", F.regexp_replace(F.regexp_replace("_t", "数据未提供（[^）\n]*）", "—"), r"^\s+|\s+$", ""))
    return out.withColumn("changed", F.col("_t") != F.col(column)).withColumn(column, F.col("_t")).drop("_t")


def annotate_claims(lines: DataFrame, bad: DataFrame) -> DataFrame:
    """Lines with a pending marker after each unverified span; `bad` has page and raw."""
    spans = all_matches(lines, "`([^`]+)`", ["raw"], keep=("page", "line_no"))
    hits = spans.join(bad.select("page", "raw").distinct(), ["page", "raw"], "left_semi")
    per_line = hits.groupBy("page", "line_no").agg(F.array_sort(F.collect_set("raw")).alias("raws"))
    tick = lambda r: F.concat(F.lit("`"), r, F.lit("`"))
    marked = F.aggregate("raws", F.col("line"), lambda acc, r: F.replace(acc, tick(r), F.concat(tick(r), F.lit("（待确认）"), pending_marker("claim", r))))
    return lines.join(per_line, ["page", "line_no"], "left").select("page", "line_no", F.when(F.col("raws").isNotNull(), marked).otherwise(F.col("line")).alias("line"))


def strip_markers(lines: DataFrame) -> DataFrame:
    return lines.withColumn("line", F.regexp_replace("line", MARKER, ""))


def list_markers(lines: DataFrame) -> DataFrame:
    found = all_matches(lines, MARKER, ["kind", "code"], keep=("page", "line_no"))
    return found.select("page", "line_no", "match_no", "kind", decode_identity(F.col("code")).alias("identity"))


RULE = r"^\s*\|[\s:|-]*\|?\s*$"


def _with_table_header(lines: DataFrame) -> DataFrame:
    """Open lines with the trimmed text of the latest table header (a `|` line before a rule)."""
    order = by_line("page")
    rows = with_fences(lines).withColumn("after", F.lead("line").over(order)).filter("NOT is_fence AND NOT in_fence")
    header = F.trim("line").startswith("|") & F.col("after").rlike(RULE) & ~F.col("line").rlike(RULE)
    return rows.withColumn("header", F.coalesce(F.last(F.when(header, F.trim("line")), ignorenulls=True).over(order), F.lit("")))


def _cell_label(line: Column, header: Column) -> Column:
    first = F.trim(F.coalesce(F.try_element_at(F.split(line, r"\|"), F.lit(2)), F.lit("")))
    col = F.when(first != "", first).otherwise(F.substring(F.trim(line), 1, 40))
    head = F.trim(F.regexp_replace(header, r"^\||\|$", ""))
    return F.when(head != "", F.concat(head, F.lit(" · "), col)).otherwise(col)


def pending_items(lines: DataFrame) -> DataFrame:
    """Every pending item: claims by marker, notes by form, cells by table label, prose by its line."""
    open_rows = with_details(lines).filter("NOT in_details").select("page", "line_no", F.lit(True).alias("_o"))
    rows = _with_table_header(lines).join(open_rows, ["page", "line_no"], "left_semi")
    found = F.arrays_zip(F.regexp_extract_all("line", F.lit(MARKER), F.lit(1)).alias("k"), F.regexp_extract_all("line", F.lit(MARKER), F.lit(2)).alias("c"))
    marks = F.transform(found, lambda m: F.struct(m["k"].alias("kind"), decode_identity(m["c"]).alias("text")))
    rows = rows.filter(F.col("line").contains(vocab.UNCONFIRMED) | F.col("line").contains("wiki:pending")).withColumn("marks", marks)
    table = F.trim("line").startswith("|")
    item = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    claims = F.filter("marks", lambda m: (m["kind"] == "claim") & (m["text"] != ""))
    noted = F.col("line").rlike(NOTE)
    told = F.try_element_at(F.filter("marks", lambda m: m["kind"] == "note"), F.lit(1))["text"]
    plain = F.trim(F.regexp_extract(F.regexp_extract("line", NOTE, 1), "^(.*?)(?:（证据不足.*)?$", 1))
    matched = (F.size(claims) > 0) | noted
    none = F.array().cast("array<struct<kind:string,text:string>>")
    other = (
        F.when(~matched & table & F.col("line").contains(vocab.UNCONFIRMED_CELL), F.array(item("cell", _cell_label(F.col("line"), F.col("header")))))
        .when(~matched & ~table & F.col("line").contains(vocab.UNCONFIRMED), F.array(item("prose", F.substring(F.trim("line"), 1, 60)))).otherwise(none))
    all_items = F.concat(claims, F.when(noted, F.array(item("note", F.coalesce(told, plain)))).otherwise(none), other)
    return rows.select("page", "line_no", "line", F.inline(all_items))


def collect_pending(lines: DataFrame) -> DataFrame:
    """Pending items over all pages by kind and text, with counts and the first place."""
    items = pending_items(lines)
    out = items.groupBy("kind", "text").agg(
        F.count("*").alias("occurrences"), F.countDistinct("page").alias("pages"), F.min(F.struct("page", "line_no", "line")).alias("first"))
    return out.select("kind", "text", "occurrences", "pages", F.col("first.page").alias("first_page"), F.substring(F.trim("first.line"), 1, 120).alias("context"))


def has_secret(text: Column) -> Column:
    out = F.lit(False)
    for _, pattern in vocab.SECRET_PATTERNS:
        out = out | text.rlike(X.ascii_edges(pattern))
    return out


def is_safe(replacement: Column) -> Column:
    """A replacement without comments, secrets or odd backticks, of at most 600 characters."""
    return (
        ~replacement.contains("<!--") & ~has_secret(replacement) & (F.regexp_count(replacement, F.lit("`")) % 2 == 0) & (F.length(replacement) <= 600))


def apply_decisions(lines: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rewrite lines by decisions [kind, text, action, replacement]; unsafe replacements keep the line; null lines vanish."""
    resolved = decisions.filter("action = 'resolve'").select("kind", "text", F.trim(F.coalesce("replacement", F.lit(""))).alias("repl"))
    resolved = resolved.withColumn("safe", is_safe(F.col("repl")))
    keyed = pending_items(lines).select("page", "line_no", "kind", "text").distinct().join(resolved, ["kind", "text"])
    per_line = keyed.groupBy("page", "line_no").agg(F.array_sort(F.collect_list(F.struct("kind", "text", "repl", "safe"))).alias("ds"))
    rows = lines.join(per_line, ["page", "line_no"], "left")
    of = lambda kind: F.filter("ds", lambda x: x["kind"] == kind)
    one = lambda kind: F.try_element_at(of(kind), F.lit(1))
    tick = lambda r: F.concat(F.lit("`"), r, F.lit("`"))
    claims = F.aggregate(of("claim"), F.col("line"), lambda acc, x: F.replace(acc, F.concat(tick(x["text"]), F.lit("（待确认）"), pending_marker("claim", x["text"])), tick(x["text"])))
    note, cell, prose = one("note"), one("cell"), one("prose")
    line = F.col("line")
    out = (
        F.when(F.col("ds").isNull(), line).when(F.size(of("claim")) > 0, claims)
        .when(note.isNotNull(), F.when(note["repl"] == "", F.lit(None).cast("string")).when(note["safe"], F.concat(F.lit("> ✅ "), note["repl"])).otherwise(line))
        .when(cell.isNotNull(), F.when(cell["repl"] == "", F.replace(line, F.lit(vocab.UNCONFIRMED_CELL), F.lit("已确认"))).when(cell["safe"], F.replace(line, F.lit(vocab.UNCONFIRMED_CELL), cell["repl"])).otherwise(line))
        .when(prose.isNotNull() & (prose["repl"] != "") & prose["safe"], prose["repl"]).otherwise(line))
    return rows.select("page", "line_no", out.alias("line")).filter("line IS NOT NULL")


FOLD_NOTE = "> 设计依据（意图证据）与 architecture.md 高度重合，已折叠；完整证据表见 [architecture.md](../02-architecture/architecture.md)。"


def intent_tables(lines: DataFrame) -> DataFrame:
    """Anchors of every evidence table with the table's first and last line."""
    rows = table_rows(lines)
    heads = rows.filter((F.col("row_no") == 0) & (F.array_join("cells", "|") == "|".join(vocab.INTENT_HEADER))).select("page", "table_line")
    mine = rows.join(heads, ["page", "table_line"], "left_semi")
    anchor = F.when(F.col("row_no") > 0, F.try_element_at("cells", F.lit(4)))
    return mine.select("page", "table_line", "line_no", F.when(anchor.contains(":"), anchor).alias("anchor"))


def fold_tables(lines: DataFrame, keep: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Replace evidence tables whose anchors `keep` [page, anchor] mostly holds by one note per page."""
    tables = intent_tables(lines)
    own = tables.filter("anchor IS NOT NULL").select("page", "table_line", "anchor").distinct()
    hit = own.join(keep.select("page", "anchor", F.lit(1).alias("hit")).distinct(), ["page", "anchor"], "left")
    folded = hit.groupBy("page", "table_line").agg((F.count("hit") / F.count("*")).alias("share")).filter(F.col("share") >= threshold)
    spans = tables.groupBy("page", "table_line").agg(F.max("line_no").alias("last_line")).join(folded, ["page", "table_line"], "left_semi")
    dropped = spans.select("page", F.explode(F.sequence("table_line", F.greatest("last_line", F.col("table_line") + 1))).alias("line_no"))
    notes = spans.groupBy("page").agg(F.min("table_line").alias("line_no")).select("page", "line_no", F.lit(FOLD_NOTE).alias("line"))
    return lines.select("page", "line_no", "line").join(dropped, ["page", "line_no"], "left_anti").unionByName(notes)


def demote_page(pages: DataFrame, stats: DataFrame) -> DataFrame:
    """Replace the body of pages that have `stats` by a summary and a link."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    body = F.concat(
        F.lit("# 数据流（摘要）\n\n> 本页检测到与 calls.md 的边表重复，已降级为数据形态摘要；完整控制流与调用可达性见 [calls.md](calls.md)。\n\n## 数据形态覆盖\n\n- 数据阶段："), n("stages"),
        F.lit(" 个（有确定类型形态 "), n("typed_stages"), F.lit("，无形态证据 "), n("unknown_stages"), F.lit("）\n- 转换边："), n("transitions"), F.lit(" 条，其中带数据证据 "), n("data_bearing"),
        F.lit(" 条（纯控制流 "), n("control_only"), F.lit(" 条不在此展开）\n- I/O 边界事件："), n("io_events"), F.lit(" 个；本地类型定义："), n("type_definitions"), F.lit(" 个\n"))
    joined = pages.join(stats, "page", "left")
    return joined.select("page", F.when(F.col("stages").isNotNull(), body).otherwise(F.col("content")).alias("content"))


def inject_evidence(pages: DataFrame, files: DataFrame) -> DataFrame:
    """Evidence block after the first level-one heading, else on top; pages that have one stay as they are.

    `files` have page, rank and file, at most a handful per page.
    """
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "file"))), lambda x: F.concat(F.lit("- "), x["file"])), "\n")
    blocks = files.groupBy("page").agg(F.concat(F.lit(f"<details>\n<summary>{vocab.SUMMARY}</summary>\n\n"), listed, F.lit("\n</details>")).alias("block"))
    joined = pages.join(blocks, "page", "left")
    done = F.col("block").isNull() | F.col("content").contains(f"<summary>{vocab.SUMMARY}</summary>")
    at = F.regexp_instr("content", F.lit(r"(?m)^#\s[^\n]*$"))
    title_end = at + F.length(F.regexp_extract("content", r"(?m)^(#\s[^\n]*)$", 1)) - 1
    placed = F.concat(F.left("content", title_end), F.lit("\n\n"), F.col("block"), F.substr("content", title_end + 1))
    out = F.when(done, F.col("content")).when(at > 0, placed).otherwise(F.concat("block", F.lit("\n\n"), "content"))
    return joined.select("page", out.alias("content"))


FRESH = r"(?m)^> 本 Wiki 基于 commit `[0-9a-z]*`(?:（无 git）)?（\d{4}-\d{2}-\d{2}）生成.*$"


def stamp_freshness(pages: DataFrame, head: str, date: str, index: str = "readme") -> DataFrame:
    """Insert or refresh the generated-at line under the title of the index page."""
    head8 = head[:8]
    stamp = f"> 本 Wiki 基于 commit `{head8}`{'' if head8 else '（无 git）'}（{date}）生成；代码演进后请重新构建以保证内容与实现一致。"
    title = r"(?m)^(# [^\n]*)$"
    at = F.regexp_instr("content", F.lit(title))
    end = at + F.length(F.regexp_extract("content", title, 1)) - 1
    fresh = F.concat(F.left("content", end), F.lit("\n\n" + stamp), F.substr("content", end + 1))
    stale = F.regexp_instr("content", F.lit(FRESH))
    old = F.length(F.regexp_extract("content", f"({FRESH})".replace("((?m)", "(?m)("), 1))
    again = F.concat(F.left("content", stale - 1), F.lit(stamp), F.substr("content", stale + old))
    out = F.when(F.col("page") != index, F.col("content")).when(stale > 0, again).when(at > 0, fresh).otherwise(F.concat(F.lit("\n" + stamp + "\n"), "content"))
    return pages.withColumn("content", out)


def safe_cut(texts: DataFrame, key: str, column: str = "text", least: int = 200) -> DataFrame:
    """Longest safe prefix of a truncated text: through the last whole table row, else the last blank line outside fences."""
    lines = texts.select(F.col(key).alias("page"), F.posexplode(F.split(F.col(column), "\n", -1)).alias("pos", "line")).withColumn("line_no", F.col("pos") + 1)
    rows = with_fences(lines)
    blank = F.trim("line") == ""
    row = F.ltrim("line").startswith("|")
    facts = rows.groupBy("page").agg(
        (F.count_if("is_fence") % 2 == 1).alias("unclosed"), F.max(F.when(~blank, F.col("line_no"))).alias("end"),
        F.max(F.when(blank & ~F.col("is_fence") & ~F.col("in_fence"), F.col("line_no"))).alias("last_blank"),
        F.max(F.when(~row & ~blank, F.col("line_no"))).alias("last_text"),
        F.max(F.when(row & F.rtrim("line").endswith("|"), F.col("line_no"))).alias("last_row"), F.max(F.when(row, F.col("line_no"))).alias("last_bar"))
    # the last table row counts only in the block of rows that ends the text
    gaps = rows.join(facts.select("page", "end"), "page").filter(~row & (F.col("line_no") < F.col("end"))).groupBy("page").agg(F.max("line_no").alias("gap"))
    facts = facts.join(gaps, "page", "left")
    tabled = ~F.col("unclosed") & (F.col("last_bar") == F.col("end")) & (F.col("last_row") > F.coalesce("gap", F.lit(0)))
    cut = F.when(tabled, F.col("last_row")).otherwise(F.col("last_blank"))
    out = facts.select(F.col("page").alias(key), cut.alias("cut"), F.when(tabled, "\n").otherwise("\n\n").alias("join_with")).filter("cut IS NOT NULL")
    kept = F.array_join(F.slice(F.split(F.col(column), "\n", -1), F.lit(1), F.col("cut")), "\n")
    joined = texts.select(key, column).join(out, key).select(key, kept.alias("kept"), "join_with")
    return joined.filter(F.length(F.regexp_replace("kept", r"^\s+|\s+$", "")) >= least)


def assemble_sections(parts: DataFrame, key: str, order: str, column: str = "text") -> DataFrame:
    """Parts in order, joined by blank lines; only the first of equal headings (in any case) stays."""
    trimmed = parts.select(F.col(key).alias("doc"), F.col(order).alias("part"), F.regexp_replace(column, r"^\s+|\s+$", "").alias("body")).filter("body <> ''")
    lines = trimmed.select("doc", "part", F.concat_ws("\u0001", F.col("doc").cast("string"), F.col("part").cast("string")).alias("page"), F.posexplode(F.split("body", "\n", -1)).alias("line_no", "line"))
    rows = with_fences(lines)
    heading = F.when(~F.col("is_fence") & ~F.col("in_fence") & F.col("line").rlike(r"^#{1,6}\s+.+$"), F.lower(F.trim("line")))
    rows = rows.withColumn("heading", heading)
    place = F.struct("part", "line_no")
    first = rows.filter("heading IS NOT NULL").groupBy("doc", "heading").agg(F.min(place).alias("first"))
    kept = rows.join(first, ["doc", "heading"], "left").filter(F.col("heading").isNull() | (F.col("first") == place))
    # one array per conversation part, then one per conversation
    texts = kept.groupBy("doc", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("t"))
    whole = trimmed.select("doc", "part").join(texts, ["doc", "part"], "left")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", F.coalesce("t", F.lit("")).alias("t")))), lambda x: x["t"]), "\n\n")
    return whole.groupBy("doc").agg(joined.alias("content")).withColumnRenamed("doc", key)


def summarize_doc(docs: DataFrame, column: str, cap: int = 120) -> DataFrame:
    """First paragraph of a comment without stars; list rows on lines of their own, pipes escaped."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(column), r"\\r", ""), r"\\n", "\n"), r"^\s*/\*\*", "")
    t = F.regexp_replace(t, r"\*/\s*$", "")
    ls = F.transform(F.split(t, "\n"), lambda x: F.rtrim(F.regexp_replace(x, r"^\s*\*!? ?", "")))
    body = F.regexp_replace(F.array_join(ls, "\n"), r"^\s+|\s+$", "")
    para = F.split(body, r"\n\s*\n", 2)[0]
    rows = F.filter(F.transform(F.split(para, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    item = r"^(?:[-*+]|\d+\.)\s+"
    shown = F.transform(rows, lambda x: F.replace(F.when(x.rlike(item), F.concat(F.lit("- "), F.regexp_replace(x, item, ""))).otherwise(x), F.lit("|"), F.lit("\\|")))
    joined = F.array_join(shown, " ")
    listed = F.when(F.exists(shown, lambda x: x.startswith("- ")), F.array_join(shown, "<br>")).otherwise(joined)
    cut = F.when(F.length(listed) > cap, F.concat(F.substring(listed, 1, cap), F.lit("…"))).otherwise(listed)
    return docs.withColumn("summary", F.when(F.coalesce(body, F.lit("")) == "", "—").otherwise(cut))


def render_table(rows: DataFrame, group: str, order: list[str], columns: list[str]) -> DataFrame:
    """Markdown table of each group's rows; meant for capped reports."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.col(c).cast("string") for c in columns]), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n| " + " | ".join("---" for _ in columns) + " |\n"
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("_l")))), lambda x: x["_l"]), "\n")
    return rows.groupBy(group).agg(F.concat(F.lit(head), body).alias("markdown"))
