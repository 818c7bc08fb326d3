"""The quality gate: every rule gives rows of one issues table [page, rule, severity, message]."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from codeloom.functions import text as X, vocab
from codeloom.operators.aggregate import claim_support, evidence_coverage, with_block
from codeloom.operators.anchors import mermaid_lines
from codeloom.operators.extract_docs import extract_tables
from codeloom.operators.lines import all_matches, by_line, with_fences
from codeloom.session import fixed_table

ISSUE = ("page", "rule", "severity", "message")


def issue(df: DataFrame, rule: str, severity: str | Column, message: Column) -> DataFrame:
    level = F.lit(severity) if isinstance(severity, str) else severity
    return df.select("page", F.lit(rule).alias("rule"), level.alias("severity"), message.alias("message"))


def rule_empty_shell(lines: DataFrame) -> DataFrame:
    t = F.trim("line")
    filled = t != ""
    n, body = F.count_if(filled), F.count_if(filled & ~t.rlike(vocab.HEADING))
    why = F.when(n == 0, "内容为空").when(body == n, "缺少 Markdown 标题结构").when(body == 0, "仅有标题无正文，判定为空壳页")
    found = lines.groupBy("page").agg(why.alias("m")).filter("m IS NOT NULL")
    return issue(found, "empty-shell", "error", F.col("m"))


def rule_secret(pages: DataFrame, column: str = "content") -> DataFrame:
    """First secret pattern, by declared order, with the line of its first hit; the value is never shown."""
    # generators keep the text (often put together from lines) and the places from being computed anew for each use
    texts = pages.select("page", F.inline(F.array(F.struct(F.col(column).alias("text")))))
    may = [reduce(Column.__or__, [F.col("text").contains(x) for x in literals]) for literals in vocab.SECRET_LITERALS]
    places = [F.when(may[i], F.regexp_instr("text", F.lit(X.ascii_edges(pattern)))).alias(f"at{i}") for i, (_, pattern) in enumerate(vocab.SECRET_PATTERNS)]
    placed = texts.select("page", "text", F.inline(F.array(F.struct(*places))))
    first = None
    for i, (label, _) in enumerate(vocab.SECRET_PATTERNS):
        hit = F.struct(F.lit(label).alias("label"), F.col(f"at{i}").alias("at"))
        first = F.when(F.col(f"at{i}") > 0, hit) if first is None else first.when(F.col(f"at{i}") > 0, hit)
    found = placed.select("page", "text", first.alias("first")).filter("first IS NOT NULL")
    line = F.length(F.regexp_replace(F.left("text", F.col("first.at")), r"[^\n]+", "")) + 1
    return issue(found, "secret", "error", F.concat("first.label", F.lit("（第 "), line.cast("string"), F.lit(" 行，值不回显）")))


EVIDENCE_MIN = 3


def rule_thin_evidence(lines: DataFrame, tiers: DataFrame) -> DataFrame:
    """Structure pages, the index aside, with too few files in their evidence block; `tiers` have page and tier."""
    listed = with_block(lines).filter(F.col("in_block") & F.col("line").startswith("- ")).groupBy("page").agg(F.count("*").alias("n"))
    judged = tiers.filter("tier = 'structure' AND page <> 'readme'").join(lines.select("page").distinct(), "page", "left_semi")
    thin = judged.join(listed, "page", "left").withColumn("n", F.coalesce("n", F.lit(0))).filter(F.col("n") < EVIDENCE_MIN)
    return issue(thin, "thin-evidence", "warn", F.concat(F.lit("证据锚定块仅 "), F.col("n").cast("string"), F.lit(f" 个源文件（< {EVIDENCE_MIN}），页面叙述依据可能不足")))


def rule_evidence_coverage(lines: DataFrame, files: DataFrame) -> DataFrame:
    odd = evidence_coverage(lines, files).filter("cited >= 3 AND covered < cited AND uncited > 0")
    return issue(odd, "evidence-coverage", "warn", F.concat(F.lit("正文引用文件 "), F.col("cited").cast("string"), F.lit(" 个，锚定块仅覆盖 "), F.col("covered").cast("string"), F.lit(" 个")))


def rule_diagram_misuse(lines: DataFrame) -> DataFrame:
    hits = mermaid_lines(lines).filter(F.col("line").rlike(r"^\s*sequenceDiagram") & (F.col("page") != "calls")).select("page").distinct()
    return issue(hits, "diagram-misuse", "warn", F.lit("sequenceDiagram 仅允许出现在 calls 页（R2 边表优于时序图）"))


def has_anchor(line: Column) -> Column:
    return line.rlike(vocab.ANCHOR) | line.rlike(X.ascii_edges(vocab.COMMIT_ANCHOR)) | line.rlike(vocab.DOC_ANCHOR)


def _sections(lines: DataFrame, width: int) -> DataFrame:
    title = F.nullif(F.trim(F.regexp_extract("line", rf"^##\s+(.{{1,{width}}})", 1)), F.lit(""))
    return lines.withColumn("title", title).withColumn("section", F.count("title").over(by_line("page"))).filter("section > 0")


def rule_unanchored_rationale(lines: DataFrame) -> DataFrame:
    rows = _sections(lines, 60)
    heads = rows.filter("title IS NOT NULL").select("page", "section", "title").filter(F.col("title").rlike(vocab.RATIONALE))
    body = rows.filter("title IS NULL").groupBy("page", "section").agg(
        F.bool_or(F.trim("line") != "").alias("filled"), F.bool_or(has_anchor(F.col("line"))).alias("anchored"))
    bare = heads.join(body, ["page", "section"]).filter("filled AND NOT anchored")
    return issue(bare, "unanchored-rationale", "warn", F.concat(F.lit("动机类小节「"), "title", F.lit("」未引用任何 file:line 或 commit 证据（R7），叙述可能为无据推断")))


TABLE_SEPARATOR = r"^\s*\|?\s*:?-{1,}:?\s*(\|\s*:?-{1,}:?\s*)*\|?\s*$"


def rule_incomplete_page(lines: DataFrame, truncated: DataFrame | None = None) -> DataFrame:
    """Unclosed fence, a last table row cut short, or table rows without header and rule; an error on truncated pages."""
    order = by_line("page")
    rows = with_fences(lines)
    bar = F.ltrim("line").startswith("|")
    filled = F.trim("line") != ""
    facts = rows.groupBy("page").agg((F.count_if("is_fence") % 2 == 1).alias("unclosed"), F.max(F.when(filled, F.struct("line_no", "line"))).alias("last"))
    cut = F.ltrim("last.line").startswith("|") & ~F.rtrim("last.line").endswith("|")
    bars = rows.filter(bar & ~F.col("in_fence")).withColumn("block", F.col("line_no") - F.row_number().over(order))
    inner = W.partitionBy("page", "block").orderBy("line_no")
    second = bars.withColumn("k", F.row_number().over(inner)).filter("k = 2").filter(~F.col("line").rlike(TABLE_SEPARATOR))
    orphan = second.groupBy("page").agg((F.min("line_no") - 1).alias("orphan"))
    joined = facts.join(orphan, "page", "left")
    signals = F.concat_ws("、", F.when(F.col("unclosed"), "未闭合代码块"), F.when(cut, "末尾表格残行"), F.when(F.col("orphan").isNotNull(), F.concat(F.lit("中段无表头表格块（第 "), F.col("orphan").cast("string"), F.lit(" 行起）"))))
    bad = joined.withColumn("s", signals).filter("s <> ''")
    severity, tail = F.lit("warn"), F.lit("")
    if truncated is not None:
        bad = bad.join(truncated.select("page", F.lit(True).alias("t")).distinct(), "page", "left")
        severity = F.when(F.col("t"), "error").otherwise("warn")
        tail = F.when(F.col("t"), "：续写耗尽后仍截断").otherwise("")
    return issue(bad, "incomplete-page", severity, F.concat(F.lit("疑似截断残页（"), "s", F.lit("）"), tail))


IMPORT_ANCHOR = r"[A-Za-z0-9_.@-]*[A-Za-z][A-Za-z0-9_.@-]*\.[A-Za-z]{2,4}\b(?::\d+)?"


def unanchored_dependencies(lines: DataFrame) -> DataFrame:
    """Dependency rows without a file anchor, per page."""
    rows = _sections(lines, 40)
    heads = rows.filter("title IS NOT NULL").filter(F.col("title").rlike(vocab.DEPENDENCY_SECTIONS)).select("page", "section")
    t = F.trim("line")
    body = rows.filter(F.col("title").isNull() & t.startswith("|")).join(heads, ["page", "section"], "left_semi")
    cells = F.filter(F.transform(F.split(t, r"\|"), lambda c: F.trim(c)), lambda c: c != "")
    body = body.withColumn("cells", cells).filter(F.size("cells") > 0)
    usable = (
        ~F.forall("cells", lambda c: c.rlike(r"^:?-{2,}:?$")) & ~F.exists("cells", lambda c: c.contains("依赖") | c.contains("版本") | c.contains("import"))
        & ~t.rlike(X.ascii_edges(IMPORT_ANCHOR)))
    name = F.try_element_at(F.filter("cells", lambda c: ~c.rlike(r"^\d")), F.lit(1))
    return body.filter(usable).select("page", "line_no", F.substring(name, 1, 30).alias("name")).filter("name IS NOT NULL")


def rule_unanchored_dependency(lines: DataFrame, page: str | None = "tech-stack") -> DataFrame:
    mine = lines if page is None else lines.filter(F.col("page") == page)
    found = unanchored_dependencies(mine).groupBy("page").agg(F.count("*").alias("n"), F.min(F.struct("line_no", "name")).alias("f"))
    return issue(found, "unanchored-dependency", "warn", F.concat(F.lit("依赖表格行缺 import 点锚点（R3）："), "f.name", F.when(F.col("n") > 1, F.concat(F.lit(" 等 "), F.col("n").cast("string"), F.lit(" 行"))).otherwise("")))


def rule_unverified_absence(lines: DataFrame, suspects: DataFrame) -> DataFrame:
    """Names under suspicion that a page calls absent without naming the scan limit."""
    told = lines.filter(F.col("line").rlike(vocab.NEGATIVE_ASSERTION) & ~F.col("line").contains(vocab.SCAN_LIMIT))
    names = all_matches(told, r"`([^`\n]+)`", ["raw"], keep=("page", "line_no")).select("page", F.trim("raw").alias("shown"))
    keys = names.distinct().select("page", "shown", F.explode(F.array_distinct(F.array(F.col("shown"), X.snake(F.col("shown"))))).alias("name"))
    hit = keys.join(suspects.select("name").distinct(), "name", "left_semi").select("page", "shown").distinct()
    per_page = hit.groupBy("page").agg(F.min("shown").alias("first"), F.count("*").alias("n"))
    return issue(per_page, "unverified-absence", "warn", F.concat(F.lit("对口径局限嫌疑对象下了否定性结论（须标「扫描口径局限」）："), "first", F.when(F.col("n") > 1, F.concat(F.lit(" 等 "), F.col("n").cast("string"), F.lit(" 个"))).otherwise("")))


def rule_filler_noise(lines: DataFrame, most: int = 10) -> DataFrame:
    n = lines.groupBy("page").agg(F.count_if(F.col("line").rlike(vocab.FILLER)).alias("n")).filter(F.col("n") > most)
    return issue(n, "filler-noise", "error", F.concat(F.lit("「数据未提供」类填充行 "), F.col("n").cast("string"), F.lit(" 行（>10）：页面疑似数据工件转储，已降级规则路径")))


def rule_scope_overlap(tables: DataFrame) -> DataFrame:
    """Pages with another page's own table header; one issue per page and owner."""
    own = fixed_table(tables.sparkSession, "owner, signature, width", [(o, "|".join(s), len(s)) for o, s in vocab.EXCLUSIVE_HEADERS])
    cells = F.split("header", r"\|")
    rows = tables.filter("n_rows > 0").select("page", "table_line", "n_rows", F.explode(F.array_distinct(F.array(*[F.array_join(F.slice(cells, 1, w), "|") for w in sorted({len(s) for _, s in vocab.EXCLUSIVE_HEADERS})]))).alias("signature"))
    hit = rows.join(F.broadcast(own), "signature").filter("page <> owner")
    first = hit.groupBy("page", "owner").agg(F.min_by(F.struct("signature", "n_rows"), F.struct("table_line", "signature")).alias("h"))
    message = F.concat(F.lit("出现 "), "owner", F.lit(" 页的专属表头「"), F.regexp_replace("h.signature", r"\|", " | "), F.lit("」（"), F.col("h.n_rows").cast("string"), F.lit(" 行），疑似职责越界，建议让位并链接 "), "owner", F.lit(".md"))
    return issue(first, "page-scope-overlap", "warn", message)


def rule_claim_support(lines: DataFrame) -> DataFrame:
    weak = claim_support(lines).filter("weak")
    return issue(weak, "claim-support", "warn", F.concat(F.lit("事实句支撑率 "), F.col("supported").cast("string"), F.lit("/"), F.col("factual").cast("string"), F.lit("（<50%）")))


def rule_dead_links(dead: DataFrame) -> DataFrame:
    return issue(dead.select("page", "target").distinct(), "dead-link", "warn", F.concat(F.lit("相对链接目标本次未产出: "), "target"))


def rule_mermaid_ghosts(ghosts: DataFrame) -> DataFrame:
    return issue(ghosts, "mermaid-ghost", "warn", F.concat(F.lit("Mermaid 图引用未知文件: "), "file"))


def rule_broken_anchors(checked: DataFrame, mismatched: DataFrame, missing_docs: DataFrame, fragments: DataFrame) -> DataFrame:
    """Anchors without a line, of unknown files or beyond the end, and those that point past their name or heading."""
    place = F.concat_ws(":", "path", "target_line")
    text = F.when(F.col("state") == "broken", F.concat(F.lit("残缺锚点（缺少行号）: "), place)).when(
        F.col("state") == "unknown", F.concat(F.lit("锚点路径不在扫描文件清单中: "), "path")).when(F.col("state") == "out-of-range", F.concat(F.lit("锚点行号超出文件范围: "), place))
    own = checked.select("page", text.alias("m")).filter("m IS NOT NULL").distinct()
    far = mismatched.select("page", F.concat(F.lit("锚点文件与符号定义文件不符: "), "name", F.lit(" @ "), place).alias("m")).distinct()
    docs = missing_docs.select("page", F.concat(F.lit("文档锚点目标不存在: "), "anchor").alias("m")).distinct()
    inner = fragments.select("page", F.concat(F.lit("页内锚链接目标不存在: #"), "slug").alias("m")).distinct()
    return issue(own.unionByName(far).unionByName(docs).unionByName(inner), "broken-anchor", "warn", F.col("m"))


def gate(*issues: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, issues)


def page_gate(lines: DataFrame, contents: DataFrame, blocks: DataFrame, tiers: DataFrame, files: DataFrame, dead: DataFrame, ghosts: DataFrame,
              anchors: tuple[DataFrame, DataFrame, DataFrame, DataFrame], suspects: DataFrame, truncated: DataFrame | None = None, dependency_page: str | None = "tech-stack") -> DataFrame:
    """All checks of a page. `contents` has page and content, `blocks` the lines with their evidence blocks, `tiers` page and tier;
    `anchors` are the four inputs of rule_broken_anchors."""
    return gate(
        rule_empty_shell(lines), rule_secret(contents), rule_broken_anchors(*anchors), rule_dead_links(dead), rule_thin_evidence(blocks, tiers),
        rule_evidence_coverage(blocks, files), rule_diagram_misuse(lines), rule_mermaid_ghosts(ghosts), rule_unanchored_rationale(lines),
        rule_incomplete_page(lines, truncated), rule_unanchored_dependency(lines, dependency_page), rule_unverified_absence(lines, suspects),
        rule_filler_noise(lines), rule_claim_support(lines))


def page_passed(pages: DataFrame, issues: DataFrame) -> DataFrame:
    """Pass flag and counts of every page; a page fails on any error."""
    counts = issues.groupBy("page").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warn").alias("warnings"))
    out = pages.select("page").distinct().join(counts, "page", "left").na.fill(0, ["errors", "warnings"])
    return out.withColumn("passed", F.col("errors") == 0)


def passing_pages(pages: DataFrame, issues: DataFrame) -> DataFrame:
    return pages.join(issues.filter("severity = 'error'").select("page"), "page", "left_anti")


def failing_reasons(issues: DataFrame, cap: int = 10) -> DataFrame:
    """Joined error messages of the pages that stay unwritten, the first few per page."""
    rank = F.row_number().over(W.partitionBy("page").orderBy("rule", "message"))
    first = issues.filter("severity = 'error'").withColumn("rn", rank).filter(F.col("rn") <= cap)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "message"))), lambda x: x["message"]), "; ")
    return first.groupBy("page").agg(joined.alias("reason"))


def build_report(statuses: DataFrame, issues: DataFrame, claims: DataFrame, anchors: DataFrame, support: DataFrame) -> DataFrame:
    """Run totals: pages by status, issues by rule and severity, claim, anchor and support sums."""
    def sums(df: DataFrame, prefix: str, columns: tuple[str, ...]) -> DataFrame:
        row = df.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns])
        return row.select(F.inline(F.array(*[F.struct(F.lit(f"{prefix}.{c}").alias("counter"), F.col(c).cast("bigint").alias("n")) for c in columns])))
    by_status = statuses.groupBy(F.concat(F.lit("pages."), "status").alias("counter")).agg(F.count("*").alias("n"))
    by_rule = issues.groupBy(F.concat_ws(".", F.lit("issues"), "severity", "rule").alias("counter")).agg(F.count("*").alias("n"))
    return (
        by_status.unionByName(by_rule).unionByName(sums(claims, "claims", ("total", "verified", "unverified", "mention_only", "ambiguous", "skipped")))
        .unionByName(sums(anchors, "anchors", ("total", "valid", "out_of_range", "comment"))).unionByName(sums(support, "support", ("factual", "supported"))))


def crosspage_review(lines: DataFrame, table_overlaps: DataFrame, anchor_groups: DataFrame, variants: DataFrame, odd_deps: DataFrame, same: DataFrame) -> DataFrame:
    """All issues between pages: duplicated tables and evidence, scope, terms, dependencies and metrics."""
    pct = lambda c: F.round(F.col(c) * 100).cast("int").cast("string")
    dup = table_overlaps.filter("duplicated").select(F.col("a").alias("page"), F.concat(F.lit("与 "), "b", F.lit(" 表格首列重合度 "), pct("overlap"), F.lit("%（≥50%）")).alias("m"))
    fold = anchor_groups.select(F.col("first_a").alias("page"), F.concat(F.lit("与 "), "first_b", F.lit(" 意图证据锚点重合度 "), pct("jaccard"), F.lit("%（≥70%）")).alias("m"))
    terms = variants.select("page", F.concat(F.lit("术语 `"), "term", F.lit("` 与 glossary 规范形 `"), "standard", F.lit("` 仅大小写/分隔符不同，建议统一")).alias("m"))
    deps = odd_deps.select(F.lit("overview").alias("page"), F.concat(F.lit("依赖 `"), "name", F.lit("` 归类矛盾")).alias("m"))
    metric = same.groupBy("sequence", "headers", "pages", "n").agg(F.min("first_page").alias("page"))
    metric = metric.select("page", F.concat(F.lit("同一数值序列（"), F.col("n").cast("string"), F.lit(" 项）在多处以不同语义渲染")).alias("m"))
    return gate(
        issue(dup, "table-duplication", "warn", F.col("m")), issue(fold, "intent-evidence-duplication", "warn", F.col("m")), rule_scope_overlap(extract_tables(lines)),
        issue(terms, "term-inconsistency", "warn", F.col("m")), issue(deps, "dep-consistency", "warn", F.col("m")), issue(metric, "metric-mismatch", "warn", F.col("m")))
