"""Counts over graphs, commits, claims and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codeloom.functions import text as X, vocab
from codeloom.operators.classify import top_per_group
from codeloom.operators.lines import all_matches, outside_fences


def degrees(calls: DataFrame, level: str = "file") -> DataFrame:
    """Calls into and out of every symbol, file or module (level is `name`, `file` or `module`)."""
    ends = F.inline(F.array(
        F.struct(F.col(f"caller_{level}").alias(level), F.lit(0).alias("i"), F.lit(1).alias("o")),
        F.struct(F.col(f"callee_{level}").alias(level), F.lit(1).alias("i"), F.lit(0).alias("o"))))
    return calls.select(ends).groupBy(level).agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def symbol_count(symbols: DataFrame) -> DataFrame:
    return symbols.filter("NOT is_test").groupBy("file").agg(F.count("*").alias("symbols"))


def module_boundaries(calls: DataFrame) -> DataFrame:
    """Calls between different modules."""
    cross = calls.filter("caller_module <> callee_module")
    return cross.groupBy(F.col("caller_module").alias("from_module"), F.col("callee_module").alias("to_module")).agg(F.count("*").alias("call_count"))


def top_callers(calls: DataFrame, n: int = 15) -> DataFrame:
    """Symbols (name and file) that call most."""
    counts = calls.groupBy(F.col("caller_name").alias("name"), F.col("caller_file").alias("file")).agg(F.count("*").alias("calls"))
    return counts.orderBy(F.col("calls").desc(), "name", "file").limit(n)


def graph_profile(symbols: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """Node, edge and language counts in one table."""
    def part(df: DataFrame, what: str, key: Column) -> DataFrame:
        return df.groupBy(F.lit(what).alias("what"), key.alias("key")).agg(F.count("*").alias("n"))
    return (
        part(symbols, "nodes", F.lit("total")).unionByName(part(edges, "edges", F.lit("total")))
        .unionByName(part(symbols, "node_label", F.col("label"))).unionByName(part(edges, "edge_type", F.col("type")))
        .unionByName(part(files, "language", X.language(F.col("path")))))


def churn(commits: DataFrame, n: int | None = 20) -> DataFrame:
    """Commits per file without merges, with the newest commit."""
    latest = F.max_by("subject", F.struct("date", "hash"))
    out = commits.filter("NOT is_merge").groupBy("file").agg(
        F.count("*").alias("commits"), latest.alias("subject"), F.max(F.struct("date", "hash")).alias("last"))
    out = out.select("file", "commits", "subject", X.commit_anchor(F.col("last.hash"), F.col("last.date")).alias("anchor"))
    return out if n is None else out.orderBy(F.col("commits").desc(), "file").limit(n)


def file_history(commits: DataFrame, window: int = 200) -> DataFrame:
    """Count, first and last commit of every file; `long_log` marks histories past the reading window."""
    at = F.struct("date", "hash")
    out = commits.filter("NOT is_merge").groupBy("file").agg(
        F.count("*").alias("commits"), F.min(at).alias("f"), F.max(at).alias("l"),
        F.min_by("subject", at).alias("first_subject"), F.max_by("subject", at).alias("last_subject"))
    return out.select("file", "commits", F.col("f.hash").alias("first_hash"), "first_subject", F.col("l.hash").alias("last_hash"), "last_subject", (F.col("commits") >= window).alias("long_log"))


def root_commits(commits: DataFrame, parents: DataFrame, limit: int | None = None) -> DataFrame:
    """Commits without parents, oldest first."""
    roots = commits.select("hash", "date", "subject").join(parents.select("hash"), "hash", "left_anti")
    return roots if limit is None else roots.orderBy("date", "hash").limit(limit)


def oldest_in_window(commits: DataFrame, window: int | None = None) -> DataFrame:
    """Oldest commit (of the `window` newest, if given), for histories without a visible root."""
    recent = commits.select("hash", "date", "subject")
    if window is not None:
        recent = recent.orderBy(F.col("date").desc(), F.col("hash").desc()).limit(window)
    return recent.orderBy("date", "hash").limit(1)


def commit_themes(commits: DataFrame, by: str, top: int = 3) -> DataFrame:
    """Most frequent normalised subjects of each group."""
    norm = commits.select(by, X.normalized_subject(F.col("subject")).alias("theme")).filter(F.length("theme") >= 4)
    counts = norm.groupBy(by, "theme").agg(F.count("*").alias("n")).filter("n >= 2")
    return top_per_group(counts, [by], [F.col("n").desc(), F.col("theme")], top)


def module_timeline(commits: DataFrame) -> DataFrame:
    """Commit count, first and last commit and themes of every module."""
    at = F.struct("date", "hash")
    base = commits.filter("NOT is_merge").groupBy("module").agg(
        F.count("*").alias("commits"), F.min_by("subject", at).alias("first_subject"), F.max_by("subject", at).alias("last_subject"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    themes = commit_themes(commits.filter("NOT is_merge"), "module")
    shown = F.concat("theme", F.lit("（×"), F.col("n").cast("string"), F.lit("）"))
    # at most three themes per module
    listed = themes.groupBy("module").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", shown.alias("t")))), lambda x: x["t"]), "、").alias("themes"))
    return base.join(listed, "module", "left")


def module_importance(modules: DataFrame, detailed: int = 12) -> DataFrame:
    """Importance of every module; the best are detailed, the rest summarised.

    `modules` have module, fan_in, fan_out, node_count, file_count and ord.
    """
    score = F.col("fan_in") * 2 + F.col("fan_out") + F.col("node_count") + F.col("file_count")
    scored = modules.withColumn("importance", score)
    best = scored.orderBy(F.col("importance").desc(), "ord").limit(detailed).select("module", F.lit(True).alias("d"))
    return scored.join(best, "module", "left").select("module", "importance", F.coalesce("d", F.lit(False)).alias("detailed"))


def claim_support(lines: DataFrame) -> DataFrame:
    """Factual lines of each page and how many carry an anchor or the inferred mark."""
    line = F.trim("line")
    rows = outside_fences(lines).filter(
        (line != "") & ~line.rlike(vocab.HEADING) & ~line.rlike(r"^\|?[\s:|-]*\|?$") & line.rlike(r"`[A-Za-z_$][A-Za-z0-9_$.-]{2,}`"))
    anchored = line.rlike(vocab.ANCHOR) | line.rlike(vocab.COMMIT_ANCHOR) | line.rlike(vocab.DOC_ANCHOR) | line.contains(vocab.INFERRED)
    out = rows.groupBy("page").agg(F.count("*").alias("factual"), F.count_if(anchored).alias("supported"))
    return out.withColumn("weak", (F.col("factual") >= 5) & (F.col("supported") * 2 < F.col("factual")))


CITED = r"[`(\[]([A-Za-z0-9_.@-]+(?:/[A-Za-z0-9_.@-]+)*\.[a-z]+)(?::\d+)?[`):\]]"


def cited_files(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Known files each page cites."""
    found = all_matches(lines, CITED, ["file"], keep=("page", "line_no")).filter(F.col("file").rlike(vocab.FILE_PATH))
    return found.select("page", F.regexp_replace("file", r"^\./", "").alias("file")).join(files.select(F.col("path").alias("file")), "file", "left_semi").select("page", "file").distinct()


def with_block(lines: DataFrame) -> DataFrame:
    """Add `in_block` for the lines of the evidence block at the top of a page."""
    summary = f"<summary>{vocab.SUMMARY}</summary>"
    starts = lines.filter(F.col("line").contains(summary)).groupBy("page").agg(F.min("line_no").alias("from_at"))
    closes = lines.filter(F.col("line").contains("</details>")).select("page", F.col("line_no").alias("close"))
    ends = starts.join(closes, "page").filter("close > from_at").groupBy("page", "from_at").agg(F.min("close").alias("to_at"))
    inside = F.col("line_no").between(F.col("from_at"), F.col("to_at"))
    return lines.join(ends, "page", "left").withColumn("in_block", F.coalesce(inside, F.lit(False))).drop("from_at", "to_at")


def evidence_coverage(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Cited files against the files of the evidence block."""
    marked = with_block(lines)
    cited = cited_files(marked.filter("NOT in_block"), files).withColumn("cited", F.lit(1))
    block = marked.filter(F.col("in_block") & F.trim("line").startswith("- ")).select("page", F.expr("substr(trim(line), 3)").alias("file")).distinct().withColumn("listed", F.lit(1))
    both = cited.join(block, ["page", "file"], "full_outer")
    return both.groupBy("page").agg(
        F.count("cited").alias("cited"), F.count_if(F.col("cited").isNotNull() & F.col("listed").isNotNull()).alias("covered"),
        F.count_if(F.col("cited").isNotNull() & F.col("listed").isNull()).alias("missing"),
        F.count_if(F.col("cited").isNull()).alias("uncited"), F.count("listed").alias("listed"))


def channel_stats(verdicts: DataFrame, components: DataFrame, sites: DataFrame, absences: DataFrame) -> DataFrame:
    """Run counters of the extraction channels, one row each."""
    def one(df: DataFrame, **counts: Column) -> DataFrame:
        row = df.agg(*[c.alias(n) for n, c in counts.items()])
        return row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("counter"), F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias("n")) for n in counts])))
    v, c, a = F.col("verdict"), F.col("confidence"), F.col("verdict")
    return (
        one(verdicts, cross_language=F.count_if(v == "cross-language"), non_code=F.count_if(v == "non-code"), no_lexical_evidence=F.count_if(v == "no-lexical-evidence"))
        .unionByName(one(components, components=F.count("*"), props=F.sum("props_count"), emits=F.sum("emits_count")))
        .unionByName(one(sites, methods_resolved=F.count_if(c == "resolved"), methods_ambiguous=F.count_if(c == "ambiguous")))
        .unionByName(one(absences.select("name", "side", "verdict").distinct(), suspect=F.count_if(a == "suspect"), confirmed=F.count_if(a == "confirmed"))))


def citation_stats(lines: DataFrame, index: DataFrame) -> DataFrame:
    """Valid and invalid [E#] citations of each page; `index` has page and id."""
    found = all_matches(lines, r"\[(E\d+)\]", ["id"], keep=("page", "line_no"))
    joined = found.join(index.select("page", "id", F.lit(True).alias("ok")), ["page", "id"], "left")
    return joined.groupBy("page").agg(F.count_if(F.col("ok")).alias("cited"), F.count_if(F.col("ok").isNull()).alias("invalid"))


def strip_citations(lines: DataFrame) -> DataFrame:
    return lines.withColumn("line", F.regexp_replace("line", r"\[E\d+\]", ""))


def confirmation_summary(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Outcome of one review round."""
    joined = items.select("kind", "text").join(decisions, ["kind", "text"], "left")
    resolved = F.col("action") == "resolve"
    return joined.agg(
        F.count("*").alias("total"), F.count_if(resolved).alias("resolved"), (F.count("*") - F.count_if(resolved)).alias("kept"),
        F.count_if(resolved & (F.col("kind") == "claim")).alias("persisted"))
