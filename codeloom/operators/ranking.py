"""Rankings, fair samples and capped evidence lists, all with full tie-breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from codeloom.functions import vocab
from codeloom.operators.classify import top_per_group
from codeloom.session import fixed_table


def _log_norm(value: Column, peak: Column) -> Column:
    return F.when((peak > 0) & (value > 0), F.log2(1 + value) / F.log2(1 + peak)).otherwise(0.0)


def rank_files(files: DataFrame, fan_in: DataFrame, symbols: DataFrame, churn: DataFrame, entry: DataFrame, boundary_modules: DataFrame,
               tested: DataFrame, docs: DataFrame) -> DataFrame:
    """Weighted importance of files; order by score desc, size desc, path.

    `files` have path, size and module; fan_in, symbols and churn have file and n; the sets have file or module.
    """
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col("file").alias("path"), F.col("n").alias(name))
    def flagged(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col("file").alias("path"), F.lit(1).alias(name)).distinct()
    def peak(df: DataFrame) -> Column:
        return df.agg(F.coalesce(F.max("n"), F.lit(0)).alias("m")).select("m").scalar()
    out = files.select("path", "size", "module")
    for df, name in ((fan_in, "fan_in"), (symbols, "symbols"), (churn, "churn")):
        out = out.join(counted(df, name), "path", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    for df, name in ((entry, "entry"), (tested, "tested"), (docs, "docs")):
        out = out.join(flagged(df, name), "path", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    edge = boundary_modules.select("module", F.lit(1).alias("boundary")).distinct()
    out = out.join(edge, "module", "left").withColumn("boundary", F.coalesce("boundary", F.lit(0)))
    w = vocab.RANK_WEIGHTS
    score = (
        w["fan_in"] * _log_norm(F.col("fan_in"), peak(fan_in)) + w["entry"] * F.col("entry") + w["boundary"] * F.col("boundary")
        + w["symbols"] * _log_norm(F.col("symbols"), peak(symbols)) + w["tested"] * F.col("tested") + w["docs"] * F.col("docs")
        + w["churn"] * _log_norm(F.col("churn"), peak(churn)))
    return out.withColumn("score", F.round(score, 9))


def top_files(ranked: DataFrame, n: int = 30) -> DataFrame:
    return ranked.orderBy(F.col("score").desc(), F.col("size").desc(), "path").limit(n)


def rank_stats(ranked: DataFrame, n: int = 30) -> DataFrame:
    top = top_files(ranked, n).agg(F.count_if(F.col("entry") == 1).alias("top_entry"), F.count_if(F.col("tested") == 1).alias("top_tested"))
    total = ranked.agg(F.count("*").alias("total")).select("total").scalar()
    return top.withColumn("total", total)


def fair_sample(symbols: DataFrame, hotspots: DataFrame, n: int = 10, per_file: int = 5, candidates: int | None = None) -> DataFrame:
    """Best symbols of each module, taken from its files in turn."""
    usable = symbols.filter("NOT is_test AND (docstring IS NOT NULL OR complexity > 0)").filter(F.col("label").isin("Class", "Function", "Method"))
    first = top_per_group(usable, ["module"], [F.col("complexity").desc(), F.col("file"), F.col("start_line"), F.col("id")], candidates, "_c")
    hot = hotspots.select("name", F.lit(8).alias("hot")).distinct()
    same = W.partitionBy("module", "file", "name", "start_line").orderBy("_c")
    scored = first.withColumn("_d", F.row_number().over(same)).filter("_d = 1").join(hot, "name", "left")
    score = F.coalesce("complexity", F.lit(0)) + F.when(F.coalesce("docstring", F.lit("")) != "", 4).otherwise(0) + F.coalesce("hot", F.lit(0))
    scored = scored.withColumn("score", score)
    in_file = W.partitionBy("module", "file").orderBy(F.col("score").desc(), "name", "start_line", "id")
    scored = scored.withColumn("round", F.row_number().over(in_file)).withColumn("best", F.max("score").over(W.partitionBy("module", "file"))).filter(F.col("round") <= per_file)
    turn = W.partitionBy("module").orderBy("round", F.col("best").desc(), "file")
    return scored.withColumn("place", F.row_number().over(turn)).filter(F.col("place") <= n).select("module", "place", "id", "name", "file", "score")


def representative_files(files: DataFrame, sample: DataFrame, n: int = 12) -> DataFrame:
    """Files that gave symbols first, in symbol order, then the others by path."""
    first = sample.groupBy("module", F.col("file").alias("path")).agg(F.min("place").alias("place"))
    joined = files.select("module", "path").join(first, ["module", "path"], "left")
    return top_per_group(joined, ["module"], [F.col("place").asc_nulls_last(), F.col("path")], n).select("module", "rank", "path")


def rank_evidence(candidates: DataFrame, n: int | None = None) -> DataFrame:
    """Evidence files of each page by best tier, then path."""
    tiers = candidates.groupBy("page", "file").agg(F.min("tier").alias("tier"))
    return top_per_group(tiers, ["page"], [F.col("tier"), F.col("file")], n)


def evidence_files(page_files: DataFrame, files: DataFrame, n: int | None = None) -> DataFrame:
    """Distinct known files of each page, sorted."""
    known = page_files.join(files.select(F.col("path").alias("file")), "file", "left_semi").select("page", "file").distinct()
    return top_per_group(known, ["page"], [F.col("file")], n)


def supplemental_symbols(symbols: DataFrame, n: int = 8) -> DataFrame:
    """Most complex production symbols, for pages with too little evidence."""
    usable = symbols.filter("NOT is_test AND file IS NOT NULL").filter(F.col("label").isin("Class", "Method", "Function"))
    return usable.orderBy(F.col("complexity").desc(), "id").limit(n).select("id", "name", "file", "complexity")


def thin_pages(evidence: DataFrame, pages: DataFrame, least: int = 3) -> DataFrame:
    counts = evidence.groupBy("page").agg(F.count("*").alias("n"))
    return pages.select("page").distinct().join(counts, "page", "left").filter(F.coalesce("n", F.lit(0)) < least).select("page", F.coalesce("n", F.lit(0)).alias("n"))


def evidence_top(evidence: DataFrame, group: str, n: int) -> DataFrame:
    """First n evidence rows of each group, by tier, file and line, one per kind and anchor."""
    once = top_per_group(evidence, [group, "kind", "anchor"], [F.col("tier"), F.col("file"), F.col("line_no")], 1, "_once")
    return top_per_group(once.drop("_once"), [group], [F.col("tier"), F.col("file"), F.col("line_no"), F.col("kind"), F.col("anchor")], n)


KIND_ORDER = (("symbol", 0), ("edge", 1), ("boundary", 2), ("intent", 3))


def assign_evidence_ids(evidence: DataFrame) -> DataFrame:
    """Stable ids E1..En per topic, by kind, anchor and name."""
    order = fixed_table(evidence.sparkSession, "kind, kind_ord", KIND_ORDER)
    ranked = evidence.join(F.broadcast(order), "kind")
    number = F.row_number().over(W.partitionBy("topic").orderBy("kind_ord", "anchor", "name"))
    return ranked.withColumn("number", number).withColumn("id", F.concat(F.lit("E"), F.col("number").cast("string"))).drop("kind_ord", "number")


def hot_functions(symbols: DataFrame, n: int = 20) -> DataFrame:
    hot = symbols.filter("NOT is_test AND complexity > 3").filter(F.col("label").isin("Method", "Function"))
    return hot.orderBy(F.col("complexity").desc(), "id").limit(n).select("id", "name", "file", "complexity")


def exported_functions(symbols: DataFrame, n: int = 15) -> DataFrame:
    out = symbols.filter("NOT is_test AND is_exported").filter(F.col("label").isin("Method", "Function"))
    return out.orderBy(F.col("complexity").desc(), "id").limit(n).select("id", "name", "file", "complexity")


def glossary(symbols: DataFrame, n: int = 30) -> DataFrame:
    """Documented symbols by label and complexity, one per name."""
    label = F.when(F.col("label") == "Class", 0).when(F.col("label") == "Method", 1).when(F.col("label") == "Function", 2).otherwise(3)
    documented = symbols.filter("NOT is_test AND docstring IS NOT NULL").filter(F.col("label").isin("Class", "Method", "Function", "Interface"))
    once = documented.withColumn("label_ord", label).groupBy("name").agg(F.min(F.struct("label_ord", (-F.col("complexity")).alias("c"), "id")).alias("k"))
    return once.orderBy("k").limit(n).select("name", F.col("k.id").alias("id"), (-F.col("k.c")).alias("complexity"))


def planner_symbols(symbols: DataFrame, n: int = 60) -> DataFrame:
    out = symbols.filter("NOT is_test AND docstring IS NOT NULL").filter(F.col("label").isin("Class", "Method", "Function"))
    return out.orderBy(F.col("complexity").desc(), "id").limit(n).select("id", "name", "file", "complexity")


def candidate_files(files: DataFrame, per_module: int | None = None, total: int | None = None) -> DataFrame:
    """Files of every module (the first of each, if limited), then those without a module."""
    top = top_per_group(files.filter("module IS NOT NULL").select("module", "path"), ["module"], [F.col("path")], per_module).select(F.lit(0).alias("o"), "module", "path")
    loose = files.filter("module IS NULL").select(F.lit(1).alias("o"), F.lit("").alias("module"), "path")
    both = top.unionByName(loose)
    return (both if total is None else both.orderBy("o", "module", "path").limit(total)).select("module", "path")
