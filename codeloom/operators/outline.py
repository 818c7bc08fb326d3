"""Chapter outlines checked against files, modules and symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from codeloom.functions import text as X

ID = r"^[a-z0-9]+(-[a-z0-9]+)*$"
MAX_CHAPTERS, MAX_CHAPTER_PAGES, MAX_PAGES = 8, 6, 16
MIN_FILES, MAX_FILES, MAX_MODULES = 3, 12, 3


def valid_files(page_files: DataFrame, files: DataFrame) -> DataFrame:
    """Known, non-test files of every outline page, in order and once."""
    known = files.filter(~X.is_test_path(F.col("path"))).select(F.col("path").alias("file"))
    kept = page_files.join(known, "file", "left_semi")
    return kept.groupBy("outline", "chapter_ord", "page_ord", "file").agg(F.min("file_ord").alias("file_ord"))


def outline_pages(chapters: DataFrame, pages: DataFrame, page_files: DataFrame, files: DataFrame) -> DataFrame:
    """Every outline page with `kept` and the reason of its drop.

    `chapters` have outline, chapter_ord, chapter_id and title; `pages` outline, chapter_ord, page_ord,
    page_id, title and brief.  Only valid pages use up the budgets, in order; an outline is one document.
    """
    sizes = valid_files(page_files, files).groupBy("outline", "chapter_ord", "page_ord").agg(F.count("*").alias("n_files"))
    rows = pages.join(sizes, ["outline", "chapter_ord", "page_ord"], "left").withColumn("n_files", F.coalesce("n_files", F.lit(0)))
    bad = (
        F.when(~F.col("page_id").rlike(ID), "bad id").when(F.trim(F.coalesce("title", F.lit(""))) == "", "no title")
        .when(F.trim(F.coalesce("brief", F.lit(""))) == "", "no brief").when(F.col("n_files") < MIN_FILES, "too few files"))
    rows = rows.withColumn("bad", bad)
    again = F.row_number().over(W.partitionBy("outline", "chapter_ord", F.col("bad").isNull(), "page_id").orderBy("page_ord"))
    rows = rows.withColumn("bad", F.when(F.col("bad").isNull() & (again > 1), "duplicate id").otherwise(F.col("bad")))
    in_chapter = W.partitionBy("outline", "chapter_ord").orderBy("page_ord")
    rows = rows.withColumn("nth", F.count_if(F.col("bad").isNull()).over(in_chapter))
    usable = rows.groupBy("outline", "chapter_ord").agg(F.least(F.count_if(F.col("bad").isNull()), F.lit(MAX_CHAPTER_PAGES)).alias("usable"))
    heads = chapters.join(usable, ["outline", "chapter_ord"], "left").withColumn("usable", F.coalesce("usable", F.lit(0)))
    wrong = F.when(~F.col("chapter_id").rlike(ID), "bad chapter id").when(F.trim(F.coalesce("title", F.lit(""))) == "", "no chapter title").when(F.col("usable") == 0, "no valid page")
    heads = heads.withColumn("wrong", wrong)
    twice = F.row_number().over(W.partitionBy("outline", F.col("wrong").isNull(), "chapter_id").orderBy("chapter_ord"))
    heads = heads.withColumn("wrong", F.when(F.col("wrong").isNull() & (twice > 1), "duplicate chapter id").otherwise(F.col("wrong")))
    order = W.partitionBy("outline").orderBy("chapter_ord")
    takes = F.when(F.col("wrong").isNull(), F.col("usable")).otherwise(0)
    heads = heads.withColumn("left_pages", F.lit(MAX_PAGES) - (F.sum(takes).over(order) - takes)).withColumn("chapter_no", F.count_if(F.col("wrong").isNull()).over(order))
    heads = heads.withColumn("wrong", F.when(F.col("wrong").isNotNull(), F.col("wrong")).when(F.col("chapter_no") > MAX_CHAPTERS, "too many chapters").when(F.col("left_pages") <= 0, "no valid page"))
    joined = rows.join(heads.select("outline", "chapter_ord", "chapter_id", "wrong", "left_pages"), ["outline", "chapter_ord"])
    before = F.col("nth") - F.when(F.col("bad").isNull(), 1).otherwise(0)
    reason = (
        F.when(F.col("wrong").isNotNull(), F.col("wrong")).when(before >= F.col("left_pages"), "too many pages").when(before >= MAX_CHAPTER_PAGES, "too many chapter pages").otherwise(F.col("bad")))
    return joined.select("outline", "chapter_ord", "chapter_id", "page_ord", "page_id", "title", reason.isNull().alias("kept"), reason.alias("reason"))


def outline_warnings(kept: DataFrame, chapters: DataFrame, page_files: DataFrame, page_refs: DataFrame, files: DataFrame, modules: DataFrame) -> DataFrame:
    """Warnings about what stays: W1 one-page chapter, W2 too many modules, W3 dropped references, W4 overlap, W5 title used twice.

    `kept` are kept outline pages; `page_refs` have outline, chapter_ord, page_ord, and `known` for every module or
    symbol reference; `modules` have path and module.
    """
    key = ["outline", "chapter_ord", "page_ord"]
    pages = kept.filter("kept").select(*key, "title")
    single = pages.groupBy("outline", "chapter_ord").agg(F.count("*").alias("n")).filter("n < 2").select(F.lit("W1").alias("code"), "outline", "chapter_ord", F.lit(None).cast("int").alias("page_ord"), F.lit(1).cast("bigint").alias("n"))
    good = valid_files(page_files, files)
    rank = F.row_number().over(W.partitionBy(*key).orderBy("file_ord", "file"))
    used = good.withColumn("rn", rank).filter(F.col("rn") <= MAX_FILES).join(pages, key, "left_semi")
    span = used.join(modules.select(F.col("path").alias("file"), "module"), "file").groupBy(*key).agg(F.countDistinct("module").alias("n")).filter(F.col("n") > MAX_MODULES)
    span = span.select(F.lit("W2").alias("code"), *key, "n")
    lost = page_files.join(good.select(*key, "file"), [*key, "file"], "left_anti").select(*key)
    lost = lost.unionByName(page_refs.filter("NOT known").join(pages, key, "left_semi").select(*key)).unionByName(good.withColumn("rn", rank).filter(F.col("rn") > MAX_FILES).select(*key))
    lost = lost.groupBy(*key).agg(F.count("*").alias("n")).select(F.lit("W3").alias("code"), *key, "n")
    # an outline keeps at most sixteen pages of twelve files
    sizes = used.groupBy(*key).agg(F.count("*").alias("size"))
    a = used.join(sizes, key).select("outline", F.col("chapter_ord").alias("ca"), F.col("page_ord").alias("pa"), "file", F.col("size").alias("na"))
    b = used.join(sizes, key).select("outline", F.col("chapter_ord").alias("cb"), F.col("page_ord").alias("pb"), "file", F.col("size").alias("nb"))
    pairs = a.join(b, ["outline", "file"]).filter("ca < cb OR (ca = cb AND pa < pb)").groupBy("outline", "ca", "pa", "cb", "pb", "na", "nb").agg(F.count("*").alias("n"))
    near = pairs.filter("n / (na + nb - n) > 0.5").select(F.lit("W4").alias("code"), "outline", F.col("ca").alias("chapter_ord"), F.col("pa").alias("page_ord"), "n")
    live = pages.select("outline", "chapter_ord").distinct()
    titles = pages.select("outline", "chapter_ord", "page_ord", "title").unionByName(chapters.join(live, ["outline", "chapter_ord"], "left_semi").select("outline", "chapter_ord", F.lit(-1).alias("page_ord"), "title"))
    place = F.row_number().over(W.partitionBy("outline", "title").orderBy("chapter_ord", "page_ord"))
    twice = titles.withColumn("n", place.cast("bigint")).filter("n > 1 AND page_ord >= 0").select(F.lit("W5").alias("code"), *key, "n")
    return single.unionByName(span).unionByName(lost).unionByName(near).unionByName(twice)
