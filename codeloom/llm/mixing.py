"""Mixing sources to target weights by hash-threshold histograms.

Each document has a 48-bit hash. Tokens are summed by source and by the first 12 bits of the hash; the bucket in which
the sum passes the source's budget is refined by the next 12 bits, and so on. Four histograms of at most 4,096 buckets a
source find the exact threshold, no document is sorted, and the mix is one filter `hash < threshold`. Thresholds grow
with the budget, so mixes of larger budgets contain those of smaller ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from codeloom.llm.common import WORD, saved

HASH_BITS, LEVEL_BITS = 48, 12


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def ranked(keys: DataFrame, key: str) -> DataFrame:
    """keys with `rank`, their place from 0 in binary order, nulls last: ranges are numbered apart, then shifted.

    The driver holds one count for each range.
    """
    order = [F.col(key).isNull(), F.col(key)]
    ranges = saved(keys.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before, starts = 0, []
    for row in ranges.groupBy("_range").count().orderBy("_range").collect():
        starts.append((row["_range"], before))
        before += row["count"]
    offsets = keys.sparkSession.createDataFrame(starts, "_range int, _start long")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranges.withColumn("rank", place).join(F.broadcast(offsets), "_range").withColumn("rank", F.col("rank") + F.col("_start")).drop("_range", "_start")


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """sources (source, source_size) with `target`: weights by rank, capped at most * size, the excess reshared."""
    s = saved(ranked(sources, "source").withColumn("w", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))), "sources")
    total = (s.agg(F.sum("source_size")).first()[0] or 0) * share
    level, capped = 0.0, -1
    while True:
        above = F.lit(level) * F.col("w") > F.col("source_size") * most if capped >= 0 else F.lit(False)
        cap, weight, n = s.agg(F.sum(F.when(above, F.col("source_size") * most)), F.sum(F.when(~above, F.col("w"))), F.count(F.when(above, 1))).first()
        if n == capped or not weight:
            break
        capped, level = n, (total - (cap or 0)) / weight
    even = F.lit(level) * F.col("w")
    return s.withColumn("target", F.when(even > F.col("source_size") * most, (F.col("source_size") * most).cast("double")).otherwise(even)).drop("rank", "w")


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """For each source (source, rest): `below`, the hash under which documents are taken for the rest of the budget."""
    open_ = budgets.filter("rest > 0").select("source", F.col("rest").alias("_left"), F.lit(0).cast("long").alias("_at"))
    for done in range(0, HASH_BITS, LEVEL_BITS):
        shift = HASH_BITS - done
        inside = sized.join(open_.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")) & (F.shiftrightunsigned("h", shift) == F.col("_at")))
        hist = inside.groupBy("source", "_left", F.shiftrightunsigned("h", shift - LEVEL_BITS).alias("_bucket")).agg(F.sum("size").alias("_n"))
        upto = F.sum("_n").over(Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))
        crossing = hist.withColumn("_upto", upto).filter("_upto > _left")
        first = crossing.groupBy("source").agg(F.min(F.struct("_bucket", "_upto", "_n", "_left")).alias("x"))
        open_ = saved(first.select("source", (F.col("x._left") - F.col("x._upto") + F.col("x._n")).alias("_left"), F.col("x._bucket").alias("_at"), F.col("x._n").alias("_n")), "boundary")
        last, open_ = open_, open_.drop("_n")
    # the document on the boundary is taken if that brings the sum nearer to the budget
    return last.select("source", (F.col("_at") + F.when(F.col("_left") * 2 > F.col("_n"), 1).otherwise(0)).alias("below"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each row of docs: `row` (all its columns), source, size, source_size, target, taken.

    taken: the words the mix takes, size times the number of repeats (0 to most). A null or empty text has size 0 and
    is never taken; a null source is a source of its own, last in order; a source without words has target 0. Rows that
    repeat id and text share a hash and are taken together. Reruns agree: the hash depends on id and text alone.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    h = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), text)), 1, HASH_BITS // 4), 16, 10).cast("long")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), h.alias("h"))
    sized = saved(rows.select("source", "size", "h"), "sizes")
    budget = F.floor("target")
    sources = saved(
        targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", (budget - F.col("whole") * F.col("source_size")).cast("long")),
        "budgets",
    )
    limits = thresholds(sized, sources).withColumnRenamed("source", "_s")
    plan = sources.join(limits, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").withColumnRenamed("source", "_s")
    out = rows.join(saved(plan, "plan"), F.col("source").eqNullSafe(F.col("_s")), "left")
    times = F.col("whole") + F.when(F.col("h") < F.col("below"), 1).otherwise(0)
    return out.select("row", "source", "size", "source_size", "target", (F.col("size") * times).alias("taken"))


def op3_query(docs: DataFrame) -> DataFrame:
    return mix(docs).select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 12) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM s),
c AS (SELECT *, sum(3 * source_size) OVER a - 3 * source_size AS capped, sum(w) OVER () - sum(w) OVER a + w AS open_w, sum(source_size) OVER () AS total
  FROM w WINDOW a AS (ORDER BY 3 * source_size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
lv AS (SELECT max((total - capped)::DOUBLE / open_w::DOUBLE) AS level FROM c WHERE (total - capped)::DOUBLE / open_w::DOUBLE * w <= 3 * source_size),
t AS (SELECT source, source_size, CASE WHEN level * w > 3 * source_size THEN CAST(3 * source_size AS DOUBLE) ELSE level * w END AS target FROM w, lv),
b AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS whole,
  CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) % source_size ELSE 0 END AS rest FROM t),
g AS (SELECT source, h, CAST(sum(size) AS BIGINT) AS n FROM d GROUP BY source, h),
u AS (SELECT *, CAST(sum(n) OVER (PARTITION BY source ORDER BY h) AS BIGINT) AS upto FROM g),
m AS (SELECT u.source, u.h, u.upto, u.n, CASE WHEN upto <= rest THEN true WHEN upto - n <= rest THEN 2 * (rest - upto + n) > n ELSE false END AS more
  FROM u JOIN b ON u.source IS NOT DISTINCT FROM b.source)
SELECT d.doc_id, d.size, b.source_size, b.target, CAST(d.size * (b.whole + CASE WHEN m.more AND b.rest > 0 THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN m ON d.source IS NOT DISTINCT FROM m.source AND d.h = m.h
"""
