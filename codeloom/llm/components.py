"""Connected components of a table of links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codeloom.llm.common import attach, saved


def _smallest(edges: DataFrame) -> DataFrame:
    """Each node with the smallest of itself and its neighbours (u, m), and the number of its edges."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("degree"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one smaller node that itself hangs on none."""
    rows = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("hangs"), F.lit(0).alias("bears")), F.struct(F.col("v").alias("x"), F.lit(0).alias("hangs"), F.lit(1).alias("bears")))).alias("e"))
    return rows.groupBy("e.x").agg(F.sum("e.hangs").alias("hangs"), F.max("e.bears").alias("bears")).filter("hangs > 1 OR hangs = 1 AND bears = 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """links (a, b) to (id, component): every linked node with the smallest node it reaches.

    Each round turns the neighbourhoods into stars around smaller nodes until only stars are left; every neighbourhood
    is only folded to its minimum, and nodes that hold many of the edges are broadcast instead of shuffled.
    """
    edges = saved(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = attach(both, saved(_smallest(both), "stars"), "u", "degree", 2 * edges.count(), "inner").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = saved(large.filter("u <> v").distinct(), "large")
        stars = saved(_smallest(large), "stars")
        small = attach(large, stars, "u", "degree", large.count(), "inner").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = saved(small.unionByName(stars.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "edges")
    leaves = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return leaves.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
