"""Five stages that turn documents into a training mix; each works on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs of
the next. All but the last return the columns of documents; the last adds the columns of MIX.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeloom.llm import decontaminate, exact_dedup, lsh_forest, mixing, quality_fm
from codeloom.llm.common import saved, ship, short_batches
from codeloom.llm.queries import table

#: Columns that the last stage adds; columns of the same names in docs give way to them.
MIX = ("mix_source_size", "mix_target", "mix_taken", "mix_repeats")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    ship(spark)
    short_batches(spark)
    return quality_fm.keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest id."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8), the one with the smallest id."""
    ship(spark)
    short_batches(spark)
    return lsh_forest.keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark."""
    ship(spark)
    short_batches(spark)
    return decontaminate.drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes once or more, with the target of their source, words taken and repeats."""
    mixed = mixing.mix(docs).filter("taken > 0")
    own = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in MIX]
    repeats = (F.col("taken") / F.col("size")).cast("int")
    return mixed.select(*own, F.col("source_size").alias(MIX[0]), F.col("target").alias(MIX[1]), F.col("taken").alias(MIX[2]), repeats.alias(MIX[3]))


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("MinHash near-dedup", near),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mix),
]

#: The first stage is a trained classifier, which SQL cannot express; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
