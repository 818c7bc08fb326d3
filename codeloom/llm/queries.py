"""Registered queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import arc_convert, decontaminate, exact_dedup, html_marginals, langid, license_scan, lsh_forest, mixing, prefix_trie, quality_fm, token_counts, url_filter, whitening
from codeloom.llm.common import ship

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def on(fn: Callable[..., DataFrame], *names: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(*[table(spark, sf_dir, name) for name in names])

    return run


QUERIES: dict[str, Query] = {
    "op1_url_filter": on(url_filter.op1_query, "pages"),
    "op2_quality": on(quality_fm.op2_query, "documents", "labels"),
    "op3_mixing": on(mixing.op3_query, "documents"),
    "op4_license_scan": on(license_scan.op4_query, "documents"),
    "op5_near_dedup": on(lsh_forest.op5_query, "documents"),
    "op6_main_text": on(html_marginals.op6_query, "pages"),
    "op7_decontamination": on(decontaminate.op7_query, "documents", "benchmark"),
    "op8_language": on(langid.op8_query, "documents"),
    "op9_exact_dedup": on(exact_dedup.op9_query, "documents"),
    "op10_arc_to_warc": on(arc_convert.op10_query, "pages"),
    "op11_whitening": on(whitening.op11_query, "embeddings"),
    "op12_prefix_trie": on(prefix_trie.op12_query, "conversations"),
    "op13_token_counts": on(token_counts.op13_query, "documents"),
}

ORACLES: dict[str, str] = {
    "op1_url_filter": url_filter.OP1_SQL,
    "op3_mixing": mixing.OP3_SQL,
    "op9_exact_dedup": exact_dedup.OP9_SQL,
    "op10_arc_to_warc": arc_convert.OP10_SQL,
    "op12_prefix_trie": prefix_trie.OP12_SQL,
}
