"""Registry of queries and their oracles over the given tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeloom.plans import fixtures
from codeloom.session import cut_lineage

Query = Callable[["Data"], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_SPARK_VIEWS = {**fixtures.VIEWS, "sentences": fixtures.SENTENCES_SPARK, "doc_words": fixtures.WORDS_SPARK}
_DUCK_VIEWS = {**fixtures.VIEWS, "sentences": fixtures.SENTENCES_DUCK, "doc_words": fixtures.WORDS_DUCK}
_frames: dict[tuple, DataFrame] = {}


class Data:
    """The given tables and the views on them, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._stored: dict[str, DataFrame] = {}

    def stored(self, name: str) -> DataFrame:
        """A view written once for a query that reads it many times."""
        if name not in self._stored:
            self._stored[name] = cut_lineage(self(name))
        return self._stored[name]

    def __call__(self, name: str) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, id(self.spark), self.sf_dir, name)
        if key not in _frames:
            if name in fixtures.BASE_TABLES:
                frame = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
                if name == "documents":
                    frame = spread(frame)
            else:
                sql = _SPARK_VIEWS[name]
                for other in _mentioned(sql, _SPARK_VIEWS):
                    self(other).createOrReplaceTempView(other)
                for table in fixtures.BASE_TABLES:
                    if re.search(rf"\b{table}\b", sql):
                        self(table).createOrReplaceTempView(table)
                frame = self.spark.sql(sql)
                if name.endswith("_lines"):
                    # a generator keeps filters on `line` from being rewritten into copies of its long expression
                    frame = frame.select(F.inline(F.array(F.struct(*frame.columns))))
            _frames[key] = frame
        return _frames[key]


def spread(frame: DataFrame) -> DataFrame:
    """Rows dealt over `spark.codeloom.input.partitions`, a setting of local sessions only; else as they are read."""
    n = frame.sparkSession.conf.get("spark.codeloom.input.partitions", None)
    return frame.repartition(int(n)) if n else frame


def _mentioned(sql: str, views: dict[str, str]) -> list[str]:
    return [v for v in views if re.search(rf"\b(?:FROM|JOIN)\s+{v}\b", sql, re.IGNORECASE)]


def with_views(sql: str) -> str:
    """Prefix an oracle with the views it reads, each after the views it needs."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for view in _mentioned(text, _DUCK_VIEWS):
            if view not in ordered:
                visit(_DUCK_VIEWS[view])
                ordered.append(view)

    visit(sql)
    if not ordered:
        return sql
    prelude = ",\n".join(f"{v} AS ({_DUCK_VIEWS[v]})" for v in ordered)
    body = sql.strip()
    if re.match(r"(?i)with\s+recursive\b", body):
        return f"WITH RECURSIVE {prelude},\n" + re.sub(r"(?i)^with\s+recursive\s+", "", body)
    if re.match(r"(?i)with\b", body):
        return f"WITH {prelude},\n" + re.sub(r"(?i)^with\s+", "", body)
    return f"WITH {prelude}\n{body}"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL that must give the same rows."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register


def bound(fn: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # regex flavour and literals below assume the default SQL dialect settings
        return fn(Data(spark, sf_dir))

    run.__name__ = fn.__name__
    return run


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from codeloom.plans import suites

    suites.load()
    return {name: bound(fn) for name, fn in QUERIES.items()}


def all_oracles() -> dict[str, str]:
    from codeloom.plans import suites

    suites.load()
    return dict(ORACLES)
