import pytest

from codeloom.llm import mixing
from tests.llm.helpers import docs, rows


def test_targets_are_capped_and_reshared(spark):
    # weights 5, 2, 1 of 1000 words: a would get 625 but holds 100
    df = docs(spark, [(i, "w " * 10, "en", "a") for i in range(10)] + [(100 + i, "w " * 10, "en", "b") for i in range(40)] + [(200 + i, "w " * 10, "en", None) for i in range(50)])
    got = {r.source: r for r in mixing.mix(df).groupBy("source").agg({"target": "max", "taken": "sum", "source_size": "max"}).collect()}
    assert got["a"]["max(target)"] == 300.0 and got["a"]["sum(taken)"] == 300
    assert got["b"]["max(target)"] == pytest.approx(1400 / 3) and abs(got["b"]["sum(taken)"] - 1400 / 3) <= 10
    assert got[None]["max(target)"] == pytest.approx(700 / 3) and abs(got[None]["sum(taken)"] - 700 / 3) <= 10


def test_budgets_nest_and_reruns_agree(spark):
    df = docs(spark, [(i, "w " * (i % 17), "en", f"s{i % 2}") for i in range(400)])
    small, large = (mixing.mix(df, share=x).selectExpr("row.doc_id AS d", "taken") for x in (0.3, 0.6))
    assert small.join(large.withColumnRenamed("taken", "t"), "d").filter("taken > t").count() == 0
    assert rows(small, "d", "taken") == rows(mixing.mix(df, share=0.3).selectExpr("row.doc_id AS d", "taken"), "d", "taken")


def test_empty_texts_repeated_rows_and_names(spark):
    df = docs(spark, [(1, None, "en", "a"), (2, "", "en", "a"), (3, "x y", "en", "b"), (3, "x y", "en", "b"), (None, "  z", "en", "c")]).withColumnRenamed("lang", "size")
    got = rows(mixing.mix(df).selectExpr("row.doc_id AS d", "size", "source_size", "taken", "target"), "d", "size", "source_size")
    assert got == sorted([(1, 0, 0), (2, 0, 0), (3, 2, 4), (3, 2, 4), (None, 2, 2)], key=repr)
    assert mixing.mix(df.limit(0)).count() == 0


def test_ranks(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("é",), ("Z",)], "source string")
    assert rows(mixing.ranked(df, "source"), "source", "rank") == sorted([("Z", 0), ("a", 1), ("b", 2), ("é", 3), (None, 4)], key=repr)
