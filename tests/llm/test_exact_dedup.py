import hashlib

from codeloom.llm import exact_dedup
from tests.llm.helpers import docs, rows


def test_nulls_ties_and_repeated_rows(spark):
    df = docs(spark, [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (5, "b"), (None, "b"), (None, "c"), (None, "c"), (7, "x" * 300_000)])
    got = exact_dedup.mark_copies(df)
    assert rows(got, "id", "keep_id", "group_size", "kept") == sorted([
        (1, 2, 2, False), (2, 2, 2, True), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 3, True), (5, 5, 3, True), (None, 5, 3, False),
        (None, None, 2, True), (None, None, 2, True), (7, 7, 1, True)], key=repr)
    assert {r.digest for r in got.filter("id = 3").collect()} == {hashlib.sha256(b"").hexdigest()}
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns
    assert rows(kept, "doc_id") == sorted([(2,), (4,), (5,), (None,), (7,)], key=repr)


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a", True, 3), (2, "a", False, 4)], "doc_id long, text string, kept boolean, _size int")
    assert rows(exact_dedup.drop_copies(df), "doc_id", "kept", "_size") == [(2, False, 4)]
    assert exact_dedup.drop_copies(df.limit(0)).count() == 0


def test_hot_group_over_many_rows(spark):
    df = spark.range(6000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN concat('pair', id div 100) ELSE concat('t', id) END AS text")
    want = {}
    for r in df.collect():
        want.setdefault(r.text, []).append(r.doc_id)
    got = {r.id: (r.keep_id, r.group_size) for r in exact_dedup.mark_copies(df).select("id", "keep_id", "group_size").collect()}
    assert got == {d: (max(ids), len(ids)) for ids in want.values() for d in ids}


def test_filter_lets_every_repeated_key_pass(spark):
    keys = spark.range(4000).selectExpr("id", "concat('k', id % 3500) AS k")
    bits, blocks = exact_dedup.repeat_filter(keys, "k", 4000)
    marked = exact_dedup.maybe_repeated(keys, "k", bits, blocks).groupBy("k").agg({"_maybe": "min", "id": "count"}).collect()
    assert all(r["min(_maybe)"] for r in marked if r["count(id)"] > 1)
    assert sum(r["min(_maybe)"] for r in marked if r["count(id)"] == 1) < 300


def test_drop_keys(spark):
    df = spark.range(100).selectExpr("id AS k", "id * 2 AS v")
    assert rows(exact_dedup.drop_keys(df, spark.range(0, 100, 3).selectExpr("id AS k"), "k"), "k") == sorted([(i,) for i in range(100) if i % 3], key=repr)
    assert exact_dedup.drop_keys(df, df.select("k").limit(0), "k").count() == 100
