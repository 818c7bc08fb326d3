"""Rows that the near-duplicate search joins by id."""

from __future__ import annotations

from codeloom.llm import lsh_forest


def test_one_prefix_row_for_each_set(spark):
    sets = spark.createDataFrame([(i, [100 * i + j for j in range(50)] + [7]) for i in range(12)], "id long, shingles array<long>")
    of = spark.createDataFrame([(i, i) for i in range(12)], "id long, label long")
    prefixes = lsh_forest._prefixes(sets, 80)
    rows = {r["id"]: r for r in prefixes.collect()}
    assert prefixes.count() == len(rows) == 12
    assert all(r["n"] == 51 and len(r["keys"]) == 51 - 41 + 1 and 7 not in r["keys"] for r in rows.values())
    assert lsh_forest._open_prefixes(prefixes, of).isEmpty()
    linked = spark.createDataFrame([(1, list(range(20))), (2, list(range(19)) + [99])], "id long, shingles array<long>")
    opened = lsh_forest._open_prefixes(lsh_forest._prefixes(linked, 80), of)
    assert {(r["id"], r["place"], r["label"]) for r in opened.collect()} >= {(1, 1, 1), (2, 1, 2)}
