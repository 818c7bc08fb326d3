from collections import defaultdict

import pytest

import corpus_pipeline
from codeloom.llm import quality_fm, queries
from codeloom.llm.decontaminate import _TOKEN
from tests.llm.helpers import SF, docs, near_components, needs_data


def test_stages_against_brute_force(spark):
    needs_data()
    documents = queries.table(spark, SF, "documents")
    machine = quality_fm.train(documents, queries.table(spark, SF, "labels"))
    texts = {r.id: r.text for r in quality_fm.scored(documents, machine).filter(f"score >= {quality_fm.ACCEPT}").select("id", "row.text").collect()}
    same = defaultdict(list)
    for d, t in texts.items():
        same[t or ""].append(d)
    texts = {max(ids): texts[max(ids)] for ids in same.values()}
    component, _ = near_components(texts, 5)
    texts = {d: t for d, t in texts.items() if component[d] == d}
    cut = lambda w: {tuple(w[i:i + 8]) for i in range(len(w) - 7)}
    word = lambda t: [w.lower() for w in _TOKEN.findall(t or "")]
    bench = set().union(*[cut(word(r.text)[1:]) for r in queries.table(spark, SF, "benchmark").collect()])
    texts = {d: t for d, t in texts.items() if not cut(word(t)) & bench}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} <= set(texts)
    source = {r.doc_id: r.source for r in documents.collect()}
    size = defaultdict(int)
    for d, t in texts.items():
        size[source[d]] += len(t.split())
    names = sorted(size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    level, capped = sum(size.values()) / sum(weight.values()), set()
    while more := {s for s in names if level * weight[s] > 3 * size[s]} - capped:
        capped |= more
        level = (sum(size.values()) - 3 * sum(size[s] for s in capped)) / sum(weight[s] for s in names if s not in capped)
    taken = defaultdict(int)
    for r in got:
        assert r.mix_target == pytest.approx(3 * size[r.source] if r.source in capped else level * weight[r.source])
        assert r.mix_taken == r.mix_repeats * len(texts[r.doc_id].split()) and 1 <= r.mix_repeats <= 3
        taken[r.source] += r.mix_taken
    largest = max(len(t.split()) for t in texts.values())
    for s in names:
        assert abs(taken[s] - (3 * size[s] if s in capped else level * weight[s])) <= largest


def test_stages_keep_columns_and_take_odd_rows(spark, tmp_path):
    needs_data()
    odd = docs(spark, [(1, None), (None, ""), (3, "some words of a text"), (3, "some words of a text"), (4, "x " * 100_000, None, None, 200_000)]).withColumn("mix_taken", quality_fm.F.lit(1))
    for table in (odd, odd.limit(0)):
        current = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            current = stage(spark, current, SF)
            assert current.columns == odd.columns
        last = corpus_pipeline.STAGES[-1][1](spark, current, SF)
        assert set(corpus_pipeline.MIX) < set(last.columns)
        last.collect()


def test_texts_go_to_python_in_short_batches(spark):
    from codeloom.llm import common

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for given, want in (("10000", "1000"), ("0", "1000"), ("64", "64")):
            spark.conf.set(key, given)
            common.short_batches(spark)
            assert spark.conf.get(key) == want
        spark.conf.set(key, "10000")
        empty = docs(spark, [])
        corpus_pipeline.quality(spark, empty, SF)
        assert spark.conf.get(key) == "1000"
    finally:
        spark.conf.set(key, before)
