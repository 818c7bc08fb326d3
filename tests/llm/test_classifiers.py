import itertools
import zlib

import numpy as np

from codeloom.llm import langid, queries, quality_fm
from tests.llm.helpers import SF, docs, needs_data


def test_margins_are_those_of_all_pairs():
    m = quality_fm.Machine(0.3)
    m.weights = np.random.default_rng(0).normal(size=quality_fm.SIZE)
    made = [quality_fm.features(t, n, quality_fm._Bins()) for t, n in ((b"a b b c", 7.0), (b"", None), (b"x| y!", -1.0), (None, float("nan")))]
    got, _ = m.margins(*quality_fm.laid_out(made))
    for (entries, values), margin in zip(made, got):
        pairs = sum(m.factors[i] @ m.factors[j] * x * y for (i, x), (j, y) in itertools.combinations(list(zip(entries, values)), 2))
        assert np.isclose(margin, 0.3 + m.weights[entries] @ values + pairs)


def test_quality_on_held_out_rows(spark):
    needs_data()
    sf = SF.replace("0.001", "0.01")
    got = {r.doc_id: r for r in queries.QUERIES["op2_quality"](spark, sf).collect()}
    truth = [(got[r.doc_id], r.quality) for r in queries.table(spark, sf, "labels").collect()]
    held = [(g, q) for g, q in truth if g.held_out]
    assert all(g.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= g.score <= 1 and g.predicted == int(g.score >= 0.3) for d, g in got.items())
    assert np.mean([g.predicted == q for g, q in held]) > 0.93
    ones, zeros = ([g.score for g, q in held if q == k] for k in (1, 0))
    assert np.mean([a > b for a in ones for b in zeros]) > 0.98


def test_quality_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (None, 1, 0), (4, None, 0), (5, 7, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    df = docs(spark, [(1, "good words here"), (2, None), (2, ""), (None, "x"), (6, "y " * 200_000)])
    machine = quality_fm.train(df, labels)
    assert quality_fm.scored(df, machine).filter("score BETWEEN 0 AND 1").count() == 5
    assert quality_fm.scored(df.drop("n_chars"), machine).count() == 5
    assert quality_fm.scored(df.limit(0), quality_fm.train(df.limit(0), labels.limit(0))).count() == 0
    assert quality_fm.keep_good(df, labels).columns == df.columns


def test_language_on_held_out_rows(spark):
    needs_data()
    sf = SF.replace("0.001", "0.01")
    lang = {r.doc_id: r.lang for r in queries.table(spark, sf, "documents").collect()}
    got = queries.QUERIES["op8_language"](spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in got if r.held_out]) > 0.98


def test_language_edges(spark):
    rows = [(i, ("the cat and the dog " if i % 2 else "der hund und die katze ") * 5, "en" if i % 2 else "de") for i in range(60)]
    df = docs(spark, rows + [(100, None, "en"), (101, "", "en"), (102, "12 !?", "de"), (103, "the dog", None), (None, "der hund", "xx"), (104, "KATZE " * 100_000, "de")]).withColumnRenamed("source", "score")
    model = langid.train(df)
    assert model.languages == ["de", "en"] and (model.weights == 0).mean() > 0.9
    got = {r.id: r for r in langid.identify(df, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 100, 101, 102, 103, None, 104)] == ["en", "de", "und", "und", "und", "en", "de", "de"]
    assert all(0 <= r.score <= 1 for r in got.values())
    nothing = langid.train(df.limit(0))
    assert {r.lang_pred for r in langid.identify(df, nothing).collect()} == {"und"}
    assert langid.identify(df.limit(0), model).count() == 0


def test_document_frequencies_count_all_rows(spark):
    texts = ["aa b", "a", "", None, "7"]
    seen, n = langid._document_frequencies(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    want = sum((langid.counts(t) > 0).astype(int) for t in texts[:2])
    assert n == 2 and (seen == want).all()


def test_training_rows_reach_the_driver_as_bytes(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality_fm.Machine, "fit", lambda self, rows, y: seen.extend(rows) or self)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    quality_fm.train(docs(spark, [(i, f"some words of text {i}") for i in range(40)]), labels)
    assert seen and all(isinstance(a.base, bytes) for row in seen for a in row)
    entries, values = quality_fm.features(b"some words of text 1", None, quality_fm._Bins())
    assert any(e.tolist() == entries.tolist() and np.allclose(v, values) for e, v in seen)
