import random

import pytest

from codeloom.llm import components, lsh_forest
from tests.llm.helpers import SF, docs, near_components, needs_data, rows


def changed(rng, words, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(rng):
    texts, d = {}, 0
    for group in range(40):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((30, 120, 400)))]
        for _ in range(rng.choice((1, 2, 5))):
            texts[d := d + 1] = changed(rng, base, rng.choice((0, 1, 3, 8)))
    base = [f"w{rng.randrange(3000)}" for _ in range(300)]
    for _ in range(200):  # a crowded region
        texts[d := d + 1] = changed(rng, base, rng.choice((1, 4, 7, 9, 11)))
    return texts


@pytest.mark.parametrize("width", [4, 5])
def test_components_are_those_of_all_pairs(spark, width):
    texts = corpus(random.Random(width))
    want, sizes = near_components(texts, width)
    got = lsh_forest.near_duplicates(docs(spark, texts.items()), width)
    assert rows(got, "id", "n_shingles", "component_id", "kept") == sorted([(d, sizes[d], c, d == c) for d, c in want.items()], key=repr)


def test_a_hub_with_a_crowd_of_edited_copies(spark):
    rng = random.Random(8)
    hub = [f"w{i}" for i in range(300)]
    texts = {d: " ".join(w if rng.random() > 0.021 else f"new{d}-{i}" for i, w in enumerate(hub)) for d in range(1, 401)} | {277: " ".join(hub)}
    want, sizes = near_components(texts, 4)
    assert sum(c == want[277] for c in want.values()) > 250
    got = lsh_forest.near_duplicates(docs(spark, texts.items()), 4)
    assert rows(got, "id", "component_id") == sorted(want.items(), key=repr)


def test_pages_of_one_template(spark):
    rng = random.Random(9)
    frame, texts = [f"t{i}" for i in range(150)], {}
    for d in range(1, 301, 2):  # about 0.72 to each other, each with a partner that shares its own words
        own = [f"own{d}-{i}" for i in range(26)]
        texts[d], texts[d + 1] = " ".join(frame + own), changed(rng, frame + own, 3 if d % 4 == 1 else 8)
    want, sizes = near_components(texts, 4)
    assert len(set(want.values())) > 150
    got = lsh_forest.near_duplicates(docs(spark, texts.items()), 4)
    assert rows(got, "id", "component_id") == sorted(want.items(), key=repr)


def test_edge_cases(spark):
    df = docs(spark, [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one  TWO\n"), (9, "one two"), (9, "one two"), (None, "one two"), (None, "alone here"), (7, "É x"), (8, "é x")]).withColumnRenamed("lang", "rep")
    assert rows(lsh_forest.near_duplicates(df, 4), "id", "n_shingles", "component_id", "kept") == sorted([
        (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (9, 1, 4, False), (9, 1, 4, False), (None, 1, 4, False),
        (None, 1, None, True), (7, 1, 7, True), (8, 1, 8, True)], key=repr)
    assert rows(lsh_forest.keep_one_of_each(df, 4), "doc_id") == sorted([(1,), (2,), (3,), (4,), (None,), (None,), (7,), (8,)], key=repr)
    assert lsh_forest.near_duplicates(df.limit(0), 4).count() == 0


def test_long_texts(spark):
    words = [f"w{i % 7919}" for i in range(150_000)]
    df = docs(spark, [(1, " ".join(words)), (2, " ".join(words[:-40])), (3, " ".join(reversed(words)))])
    assert rows(lsh_forest.near_duplicates(df), "id", "component_id") == [(1, 1), (2, 1), (3, 3)]


def test_query_against_all_pairs(spark):
    needs_data()
    from codeloom.llm import queries

    texts = {r.doc_id: r.text for r in queries.table(spark, SF, "documents").collect()}
    want, sizes = near_components(texts, 4)
    got = queries.QUERIES["op5_near_dedup"](spark, SF)
    assert rows(got, "doc_id", "n_shingles", "component_id", "kept") == sorted([(d, sizes[d], c, d == c) for d, c in want.items()], key=repr)


def test_connected_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 400)] + [(501, 500), (502, 501), (500, 502), (7, 7), (900, 901), (900, 901)]
    got = dict(rows(components.components(spark.createDataFrame(links, "a long, b long")), "id", "component"))
    want = {i: 0 for i in range(61)} | {i: 100 for i in range(100, 400)} | {500: 500, 501: 500, 502: 500, 900: 900, 901: 900}
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
