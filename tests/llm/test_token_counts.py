import os
import random

import pytest

from codeloom.llm import token_counts as tc
from tests.llm.helpers import SF, docs, needs_data, rows

public_tokenizers = pytest.importorskip("public_tokenizers")


def library(name="byte_bpe_50k.json"):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def test_all_documents_against_the_library(spark):
    needs_data()
    table = spark.read.parquet(os.path.join(SF, "documents.parquet"))
    got = {r.id: r for r in tc.count_tokens(table, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    texts = {r.doc_id: r.text or "" for r in table.collect()}
    want = dict(zip(texts, library()(list(texts.values()))))
    assert {i: r.n_tokens for i, r in got.items()} == want
    assert all(r.n_bytes == len(texts[i].encode()) and r.over_limit == (r.n_tokens > 1024) and r.n_whole <= r.n_tokens for i, r in got.items())


def test_odd_texts_against_the_library():
    rng = random.Random(5)
    pools = ["ab c", "it's they'LL 12 ½²x\t\n\r\x0b\x85  ", "äöüßéλж漢字かな한글", "\U0001f600\U0001f468‍\U0001f469 é", "<|endoftext|>", "".join(chr(rng.randrange(0x80, 0x110000 - 0x800)) for _ in range(0)) + "͸�ᲉꟚ\U00010d4a"]
    texts = ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += ["<|endoftext|>", " <|endoftext|> a<|endoftext|><|endoftext|>b", "<|endoftext", "a" * 5000, " " * 3000 + "x", "\n" * 2000, "é" * 4000, "=-" * 3000, ""]
    counter = tc.Counter(tc.vocabulary(public_tokenizers.path("byte_bpe_50k.json")))
    assert [counter.count(t)[0] for t in texts] == library()(texts)


def test_every_proved_string_is_one_token():
    known = tc.vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    proved = sorted(known.whole)
    assert len(proved) > 40_000
    counter, count = tc.Counter(known), library()
    alone = [t for t in proved if known.specials[0] not in t]
    assert [counter.count(t)[0] for t in alone] == count(alone)


def test_nulls_repeats_and_clashing_columns(spark):
    df = docs(spark, [(1, None), (1, "one two"), (1, "one two"), (None, ""), (2, "x " * 600_000)]).selectExpr("*", "1 AS id", "2 AS n_tokens", "'r' AS row")
    got = tc.count_tokens(df, public_tokenizers.path("byte_bpe_50k.json"))
    long = library()(["x " * 600_000])[0]
    assert rows(got, "id", "n_bytes", "n_tokens", "over_limit") == sorted([(1, 0, 0, False), (1, 7, 2, False), (1, 7, 2, False), (None, 0, 0, False), (2, 1_200_000, long, True)], key=repr)
    assert tc.count_tokens(docs(spark, []), public_tokenizers.path("byte_bpe_50k.json")).count() == 0
