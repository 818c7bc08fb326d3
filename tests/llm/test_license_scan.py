import random

import numpy as np

from codeloom.llm import license_scan as ls
from tests.llm.helpers import docs


def scan(text):
    a = ls._default()
    return a.scan(np.array([a.ids.get(w, -1) for w in ls.words_of(text)], np.int64))


def brute_base(words):
    hits, labels = [], set()
    for phrase, label in ls.BASE_PHRASES:
        p = phrase.encode().split()
        at = [i for i in range(len(words)) if words[i:i + len(p)] == p]
        hits += at
        labels |= {label} if at else set()
    return len(hits), min(hits, default=None), max(hits, default=None), ",".join(sorted(labels))


def test_matching_statistics_and_base_phrases_against_brute_force():
    rng = random.Random(4)
    pool = sorted({w for t in [t for _, t in ls.TEMPLATES] + [p for p, _ in ls.BASE_PHRASES] for w in ls.words_of(t)})
    texts = [ls.words_of(t) for _, t in ls.TEMPLATES] + [p.encode().split() for p, _ in ls.BASE_PHRASES]
    inside = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    a = ls._default()
    for _ in range(60):
        words = []
        while len(words) < 60:
            t = rng.choice(texts)
            i = rng.randrange(len(t))
            words += rng.choice((t[i:i + rng.randint(1, 9)], [rng.choice(pool)], [b"mit", b"license", b"cc", b"by"]))
        ids = [a.ids[w] for w in words]
        for at, (place, _, length) in enumerate(a.statistics(ids, 0)):
            want = next(n for n in range(at + 1, -1, -1) if n == 0 or tuple(words[at - n + 1:at + 1]) in inside)
            assert (place, length) == (at, want)
        got = scan(b" ".join(words).decode())
        assert (got["n_base"], got["first_word"], got["last_word"], got["base_labels"]) == brute_base(words)


def test_whole_and_torn_templates():
    for label, text in ls.TEMPLATES:
        got = scan("foo bar " + text + " baz")
        assert label in got["labels"].split(","), label
        assert any(s["label"] == label and s["share"] == 1 for s in got["spans"])
    mit = ls.TEMPLATES[0][1].split()
    torn = " ".join(mit[:40] + ["inserted", "words"] + mit[42:])
    assert "mit" in scan(torn)["labels"]
    assert scan(" ".join(mit[:20]))["labels"] == ""
    assert [s["label"] for s in scan(f"{ls.TEMPLATES[0][1]} foo {ls.TEMPLATES[0][1]}")["spans"]] == ["mit", "mit"]


def test_words_and_edges(spark):
    assert ls.words_of("Ab-c É9\x7fx_y") == [b"ab", b"c", "É9".encode(), b"x", b"y"]
    df = docs(spark, [(1, None), (2, ""), (3, "The MIT-License! CC by, apache licensee"), (3, "x"), (None, "cc\nby"), (5, "gnu " * 200_000 + "general public license")]).withColumnRenamed("lang", "labels")
    got = {(r.id, r.n_words): r for r in ls.license_scan(df).collect()}
    assert got[1, 0].labels == got[2, 0].labels == "" and got[1, 0].first_word is None and got[1, 0].score == 0
    assert (got[3, 7].n_base, got[3, 7].first_word, got[3, 7].last_word, got[3, 7].base_labels) == (2, 1, 3, "cc-by,mit")
    assert got[None, 2].base_labels == "cc-by" and got[5, 200_003].first_word == 199_999
    assert ls.license_scan(df.limit(0)).count() == 0
