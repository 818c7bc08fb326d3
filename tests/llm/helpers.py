"""Small tables and brute-force versions for the tests."""

from __future__ import annotations

import os
import re
from collections import defaultdict

import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PAGES = "page_id long, url string, html string"


def needs_data():
    if not os.path.isdir(SF):
        pytest.skip("no test data")


def docs(spark, rows):
    """rows of (doc_id, text[, lang[, source[, n_chars]]])."""
    return spark.createDataFrame([tuple(r) + (None,) * (5 - len(r)) for r in rows], DOCS)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < width else [tuple(words[i:i + width]) for i in range(len(words) - width + 1)])


def near_components(texts, width, percent=80):
    """doc id to the smallest id it reaches, by comparing all pairs."""
    sets = {d: shingles(t, width) for d, t in texts.items()}
    links = defaultdict(set)
    by_shingle = defaultdict(set)
    for d, s in sets.items():
        for x in s:
            by_shingle[x].add(d)
    for d, s in sets.items():
        for e in set().union(*[by_shingle[x] for x in s]) if s else ():
            both = len(s & sets[e])
            if e != d and 100 * both >= percent * (len(s) + len(sets[e]) - both):
                links[d].add(e)
    out = {}
    for d in sorted(sets):
        if d not in out:
            todo, out[d] = [d], d
            while todo:
                for e in links[todo.pop()]:
                    if e not in out:
                        out[e] = d
                        todo.append(e)
    return out, {d: len(s) for d, s in sets.items()}
