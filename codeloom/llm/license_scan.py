"""Licence scans with a generalised suffix automaton of licence texts.

The automaton holds the words of all templates. A file's words are streamed through it, which yields the matching
statistics: at each word the longest match that ends there. Matches that cannot be extended are chained, per template,
into spans in file and template order; a span that covers enough of its template gives the template's label. The base
phrases are templates as well: a phrase ends at a word if its state lies on the suffix path of the match there.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Phrases of the contract and their labels.
BASE_PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Public licence notices and the label each gives.
TEMPLATES = (
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software."""),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
later version."""),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser
General Public License as published by the Free Software Foundation"""),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list
of conditions and the following disclaimer."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
MPL was not distributed with this file, You can obtain one at"""),
    ("mit", "Released under the MIT License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("public-domain", "This is free and unencumbered software released into the public domain"),
)

#: Shortest match that is chained (or the whole template if it has fewer words), gap in words between two matches of a
#: span, and the share of a template that a span must cover.
LEAST_MATCH, MOST_GAP, LEAST_SHARE = 4, 12, 0.75

SCAN = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,last:long,share:double>>"


def words_of(text: str | bytes | None) -> list[bytes]:
    """The words of a text with A-Z lower-cased; bytes are taken as UTF-8."""
    return WORDS.findall((text.encode() if isinstance(text, str) else text or b"").lower())


class Automaton:
    """Suffix automaton of several word sequences."""

    def __init__(self, phrases=BASE_PHRASES, templates=TEMPLATES):
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        self.labels = [label for label, _ in templates]
        self.phrases = [label for _, label in phrases]
        texts = [[self.ids.setdefault(w, len(self.ids)) for w in words_of(t)] for _, t in templates]
        sought = [[self.ids.setdefault(w, len(self.ids)) for w in words_of(p)] for p, _ in phrases]
        if any(len(words) < 2 for words in [*texts, *sought]):
            raise ValueError("templates and phrases need two words or more")
        self.sizes = [len(t) for t in texts]
        for k, words in enumerate([*texts, *sought]):
            last = 0
            for i, word in enumerate(words):
                last = self._extend(last, word)
                if k < len(texts):
                    self.ends[last].add((k, i))
        order = sorted(range(1, len(self.next)), key=lambda s: -self.length[s])
        for s in order:  # an occurrence of a string is one of all its suffixes
            if self.link[s] > 0:
                self.ends[self.link[s]] |= self.ends[s]
        own: dict[int, list[int]] = defaultdict(list)
        for p, words in enumerate(sought):
            state = 0
            for word in words:
                state = self.next[state][word]
            own[state].append(p)
        self.size_of = [len(words) for words in sought]
        self.hits: list[list[int]] = [[] for _ in self.next]  # phrases on the suffix path, the state's own first
        for s in reversed(order):
            self.hits[s] = own[s] + (self.hits[self.link[s]] if self.link[s] > 0 else [])
        self.pairs = np.zeros((len(self.ids), len(self.ids)), bool)
        for words in [*texts, *sought]:
            self.pairs[words[:-1], words[1:]] = True

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            q = self.next[last][word]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, word, q)
        state = self._state(self.length[last] + 1, {})
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = state
            p = self.link[p]
        if p < 0:
            self.link[state] = 0
        else:
            q = self.next[p][word]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._clone(p, word, q)
        return state

    def _state(self, length: int, to: dict[int, int]) -> int:
        self.next.append(to)
        self.length.append(length)
        self.link.append(0)
        self.ends.append(set())
        return len(self.next) - 1

    def _clone(self, p: int, word: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[copy], self.link[q] = self.link[q], copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def statistics(self, ids: list[int], start: int) -> Iterator[tuple[int, int, int]]:
        """(place, state, length) of the longest match that ends at each word of a run of known words."""
        state = length = 0
        for place, word in enumerate(ids, start):
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            else:
                state = length = 0
            yield place, state, length

    def scan(self, ids: np.ndarray) -> dict:
        """The columns of SCAN for a sequence of word ids, -1 for words in no template."""
        base, found, matches = [], set(), defaultdict(list)
        for first, last in self._runs(ids):
            run = ids[first:last + 1].tolist()
            before = (0, 0, 0)
            for place, state, length in [*self.statistics(run, first), (last + 1, 0, 0)]:
                if length != before[2] + 1 and before[2] > 1:
                    self._note(matches, *before)
                for p in self.hits[state]:
                    if self.size_of[p] <= length:
                        base.append(place - self.size_of[p] + 1)
                        found.add(self.phrases[p])
                before = (place, state, length)
        spans = [s for k, m in matches.items() for s in self._chains(k, m)]
        labels = sorted(found | {s[0] for s in spans})
        score = 1.0 if base else max((s[3] for s in spans), default=0.0)
        return {
            "n_words": len(ids), "n_base": len(base), "first_word": min(base, default=None), "last_word": max(base, default=None),
            "base_labels": ",".join(sorted(found)), "labels": ",".join(labels), "score": score,
            "spans": [dict(zip(("label", "first", "last", "share"), s)) for s in sorted(spans, key=lambda s: (s[1], s[2], s[0]))],
        }

    def _runs(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches in which every two neighbours follow each other in some template; matches lie within them."""
        if len(ids) < 2:
            return
        known = (ids[:-1] >= 0) & (ids[1:] >= 0)
        known[known] = self.pairs[ids[:-1][known], ids[1:][known]]
        edges = np.diff(np.concatenate(([0], known.view(np.int8), [0])))
        yield from zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist())

    def _note(self, matches: dict, place: int, state: int, length: int) -> None:
        for k, end in self.ends[state]:
            if length >= min(LEAST_MATCH, self.sizes[k]):
                matches[k].append((place - length + 1, end - length + 1, length))

    def _chains(self, k: int, matches: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, int, float]]:
        """Disjoint spans of one template: best chains by covered words, read from their ends backwards."""
        matches.sort()
        best: list[tuple[int, int]] = []  # covered words of the best chain that ends here, its first word
        for j, (at, there, n) in enumerate(matches):
            covered, first = n, at
            for i in range(j - 1, -1, -1):
                a, t, m = matches[i]
                if a + m + MOST_GAP < at:
                    if a + self.sizes[k] + MOST_GAP < at:
                        break
                    continue
                shared = max(0, a + m - at, t + m - there)  # matches may overlap by a few words
                if t < there and a < at and shared < n and best[i][0] + n - shared > covered:
                    covered, first = best[i][0] + n - shared, best[i][1]
            best.append((covered, first))
        taken = float("inf")
        for j in sorted(range(len(matches)), key=lambda j: (-matches[j][0] - matches[j][2], -best[j][0])):
            last = matches[j][0] + matches[j][2] - 1
            share = min(1.0, best[j][0] / self.sizes[k])
            if share >= LEAST_SHARE and last < taken:
                yield self.labels[k], best[j][1], last, share
                taken = best[j][1]


class _WordIds(dict):
    """Ids of words, -1 for those in no template; emptied of the latter when it has grown large."""

    def __init__(self, known: dict[bytes, int]):
        super().__init__(known)
        self.known = known

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
            self.update(self.known)
        self[word] = -1
        return -1


@lru_cache(maxsize=1)
def _default() -> Automaton:
    return Automaton()


def scan_text(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """The columns of SCAN for texts in UTF-8; null counts as empty."""
    automaton = _default()
    ids = _WordIds(automaton.ids)
    for series in texts:
        rows = []
        for text in series:
            words = words_of(text)
            rows.append(automaton.scan(np.fromiter(map(ids.__getitem__, words), np.int64, len(words))))
        out = pd.DataFrame(rows, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])
        yield out.astype({"first_word": "Int64", "last_word": "Int64"})


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: `row` (all its columns), id, and the columns of SCAN.

    Null and empty texts have no words, labels '' and score 0; repeated rows are scanned each. score is 1 where a base
    phrase stands, else the largest covered share of a template.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.pandas_udf(scan_text, SCAN)(F.col(text_col).cast("binary")).alias("_s"))
    return rows.select("row", "id", "_s.*")


def op4_query(docs: DataFrame) -> DataFrame:
    scanned = license_scan(docs)
    return scanned.select(F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
