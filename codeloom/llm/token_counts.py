"""Token counts by the whole-token shortcut.

A byte-level tokenizer cuts a text at its special strings, then into pre-tokens, and merges the bytes of each pre-token.
Offline, once for each vocabulary, every vocabulary string is merged alone: those that come out as the one token they name
are proved whole. In the texts, a pre-token that is a whole string counts 1 without any merging; only the rest is merged,
and merged counts are remembered. Texts stay where they are: there is no shuffle, and what is sent to the executors is the
vocabulary, of at most MAX_VOCABULARY strings.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable
from functools import lru_cache
from itertools import filterfalse, islice

import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

MAX_VOCABULARY = 2_000_000
#: Merged counts that a worker remembers; emptied when full.
REMEMBERED = 400_000
#: Pre-tokens of a text that are held at a time.
BLOCK = 100_000
#: Pre-tokens longer than this are merged with a heap.
SHORT = 32
SHIFT = 32

#: Fixed value: the pattern that byte-level vocabularies of this kind cut pre-tokens with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A letter, a number and another character on whose class all versions of Unicode agree.
_LETTER, _NUMBER, _OTHER = "\u00e9", "\u00b2", "\ue000"


def _byte_of() -> dict[str, str]:
    """The character that byte-level files write for a byte, to the character of that byte's value."""
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printed)]
    return {chr(b): chr(b) for b in printed} | {chr(256 + i): chr(b) for i, b in enumerate(others)}


class Vocabulary:
    """Merges, specials and whole strings of a vocabulary.

    strings: every string, each byte as the character of the same code point; merges: (left, right, rank), of which the
    lowest rank goes first and the leftmost of equals.
    """

    def __init__(self, strings: Iterable[str], merges: Iterable[tuple[str, str, int]], specials: list[str], odd: dict[int, str]):
        self.specials, self.odd = specials, odd
        #: A byte's number is its value; other strings follow.
        self.number = {chr(b): b for b in range(256)}
        for s in strings:
            self.number.setdefault(s, len(self.number))
        if len(self.number) > MAX_VOCABULARY:
            raise ValueError(f"a vocabulary of more than {MAX_VOCABULARY} strings")
        self.rank, self.made = {}, {}
        for left, right, rank in merges:
            self.rank[self.number[left] << SHIFT | self.number[right]] = rank
            self.made[rank] = self.number[left + right]
        self.never = max(self.made, default=0) + 1
        self.counter: Counter | None = None
        self.whole = {text for s, n in self.number.items() if (text := _text(s)) and self.merged(s.encode("latin-1")) == [n]}

    def merged(self, pretoken: bytes) -> list[int]:
        """The tokens of one pre-token, by number."""
        return self._merged_long(pretoken) if len(pretoken) > SHORT else self._merged_short(pretoken)

    def _merged_short(self, pretoken: bytes) -> list[int]:
        parts, get, never = list(pretoken), self.rank.get, self.never
        ranks = [get(a << SHIFT | b, never) for a, b in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) != never:
            at = ranks.index(least)
            parts[at:at + 2] = [self.made[least]]
            del ranks[at]
            if at:
                ranks[at - 1] = get(parts[at - 1] << SHIFT | parts[at], never)
            if at < len(ranks):
                ranks[at] = get(parts[at] << SHIFT | parts[at + 1], never)
        return parts

    def _merged_long(self, pretoken: bytes) -> list[int]:
        n = len(pretoken)
        part: list[int | None] = list(pretoken)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        todo: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n:
                a, b = part[i], part[after[i]]
                rank = self.rank.get(a << SHIFT | b)
                if rank is not None:
                    heapq.heappush(todo, (rank, i, a, b))

        for i in range(n - 1):
            offer(i)
        while todo:
            rank, i, a, b = heapq.heappop(todo)
            j = after[i]
            if part[i] != a or j >= n or part[j] != b:
                continue  # one of the two has been merged since
            part[i], part[j], after[i] = self.made[rank], None, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [p for p in part if p is not None]


def _text(s: str) -> str | None:
    """The text whose UTF-8 bytes these are; none where they are no whole text."""
    try:
        return s.encode("latin-1").decode("utf-8")
    except UnicodeDecodeError:
        return None


def _class(c: str) -> str:
    kind = unicodedata.category(c)[0]
    return _LETTER if kind == "L" else _NUMBER if kind == "N" else _OTHER


def _odd_characters(starts) -> dict[int, str]:
    """Characters that `regex` and the library may class differently, with one of the library's class.

    Both follow Unicode, in different versions: asked about are the characters that are new since Python's own version.
    starts: where pre-tokens start, by the library.
    """
    letter, number = regex.compile(r"\p{L}"), regex.compile(r"\p{N}")
    asked = [c for c in map(chr, range(0x80, 0x110000)) if not 0xD800 <= ord(c) < 0xE000
             and (_LETTER if letter.match(c) else _NUMBER if number.match(c) else _OTHER) != _class(c)]
    joins = {one: starts("".join(" " + one + c for c in asked)) for one in ("a", "1")}
    return {ord(c): next((to for one, to in (("a", _LETTER), ("1", _NUMBER)) if 3 * i + 2 not in joins[one]), _OTHER) for i, c in enumerate(asked)}


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file: .json of a byte-level tokenizer with merges, or .tiktoken with ranks."""
    if path.endswith(".tiktoken"):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token).decode("latin-1"): int(rank) for token, rank in map(bytes.split, f)}
        halves = ((s[:i], s[i:], rank) for s, rank in ranks.items() for i in range(1, len(s)))
        return Vocabulary(ranks, ((a, b, rank) for a, b, rank in halves if a in ranks and b in ranks), [], {})
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    model, cut = d["model"], d["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    byte_level = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space") and not d["normalizer"]
    if not plain or not byte_level or any(t[k] for t in d["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("only byte-level vocabularies with merges and plain special strings are counted here")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path).pre_tokenizer
    byte_of = str.maketrans(_byte_of())
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    merges = ((a.translate(byte_of), b.translate(byte_of), i) for i, (a, b) in enumerate(pairs))
    specials = [t["content"] for t in d["added_tokens"]]
    strings = {s.translate(byte_of) for s in model["vocab"] if s not in specials}
    odd = _odd_characters(lambda text: {at for _, (at, _) in library.pre_tokenize_str(text)})
    return Vocabulary(sorted(strings), merges, specials, odd)


class Counter:
    """Counts the tokens of texts; one for each Python worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.find = regex.compile(PATTERN)
        longest_first = sorted(vocabulary.specials, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, longest_first))) if longest_first else None
        self.odd = frozenset(map(chr, vocabulary.odd))
        self.merged_count = _MergedCounts(vocabulary)

    def count(self, text: str | None) -> tuple[int, int]:
        """The number of tokens, and how many of them are whole pre-tokens."""
        if not text:
            return 0, 0
        tokens = whole = at = 0
        for m in self.special.finditer(text) if self.special else ():
            t, w = self._piece(text[at:m.start()])
            tokens, whole, at = tokens + t + 1, whole + w, m.end()
        t, w = self._piece(text[at:] if at else text)
        return tokens + t, whole + w

    def _piece(self, text: str) -> tuple[int, int]:
        shown = text if text.isascii() or self.odd.isdisjoint(text) else text.translate(self.vocabulary.odd)
        found = (text[m.start():m.end()] for m in self.find.finditer(shown)) if shown is not text or len(text) > BLOCK else iter(self.find.findall(text))
        tokens = whole = 0
        while block := list(islice(found, BLOCK)):
            rest = list(filterfalse(self.vocabulary.whole.__contains__, block))
            whole += len(block) - len(rest)
            tokens += len(block) - len(rest) + sum(map(self.merged_count.__getitem__, rest))
        return tokens, whole


class _MergedCounts(dict):
    """The number of tokens of pre-tokens that had to be merged."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, pretoken: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = len(self.vocabulary.merged(pretoken.encode("utf-8")))
        if len(pretoken) <= SHORT:
            self[pretoken] = n
        return n


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: `row` (all its columns), id, n_bytes, n_tokens, n_whole, over_limit.

    n_whole: tokens that are whole pre-tokens, found without merging. A null or empty text has no bytes and no tokens.
    Rows that repeat an id are counted each; there are no ties. Special strings inside texts are one token each, as the
    library does by default. Clashing names do no harm: the input's columns stay inside `row`. An empty table gives no
    rows. path: a file that the driver can read; executors get its content.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    @F.pandas_udf("n_tokens long, n_whole long")
    def count(texts: pd.Series) -> pd.DataFrame:
        known = shared.value  # one object for each worker
        if known.counter is None:
            known.counter = Counter(known)
        return pd.DataFrame([known.counter.count(t) for t in texts], columns=["n_tokens", "n_whole"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), count(F.col(text_col)).alias("_n"))
    return rows.select("row", "id", "n_bytes", "_n.n_tokens", "_n.n_whole", (F.col("_n.n_tokens") > limit).alias("over_limit"))


def op13_query(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    rows = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return rows.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", "over_limit", "n_whole")
