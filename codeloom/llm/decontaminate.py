"""Benchmark decontamination by template windows.

Texts become templates: numbers, units of measure and names (capitalised words inside a sentence) turn into typed
placeholders, all other words into lower case without punctuation. Windows of WINDOW template words of the benchmark are
joined by hash with those of the documents, so a question whose numbers or names were changed still meets its original.
Along each alignment of a document with an item the slot values must map one to one (and by type), else only windows
with unchanged values count. Beside the templates, the unchanged words of every window, and of whole items that are
shorter than a window, are joined in the same way, so that exact copies are found however many slots they hold. In
scripts without spaces each character is a word. Before the join, document windows pass a bitmap of fixed size built from
all benchmark windows, so that only possible hits leave the tasks. Windows of many texts are hashed in one array.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from codeloom.llm.common import saved
from codeloom.llm.exact_dedup import drop_keys

#: Words of a window; for templates only, fewest words of it that are no slots and fewest words of an item.
WINDOW, LEAST_LITERALS, LEAST_ITEM = 8, 5, 4
#: An alignment with changed slots must cover this share of the item's windows; unchanged windows count singly.
TEMPLATE_SHARE = 0.5
#: The bitmap has 2^23 bits: 256 rows of 4 KB.
BLOCKS, BLOCK_BITS = 256, 32_768
#: Up to this many benchmark windows the join is a broadcast; beyond it the planner decides.
BROADCAST_WINDOWS = 200_000

#: Chunks between white space, and possible slot words, that a task remembers; then it starts anew, so that its memory
#: does not grow with the corpus. Longer chunks, as in scripts without spaces, are not remembered.
KNOWN_WORDS, LONGEST_CHUNK = 100_000, 64
#: Characters of neighbouring texts whose windows are hashed at once.
TOGETHER = 500_000

LITERAL, NUMBER, UNIT, CAPITAL = 0, 1, 2, 3

#: Words that stand for numbers and units.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
UNITS = "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years cent cents dollar dollars euro euros usd eur gbp mph kmh percent degrees".split()

_SLOT_WORDS = {w: UNIT for w in UNITS} | {w: NUMBER for w in NUMBER_WORDS}
#: Han, kana, Thai, Lao, Burmese, Khmer.
_UNSPACED = "\u2e80-\u2fff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff"
_TOKEN = re.compile(rf"\d+(?:[.,:]\d+)*|(?=[^\W\d_])[{_UNSPACED}]|(?:(?![{_UNSPACED}])[^\W\d_])+")
_END = re.compile(r"[.!?:]\W*$")
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary(dict):
    """Chunks between white space, each with its words as eight bytes: hash, kind, and whether the word ends a sentence."""

    def __init__(self):
        super().__init__()
        #: Words that may be slots, by hash.
        self.text: dict[int, str] = {}

    def __missing__(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk.isalpha():
            return self._remember(chunk, self._packed(chunk, False))
        stem, last = chunk[:-1], chunk[-1]
        if last in ".,;:!?" and stem.isascii() and stem.isalpha():
            return self._remember(chunk, self._packed(stem, last not in ",;"))
        words, end = _TOKEN.findall(chunk), _END.search(chunk) is not None
        out = b"".join([self._packed(w, end and i == len(words) - 1) for i, w in enumerate(words)])
        return self._remember(chunk, out) if len(chunk) <= LONGEST_CHUNK else out

    def _remember(self, chunk: str, out: bytes) -> bytes:
        self[chunk] = out
        return out

    def _packed(self, word: str, end: bool) -> bytes:
        low = word.lower()
        value = xxhash.xxh64_intdigest(low) >> 3
        kind = _SLOT_WORDS.get(low)
        if kind is None:
            if word == low:
                kind = NUMBER if word[0].isdigit() else LITERAL
            else:
                kind = CAPITAL if word[0].isupper() and word[1:].islower() else LITERAL
        if kind != LITERAL:
            self.text[value] = low
        return (value << 3 | kind << 1 | end).to_bytes(8, "little")

    def template(self, *texts: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(kinds, hashes, plain hashes) of the words of all texts in a row, and each text's number of words; slots of one
        kind share a hash."""
        if max(len(self), len(self.text)) > KNOWN_WORDS:
            self.clear()
            self.text.clear()
        parts = [b"".join(map(self.__getitem__, text.split())) for text in texts]
        counts = np.array([len(p) // 8 for p in parts], np.int64)
        words = np.frombuffer(b"".join(parts), "<u8")
        kinds, plain, ends = (words >> np.uint64(1) & np.uint64(3)).astype(np.int8), words >> np.uint64(3), words & np.uint64(1) == 1
        first = np.concatenate(([True], ends[:-1]))[: len(words)]
        first[(np.cumsum(counts) - counts)[counts > 0]] = True
        kinds[(kinds == CAPITAL) & first] = LITERAL
        return kinds, np.where(kinds == LITERAL, plain, kinds.astype(np.uint64)), plain, counts

    def windows(self, texts: list[str], lengths: list[int], known=None) -> Iterator[tuple[int, int, int, list[str], bool]]:
        """(text's index, hash, place, slots, counts) of the texts' windows that known(hashes) lets pass; a slot is its type
        and value.

        Each window comes with its unchanged words and no slots, and as a template if it has slots and literals enough.
        counts: whether the window has literals enough. No window reaches from one text into the next.
        """
        kinds, hashes, plain, counts = self.template(*texts)
        if not len(kinds):
            return
        text_of, text_start = np.repeat(np.arange(len(counts)), counts), np.cumsum(counts) - counts
        left = np.repeat(np.cumsum(counts), counts) - np.arange(len(kinds))  # words from here to the end of the text
        literals_to = np.concatenate(([0], np.cumsum(kinds == LITERAL)))
        up, down = _powers(max(12, len(kinds).bit_length()))
        # sums of words times falling powers: each window of any length is one subtraction away
        sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * down[:len(kinds)]))) for words in (plain, hashes)]
        for length in lengths:
            n = len(kinds) - length + 1
            if n < 1:
                continue
            inside = left[:n] >= length
            literals = literals_to[length:] - literals_to[:n]
            good = (literals >= min(LEAST_LITERALS, length - 1)) & (length >= LEAST_ITEM)
            for to, start, places in ((sums[0], WINDOW + length, np.flatnonzero(inside)), (sums[1], length, np.flatnonzero(inside & good & (literals < length)))):
                rolled = (to[places + length] - to[places]) * up[places + (length - 1)] + np.uint64(start * pow(int(_BASE), length, 1 << 64) % (1 << 64))
                rolled ^= rolled >> np.uint64(29)
                if known is not None:
                    passed = known(rolled)
                    places, rolled = places[passed], rolled[passed]
                for at, value in zip(places.tolist(), rolled.view(np.int64).tolist()):
                    slots = [] if to is sums[0] else [f"{kinds[i]}:{self.text[int(plain[i])]}" for i in range(at, at + length) if kinds[i] != LITERAL]
                    yield int(text_of[at]), value, int(at - text_start[text_of[at]]), slots, bool(good[at])


def _together(texts: Iterable[str]) -> Iterator[tuple[int, list[str]]]:
    """Neighbouring texts of about TOGETHER characters, with the place of the first; a longer text comes alone or last."""
    start, size, block = 0, 0, []
    for text in texts:
        block.append(text)
        size += len(text)
        if size >= TOGETHER:
            yield start, block
            start, size, block = start + len(block), 0, []
    if block:
        yield start, block


@lru_cache(maxsize=16)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The first 2 ** bits powers of the odd base and of its inverse, modulo 2 ** 64."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    return tuple(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full((1 << bits) - 1, base, np.uint64)))) for base in (_BASE, inverse))


def _item_windows(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, length, hash, place, slots, counts, item_windows, templates): templates is the number of windows that count."""

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Vocabulary()
        for frame in frames:
            rows = []
            for item, text in zip(frame["item"], frame["text"]):
                n = len(words.template(text)[0])
                if n:
                    length = min(n, WINDOW)
                    made = [w[1:] for w in words.windows([text], [length])]
                    counted = len({at for _, at, _, counts in made if counts})
                    rows += [(item, length, *w, n - length + 1, counted) for w in made]
            yield pd.DataFrame(rows, columns=["item", "length", "hash", "place", "slots", "counts", "item_windows", "templates"])

    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter("item IS NOT NULL").distinct()
    return items.mapInPandas(build, "item string, length int, hash long, place long, slots array<string>, counts boolean, item_windows long, templates long")


def _doc_windows(docs: DataFrame, lengths: list[int], bits: np.ndarray) -> DataFrame:
    """(key, hash, place, slots) of the document windows that the bitmap lets pass."""

    def known(hashes: np.ndarray) -> np.ndarray:
        at = (hashes & np.uint64(BLOCKS * BLOCK_BITS - 1)).view(np.int64)  # the size is a power of two
        return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Vocabulary()
        for frame in frames:
            keys = frame["key"].tolist()
            for start, block in _together(frame["text"]):
                rows = [(keys[start + i], *w) for i, *w, _ in words.windows(block, lengths, known)]
                yield pd.DataFrame(rows, columns=["key", "hash", "place", "slots"])

    return docs.select("key", "text").mapInPandas(build, "key string, hash long, place long, slots array<string>")


def _bitmap(windows: DataFrame) -> np.ndarray:
    size = BLOCKS * BLOCK_BITS
    at = F.pmod(F.col("hash"), F.lit(size).cast("long"))  # 2^64 is a multiple of the size, so signs make no difference
    blocks = windows.groupBy(F.floor(at / BLOCK_BITS).cast("int").alias("b")).agg(F.bitmap_construct_agg(at % BLOCK_BITS).alias("bits")).collect()
    bits = np.zeros(size // 8, np.uint8)
    for row in blocks:
        bits[row["b"] * (BLOCK_BITS // 8):(row["b"] + 1) * (BLOCK_BITS // 8)] = np.frombuffer(row["bits"], np.uint8)
    return bits


def _row_key(id_col: str, text_col: str) -> Column:
    """The id as text; a row without id goes by its text."""
    return F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(key, item, windows, item_windows, share, kind): document and item that share windows.

    kind: `copy` where slot values are unchanged, `template` where they map one to one and the alignment covers
    TEMPLATE_SHARE of the item's windows with literals enough. A whole item of fewer than WINDOW words is one window.
    Null and empty texts have no windows; items without id are ignored; rows that repeat an
    id count once. Other columns are ignored, empty tables give no rows.
    """
    items = saved(_item_windows(benchmark, item_col, item_text_col), "item-windows")
    n = items.count()
    lengths = sorted(r[0] for r in items.select("length").distinct().collect())  # 1 to WINDOW
    rows = docs.select(_row_key(id_col, text_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    hits = _doc_windows(rows, lengths, _bitmap(items))
    index = items.select("hash", "item", F.col("place").alias("there"), F.col("slots").alias("asked"), "counts", "item_windows", "templates", "length")
    met = hits.join(F.broadcast(index) if n <= BROADCAST_WINDOWS else index, "hash").filter(F.size("slots") == F.size("asked"))
    pairs = F.transform(F.arrays_zip("asked", "slots"), lambda p: F.struct(p["asked"].alias("x"), p["slots"].alias("y")))
    same_kind = F.forall(pairs, lambda p: F.substring(p["x"], 1, 1) == F.substring(p["y"], 1, 1))
    met = met.filter(same_kind).withColumn("pairs", pairs).withColumn("same", F.forall(pairs, lambda p: p["x"] == p["y"]))
    # an alignment has at most one window for each window of the item, so its sets are bounded by the item
    lines = met.groupBy("key", "item", (F.col("place") - F.col("there")).alias("shift")).agg(
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"), F.collect_set(F.when(F.col("counts"), F.col("there"))).alias("all"), F.collect_set(F.when(F.col("same"), F.col("there"))).alias("exact"), F.first("item_windows").alias("item_windows"), F.first("templates").alias("templates"),
    )
    one_to_one = (F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["x"])))) & (F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["y"]))))
    whole = one_to_one & (F.size("all") >= TEMPLATE_SHARE * F.col("templates"))
    lines = lines.withColumn("windows", F.when(whole, F.array_union("all", "exact")).otherwise(F.col("exact"))).filter(F.size("windows") > 0)
    places = F.array_distinct(F.flatten(F.collect_set("windows")))
    out = lines.groupBy("key", "item").agg(F.size(places).cast("long").alias("windows"), F.first("item_windows").alias("item_windows"), F.max(F.size("exact") > 0).alias("copied"))
    return out.select("key", "item", "windows", "item_windows", (F.col("windows") / F.col("item_windows")).alias("share"), F.when(F.col("copied"), "copy").otherwise("template").alias("kind"))


def drop_leaked(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs that share no window with the benchmark."""
    gone = saved(leaks(docs, benchmark, id_col, text_col, item_col, item_text_col).select(F.col("key").alias("_key")).distinct(), "leaked")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _row_key(id_col, text_col).alias("_key"))
    return drop_keys(rows, gone, "_key").select("row.*")


def op7_query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, windows, item_windows, share, kind) of all leaks; doc_id is null for rows without id."""
    found = leaks(docs, benchmark)
    number = F.expr("try_cast(key AS BIGINT)")
    return found.select(number.alias("doc_id"), F.expr("try_cast(item AS BIGINT)").alias("item_id"), "windows", "item_windows", "share", "kind")
