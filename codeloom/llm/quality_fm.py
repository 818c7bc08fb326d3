"""Quality scores by a factorisation machine over hashed words, structure statistics and metadata.

A document is a sparse vector: hashed words with damped counts and unit norm, and one entry for the step in which each
structure statistic (shares of upper case, symbols, bars, repeated words, ...) and the recorded length fall. The model
gives each entry a weight and a vector of RANK factors; the pairwise interactions of all entries are scored in linear
time, as half the difference of the square of the sum and the sum of the squares of the factor vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

#: Hashed words, steps of a statistic, and rank of the interactions.
WORD_BINS, STEPS, RANK = 1 << 13, 12, 8
#: Labelled documents that the model is fitted on, at most: those of smallest id hash.
SAMPLE = 4000
EPOCHS, BATCH, RATE, DECAY = 12, 64, 0.1, 1e-4
#: A document is rejected below this score.
ACCEPT = 0.3
STATISTICS = ("upper", "digit", "punctuation", "symbol", "bang", "bar", "line", "wide", "word_length", "distinct", "top_word", "length", "recorded")
SIZE = WORD_BINS + STEPS * len(STATISTICS)

_CLASS = {
    "upper": range(65, 91), "digit": range(48, 58), "punctuation": b".,;:'\"-()?", "symbol": b"#$%&*+/<=>@[]^_`{}~\\",
    "bang": b"!", "bar": b"|", "line": b"\n\r", "wide": range(128, 256),
}
_BYTES = np.array([np.isin(np.arange(256), list(members)) for members in _CLASS.values()], float)


class _Bins(dict):
    """Hash bins of words; emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        value = self[word] = xxhash.xxh32_intdigest(word) % WORD_BINS
        return value


def features(text: bytes | None, recorded: float | None, bins: _Bins) -> tuple[np.ndarray, np.ndarray]:
    """(entries, values) of a text in UTF-8 with its recorded length; null counts as empty or not recorded."""
    text = text or b""
    words = text.split()
    n, size = max(1, len(words)), max(1, len(text))
    found, counts = np.unique(np.fromiter(map(bins.__getitem__, words), np.int64, len(words)), return_counts=True)
    damped = np.log1p(counts)
    damped /= max(1e-9, np.sqrt((damped**2).sum()))
    shares = _BYTES @ np.bincount(np.frombuffer(text, np.uint8), minlength=256) / size
    known = recorded is not None and recorded == recorded and recorded >= 0
    steps = [
        *np.sqrt(shares), (size / n) / 24, len(found) / n, counts.max(initial=0) / n,
        np.log1p(len(text)) / 14, np.log1p(recorded) / 14 if known else 1.0,
    ]
    at = np.minimum(STEPS - 1, (np.array(steps) * STEPS).astype(np.int64))
    entries = WORD_BINS + np.arange(len(STATISTICS)) * STEPS + at
    return np.concatenate((found, entries)), np.concatenate((damped, np.full(len(entries), 0.5)))


class Machine:
    """weights (SIZE), factors (SIZE x RANK) and bias."""

    def __init__(self, bias: float = 0.0, seed: int = 2):
        self.bias = bias
        self.weights = np.zeros(SIZE)
        self.factors = np.random.default_rng(seed).normal(0, 0.02, (SIZE, RANK))

    def margins(self, entries: np.ndarray, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Margins of documents laid end to end (each has an entry), and their sums of factor vectors."""
        v = self.factors[entries] * values[:, None]
        total = np.add.reduceat(v, starts)
        pairs = 0.5 * (total**2 - np.add.reduceat(v**2, starts)).sum(axis=1)
        return self.bias + np.add.reduceat(self.weights[entries] * values, starts) + pairs, total

    def scores(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not docs:
            return np.empty(0)
        margins, _ = self.margins(*laid_out(docs))
        return 1 / (1 + np.exp(-np.clip(margins, -30, 30)))

    def fit(self, docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> "Machine":
        """Adaptive gradient steps on the logistic loss, in a fixed random order."""
        rng, eps = np.random.default_rng(1), 1e-8
        squares_w, squares_v, square_b = np.zeros(SIZE), np.zeros((SIZE, RANK)), 0.0
        for _ in range(EPOCHS):
            order = rng.permutation(len(docs))
            for at in range(0, len(docs), BATCH):
                part = order[at:at + BATCH]
                entries, values, starts = laid_out([docs[i] for i in part])
                margins, total = self.margins(entries, values, starts)
                error = (1 / (1 + np.exp(-np.clip(margins, -30, 30))) - labels[part]) / len(part)
                owner = np.repeat(np.arange(len(part)), np.diff(np.append(starts, len(entries))))
                step = error[owner] * values
                used, place = np.unique(entries, return_inverse=True)
                grad_w = np.bincount(place, step, len(used)) + DECAY * self.weights[used]
                each = step[:, None] * (total[owner] - self.factors[entries] * values[:, None])
                grad_v = np.stack([np.bincount(place, each[:, k], len(used)) for k in range(RANK)], axis=1) + DECAY * self.factors[used]
                squares_w[used] += grad_w**2
                squares_v[used] += grad_v**2
                square_b += error.sum() ** 2
                self.weights[used] -= RATE * grad_w / np.sqrt(squares_w[used] + eps)
                self.factors[used] -= RATE * grad_v / np.sqrt(squares_v[used] + eps) * 0.3
                self.bias -= RATE * error.sum() / np.sqrt(square_b + eps)
        return self


def laid_out(docs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = [len(e) for e, _ in docs]
    starts = np.concatenate(([0], np.cumsum(sizes[:-1]))).astype(np.int64)
    return np.concatenate([e for e, _ in docs]), np.concatenate([v for _, v in docs]), starts


def held_out(id_: Column) -> Column:
    """Rows that are never learned from; a null id counts as held out."""
    return F.coalesce(F.crc32(id_.cast("string")) % 5 == 0, F.lit(True))


def _recorded(docs: DataFrame, chars_col: str) -> Column:
    return (F.col(chars_col) if chars_col in docs.columns else F.lit(None)).cast("double")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", label_col: str = "quality", sample: int = SAMPLE) -> Machine:
    """A machine fitted on `sample` labelled rows at most, none of them held out.

    Labels other than 0 and 1 and ids without text row are ignored; of several labels of an id the mean counts.
    """

    # as bytes, since the driver would hold lists as one Python object for each number
    @F.pandas_udf("struct<entries:binary,values:binary>")
    def vector(texts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        bins = _Bins()
        for series, recorded in texts:
            made = [features(t, r, bins) for t, r in zip(series, recorded)]
            yield pd.DataFrame({"entries": [e.astype("<i4").tobytes() for e, _ in made], "values": [v.astype("<f4").tobytes() for _, v in made]})

    usable = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("y")).filter("y IN (0, 1)").filter(~held_out(F.col("_id")))
    chosen = usable.groupBy("_id").agg(F.avg("y").alias("y")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    # `chosen` has at most `sample` rows, so its broadcast is bounded
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("text"), _recorded(docs, chars_col).alias("recorded"))
    rows = texts.join(F.broadcast(chosen), "_id").select("_id", "y", vector("text", "recorded").alias("f")).dropDuplicates(["_id"]).collect()
    rows.sort(key=lambda r: r["_id"])
    if not rows:
        return Machine()
    y = np.array([r["y"] for r in rows])
    rate = np.clip(y.mean(), 0.01, 0.99)
    return Machine(float(np.log(rate / (1 - rate)))).fit([(np.frombuffer(r["f"]["entries"], "<i4"), np.frombuffer(r["f"]["values"], "<f4")) for r in rows], y)


def scored(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """One row for each row of docs: `row` (all its columns), id and score.

    Null and empty texts are scored by their statistics; repeated rows are scored each; a table without `chars_col` is
    scored as one with nothing recorded.
    """

    @F.pandas_udf("double")
    def score(texts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        bins = _Bins()
        for series, recorded in texts:
            out = [machine.scores([features(t, r, bins) for t, r in zip(series[at:at + 200], recorded[at:at + 200])]) for at in range(0, len(series), 200)]
            yield pd.Series(np.concatenate(out) if out else np.empty(0))

    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"),
        score(F.col(text_col).cast("binary"), _recorded(docs, chars_col)).alias("score"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """The rows of docs that score `accept` or more."""
    return scored(docs, train(docs, labels)).filter(F.col("score") >= accept).select("row.*")


def op2_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = scored(docs, train(docs, labels))
    return rows.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
