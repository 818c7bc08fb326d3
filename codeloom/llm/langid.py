"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, everything but letters becomes one space, and n-grams of one to three code points are hashed into
BINS bins. Document frequencies are counted over all rows that may be learned from. The weights are fitted by
follow-the-regularised-leader with per-coordinate rates, an L1 and an L2 penalty, on a bounded sample; a temperature
fitted on a part of the sample that the weights have not seen makes the scores probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

BIN_BITS = 14
BINS = 1 << BIN_BITS
#: The weights are fitted on the documents of smallest id hash: so many a language, and in all.
PER_LANGUAGE, SAMPLE = 300, 3000
EPOCHS, BATCH, ALPHA, BETA, L1, L2 = 6, 32, 0.5, 1.0, 2e-3, 1e-3
UNKNOWN = "und"

_GRAM = [np.array(x, np.uint32) for x in ([2654435761], [2246822519, 3266489917], [668265263, 374761393, 2869860233])]


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def counts(text: str | None) -> np.ndarray | None:
    """Counts of the hashed n-grams of a text; None if it is null or has no letter."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of several other characters stands for all as a space
    spaced = np.where(letter, points, np.uint32(32))[keep]
    spaced = np.concatenate(([32], spaced, [32])).astype(np.uint32)
    out = np.zeros(BINS, np.int64)
    with np.errstate(over="ignore"):
        for n, odd in enumerate(_GRAM, 1):
            h = sum((spaced[i:len(spaced) - n + 1 + i] * odd[i] for i in range(n)), start=np.uint32(n))
            out += np.bincount((h ^ (h >> np.uint32(15))) * np.uint32(2654435769) >> np.uint32(32 - BIN_BITS), minlength=BINS)
    return out


def held_out(id_: Column) -> Column:
    """Rows that are never learned from; a null id counts as held out."""
    return F.coalesce(F.crc32(id_.cast("string")) % 4 == 2, F.lit(True))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, BINS)))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    temperature: float = 1.0

    def vectors(self, rows: list[np.ndarray]) -> np.ndarray:
        x = np.log1p(np.stack(rows).astype(np.float32)) * self.idf
        return x / np.maximum(1e-9, np.sqrt((x * x).sum(axis=1, keepdims=True)))

    def probabilities(self, x: np.ndarray, temperature: float | None = None) -> np.ndarray:
        z = (x @ self.weights.T + self.bias) / (temperature or self.temperature)
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def fit(self, rows: list[np.ndarray], y: np.ndarray) -> "Model":
        """Follow-the-regularised-leader over batches in a fixed random order, then the temperature."""
        k = len(self.languages)
        rng = np.random.default_rng(8)
        order = rng.permutation(len(rows))
        aside, learn = order[: len(rows) // 5], order[len(rows) // 5:]
        self.weights, self.bias = np.zeros((k, BINS), np.float32), np.zeros(k, np.float32)
        z, n = np.zeros((k, BINS + 1), np.float32), np.zeros((k, BINS + 1), np.float32)
        penalty = np.append(np.full(BINS, L1), 0).astype(np.float32)
        for _ in range(EPOCHS):
            for part in np.array_split(rng.permutation(learn), max(1, len(learn) // BATCH)):
                x = self.vectors([rows[i] for i in part])
                error = self.probabilities(x, 1.0)
                error[np.arange(len(part)), y[part]] -= 1
                grad = np.concatenate((error.T @ x, error.sum(axis=0)[:, None]), axis=1) / len(part)
                whole = np.concatenate((self.weights, self.bias[:, None]), axis=1)
                z += grad - (np.sqrt(n + grad**2) - np.sqrt(n)) / ALPHA * whole
                n += grad**2
                whole = np.where(np.abs(z) <= penalty, 0, -(z - np.sign(z) * penalty) / ((BETA + np.sqrt(n)) / ALPHA + L2))
                self.weights, self.bias = whole[:, :-1].astype(np.float32), whole[:, -1].astype(np.float32)
        if len(aside):
            x = np.concatenate([self.vectors([rows[i] for i in part]) for part in np.array_split(aside, max(1, len(aside) // BATCH))])
            truth = y[np.concatenate(np.array_split(aside, max(1, len(aside) // BATCH)))]
            loss = lambda t: -np.log(np.maximum(1e-12, self.probabilities(x, t)[np.arange(len(truth)), truth])).mean()
            self.temperature = float(min(np.geomspace(0.02, 5, 60), key=loss))
        return self


def _document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each bin occurs, and the number of texts with letters; each partition sends one row a bin."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(BINS, np.int64), 0
        for frame in frames:
            for text in frame["text"]:
                if (c := counts(text)) is not None:
                    total += c > 0
                    n += 1
        used = np.flatnonzero(total)
        yield pd.DataFrame({"bin": np.append(used, -1), "n": np.append(total[used], n)})

    out = np.zeros(BINS + 1, np.int64)
    for row in texts.mapInPandas(count, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():  # BINS + 1 rows at most
        out[row["bin"]] = row["n"]
    return out[:-1], int(out[-1])


def _sparse(texts: pd.Series) -> pd.DataFrame:
    made = [c if (c := counts(t)) is not None else np.zeros(BINS, np.int64) for t in texts]
    used = [np.flatnonzero(c) for c in made]
    return pd.DataFrame({"bins": [u.astype(np.int32) for u in used], "counts": [c[u].astype(np.int32) for c, u in zip(made, used)]})


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, sample: int = SAMPLE) -> Model:
    """A model of the languages of the rows that may be learned from: those with text, language and id, not held out."""
    usable = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("text IS NOT NULL AND lang IS NOT NULL").filter(~held_out(F.col("_id")))
    seen, n = _document_frequencies(usable.select("text"))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("_id"), "_id")
    chosen = usable.select("_id", "lang").distinct().withColumn("_at", F.row_number().over(first)).filter(F.col("_at") <= per_language).orderBy("_at", "lang", "_id").limit(sample)
    # `chosen` has at most `sample` rows, so its broadcast is bounded
    picked = usable.join(F.broadcast(chosen.drop("_at")), ["_id", "lang"])
    sparse = F.pandas_udf(_sparse, "struct<bins:array<int>,counts:array<int>>")
    rows = picked.select("_id", "lang", sparse("text").alias("c")).dropDuplicates(["_id", "lang"]).collect()
    rows = sorted((r for r in rows if r["c"]["bins"]), key=lambda r: (r["lang"], r["_id"]))
    languages = sorted({r["lang"] for r in rows})
    model = Model(languages, np.log((1 + n) / (1 + seen)).astype(np.float32) + 1)
    if not rows:
        return model

    def dense(c) -> np.ndarray:
        out = np.zeros(BINS, np.int32)
        out[c["bins"]] = c["counts"]
        return out

    # 3,000 rows of 16,384 counts take 200 MB dense, so they stay sparse and become dense by batches
    class Rows(list):
        def __getitem__(self, i):
            return dense(rows[i]["c"])

    return model.fit(Rows(range(len(rows))), np.array([languages.index(r["lang"]) for r in rows]))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: `row` (all its columns), id, lang_pred, score.

    lang_pred is `und` with score 0 for texts that are null or have no letter, and for all texts if there was nothing to
    learn from. Repeated rows are judged each.
    """

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in texts:
            names, scores = [UNKNOWN] * len(series), np.zeros(len(series))
            for at in range(0, len(series), BATCH):
                made = [(i, c) for i, t in enumerate(series[at:at + BATCH], at) if (c := counts(t)) is not None]
                if made and model.languages:
                    p = model.probabilities(model.vectors([c for _, c in made]))
                    for (i, _), best, value in zip(made, p.argmax(axis=1), p.max(axis=1)):
                        names[i], scores[i] = model.languages[best], min(1.0, float(value))
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), predict(F.col(text_col)).alias("_p"))
    return rows.select("row", "id", "_p.*")


def op8_query(docs: DataFrame) -> DataFrame:
    rows = identify(docs, train(docs))
    return rows.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "lang_pred", "score")
