"""Whitening of embeddings by a pivoted Cholesky factor and one-sided Jacobi rotations.

Two passes gather what is fitted: exact sums, then the scatter of the centred vectors, as one small matrix for each task
that Spark adds up. The scatter V of d dimensions is factored with pivoting, V = G G', G having as many columns as V has
rank; rotating pairs of columns of G until they are orthogonal leaves columns whose squared norms are the eigenvalues of
V and whose directions are its eigenvectors. The driver holds d * d numbers, whatever the number of rows.

Vectors are fixed-point numbers, so all sums are integers and exact: vectors are centred at the rounded mean before they
are multiplied, products are added in blocks small enough for a double to hold every integer, and the rest of the mean is
taken off exactly. Reruns agree to the last bit, however the rows are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from codeloom.llm.common import saved

SCALE, SHIFT = 1024, 100_000
#: Entries from here on count as not finite, so that sums of products fit 38 digits.
TOO_LARGE = 2.0**30
#: Integers up to here are exact as doubles.
EXACT = 2**53
#: Vectors that are multiplied at a time.
BLOCK = 4096


def fixed_point(vectors: Column) -> Column:
    """Arrays of long, floor(SCALE * entry) + SHIFT; null for a null vector or one with a null or non-finite entry."""
    entry = lambda c: (F.abs(c.cast("double")) < TOO_LARGE)  # not true for null, NaN and infinity
    usable = F.coalesce(F.forall(vectors, lambda c: F.coalesce(entry(c), F.lit(False))), F.lit(False))
    return F.when(usable, F.transform(vectors, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT))


def scatter(rows: DataFrame, centre: list[int]) -> list[list[int]]:
    """Exact sums of the products (x[i] - centre[i]) * (x[j] - centre[j]) over rows (x), for i <= j."""
    d, mid = len(centre), np.array(centre, np.int64)
    upper = np.triu_indices(d)

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((d, d), object)
        for frame in frames:
            for at in range(0, len(frame), BLOCK):
                y = np.stack(frame["x"].iloc[at:at + BLOCK].to_list()) - mid
                largest = int(np.abs(y).max())
                if largest * largest * len(y) < EXACT:
                    y = y.astype(np.float64)
                    total += (y.T @ y).astype(np.int64)
                else:
                    y = y.astype(object)
                    total += y.T @ y
        yield pd.DataFrame({"i": upper[0], "j": upper[1], "s": [str(v) for v in total[upper]]})

    cells = rows.select("x").mapInPandas(add, "i int, j int, s string").groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out = [[0] * d for _ in range(d)]
    for i, j, s in cells.collect():  # d * (d + 1) / 2 rows
        out[i][j] = out[j][i] = int(s)
    return out


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """G with G G' = v for a symmetric positive semidefinite v; as many columns as v has rank.

    The rows of G in the order of the pivots form a lower triangle.
    """
    d = len(v)
    g, rest, open_ = np.zeros((d, d)), np.diag(v).copy(), np.ones(d, bool)
    least = np.finfo(float).eps * d * rest.max(initial=0.0)
    for k in range(d):
        pivot = int(np.where(open_, rest, -np.inf).argmax())
        if rest[pivot] <= least:
            return g[:, :k]
        column = (v[:, pivot] - g[:, :k] @ g[pivot, :k]) / np.sqrt(rest[pivot])
        g[:, k] = np.where(open_, column, 0.0)
        rest = rest - g[:, k] ** 2
        open_[pivot] = False
    return g


def one_sided_jacobi(g: np.ndarray) -> np.ndarray:
    """g times a rotation, such that the columns are orthogonal.

    Pairs of columns are dealt as in a round robin: the pairs of one turn share no column and are rotated at once.
    """
    b, r = g.copy(), g.shape[1]
    size = r + r % 2
    for _ in range(60):
        seats, turned = list(range(size)), False
        for _ in range(size - 1):
            pairs = [(min(p), max(p)) for p in zip(seats[:size // 2], seats[:size // 2 - 1:-1]) if max(p) < r]
            seats = [seats[0], seats[-1], *seats[1:-1]]
            if not pairs:
                continue
            i, j = map(np.array, zip(*pairs))
            x, y = b[:, i], b[:, j]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            apart = np.abs(xy) > 1e-15 * np.sqrt(xx * yy)
            if not apart.any():
                continue
            turned = True
            ratio = (yy - xx) / (2 * np.where(apart, xy, 1.0))
            t = np.where(ratio >= 0, 1.0, -1.0) / (np.abs(ratio) + np.sqrt(1 + ratio * ratio))
            t = np.where(apart, t, 0.0)
            cos = 1 / np.sqrt(1 + t * t)
            b[:, i], b[:, j] = cos * x - cos * t * y, cos * t * x + cos * y
        if not turned:
            break
    return b


@dataclass
class Whitening:
    """What is fitted: n vectors with sums per dimension, the exact covariance, and eigenvalues with components (rows)."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    components: np.ndarray

    @property
    def trace(self) -> float:
        return float(np.trace(self.covariance))

    def identity_error(self, most: int) -> float:
        """The largest entry of the whitened vectors' covariance minus the identity: W V W', from the exact V."""
        w = self.components[:most] / np.sqrt(self.values[:most, None])
        return float(np.abs(w @ self.covariance @ w.T - np.eye(len(w))).max(initial=0.0))


def decompose(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues above zero, falling, and unit eigenvectors as rows, the largest entry of each positive."""
    b = one_sided_jacobi(pivoted_cholesky(covariance))
    norms = (b * b).sum(0)
    order = np.argsort(-norms, kind="stable")
    components = (b[:, order] / np.sqrt(norms[order])).T
    signs = np.sign(components[np.arange(len(components)), np.abs(components).argmax(1)]) if len(components) else np.ones(0)
    return norms[order], components * signs[:, None]


def fit(rows: DataFrame) -> Whitening:
    """The whitening of rows (x: arrays of equal length of long)."""
    sums = {r["pos"]: (r["n"], r["s"]) for r in rows.select(F.posexplode("x").alias("pos", "v")).groupBy("pos").agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).collect()}  # d rows
    if not sums:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), np.zeros((0, 0)))
    n, s = sums[0][0], [int(sums[i][1]) for i in range(len(sums))]
    centre = [round(Fraction(t, n)) for t in s]
    products = scatter(rows, centre)
    rest = [t - n * c for t, c in zip(s, centre)]
    covariance = np.array([[float(Fraction(n * products[i][j] - rest[i] * rest[j], n * n)) for j in range(len(s))] for i in range(len(s))])
    return Whitening(n, s, covariance, *decompose(covariance))


def project(rows: DataFrame, w: Whitening, most: int) -> DataFrame:
    """(id, component, deviation, whitened) of rows (id, x) for the first components."""
    k = min(most, len(w.values))
    centre = np.array([round(Fraction(t, w.n)) for t in w.sums], np.int64)
    rest = np.array([float(Fraction(t, w.n) - int(c)) for t, c in zip(w.sums, centre)])
    off = [int(t - w.n * int(c)) for t, c in zip(w.sums, centre)]
    axes, n, d = (w.components[:k] / np.sqrt(w.values[:k, None])).T, w.n, len(w.sums)

    def deviations(y: np.ndarray) -> list[int | None]:
        largest = n * int(np.abs(y).max(initial=0)) + max(map(abs, off))
        if largest * largest * d < 2**63:
            return ((n * y - np.array(off, np.int64)) ** 2).sum(1).tolist()
        exact = ((n * y.astype(object) - np.array(off, object)) ** 2).sum(1)
        return [int(v) if v < 2**63 else None for v in exact]

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), BLOCK):
                part = frame.iloc[at:at + BLOCK]
                y = np.stack(part["x"].to_list()) - centre
                white = (y.astype(np.float64) - rest) @ axes
                yield pd.DataFrame({"id": part["id"].values, "deviation": pd.Series(deviations(y), dtype="Int64"), "white": list(white)})

    placed = rows.select(F.col("id").cast("string").alias("id"), "x").mapInPandas(place, "id string, deviation long, white array<double>")
    each = placed.select(F.col("id").cast(rows.schema["id"].dataType).alias("id"), "deviation", F.posexplode("white").alias("component", "whitened"))
    return each.withColumn("component", F.col("component") + 1)


def whiten(vectors: DataFrame, most: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each vector and component up to `most`: id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null or hold a null or non-finite entry are left out, as are entries of 2**30 or more and vectors
    that are not of the commonest length (of equally common ones, the longest). Components are those of eigenvalues above
    zero, so fewer than `most` may come out, and none for equal vectors, a single one or an empty table. Equal eigenvalues
    keep the order of their columns. A deviation beyond a long is null. Rows that repeat an id are vectors of their own; a
    null id is kept. Other columns are ignored.
    """
    rows = vectors.select(F.col(id_col).alias("id"), fixed_point(F.col(vector_col)).alias("x")).filter("x IS NOT NULL")
    rows = saved(rows, "fixed-point")
    length = rows.groupBy(F.size("x").alias("d")).count().agg(F.max(F.struct("count", "d"))).first()[0]
    rows = rows.filter(F.size("x") == F.lit(length["d"] if length else 0))
    w = fit(rows)
    share = F.element_at(F.array(*[F.lit(float(v) / w.trace) for v in w.values[:most]] or [F.lit(0.0)]), F.col("component"))
    return project(rows, w, most).select("id", "component", F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(w.identity_error(most)).alias("identity_error"))


def op11_query(embeddings: DataFrame) -> DataFrame:
    return whiten(embeddings).withColumnRenamed("id", "vec_id")
