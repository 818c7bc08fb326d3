import math

import numpy as np
import pytest

from codeloom.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>"


def test_against_a_library_decomposition(spark):
    rng = np.random.default_rng(3)
    made = (rng.normal(size=(400, 12)) @ rng.normal(size=(12, 12)) * np.linspace(0.1, 2, 12)).astype(np.float32)
    table = [(i, v.tolist()) for i, v in enumerate(made)] + [(900, None), (901, [1.0] * 11 + [float("nan")]), (902, [1.0] * 11 + [float("inf")]), (903, [1.0] * 11 + [None])]
    df = spark.createDataFrame(table, SCHEMA).selectExpr("*", "1 AS x", "2 AS id", "3 AS component").repartition(5)
    got = wh.whiten(df.withColumnRenamed("id", "id_").withColumnRenamed("id_", "id")).collect()
    x = np.floor(1024 * made.astype(np.float64)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(0)
    centred = x - sums / n
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == n * 8 and {r.id for r in got} == set(range(n)) and {r.n for r in got} == {n}
    for r in got:
        assert r.deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[r.id], sums))
        assert math.isclose(r.explained, values[r.component - 1] / np.trace(v), rel_tol=1e-9) and r.identity_error < 1e-9
    white = np.zeros((n, 8))
    for r in got:
        white[r.id, r.component - 1] = r.whitened
    want = centred @ vectors[:, :8] / np.sqrt(values[:8])
    want *= np.sign((want * white).sum(0))
    assert np.abs(white - want).max() < 1e-8
    assert np.abs(white.T @ white / n - np.eye(8)).max() < 1e-8


def test_factor_and_rotations():
    rng = np.random.default_rng(1)
    low = rng.normal(size=(20, 5))
    v = low @ low.T
    g = wh.pivoted_cholesky(v)
    assert g.shape == (20, 5) and np.allclose(g @ g.T, v)
    b = wh.one_sided_jacobi(g)
    assert np.allclose(b @ b.T, v) and np.allclose(b.T @ b, np.diag(np.diag(b.T @ b)))


@pytest.mark.parametrize("table,many", [([], 0), ([(1, [1.0, 2.0])], 0), ([(1, [1.0, 2.0]), (2, [1.0, 2.0])], 0), ([(1, [1.0, 2.0]), (1, [3.0, 2.0]), (None, [3.0, 5.0])], 6)])
def test_few_vectors(spark, table, many):
    assert wh.whiten(spark.createDataFrame(table, SCHEMA)).count() == many


def test_lengths_and_large_entries(spark):
    table = [(1, [1.0, 2.0]), (2, [4.0, 1.0]), (3, [4.0, 1.0, 1.0]), (4, [1e30, 0.0]), (5, [])]
    got = wh.whiten(spark.createDataFrame(table, SCHEMA)).collect()
    assert {r.id for r in got} == {1, 2} and {r.component for r in got} == {1}
