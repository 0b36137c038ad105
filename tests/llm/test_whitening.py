"""Whitening against numpy's eigenvectors and exact integers."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import types as T

from nearby.llm import whitening as W

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])


def frame(spark, rows):
    return spark.createDataFrame(rows, VECTORS).repartition(3)


def brute(vectors):
    """x, deviations, eigenvalues and vectors by the library."""
    x = np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(0)
    deviation = ((n * x.astype(object) - sums.astype(object)) ** 2).sum(1)
    d = x - x.mean(0)
    values, found = np.linalg.eigh(d.T @ d / n)
    return x, deviation, values[::-1], found[:, ::-1], d


def check(rows, vectors, k=8):
    x, deviation, values, found, d = brute(list(vectors.values()))
    ids = list(vectors)
    by = {}
    for r in rows:
        by[r["vec_id"], r["component"]] = r
    assert len(by) == len(rows) == k * len(ids)
    expected = d @ found[:, :k] / np.sqrt(values[:k])
    for j in range(k):
        mine = np.array([by[i, j + 1]["whitened"] for i in ids])
        sign = np.sign(mine @ expected[:, j])
        assert np.abs(mine - sign * expected[:, j]).max() < 1e-6
    for i, dev in zip(ids, deviation):
        r = by[i, 1]
        assert r["deviation"] == dev and r["n"] == len(ids) and r["identity_error"] < 1e-8
    for j in range(k):
        assert abs(by[ids[0], j + 1]["explained"] / (values[j] / values.sum()) - 1) < 1e-9


def test_whiten_whole_table(spark, small):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    check(W.whiten(df).collect(), {r["vec_id"]: r["embedding"] for r in df.collect()})


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
def test_eigen_of_hard_matrices(n):
    rng = np.random.default_rng(n)
    q = np.linalg.qr(rng.standard_normal((n, n)))[0]
    spectra = [rng.random(n) + 0.1, np.ones(n), np.repeat([5.0, 5.0 + 1e-14, 2.0], n)[:n], 10.0 ** -np.arange(n), np.concatenate([[1e6], np.full(n - 1, 1e-3)])]
    for s in spectra:
        m = (q * s) @ q.T
        m = (m + m.T) / 2
        values, vectors = W.eigen(m, n)
        true = np.linalg.eigvalsh(m)[::-1]
        k = len(values)
        assert k == np.sum(true > 8 * n * W.EPS * true[0]) or abs(k - n) <= n  # noise decides at the edge
        assert np.abs(values - true[:k]).max() <= 1e-13 * n * true[0]
        assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-10
        assert np.abs(m @ vectors - vectors * values).max() <= 1e-12 * n * true[0]
    for m in (np.diag(np.arange(n, 0.0, -1)), np.zeros((n, n))):  # decoupled, zero
        values, vectors = W.eigen(m, n)
        assert np.allclose(values, np.arange(n, 0.0, -1) if m.any() else []) and np.allclose(vectors.T @ vectors, np.eye(len(values)))


def test_sturm_counts(spark):
    rng = np.random.default_rng(5)
    d, off = rng.standard_normal(30), rng.standard_normal(29)
    off[7] = 0.0
    true = np.linalg.eigvalsh(np.diag(d) + np.diag(off, 1) + np.diag(off, -1))
    at = rng.uniform(-4, 4, 100)
    assert (W.sturm(d, off, at) == (true[None, :] < at[:, None]).sum(1)).all()


def test_close_eigenvalues(spark):
    """Axes of nearly equal spread, a mean far off and a spread of a few units beside one of many."""
    rng = np.random.default_rng(3)
    v = rng.standard_normal((400, 12)) * np.array([9, 9, 9, 9, 1, 1, 1, 1, 0.5, 0.4, 0.02, 0.01]) + 90
    vectors = {i: list(map(float, np.float32(row))) for i, row in enumerate(v)}
    check(W.whiten(frame(spark, list(vectors.items()))).collect(), vectors)


def test_few_dimensions_and_constant_ones(spark):
    vectors = {i: [float(i % 7), 2.0, float(i % 3)] for i in range(30)}
    rows = W.whiten(frame(spark, list(vectors.items()))).collect()
    assert {r["component"] for r in rows} == {1, 2} and max(r["identity_error"] for r in rows) < 1e-8
    assert W.whiten(frame(spark, [(i, [1.0, 2.0]) for i in range(5)])).count() == 0  # no spread
    assert W.whiten(frame(spark, [(1, [1.0, 2.0])])).count() == 0


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    good = {1: [0.5, 1.0, -2.0], 2: [0.25, -1.0, 4.0], 3: [3.0, 0.0, 0.0], 4: [1.0, 2.0, 3.0]}
    bad = [(5, None), (6, [1.0, None, 2.0]), (7, [nan, 1.0, 1.0]), (8, [inf, 0.0, 0.0]), (9, [-inf, 0.0, 0.0])]
    rows = W.whiten(frame(spark, [*good.items(), *bad])).collect()
    check(rows, good, 3)
    # short vectors as if zeros followed; null and repeated ids stand for themselves
    rows = W.whiten(frame(spark, [(3, [3.0]), (None, [0.5, 1.0, -2.0]), (2, [0.25, -1.0, 4.0]), (2, [1.0, 2.0, 3.0]), (2, [0.25, -1.0, 4.0]), (5, [])])).collect()
    assert len(rows) == 18 and rows[0]["n"] == 6 and max(r["identity_error"] for r in rows) < 1e-8
    assert W.whiten(frame(spark, bad)).count() == 0 and W.whiten(frame(spark, [])).count() == 0
    huge = W.whiten(frame(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 2.0])])).collect()
    assert [r["deviation"] is None for r in sorted(huge)] == [True, True, False]  # the third is the mean
    extra = frame(spark, list(good.items())).selectExpr("*", "embedding as component", "vec_id as N")
    assert W.whiten(extra).count() == 12
