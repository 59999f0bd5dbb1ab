"""Spectrum slicing beside numpy's eigenvalues, and whitening beside plain whole-number arithmetic."""

import math
from fractions import Fraction

import numpy as np
import pytest

from tagspark.llm import whitening as W

SF_COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def symmetric(values, seed):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return (q * np.asarray(values, dtype=float)) @ q.T


@pytest.mark.parametrize("seed", range(20))
def test_inertia_counts_positive_eigenvalues(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 30))
    a = rng.standard_normal((n, n))
    a = a + a.T
    if seed % 3 == 0:
        np.fill_diagonal(a, 0)
    assert W.inertia(a) == (np.linalg.eigvalsh(a) > 0).sum()


def test_inertia_of_blocks_and_nothing():
    assert W.inertia(np.array([[0.0, 1], [1, 0]])) == 1
    assert W.inertia(np.zeros((3, 3))) == 0
    assert W.inertia(np.zeros((0, 0))) == 0


@pytest.mark.parametrize(
    "values",
    [range(1, 41), [5.0] * 6 + [1.0] * 3, [1, 1 + 1e-9, 1 + 2e-9, 0.5], [1e6, 1, 1e-6, 0, 0], [3], [2, 2 - 1e-13, 1], np.exp(-np.arange(25.0))],
)
def test_leading_eigenvalues(values):
    a = symmetric(values, 7)
    a = (a + a.T) / 2
    found, vectors = W.leading(a, 32)
    want = np.sort(np.linalg.eigvalsh(a))[::-1]
    size = np.abs(want).max()
    assert np.allclose(found, want[: len(found)], rtol=0, atol=1e-13 * len(a) * size)
    assert np.allclose(vectors @ vectors.T, np.eye(len(found)), atol=1e-12)
    assert np.abs(a @ vectors.T - vectors.T * found).max() <= 1e-12 * size
    assert len(found) == min(32, (want > 1e-14 * len(a) * size).sum())


def plain(rows):
    """The contract over rows of (id, vector), in exact fractions but for the eigenvectors."""
    kept = [(i, [math.floor(64 * c) + 1000000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n, d = len(kept), len(kept[0][1])
    sums = [sum(x[j] for _, x in kept) for j in range(d)]
    cov = [[sum(Fraction(n * x[a] - sums[a]) * (n * x[b] - sums[b]) for _, x in kept) / n**3 for b in range(d)] for a in range(d)]
    deviation = {i: sum((n * x[j] - sums[j]) ** 2 for j in range(d)) for i, x in kept}
    return kept, n, sums, np.array([[float(v) for v in r] for r in cov]), deviation


def check(spark, rows, most=32):
    got = W.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>, n string, `a.b` int"), most).collect()
    pairs = [(r[0], r[1]) for r in rows]
    kept, n, sums, cov, deviation = plain(pairs)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1].T
    k = min(most, (values > 1e-12 * values[0]).sum())
    assert len(got) == k * len(kept)
    by = {(r["vec_id"], r["component"]): r for r in got}
    w = np.array([[by[i, c]["whitened"] for c in range(1, k + 1)] for i, _ in kept])
    for c in range(k):
        plainly = np.array([sum((x[j] - Fraction(sums[j], n)) * Fraction(float(vectors[c][j])) for j in range(len(x))) for _, x in kept], dtype=float) / math.sqrt(values[c])
        assert min(np.abs(w[:, c] - plainly).max(), np.abs(w[:, c] + plainly).max()) < 1e-7
    assert np.abs(w.T @ w / n - np.eye(k)).max() < 1e-9
    for r in got:
        assert (r["n"], r["deviation"]) == (n, deviation[r["vec_id"]])
        assert abs(r["explained"] - values[r["component"] - 1] / np.trace(cov)) < 1e-12 and r["identity_error"] < 1e-9
    return got


def test_small_tables(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.standard_normal(5) * [9, 5, 3, 2, 1]], "x", 1) for i in range(60)]
    bad = [(100, None, "x", 1), (101, [1.0, None, 1.0, 1.0, 1.0], "x", 1), (102, [1.0, float("nan"), 1.0, 1.0, 1.0], "x", 1), (103, [1.0, float("inf"), 1.0, 1.0, 1.0], "x", 1)]
    check(spark, rows + bad)
    assert {r["component"] for r in check(spark, rows, 2)} == {1, 2}


def test_lost_ranks_and_other_shapes(spark):
    flat = [(i, [float(i % 7), 2.0 * (i % 7), 5.0], "x", 1) for i in range(30)]
    assert {r["component"] for r in check(spark, flat)} == {1}
    make = lambda rows: W.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert make([]).collect() == [] and make([]).columns == SF_COLUMNS
    assert make([(1, [1.0, 2.0])] * 3).collect() == []
    assert make([(1, []), (None, None)]).collect() == []
    mixed = make([(i, [float(i), float(i * i % 5)]) for i in range(9)] + [(50, [1.0]), (51, [1e300, 1.0]), (None, [3.0, 4.0])]).collect()
    assert {r["vec_id"] for r in mixed} == {*range(9), None} and {r["n"] for r in mixed} == {10}


def test_wide_entries_stay_exact(spark):
    rows = [(i, [float(2**30 * (i % 3)), float(i)]) for i in range(12)]
    got = W.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    deviation = plain(rows)[4]
    assert all(r["deviation"] == (deviation[r["vec_id"]] if deviation[r["vec_id"]] < 2**63 else None) for r in got)
    y = np.array([[2**40, 3], [2**41, -5]])
    assert list(W.products(y)) == [3 * 2**40, -2, 2**80 + 2**82, 3 * 2**40 - 5 * 2**41, 34]
