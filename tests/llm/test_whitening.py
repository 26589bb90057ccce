"""Whitening against a plain computation."""

import numpy as np
import pytest

from loglattice.llm import whitening as w

SCHEMA = "vec_id long, embedding array<double>, id long, code string, dims int"


def table(spark, vectors, parts=3):
    return spark.createDataFrame([(k, v, 1, "x", 2) for k, v in enumerate(vectors)], SCHEMA).repartition(parts)


def plain(vectors):
    """The grid, its distinct vectors' number and sums, and eigenvalues and eigenvectors of their covariance."""
    x = np.floor(64 * np.array(vectors)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    values, vectors = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True).reshape(x.shape[1], -1))
    return x, len(fit), fit.sum(axis=0), values[::-1], vectors[:, ::-1]


def test_equals_the_plain_computation(spark):
    draw = np.random.default_rng(3)
    some = (draw.normal(size=(120, 9)) * np.array([9, 5, 3, 2, 1, 0.6, 0.4, 0.2, 0.1])).tolist()
    vectors = some + some[:30] + [some[0]] * 20
    x, n, sums, values, directions = plain(vectors)
    rows = {(r["vec_id"], r["component"]): r for r in w.whiten(table(spark, vectors)).collect()}
    assert len(rows) == 9 * len(vectors) and {r["n"] for r in rows.values()} == {n}
    want = (x - sums / n) @ directions / np.sqrt(values)
    for k in range(9):
        got = np.array([rows[i, k + 1]["whitened"] for i in range(len(vectors))])
        assert min(np.abs(got - want[:, k]).max(), np.abs(got + want[:, k]).max()) < 1e-8
        assert abs(rows[0, k + 1]["explained"] - values[k] / values.sum()) < 1e-12
    assert all(rows[i, 1]["deviation"] == sum(int(d) ** 2 for d in n * x[i] - sums) for i in range(len(vectors)))
    assert {r["identity_error"] for r in rows.values()} == {rows[0, 1]["identity_error"]} and rows[0, 1]["identity_error"] < 1e-9


def test_rows_that_are_left_out(spark):
    good = [[1.0, 2.0], [2.0, 0.5], [0.0, 0.0], [3.0, 3.0]]
    bad = [None, [], [1.0, None], [float("nan"), 1.0], [1.0, float("inf")], [1e300, 0.0], [1.0], [1.0, 2.0, 3.0]]
    rows = w.whiten(table(spark, good + bad)).collect()
    assert {r["vec_id"] for r in rows} == {0, 1, 2, 3} and {r["component"] for r in rows} == {1, 2} and {r["n"] for r in rows} == {4}
    assert w.whiten(table(spark, [[1.0, 2.0]]).filter("false")).count() == 0
    assert w.whiten(table(spark, bad[:5])).count() == 0


def test_no_variance(spark):
    same = w.whiten(table(spark, [[1.0, 2.0]] * 5)).collect()
    assert len(same) == 10 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in same} == {(1, 0, None, 0.0, 0.0)}
    line = w.whiten(table(spark, [[float(k), 2.0 * k, 7.0] for k in range(6)])).collect()
    assert {(r["component"], r["whitened"] is None) for r in line} == {(1, False), (2, True), (3, True)}


def test_large_numbers_stay_exact(spark):
    vectors = [[1e12, 3.0], [-4e14, 5.0], [2.0, 6.5]]
    x, n, sums, _, _ = plain(vectors)
    got = {r["vec_id"]: r["deviation"] for r in w.whiten(table(spark, vectors)).collect()}
    want = [sum(int(d) ** 2 for d in n * row.astype(object) - sums.astype(object)) for row in x]
    assert [got[k] for k in range(3)] == [d if d < 1 << 63 else None for d in want]


@pytest.mark.parametrize("n", [1, 2, 5, 8, 33])
def test_small_eigenvalues(n):
    """Values over many sizes, each to its own precision, from a matrix with graded rows."""
    draw = np.random.default_rng(n)
    scale = 10.0 ** -np.linspace(0, 12, n)
    base = draw.normal(size=(n, 4 * n + 4))
    matrix = scale[:, None] * (base @ base.T) * scale
    values, vectors = w.jacobi(matrix)
    assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-13 and (np.diff(values) <= 0).all()
    exact = np.linalg.svd(scale[:, None] * base, compute_uv=False) ** 2
    assert np.allclose(values[: n // 2 + 1], exact[: n // 2 + 1], rtol=1e-10)
    assert abs(np.prod(values / scale**2) / np.linalg.det(base @ base.T) - 1) < 1e-8


def test_codes_keep_numbers():
    import pyarrow as pa

    vectors = [[0.0, -1.9], [700.0, 2.0], [1e7, -1e7], [1e15, 0.1]]
    codes = w.pack(pa.array(vectors, pa.list_(pa.float64())))
    assert [c[0] for c in codes] == [1, 4, 4, 8]
    assert w.unpack(codes, 2).tolist() == [[int(np.floor(64 * c)) for c in v] for v in vectors]
