import math
import random

import numpy as np
import pytest

from daybook.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n string"


def plain(given, count=4):
    """Expected rows by numpy's eigensolver over all distinct whole-number vectors."""
    keep = [(i, v) for i, v in given if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    xs = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v in keep]
    fit = sorted({x for _, x in xs})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array(fit, float) - np.array([s / n for s in sums])
    e, q = np.linalg.eigh(y.T @ y / n)
    e, q = e[::-1][:count], q[:, ::-1][:, :count]
    out = {}
    for i, x in xs:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        z = (np.array(x) - np.array([s / n for s in sums])) @ q / np.sqrt(e)
        out.setdefault(i, []).append((n, deviation, z, e / np.trace(y.T @ y / n)))
    return out


def table(spark, given):
    return spark.createDataFrame([(i, v, 1, "a", "b") for i, v in given], SCHEMA)


def test_equals_an_eigensolver(spark):
    rng = np.random.default_rng(3)
    mixed = rng.standard_normal((9, 9)) * np.linspace(0.2, 2, 9)
    given = [(i, (rng.standard_normal(9) @ mixed).tolist()) for i in range(200)]
    given += [(300 + i, given[0][1]) for i in range(40)]  # copies count once
    given += [(400, None), (401, [None] * 9), (402, [float("nan")] * 9), (403, [math.inf] * 9), (None, given[5][1]), (7, given[8][1])]
    got = {}
    for r in W.whiten(table(spark, given)).collect():
        got.setdefault((r.vec_id, r.deviation), {})[r.component] = r
    want = plain(given)
    assert {i for i, _ in got} == set(want) and len(got) == len(given) - 4
    sign = None
    for i, rows in want.items():
        for n, deviation, z, explained in rows:
            found = [got[i, deviation][c] for c in range(1, 5)]
            assert {r.n for r in found} == {n}
            mine = np.array([r.whitened for r in found])
            sign = np.sign(mine * z) if sign is None else sign  # one sign per component for all rows
            assert np.allclose(mine * sign, z, atol=1e-9)
            assert np.allclose([r.explained for r in found], explained, rtol=1e-10)
            assert max(r.identity_error for r in found) < 1e-9


@pytest.mark.parametrize("size", [1, 2, 3, 17, 64])
def test_spectrum_of_awkward_matrices(size):
    rng = np.random.default_rng(size)
    q = np.linalg.qr(rng.standard_normal((size, size)))[0]
    spectra = [
        np.arange(size, 0.0, -1), np.full(size, 3.0), np.zeros(size), 2.0 ** -np.arange(size), np.where(np.arange(size) < size / 3, 5.0, 1.0),
        np.concatenate([[1e12], np.ones(size - 1)]), 1 + 1e-9 * np.arange(size), rng.standard_normal(size),
    ]
    for e in spectra:
        a = q * e @ q.T
        values, vectors = W.spectrum(a, size)
        scale = max(1e-300, np.abs(e).max())
        assert np.allclose(values, np.sort(e)[::-1], atol=1e-12 * size * scale)
        assert np.allclose(vectors.T @ vectors, np.eye(size), atol=1e-12 * size)
        assert np.allclose(a @ vectors, vectors * values, atol=1e-11 * size * scale)
        top, axes = W.spectrum(a, min(4, size))
        assert len(top) >= min(4, size) and np.allclose(a @ axes, axes * top, atol=1e-11 * size * scale)


def test_orthogonal_factor_is_the_matrix_sign():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((20, 20))
    e, q = np.linalg.eigh(a + a.T)
    assert np.allclose(W.orthogonal_factor(a + a.T), q * np.sign(e) @ q.T, atol=1e-12)


def test_edges(spark):
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for given in ([], [(1, None)], [(1, [])], [(1, [0.5, 1.0]), (2, [0.5, 1.0])]):
        out = W.whiten(table(spark, given))
        assert out.columns == names and out.count() == 0
    # Two places give two components at most, a vanishing one none; another length is left out.
    rng = random.Random(0)
    line = [(i, [float(i), 2.0 * i]) for i in range(10)]
    flat = W.whiten(table(spark, [*line, (50, [1.0, 2.0, 3.0])])).collect()
    assert {r.component for r in flat} == {1} and len(flat) == 10 and all(abs(r.explained - 1) < 1e-12 for r in flat)
    both = W.whiten(table(spark, [(i, [rng.random(), rng.random()]) for i in range(10)])).collect()
    assert {r.component for r in both} == {1, 2}
    # Entries too large for exact machine numbers: the deviation is exact where a long holds it, else null.
    huge = W.whiten(table(spark, [(1, [3e13, 1.0]), (2, [-3e13, 2.0]), (3, [3e13, 3.0])])).collect()
    assert {r.deviation for r in huge} == {None} and max(r.identity_error for r in huge if r.component == 1) < 1e-4
