"""Eigenvectors against the library's, whitening against a plain computation in numpy."""

from fractions import Fraction

import numpy as np
import pytest

from netlens.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>"


def covariance(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))[0]
    a = (q * values) @ q.T
    return (a + a.T) / 2


CASES = {
    "spread": np.geomspace(1e4, 1e-3, 40),
    "close": 5.0 + 1e-7 * np.arange(24),
    "clusters": np.repeat([9.0, 3.0, 3.0 + 1e-9, 1.0, 1e-6], [4, 3, 5, 1, 7]),
    "pairs": np.sort(np.r_[np.arange(1.0, 30), np.arange(1.0, 30) + 1e-5]),
    "equal": np.ones(16),
    "low rank": np.r_[[100.0, 50, 25], np.zeros(20)],
    "one": np.array([3.0]),
    "huge": np.linspace(1, 9, 12) * 1e60,
}


@pytest.mark.parametrize("case", list(CASES))
def test_eigenvectors_to_double_precision(case):
    a = covariance(CASES[case])
    values, x = wh.eigenvectors(a)
    size, d = np.abs(a).max(), len(a)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], rtol=0, atol=1e-13 * size * d)
    assert np.abs(x.T @ x - np.eye(d)).max() < 1e-13
    assert np.abs(a @ x - x * values).max() < 2e-14 * size * d
    single = np.linalg.eigh((a / size).astype(np.float32))[1].astype(float)
    if d > 10 and case != "equal":  # the float32 vectors are far from that
        assert np.abs(single.T @ single - np.eye(d)).max() > 1e-8


def test_separate_vectors_equal_the_library():
    a = covariance(np.linspace(1, 20, 30))
    _, x = wh.eigenvectors(a)
    y = np.linalg.eigh(a)[1][:, ::-1]
    assert np.abs(np.abs((x * y).sum(0)) - 1).max() < 1e-14
    assert (x[np.abs(x).argmax(0), range(30)] > 0).all()


def plain(rows, components=16):
    """{id: [(deviation, whitened, explained)]} of (id, vector) rows, n, and the components' eigenvalues."""
    good = [(i, [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, d = len(fit), len(fit[0])
    s = [sum(x[j] for x in fit) for j in range(d)]
    mean = [Fraction(v, n) for v in s]
    y = np.array([[float(v - m) for v, m in zip(x, mean, strict=True)] for x in fit])
    v = y.T @ y / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > d * np.finfo(float).eps * values[0]).sum()))
    out = {}
    for i, x in good:
        z = np.array([float(a - m) for a, m in zip(x, mean, strict=True)]) @ vectors[:, :k] / np.sqrt(values[:k])
        out.setdefault(i, []).append((sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True)), z, values[:k] / np.trace(v)))
    return out, n


def rows_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.vec_id, []).append(r)
    return out


@pytest.mark.parametrize("seed,dims", [(0, 20), (1, 8), (2, 64)])
def test_against_a_plain_computation(spark, seed, dims):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(300, dims)) * np.linspace(4, 1, dims)
    rows = [(k, base[k % 150 if k < 250 else 7].tolist()) for k in range(400)]
    rows += [(900, None), (901, [None] * dims), (902, [float("nan")] * dims), (903, [1.0] * (dims - 1) + [float("-inf")]), (904, []), (905, [1.0])]
    got = rows_of(wh.whitened(spark.createDataFrame(rows, SCHEMA).repartition(7)))
    want, n = plain(rows[:400])
    assert set(got) == set(want) and all(len(v) == min(16, dims) for v in got.values())
    signs = None
    for i, found in got.items():
        found.sort(key=lambda r: r.component)
        (deviation, z, explained), w = want[i][0], np.array([r.whitened for r in found])
        signs = np.sign(w * z) if signs is None else signs
        assert [r.component for r in found] == list(range(1, len(found) + 1))
        assert {r.n for r in found} == {n} and {r.deviation for r in found} == {deviation}
        assert np.allclose(w * signs, z, atol=1e-9) and np.allclose([r.explained for r in found], explained, rtol=1e-10)
    assert max(r.identity_error for v in got.values() for r in v) < 1e-10


def test_odd_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, f"{SCHEMA}, x string, id int")
    extra = lambda rows: make([(*r, "a", 1) for r in rows])
    assert wh.whitened(make([])).count() == 0
    assert wh.whitened(extra([(1, None), (2, []), (3, [1e30, 2.0])])).count() == 0
    assert wh.whitened(extra([(1, [1.0, 2.0])] * 3)).count() == 0  # one vector has no spread
    got = wh.whitened(extra([(1, [0.0, 5.0]), (1, [0.0, 5.0]), (None, [1.0, 5.0]), (3, [2.0, 5.0])])).collect()
    assert len(got) == 4 and {r.component for r in got} == {1}  # the second dimension is constant
    assert sorted((r.vec_id or 0, round(abs(r.whitened), 6), r.n) for r in got) == [(0, 0.0, 3), (1, 1.224745, 3), (1, 1.224745, 3), (3, 1.224745, 3)]


def test_large_numbers_stay_exact(spark):
    big = 1e11
    rows = [(1, [big, 0.0]), (2, [-big, 1.0]), (3, [big, 2.0])]
    got = {r.vec_id: r.deviation for r in wh.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert set(got) == {1, 2, 3} and set(got.values()) == {None}  # beyond 64 bits
    small = wh.whitened(spark.createDataFrame([(k, [float(k), 1.0 / (k + 1)]) for k in range(9)], SCHEMA)).collect()
    assert {r.vec_id: r.deviation for r in small} == {i: v[0][0] for i, v in plain([(k, [float(k), 1.0 / (k + 1)]) for k in range(9)])[0].items()}
