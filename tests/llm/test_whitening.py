"""Whitening against a dense eigendecomposition, and the solver on hard spectra."""

import math

import numpy as np
import pytest

from ringdata.llm.whitening import deviations, jacobi_davidson, minres, op12_whitening, whiten


def plain(rows, k=8):
    """{(id, place): (n, deviation, whitened, explained)} from the dense covariance."""
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in rows], dtype=object)
    n, s = len(x), x.sum(axis=0)
    deviation = ((n * x - s) ** 2).sum(axis=1)
    y = (n * x - s).astype(float) / n
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return n, deviation.tolist(), y @ u / np.sqrt(e), e / np.trace(y.T @ y / n)


def check(got, rows, k=8):
    n, deviation, white, explained = plain(rows, k)
    by = {}
    for r in got:
        by.setdefault(r.component, {})[r.vec_id] = r
    assert sorted(by) == list(range(1, k + 1))
    for c, found in by.items():
        assert len(found) == n
        mine = np.array([found[i].whitened for i, _ in rows])
        want = white[:, c - 1]
        sign = np.sign(mine @ want)
        assert np.allclose(mine, sign * want, atol=1e-7)
        for (i, _), dev in zip(rows, deviation, strict=True):
            assert (found[i].n, int(found[i].deviation)) == (n, dev)
            assert found[i].explained == pytest.approx(explained[c - 1], rel=1e-9)
            assert found[i].identity_error < 1e-9


def frame(spark, rows, more=""):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>" + more)


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    check(op12_whitening(spark, d).collect(), rows)


def test_odd_vectors(spark):
    good = [(i, [float((i * 7) % 5), float((i * 3) % 11), i / 3]) for i in range(40)]
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, float("nan"), 2.0]), (103, [float("inf"), 0.0, 1.0]), (104, [1.0]), (105, []), (106, [1e30, 0.0, 0.0])]
    got = whiten(frame(spark, [(i, v, "x", 1.0) for i, v in good + bad], ", x string, n double"))
    check(got.collect(), good, k=3)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_repeats_and_null_ids(spark):
    rows = [(None, [1.0, 2.0])] * 2 + [(2**60 + 1, [3.0, -1.0])] * 3 + [(6, [0.0, 0.5])]
    got = whiten(frame(spark, rows)).collect()
    assert sorted(str(r.vec_id) for r in got) == sorted(["None"] * 4 + [str(2**60 + 1)] * 6 + ["6"] * 2)
    assert len({round(r.whitened, 12) for r in got if r.vec_id == 2**60 + 1 and r.component == 1}) == 1


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(9)], [(1, None), (2, [])]])
def test_nothing_to_whiten(spark, rows):
    assert whiten(frame(spark, rows)).collect() == []


def test_fewer_directions_than_components(spark):
    rows = [(i, [float(i), 2.0 * i, 0.0, 7.0]) for i in range(20)]  # on one line
    got = whiten(frame(spark, rows)).collect()
    assert len(got) == 20 and {r.component for r in got} == {1}
    assert got[0].explained == pytest.approx(1.0) and got[0].identity_error < 1e-9


def test_large_numbers_stay_exact():
    x = np.array([[2**40, -(2**40)], [1, 5], [2**40 + 1, 3]], dtype=np.int64)
    s = [int(v) for v in x.sum(axis=0)]
    n = 3_000_000_000
    assert deviations(x, n, s) == [sum((n * int(v) - t) ** 2 for v, t in zip(r, s, strict=True)) for r in x]
    assert deviations(x[1:2], 3, [1, 2]) == [(3 - 1) ** 2 + (15 - 2) ** 2]


@pytest.mark.parametrize(
    "values",
    [np.linspace(1, 2, 64), 2.0 ** -np.arange(64), np.ones(40), np.r_[np.ones(20) * 5, np.ones(200)], np.r_[np.linspace(1, 1.001, 12), np.linspace(0, 0.9, 300)], np.array([3.0, 2, 1]), np.array([4.0]), np.r_[3.0, np.zeros(30)]],
    ids=["flat", "decay", "equal", "tied", "near", "small", "one", "rank1"],
)
def test_solver(values):
    d = len(values)
    q, _ = np.linalg.qr(np.random.default_rng(3).standard_normal((d, d)))
    v = (q * values) @ q.T
    found = jacobi_davidson(lambda b: v @ b, d, 8)
    k = min(8, d)
    assert np.allclose(found.values, np.sort(values)[::-1][:k], atol=1e-12 * values.max())
    assert np.allclose(found.vectors.T @ found.vectors, np.eye(k), atol=1e-12)
    assert np.abs(v @ found.vectors - found.vectors * found.values).max() <= 3e-13 * values.max()


def test_minres_solves_each_column():
    rng = np.random.default_rng(4)
    a = rng.standard_normal((30, 30))
    a, theta, b = a + a.T, np.array([0.3, -1.0]), rng.standard_normal((30, 2))
    t = minres(lambda z: a @ z, theta, b, lambda z: z, 60)
    for j in range(2):
        assert np.allclose((a - theta[j] * np.eye(30)) @ t[:, j], b[:, j], atol=1e-6)
