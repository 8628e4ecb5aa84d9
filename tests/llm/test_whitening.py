from fractions import Fraction

import numpy as np
import pytest

from occuflow.llm import vectors, whitening

SCHEMA = "vec_id long, embedding array<float>"


def exact(fit):
    """Covariance in fractions."""
    n, d = len(fit), len(fit[0])
    mean = [Fraction(sum(x[i] for x in fit), n) for i in range(d)]
    return [[sum((x[i] - mean[i]) * (x[j] - mean[j]) for x in fit) / n for j in range(d)] for i in range(d)]


def result(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    return whitening.op13_whitening(spark, str(tmp_path)).collect()


def check(rows, got, at_most=4):
    kept = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    cov = np.array([[float(c) for c in row] for row in exact(fit)])
    values, vecs = np.linalg.eigh(cov)
    values, vecs = values[::-1], vecs[:, ::-1]
    assert len(got) == len(kept) * at_most and all(r["n"] == n and 0 <= r["identity_error"] <= 1e-4 for r in got)
    by = {}
    for r in got:
        by.setdefault(r["component"], {})[r["vec_id"]] = r
    assert sorted(by) == list(range(1, at_most + 1))
    for k, mine in by.items():
        assert all(abs(r["explained"] - values[k - 1] / np.trace(cov)) <= 1e-4 * values[k - 1] / np.trace(cov) for r in mine.values())
        want = {i: (np.array(x) - np.array(s) / n) @ vecs[:, k - 1] / np.sqrt(values[k - 1]) for i, x in kept}
        first = max(want, key=lambda i: abs(want[i]))
        sign = np.sign(want[first] * mine[first]["whitened"])
        assert all(abs(mine[i]["whitened"] - sign * want[i]) < 1e-6 * (1 + abs(want[i])) for i in want)
    for i, x in kept:
        assert by[1][i]["deviation"] == sum((n * c - t) ** 2 for c, t in zip(x, s))


def test_equals_exact_covariance(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal(size=6) * [5, 3, 2, 1, 0.5, 0.1] + 700]) for i in range(120)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)] + [(2, None), (3, [None] * 6), (4, [float("nan")] * 6), (5, [float("inf")] + [0.0] * 5)]
    rows = [(i if i > 5 or k < 6 else 5000 + i, v) for k, (i, v) in enumerate(rows)]
    check(rows, result(spark, rows, tmp_path))


def test_small_eigenvalues_beside_large_ones():
    """A covariance of condition 1e18: plain doubles would lose the last components."""
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.normal(size=(5, 5)))[0]
    values = np.array([1e12, 1e6, 1.0, 1e-3, 1e-6])
    exact_q = [[Fraction(float(c)) for c in row] for row in q]
    cov = [[sum(exact_q[i][k] * Fraction(float(values[k])) * exact_q[j][k] for k in range(5)) for j in range(5)] for i in range(5)]
    high = np.array([[float(c) for c in row] for row in cov])
    low = np.array([[float(c - Fraction(h)) for c, h in zip(row, hs)] for row, hs in zip(cov, high.tolist())])
    vecs, got = whitening.leading(high, low, 4)
    assert np.allclose(got / values[:4], 1, rtol=1e-4)
    assert np.abs(np.abs((vecs * q[:, :4]).sum(axis=0)) - 1).max() < 1e-9
    plain = np.linalg.eigh(high)[0][::-1]
    assert abs(plain[3] / values[3] - 1) > 1e-4  # so the refinement is needed


def test_double_doubles_are_exact():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=50) * 2.0 ** rng.integers(-30, 30, 50), rng.normal(size=50) * 2.0 ** rng.integers(-30, 30, 50)
    for f, op in ((vectors.two_sum, lambda x, y: x + y), (vectors.two_product, lambda x, y: x * y)):
        h, e = f(a, b)
        assert all(Fraction(float(p)) + Fraction(float(q)) == op(Fraction(float(x)), Fraction(float(y))) for p, q, x, y in zip(h, e, a, b))
    h, e = vectors.dd_total(np.concatenate([a, -a])[:, None], np.concatenate([b * 1e-30, b * 1e-30])[:, None])
    want = sum(map(Fraction, (b * 1e-30).tolist())) * 2
    assert abs(Fraction(float(h[0])) + Fraction(float(e[0])) - want) <= abs(want) * Fraction(1, 10**6)


def test_deviations_stay_exact_beyond_longs():
    model = whitening.Whitening(10**9, [5 * 10**12 + 7, -3], np.zeros((2, 0)), np.zeros(0), 1.0)
    x = np.array([[5000, 0], [2**33, 1]])
    assert whitening.deviations(x, model) == [49 + 9, None]
    assert whitening.deviations(np.array([[3, 4]]), whitening.Whitening(2, [1, 1], np.zeros((2, 0)), np.zeros(0), 1.0)) == [25 + 49]


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [0.5, 0.5]), (2, [0.5, 0.5])]])
def test_nothing_to_whiten(spark, tmp_path, rows):
    assert result(spark, rows, tmp_path) == []


def test_few_dimensions_nulls_and_repeats(spark, tmp_path):
    rows = [(None, [1.0, 2.0]), (None, [1.0, 2.0]), (1, [2.0, 0.0]), (1, [0.0]), (2, [1.0, 1.0])]
    got = result(spark, rows, tmp_path)
    assert len(got) == 10 and {r["n"] for r in got} == {4} and {r["component"] for r in got} == {1, 2}
    # equal eigenvalues and a rank of one
    line = [(i, [float(i), 2.0 * i, 0.0]) for i in range(9)]
    assert {r["component"] for r in result(spark, line, tmp_path / "line")} == {1}
