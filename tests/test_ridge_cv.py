import numpy as np
import pytest
from pyspark.sql import functions as F

from occuflow.operators import models, nested

ALPHAS = np.logspace(-2, 3, 20)


def rows(seed=1, groups=9, n=30):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(groups * n, 3)) * [1, 20, 0.1] + [0, 100, 0]
    y = 3 + 2 * x[:, 0] - 0.1 * x[:, 1] + rng.normal(size=len(x))
    return np.repeat(np.arange(groups), n), x, y


def ridge(x, y, alpha):
    m, sd = x.mean(axis=0), x.std(axis=0, ddof=1)
    z = (x - m) / sd
    w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean())) / sd
    return lambda v: y.mean() + (v - m) @ w


def test_equals_a_loop_over_lots_folds_and_penalties(spark):
    g, x, y = rows()
    df = spark.createDataFrame([(int(k), *map(float, v), float(t)) for k, v, t in zip(g, x, y)] + [(0, None, 1.0, 1.0, 1.0), (0, 1.0, 1.0, 1.0, None)], "lot long, a double, b double, c double, y double").repartition(3)
    fold = dict(map(tuple, df.select("lot", F.pmod(F.xxhash64("lot"), F.lit(5)).cast("int")).distinct().collect()))
    of = np.array([fold[int(k)] for k in g])
    got = {r["lot"]: r for r in models.ridge_cv(df, "lot", ["a", "b", "c"], "y", ALPHAS).collect()}
    for lot in range(9):
        others, loss = g != lot, []
        for a in ALPHAS:
            total = 0.0
            for k in range(5):
                held = others & (of == k)
                if held.any():
                    total += ((ridge(x[others & ~held], y[others & ~held], a)(x[held]) - y[held]) ** 2).sum()
            loss.append(total)
        best = ALPHAS[int(np.argmin(loss))]
        miss = ridge(x[others], y[others], best)(x[~others]) - y[~others]
        r = got[lot]
        assert (r["n"], r["alpha"]) == (30, pytest.approx(best)) and r["mae"] == pytest.approx(np.abs(miss).mean()) and r["rmse"] == pytest.approx(np.sqrt((miss**2).mean()))


def test_constant_features_and_a_single_lot(spark):
    df = spark.createDataFrame([(i % 4, float(i), 1.0, 2.0 * i) for i in range(40)], "lot long, a double, b double, y double")
    got = models.ridge_cv(df, "lot", ["a", "b"], "y", ALPHAS).collect()
    assert len(got) == 4 and all(r["alpha"] == pytest.approx(0.01) and r["mae"] < 0.1 for r in got)
    assert models.ridge_cv(df.where("lot = 1"), "lot", ["a", "b"], "y", ALPHAS).count() == 0
    assert models.ridge_cv(df.limit(0), "lot", ["a", "b"], "y", ALPHAS).count() == 0


def test_inflation_is_that_of_regressions(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 7))
    x[:, 6] = x[:, 0] + 0.5 * x[:, 1] + 0.3 * rng.normal(size=400)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], [f"x{i}" for i in range(7)])
    got = {r["feature"]: r["vif"] for r in models.inflation(df, df.columns).collect()}
    for i in range(7):
        z = np.column_stack([np.ones(400), np.delete(x, i, axis=1)])
        rest = x[:, i] - z @ np.linalg.lstsq(z, x[:, i], rcond=None)[0]
        assert got[f"x{i}"] == pytest.approx(((x[:, i] - x[:, i].mean()) ** 2).sum() / (rest**2).sum())


def test_inflation_of_dependent_and_constant_features(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, float(i * i % 7), 3.0) for i in range(30)], "a double, b double, c double, d double")
    got = {r["feature"]: r["vif"] for r in models.inflation(df, df.columns).collect()}
    assert got["a"] == got["b"] == np.inf and 1 <= got["c"] < 2 and got["d"] is None
    assert [r["vif"] for r in models.inflation(df.select("a"), ["a"]).collect()] == [1.0]


def test_nested_documents_of_all_kinds(spark):
    docs = [
        '{"r": {"item": [{"n": "5", "s": "x"}, {"n": 7.5}, 3, null]}}', '{"r": {"item": {"n": "", "m": "4"}}}', '{"r": {"item": []}}', '{"r": {"item": "text"}}', '{"r": 1}', "{bad", None, '{"r": {"item": {"n": "0", "m": 9}}}', '{"r": {"item": {"n": "1e2"}}}',
    ]
    df = spark.createDataFrame(list(enumerate(docs)), "i int, doc string").withColumn("item_", F.lit(1))
    x = nested.flattened(df, "doc", "$.r.item").select("i", nested.field("s", "string"), nested.number("n"), nested.first_positive("n", "m"), "listed")
    got = sorted(map(tuple, x.collect()), key=repr)
    want = [
        (0, "x", 5.0, 5.0, True), (0, None, 7.5, 7.5, True), (1, None, None, 4.0, False), (2, None, None, None, True), (3, None, None, None, False), (4, None, None, None, False),
        (5, None, None, None, False), (6, None, None, None, False), (7, None, 0.0, 9.0, False), (8, None, 100.0, 100.0, False),
    ]
    assert got == sorted(want, key=repr)


def test_many_lots_are_solved_side_by_side():
    """2,000 lots at once take no longer than a few: the matrices are stacked, not visited one by one in Python."""
    rng = np.random.default_rng(3)
    x = np.concatenate([np.ones((2000, 30, 1)), rng.normal(size=(2000, 30, 7))], axis=2)
    own, fold = np.swapaxes(x, 1, 2) @ x, np.arange(2000) % 5
    parts = np.stack([own[fold == k].sum(axis=0) for k in range(5)])
    calls, eigh = [], np.linalg.eigh
    np.linalg.eigh = lambda a: calls.append(a.shape) or eigh(a)
    try:
        best, w = models.chosen(own, parts, fold, ALPHAS)
    finally:
        np.linalg.eigh = eigh
    assert best.shape == (2000,) and w.shape == (2000, 7) and len(calls) == 6  # five folds and the weights
    for i in (0, 7, 1999):
        one = models.chosen(own[i : i + 1], parts, fold[i : i + 1], ALPHAS)
        assert one[0][0] == best[i] and np.allclose(one[1][0], w[i])
