"""What the learnt models must do on data whose answer is known."""

import numpy as np
import pytest

from occuflow.operators import models


@pytest.fixture(scope="module")
def frame(spark):
    """The change is 20 where x0 is high, -10 where it is low; x1 says nothing."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(900):
        x0, x1, now = float(rng.integers(0, 10)), float(rng.integers(0, 10)), float(rng.integers(0, 101))
        actual = min(max(now + (20 if x0 >= 5 else -10) + rng.normal(), 0.0), 100.0)
        rows.append((i % 30, i, x0, x1, now, actual, float(x0 >= 5 and rng.random() < 0.9 or rng.random() < 0.05)))
    return spark.createDataFrame(rows, "lot long, ts long, x0 double, x1 double, occ_now double, actual double, full double")


def test_boosted_changes_are_restored_and_clipped(frame):
    out = models.boosted_change(frame.where("ts < 600"), frame.where("ts >= 600"), ["x0", "x1"]).toPandas()
    assert out["predicted"].between(0, 100).all() and (out["predicted"] == 100).any() and (out["predicted"] == 0).any()
    middle = out[out["actual"].between(1, 99)]
    assert (middle["predicted"] - middle["actual"]).abs().mean() < 2.5


def test_importance_ranks_what_matters_first(spark, frame):
    rows = models.importance(spark, frame, ["x1", "x0"]).collect()
    by = {r["feature"]: r for r in rows}
    assert abs(sum(r["share"] for r in rows) - 1) < 1e-9 and by["x0"]["rank"] == 1 and by["x0"]["share"] > 0.7


def test_chances_are_calibrated(frame):
    out = models.calibrated_chance(frame.where("ts < 600"), frame.where("ts >= 600"), ["x0", "x1"], "full").toPandas()
    assert out["p"].between(0, 1).all() and out["calibrated"].between(0, 1).all() and len(out) == 300
    brier = ((out["calibrated"] - out["full"]) ** 2).mean()
    assert brier < 0.6 * ((out["full"].mean() - out["full"]) ** 2).mean()
    for high in (True, False):
        some = out[(out["x0"] >= 5) == high]
        assert abs(some["calibrated"].mean() - some["full"].mean()) < 0.1


def test_the_number_of_clusters_is_that_of_the_blobs(spark):
    rng = np.random.default_rng(4)
    centres = np.array([[0, 0], [10, 0], [0, 10]])
    rows = [(i, [float(v) for v in centres[i % 3] + rng.normal(size=2) * 0.3]) for i in range(150)]
    out = models.clusters(spark.createDataFrame(rows, "i long, v array<double>"), "v", (2, 3, 4)).collect()
    of = {}
    for r in out:
        of.setdefault(r["i"] % 3, set()).add(r["cluster"])
    assert all(len(c) == 1 for c in of.values()) and len(set.union(*of.values())) == 3


def test_ridge_errors_are_those_of_numpy(frame):
    p = frame.toPandas()
    train, test = p[p["ts"] < 600], p[p["ts"] >= 600]
    x = lambda f: np.column_stack([np.ones(len(f)), f[["x0", "x1", "occ_now"]]])
    for back in (None, "occ_now"):
        shift = lambda f: f[back] if back else 0.0  # noqa: E731, B023
        penalty = np.diag([1e-9, 1.0, 1.0, 1.0])
        w = np.linalg.solve(x(train).T @ x(train) + penalty, x(train).T @ (train["actual"] - shift(train)))
        guess = np.clip(x(test) @ w + shift(test), 0, 100)
        got = models.ridge_errors(frame.where("ts < 600"), frame.where("ts >= 600"), [], ["x0", "x1", "occ_now"], "actual", 1.0, back).first()
        assert got["n"] == 300 and got["mae"] == pytest.approx(np.abs(guess - test["actual"]).mean())


def test_intervals_never_cross_and_cover(frame):
    fit, held, test = frame.where("ts < 400"), frame.where("ts >= 400 AND ts < 700"), frame.where("ts >= 700")
    out = models.interval(fit, held, test, ["x0", "x1"], ["full"], 0.1, 0.9).toPandas()
    assert (out["lo"] <= out["mid"]).all() and (out["mid"] <= out["hi"]).all() and len(out) == 200
    assert 0.6 < out["actual"].between(out["lo"], out["hi"]).mean() <= 1
