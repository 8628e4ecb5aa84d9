import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from occuflow.operators import boosting
from occuflow.sources import bundles

ALPHAS = [0.1, 0.5, 0.9]


def data(n, seed=1):
    """The spread of y grows with x0; x1 says nothing."""
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, 20, n), rng.integers(0, 9, n)], axis=1).astype(float)
    return x, 50 + (1 + x[:, 0]) * rng.normal(size=n)


def frame(spark, x, y, extra=()):
    return spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)] + list(extra), "a double, b double, y double")


def loss(y, q):
    return sum(np.maximum((y - q[:, i]) * a, (y - q[:, i]) * (a - 1)).mean() for i, a in enumerate(ALPHAS))


@pytest.fixture(scope="module")
def forest(spark):
    x, y = data(3000)
    return boosting.fit(frame(spark, x, y, [(1.0, 1.0, None)]).repartition(5), ["a", "b"], "y", ALPHAS)


def test_quantiles_beat_offsets_of_residuals(forest):
    x, y = data(4000, 2)
    q = forest.predict(x)
    inside = (q[:, 0] <= y) & (y <= q[:, 2])
    assert abs(inside.mean() - 0.8) < 0.03 and (np.diff(q, axis=1) >= 0).all()
    assert abs(inside[x[:, 0] < 5].mean() - 0.8) < 0.08 and abs(inside[x[:, 0] > 15].mean() - 0.8) < 0.08
    train_y = data(3000)[1]
    offsets = np.tile(np.median(train_y) + np.quantile(train_y - np.median(train_y), ALPHAS), (len(y), 1))
    best = 50 + (1 + x[:, :1]) * np.array([-1.2815516, 0.0, 1.2815516])  # the true quantiles
    assert loss(y, q) < 1.03 * loss(y, best) and loss(y, q) < 0.95 * loss(y, offsets)


def test_the_same_trees_at_any_partitioning_and_in_one_task(spark, forest):
    x, y = data(3000)
    again = boosting.fit(frame(spark, x, y).repartition(2), ["a", "b"], "y", ALPHAS)
    assert again == forest
    local = boosting.fit_local(x, y, ALPHAS)
    assert [[t.feature for t in ts] for ts in local.trees] == [[t.feature for t in ts] for ts in forest.trees]
    assert np.allclose(local.predict(x), forest.predict(x), atol=1e-6)


def test_the_best_split_is_that_of_a_loop(forest):
    rng = np.random.default_rng(4)
    for _ in range(20):
        cells = np.zeros((2, boosting.BINS + 1, 2))
        cells[..., 0] = rng.integers(0, 30, cells.shape[:2])
        cells[..., 1] = rng.integers(0, 1 + cells[..., 0].astype(int))
        cells[1] *= cells[0].sum(axis=0) / np.maximum(cells[1].sum(axis=0), 1)
        best, at = 1e-9, (0, boosting.BINS)
        for j in range(2):
            for cut in range(boosting.BINS):
                left, right = cells[j, : cut + 1].sum(axis=0), cells[j, cut + 1 :].sum(axis=0)
                if min(left[0], right[0]) >= boosting.LEAST:
                    g = [0.3 * n - k for n, k in (left, right)]
                    gain = g[0] ** 2 / left[0] + g[1] ** 2 / right[0] - (g[0] + g[1]) ** 2 / (left[0] + right[0])
                    if gain > best + 1e-9:
                        best, at = gain, (j, cut)
        assert boosting.best_split(cells, 0.3) == at


def test_a_leaf_is_the_quantile_of_its_residuals(forest):
    r = np.random.default_rng(5).normal(size=4000) * 10
    at = np.clip((r + forest.span) / (2 * forest.span) * boosting.RESIDUAL_BINS, 0, boosting.RESIDUAL_BINS - 1).astype(int)
    counts = np.bincount(at, minlength=boosting.RESIDUAL_BINS).astype(float)
    for a in ALPHAS:
        assert abs(forest.residual(counts, a) - np.quantile(r, a)) < 2 * forest.span / boosting.RESIDUAL_BINS
    assert forest.residual(np.zeros(boosting.RESIDUAL_BINS), 0.5) == 0


def test_empty_missing_and_equal_values(spark):
    none = boosting.fit(spark.createDataFrame([], "a double, y double"), ["a"], "y", ALPHAS)
    assert none.predict(np.array([[1.0]])).tolist() == [[0.0] * 3]
    flat = boosting.fit(spark.createDataFrame([(None, 5.0)] * 60, "a double, y double"), ["a"], "y", ALPHAS, rounds=2)
    assert np.allclose(flat.predict(np.array([[np.nan], [3.0]])), 5, atol=1e-6)


def test_groups_are_trained_apart_and_large_ones_over_spark(spark):
    rng = np.random.default_rng(6)
    rows = [(g, float(v), float(v * (g or 9) + rng.normal())) for g in (1, 2, None) for v in rng.integers(0, 10, 150)] + [(3, 1.0, 2.0)] * 4 + [(1, 1.0, None)]
    train = spark.createDataFrame(rows, "g int, a double, y double")
    test = spark.createDataFrame([(g, float(a)) for g in (1, 2, 3, 4, None) for a in range(10)], "g int, a double")
    args = (train, test, ["g"], ["a"], "y", [0.5], ["p"], 50)
    small = {(r["g"], r["a"]): r["p"] for r in boosting.fit_groups(*args, rounds=8).collect()}
    large = {(r["g"], r["a"]): r["p"] for r in boosting.fit_groups(*args, most=100, rounds=8).collect()}
    assert len(small) == 50 and all(small[g, float(a)] is None for g in (3, 4) for a in range(10))
    for g in (1, 2, None):
        assert all(abs(small[g, float(a)] - a * (g or 9)) < 4 + (g or 9) for a in range(10))
        assert all(abs(small[g, float(a)] - large[g, float(a)]) < 1e-6 for a in range(10))


def bundle(forest, version):
    return bundles.Bundle(version, ["a", "b"], forest, None, None, {"60|operating|wd": 1.5}, {"60|operating|wd": True})


def test_bundles_are_loaded_whole_or_not_at_all(spark, tmp_path, forest):
    folder, x = str(tmp_path), data(50, 3)
    assert bundles.load(spark, folder) is None
    with pytest.raises(ValueError, match="trees"):
        bundles.publish(spark, folder, bundle(boosting.started(ALPHAS, [[], []], [0.0] * 3, 0, 1, 3, 0.3), "v0"))
    bundles.publish(spark, folder, bundle(forest, "v1"))
    first = bundles.load(spark.newSession(), folder)
    assert (first.forest, first.version, first.adjustments, first.gate, first.error) == (forest, "v1", {"60|operating|wd": 1.5}, {"60|operating|wd": True}, None)
    df = frame(spark, *x).withColumn("occ_now", F.lit(0.0))
    both = [[tuple(r) for r in df.select(b.quantiles()).collect()] for b in (bundle(forest, "v1"), first)]
    assert both[0] == both[1]
    # a later version that isn't whole keeps the one before, and says why
    bundles.publish(spark, folder, bundle(forest, "v2"))
    shutil.rmtree(tmp_path / "v2" / "forest")
    for last in (None, first):
        kept = bundles.load(spark, folder, last)
        assert kept.version == "v1" and kept.error.startswith("v2: ")
    # written, but not yet published
    spark.createDataFrame(bundles.rows_of(forest), bundles.FOREST).write.parquet(f"{folder}/v3/forest")
    assert bundles.load(spark, folder, first).version == "v1"
    bundles.publish(spark, folder, bundle(forest, "v4"))
    assert bundles.load(spark, folder, first).version == "v4"
    with pytest.raises(Exception, match="already exists"):
        bundles.publish(spark, folder, bundle(forest, "v4"))


def test_forecasts_are_restored_and_clipped(spark, forest):
    df = spark.createDataFrame([(1.0, 1.0, 200.0), (1.0, 1.0, -300.0)], "a double, b double, occ_now double")
    rows = bundles.forecast(df, bundle(forest, "v1")).collect()
    assert [(r["p10"], r["p90"], r["model_version"]) for r in rows] == [(100.0, 100.0, "v1"), (0.0, 0.0, "v1")]


def test_large_groups_share_their_jobs_and_small_ones_reach_no_task(spark):
    tracker, rng = spark.sparkContext, np.random.default_rng(7)
    rows = [(g, float(v), float(v * g + rng.normal())) for g in range(1, 7) for v in rng.integers(0, 10, 120)]
    few = [(g, 1.0, 2.0) for g in range(100, 160) for _ in range(3)]
    train = spark.createDataFrame(rows + few, "g int, a double, y double").cache()
    test = spark.createDataFrame([(g, 3.0) for g in (*range(1, 7), *range(100, 160))], "g int, a double")

    def jobs(groups, name):
        tracker.setJobGroup(name, name)
        got = boosting.fit_groups(train.where(f"g <= {groups} OR g >= 100"), test.where(f"g <= {groups} OR g >= 100"), ["g"], ["a"], "y", [0.5], ["p"], 50, most=100, rounds=2)
        out = {r["g"]: r["p"] for r in got.collect()}
        return len(tracker.statusTracker().getJobIdsForGroup(name)), out

    one, _ = jobs(1, "one-large")
    six, got = jobs(6, "six-large")
    tracker.setLocalProperty("spark.jobGroup.id", None)
    assert six <= one + 4  # not six times as many
    assert len(got) == 66 and all(abs(got[g] - 3 * g) < 4 + g for g in range(1, 7)) and all(got[g] is None for g in range(100, 160))
    # a group with much to forecast and too little to learn from has no forecast
    thin = boosting.fit_groups(train, spark.createDataFrame([(100, 1.0)] * 8, "g int, a double"), ["g"], ["a"], "y", [0.5], ["p"], 50, most=5, rounds=1)
    assert [r["p"] for r in thin.collect()] == [None] * 8


def test_rows_are_kept_between_jobs_as_blocks_of_batches(spark, forest):
    x, y = data(3000)
    rows = boosting.numeric(frame(spark, x, y).repartition(3), ["a", "b"], "y", F.lit(0))
    spread = boosting.Spread(rows, ["a", "b"], [forest])
    try:
        assert spread.rows.count() <= 6  # not a row of the cache for each of 3000
        got = list(spread.blocks(spread.rows.toPandas()))
    finally:
        spread.forget(spread.rows)
    assert sorted(np.concatenate([b[1] for b in got])) == sorted(y)
    assert sorted(map(tuple, np.concatenate([b[2] for b in got]))) == sorted(map(tuple, forest.bins(x)))
    assert (np.concatenate([b[3] for b in got]) == forest.base).all()
