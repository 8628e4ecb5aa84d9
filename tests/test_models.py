"""Models against closed forms and brute force."""

import numpy as np
from pyspark.sql import functions as F

from occuflow.operators import evaluation as ev
from occuflow.operators import asof, calibration, evaluation, models, statistics


def data(spark, n=240):
    rng = np.random.default_rng(1)
    rows = [(i % 6, float(a), float(b), float(3 + 2 * a - b + rng.normal() * 0.1 + (i % 6))) for i, (a, b) in enumerate(rng.normal(size=(n, 2)))]
    return rows, spark.createDataFrame(rows, "g int, a double, b double, y double")


def solved(rows, alpha=1.0):
    x, y = np.array([(1, a, b) for _, a, b, _ in rows]), np.array([r[3] for r in rows])
    return np.linalg.solve(x.T @ x + np.diag([1e-9, alpha, alpha]), x.T @ y)


def test_ridge_by_closed_form(spark):
    rows, df = data(spark)
    out = {r["g"]: r["mae"] for r in models.ridge_without(df, "g", ["a", "b"], "y", 1.0).collect()}
    for g in range(6):
        w = solved([r for r in rows if r[0] != g])
        assert abs(out[g] - np.mean([abs(w @ (1, a, b) - y) for k, a, b, y in rows if k == g])) < 1e-9
    local = {r["g"]: r for r in models.ridge_local(df, df, "g", ["a", "b"], "y", 1.0, 30).collect()}
    w, mine = solved(rows), solved([r for r in rows if r[0] == 2])
    assert abs(local[2]["mae_global"] - np.mean([abs(w @ (1, a, b) - y) for k, a, b, y in rows if k == 2])) < 1e-9
    assert abs(local[2]["mae_local"] - np.mean([abs(mine @ (1, a, b) - y) for k, a, b, y in rows if k == 2])) < 1e-9
    assert all(r["mae_local"] is None for r in models.ridge_local(df, df, "g", ["a", "b"], "y", 1.0, 10_000).collect())


def test_triples_never_cross(spark):
    rng = np.random.default_rng(2)
    rows = [(float(x), float(np.clip(x + rng.normal() * 10, 0, 100))) for x in rng.uniform(0, 100, 400)]
    df = spark.createDataFrame([(i, 360, x, y) for i, (x, y) in enumerate(rows)], "i int, horizon int, occ_now double, actual double")
    out = models.interval(df.where("i < 150"), df.where("i >= 150 AND i < 280"), df.where("i >= 280"), ["occ_now"], ["horizon"], 0.1, 0.9).collect()
    assert len(out) == 120 and all(r["lo"] <= r["mid"] <= r["hi"] for r in out)
    assert 0.6 < np.mean([r["lo"] <= r["actual"] <= r["hi"] for r in out]) < 0.95


def test_bootstrap_is_repeatable_and_near_the_normal_interval(spark):
    rng = np.random.default_rng(3)
    s = rng.normal(5, 2, 60)
    df = spark.createDataFrame([("h", int(i), float(x), 1) for i, x in enumerate(s)], "k string, cluster int, s double, n int")
    a, b = (statistics.cluster_bootstrap(df.repartition(p), ["k"], 400, 7).first() for p in (1, 5))
    assert all(abs(x - y) < 1e-9 for x, y in zip(a[1:], b[1:]))
    half = 1.96 * s.std() / np.sqrt(len(s))
    assert abs(a["lo"] - (s.mean() - half)) < 0.25 * half and abs(a["hi"] - (s.mean() + half)) < 0.25 * half


def test_ranked_value_is_the_sorted_one(spark):
    x = np.random.default_rng(4).exponential(3, 501)
    df = spark.createDataFrame([(i % 2, float(v)) for i, v in enumerate(x)], "k int, v double")
    for k, v in ((r["k"], r["v"]) for r in evaluation.ranked_value(df, ["k"], "v", lambda n: F.ceil(n * 0.8)).collect()):
        mine = np.sort(x[k::2])
        assert v == mine[int(np.ceil(len(mine) * 0.8)) - 1]


def test_series_without_a_key_carries_over_days(spark):
    at = "2024-01-0{} 0{}:00:00"
    series = spark.createDataFrame([(at.format(1, 3), 1.0), (at.format(4, 5), 2.0)], "r_ts string, v double").select(F.col("r_ts").cast("timestamp_ntz").alias("r_ts"), "v")
    left = spark.createDataFrame([(1, at.format(1, 2)), (2, at.format(1, 3)), (3, at.format(3, 1)), (4, at.format(4, 4)), (5, at.format(4, 6))], "i int, ts string").select("i", F.col("ts").cast("timestamp_ntz").alias("ts"))
    got = {r["i"]: r["v"] for r in asof.asof_series(left, series).collect()}
    assert got == {1: None, 2: 1.0, 3: 1.0, 4: 1.0, 5: 2.0}
    assert asof.asof_series(left.limit(0), series).count() == 0 and asof.asof_series(left, series.limit(0)).count() == 5


def test_conformal_intervals_by_brute_force(spark):
    rng = np.random.default_rng(11)
    rows = [("a", float(lo), float(lo + 20), float(lo + x)) for lo, x in zip(rng.uniform(20, 60, 120), rng.normal(10, 15, 120))]
    rows += [("b", float(lo), float(lo + 30), float(lo + 15)) for lo in rng.uniform(20, 60, 60)] + [("few", 1.0, 2.0, 3.0)] * 49 + [("a", None, 3.0, 1.0), ("a", 1.0, 2.0, None)]
    schema = "k string, lo double, hi double, actual double"
    known = spark.createDataFrame(rows, schema).repartition(3)
    asked = spark.createDataFrame([("a", 40.0, 60.0, None), ("a", 2.0, 99.0, None), ("b", 10.0, 40.0, None), ("b", 10.0, 11.0, None), ("few", 1.0, 2.0, None), ("new", 1.0, 2.0, None), (None, 1.0, 2.0, None), ("a", None, 2.0, None)], schema)
    s = sorted(max(lo - y, y - hi) for k, lo, hi, y in rows if k == "a" and lo is not None and y is not None)
    q = s[int(np.ceil(min(1.0, np.ceil(121 * 0.8) / 120) * 119))]
    got = {(r["k"], i): (r["lo"], r["hi"]) for i, r in enumerate(sorted(calibration.conformal(known, asked, ["k"]).collect(), key=lambda r: (r["k"] or "", r["lo"] is None, r["lo"] or 0)))}
    values = sorted((k[0] or "", v) for k, v in got.items() if v[0] is not None)
    want = sorted([("a", (40 - q, 60 + q)), ("a", (max(2 - q, 0.0), min(99 + q, 100.0))), ("b", (25.0, 25.0))])
    assert len(got) == 8 and [k for k, _ in values] == [k for k, _ in want] and np.allclose([v for _, v in values], [v for _, v in want])
    assert calibration.conformal(known.limit(0), asked, ["k"]).where("lo IS NOT NULL").count() == 0


def test_quantiles_from_counts_are_exact(spark):
    rng = np.random.default_rng(11)
    groups = {1: rng.normal(size=501) * 30, 2: np.repeat([1.5, -2.0, 7.25], [5, 1, 3]), 3: np.array([4.0]), 4: rng.integers(-3, 3, 40).astype(float)}
    rows = [(k, float(v)) for k, xs in groups.items() for v in xs] + [(1, None), (5, None)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(3)
    shares = {"lo": 0.0, "q": 0.25, "mid": 0.5, "p": 0.937, "hi": 1.0}
    got = {r["k"]: r for r in ev.quantiles_of(ev.counts_of(df, ["k"], "v"), ["k"], "v", shares).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    for k, xs in groups.items():
        for name, p in shares.items():
            assert abs(got[k][name] - np.quantile(xs, p)) < 1e-9


def test_models_read_written_pairs_and_join_no_grid_again(spark, monkeypatch):
    from occuflow.plans import model

    made, seen = [], []
    monkeypatch.setattr(model, "frame", lambda *a, f=model.frame: made.append(1) or f(*a))
    monkeypatch.setattr(model.models, "calibrated_chance", lambda train, test, *a: seen.extend([train, test]) or test.withColumn("p", test["full"]).withColumn("calibrated", test["full"]))
    model.full_probability(spark, "/root/testdata/sf0.001")
    plans = [spark._jvm.PythonSQLUtils.explainString(x._jdf.queryExecution(), "simple") for x in seen]
    assert len(made) == 1 and len(plans) == 2 and not any("Exchange" in p or "Join" in p for p in plans)
