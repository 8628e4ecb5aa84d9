import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from occuflow.operators import asof
from occuflow.operators.timegrid import interpolate_one

START = datetime(2024, 1, 1)


def tables(spark, seed, minutes=9000):
    rng = random.Random(seed)
    at = lambda: START + timedelta(minutes=rng.randrange(minutes))
    left = [(i, rng.choice([1, 2, 3, None]), at()) for i in range(200)] + [(900, 1, START + timedelta(days=1)), (901, 1, None)]
    right = [(rng.choice([1, 2, None]), at(), float(rng.randrange(9))) for _ in range(300)] + [(1, START + timedelta(days=1), 5.0), (1, None, 1.0), (1, START + timedelta(days=1), None)]
    return left, right, spark.createDataFrame(left, "i long, k int, ts timestamp_ntz").repartition(3), spark.createDataFrame(right, "k int, ts timestamp_ntz, v double").repartition(3)


def best(left, right, direction, tolerance):
    out = {}
    for i, k, t in left:
        rows = [(r, -1.0 if v is None else v) for kk, r, v in right if kk == k and t and r and abs(r - t).total_seconds() <= tolerance]
        rows = [(r, v) for r, v in rows if direction == "nearest" or (r <= t if direction == "backward" else r >= t)]
        out[i] = min(rows, key=lambda x: (abs((x[0] - t).total_seconds()), x[0], -x[1]))[0] if rows else None
    return out


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("tolerance", [0, 120, 7200, 200_000])
def test_pieces_of_a_day_match_as_a_loop_does(spark, direction, tolerance):
    left, right, a, b = tables(spark, tolerance + len(direction))
    got = asof.asof_join(a, b, ["k"], "v", tolerance, direction).collect()
    want = best([(i, k, t) for i, k, t in left], [(k, r, v) for k, r, v in right], direction, tolerance)
    assert len(got) == len(left) and {r["i"]: r["r_ts"] for r in got} == want


def test_a_stale_or_missing_present_isnt_replaced_by_an_older_one(spark):
    h = [(1, START, 5.0), (1, START + timedelta(minutes=10), None), (2, START, 7.0)]
    history = spark.createDataFrame(h, "k int, ts timestamp_ntz, v double")
    asked = spark.createDataFrame([(1, START + timedelta(minutes=65), 60), (1, START + timedelta(minutes=72), 60), (2, START + timedelta(minutes=65), 60), (2, START + timedelta(minutes=66), 60), (3, START, 60)], "k int, target timestamp_ntz, horizon int")
    got = [(r["k"], r["v"], r["r_ts"]) for r in asof.point_lookup(asked, history, ["k"], "v", 300).orderBy("k", "target").collect()]
    assert got == [(1, 5.0, START), (1, None, None), (2, 7.0, START), (2, None, None), (3, None, None)]


def test_the_nearest_row_of_a_window(spark):
    rows = spark.createDataFrame([(1, START, "a", 1), (1, START + timedelta(minutes=20), "b", 2), (1, START + timedelta(minutes=20), "b", 3)], "k int, ts timestamp_ntz, s string, n int")
    asked = spark.createDataFrame([(1, START + timedelta(minutes=m)) for m in (10, 11, 25, 26)], "k int, at timestamp_ntz")
    got = [(r["s"], r["n"], r["seconds"]) for r in asof.nearest_in_window(asked, rows, ["k"], ["s", "n"], 600).orderBy("at").collect()]
    assert got == [("a", 1, 600.0), ("b", 3, 540.0), ("b", 3, 300.0), ("b", 3, 360.0)]


def seconds(df):
    out = 1e9
    for _ in range(2):
        start = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        out = min(out, time.perf_counter() - start)
    return out


def test_time_is_linear_in_the_rows_of_a_key(spark):
    """Four times the rows take at most five times the time, without a tolerance too."""

    def series(n):
        at = F.timestamp_add("MINUTE", (F.col("id") * 5).cast("int"), F.expr("TIMESTAMP_NTZ'2000-01-01 00:00:00'")).alias("ts")
        return spark.range(n).select(F.lit(1).alias("lot"), at, F.when(F.col("id") % 3 != 1, F.col("id").cast("double")).alias("occ"))

    for run in (lambda df: asof.asof_join(df, df, ["lot"], "occ", None, "nearest"), lambda df: interpolate_one(df, 5)):
        assert seconds(run(series(120_000))) <= 5 * seconds(run(series(30_000)))
