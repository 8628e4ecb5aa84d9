import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from occuflow.operators import features as ft

START = datetime(2024, 1, 1)


@pytest.mark.parametrize("step", [5, 60, 360])
def test_pieces_give_what_a_loop_over_the_history_gives(spark, step):
    rng = random.Random(step)
    lots = {k: [rng.random() if rng.random() < 0.8 else None for _ in range(700)] for k in (1, 2)}
    rows = [(k, START + timedelta(minutes=step * (i + 13 * k)), v) for k, xs in lots.items() for i, v in enumerate(xs)]
    grid = spark.createDataFrame(rows, "lot int, ts timestamp_ntz, occ double").repartition(3)
    columns = {"back": ft.lag(12), "mean": ft.rolling_mean(6), "full": ft.rolling_mean(3, True), "past": ft.past_complete(4), "next": ft.future_complete(5), "gone": ft.recently(F.col("occ").isNull(), 7)}
    got = {(r["lot"], r["ts"]): r for r in ft.windowed(grid, step, columns, 12, 5).collect()}
    assert len(got) == len(rows) and {len(r) for r in got.values()} == {3 + len(columns)}
    for k, xs in lots.items():
        for i in range(len(xs)):
            r = got[k, START + timedelta(minutes=step * (i + 13 * k))]
            some = [v for v in xs[max(i - 5, 0) : i + 1] if v is not None]
            three = xs[max(i - 2, 0) : i + 1]
            whole = len(three) == 3 and None not in three
            assert r["back"] == (xs[i - 12] if i >= 12 else None)
            assert r["mean"] == (pytest.approx(sum(some) / len(some)) if some else None) and r["full"] == (pytest.approx(sum(three) / 3) if whole else None)
            assert r["past"] == (i >= 3 and None not in xs[i - 3 : i + 1]) and r["next"] == (i + 5 < len(xs) and None not in xs[i : i + 6])
            assert r["gone"] == (None in xs[max(i - 6, 0) : i + 1])


def test_tasks_are_as_many_as_days(spark):
    """A year of one lot: its windows are dealt by lot and piece, not by lot alone."""
    at = F.timestamp_add("MINUTE", (F.col("id") * 5).cast("int"), F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'")).alias("ts")
    grid = spark.range(2000).select((F.col("id") % 2).alias("lot"), at, F.lit(1.0).alias("occ"))
    plan = ft.windowed(grid, 5, {"x": ft.lag(12)}, 12)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(lot" in plan and "piece" in plan.split("hashpartitioning(", 1)[1].split(")")[0]
