from datetime import datetime, timedelta

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from occuflow import catalogue
from occuflow.operators import serving, tariff
from occuflow.operators.calendar import HOLIDAY_NUMBERS, is_holiday
from occuflow.plans import serving as plans

from .test_oracle import rows


def test_the_first_reason_of_the_ladder_counts_and_unknown_is_a_no(spark):
    names = ["supported", "live", "model", "gate", "certified", "fresh", "whole"]
    good = (True, True, True, None, True, True, True)
    reasons = ["unsupported_horizon", "dead_feed", "no_model", "gate_frozen", "lot_horizon_not_certified", "no_fresh_history", "missing_features"]
    rows, want = [(0, *good)], {0: "ml"}
    for i, reason in enumerate(reasons):
        for k, bad in enumerate(["gate_frozen"] if names[i] == "gate" else [False, None]):
            n = len(rows)
            rows.append((n, *good[:i], bad, *[False if names[j] != "gate" else "gate_x" for j in range(i + 1, 7)]))
            want[n] = reason
    df = spark.createDataFrame(rows, "i int, supported boolean, live boolean, model boolean, gate string, certified boolean, fresh boolean, whole boolean")
    got = dict(map(tuple, df.select("i", serving.ladder(*[F.col(c) for c in names])).collect()))
    assert got == want


def test_access_names_the_first_reason(spark):
    day = [(0, 1440)]
    cases = [
        (False, day, 60, 120, ("general_public_not_allowed", "confirmed_restricted", None)), (True, None, 60, 120, ("access_schedule_unknown", "unknown", None)), (True, [(540, 1080)], 500, 600, ("entry_closed_at_arrival", "confirmed_restricted", 1080)),
        (True, [(540, 1080)], 600, 1100, ("closes_before_departure", "confirmed_restricted", None)), (True, [(540, 1080)], 600, 1070, ("insufficient_exit_margin", "confirmed_restricted", 1080)), (True, [(540, 720), (780, 1080)], 600, 800, ("closed_interval_crossed", "confirmed_restricted", 1080)),
        (True, [(540, 1080)], 600, 1069, ("available", "confirmed_open", 1080)), (True, day, 600, 1435, ("available", "confirmed_open", 1440)), (True, [], 600, 700, ("entry_closed_at_arrival", "confirmed_restricted", None)),
    ]
    df = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "i int, public boolean, xs array<struct<s:int,e:int>>, a int, z int")
    got = {r["i"]: tuple(r["x"]) for r in df.select("i", serving.access(F.col("public"), F.col("xs"), F.col("a"), F.col("z"), 10).alias("x")).collect()}
    assert got == {i: c[4] for i, c in enumerate(cases)}


def test_the_cheapest_benefit_is_that_of_a_loop(spark):
    def price(minutes, code):
        rates, (percent, free) = tariff.RATES["off", 2], tariff.DISCOUNTS.get(code, (100, 0))
        due = max(minutes - free, 0)
        total = (rates[0] if due else 0) + sum(-(-max(min(due, hi) - lo, 0) // 10) * rates[k] for k, (lo, hi) in enumerate(tariff.BRACKETS, 1))
        return min(total, tariff.DAY_CAP) * percent // 10_000 * 100

    rows = [(m, held) for m in (10, 45, 130, 200, 900) for held in range(0, 8192, 277)]
    df = spark.createDataFrame(rows, "m int, held int")
    best = serving.cheapest(F.col("m"), tariff.rates(F.lit("off"), F.lit(2)), lambda i: F.shiftright("held", i).bitwiseAND(1) == 1)
    for r in df.select("m", "held", best.alias("b")).collect():
        options = ["none", *[c for i, c in enumerate(tariff.DISCOUNTS) if r["held"] >> i & 1]]
        assert (r["b"]["total"], r["b"]["code"]) == min(((price(r["m"], c), c) for c in options), key=lambda x: x[0])
    none = df.limit(1).select(serving.cheapest(F.col("m"), tariff.rates(F.lit("on"), F.lit(5)), lambda i: F.lit(True)).alias("b")).first()["b"]
    assert (none["total"], none["code"]) == (None, "none")


def test_horizons_snap_to_the_nearest_and_ties_to_the_shorter(spark):
    df = spark.createDataFrame([(m,) for m in (1, 22, 23, 45, 46, 90, 400)], "m int")
    assert [r[0] for r in df.select(serving.snapped(F.col("m"), (15, 30, 60, 120))).collect()] == [15, 15, 30, 30, 60, 60, 120]


def test_one_table_of_holidays(spark):
    days = spark.createDataFrame([("2024-02-10",), ("2024-02-13",), ("2024-03-01",)], "d string").select(F.to_date("d").alias("d"))
    assert [tuple(r) for r in days.select(is_holiday(F.col("d")), F.unix_date("d").isin(*HOLIDAY_NUMBERS)).collect()] == [(True, True), (False, False), (True, True)]


def test_cards_agree_with_sql_at_the_edges_of_freshness_and_none_is_shuffled(spark, tmp_path):
    now, names = datetime(2024, 1, 28, 5, 30), range(1, 121)
    times = [(k, datetime(2024, 1, 1) + timedelta(hours=18 * i), 30.0 + k % 5 + i % 2 * 2) for k in names for i in range(30 if k % 11 else 3)]
    # twelve hours before a minute, and a microsecond to each side; some lots were seen at that minute or above capacity
    times += [(k, now + timedelta(minutes=k * 37 % 1440, microseconds=k % 3 - 1) - timedelta(hours=0 if k % 7 == 0 else 12), 130.0 if k % 13 == 0 else 40.0) for k in names]
    tables = {
        "customer": pa.table({"c_custkey": pa.array(range(1, 181), pa.int64())}),
        "supplier": pa.table({"s_suppkey": pa.array(names, pa.int64()), "s_name": [f"lot {k}" for k in names], "s_acctbal": [1.0] * len(names)}),
        "events": pa.table({"event_id": pa.array(range(len(times)), pa.int64()), "user_id": pa.array([t[0] for t in times], pa.int64()), "ts": pa.array([t[1] for t in times], pa.timestamp("us")), "value": [t[2] for t in times]}),
    }
    con = duckdb.connect()
    for name, table in tables.items():
        pq.write_table(table, tmp_path / f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path / name}.parquet')")
    cards = plans.recommend_cards(spark, str(tmp_path))
    plan = cards._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "Window" not in plan and plan.index("Exchange") > plan.index("MapInPandas")
    want = con.execute(catalogue.oracle_sql()["recommend_cards"])
    got = cards.collect()
    assert rows(cards.columns, got) == rows([c[0] for c in want.description], want.fetchall())
    assert {"ml", "no_fresh_history"} <= {r["source"] for r in got}
