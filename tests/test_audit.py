import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from occuflow.operators import audit
from occuflow.sources.reports import write_report

START = datetime(2024, 1, 1)
OBS = "lot long, ts timestamp_ntz, park long, cells long"


def found(spark, rows, **kw):
    settings = {"hours": 24, "tolerance": 15, "interval": 5, "jump": 0.3, "within": 10, "still": 0.01, "least": 12} | kw
    return {r["code"]: (r["n"], r["fails"]) for r in audit.findings(spark.createDataFrame(rows, OBS), **settings).collect()}


def test_findings(spark):
    assert found(spark, []) == {"no_data": (1, True)}
    steady = [(1, START + timedelta(minutes=5 * i), 10 + i % 3, 100) for i in range(289)]
    assert found(spark, steady) == {"frozen_count": (0, False)}
    frozen = [(2, t, 7, 10) for _, t, _, _ in steady]
    assert found(spark, steady + frozen) == {"frozen_count": (1, False)}
    # a gap over midnight, a jump, rows over capacity, and what lies before the window
    rows = [(lot, t + timedelta(hours=13), p, c) for lot, t, p, c in steady if not 125 <= (t - START).total_seconds() / 300 < 135]
    rows += [(3, rows[-1][1], 90, 100), (3, rows[-1][1] - timedelta(minutes=5), 20, 100), (4, rows[-1][1], 12, 10), (5, rows[-1][1], 1, 0), (4, START - timedelta(days=9), 99, 10)]
    assert found(spark, rows) == {"polling_gap": (1, True), "over_capacity": (1, True), "step_change": (1, True), "frozen_count": (0, False)}
    assert found(spark, rows[:100])["snapshot_shortfall"] == (1, True)


def test_gaps_cross_days(spark):
    times = [START + timedelta(hours=h) for h in (1, 1, 3, 30, 80)]
    got = [r["minutes"] for r in audit.gaps(spark.createDataFrame([(t,) for t in times] + [(None,)], "ts timestamp_ntz")).orderBy("ts").collect()]
    assert got == [None, 120, 27 * 60, 50 * 60]


def test_columns_without_information_go(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0, None, 1), (2, 2.0, 5.0, None, 1), (3, 2.0, 6.0, None, 2)], "i int, a double, b double, c double, g int")
    assert audit.informative(df, ["a", "b", "c"]).columns == ["i", "a", "b", "g"]
    assert audit.informative(df, ["a", "b", "c"], F.col("g") == 1).columns == ["i", "a", "g"]
    assert audit.informative(df.limit(0), ["a", "b", "c"]).columns == ["i", "g"]


def test_the_first_row_of_a_key_stays(spark):
    kind = "a int, b int, o int, v string"
    one = spark.createDataFrame([(1, 1, 5, "x"), (1, 1, 4, "y"), (None, 1, 1, "n")], kind)
    two = spark.createDataFrame([(1, 1, 1, "z"), (1, 2, 2, "w"), (None, 1, 0, "m")], kind)
    got = sorted(map(tuple, audit.insert_first([one, two], ["a", "b"], "o").collect()), key=repr)
    assert got == sorted([(1, 1, 4, "y", 0), (1, 2, 2, "w", 1), (None, 1, 1, "n", 0)], key=repr)


def test_reports_are_files(spark, tmp_path):
    df = spark.createDataFrame([("b", 1.5), ('a, "q"', None)], "name string, x double")
    got = {(r["name"], r["kind"]): (r["rows"], r["columns"]) for r in write_report(spark, str(tmp_path), {"r": df, "none": df.limit(0)}).collect()}
    assert got == {("r", "csv"): (2, 2), ("r", "md"): (2, 2), ("none", "csv"): (0, 2), ("none", "md"): (0, 2)}
    text = lambda name: next((tmp_path / name).glob("part-*")).read_text(encoding="utf-8")
    assert text("r.csv") == '﻿name,x\n"a, ""q""",\nb,1.5\n'
    assert text("r.md") == '| name | x |\n|---|---|\n| a, "q" |  |\n| b | 1.5 |\n'
    assert len([json.loads(x) for x in text("manifest").splitlines()]) == 4
