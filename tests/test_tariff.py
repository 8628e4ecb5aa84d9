"""Quotes of known stays."""

import pytest
from pyspark.sql import functions as F

from occuflow.operators import tariff

MONDAY, SUNDAY = 20703 * 1440 + 600, 20702 * 1440 + 840  # 2026-09-07 10:00, 2026-09-06 14:00


def quotes(spark, stays):
    """(grade, open, close, start, minutes, code, Sundays free) to quotes."""
    rows = [(i, g, a, z, s, m, c, f) for i, (g, a, z, s, m, c, f) in enumerate(stays)]
    x = spark.createDataFrame(rows, "i int, g int, a int, z int, s long, m long, c string, f boolean")
    own = F.array(F.struct(F.col("a").alias("s"), F.col("z").alias("e")))
    none = F.array().cast("array<struct<s:int,e:int>>")
    windows = F.array(*[own] * 6, F.when(F.col("f"), none).otherwise(own))
    days = tariff.charged_days(F.col("s"), F.col("m"), windows, F.array().cast("array<bigint>"))
    q = tariff.quote(days, tariff.rates(F.lit("off"), F.col("g")), F.col("g"), tariff.discount(F.col("c"), 0), tariff.discount(F.col("c"), 1))
    return [r["q"] for r in x.orderBy("i").select(q.alias("q")).collect()]


def test_totals(spark):
    wide, narrow, whole = (1, 540, 1320), (3, 600, 1080), (1, 0, 1440)
    cases = [((*wide, MONDAY, m, None, True), want) for m, want in ((14, 0), (30, 600), (40, 900), (60, 1500), (90, 3300), (120, 5100), (180, 10500), (300, 24900))]
    cases += [((*narrow, MONDAY, m, None, True), want) for m, want in ((30, 200), (60, 500), (120, 2300), (180, 4700), (240, 7100))]
    cases += [((*wide, MONDAY + 780, 180, None, True), 0), ((*wide, MONDAY + 660, 180, None, True), 1500), ((*wide, SUNDAY, 120, None, True), 0), ((*wide, SUNDAY, 120, None, False), 5100)]
    cases += [((*wide, MONDAY, m, c, True), want) for m, c, want in ((120, "compact", 2500), (14, "compact", 0), (120, "disabled_severe", 0), (120, "market", 600))]
    cases += [((*whole, MONDAY, 600, None, True), 25000)]
    assert [q["total"] for q in quotes(spark, [c for c, _ in cases])] == [w for _, w in cases]


def test_day_pass(spark):
    long, short, whole, two = quotes(spark, [(1, 540, 1320, MONDAY, 300, None, True), (1, 540, 1320, MONDAY, 120, None, True), (1, 0, 1440, MONDAY, 600, None, True), (1, 540, 1320, MONDAY + 600, 1440, None, True)])
    assert (long["total"], long["prepaid"], long["buy_pass"], long["saving"]) == (24900, 16000, True, 8900)
    assert not short["buy_pass"] and whole["day_pass"] is None and whole["capped"]
    assert two["paid_days"] == 2 and two["prepaid"] is None


@pytest.mark.parametrize(("kind", "grade"), [("on", 4), ("on", 5), ("other", 1)])
def test_no_such_tariff(spark, kind, grade):
    assert spark.range(1).select(tariff.rates(F.lit(kind), F.lit(grade)).alias("p")).first()["p"] is None


def test_a_quote_names_each_of_its_inputs_once(spark):
    """What a quote is made of is computed once a row, not once a field."""
    q = str(tariff.quote(F.col("the_days"), F.col("p"), F.col("g"), F.col("percent"), F.col("free")))
    assert q.count("the_days") == 1
    empty = F.array().cast("array<struct<day:bigint,billable:bigint,window:bigint>>")
    short = spark.range(1).select(tariff.quote(empty, tariff.rates(F.lit("off"), F.lit(1)), F.lit(1), F.lit(100), F.lit(0), False).alias("q")).select("q.*")
    assert "pass_from_minute" not in short.columns and short.first()["reason"] == "not_charged"
