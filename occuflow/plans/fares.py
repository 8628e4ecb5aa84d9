"""Fare quotes: charging windows by rule, weekday and holiday, discounts, day passes, and their audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tariff
from ..operators.calendar import HOLIDAY_NUMBERS
from ..operators.timegrid import micros
from ..registry import query
from ..sources.tables import LOTS, lots, read

#: Stays of a fare quote; the lot picks the rule of its charging windows, the event its discount.
STAY = """stay AS (SELECT event_id, epoch_us(ts) // 60000000 AS a, event_id % 2600 + 5 AS mins, user_id % 5 AS rule, CASE WHEN user_id % 3 = 0 THEN 'on' ELSE 'off' END AS kind, CAST(1 + user_id % 5 AS INTEGER) AS grade,
CASE event_id % 14 WHEN 0 THEN 'emergency' WHEN 1 THEN 'compact' WHEN 2 THEN 'low_emission' WHEN 3 THEN 'charging' WHEN 4 THEN 'senior' WHEN 5 THEN 'disabled_mild' WHEN 6 THEN 'disabled_severe' WHEN 7 THEN 'veteran' WHEN 8 THEN 'transfer' WHEN 9 THEN 'transfer_compact' WHEN 10 THEN 'children' WHEN 11 THEN 'pregnant' WHEN 12 THEN 'market' END AS code FROM events)"""
#: Rules: windows of weekdays, Saturdays and Sundays in minutes. Rule 4 isn't surveyed: nine to ten in the evening, Sundays and holidays free.
RULE_ROWS = [(0, 0, 540, 1320), (0, 5, 540, 1080), (1, 0, 600, 1080), (1, 5, 600, 1080), (1, 6, 600, 1080), (2, 0, 0, 1440), (2, 5, 0, 1440), (2, 6, 0, 1440), (3, 0, 0, 480), (3, 0, 1200, 1440), (3, 5, 1200, 1440), (4, 0, 540, 1320), (4, 5, 540, 1320)]
WINDOWS = "win AS (SELECT * FROM (VALUES {}) t(rule, d, s, e))".format(", ".join(map(str, RULE_ROWS)))
WEEKDAYS = {0: range(5), 5: (5,), 6: (6,)}

#: The tariff tables of operators/tariff.py as SQL.
PRICES = """CASE kind || grade WHEN 'on1' THEN [600, 300, 600, 900, 1200] WHEN 'on2' THEN [400, 200, 400, 600, 800] WHEN 'on3' THEN [200, 100, 300, 400, 400] WHEN 'off1' THEN [600, 300, 600, 900, 1200]
WHEN 'off2' THEN [400, 200, 400, 600, 800] WHEN 'off3' THEN [200, 100, 300, 400, 400] WHEN 'off4' THEN [200, 100, 200, 200, 200] WHEN 'off5' THEN [200, 100, 100, 100, 100] END"""
PASS = """CASE CAST(h AS VARCHAR) WHEN '8.0' THEN [10000, 7000, 5000, 2000, 1500] WHEN '9.0' THEN [11000, 8000, 5000, 2000, 1500] WHEN '10.0' THEN [13000, 9000, 6000, 3000, 2500] WHEN '11.0' THEN [14000, 10000, 7000, 3000, 2500]
WHEN '12.0' THEN [15000, 11000, 7000, 3000, 2500] WHEN '13.0' THEN [16000, 12000, 8000, 4000, 3500] END[grade]"""
PCT = "CASE WHEN code = 'emergency' THEN 0 WHEN code = 'transfer_compact' THEN 40 WHEN code IS NULL OR code = 'market' THEN 100 ELSE 50 END"
FREE = "CASE WHEN code IN ('charging', 'disabled_severe', 'veteran') THEN 120 WHEN code = 'market' THEN 90 ELSE 0 END"


def prog(m: str) -> str:
    step = lambda lo, hi, i: f"CAST(ceil(greatest(least({m}, {hi}) - {lo}, 0) / 10.0) AS BIGINT) * p[{i}]"
    return f"(CASE WHEN {m} > 0 THEN p[1] ELSE 0 END + {step(30, 60, 2)} + {step(60, 120, 3)} + {step(120, 180, 4)} + {step(180, 1440, 5)})"


DAYS = f"""{STAY}, {WINDOWS}, day AS (SELECT *, unnest(generate_series(a // 1440, (a + mins - 1) // 1440)) AS day FROM stay),
charged AS (SELECT event_id, day, any_value(a) AS a, any_value(mins) AS mins, any_value(kind) AS kind, any_value(grade) AS grade, any_value(code) AS code, CAST(coalesce(sum(greatest(least(a + mins, day * 1440 + e) - greatest(a, day * 1440 + s), 0)) FILTER (WHERE s IS NOT NULL), 0) AS BIGINT) AS billable, CAST(coalesce(sum(e - s), 0) AS BIGINT) AS win
FROM day LEFT JOIN win ON win.rule = day.rule AND day.day NOT IN {HOLIDAY_NUMBERS} AND win.d = CASE (day.day + 3) % 7 WHEN 5 THEN 5 WHEN 6 THEN 6 ELSE 0 END GROUP BY event_id, day)"""


def stays(spark, d):
    """Stays with their charged days."""
    empty = F.array().cast("array<struct<s:int,e:int>>")
    rule, windows = F.pmod("user_id", F.lit(5)), F.array(*[empty] * 7)
    for r in range(5):
        by_day = [[(s, e) for q, g, s, e in RULE_ROWS if q == r and day in WEEKDAYS[g]] for day in range(7)]
        mine = F.array(*[F.array(*[F.struct(F.lit(s).alias("s"), F.lit(e).alias("e")) for s, e in xs]) if xs else empty for xs in by_day])
        windows = F.when(rule == r, mine).otherwise(windows)
    k, codes = F.pmod("event_id", F.lit(14)), list(tariff.DISCOUNTS)
    code = F.element_at(F.array(*map(F.lit, [*codes, None])), (k + 1).cast("int"))
    x = read(spark, d, "events").select(
        "event_id", F.floor(micros("ts") / 60_000_000).alias("a"), (F.pmod("event_id", F.lit(2600)) + 5).alias("mins"), windows.alias("windows"),
        F.when(F.pmod("user_id", F.lit(3)) == 0, "on").otherwise("off").alias("kind"), (1 + F.pmod("user_id", F.lit(5))).cast("int").alias("grade"), code.alias("code"),
    )
    return x.withColumn("days", tariff.charged_days(F.col("a"), F.col("mins"), F.col("windows"), F.array(*[F.lit(h).cast("long") for h in HOLIDAY_NUMBERS])))


@query(f"WITH {DAYS} SELECT event_id, day, billable, win AS window_minutes FROM charged")
def surveyed_schedule(spark, d):
    """The charged minutes of each day of a stay by its lot's surveyed windows; holidays and days without a window are free."""
    return stays(spark, d).select("event_id", F.explode("days").alias("x")).select("event_id", "x.day", "x.billable", F.col("x.window").alias("window_minutes"))


@query(f"""WITH {DAYS}, u AS (SELECT *, {PRICES} AS p, {PCT} AS pct, {FREE} AS free, coalesce(sum(billable) OVER (PARTITION BY event_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM charged),
v AS (SELECT *, billable - least(greatest(free - before, 0), billable) AS due FROM u), w AS (SELECT *, {prog('due')} AS price FROM v),
s AS (SELECT event_id, any_value(p) AS p, any_value(grade) AS grade, any_value(pct) AS pct, CAST(sum(billable) AS BIGINT) AS billable, sum(due) AS due, sum(price) AS raw, sum(least(price, 25000)) AS cut, count(*) FILTER (WHERE due > 0) AS days, arg_min(win, day) FILTER (WHERE billable > 0) / 60.0 AS h FROM w GROUP BY event_id),
q AS (SELECT *, billable >= 15 AND due > 0 AND p IS NOT NULL AS charged, {PASS} AS pass0 FROM s),
r AS (SELECT *, CASE WHEN charged THEN pass0 END AS pass, CASE WHEN p IS NULL THEN NULL WHEN NOT charged THEN 0 ELSE CAST(floor(cut * pct / 10000.0) * 100 AS BIGINT) END AS total FROM q),
t AS (SELECT *, CASE WHEN charged AND days = 1 THEN CASE WHEN pct <> 100 THEN CAST(floor(pass * 30 / 10000.0) * 100 AS BIGINT) ELSE pass END END AS prepaid FROM r)
SELECT event_id, billable, CASE WHEN charged THEN CAST(raw AS BIGINT) END AS raw, coalesce(charged AND raw > cut, FALSE) AS capped, total, CASE WHEN charged THEN CAST(days AS INTEGER) ELSE 0 END AS paid_days, pass AS day_pass, prepaid, prepaid < total AS buy_pass, CASE WHEN prepaid IS NOT NULL THEN greatest(total - prepaid, 0) END AS saving,
CASE WHEN p IS NULL THEN 'no_such_tariff' WHEN billable < 15 THEN 'not_charged' WHEN due = 0 THEN 'within_free_minutes' WHEN pass IS NULL THEN 'no_day_pass' END AS reason FROM t""")
def fare_quote(spark, d):
    """The whole quote of a stay: charged days, free minutes, progression and cap by day, discount, rounding, day pass and whether to buy it."""
    q = tariff.quote(F.col("days"), tariff.rates(F.col("kind"), F.col("grade")), F.col("grade"), tariff.discount(F.col("code"), 0), tariff.discount(F.col("code"), 1), False)
    return stays(spark, d).select("event_id", q.alias("q")).select("event_id", "q.*")


@query(f"""WITH {LOTS}, x AS (SELECT lot, grade, 6 + lot % 10 AS hours, price FROM lots), y AS (SELECT *, CAST(hours AS DOUBLE) AS h FROM x), z AS (SELECT lot, hours, {PASS} AS pass, CAST(round_even(abs(price) / 1000, 0) AS INTEGER) * 1000 AS stored FROM y)
SELECT hours, count(*) AS n, count(pass) AS in_table, count(*) FILTER (WHERE pass = stored) AS equal, round(avg(CASE WHEN pass IS NOT NULL THEN (pass = stored)::INT END), 6) AS match_rate FROM z GROUP BY hours""")
def tariff_consistency(spark, d):
    """Stored prices against the table's, by opening hours; hours outside the table count as unknown, not as wrong."""
    x = lots(spark, d).select("grade", (6 + F.pmod("lot", F.lit(10))).alias("hours"), (F.bround(F.abs("price") / 1000, 0).cast("int") * 1000).alias("stored"))
    x = x.withColumn("pass", tariff.day_pass(F.col("hours"), F.col("grade")))
    same = F.col("pass") == F.col("stored")
    return x.groupBy("hours").agg(F.count("*").alias("n"), F.count("pass").alias("in_table"), F.count_if(same).alias("equal"), F.round(F.avg(same.cast("int")), 6).alias("match_rate"))


@query("""SELECT event_id, codes, to_json([c FOR c IN ['compact+transfer', 'charging+market'] IF list_has_all(string_split(codes, ','), string_split(c, '+'))])::VARCHAR AS combos
FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'transfer,compact' WHEN 1 THEN 'market' WHEN 2 THEN 'charging,market,compact' ELSE 'compact' END AS codes FROM events)""")
def benefit_combos(spark, d):
    """What a user chose, without repetitions in the order of choice, and the combinations whose parts were all chosen."""
    chosen = F.array_distinct(F.split(F.expr("CASE event_id % 4 WHEN 0 THEN 'transfer,compact,transfer' WHEN 1 THEN 'market,market' WHEN 2 THEN 'charging,market,charging,compact' ELSE 'compact' END"), ","))
    combos = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in (("compact", "transfer"), ("charging", "market"))])
    held = F.filter(combos, lambda c: F.size(F.array_except(F.array(c["a"], c["b"]), F.col("chosen"))) == 0)
    return read(spark, d, "events").select("event_id", chosen.alias("chosen")).select("event_id", F.array_join("chosen", ",").alias("codes"), F.to_json(F.transform(held, lambda c: F.concat_ws("+", c["a"], c["b"]))).alias("combos"))
