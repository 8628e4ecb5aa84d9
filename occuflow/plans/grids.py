"""Grid, feature and calendar queries on six-hour slots of the event lots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import features as ft
from ..operators import timegrid as tg
from ..registry import query
from ..sources.tables import OBS, observations

STEP = 360
I = f"INTERVAL {STEP} MINUTES"
FLOOR = f"time_bucket({I}, ts, TIMESTAMP '1970-01-01')"
CEIL = f"CASE WHEN {FLOOR} = ts THEN ts ELSE {FLOOR} + {I} END"
#: SQL of grid_last: the table ``grid`` (lot, ts, occ).
GRID = f"""{OBS},
placed AS (SELECT lot, {CEIL} AS slot, ts, event_id, CASE WHEN park >= 0 AND park <= cells AND cells > 0 THEN park * 100.0 / cells END AS occ FROM obs),
last AS (SELECT lot, slot, occ FROM placed WHERE occ IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lot, slot ORDER BY ts DESC, event_id DESC) = 1),
span AS (SELECT lot, min(slot) AS lo, max(slot) AS hi FROM placed GROUP BY lot),
slots AS (SELECT lot, unnest(generate_series(lo, hi, {I})) AS slot FROM span),
grid AS (SELECT s.lot, s.slot AS ts, CAST(l.occ AS DOUBLE) AS occ FROM slots s LEFT JOIN last l USING (lot, slot))"""
W = "OVER (PARTITION BY lot ORDER BY ts"


def grid(spark: SparkSession, d: str) -> DataFrame:
    return tg.grid_last(observations(spark, d), STEP)


@query(f"WITH {GRID} SELECT lot, ts, round(occ, 6) AS occ FROM grid")
def grid_last(spark, d):
    return grid(spark, d).select("lot", "ts", F.round("occ", 6).alias("occ"))


@query(f"""WITH {GRID}, ends AS (SELECT min(lo) AS lo, max(hi) AS hi FROM span),
every AS (SELECT lot, unnest(generate_series(e.lo, e.hi, {I})) AS slot FROM (SELECT lot FROM span), ends e)
SELECT e.lot, e.slot AS ts, round(CAST(l.occ AS DOUBLE), 6) AS occ FROM every e LEFT JOIN last l USING (lot, slot)""")
def grid_common(spark, d):
    return tg.grid_last(observations(spark, d), STEP, common=True).select("lot", "ts", F.round("occ", 6).alias("occ"))


MEAN = f"""{OBS}, placed AS (SELECT lot, {FLOOR} AS slot, least(greatest(park * 100.0 / cells, 0.0), 120.0) AS occ FROM obs),
means AS (SELECT lot, slot, avg(occ) AS occ FROM placed GROUP BY lot, slot),
span AS (SELECT lot, min(slot) AS lo, max(slot) AS hi FROM placed GROUP BY lot),
slots AS (SELECT lot, unnest(generate_series(lo, hi, {I})) AS slot FROM span),
grid AS (SELECT s.lot, s.slot AS ts, CAST(m.occ AS DOUBLE) AS occ FROM slots s LEFT JOIN means m USING (lot, slot))"""


@query(f"WITH {MEAN} SELECT lot, ts, round(occ, 6) AS occ FROM grid")
def grid_mean_floor(spark, d):
    return tg.grid_mean(observations(spark, d), STEP).select("lot", "ts", F.round("occ", 6).alias("occ"))


@query(f"""WITH {MEAN}, near AS (
  SELECT *, last_value(CASE WHEN occ IS NOT NULL THEN ts END IGNORE NULLS) {W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pt,
    last_value(occ IGNORE NULLS) {W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS po,
    first_value(CASE WHEN occ IS NOT NULL THEN ts END IGNORE NULLS) {W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nt,
    first_value(occ IGNORE NULLS) {W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS no FROM grid)
SELECT lot, ts, round(coalesce(occ, CASE WHEN date_diff('minute', pt, ts) = {STEP} AND nt IS NOT NULL THEN po + (no - po) * {STEP} / date_diff('minute', pt, nt) END), 6) AS occ FROM near""")
def interp_limit1(spark, d):
    return tg.interpolate_one(tg.grid_mean(observations(spark, d), STEP), STEP).select("lot", "ts", F.round("occ", 6).alias("occ"))


@query(f"""WITH {GRID} SELECT lot, ts, {', '.join(f'round(lag(occ, {k}) {W}), 6) AS lag_{k}' for k in (1, 2, 3, 6, 12))},
{', '.join(f'round(occ - lag(occ, {k}) {W}), 6) AS delta_{k}' for k in (1, 3, 6))} FROM grid""")
def lag_features(spark, d):
    f = ft.features(grid(spark, d), STEP)
    return f.select("lot", "ts", *[F.round(c, 6).alias(c) for c in f.columns if c.startswith(("lag_", "delta_"))])


@query(f"""WITH {GRID} SELECT lot, ts, {', '.join(f'round(avg(occ) {W} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW), 6) AS roll_mean_{w}' for w in (3, 6, 12))} FROM grid""")
def rolling_mp1(spark, d):
    return ft.windowed(grid(spark, d), STEP, {f"roll_mean_{w}": F.round(ft.rolling_mean(w), 6) for w in (3, 6, 12)}, 11).drop("occ")


@query(f"""WITH {GRID} SELECT lot, ts, {', '.join(
    f'CASE WHEN count(occ) {W} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) = {w} THEN round(avg(occ) {W} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW), 6) END AS roll_mean_{w}' for w in (2, 3))} FROM grid""")
def rolling_full(spark, d):
    return ft.windowed(grid(spark, d), STEP, {f"roll_mean_{w}": F.round(ft.rolling_mean(w, True), 6) for w in (2, 3)}, 2).drop("occ")


@query(f"WITH {GRID} SELECT lot, ts, count(occ) {W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 AS complete FROM grid")
def history_complete(spark, d):
    return ft.windowed(grid(spark, d), STEP, {"complete": ft.past_complete(3)}, 2).drop("occ")


@query(f"WITH {GRID} SELECT lot, ts, count(occ) {W} ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) = 3 AS complete FROM grid")
def future_complete(spark, d):
    return ft.windowed(grid(spark, d), STEP, {"complete": ft.future_complete(2)}, ahead=2).drop("occ")


@query(f"""WITH {GRID}, f AS (SELECT lot, ts, {', '.join(f'count(occ) {W} ROWS BETWEEN CURRENT ROW AND {k} FOLLOWING) = {k + 1} AS c{k}' for k in (1, 2, 4))} FROM grid)
SELECT lot, count(*) AS slots, {', '.join(f'count(*) FILTER (WHERE c{k}) AS whole_{k}' for k in (1, 2, 4))}, {', '.join(f'round(count(*) FILTER (WHERE c{k}) / count(*), 6) AS share_{k}' for k in (1, 2, 4))} FROM f GROUP BY lot""")
def horizon_continuity(spark, d):
    """Slots from which a whole horizon is observed, by lot."""
    f = ft.windowed(grid(spark, d), STEP, {f"c{k}": ft.future_complete(k) for k in (1, 2, 4)}, ahead=4)
    return f.groupBy("lot").agg(F.count("*").alias("slots"), *[F.count_if(f"c{k}").alias(f"whole_{k}") for k in (1, 2, 4)], *[F.round(F.count_if(f"c{k}") / F.count("*"), 6).alias(f"share_{k}") for k in (1, 2, 4)])


@query("""SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(minute(ts) AS INTEGER) AS minute, CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS minute_of_day, CAST(isodow(ts) - 1 AS INTEGER) AS dow,
isodow(ts) >= 6 AS is_weekend, isodow(ts) = 7 AS is_sunday FROM events""")
def calendar_features(spark, d):
    e = observations(spark, d)
    return e.select("event_id", F.hour("ts").alias("hour"), F.minute("ts").alias("minute"), ft.minute_of_day().alias("minute_of_day"), F.weekday("ts").alias("dow"), (F.weekday("ts") >= 5).alias("is_weekend"), (F.weekday("ts") == 6).alias("is_sunday"))


@query("""WITH x AS (SELECT event_id, hour(ts) * 60 + minute(ts) AS m, (isodow(ts) - 1) * 1440 + hour(ts) * 60 + minute(ts) AS w, (isodow(ts) >= 6)::INT AS we FROM events)
SELECT event_id, round(sin(m * 2 * pi() / 1440), 6) + 0.0 AS day_sin, round(cos(m * 2 * pi() / 1440), 6) + 0.0 AS day_cos, round(sin(w * 2 * pi() / 10080), 6) + 0.0 AS week_sin, round(cos(w * 2 * pi() / 10080), 6) + 0.0 AS week_cos,
round(we * sin(m * 2 * pi() / 1440), 6) + 0.0 AS we_sin, round(we * cos(m * 2 * pi() / 1440), 6) + 0.0 AS we_cos FROM x""")
def cyclic_features(spark, d):
    e = observations(spark, d)
    day, week, we = ft.cyclic(ft.minute_of_day(), 1440), ft.cyclic(F.weekday("ts") * 1440 + ft.minute_of_day(), 10080), (F.weekday("ts") >= 5).cast("int")
    r = lambda c, n: (F.round(c, 6) + 0.0).alias(n)
    return e.select("event_id", r(day[0], "day_sin"), r(day[1], "day_cos"), r(week[0], "week_sin"), r(week[1], "week_cos"), r(we * day[0], "we_sin"), r(we * day[1], "we_cos"))


@query("""WITH w AS (SELECT event_id, hour(ts) * 60 + minute(ts) AS pos, isodow(ts) = 7 AS sunday, CASE user_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 540 WHEN 2 THEN 600 WHEN 3 THEN 1200 ELSE 480 END AS a,
  CASE user_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 1080 WHEN 2 THEN 600 WHEN 3 THEN 360 ELSE 1320 END AS b0 FROM events),
v AS (SELECT event_id, pos, sunday, coalesce(a, 0) AS a, CASE WHEN coalesce(b0, 1440) < coalesce(a, 0) THEN coalesce(b0, 1440) + 1440 ELSE coalesce(b0, 1440) END AS b FROM w),
u AS (SELECT *, a = b AS closed, CASE WHEN pos >= a AND pos < b THEN pos WHEN b > 1440 AND pos + 1440 < b THEN pos + 1440 END AS pin FROM v),
t AS (SELECT *, NOT closed AND pin IS NOT NULL AS inside FROM u)
SELECT event_id, inside::INT AS is_operating, CAST(CASE WHEN closed THEN 1440 WHEN inside THEN 0 WHEN pos < a THEN a - pos ELSE 1440 END AS INTEGER) AS min_to_open,
CAST(CASE WHEN inside THEN b - pin ELSE 0 END AS INTEGER) AS min_to_close, (NOT inside OR sunday)::INT AS is_free_now FROM t""")
def operating_window(spark, d):
    e = observations(spark, d)
    kind = F.pmod("lot", F.lit(5))
    start = F.when(kind == 1, 540).when(kind == 2, 600).when(kind == 3, 1200).when(kind == 4, 480)
    end = F.when(kind == 1, 1080).when(kind == 2, 600).when(kind == 3, 360).when(kind == 4, 1320)
    return e.select("event_id", *[c.alias(n) for n, c in ft.operating(ft.minute_of_day(), start, end, F.weekday("ts") == 6).items()])


@query("""SELECT event_id, CASE WHEN isodow(ts) = 7 OR CAST(ts AS DATE) IN (DATE '2024-01-01', DATE '2024-01-15') THEN 'sunday_holiday' WHEN isodow(ts) = 6 THEN 'saturday' ELSE 'weekday' END AS day_group FROM events""")
def day_group(spark, d):
    holiday = F.to_date("ts").isin("2024-01-01", "2024-01-15")
    return observations(spark, d).select("event_id", ft.day_group("ts", holiday).alias("day_group"))


OPEN = "CASE lot % 4 WHEN 0 THEN TRUE WHEN 1 THEN NULL WHEN 2 THEN hour(ts) >= 10 AND hour(ts) < 22 ELSE CASE WHEN isodow(ts) >= 6 THEN FALSE ELSE hour(ts) >= 6 AND hour(ts) < 20 END END"


def accessible():
    """Open always, unknown, 10 to 22 daily, or 6 to 20 on weekdays, by the lot; unknown stays null."""
    k, h = F.pmod("lot", F.lit(4)), F.hour("ts")
    return F.when(k == 0, True).when(k == 2, (h >= 10) & (h < 22)).when(k == 3, F.when(F.weekday("ts") >= 5, False).otherwise((h >= 6) & (h < 20)))


@query(f"""WITH {GRID}, v AS (SELECT lot, ts, {OPEN} AS open, occ FROM grid)
SELECT lot, ts, open, round(CASE WHEN open THEN occ END, 6) AS occ_valid, max((open IS NOT TRUE)::INT) {W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) = 1 AS opened_recently,
round(avg(CASE WHEN open THEN occ END) {W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS mean_valid FROM v""")
def label_valid_mask(spark, d):
    """Values are masked where a lot isn't known to be open, before any feature is made of them."""
    v = grid(spark, d).withColumn("open", accessible()).withColumn("occ_valid", F.expr("CASE WHEN open THEN occ END"))
    shut = ~F.coalesce("open", F.lit(False))
    v = ft.windowed(v, STEP, {"opened_recently": ft.recently(shut, 4), "mean_valid": F.round(ft.rolling_mean(4, c="occ_valid"), 6)}, 3)
    return v.select("lot", "ts", "open", F.round("occ_valid", 6).alias("occ_valid"), "opened_recently", "mean_valid")


@query(f"""WITH {OBS}, g AS (SELECT lot, ts, park, lag(ts) {W}, event_id) AS pt, lag(park) {W}, event_id) AS pp FROM obs)
SELECT lot, ts, (epoch_us(ts) - epoch_us(pt)) // 1000000 AS gap_s, park - pp AS step, abs(park - pp) > 50 AS jump, abs(park - pp) > 50 AND (epoch_us(ts) - epoch_us(pt)) // 1000000 <= 3600 AS quick_jump FROM g""")
def jump_flags(spark, d):
    w = Window.partitionBy("lot").orderBy("ts", "event_id")
    o = observations(spark, d).withColumns({"pt": F.lag("ts").over(w), "pp": F.lag("park").over(w)})
    gap, step = F.floor((tg.micros("ts") - tg.micros("pt")) / 1_000_000), F.col("park") - F.col("pp")
    return o.select("lot", "ts", gap.alias("gap_s"), step.alias("step"), (F.abs(step) > 50).alias("jump"), ((F.abs(step) > 50) & (gap <= 3600)).alias("quick_jump"))


@query(f"WITH {OBS} SELECT event_id, round(CASE WHEN park >= 0 AND park <= cells THEN park * 100.0 / cells END, 6) AS dropped, round(least(park * 100.0 / cells, 120), 6) AS clip120, round(least(park * 100.0 / cells, 100), 6) AS clip100, round(least(park * 1.0 / cells, 1.2), 6) AS ratio12, park > cells OR park < 0 AS invalid FROM obs")
def occupancy_policies(spark, d):
    o = observations(spark, d)
    return o.select("event_id", *[F.round(tg.occupancy(p), 6).alias(n) for p, n in (("drop", "dropped"), ("clip120", "clip120"), ("clip100", "clip100"), ("ratio1.2", "ratio12"))], tg.invalid().alias("invalid"))


@query(f"""WITH {GRID}, h AS (SELECT lot, CAST(hour(ts) AS BIGINT) // 6 AS h FROM grid WHERE occ IS NOT NULL GROUP BY 1, 2), n AS (SELECT lot, h, h - row_number() OVER (PARTITION BY lot ORDER BY h) AS k FROM h)
SELECT lot, string_agg(w, '|' ORDER BY w) AS windows FROM (SELECT lot, lpad(CAST(min(h) * 6 AS VARCHAR), 2, '0') || ':00-' || lpad(CAST(max(h) * 6 + 6 AS VARCHAR), 2, '0') || ':00' AS w FROM n GROUP BY lot, k) GROUP BY lot""")
def open_hour_islands(spark, d):
    """Runs of quarters of the day with observations, as windows."""
    h = grid(spark, d).where("occ IS NOT NULL").select("lot", F.floor(F.hour("ts") / 6).alias("h")).distinct()
    k = h.withColumn("k", F.col("h") - F.row_number().over(Window.partitionBy("lot").orderBy("h")))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    runs = k.groupBy("lot", "k").agg(F.concat(two(F.min("h") * 6), F.lit(":00-"), two(F.max("h") * 6 + 6), F.lit(":00")).alias("w"))
    return runs.groupBy("lot").agg(F.array_join(F.array_sort(F.collect_list("w")), "|").alias("windows"))
