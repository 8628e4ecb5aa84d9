"""Clock, holiday and text helpers: target-anchored features, opening hours, time zones, and parsers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.calendar import IN_HOLIDAYS, is_holiday
from ..registry import query
from ..sources.tables import LOTS, OBS, lots, observations, read
from .evaluation import PAIRS, pairs, r6
from .grids import FLOOR

@query(f"SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, any_value(CAST(ts AS DATE) {IN_HOLIDAYS}) AS holiday, any_value(CASE WHEN CAST(ts AS DATE) {IN_HOLIDAYS} OR isodow(ts) = 7 THEN 'sunday_holiday' WHEN isodow(ts) = 6 THEN 'saturday' ELSE 'weekday' END) AS day_group, count(*) AS n FROM events GROUP BY 1")
def holiday_calendar(spark, d):
    """Days with their group, holidays counting as Sundays."""
    day = F.to_date("ts")
    group = F.when(is_holiday(day) | (F.weekday(day) == 6), "sunday_holiday").when(F.weekday(day) == 5, "saturday").otherwise("weekday")
    g = read(spark, d, "events").groupBy(day.alias("x"), is_holiday(day).alias("holiday"), group.alias("day_group")).agg(F.count("*").alias("n"))
    return g.select(F.col("x").cast("string").alias("day"), "holiday", "day_group", "n")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN ts ELSE ts + INTERVAL 9 HOURS END AS local, CAST(hour(CASE WHEN event_id % 2 = 0 THEN ts ELSE ts + INTERVAL 9 HOURS END) AS INTEGER) AS hour FROM events")
def local_time(spark, d):
    """Times without a zone are local already (even ids); those in UTC are converted to Seoul's."""
    local = F.when(F.pmod("event_id", F.lit(2)) == 0, F.col("ts")).otherwise(F.convert_timezone(F.lit("UTC"), F.lit("Asia/Seoul"), F.col("ts")))
    return read(spark, d, "events").select("event_id", local.alias("local"), F.hour(local).alias("hour"))


@query(f"""WITH {PAIRS} SELECT lot, ts, horizon, round(lag_24h, 6) AS lag_day, round(lag_7d, 6) AS lag_week, round(occ_now - lag_24h, 6) AS change, (isodow(target_time) - 1) * 1440 + hour(target_time) * 60 + minute(target_time) AS minute_of_week, round(sin(2 * pi() * (hour(target_time) * 60 + minute(target_time)) / 1440), 6) AS day_sin, CAST(target_time AS DATE) {IN_HOLIDAYS} AS holiday FROM pairs""")
def target_features(spark, d):
    """Features anchored at the target: a day and a week before it, the change since, its place in the week and whether it is a holiday."""
    minute = F.hour("target_time") * 60 + F.minute("target_time")
    return pairs(spark, d).select(
        "lot", "ts", "horizon", r6("lag_24h").alias("lag_day"), r6("lag_7d").alias("lag_week"), r6(F.col("occ_now") - F.col("lag_24h")).alias("change"), (F.weekday("target_time") * 1440 + minute).cast("long").alias("minute_of_week"),
        r6(F.sin(2 * F.pi() * minute / 1440)).alias("day_sin"), is_holiday(F.to_date("target_time")).alias("holiday"),
    )


@query("SELECT event_id, round(CASE WHEN user_id % 6 = 0 THEN 0 ELSE greatest((epoch_us(ts) - epoch_us(date_trunc('day', ts))) // 1000000 - (6 + user_id % 5) * 3600, 0) / 3600 END, 6) AS hours FROM events")
def hours_since_open(spark, d):
    """Hours since a lot opened that day: none before, and none where it stays closed."""
    seconds = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    hours = F.when(F.pmod("user_id", F.lit(6)) == 0, 0.0).otherwise(F.greatest(seconds - (6 + F.pmod("user_id", F.lit(5))) * 3600, F.lit(0)) / 3600)
    return read(spark, d, "events").select("event_id", r6(hours).alias("hours"))


@query(f"WITH {OBS} SELECT lot, {FLOOR} AS slot, round(avg(CASE WHEN park <= cells THEN park * 100.0 / cells END), 6) AS occ, max(park) AS most, count(*) AS n, count(*) FILTER (WHERE park > cells) AS invalid FROM obs GROUP BY 1, 2")
def multi_measure(spark, d):
    """Several measures on one grid: the mean of valid shares, the largest count, and how many rows there were."""
    valid = F.when(F.col("park") <= F.col("cells"), F.col("park") * 100.0 / F.col("cells"))
    g = observations(spark, d).groupBy("lot", F.window("ts", "360 minutes").alias("w")).agg(r6(F.avg(valid)).alias("occ"), F.max("park").alias("most"), F.count("*").alias("n"), F.count_if(F.col("park") > F.col("cells")).alias("invalid"))
    return g.select("lot", F.col("w.start").cast("timestamp_ntz").alias("slot"), "occ", "most", "n", "invalid")


@query(f"""WITH {OBS}, x AS (SELECT lot, ts, event_id, CASE WHEN park <= cells THEN park * 100.0 / cells END AS occ FROM obs), n AS (SELECT *, lag(occ) {{w}} AS po, lead(occ) {{w}} AS no, lag(ts) {{w}} AS pt, lead(ts) {{w}} AS nt FROM x)
SELECT event_id, round(CAST(coalesce(occ, CASE WHEN nt > pt THEN po + (no - po) * (epoch_us(ts) - epoch_us(pt)) / (epoch_us(nt) - epoch_us(pt)) END) AS DOUBLE), 6) AS occ FROM n""".replace("{w}", "OVER (PARTITION BY lot ORDER BY ts, event_id)"))
def time_interpolation(spark, d):
    """Single missing values between two known ones, by the share of the time that has passed."""
    w = Window.partitionBy("lot").orderBy("ts", "event_id")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    x = observations(spark, d).withColumn("occ", F.when(F.col("park") <= F.col("cells"), F.col("park") * 100.0 / F.col("cells")))
    n = x.withColumns({"po": F.lag("occ").over(w), "no": F.lead("occ").over(w), "pt": F.lag("ts").over(w), "nt": F.lead("ts").over(w)})
    share = F.when(F.col("nt") > F.col("pt"), (us("ts") - us("pt")) / (us("nt") - us("pt")))
    return n.select("event_id", r6(F.coalesce("occ", F.col("po") + (F.col("no") - F.col("po")) * share)).alias("occ"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL WHEN 1 THEN date_trunc('minute', ts) ELSE date_trunc('second', ts) END AS at FROM events""")
def mixed_timestamps(spark, d):
    """Times written in one of three formats; what fits none is unknown."""
    k = F.pmod("event_id", F.lit(4))
    text = F.when(k == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).when(k == 1, F.date_format("ts", "yyyy/MM/dd HH:mm")).when(k == 2, F.date_format("ts", "yyyyMMddHHmmss")).otherwise("soon")
    forms = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd HH:mm", "yyyyMMddHHmmss")
    return read(spark, d, "events").select("event_id", text.alias("t")).select("event_id", F.coalesce(*[F.try_to_timestamp("t", F.lit(f)) for f in forms]).cast("timestamp_ntz").alias("at"))


@query("""SELECT p_partkey, regexp_replace(replace(replace(trim('  ' || p_type || ' / ' || p_name || ' '), ' ', '_'), '/', '_'), '[()]', '', 'g') AS category, substr(trim(regexp_replace(p_name || chr(7) || ' ' || repeat('é', 5), '[^\\x20-\\x7e]', '', 'g')), 1, 500) AS clean FROM part""")
def text_cleaning(spark, d):
    """Category names without blanks, slashes and brackets; remarks of printable characters alone, trimmed and cut at 500."""
    category = F.regexp_replace(F.translate(F.trim(F.concat(F.lit("  "), "p_type", F.lit(" / "), "p_name", F.lit(" "))), " /", "__"), "[()]", "")
    remark = F.concat("p_name", F.lit("\x07 "), F.repeat(F.lit("é"), 5))
    return read(spark, d, "part").select("p_partkey", category.alias("category"), F.substring(F.trim(F.regexp_replace(remark, "[^\\x20-\\x7e]", "")), 1, 500).alias("clean"))


@query("""WITH x AS (SELECT event_id, event_type, CASE WHEN event_id % 10 = 0 THEN 'nan'::DOUBLE WHEN event_id % 10 = 1 THEN NULL ELSE value END AS v FROM events)
SELECT event_id, v IS NOT NULL AND NOT isnan(v) AS known, CASE WHEN v IS NULL OR isnan(v) THEN 0.1 WHEN event_type = 'click' THEN 0.95 WHEN v > 50 THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence FROM x""")
def nan_and_confidence(spark, d):
    """NaN is as unknown as null; confidence by a ladder of cases."""
    k = F.pmod("event_id", F.lit(10))
    v = F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(None)).otherwise(F.col("value"))
    known = F.col("v").isNotNull() & ~F.isnan("v")
    confidence = F.when(~known, 0.1).when(F.col("event_type") == "click", 0.95).when(F.col("v") > 50, 0.9).otherwise(0.5)
    return read(spark, d, "events").select("event_id", "event_type", v.alias("v")).select("event_id", known.alias("known"), confidence.alias("confidence"))


@query(f"""WITH {LOTS}, g AS (SELECT * FROM (VALUES ('weekday'), ('saturday'), ('sunday_holiday')) t(day_group)), b AS (SELECT lot, CASE lot % 4 WHEN 0 THEN 'always' WHEN 1 THEN 'daytime' WHEN 2 THEN 'closed' ELSE 'unknown' END AS bucket FROM lots)
SELECT lot, day_group, bucket, CASE WHEN bucket = 'always' THEN '00:00-24:00' WHEN bucket = 'daytime' AND day_group = 'weekday' THEN '09:00-18:00' WHEN bucket = 'daytime' AND day_group = 'saturday' THEN '09:00-13:00' WHEN bucket IN ('daytime', 'closed') THEN 'closed' END AS windows, bucket <> 'unknown' AS verified FROM b CROSS JOIN g""")
def rule_synthesis(spark, d):
    """A rule of each lot for each group of days, from the bucket that the lot fell into; unknown ones have no windows."""
    bucket = F.expr("CASE lot % 4 WHEN 0 THEN 'always' WHEN 1 THEN 'daytime' WHEN 2 THEN 'closed' ELSE 'unknown' END")
    b = lots(spark, d).select("lot", bucket.alias("bucket"), F.explode(F.array(F.lit("weekday"), F.lit("saturday"), F.lit("sunday_holiday"))).alias("day_group"))
    day = F.col("bucket") == "daytime"
    windows = F.when(F.col("bucket") == "always", "00:00-24:00").when(day & (F.col("day_group") == "weekday"), "09:00-18:00").when(day & (F.col("day_group") == "saturday"), "09:00-13:00").when(F.col("bucket").isin("daytime", "closed"), "closed")
    return b.select("lot", "day_group", "bucket", windows.alias("windows"), (F.col("bucket") != "unknown").alias("verified"))
