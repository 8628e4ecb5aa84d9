"""Event-time windows, over streams and in their batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import read
from ..streaming import live, windows


@query("SELECT event_type, time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_dedup_window(spark, d):
    """Tumbling windows of a stream of polls that drops repeated ones; it runs over what is there, then ends."""
    return windows.tumbling(spark, d, "6 hours").select("event_type", "start", "n", F.round("total", 4).alias("total"))


@query("""WITH e AS (SELECT event_type, value, time_bucket(INTERVAL 3 HOURS, ts, TIMESTAMP '1970-01-01') AS b FROM events), w AS (SELECT event_type, value, b - k.k * INTERVAL 3 HOURS AS start FROM e, (VALUES (0), (1), (2), (3)) k(k))
SELECT event_type, start, count(*) AS n, round(avg(value), 6) AS mean FROM w GROUP BY 1, 2""")
def sliding_windows(spark, d):
    w = F.window("ts", "12 hours", "3 hours")
    g = read(spark, d, "events").groupBy("event_type", w.alias("w")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return g.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "mean")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 4 HOURS THEN 0 ELSE 1 END AS f FROM events), s AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def gap_sessions(spark, d):
    """Runs of polls with gaps below four hours."""
    s = read(spark, d, "events").groupBy("user_id", F.session_window("ts", "4 hours").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


SLIDING = """WITH e AS (SELECT event_type, value, time_bucket(INTERVAL 3 HOURS, ts, TIMESTAMP '1970-01-01') AS b FROM events), w AS (SELECT event_type, value, b - k.k * INTERVAL 3 HOURS AS start FROM e, (VALUES (0), (1), (2), (3)) k(k))
SELECT event_type, start, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM w GROUP BY 1, 2"""


@query(SLIDING)
def stream_sliding(spark, d):
    """Counts and exact sums of sliding windows over a stream."""
    return windows.sliding(spark, d, "12 hours", "3 hours")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 4 HOURS THEN 0 ELSE 1 END AS f FROM events), s AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark, d):
    """Sessions of polls over a stream, merged as late polls join them."""
    return windows.sessions(spark, d, "4 hours")


@query("""WITH m AS (SELECT max(ts) AS now FROM events), s AS (SELECT user_id, time_bucket(INTERVAL 5 MINUTES, ts, TIMESTAMP '1970-01-01') AS slot, arg_max(value, (ts, event_id)) AS v FROM events, m WHERE ts >= now - INTERVAL 4 HOURS GROUP BY 1, 2)
SELECT user_id, count(*) AS slots, round(arg_max(v, slot), 6) AS latest, round(avg(v), 6) AS mean FROM s GROUP BY 1""")
def live_refresh(spark, d):
    """The features of each lot from the last four hours: five-minute slots with their last value, the latest and the mean."""
    e = read(spark, d, "events")
    now = e.agg(F.max("ts")).first()[0]  # a literal, so that the scan skips what is older
    recent = e.where(F.col("ts") >= F.lit(now).cast("timestamp_ntz") - F.expr("INTERVAL 4 HOURS"))
    slot = F.window("ts", "5 minutes")["start"].alias("slot")
    s = recent.groupBy("user_id", slot).agg(F.max_by("value", F.struct("ts", "event_id")).alias("v"))
    return s.groupBy("user_id").agg(F.count("*").alias("slots"), F.round(F.max_by("v", "slot"), 6).alias("latest"), F.round(F.avg("v"), 6).alias("mean"))


STEP = 360
_value = lambda k: f"max(v) FILTER (WHERE slot = last - {k})"


@query(f"""WITH s AS (SELECT user_id AS lot, epoch_us(ts) // {STEP * 60_000_000} AS slot, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY 1, 2), l AS (SELECT *, max(slot) OVER (PARTITION BY lot) AS last, max(slot) OVER () AS now FROM s),
f AS (SELECT lot, any_value(last) AS last, any_value(now) AS now, count(*) AS slots, {_value(0)} AS occ_now, {', '.join(f"{_value(k)} AS lag_{k}" for k in live.LAGS)}, {', '.join(f"avg(v) FILTER (WHERE slot > last - {w}) AS roll_mean_{w}" for w in live.MEANS)} FROM l WHERE slot > last - {live.SLOTS} GROUP BY lot)
SELECT lot, make_timestamp(last * {STEP * 60_000_000}) AS last_slot, slots, occ_now, {', '.join(f"lag_{k}" for k in live.LAGS)}, {', '.join(f"round(roll_mean_{w}, 6) AS roll_mean_{w}" for w in live.MEANS)}, last >= now - 1 AND {' AND '.join(f"lag_{k} IS NOT NULL" for k in live.LAGS)} AS ready FROM f""")
def stream_live_features(spark, d):
    """The features of each lot's newest slot from stream state of its last thirteen slots, and whether it is ready to be forecast."""
    out = live.live(spark, d, STEP)
    return out.withColumns({f"roll_mean_{w}": F.round(f"roll_mean_{w}", 6) for w in live.MEANS})
