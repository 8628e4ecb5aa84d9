"""Audits of feeds and rule tables: merges, changed snapshots, constant columns, overlapping periods, whole weekends."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import OBS, observations, read


@query(f"""WITH {OBS}, a AS (SELECT DISTINCT lot, date_trunc('hour', ts) AS slot FROM obs WHERE event_id % 3 <> 0), b AS (SELECT DISTINCT lot, date_trunc('hour', ts) AS slot FROM obs WHERE event_id % 3 <> 1)
SELECT b.lot, count(*) AS n, count(*) FILTER (WHERE a.lot IS NULL) AS added, min(b.slot) AS first, max(b.slot) AS last FROM b LEFT JOIN a ON a.lot = b.lot AND a.slot = b.slot GROUP BY b.lot""")
def merge_report(spark, d):
    """What a second collector's file adds to the first by key, and its range of times.

    One aggregate by key marks which file has it, so the two files need no join.
    """
    o = observations(spark, d).select("lot", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("slot"), F.pmod("event_id", F.lit(3)).alias("part"))
    keys = o.groupBy("lot", "slot").agg(F.bool_or(F.col("part") != 0).alias("old"), F.bool_or(F.col("part") != 1).alias("new")).where("new")
    return keys.groupBy("lot").agg(F.count("*").alias("n"), F.count_if(~F.col("old")).alias("added"), F.min("slot").alias("first"), F.max("slot").alias("last"))


@query(f"""WITH {OBS}, day AS (SELECT lot, CAST(ts AS DATE) AS day, arg_max(park, event_id) AS park FROM obs GROUP BY 1, 2)
SELECT a.day, count(*) AS n, round(avg(CASE WHEN a.park <> b.park THEN 1.0 ELSE 0.0 END), 6) AS changed FROM day a JOIN day b ON a.lot = b.lot AND b.day = a.day + INTERVAL 1 DAY GROUP BY a.day""")
def snapshot_change(spark, d):
    """The share of lots whose last value differs from the next day's."""
    day = observations(spark, d).groupBy("lot", F.to_date("ts").alias("day")).agg(F.max_by("park", "event_id").alias("park"))
    w = Window.partitionBy("lot").orderBy("day")  # one row a lot and day
    both = day.select("day", "park", F.lead("day").over(w).alias("next"), F.lead("park").over(w).alias("then")).where(F.col("next") == F.date_add("day", 1))
    return both.groupBy("day").agg(F.count("*").alias("n"), F.round(F.avg((F.col("park") != F.col("then")).cast("double")), 6).alias("changed"))


@query("""WITH u AS (UNPIVOT (SELECT l_suppkey, CAST(l_linenumber AS VARCHAR) AS linenumber, CAST(l_tax AS VARCHAR) AS tax, l_returnflag AS returnflag, CASE WHEN l_quantity > 49 THEN l_linestatus END AS status FROM lineitem) ON linenumber, tax, returnflag, status INTO NAME feature VALUE v),
k AS (SELECT l_suppkey, feature, count(DISTINCT v) AS kinds, count(v) AS n FROM u GROUP BY 1, 2), f AS (SELECT unnest(['linenumber', 'tax', 'returnflag', 'status']) AS feature), s AS (SELECT l_suppkey, count(*) AS total FROM lineitem GROUP BY 1)
SELECT f.feature, count(*) FILTER (WHERE coalesce(k.kinds, 0) <= 1) AS constant_lots, count(*) AS lots, round(1 - sum(coalesce(k.n, 0)) / sum(s.total), 6) AS null_rate FROM s CROSS JOIN f LEFT JOIN k ON k.l_suppkey = s.l_suppkey AND k.feature = f.feature GROUP BY f.feature""")
def constant_features(spark, d):
    """Lots where a feature has at most one value, and the feature's rate of nulls. A least value equal to the greatest, or none, says so without counting distinct values."""
    li = read(spark, d, "lineitem").select("l_suppkey", F.col("l_linenumber").alias("linenumber"), F.col("l_tax").alias("tax"), F.col("l_returnflag").alias("returnflag"), F.expr("CASE WHEN l_quantity > 49 THEN l_linestatus END").alias("status"))
    names = ["linenumber", "tax", "returnflag", "status"]
    per = li.groupBy("l_suppkey").agg(F.count("*").alias("total"), *[F.struct(F.lit(c).alias("feature"), F.min(c).eqNullSafe(F.max(c)).alias("constant"), F.count(c).alias("n")).alias(c) for c in names])
    long = per.select("total", F.explode(F.array(*names)).alias("x")).select("total", "x.*")
    return long.groupBy("feature").agg(F.count_if("constant").alias("constant_lots"), F.count("*").alias("lots"), F.round(1 - F.sum("n") / F.sum("total"), 6).alias("null_rate"))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS since, CAST(CAST(o_orderdate AS DATE) + INTERVAL 60 DAYS AS DATE) AS until FROM orders),
w AS (SELECT *, lag(until) OVER (PARTITION BY o_custkey ORDER BY since, o_orderkey) AS before FROM r) SELECT o_custkey, o_orderkey, CAST(since AS VARCHAR) AS since, CAST(before AS VARCHAR) AS before FROM w WHERE since <= before""")
def overlapping_periods(spark, d):
    """Rules of a key whose period starts before the former one has ended."""
    r = read(spark, d, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("since"))
    w = Window.partitionBy("o_custkey").orderBy("since", "o_orderkey")
    near = r.withColumn("before", F.date_add(F.lag("since").over(w), 60)).where("since <= before")
    return near.select("o_custkey", "o_orderkey", F.col("since").cast("string").alias("since"), F.col("before").cast("string").alias("before"))


@query("""WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE isodow(ts) >= 6)
SELECT user_id, count(DISTINCT date_trunc('week', day)) AS weekends, count(*) - count(DISTINCT date_trunc('week', day)) AS whole FROM d GROUP BY user_id""")
def weekends_seen(spark, d):
    """Distinct weekends with polls of each lot, and those with both days."""
    e = read(spark, d, "events").where(F.weekday("ts") >= 5).groupBy("user_id", F.date_trunc("week", "ts").alias("week")).agg(F.max(F.weekday("ts")).alias("b"), F.min(F.weekday("ts")).alias("a"))
    return e.groupBy("user_id").agg(F.count("*").alias("weekends"), F.count_if(F.col("a") < F.col("b")).alias("whole"))
