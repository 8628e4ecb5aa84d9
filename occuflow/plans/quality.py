"""Data quality: bad rows, dead feeds, gaps, freshness, validation, hashes, availability."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import features as ft
from ..operators import quality as q
from ..operators.timegrid import micros
from ..registry import query
from ..sources.tables import OBS, observations, read
from .evaluation import r6
from .grids import GRID, grid


@query(f"WITH {OBS} SELECT lot, count(*) AS n, count(*) FILTER (WHERE park < 0) AS negative, count(*) FILTER (WHERE park > cells) AS over_capacity, count(*) FILTER (WHERE cells IS NULL OR cells <= 0) AS bad_cells, count(*) FILTER (WHERE park IS NULL) AS missing, round(avg(CASE WHEN park BETWEEN 0 AND cells THEN park * 100.0 / cells END), 6) AS mean_valid FROM obs GROUP BY lot")
def bad_row_flags(spark, d):
    o = observations(spark, d)
    flags = q.bad_flags()
    return o.groupBy("lot").agg(F.count("*").alias("n"), *[F.count_if(c).alias(n) for n, c in flags.items()], r6(F.avg(F.expr("CASE WHEN park BETWEEN 0 AND cells THEN park * 100.0D / cells END"))).alias("mean_valid"))


@query(f"WITH {OBS} SELECT lot, count(*) AS n, min(park) AS least, max(park) AS most FROM obs GROUP BY lot HAVING max(park) - min(park) < 200")
def dead_feed_having(spark, d):
    g = observations(spark, d).groupBy("lot").agg(F.count("*").alias("n"), F.min("park").alias("least"), F.max("park").alias("most"))
    return g.where(F.col("most") - F.col("least") < 200)


@query(f"WITH {OBS}, live AS (SELECT lot FROM obs GROUP BY lot HAVING max(park) - min(park) >= 200) SELECT o.event_id, o.lot FROM obs o WHERE o.lot IN (SELECT lot FROM live) AND o.park <= o.cells")
def live_rows(spark, d):
    """Valid rows of lots whose feed moves: a semi-join with the aggregate."""
    o = observations(spark, d)
    live = o.groupBy("lot").agg((F.max("park") - F.min("park")).alias("span")).where("span >= 200").select("lot")
    return o.where("park <= cells").join(live, "lot", "left_semi").select("event_id", "lot")


@query(f"""WITH {OBS}, t AS (SELECT DISTINCT lot, ts FROM obs), g AS (SELECT lot, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY lot ORDER BY ts))) / 60000000.0 AS m FROM t)
SELECT lot, count(m) AS intervals, round(median(m), 4) AS median_minutes, count(*) FILTER (WHERE m > 720) AS gaps, round(coalesce(sum(m) FILTER (WHERE m > 720), 0), 4) AS gap_minutes FROM g GROUP BY lot""")
def poll_gaps(spark, d):
    return q.gaps(observations(spark, d), 720).select("lot", "intervals", F.round("median_minutes", 4).alias("median_minutes"), "gaps", F.round("gap_minutes", 4).alias("gap_minutes"))


@query("""WITH m AS (SELECT event_type, max(ts) AS last FROM events GROUP BY 1), n AS (SELECT max(ts) AS now FROM events)
SELECT event_type, last, (epoch_us(now) - epoch_us(last)) // 60000000 AS minutes_behind, (epoch_us(now) - epoch_us(last)) // 60000000 > 20 AS stale FROM m, n""")
def freshness(spark, d):
    m = read(spark, d, "events").groupBy("event_type").agg(F.max("ts").alias("last"))
    now = m.agg(F.max("last").alias("now")).withColumn("k", F.lit(1))
    x = m.withColumn("k", F.lit(1)).join(F.broadcast(now), "k")  # one row
    behind = F.floor((micros("now") - micros("last")) / 60_000_000)
    return x.select("event_type", "last", behind.alias("minutes_behind"), (behind > 20).alias("stale"))


CODES = "['bad_total', 'bad_status', 'orphan', 'weekend_urgent', 'duplicate']"


@query(f"""WITH o AS (SELECT *, count(*) OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE)) > 1 AS dup FROM orders), f AS (SELECT o_orderkey, unnest({CODES}) AS code, unnest([o_totalprice < 20000, o_orderstatus NOT IN ('O', 'F'), o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0), isodow(o_orderdate) >= 6 AND o_orderpriority LIKE '1%', dup]) AS bad FROM o)
SELECT o_orderkey, code FROM f WHERE bad""")
def validate_rows(spark, d):
    """A row for each error code of each row: row checks, a reference check and a set check."""
    good = read(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("known"))
    o = read(spark, d, "orders").join(good, "o_custkey", "left").withColumn("day", F.to_date("o_orderdate"))
    twice = o.groupBy("o_custkey", "day").count().where("count > 1").select("o_custkey", "day", F.lit(True).alias("dup"))
    o = o.join(twice, ["o_custkey", "day"], "left")
    checks = {
        "bad_total": F.col("o_totalprice") < 20000, "bad_status": ~F.col("o_orderstatus").isin("O", "F"), "orphan": F.col("known").isNull(),
        "weekend_urgent": (F.weekday("o_orderdate") >= 5) & F.col("o_orderpriority").startswith("1"), "duplicate": F.col("dup").isNotNull(),
    }
    return q.error_codes(o, checks).select("o_orderkey", "code")


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(('0x' || substr(md5(concat_ws('|', event_id, user_id, props)), 1, 8)) AS BIGINT)) % 1000000007 AS BIGINT) AS digest FROM events GROUP BY event_type")
def content_hash(spark, d):
    """An order-free digest of each part of a table: the sum of row hashes."""
    return q.digest(read(spark, d, "events"), ["event_type"], ["event_id", "user_id", "props"])


@query("SELECT user_id, arg_min(event_type, (-n, event_type)) AS mode, CAST(sum(n) AS BIGINT) AS n, CAST(max(n) AS BIGINT) AS most FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY user_id")
def value_counts_mode(spark, d):
    c = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return c.groupBy("user_id").agg(F.min_by("event_type", F.struct(-F.col("n"), "event_type")).alias("mode"), F.sum("n").alias("n"), F.max("n").alias("most"))


@query("SELECT event_type, CAST(t AS INTEGER) AS at_most, count(*) FILTER (WHERE value <= t) AS n, round(avg((value <= t)::INT), 6) AS share FROM events, (VALUES (5), (10), (15), (30), (60)) x(t) GROUP BY 1, 2")
def threshold_ladder(spark, d):
    x = read(spark, d, "events").select("event_type", "value", F.explode(F.array(*map(F.lit, (5, 10, 15, 30, 60)))).alias("at_most"))
    hit = F.col("value") <= F.col("at_most")
    return x.groupBy("event_type", "at_most").agg(F.count_if(hit).alias("n"), r6(F.avg(hit.cast("int"))).alias("share"))


GROUP_SQL = "CASE WHEN isodow(ts) = 7 THEN 'sunday_holiday' WHEN isodow(ts) = 6 THEN 'saturday' ELSE 'weekday' END"


@query(f"""WITH {GRID}, h AS (SELECT lot, {GROUP_SQL} AS day_group, CAST(hour(ts) AS BIGINT) // 6 AS h FROM grid GROUP BY 1, 2, 3 HAVING count(occ) >= 1 AND max(occ) < 98), n AS (SELECT *, h - row_number() OVER (PARTITION BY lot, day_group ORDER BY h) AS k FROM h)
SELECT lot, day_group, string_agg(w, '|' ORDER BY w) AS windows FROM (SELECT lot, day_group, lpad(CAST(min(h) * 6 AS VARCHAR), 2, '0') || ':00-' || lpad(CAST(max(h) * 6 + 6 AS VARCHAR), 2, '0') || ':00' AS w FROM n GROUP BY lot, day_group, k) GROUP BY 1, 2""")
def availability_windows(spark, d):
    """Merged windows of the quarters of a day in which a lot has values and none is nearly full."""
    g = grid(spark, d).groupBy("lot", ft.day_group("ts").alias("day_group"), F.floor(F.hour("ts") / 6).alias("h")).agg(F.count("occ").alias("n"), F.max("occ").alias("most"))
    return q.islands(g.where("n >= 1 AND most < 98"), ["lot", "day_group"], 6)


@query("""WITH x AS (SELECT event_id, value, ts, event_id % 120 - 60 AS days_left, event_id % 9 = 0 AS unknown, event_id % 7 = 0 AS weak, event_id % 200 AS age FROM events)
SELECT event_id, CASE WHEN days_left < 0 THEN 'expired' WHEN days_left <= 30 THEN 'expiring' WHEN unknown THEN 'unknown' WHEN weak THEN 'weak_evidence' WHEN age >= 90 THEN 'stale' END AS reason FROM x WHERE days_left < 0 OR days_left <= 30 OR unknown OR weak OR age >= 90""")
def revalidation_queue(spark, d):
    """The first reason to look at a rule again."""
    left = F.pmod("event_id", F.lit(120)) - 60
    is_ = lambda k: F.pmod("event_id", F.lit(k)) == 0
    reason = F.when(left < 0, "expired").when(left <= 30, "expiring").when(is_(9), "unknown").when(is_(7), "weak_evidence").when(F.pmod("event_id", F.lit(200)) >= 90, "stale")
    return read(spark, d, "events").select("event_id", reason.alias("reason")).where("reason IS NOT NULL")


@query(f"""WITH {OBS}, g AS (SELECT lot, ts, park, cells, lag(park) OVER (PARTITION BY lot ORDER BY ts, event_id) AS pp FROM obs),
s AS (SELECT lot, count(*) AS n, avg((park > cells)::INT) AS over_share, avg((abs(park - pp) > 150)::INT) AS jump_share, max(park) - min(park) AS span FROM g GROUP BY lot)
SELECT lot, CASE WHEN n < 50 THEN 'pending' WHEN over_share > 0.2 THEN 'over_capacity' WHEN coalesce(jump_share, 0) > 0.1 THEN 'jumps' WHEN span < 1 THEN 'frozen' ELSE 'available' END AS bucket FROM s""")
def bucket_classifier(spark, d):
    w = Window.partitionBy("lot").orderBy("ts", "event_id")
    g = observations(spark, d).withColumn("pp", F.lag("park").over(w))
    s = g.groupBy("lot").agg(F.count("*").alias("n"), F.avg((F.col("park") > F.col("cells")).cast("int")).alias("over"), F.avg((F.abs(F.col("park") - F.col("pp")) > 150).cast("int")).alias("jump"), (F.max("park") - F.min("park")).alias("span"))
    bucket = F.when(F.col("n") < 50, "pending").when(F.col("over") > 0.2, "over_capacity").when(F.coalesce("jump", F.lit(0)) > 0.1, "jumps").when(F.col("span") < 1, "frozen").otherwise("available")
    return s.select("lot", bucket.alias("bucket"))
