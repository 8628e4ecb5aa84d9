"""As-of, exact-offset, interval, radius and matching joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof, spatial
from ..registry import query
from ..sources.tables import LOTS, OBS, lots, observations, read
from ..streaming.windows import work_folder
from .grids import GRID, grid


def clicks(spark, d):
    e = read(spark, d, "events")
    return e.where("event_type = 'click'").select("user_id", "ts", "event_id"), e.where("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("v"))


L = "l AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'click'), r AS (SELECT user_id, ts, max(value) AS v FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)"
BACK = "b AS (SELECT l.*, r.ts AS bt, r.v AS bv FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts)"
HOURS12 = 12 * 3600


@query(f"WITH {L}, {BACK} SELECT event_id, CASE WHEN epoch_us(ts) - epoch_us(bt) <= {HOURS12}000000 THEN bt END AS r_ts, CASE WHEN epoch_us(ts) - epoch_us(bt) <= {HOURS12}000000 THEN bv END AS v FROM b")
def asof_backward_tol(spark, d):
    left, right = clicks(spark, d)
    return asof.asof_join(left, right, ["user_id"], "v", HOURS12).select("event_id", "r_ts", "v")


@query(f"""WITH {L}, {BACK}, f AS (SELECT b.*, r.ts AS ft, r.v AS fv FROM b ASOF LEFT JOIN r ON b.user_id = r.user_id AND b.ts <= r.ts),
c AS (SELECT event_id, ts, CASE WHEN ft IS NULL OR epoch_us(ts) - epoch_us(bt) <= epoch_us(ft) - epoch_us(ts) THEN bt ELSE ft END AS mt, CASE WHEN ft IS NULL OR epoch_us(ts) - epoch_us(bt) <= epoch_us(ft) - epoch_us(ts) THEN bv ELSE fv END AS mv FROM f)
SELECT event_id, CASE WHEN abs(epoch_us(ts) - epoch_us(mt)) <= {HOURS12}000000 THEN mt END AS r_ts, CASE WHEN abs(epoch_us(ts) - epoch_us(mt)) <= {HOURS12}000000 THEN mv END AS v FROM c""")
def asof_nearest_tol(spark, d):
    left, right = clicks(spark, d)
    return asof.asof_join(left, right, ["user_id"], "v", HOURS12, "nearest").select("event_id", "r_ts", "v")


@query("""WITH h AS (SELECT date_trunc('hour', ts) AS ts, avg(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT e.event_id, h.ts AS r_ts, round(h.v, 6) AS v FROM (SELECT event_id, ts FROM events WHERE event_type = 'error') e ASOF LEFT JOIN h ON h.ts <= e.ts""")
def asof_broadcast(spark, d):
    """An hourly series without a key onto events: the latest hour that has a value, however long ago."""
    e = read(spark, d, "events")
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    series = e.where("event_type = 'view'").groupBy(hour.alias("r_ts")).agg(F.avg("value").alias("v"))
    return asof.asof_series(e.where("event_type = 'error'").select("event_id", "ts"), series).select("event_id", "r_ts", F.round("v", 6).alias("v"))


@query(f"WITH {GRID} SELECT g.lot, g.ts, round(p.occ, 6) AS lag_24h, round(q.occ, 6) AS lag_7d FROM grid g LEFT JOIN grid p ON p.lot = g.lot AND p.ts = g.ts - INTERVAL 24 HOURS LEFT JOIN grid q ON q.lot = g.lot AND q.ts = g.ts - INTERVAL 7 DAYS")
def lag24h_exact(spark, d):
    g = grid(spark, d)
    day = asof.offset_join(g, g, ["lot"], "ts", 1440, "occ", "lag_24h")
    return asof.offset_join(day, g, ["lot"], "ts", 10_080, "occ", "lag_7d").select("lot", "ts", F.round("lag_24h", 6).alias("lag_24h"), F.round("lag_7d", 6).alias("lag_7d"))


@query(f"""WITH {GRID}, p AS (SELECT lot, isodow(ts) AS w, hour(ts) AS h, median(occ) AS m, count(*) AS n FROM grid WHERE occ IS NOT NULL AND ts < TIMESTAMP '2024-01-22' GROUP BY 1, 2, 3)
SELECT g.lot, g.ts, round(CASE WHEN n >= 2 THEN m END, 6) AS seasonal FROM grid g LEFT JOIN p ON p.lot = g.lot AND p.w = isodow(g.ts) AND p.h = hour(g.ts)""")
def seasonal_naive(spark, d):
    """The median of the same weekday and slot before a day; fewer than two values give none."""
    g = grid(spark, d).withColumns({"w": F.weekday("ts"), "h": F.hour("ts")})
    profile = g.where("occ IS NOT NULL AND ts < TIMESTAMP_NTZ'2024-01-22 00:00:00'").groupBy("lot", "w", "h").agg(F.median("occ").alias("m"), F.count("*").alias("n"))
    return g.join(profile, ["lot", "w", "h"], "left").select("lot", "ts", F.round(F.expr("CASE WHEN n >= 2 THEN m END"), 6).alias("seasonal"))


@query(f"WITH {OBS} SELECT lot, ts, event_id, park FROM obs QUALIFY row_number() OVER (PARTITION BY lot ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(spark, d):
    last = observations(spark, d).groupBy("lot").agg(F.max_by(F.struct("ts", "event_id", "park"), F.struct("ts", "event_id")).alias("x"))
    return last.select("lot", "x.*")


@query(f"""WITH {OBS}, rules AS (SELECT * FROM (VALUES (0, 'weekday', DATE '2023-01-01', DATE '2024-01-14', 'a'), (0, 'weekday', DATE '2024-01-15', NULL, 'b'), (0, 'weekend', DATE '2023-01-01', NULL, 'c'),
  (1, 'weekday', DATE '2024-01-10', DATE '2024-01-20', 'd'), (1, 'weekend', DATE '2024-01-01', NULL, 'e'), (2, 'weekday', DATE '2024-01-01', NULL, 'f')) t(k, g, lo, hi, rule))
SELECT o.event_id, r.rule FROM obs o LEFT JOIN rules r ON r.k = o.lot % 4 AND r.g = CASE WHEN isodow(o.ts) >= 6 THEN 'weekend' ELSE 'weekday' END AND CAST(o.ts AS DATE) >= r.lo AND CAST(o.ts AS DATE) <= coalesce(r.hi, DATE '9999-12-31')
QUALIFY row_number() OVER (PARTITION BY o.event_id ORDER BY r.lo) = 1""")
def scd2_lookup(spark, d):
    """The rule of a lot's kind and day group that is in force on a day; the first one if several are."""
    rows = [(0, "weekday", "2023-01-01", "2024-01-14", "a"), (0, "weekday", "2024-01-15", None, "b"), (0, "weekend", "2023-01-01", None, "c"), (1, "weekday", "2024-01-10", "2024-01-20", "d"), (1, "weekend", "2024-01-01", None, "e"), (2, "weekday", "2024-01-01", None, "f")]
    rules = spark.createDataFrame(rows, "k int, g string, lo string, hi string, rule string").selectExpr("k", "g", "date(lo) AS lo", "date(hi) AS hi", "rule")
    # all periods of a key in one row: the join adds no rows, and the choice is made within the row
    periods = rules.groupBy("k", "g").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "rule"))).alias("ps"))
    o = observations(spark, d).select("event_id", F.pmod("lot", F.lit(4)).cast("int").alias("k"), F.when(F.weekday("ts") >= 5, "weekend").otherwise("weekday").alias("g"), F.to_date("ts").alias("day"))
    hit = F.filter("ps", lambda p: (p["lo"] <= F.col("day")) & (F.col("day") <= F.coalesce(p["hi"], F.lit("9999-12-31").cast("date"))))
    return o.join(F.broadcast(periods), ["k", "g"], "left").select("event_id", F.try_element_at(hit, F.lit(1))["rule"].alias("rule"))


NEAR = f"""{LOTS}, dist AS (SELECT a.lot, b.lot AS other, 2 * 6371000.0 * asin(sqrt(least(pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lng) - radians(a.lng)) / 2), 2), 1.0))) AS m,
a.cells AS c1, b.cells AS c2, a.name AS n1, b.name AS n2, b.price AS price FROM lots a, lots b)"""


@query(f"WITH {NEAR} SELECT lot, other, CAST(round_even(m, 0) AS BIGINT) AS metres FROM dist WHERE m <= 3000 AND lot <> other")
def radius_join(spark, d):
    place = lots(spark, d).select("lot", "lat", "lng")
    p = spatial.radius_join(place, place, 3000)
    return p.where("lot <> r_lot").select("lot", F.col("r_lot").alias("other"), F.bround("metres").cast("long").alias("metres"))


@query(f"WITH {NEAR} SELECT lot, arg_min(other, (m, other)) AS other, CAST(round_even(min(m), 0) AS BIGINT) AS metres FROM dist WHERE lot <> other AND m <= 10000 GROUP BY lot")
def nearest_one(spark, d):
    place = lots(spark, d).select("lot", "lat", "lng")
    best = spatial.nearest(place, place, "lot", 10_000, "lot", F.col("lot") != F.col("r_lot"))
    return best.select("lot", "other", F.bround("metres").cast("long").alias("metres"))


@query(f"""WITH {NEAR}, c AS (SELECT lot, count(*) FILTER (WHERE m <= 1000) AS a, count(*) FILTER (WHERE m <= 2000) AS b FROM dist WHERE m <= 3000 AND lot <> other GROUP BY lot),
r AS (SELECT lot, CASE WHEN a >= 2 THEN 1000.0 WHEN b >= 2 THEN 2000.0 ELSE 3000.0 END AS radius FROM c)
SELECT d.lot, d.other, CAST(r.radius AS DOUBLE) AS radius FROM dist d JOIN r USING (lot) WHERE d.lot <> d.other AND d.m <= r.radius""")
def expanding_radius(spark, d):
    place = lots(spark, d).select("lot", "lat", "lng")
    return spatial.expanding(place, place, "lot", [1000, 2000, 3000], 2, F.col("lot") != F.col("r_lot"), work_folder(spark)).select("lot", F.col("r_lot").alias("other"), "radius")


@query(f"WITH {NEAR} SELECT lot, other FROM dist WHERE m <= 3000 AND NOT (c1 = c2 AND (m <= 10 OR (n1 = n2 AND m <= 100)))")
def self_match_antijoin(spark, d):
    """Neighbours that aren't the lot itself: equal cells and at most 10 m apart, or an equal name and at most 100 m."""
    place = lots(spark, d).select("lot", "lat", "lng", "cells", "name")
    p = spatial.radius_join(place, place, 3000)
    own = (F.col("cells") == F.col("r_cells")) & ((F.col("metres") <= 10) | ((F.col("name") == F.col("r_name")) & (F.col("metres") <= 100)))
    return p.where(~own).select("lot", F.col("r_lot").alias("other"))


@query(f"WITH {NEAR} SELECT lot, arg_min(other, (m, other)) AS other FROM dist WHERE lot <> other AND m <= 3000 AND c2 * 1.0 / c1 BETWEEN 0.8 AND 1.25 GROUP BY lot")
def tolerance_match(spark, d):
    """The nearest other lot within 3 km of a like capacity."""
    place = lots(spark, d).select("lot", "lat", "lng", "cells")
    like = (F.col("lot") != F.col("r_lot")) & (F.col("r_cells") / F.col("cells")).between(0.8, 1.25)
    return spatial.nearest(place, place, "lot", 3000, "lot", like).select("lot", "other")


@query("""WITH a AS (SELECT c_custkey AS k, 'N' || c_custkey % 211 AS address, replace(c_name, 'Customer', 'X') AS name, c_nationkey AS dong FROM customer),
b AS (SELECT s_suppkey AS j, 'N' || s_suppkey * 7 % 211 AS address, replace(replace(s_name, 'Supplier', 'X'), '000000', '00000') AS name, s_nationkey AS dong FROM supplier),
m1 AS (SELECT k, min(j) AS j, count(*) AS n FROM a JOIN b USING (address) GROUP BY k),
m2 AS (SELECT a.k, min(b.j) AS j, count(*) AS n FROM a JOIN b ON a.name = b.name WHERE a.k NOT IN (SELECT k FROM m1) GROUP BY a.k),
m3 AS (SELECT a.k, min(b.j) AS j, count(*) AS n FROM a JOIN b ON a.dong = b.dong AND right(a.name, 2) = right(b.name, 2) WHERE a.k NOT IN (SELECT k FROM m1) AND a.k NOT IN (SELECT k FROM m2) GROUP BY a.k)
SELECT k, stage, CASE WHEN n = 1 THEN j END AS j, n > 1 AS ambiguous FROM (SELECT *, 1 AS stage FROM m1 UNION ALL SELECT *, 2 FROM m2 UNION ALL SELECT *, 3 FROM m3)""")
def entity_stage_match(spark, d):
    """Address, then name, then area with a like name; a stage with several matches is ambiguous and later stages skip the row."""
    a = read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.expr("concat('N', c_custkey % 211)").alias("address"), F.expr("replace(c_name, 'Customer', 'X')").alias("name"), F.col("c_nationkey").alias("dong"), F.expr("right(c_name, 2)").alias("tail"))
    b = read(spark, d, "supplier").select(F.col("s_suppkey").alias("j"), F.expr("concat('N', s_suppkey * 7 % 211)").alias("address"), F.expr("replace(replace(s_name, 'Supplier', 'X'), '000000', '00000')").alias("name"), F.col("s_nationkey").alias("dong"), F.expr("right(s_name, 2)").alias("tail"))
    rest, out = a, None
    for stage, keys in enumerate((["address"], ["name"], ["dong", "tail"]), 1):
        hit = rest.select("k", *keys).join(b.select("j", *keys), keys).groupBy("k").agg(F.min("j").alias("j"), F.count("*").alias("n"))
        one = hit.select("k", F.lit(stage).alias("stage"), F.expr("CASE WHEN n = 1 THEN j END").alias("j"), (F.col("n") > 1).alias("ambiguous"))
        out = one if out is None else out.union(one)
        rest = rest.join(hit.select("k"), "k", "left_anti")
    return out


@query("""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), u AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e),
m AS (SELECT label, i, avg(x) AS m FROM u GROUP BY 1, 2), p AS (SELECT label, list(m ORDER BY i) AS m FROM m GROUP BY 1),
d AS (SELECT p.label AS profile, round(list_distance(e.v, p.m), 4) AS dist, e.vec_id FROM e JOIN p ON e.label <> p.label)
SELECT profile, dist, vec_id FROM d QUALIFY row_number() OVER (PARTITION BY profile ORDER BY dist, vec_id) = 1""")
def pairwise_distance(spark, d):
    """The nearest vector of another label for each label's mean profile: few profiles against all vectors."""
    e = read(spark, d, "embeddings").select("vec_id", "label", F.expr("transform(embedding, x -> double(x))").alias("v"))
    means = e.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("m"))
    profiles = means.groupBy().agg(F.collect_list(F.struct("label", "m")).alias("ps")).withColumn("k", F.lit(1))  # one profile a label
    near = e.withColumn("k", F.lit(1)).join(F.broadcast(profiles), "k").select("vec_id", "label", "v", F.explode("ps").alias("p"))
    dist = F.sqrt(F.aggregate(F.zip_with("v", "p.m", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    return near.where("label <> p.label").groupBy(F.col("p.label").alias("profile")).agg(F.min(F.struct(F.round(dist, 4).alias("dist"), "vec_id")).alias("b")).select("profile", "b.*")


@query(f"""WITH {GRID}, a AS (SELECT lot, ts, occ FROM grid WHERE occ IS NOT NULL), b AS (SELECT lot, ts, occ + 1 AS occ FROM grid WHERE occ IS NOT NULL AND hour(ts) <> 6 UNION ALL SELECT lot, ts + INTERVAL 365 DAYS, occ FROM grid WHERE occ IS NOT NULL AND hour(ts) = 6)
SELECT CASE WHEN a.lot IS NULL THEN 'only_new' WHEN b.lot IS NULL THEN 'only_old' WHEN abs(a.occ - b.occ) < 0.5 THEN 'agree' ELSE 'conflict' END AS status, count(*) AS n FROM a FULL JOIN b ON a.lot = b.lot AND a.ts = b.ts GROUP BY 1""")
def reconcile_full(spark, d):
    """Two versions of a table, key by key."""
    g = grid(spark, d).where("occ IS NOT NULL")
    new = g.where(F.hour("ts") != 6).withColumn("occ", F.col("occ") + 1).union(g.where(F.hour("ts") == 6).withColumn("ts", F.expr("ts + INTERVAL 365 DAYS")))
    both = g.join(new.select("lot", "ts", F.col("occ").alias("o2"), F.lit(1).alias("new")), ["lot", "ts"], "full")
    status = F.when(F.col("occ").isNull(), "only_new").when(F.col("new").isNull(), "only_old").when(F.abs(F.col("occ") - F.col("o2")) < 0.5, "agree").otherwise("conflict")
    return both.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("SELECT n.n_nationkey, n.n_name, EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = n.n_nationkey AND s.s_acctbal > 9000) AS has_rich, NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = n.n_nationkey AND c.c_mktsegment = 'MACHINERY' AND c.c_acctbal < -900) AS no_poor FROM nation n")
def semi_anti_join(spark, d):
    n = read(spark, d, "nation").select("n_nationkey", "n_name")
    rich = read(spark, d, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("n_nationkey")).distinct().withColumn("a", F.lit(True))
    poor = read(spark, d, "customer").where("c_mktsegment = 'MACHINERY' AND c_acctbal < -900").select(F.col("c_nationkey").alias("n_nationkey")).distinct().withColumn("b", F.lit(True))
    return n.join(rich, "n_nationkey", "left").join(poor, "n_nationkey", "left").select("n_nationkey", "n_name", F.col("a").isNotNull().alias("has_rich"), F.col("b").isNull().alias("no_poor"))


@query(f"""WITH {LOTS} SELECT lot, round(round_even(lat / (100.0 / 111000), 0) * (100.0 / 111000), 6) AS y,
round(round_even(lng / (100.0 / (111000 * cos(radians(round_even(lat / (100.0 / 111000), 0) * (100.0 / 111000))))), 0) * (100.0 / (111000 * cos(radians(round_even(lat / (100.0 / 111000), 0) * (100.0 / 111000))))), 6) AS x FROM lots""")
def grid_snap(spark, d):
    l_ = lots(spark, d)
    y, x = spatial.snapped(F.col("lat"), F.col("lng"))
    return l_.select("lot", F.round(y, 6).alias("y"), F.round(x, 6).alias("x"))


@query("""WITH a AS (SELECT c_custkey AS q, c_custkey % 90 AS lot, TIMESTAMP '2024-01-02 00:00:00' + (c_custkey * 977 % 38000) * INTERVAL 1 MINUTE AS target, CASE c_custkey % 3 WHEN 0 THEN 60 WHEN 1 THEN 120 ELSE 360 END AS horizon FROM customer),
b AS (SELECT *, target - horizon * INTERVAL 1 MINUTE AS base FROM a), h AS (SELECT user_id AS lot, ts, max(CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END) AS v FROM events GROUP BY 1, 2),
m AS (SELECT q, arg_max({'t': h.ts, 'v': h.v}, h.ts) AS x FROM b JOIN h ON h.lot = b.lot AND h.ts <= b.base AND h.ts >= b.base - INTERVAL 3 HOURS GROUP BY q)
SELECT b.q, b.lot, b.target, b.horizon, CASE WHEN x.v IS NOT NULL THEN x.t END AS r_ts, x.v AS known FROM b LEFT JOIN m ON m.q = b.q""")
def point_asof(spark, d):
    """What was known of a lot at a request's target less its horizon; a stale or missing latest value is null, an older one doesn't stand in for it."""
    k = F.col("c_custkey")
    asked = read(spark, d, "customer").select(
        k.alias("q"), (k % 90).alias("lot"), F.timestamp_add("MINUTE", (k * 977 % 38000).cast("int"), F.expr("TIMESTAMP_NTZ'2024-01-02 00:00:00'")).alias("target"), F.expr("CASE c_custkey % 3 WHEN 0 THEN 60 WHEN 1 THEN 120 ELSE 360 END").alias("horizon"),
    )
    history = read(spark, d, "events").select(F.col("user_id").alias("lot"), "ts", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("known"))
    return asof.point_lookup(asked, history, ["lot"], "known", 3 * 3600)


@query("""WITH t AS (SELECT TIMESTAMP '2024-01-01 12:00:00' + k * INTERVAL 30 HOURS AS moment FROM range(20) r(k)), a AS (SELECT DISTINCT user_id AS lot, moment FROM events, t),
x AS (SELECT a.lot, a.moment, e.ts, e.value, e.event_type, abs(epoch_us(e.ts) - epoch_us(a.moment)) AS away FROM a JOIN events e ON e.user_id = a.lot AND abs(epoch_us(e.ts) - epoch_us(a.moment)) <= 14400000000),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lot, moment ORDER BY away, ts, value DESC, event_type DESC) = 1)
SELECT a.lot, a.moment, b.ts AS r_ts, b.value, b.event_type, b.away / 1000000.0 AS seconds FROM a LEFT JOIN b ON b.lot = a.lot AND b.moment = a.moment""")
def nearest_in_window(spark, d):
    """All lots as they were at twenty moments: the nearest row of each within four hours of each moment."""
    times = spark.range(20).select(F.timestamp_add("HOUR", (F.col("id") * 30).cast("int"), F.expr("TIMESTAMP_NTZ'2024-01-01 12:00:00'")).alias("moment"))
    e = read(spark, d, "events").withColumnRenamed("user_id", "lot")
    asked = e.select("lot").distinct().crossJoin(F.broadcast(times))  # twenty moments
    return asof.nearest_in_window(asked, e, ["lot"], ["value", "event_type"], 4 * 3600, "moment")


@query("""WITH o AS (SELECT o_orderkey AS k, replace(lower('Customer  ' || o_custkey), ' ', '') AS name, CAST(o_orderdate AS TIMESTAMP) AS at FROM orders), s AS (SELECT replace(lower('CUSTOMER ' || o_custkey), ' ', '') AS name, CAST(l_shipdate AS TIMESTAMP) AS ts, max(l_extendedprice) AS price FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' GROUP BY ALL),
x AS (SELECT o.k, s.ts, s.price FROM o JOIN s ON s.name = o.name AND abs(epoch_us(s.ts) - epoch_us(o.at)) <= 864000000000 QUALIFY row_number() OVER (PARTITION BY o.k ORDER BY abs(epoch_us(s.ts) - epoch_us(o.at)), s.ts) = 1)
SELECT o.k, o.name, x.ts AS r_ts, x.price FROM o LEFT JOIN x ON x.k = o.k""")
def cross_source_nearest(spark, d):
    """Two sources that write names differently: joined by the normalised name, and in it to the nearest row within ten days."""
    plain = lambda c: F.regexp_replace(F.lower(c), r"\s", "")
    orders = read(spark, d, "orders")
    asked = orders.select(F.col("o_orderkey").alias("k"), plain(F.concat(F.lit("Customer  "), F.col("o_custkey").cast("string"))).alias("name"), F.col("o_orderdate").cast("timestamp_ntz").alias("at"))
    lines = read(spark, d, "lineitem").where("l_returnflag = 'R'").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    other = lines.select(plain(F.concat(F.lit("CUSTOMER "), F.col("o_custkey").cast("string"))).alias("name"), F.col("l_shipdate").cast("timestamp_ntz").alias("ts"), F.col("l_extendedprice").alias("price"))
    return asof.nearest_in_window(asked, other, ["name"], ["price"], 10 * 86400).select("k", "name", "r_ts", "price")
