"""Row selections: exclusions with reasons, folds, segments, boxes, rule updates, guards and seeded samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import LOTS, lots, read
from .evaluation import PAIRS, pairs, r6
from .grids import GRID, grid


@query(f"""WITH {GRID}, s AS (SELECT lot, count(occ) AS n, count(DISTINCT CASE WHEN occ IS NOT NULL THEN hour(ts) END) AS hours, max(occ) - min(occ) AS span FROM grid GROUP BY lot)
SELECT lot, n, hours, concat_ws('·', CASE WHEN n < 90 THEN 'few_rows' END, CASE WHEN hours < 4 THEN 'few_hours' END, CASE WHEN coalesce(span, 0) < 60 THEN 'flat' END) AS reasons FROM s""")
def thin_lots(spark, d):
    """Lots with too little to judge, with all their reasons in one string; an empty one keeps the lot."""
    g = grid(spark, d).withColumn("h", F.when(F.col("occ").isNotNull(), F.hour("ts")))
    s = g.groupBy("lot").agg(F.count("occ").alias("n"), F.countDistinct("h").alias("hours"), (F.max("occ") - F.min("occ")).alias("span"))
    checks = {"few_rows": F.col("n") < 90, "few_hours": F.col("hours") < 4, "flat": F.coalesce("span", F.lit(0)) < 60}
    return s.select("lot", "n", "hours", F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()])), "·").alias("reasons"))


@query("SELECT event_type, count(*) FILTER (WHERE ts <= TIMESTAMP '2024-01-20') AS kept, count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-20') AS dropped FROM events GROUP BY 1")
def truncate_end(spark, d):
    """Rows up to the end of the data and how many lie beyond it; nothing left is an error."""
    inside = F.col("ts") <= F.expr("TIMESTAMP_NTZ'2024-01-20 00:00:00'")
    g = read(spark, d, "events").groupBy("event_type").agg(F.count_if(inside).alias("kept"), F.count_if(~inside).alias("dropped"))
    return g.where(F.when(F.col("kept") > 0, True).otherwise(F.raise_error(F.concat(F.lit("no rows are left of "), "event_type"))))


FOLD_DAYS = range(22, 28)


@query(f"""WITH {PAIRS}, f AS (SELECT unnest(range(22, 28)) AS i), x AS (SELECT f.i AS fold, horizon, CASE WHEN CAST(ts AS DATE) < DATE '2024-01-01' + CAST(i AS INTEGER) AND CAST(target_time AS DATE) < DATE '2024-01-01' + CAST(i AS INTEGER) THEN 'train' WHEN CAST(ts AS DATE) = DATE '2024-01-01' + CAST(i AS INTEGER) AND CAST(target_time AS DATE) = DATE '2024-01-01' + CAST(i AS INTEGER) THEN 'test' END AS role FROM pairs, f WHERE actual IS NOT NULL)
SELECT fold, horizon, role, count(*) AS n FROM x WHERE role IS NOT NULL GROUP BY ALL""")
def expanding_folds(spark, d):
    """Folds that train on all days before one and test on that day; a row counts only if its label lies on the same side."""
    start = F.to_date(F.lit("2024-01-01"))
    p = pairs(spark, d).where("actual IS NOT NULL").withColumn("fold", F.explode(F.array(*[F.lit(i).cast("long") for i in FOLD_DAYS])))
    day, seen, label = F.date_add(start, F.col("fold").cast("int")), F.to_date("ts"), F.to_date("target_time")
    role = F.when((seen < day) & (label < day), "train").when((seen == day) & (label == day), "test")
    return p.withColumn("role", role).where("role IS NOT NULL").groupBy("fold", "horizon", "role").agg(F.count("*").alias("n"))


@query(f"""WITH {PAIRS}, x AS (SELECT *, hour(target_time) BETWEEN 6 AND 18 AS op, isodow(target_time) >= 6 AS we, abs(occ_now - actual) AS e FROM pairs WHERE actual IS NOT NULL AND occ_now IS NOT NULL),
s AS (SELECT horizon, e, unnest(list_filter(['all', CASE WHEN op THEN 'operating' ELSE 'outside' END, CASE WHEN we THEN 'weekend' ELSE 'weekday' END, CASE WHEN we THEN 'weekend' ELSE 'weekday' END || '_' || CASE WHEN op THEN 'operating' ELSE 'outside' END], lambda v: v IS NOT NULL)) AS segment FROM x)
SELECT horizon, segment, count(*) AS n, round(avg(e), 6) AS mae FROM s GROUP BY 1, 2""")
def segment_masks(spark, d):
    """Errors in nine overlapping segments: all, operating or not, weekday or weekend, and their crosses."""
    p = pairs(spark, d).where("actual IS NOT NULL AND occ_now IS NOT NULL")
    op = F.when(F.hour("target_time").between(6, 18), "operating").otherwise("outside")
    we = F.when(F.weekday("target_time") >= 5, "weekend").otherwise("weekday")
    x = p.select("horizon", F.abs(F.col("occ_now") - F.col("actual")).alias("e"), F.explode(F.array(F.lit("all"), op, we, F.concat_ws("_", we, op))).alias("segment"))
    return x.groupBy("horizon", "segment").agg(F.count("*").alias("n"), r6(F.avg("e")).alias("mae"))


@query(f"""WITH {LOTS} SELECT lot, round(sqrt(pow((lat - 37.4) * 111000, 2) + pow((lng - 127.0) * 88000, 2)), 4) AS metres FROM lots WHERE lat BETWEEN 37.4 - 9000 / 111000.0 AND 37.4 + 9000 / 111000.0 AND lng BETWEEN 127.0 - 9000 / 88000.0 AND 127.0 + 9000 / 88000.0""")
def bounding_box(spark, d):
    """Lots in the box around a point, with the planar distance."""
    dy, dx = 9000 / 111000.0, 9000 / 88000.0
    box = F.col("lat").between(37.4 - dy, 37.4 + dy) & F.col("lng").between(127.0 - dx, 127.0 + dx)
    return lots(spark, d).where(box).select("lot", F.round(F.hypot((F.col("lat") - 37.4) * 111000, (F.col("lng") - 127.0) * 88000), 4).alias("metres"))


RULE_SQL = "r AS (SELECT l_orderkey AS line, CASE WHEN l_linenumber = 7 THEN 'x' || l_suppkey ELSE CAST(l_suppkey + CASE WHEN l_linenumber = 6 THEN 1000000 ELSE 0 END AS VARCHAR) END AS id, 'Supplier # ' || lpad(CAST(l_suppkey + CASE WHEN l_linenumber = 5 THEN 1 ELSE 0 END AS VARCHAR), 9, '0') AS name FROM lineitem)"


@query(f"""WITH {RULE_SQL}, c AS (SELECT r.*, s.s_suppkey IS NOT NULL AS known, regexp_replace(r.name, '\\s', '', 'g') = regexp_replace(s.s_name, '\\s', '', 'g') AS same, TRY_CAST(r.id AS BIGINT) IS NULL AS bad FROM r LEFT JOIN supplier s ON s.s_suppkey = TRY_CAST(r.id AS BIGINT))
SELECT CASE WHEN bad THEN 'not_integer' WHEN NOT known THEN 'unknown_id' WHEN NOT same THEN 'other_name' ELSE 'ok' END AS verdict, count(*) AS n, count(DISTINCT id) AS ids FROM c GROUP BY 1""")
def rule_ids(spark, d):
    """Rules whose id is no integer, unknown, or belongs to another name, compared without blanks."""
    n, k = F.col("l_linenumber"), F.col("l_suppkey")
    id_ = F.when(n == 7, F.concat(F.lit("x"), k.cast("string"))).otherwise((k + F.when(n == 6, 1_000_000).otherwise(0)).cast("string"))
    r = read(spark, d, "lineitem").select(id_.alias("id"), F.concat(F.lit("Supplier # "), F.lpad((k + F.when(n == 5, 1).otherwise(0)).cast("string"), 9, "0")).alias("name"))
    s = read(spark, d, "supplier").select("s_suppkey", "s_name")
    x = r.withColumn("key", F.col("id").try_cast("long")).join(s, F.col("key") == F.col("s_suppkey"), "left")
    bare = lambda c: F.regexp_replace(c, r"\s", "")
    verdict = F.when(F.col("key").isNull(), "not_integer").when(F.col("s_suppkey").isNull(), "unknown_id").when(bare("name") != bare("s_name"), "other_name").otherwise("ok")
    return x.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND c.c_acctbal > 5000 THEN c.c_mktsegment ELSE o_orderpriority END AS schedule FROM orders LEFT JOIN customer c ON c.c_custkey = o_custkey")
def conditional_update(spark, d):
    """New values where the rule says so and there is one; all others keep theirs."""
    c = read(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    o = read(spark, d, "orders").join(c, "o_custkey", "left")
    return o.select("o_orderkey", F.when((F.col("o_orderstatus") == "O") & F.col("c_mktsegment").isNotNull(), F.col("c_mktsegment")).otherwise(F.col("o_orderpriority")).alias("schedule"))


@query("SELECT event_type, count(*) AS n, round(avg(ln(value + 1)), 6) AS mean_log FROM events GROUP BY 1")
def finite_guard(spark, d):
    """A mean that fails on a value that isn't finite, instead of dropping it."""
    x = F.log1p("value")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    g = read(spark, d, "events").withColumn("x", F.when(finite, x).otherwise(F.raise_error(F.lit("a value is not finite")).cast("double")))
    return g.groupBy("event_type").agg(F.count("*").alias("n"), r6(F.avg("x")).alias("mean_log"))


@query(f"""WITH {PAIRS}, x AS (SELECT horizon, CASE WHEN target_time < TIMESTAMP '2024-01-17' THEN 'train' WHEN ts >= TIMESTAMP '2024-01-17' AND target_time < TIMESTAMP '2024-01-24' THEN 'cal' WHEN ts >= TIMESTAMP '2024-01-24' THEN 'test' END AS part, ts, target_time FROM pairs WHERE actual IS NOT NULL),
m AS (SELECT horizon, max(target_time) FILTER (WHERE part = 'train') AS a, min(ts) FILTER (WHERE part = 'cal') AS b, max(target_time) FILTER (WHERE part = 'cal') AS c, min(ts) FILTER (WHERE part = 'test') AS d, count(*) FILTER (WHERE part IS NULL) AS purged FROM x GROUP BY 1)
SELECT horizon, a < b AS train_before_cal, c < d AS cal_before_test, purged FROM m""")
def leak_audit(spark, d):
    """No label of a part may lie in the next one; rows across a border belong to none."""
    at = lambda s: F.expr(f"TIMESTAMP_NTZ'{s} 00:00:00'")
    part = F.when(F.col("target_time") < at("2024-01-17"), "train").when((F.col("ts") >= at("2024-01-17")) & (F.col("target_time") < at("2024-01-24")), "cal").when(F.col("ts") >= at("2024-01-24"), "test")
    p = pairs(spark, d).where("actual IS NOT NULL").withColumn("part", part)
    of = lambda f, c, k: f(F.when(F.col("part") == k, F.col(c)))
    return p.groupBy("horizon").agg(
        (of(F.max, "target_time", "train") < of(F.min, "ts", "cal")).alias("train_before_cal"), (of(F.max, "target_time", "cal") < of(F.min, "ts", "test")).alias("cal_before_test"), F.count_if(F.col("part").isNull()).alias("purged"),
    )


@query("SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY md5(event_id || '/42'), event_id) <= 20")
def seeded_sample(spark, d):
    """Twenty rows of each kind without replacement, by the order of a seeded hash: the same at any partitioning. Parts are cut first, so a large kind isn't one task's."""
    from pyspark.sql import Window

    mark = F.md5(F.concat(F.col("event_id").cast("string"), F.lit("/42")).cast("binary"))
    e = read(spark, d, "events").select("event_type", "event_id", mark.alias("mark")).withColumn("part", F.substring("mark", 1, 1))
    nth = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("mark", "event_id"))
    few = e.withColumn("i", nth("event_type", "part")).where("i <= 20")
    return few.withColumn("i", nth("event_type")).where("i <= 20").select("event_type", "event_id")


@query(f"""WITH {LOTS}, x AS (SELECT lot, CASE WHEN price < 0 THEN 'excluded' WHEN lot % 6 = 0 THEN 'unavailable' ELSE 'live' END AS side FROM lots) SELECT side, lot FROM x""")
def partition_split(spark, d):
    """Lots split by predicates that exclude each other; no lot is lost and none is in two parts."""
    x = lots(spark, d)
    excluded, gone = F.col("price") < 0, F.pmod("lot", F.lit(6)) == 0
    part = lambda name, c: x.where(c).select(F.lit(name).alias("side"), "lot")
    return part("excluded", excluded).union(part("unavailable", ~excluded & gone)).union(part("live", ~excluded & ~gone))


@query(f"""WITH {LOTS} SELECT lot, row_number() OVER (ORDER BY CASE grade WHEN 3 THEN 0 WHEN 1 THEN 1 WHEN 5 THEN 2 ELSE 999 END, cells DESC, lot) AS place FROM lots QUALIFY place <= 40""")
def custom_priority(spark, d):
    """The first by an explicit order of grades, others after them, then by size and id."""
    from pyspark.sql import Window

    order = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in ((3, 0), (1, 1), (5, 2)) for x in pair]), F.col("grade")), F.lit(999))
    top = lots(spark, d).withColumn("o", order).orderBy("o", F.desc("cells"), "lot").limit(40)
    return top.select("lot", F.row_number().over(Window.orderBy("o", F.desc("cells"), "lot")).alias("place"))
