"""Forecast evaluation: pairs, baselines, folds, scores, certification."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import calibration as cal
from ..operators import evaluation as ev
from ..registry import query
from .grids import GRID, grid

HORIZONS = [360, 720, 1440]
METHODS = ["persistence", "lag_24h", "lag_7d"]
#: SQL of with_baselines over GRID: the table ``pairs``.
PAIRS = f"""{GRID}, pairs AS (SELECT g.lot, g.ts, h.h AS horizon, g.ts + h.h * INTERVAL 1 MINUTE AS target_time, g.occ AS occ_now, a.occ AS actual, g.occ AS persistence, d.occ AS lag_24h, w.occ AS lag_7d
FROM grid g CROSS JOIN (VALUES (360), (720), (1440)) h(h) LEFT JOIN grid a ON a.lot = g.lot AND a.ts = g.ts + h.h * INTERVAL 1 MINUTE
LEFT JOIN grid d ON d.lot = g.lot AND d.ts = g.ts + h.h * INTERVAL 1 MINUTE - INTERVAL 24 HOURS LEFT JOIN grid w ON w.lot = g.lot AND w.ts = g.ts + h.h * INTERVAL 1 MINUTE - INTERVAL 7 DAYS)"""
LONG = "long AS (SELECT *, unnest([{{'m': 'persistence', 'i': 0, 'p': persistence}}, {{'m': 'lag_24h', 'i': 1, 'p': lag_24h}}, {{'m': 'lag_7d', 'i': 2, 'p': lag_7d}}]) AS x FROM {src})"
CORE = "actual IS NOT NULL AND persistence IS NOT NULL AND lag_24h IS NOT NULL"
DAY = "CASE WHEN isodow(target_time) >= 6 THEN 'weekend' ELSE 'weekday' END"
r6 = lambda c: F.round(c, 6)


def pairs(spark, d):
    g = grid(spark, d)
    return ev.with_baselines(ev.horizon_frame(g, HORIZONS), g)


def weekpart(c="target_time"):
    return F.when(F.weekday(c) >= 5, "weekend").otherwise("weekday")


@query(f"WITH {PAIRS} SELECT horizon, count(*) AS n, round(avg(abs(actual - occ_now)), 6) AS mae, round(sqrt(avg(pow(actual - occ_now, 2))), 6) AS rmse, round(quantile_cont(abs(actual - occ_now), 0.5), 6) AS p50, round(quantile_cont(abs(actual - occ_now), 0.9), 6) AS p90 FROM pairs WHERE actual IS NOT NULL AND occ_now IS NOT NULL GROUP BY horizon")
def persistence_error(spark, d):
    """The flagship: errors of the last value as a forecast, by horizon."""
    g = grid(spark, d)
    e = ev.horizon_frame(g, HORIZONS).where("actual IS NOT NULL AND occ_now IS NOT NULL").withColumn("e", ev.errors("occ_now"))
    counted = ev.counts_of(e, ["horizon"], "e")
    n = F.sum("c")
    sums = counted.groupBy("horizon").agg(n.alias("n"), r6(F.sum(F.col("c") * F.col("e")) / n).alias("mae"), r6(F.sqrt(F.sum(F.col("c") * F.col("e") * F.col("e")) / n)).alias("rmse"))
    return sums.join(ev.quantiles_of(counted, ["horizon"], "e", {"p50": 0.5, "p90": 0.9}).select("horizon", r6("p50").alias("p50"), r6("p90").alias("p90")), "horizon")


@query(f"WITH {PAIRS} SELECT horizon, count(*) AS grid_n, count(actual) AS eligible, count(persistence) AS n_persistence, count(lag_24h) AS n_lag_24h, count(lag_7d) AS n_lag_7d, count(*) FILTER (WHERE {CORE}) AS core, count(*) FILTER (WHERE {CORE} AND lag_7d IS NOT NULL) AS all_rows, round(count(*) FILTER (WHERE {CORE}) / nullif(count(actual), 0), 6) AS core_rate FROM pairs GROUP BY horizon")
def common_rows(spark, d):
    core = ev.complete(["actual", "persistence", "lag_24h"])
    return pairs(spark, d).groupBy("horizon").agg(
        F.count("*").alias("grid_n"), F.count("actual").alias("eligible"), *[F.count(m).alias(f"n_{m}") for m in METHODS], F.count_if(core).alias("core"),
        F.count_if(core & F.col("lag_7d").isNotNull()).alias("all_rows"), r6(F.try_divide(F.count_if(core), F.count("actual"))).alias("core_rate"),
    )


@query(f"WITH {PAIRS}, {LONG.format(src='pairs')} SELECT horizon, x.m AS method, count(x.p - actual) AS n, round(avg(abs(x.p - actual)), 6) AS mae, round(sqrt(avg(pow(x.p - actual, 2))), 6) AS rmse FROM long WHERE {CORE} GROUP BY 1, 2")
def method_scores(spark, d):
    s = ev.long_scores(pairs(spark, d).where(ev.complete(["actual", "persistence", "lag_24h"])), METHODS, ["horizon"])
    return s.select("horizon", "method", "n", r6("mae").alias("mae"), r6("rmse").alias("rmse"))


@query(f"WITH {PAIRS}, {LONG.format(src='pairs')}, s AS (SELECT horizon, x.m AS method, x.i AS i, avg(abs(x.p - actual)) AS mae FROM long WHERE {CORE} GROUP BY 1, 2, 3) SELECT horizon, method, round(mae, 6) AS mae FROM s WHERE mae IS NOT NULL QUALIFY row_number() OVER (PARTITION BY horizon ORDER BY mae, i) = 1")
def strongest_baseline(spark, d):
    s = ev.long_scores(pairs(spark, d).where(ev.complete(["actual", "persistence", "lag_24h"])), METHODS, ["horizon"])
    return ev.strongest(s, ["horizon"]).withColumn("mae", r6("mae"))


@query(f"""WITH {PAIRS}, p AS (SELECT CAST(horizon AS VARCHAR) AS h, CAST(lot % 3 AS VARCHAR) AS access, {DAY} AS day, abs(persistence - actual) AS a, abs(lag_24h - actual) AS b FROM pairs WHERE {CORE}),
c AS (SELECT coalesce(h, 'all') AS h, coalesce(access, 'all') AS access, coalesce(day, 'all') AS day, count(*) AS n, avg(a) AS base, avg(b) AS model FROM p GROUP BY CUBE (h, access, day)),
cells AS (SELECT * FROM (VALUES ('all'), ('360'), ('720'), ('1440')) h(h), (VALUES ('all'), ('0'), ('1'), ('2'), ('9')) a(access), (VALUES ('all'), ('weekday'), ('weekend')) d(day))
SELECT h, access, day, coalesce(n, 0) AS n, round(base, 6) AS base, round(model, 6) AS model, round(base - model, 6) AS gain, CASE WHEN coalesce(n, 0) = 0 THEN 'unavailable' WHEN abs(base - model) < 1e-12 THEN 'tie' WHEN base > model THEN 'better' ELSE 'worse' END AS status FROM cells LEFT JOIN c USING (h, access, day)""")
def score_cube_margins(spark, d):
    p = pairs(spark, d).where(ev.complete(["actual", "persistence", "lag_24h"])).select(F.col("horizon").cast("string").alias("h"), F.pmod("lot", F.lit(3)).cast("string").alias("access"), weekpart().alias("day"), ev.errors("persistence").alias("a"), ev.errors("lag_24h").alias("b"))
    cells = spark.createDataFrame([(h, a, w) for h in ("all", "360", "720", "1440") for a in ("all", "0", "1", "2", "9") for w in ("all", "weekday", "weekend")], "h string, access string, day string")
    c = ev.with_margins(p, ["h", "access", "day"], F.broadcast(cells), [F.count("*").alias("n"), F.avg("a").alias("base"), F.avg("b").alias("model")])
    gain = F.col("base") - F.col("model")
    status = F.when(F.coalesce("n", F.lit(0)) == 0, "unavailable").when(F.abs(gain) < 1e-12, "tie").when(gain > 0, "better").otherwise("worse")
    return c.select("h", "access", "day", F.coalesce("n", F.lit(0)).alias("n"), r6("base").alias("base"), r6("model").alias("model"), r6(gain).alias("gain"), status.alias("status"))


@query(f"WITH {PAIRS} SELECT horizon, lot, count(*) AS n, round(avg(abs(lag_24h - actual)), 6) AS mae, count(*) >= 5 AS evaluable, count(*) >= 5 AND avg(abs(lag_24h - actual)) <= 25 AS passes FROM pairs WHERE {CORE} GROUP BY 1, 2")
def per_lot_pass(spark, d):
    p = pairs(spark, d).where(ev.complete(["actual", "persistence", "lag_24h"])).groupBy("horizon", "lot").agg(F.count("*").alias("n"), F.avg(ev.errors("lag_24h")).alias("m"))
    return p.select("horizon", "lot", "n", r6("m").alias("mae"), (F.col("n") >= 5).alias("evaluable"), ((F.col("n") >= 5) & (F.col("m") <= 25)).alias("passes"))


@query(f"WITH {PAIRS} SELECT horizon, CAST(CAST(target_time AS DATE) AS VARCHAR) AS day, count(*) AS n, avg(abs(lag_24h - actual)) < avg(abs(persistence - actual)) AS better FROM pairs WHERE {CORE} GROUP BY 1, 2")
def by_day_direction(spark, d):
    p = pairs(spark, d).where(ev.complete(["actual", "persistence", "lag_24h"]))
    return p.groupBy("horizon", F.to_date("target_time").cast("string").alias("day")).agg(F.count("*").alias("n"), (F.avg(ev.errors("lag_24h")) < F.avg(ev.errors("persistence"))).alias("better"))


@query(f"""WITH {PAIRS}, s AS (SELECT horizon, avg(abs(lag_24h - actual)) AS mae, avg(abs(persistence - actual)) AS base, avg(CASE WHEN {DAY} = 'weekend' THEN abs(lag_24h - actual) END) AS we, count(DISTINCT CASE WHEN isodow(target_time) >= 6 THEN date_trunc('week', target_time) END) AS weekends FROM pairs WHERE {CORE} GROUP BY 1),
o AS (SELECT *, mae <= base * 1.2 AND coalesce(we <= 40, FALSE) AND weekends >= 2 AS ok FROM s)
SELECT horizon, round(mae, 6) AS mae, weekends, ok, bool_and(ok) OVER (ORDER BY horizon) AS certified FROM o""")
def certify_prefix(spark, d):
    """Checks of each horizon, and the horizons before the first that fails."""
    p = pairs(spark, d).where(ev.complete(["actual", "persistence", "lag_24h"]))
    we = F.weekday("target_time") >= 5
    s = p.groupBy("horizon").agg(F.avg(ev.errors("lag_24h")).alias("m"), F.avg(ev.errors("persistence")).alias("base"), F.avg(F.when(we, ev.errors("lag_24h"))).alias("we"), F.countDistinct(F.when(we, F.date_trunc("week", "target_time"))).alias("weekends"))
    ok = (F.col("m") <= F.col("base") * 1.2) & F.coalesce(F.col("we") <= 40, F.lit(False)) & (F.col("weekends") >= 2)
    return ev.certified_prefix(s.withColumn("ok", ok)).select("horizon", r6("m").alias("mae"), "weekends", "ok", "certified")


@query(f"""WITH {PAIRS}, e AS (SELECT * FROM pairs WHERE {CORE}), t AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM e)), c AS (SELECT ts AS cut FROM t WHERE i = CAST(floor(n * 0.8) AS BIGINT))
SELECT horizon, count(*) FILTER (WHERE target_time < cut) AS train, count(*) FILTER (WHERE ts >= cut) AS test, count(*) FILTER (WHERE ts < cut AND target_time >= cut) AS purged FROM e, c GROUP BY horizon""")
def purged_split(spark, d):
    """80 percent of the distinct times train; pairs whose label lies past the cut are purged."""
    e = pairs(spark, d).where(ev.complete(["actual", "persistence", "lag_24h"]))
    # the time at a rank: days are counted first, then only the day that holds it is sorted
    times = e.select("ts").distinct()
    days = times.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("c"))
    upto = days.withColumns({"upto": F.sum("c").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("c").over(Window.partitionBy())})  # a row a day
    rank = F.floor(F.col("n") * 0.8)
    day = upto.where((rank < F.col("upto")) & (rank >= F.col("upto") - F.col("c"))).select("day", (rank - F.col("upto") + F.col("c") + 1).alias("place"))
    cut = times.withColumn("day", F.to_date("ts")).join(F.broadcast(day), "day").withColumn("i", F.row_number().over(Window.partitionBy("day").orderBy("ts"))).where("i = place").select(F.col("ts").alias("cut"))
    x = e.join(F.broadcast(cut), F.lit(True))  # one row
    return x.groupBy("horizon").agg(F.count_if(F.col("target_time") < F.col("cut")).alias("train"), F.count_if(F.col("ts") >= F.col("cut")).alias("test"), F.count_if((F.col("ts") < F.col("cut")) & (F.col("target_time") >= F.col("cut"))).alias("purged"))


FOLDS = ("2024-01-25", "2024-01-26", "2024-01-27")


def roles_sql(ts):
    return f"""WITH {PAIRS}, f AS (SELECT *, unnest([{', '.join(f"TIMESTAMP '{x}'" for x in FOLDS)}]) AS fold FROM pairs WHERE actual IS NOT NULL),
r AS (SELECT *, CASE WHEN target_time < fold - INTERVAL 1 DAY THEN 'train' WHEN {ts} >= fold - INTERVAL 1 DAY AND target_time < fold THEN 'validation' WHEN {ts} >= fold AND target_time < fold + INTERVAL 1 DAY THEN 'test' END AS role FROM f)
SELECT fold, role, horizon, count(*) AS n FROM r WHERE role IS NOT NULL GROUP BY 1, 2, 3"""


@query(roles_sql("ts"))
def rolling_origin_folds(spark, d):
    assert ev.test_days("2024-01-01", "2024-01-28", 3, 14) == list(FOLDS)
    return ev.roles(pairs(spark, d).where("actual IS NOT NULL"), list(FOLDS), False).groupBy("fold", "role", "horizon").agg(F.count("*").alias("n"))


@query(roles_sql("target_time"))
def label_time_folds(spark, d):
    return ev.roles(pairs(spark, d).where("actual IS NOT NULL"), list(FOLDS), True).groupBy("fold", "role", "horizon").agg(F.count("*").alias("n"))


@query(f"WITH {PAIRS}, {LONG.format(src='pairs')} SELECT horizon, {DAY} AS day, x.m AS method, count(*) AS n, count(x.p) AS scored, count(*) - count(x.p) AS missing, round(avg(abs(x.p - actual)), 6) AS mae FROM long WHERE actual IS NOT NULL GROUP BY ALL")
def method_missing(spark, d):
    """Scores that skip missing forecasts, and how many are missing."""
    p = pairs(spark, d).where("actual IS NOT NULL").withColumn("day", weekpart())
    x = p.select("horizon", "day", "actual", F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).alias("p")) for m in METHODS])).alias("x"))
    return x.groupBy("horizon", "day", F.col("x.m").alias("method")).agg(F.count("*").alias("n"), F.count("x.p").alias("scored"), F.count_if(F.col("x.p").isNull()).alias("missing"), r6(F.avg(F.abs(F.col("x.p") - F.col("actual")))).alias("mae"))


@query(f"WITH {PAIRS} SELECT lot, horizon, round(median(actual - lag_24h), 6) AS correction, count(*) AS n FROM pairs WHERE {CORE} GROUP BY lot, horizon")
def residual_median(spark, d):
    """The median error of the day before, exact from counts of errors: no task holds a lot's errors."""
    p = pairs(spark, d).where(ev.complete(["actual", "persistence", "lag_24h"])).withColumn("e", F.col("actual") - F.col("lag_24h"))
    keys = ["lot", "horizon"]
    counted = ev.counts_of(p, keys, "e")
    n = counted.groupBy(*keys).agg(F.sum("c").alias("n"))
    return n.join(ev.quantiles_of(counted, keys, "e", {"correction": 0.5}), keys).select(*keys, r6("correction").alias("correction"), "n")


@query(f"""WITH {PAIRS}, p AS (SELECT lot % 4 AS state, horizon, abs(actual - lag_24h) AS s, row_number() OVER (PARTITION BY lot % 4, horizon ORDER BY abs(actual - lag_24h), lot, ts) AS i, count(*) OVER (PARTITION BY lot % 4, horizon) AS n FROM pairs WHERE {CORE})
SELECT state, horizon, max(n) AS n, round(CASE WHEN max(n) >= 50 THEN max(CASE WHEN i = CAST(ceil(least(1.0, ceil((n + 1) * 0.8) / n) * (n - 1)) AS BIGINT) + 1 THEN s END) END, 6) AS adjust FROM p GROUP BY 1, 2""")
def conformal_quantile(spark, d):
    """The conformal quantile of each state and horizon: the score of the next higher rank, none below 50 scores."""
    p = pairs(spark, d).where(ev.complete(["actual", "persistence", "lag_24h"])).select(F.pmod("lot", F.lit(4)).alias("state"), "horizon", ev.errors("lag_24h").alias("s"))
    return ev.ranked_value(p, ["state", "horizon"], "s", lambda n: F.ceil(F.least(F.lit(1.0), F.ceil((n + 1) * 0.8) / n) * (n - 1)) + 1).select("state", "horizon", "n", F.round(F.when(F.col("n") >= 50, F.col("s")), 6).alias("adjust"))


@query(f"""WITH {PAIRS}, b AS (SELECT lot, ts, target_time, horizon, actual, {DAY} AS day, least(persistence, lag_24h) AS lo, greatest(persistence, lag_24h) AS hi FROM pairs WHERE {CORE}),
q AS (SELECT day, horizon, greatest(lo - actual, actual - hi) AS s, row_number() OVER (PARTITION BY day, horizon ORDER BY greatest(lo - actual, actual - hi)) AS i, count(*) OVER (PARTITION BY day, horizon) AS n FROM b WHERE target_time < TIMESTAMP '2024-01-24'),
a AS (SELECT day, horizon, CASE WHEN max(n) >= 50 THEN max(CASE WHEN i = CAST(ceil(least(1.0, ceil((n + 1) * 0.8) / n) * (n - 1)) AS BIGINT) + 1 THEN s END) END AS adjust FROM q GROUP BY 1, 2),
w AS (SELECT b.*, lo - adjust AS l, hi + adjust AS h FROM b LEFT JOIN a USING (day, horizon) WHERE ts >= TIMESTAMP '2024-01-24')
SELECT lot, ts, horizon, day, round(CASE WHEN l <= h THEN least(greatest(l, 0), 100) END, 6) AS lo, round(CASE WHEN l <= h THEN least(greatest(h, 0), 100) END, 6) AS hi FROM w""")
def conformal_intervals(spark, d):
    """Intervals between the last value and that of a day before, moved by the conformal quantile that earlier rows give to a part of the week and horizon."""
    p = pairs(spark, d).where(ev.complete(["actual", "persistence", "lag_24h"])).withColumns({"day": weekpart(), "lo": F.least("persistence", "lag_24h"), "hi": F.greatest("persistence", "lag_24h")})
    cut = F.expr("TIMESTAMP_NTZ'2024-01-24 00:00:00'")
    out = cal.conformal(p.where(F.col("target_time") < cut), p.where(F.col("ts") >= cut), ["day", "horizon"])
    return out.select("lot", "ts", "horizon", "day", r6("lo").alias("lo"), r6("hi").alias("hi"))
