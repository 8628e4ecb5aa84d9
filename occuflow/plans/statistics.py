"""Calibration, coverage, gates, correlation and profile statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import calibration as cal
from ..operators import models
from ..operators import statistics as st
from ..registry import query
from ..sources.tables import read
from .evaluation import CORE, DAY, HORIZONS, LONG, PAIRS, pairs, r6, weekpart
from .grids import GRID, grid

#: Scored events: a chance of being full, whether it came true, and the last state as a rival forecast.
PROB = """prob AS (SELECT event_id, user_id AS lot, event_type AS kind, (event_id * 37 + user_id * 11) % 1000 / 1000.0 AS p, CASE WHEN (event_id * 7919) % 1000 < (event_id * 37 + user_id * 11) % 1000 THEN 1 ELSE 0 END AS y,
CASE WHEN event_id % 5 < 2 THEN 1.0 ELSE 0.0 END AS q FROM events)"""


def probabilities(spark, d):
    e = read(spark, d, "events")
    x = F.pmod(F.col("event_id") * 37 + F.col("user_id") * 11, F.lit(1000))
    return e.select(
        "event_id", F.col("user_id").alias("lot"), F.col("event_type").alias("kind"), (x / 1000).alias("p"), F.when(F.pmod(F.col("event_id") * 7919, F.lit(1000)) < x, 1).otherwise(0).alias("y"),
        F.when(F.pmod("event_id", F.lit(5)) < 2, 1.0).otherwise(0.0).alias("q"),
    )


@query(f"WITH {PROB} SELECT kind, count(*) AS n, round(avg(pow(p - y, 2)), 6) AS brier, round(avg(pow(q - y, 2)), 6) AS brier_base FROM prob GROUP BY kind")
def brier_by_group(spark, d):
    return cal.brier(probabilities(spark, d), ["kind"], "q").select("kind", "n", r6("brier").alias("brier"), r6("brier_base").alias("brier_base"))


BINS = f"""{PROB}, b AS (SELECT kind, CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS mean_y FROM prob GROUP BY 1, 2),
bins AS (SELECT k.kind, CAST(i.bin AS INTEGER) AS bin, coalesce(b.n, 0) AS n, b.mean_p, b.mean_y FROM (SELECT DISTINCT kind FROM prob) k CROSS JOIN range(10) i(bin) LEFT JOIN b ON b.kind = k.kind AND b.bin = i.bin)"""


def bins(spark, d):
    return cal.reliability(probabilities(spark, d), ["kind"])


@query(f"WITH {BINS} SELECT kind, bin, n, round(mean_p, 6) AS mean_p, round(mean_y, 6) AS mean_y FROM bins")
def reliability_bins(spark, d):
    return bins(spark, d).select("kind", "bin", "n", r6("mean_p").alias("mean_p"), r6("mean_y").alias("mean_y"))


@query(f"WITH {BINS} SELECT kind, round(CASE WHEN count(mean_p) >= 2 THEN regr_slope(mean_y, mean_p) END, 6) AS slope FROM bins GROUP BY kind")
def reliability_slope(spark, d):
    """The slope over the means of bins that have rows, each bin counting once."""
    return cal.slope(bins(spark, d), ["kind"]).select("kind", r6("slope").alias("slope"))


@query(f"""WITH {PROB}, g AS (SELECT kind, count(*) AS n, avg(pow(p - y, 2)) AS brier, avg(pow(q - y, 2)) AS base FROM prob GROUP BY 1), {BINS.replace(PROB + ', ', '')},
s AS (SELECT kind, CASE WHEN count(mean_p) >= 2 THEN regr_slope(mean_y, mean_p) END AS slope FROM bins GROUP BY kind)
SELECT kind, CASE WHEN n < 1500 THEN 'insufficient' WHEN brier >= base THEN 'no_better_than_persistence' WHEN slope IS NULL OR slope < 0.8 OR slope > 1.2 THEN 'miscalibrated' ELSE 'calibrated' END AS status FROM g JOIN s USING (kind)""")
def probability_gate(spark, d):
    p = probabilities(spark, d)
    return cal.gate(cal.brier(p, ["kind"], "q"), cal.slope(cal.reliability(p, ["kind"]), ["kind"]), ["kind"], 1500).select("kind", "status")


INTERVALS = f"""{PAIRS}, iv AS (SELECT horizon, lot, {DAY} AS day, CASE WHEN lot % 10 = 0 THEN NULL ELSE lag_24h - 25 END AS lo, CASE WHEN lot % 10 = 0 THEN NULL ELSE lag_24h + 25 END AS hi, actual FROM pairs WHERE {CORE})"""


def intervals(spark, d):
    p = pairs(spark, d).where(CORE).withColumn("day", weekpart())
    known = F.pmod("lot", F.lit(10)) != 0
    return p.select("horizon", "lot", "day", F.when(known, F.col("lag_24h") - 25).alias("lo"), F.when(known, F.col("lag_24h") + 25).alias("hi"), "actual")


COVER = "count(*) AS n, count(lo) AS n_interval, count(*) FILTER (WHERE actual BETWEEN lo AND hi) AS inside, avg(hi - lo) AS width"


@query(f"""WITH {INTERVALS}, c AS (SELECT horizon, day, {COVER} FROM iv GROUP BY 1, 2)
SELECT horizon, day, n, n_interval, inside, round(inside / nullif(n_interval, 0), 6) AS coverage, round(width, 6) AS width, CASE WHEN n_interval < n THEN 'unavailable' WHEN inside / n_interval BETWEEN 0.77 AND 0.83 THEN 'pass' ELSE 'fail' END AS status FROM c""")
def interval_coverage(spark, d):
    x = intervals(spark, d)
    return cal.coverage(x, ["horizon", "day"]).select("horizon", "day", "n", "n_interval", "inside", r6("coverage").alias("coverage"), r6("width").alias("width"), "status")


@query(f"""WITH {INTERVALS}, c AS (SELECT horizon, day, {COVER} FROM iv GROUP BY GROUPING SETS ((horizon, day), (horizon)))
SELECT a.horizon, a.n = sum(b.n) AS n_adds, a.n_interval = sum(b.n_interval) AS intervals_add, a.inside = sum(b.inside) AS inside_adds FROM c a JOIN c b ON a.horizon = b.horizon AND a.day IS NULL AND b.day IS NOT NULL GROUP BY a.horizon, a.n, a.n_interval, a.inside""")
def coverage_additivity(spark, d):
    """A parent cell equals the sum of its children."""
    return cal.additive(cal.coverage(intervals(spark, d), ["horizon", "day"]), cal.coverage(intervals(spark, d), ["horizon"]), ["horizon"])


@query(f"""WITH {INTERVALS}, c AS (SELECT horizon, lot % 3 AS state, {COVER} FROM iv GROUP BY 1, 2) SELECT horizon, bool_and(inside / nullif(n_interval, 0) BETWEEN 0.7 AND 0.9) AS open FROM c GROUP BY horizon""")
def interval_gate(spark, d):
    """A horizon opens if all its states are covered within the band."""
    c = cal.coverage(intervals(spark, d).withColumn("state", F.pmod("lot", F.lit(3))), ["horizon", "state"])
    return c.groupBy("horizon").agg(F.bool_and(F.col("coverage").between(0.7, 0.9)).alias("open"))


@query(f"""WITH {PROB}, t AS (SELECT unnest([0.3, 0.5, 0.7]) AS cut), c AS (SELECT cut, count(*) FILTER (WHERE p >= cut AND y = 1) AS tp, count(*) FILTER (WHERE p >= cut AND y = 0) AS fp, count(*) FILTER (WHERE p < cut AND y = 0) AS tn, count(*) FILTER (WHERE p < cut AND y = 1) AS fn FROM prob, t GROUP BY cut)
SELECT CAST(cut AS DOUBLE) AS cut, tp, fp, tn, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(fp / nullif(fp + tn, 0), 6) AS fpr, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy FROM c""")
def confusion_metrics(spark, d):
    return cal.confusion(probabilities(spark, d), [0.3, 0.5, 0.7])


@query(f"""WITH {PROB}, g AS (SELECT kind, (i + 1) / 10.0 AS lo, (j + 1) / 10.0 AS hi, avg(CASE WHEN (CASE WHEN p < (i + 1) / 10.0 THEN 0 WHEN p < (j + 1) / 10.0 THEN q ELSE 1 END) = y THEN 1.0 ELSE 0.0 END) AS hit FROM prob, range(9) a(i), range(9) b(j) WHERE i < j GROUP BY ALL)
SELECT kind, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi, round(hit, 6) AS hit FROM g QUALIFY row_number() OVER (PARTITION BY kind ORDER BY round(hit, 9) DESC, lo, hi) = 1""")
def threshold_search(spark, d):
    """The two thresholds of the best share of right answers, from a grid of all pairs."""
    grid_ = [(i, j) for i in range(1, 10) for j in range(i + 1, 10)]
    cuts = F.array(*[F.struct(F.lit(a).alias("i"), F.lit(b).alias("j")) for a, b in grid_])
    # cuts are tenths, so rows are counted by tenth first and only the counts meet all pairs
    tenth = F.floor(F.round(F.col("p") * 1000) / 100).cast("int")
    counts = probabilities(spark, d).groupBy("kind", tenth.alias("t"), "q", "y").agg(F.count("*").alias("n"))
    x = counts.select("kind", "t", "q", "y", "n", F.explode(cuts).alias("c"))
    says = F.when(F.col("t") < F.col("c.i"), 0.0).when(F.col("t") < F.col("c.j"), F.col("q")).otherwise(1.0)
    hit = x.groupBy("kind", "c").agg((F.sum(F.when(says == F.col("y"), F.col("n")).otherwise(0)) / F.sum("n")).alias("hit"))
    hit = hit.select("kind", F.struct((F.col("c.i") / 10).alias("lo"), (F.col("c.j") / 10).alias("hi")).alias("c"), "hit")
    best = hit.groupBy("kind").agg(F.min(F.struct(-F.round("hit", 9), "c.lo", "c.hi", "hit")).alias("b"))
    return best.select("kind", "b.lo", "b.hi", r6("b.hit").alias("hit"))


SCORED = f"""{PAIRS}, sc AS (SELECT horizon, lot, {DAY} AS day, lot % 3 = 0 AS gate, CASE WHEN target_time < TIMESTAMP '2024-01-17' THEN 1 ELSE 2 END AS half, abs(lag_24h - actual) AS e, abs(persistence - actual) AS b1, abs(coalesce(lag_7d, lag_24h) - actual) AS b2 FROM pairs WHERE {CORE})"""


def scored(spark, d):
    p = pairs(spark, d).where(CORE)
    half = F.when(F.col("target_time") < F.expr("TIMESTAMP_NTZ'2024-01-17 00:00:00'"), 1).otherwise(2)
    err = lambda c: F.abs(c - F.col("actual"))
    return p.select("horizon", "lot", weekpart().alias("day"), (F.pmod("lot", F.lit(3)) == 0).alias("gate"), half.alias("half"), err(F.col("lag_24h")).alias("e"), err(F.col("persistence")).alias("b1"), err(F.coalesce("lag_7d", "lag_24h")).alias("b2"))


@query(f"""WITH {SCORED}, c AS (SELECT horizon, day, gate, count(*) AS n, avg(e) AS mae FROM sc GROUP BY 1, 2, 3), f AS (SELECT * FROM (VALUES (360), (720), (1440)) h(horizon), (VALUES ('weekday'), ('weekend')) d(day), (VALUES (TRUE), (FALSE)) g(gate))
SELECT horizon, day, gate, coalesce(n, 0) AS n, round(CASE WHEN n >= 200 THEN mae END, 6) AS mae, coalesce(n, 0) < 200 AS insufficient FROM f LEFT JOIN c USING (horizon, day, gate)""")
def four_cell_strata(spark, d):
    """Weekday by gate; a cell below 200 rows has no score, an empty one stays."""
    cells = spark.createDataFrame([(h, w, g) for h in HORIZONS for w in ("weekday", "weekend") for g in (True, False)], "horizon int, day string, gate boolean")
    c = scored(spark, d).groupBy("horizon", "day", "gate").agg(F.count("*").alias("n"), F.avg("e").alias("mae"))
    x = cells.join(c, ["horizon", "day", "gate"], "left")
    n = F.coalesce("n", F.lit(0).cast("long"))
    return x.select("horizon", "day", "gate", n.alias("n"), r6(F.when(F.col("n") >= 200, F.col("mae"))).alias("mae"), (n < 200).alias("insufficient"))


@query(f"WITH {SCORED}, c AS (SELECT horizon, day, count(*) AS n, avg(e) AS mae FROM sc WHERE gate GROUP BY 1, 2) SELECT horizon, sum(n)::BIGINT AS n, round(sum(mae * n) / sum(n), 6) AS mae FROM c GROUP BY horizon")
def weighted_headline(spark, d):
    """The headline of what is served: cell means weighted by rows."""
    c = scored(spark, d).where("gate").groupBy("horizon", "day").agg(F.count("*").alias("n"), F.avg("e").alias("mae"))
    return c.groupBy("horizon").agg(F.sum("n").alias("n"), r6(F.sum(F.col("mae") * F.col("n")) / F.sum("n")).alias("mae"))


@query(f"""WITH {SCORED}, a AS (SELECT lot, horizon, count(*) FILTER (WHERE half = 1) AS n1, count(*) FILTER (WHERE half = 2) AS n2, avg(e) FILTER (WHERE half = 1) AS m1, avg(e) FILTER (WHERE half = 2) AS m2, avg(e) AS m, least(avg(b1), avg(b2)) AS base FROM sc GROUP BY 1, 2)
SELECT lot, horizon, round(m1, 6) AS mae_first, round(m2, 6) AS mae_second, round(base, 6) AS baseline, CASE WHEN lot % 11 = 0 THEN 'display_blocked' WHEN n1 < 2 OR n2 < 2 THEN 'insufficient' WHEN m1 > 30 THEN 'failed' WHEN m2 > 30 THEN 'not_reproduced' WHEN base IS NULL THEN 'no_baseline' WHEN m > base THEN 'below_baseline' ELSE 'certified' END AS status FROM a""")
def accuracy_gate(spark, d):
    """Each lot and horizon on the ladder of reasons, by both halves of the test days."""
    h = lambda k, c: F.avg(F.when(F.col("half") == k, F.col(c)))
    a = scored(spark, d).groupBy("lot", "horizon").agg(
        F.count_if(F.col("half") == 1).alias("n1"), F.count_if(F.col("half") == 2).alias("n2"), h(1, "e").alias("m1"), h(2, "e").alias("m2"), F.avg("e").alias("m"), F.least(F.avg("b1"), F.avg("b2")).alias("base")
    )
    return a.select("lot", "horizon", r6("m1").alias("mae_first"), r6("m2").alias("mae_second"), r6("base").alias("baseline"), cal.accuracy_status(F.pmod("lot", F.lit(11)) == 0, 2, 30).alias("status"))


@query(f"""WITH {SCORED}, a AS (SELECT lot, horizon, avg(e) AS m, least(avg(b1), avg(b2)) AS base FROM sc GROUP BY 1, 2)
SELECT e.event_id, CASE WHEN e.event_id % 4 = 3 THEN 'unsupported_horizon' WHEN a.lot IS NULL THEN 'no_model' WHEN a.m > a.base THEN 'not_certified' WHEN e.value < 5 THEN 'no_fresh_history' ELSE 'ml' END AS decision
FROM events e LEFT JOIN a ON a.lot = e.user_id AND a.horizon = CASE e.event_id % 4 WHEN 0 THEN 360 WHEN 1 THEN 720 WHEN 2 THEN 1440 END""")
def prediction_decision(spark, d):
    """Why a request is served by the model or not: the first reason of the ladder."""
    a = scored(spark, d).groupBy("lot", "horizon").agg(F.avg("e").alias("m"), F.least(F.avg("b1"), F.avg("b2")).alias("base"))
    e = read(spark, d, "events").select("event_id", F.col("user_id").alias("lot"), "value", F.expr("CASE event_id % 4 WHEN 0 THEN 360 WHEN 1 THEN 720 WHEN 2 THEN 1440 END").alias("horizon"))
    x = e.join(a, ["lot", "horizon"], "left")
    ladder = F.when(F.col("horizon").isNull(), "unsupported_horizon").when(F.col("m").isNull(), "no_model").when(F.col("m") > F.col("base"), "not_certified").when(F.col("value") < 5, "no_fresh_history").otherwise("ml")
    return x.select("event_id", ladder.alias("decision"))


# ---- correlation and profiles


@query("""WITH r AS (SELECT n_regionkey AS g, CAST(o_totalprice AS DOUBLE) AS x, CAST(c_acctbal AS DOUBLE) AS y FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey),
k AS (SELECT g, rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY g ORDER BY y) + (count(*) OVER (PARTITION BY g, y) - 1) / 2.0 AS ry FROM r)
SELECT g, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM k GROUP BY g""")
def spearman_rho(spark, d):
    """Rank correlation; ties share their mean rank."""
    return st.spearman(priced(spark, d), ["g"], "x", "y").select("g", "n", r6("rho").alias("rho"))


def priced(spark, d):
    o, c, n = read(spark, d, "orders"), read(spark, d, "customer"), read(spark, d, "nation")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("n_regionkey").alias("g"), F.col("o_totalprice").cast("double").alias("x"), F.col("c_acctbal").cast("double").alias("y"))


@query("""WITH r AS (SELECT c_nationkey AS g, CAST(o_totalprice AS DOUBLE) AS x, CAST(c_acctbal AS DOUBLE) AS y FROM orders JOIN customer ON o_custkey = c_custkey), c AS (SELECT g, count(*) AS n, corr(x, y) AS r FROM r GROUP BY g)
SELECT g, n, round(r, 6) AS r, round(CASE WHEN n >= 4 THEN tanh(atanh(r) - 1.96 / sqrt(n - 3)) END, 6) AS lo, round(CASE WHEN n >= 4 THEN tanh(atanh(r) + 1.96 / sqrt(n - 3)) END, 6) AS hi FROM c""")
def fisher_ci(spark, d):
    o, c = read(spark, d, "orders"), read(spark, d, "customer")
    r = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("g")).agg(F.count("*").alias("n"), F.corr(F.col("o_totalprice").cast("double"), F.col("c_acctbal").cast("double")).alias("r"))
    lo, hi = st.fisher_interval(F.col("r"), F.col("n"))
    return r.select("g", "n", r6("r").alias("r"), r6(lo).alias("lo"), r6(hi).alias("hi"))


@query(f"""WITH {GRID}, g AS (SELECT lot, avg(occ) AS m, var_samp(occ) AS v, count(*) AS n FROM grid WHERE occ IS NOT NULL GROUP BY lot HAVING count(*) >= 2),
t AS (SELECT count(*) AS k, sum(n) AS total, sum(n * m) / sum(n) AS grand, sum(n * n) AS sq FROM g), s AS (SELECT sum(n * pow(m - grand, 2)) / (any_value(k) - 1) AS msb, sum((n - 1) * v) / (any_value(total) - any_value(k)) AS msw, (any_value(total) - any_value(sq) / any_value(total)) / (any_value(k) - 1) AS n0 FROM g, t)
SELECT round((msb - msw) / (msb + (n0 - 1) * msw), 6) AS icc, round(msb / msw, 6) AS f FROM s""")
def icc1(spark, d):
    """One-way intraclass correlation of unbalanced groups."""
    return st.icc1(grid(spark, d).where("occ IS NOT NULL"), "lot", "occ").select(r6("icc").alias("icc"), r6("f").alias("f"))


@query(f"""WITH {GRID}, p AS (SELECT lot, hour(ts) * 7 + isodow(ts) AS h, avg(occ) FILTER (WHERE day(ts) <= 15) AS a, avg(occ) FILTER (WHERE day(ts) > 15) AS b FROM grid GROUP BY 1, 2),
c AS (SELECT lot, count(*) AS n, corr(a, b) AS r FROM p WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY lot HAVING count(*) >= 8 AND stddev_samp(a) > 1e-9 AND stddev_samp(b) > 1e-9)
SELECT lot, n, round(r, 5) AS r FROM c""")
def split_half_r(spark, d):
    """How a lot's profile of one half of the month agrees with the other's."""
    g = grid(spark, d).withColumn("h", F.hour("ts") * 7 + F.weekday("ts"))
    return st.split_half(g, F.dayofmonth("ts") <= 15, 8).select("lot", "n", F.round("r", 5).alias("r"))


@query(f"""WITH {GRID}, m AS (SELECT lot, hour(ts) AS h, avg(occ) AS m FROM grid WHERE occ IS NOT NULL GROUP BY 1, 2), o AS (SELECT lot, avg(m) AS a FROM m GROUP BY lot HAVING count(*) >= 3)
SELECT m.lot, {', '.join(f"round(coalesce(max(CASE WHEN h = {h} THEN m / a END), 1.0), 6) AS h{h}" for h in (0, 6, 12, 18))} FROM m JOIN o ON o.lot = m.lot WHERE a <> 0 GROUP BY m.lot""")
def profile_pivot(spark, d):
    """Profiles as shares of their own mean; lots of few hours are left out, missing hours take the mean."""
    m = grid(spark, d).where("occ IS NOT NULL").groupBy("lot", F.hour("ts").alias("h")).agg(F.avg("occ").alias("m"))
    w = Window.partitionBy("lot")
    own = m.withColumns({"a": F.avg("m").over(w), "k": F.count("*").over(w)}).where("k >= 3 AND a <> 0")
    return own.groupBy("lot").pivot("h", [0, 6, 12, 18]).agg(F.first(F.col("m") / F.col("a"))).select("lot", *[F.round(F.coalesce(F.col(str(h)), F.lit(1.0)), 6).alias(f"h{h}") for h in (0, 6, 12, 18)])


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS n_{t}" for t in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY user_id")
def category_pivot(spark, d):
    kinds = ["click", "error", "purchase", "signup", "view"]
    p = read(spark, d, "events").groupBy("user_id").pivot("event_type", kinds).count().na.fill(0)
    return p.select("user_id", *[F.col(k).cast("long").alias(f"n_{k}") for k in kinds])


@query(f"""WITH {GRID}, h AS (SELECT lot, hour(ts) AS h, avg(occ) AS m FROM grid WHERE occ IS NOT NULL GROUP BY 1, 2), l AS (SELECT lot, avg(m) AS level FROM h GROUP BY lot HAVING avg(m) > 0),
s AS (SELECT h.lot, h.h, m / level AS shape, m, level FROM h JOIN l USING (lot)), t AS (SELECT h, sum(shape) AS total, count(*) AS n FROM s GROUP BY h), al AS (SELECT sum(level) AS total, count(*) AS n FROM l)
SELECT s.lot, s.h, round((al.total - s.level) / nullif(al.n - 1, 0) * coalesce((t.total - s.shape) / nullif(t.n - 1, 0), 1.0), 6) AS predicted, round(s.level * coalesce((t.total - s.shape) / nullif(t.n - 1, 0), 1.0), 6) AS with_own_level, round(m, 6) AS actual FROM s JOIN t ON t.h = s.h, al""")
def loo_level_shape(spark, d):
    """Level and shape of a lot from all others: group sums less the lot's own share."""
    x = st.leave_one_out(grid(spark, d).where("occ IS NOT NULL"), F.hour("ts"))
    return x.select("lot", "h", r6("predicted").alias("predicted"), r6("with_own_level").alias("with_own_level"), r6("actual").alias("actual"))


@query("""WITH e AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i, vec_id FROM embeddings), w AS (SELECT vec_id, max(x) FILTER (WHERE i = 1) AS a, max(x) FILTER (WHERE i = 2) AS b, max(x) FILTER (WHERE i = 3) AS c FROM e GROUP BY vec_id),
k AS (SELECT corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc FROM w), q AS (SELECT *, 1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc AS det FROM k)
SELECT round((1 - bc * bc) / det, 6) AS vif_a, round((1 - ac * ac) / det, 6) AS vif_b, round((1 - ab * ab) / det, 6) AS vif_c FROM q""")
def variance_inflation(spark, d):
    """Variance inflation of three features, from the inverse of their correlations."""
    e = read(spark, d, "embeddings").select(*[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("abc")])
    k = e.agg(F.corr("a", "b").alias("ab"), F.corr("a", "c").alias("ac"), F.corr("b", "c").alias("bc"))
    det = F.expr("1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc")
    return k.select(*[r6((1 - F.col(o) * F.col(o)) / det).alias(f"vif_{c}") for c, o in (("a", "bc"), ("b", "ac"), ("c", "ab"))])


SIX = 6


def sweep_sql():
    """The inverse of six features' correlations in SQL: the matrix's cells are columns, swept by one feature a step."""
    cells = [(i, j) for i in range(SIX) for j in range(SIX)]
    steps = ["x AS (SELECT " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS x{i}" for i in range(SIX)) + " FROM embeddings)", "s0 AS (SELECT " + ", ".join(f"corr(x{i}, x{j}) AS a{i}_{j}" for i, j in cells) + " FROM x)"]
    for k in range(SIX):
        new = [f"{'-' if i == k and j == k else ''}{'1 / a%d_%d' % (k, k) if i == j == k else f'a{i}_{j} / a{k}_{k}' if k in (i, j) else f'a{i}_{j} - a{i}_{k} * a{k}_{j} / a{k}_{k}'} AS a{i}_{j}" for i, j in cells]
        steps.append(f"s{k + 1} AS (SELECT {', '.join(new)} FROM s{k})")
    return "WITH " + ", ".join(steps) + f" SELECT unnest([{', '.join(repr(f'x{i}') for i in range(SIX))}]) AS feature, round(unnest([{', '.join(f'-a{i}_{i}' for i in range(SIX))}]), 6) AS vif FROM s{SIX}"


@query(sweep_sql())
def inflation_factors(spark, d):
    """Variance inflation of six features, from the inverse of their correlation matrix."""
    e = read(spark, d, "embeddings").select(*[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(SIX)])
    return models.inflation(e, list(e.columns)).select("feature", r6("vif").alias("vif"))


@query(f"""WITH {PAIRS}, {LONG.format(src='pairs')}, s AS (SELECT horizon, x.m AS m, avg(abs(x.p - actual)) AS mae FROM long WHERE {CORE} GROUP BY 1, 2)
SELECT m AS method, round(max(mae) FILTER (WHERE horizon = 360), 6) AS h360, round(max(mae) FILTER (WHERE horizon = 720), 6) AS h720, round(max(mae) FILTER (WHERE horizon = 1440), 6) AS h1440 FROM s GROUP BY m""")
def report_pivot(spark, d):
    from ..operators import evaluation as ev

    s = ev.long_scores(pairs(spark, d).where(CORE), ["persistence", "lag_24h", "lag_7d"], ["horizon"])
    return s.groupBy("method").pivot("horizon", HORIZONS).agg(F.first("mae")).select("method", *[r6(str(h)).alias(f"h{h}") for h in HORIZONS])


def bootstrap_rescue(spark, d):
    """Day-cluster bootstrap of a gain by horizon: resamples of days, 2.5 and 97.5 percent. Draws are hashes, so they are the same at every run."""
    p = pairs(spark, d).where(CORE)
    gain = F.abs(F.col("persistence") - F.col("actual")) - F.abs(F.col("lag_24h") - F.col("actual"))
    x = p.groupBy("horizon", F.to_date("target_time").alias("cluster")).agg(F.sum(gain).alias("s"), F.count("*").alias("n"))
    return st.cluster_bootstrap(x, ["horizon"], 500, 7)


query()(bootstrap_rescue)


@query("""SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) AS running, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth, ntile(4) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS quarter, round(percent_rank() OVER (PARTITION BY user_id ORDER BY value, event_id), 6) AS share FROM events""")
def running_ranks(spark, d):
    w, v = Window.partitionBy("user_id").orderBy("ts", "event_id"), Window.partitionBy("user_id").orderBy("value", "event_id")
    e = read(spark, d, "events")
    return e.select("event_id", "user_id", F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("running"), F.row_number().over(w).alias("nth"), F.ntile(4).over(w).alias("quarter"), F.round(F.percent_rank().over(v), 6).alias("share"))


@query("SELECT user_id, count(*) AS n, round(min(value), 6) AS least, round(quantile_cont(value, 0.25), 6) AS q1, round(median(value), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, round(max(value), 6) AS most, round(stddev_samp(value), 6) AS deviation, count(DISTINCT event_type) AS kinds, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY user_id")
def describe_lots(spark, d):
    e = read(spark, d, "events")
    q = lambda p: r6(F.percentile("value", F.lit(p)))
    return e.groupBy("user_id").agg(
        F.count("*").alias("n"), r6(F.min("value")).alias("least"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), r6(F.max("value")).alias("most"), r6(F.stddev_samp("value")).alias("deviation"),
        F.countDistinct("event_type").alias("kinds"), F.countDistinct(F.to_date("ts")).alias("days"),
    )
