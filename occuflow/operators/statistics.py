"""Rank correlation, intervals, intraclass correlation, split halves, leave-one-out sums and cluster bootstrap."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_parts(counts: DataFrame, keys: list[str], c: str, name: str) -> DataFrame:
    """(keys, c, name): the mean rank of each value, of distinct values and their counts t (keys, c, t).

    Ranks come from running sums over distinct values, split at approximate quantiles of each key, so that no
    task sorts a whole key's values, however they are spread.
    """
    cuts = counts.groupBy(*keys).agg(F.percentile_approx(c, [k / 64 for k in range(1, 64)], 2000).alias("cuts"))
    placed = counts.join(cuts, keys).withColumn("part", F.size(F.filter("cuts", lambda x: x < F.col(c)))).drop("cuts")
    w = Window.partitionBy(*keys, "part").orderBy(c)
    sizes = placed.groupBy(*keys, "part").agg(F.sum("t").alias("s"))
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "part", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("offset"))
    ranks = placed.withColumn("below", F.sum("t").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("t")).join(offsets, [*keys, "part"])
    return ranks.select(*keys, c, (F.col("offset") + F.col("below") + (F.col("t") + 1) / 2).alias(name))


def spearman(frame: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, n, rho): the correlation of mean ranks. Rows are counted by pairs of values first, so frequent values are one row each and the frame is read once."""
    pairs = frame.groupBy(*keys, x, y).agg(F.count("*").alias("t"))
    of = lambda c, name: rank_parts(pairs.groupBy(*keys, c).agg(F.sum("t").alias("t")), keys, c, name)
    r = pairs.join(of(x, "a"), [*keys, x]).join(of(y, "b"), [*keys, y])
    n, a, b, t = F.sum("t"), F.col("a"), F.col("b"), F.col("t")
    sums = r.groupBy(*keys).agg(n.alias("n"), F.sum(t * a).alias("sa"), F.sum(t * b).alias("sb"), F.sum(t * a * a).alias("saa"), F.sum(t * b * b).alias("sbb"), F.sum(t * a * b).alias("sab"))
    cov = F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")
    spread = F.sqrt((F.col("saa") - F.col("sa") * F.col("sa") / F.col("n")) * (F.col("sbb") - F.col("sb") * F.col("sb") / F.col("n")))
    return sums.select(*keys, "n", F.try_divide(cov, spread).alias("rho"))


def fisher_interval(r: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The interval of a correlation by Fisher's transform; null below four rows."""
    half = F.lit(z) / F.sqrt(n - 3)
    return tuple(F.when(n >= 4, F.tanh(F.atanh(r) + s * half)) for s in (-1, 1))


def icc1(frame: DataFrame, key: str, c: str) -> DataFrame:
    """(icc, f) of a one-way layout with groups of unequal size; groups of one row are left out."""
    g = frame.groupBy(key).agg(F.avg(c).alias("m"), F.var_samp(c).alias("v"), F.count("*").alias("n")).where("n >= 2")
    # sums of squares between groups from sums over groups, so that no second pass is needed
    t = g.agg(F.count("*").alias("k"), F.sum("n").alias("total"), F.sum(F.expr("n * m")).alias("nm"), F.sum(F.expr("n * m * m")).alias("nmm"), F.sum(F.expr("n * n")).alias("nn"), F.sum(F.expr("(n - 1) * v")).alias("within"))
    s = t.select(F.expr("(nmm - nm * nm / total) / (k - 1)").alias("msb"), F.expr("within / (total - k)").alias("msw"), F.expr("(total - nn / total) / (k - 1)").alias("n0"))
    return s.select(F.expr("(msb - msw) / (msb + (n0 - 1) * msw)").alias("icc"), F.expr("msb / msw").alias("f"))


def split_half(grid: DataFrame, first: Column, least: int) -> DataFrame:
    """(lot, n, r): correlation of a lot's profiles over ``h`` of both halves, where both vary and share ``least`` places."""
    p = grid.groupBy("lot", "h").agg(F.avg(F.when(first, F.col("occ"))).alias("a"), F.avg(F.when(~first, F.col("occ"))).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    c = p.groupBy("lot").agg(F.count("*").alias("n"), F.corr("a", "b").alias("r"), F.stddev_samp("a").alias("sa"), F.stddev_samp("b").alias("sb"))
    return c.where((F.col("n") >= least) & (F.col("sa") > 1e-9) & (F.col("sb") > 1e-9))


def leave_one_out(grid: DataFrame, hour: Column) -> DataFrame:
    """(lot, h, predicted, with_own_level, actual): level times shape of the other lots; a shape that no other lot has is 1."""
    m = grid.groupBy("lot", hour.alias("h")).agg(F.avg("occ").alias("actual"))
    level = m.groupBy("lot").agg(F.avg("actual").alias("level")).where("level > 0")
    s = m.join(level, "lot").withColumn("shape", F.col("actual") / F.col("level"))
    by_hour = s.groupBy("h").agg(F.sum("shape").alias("shapes"), F.count("*").alias("lots"))
    every = level.agg(F.sum("level").alias("levels"), F.count("*").alias("all")).withColumn("k", F.lit(1))
    x = s.join(F.broadcast(by_hour), "h").withColumn("k", F.lit(1)).join(F.broadcast(every), "k")  # hours of a day, and one row
    shape = F.coalesce(F.try_divide(F.col("shapes") - F.col("shape"), F.col("lots") - 1), F.lit(1.0))
    return x.select("lot", "h", (F.try_divide(F.col("levels") - F.col("level"), F.col("all") - 1) * shape).alias("predicted"), (F.col("level") * shape).alias("with_own_level"), "actual")


def cluster_bootstrap(clusters: DataFrame, keys: list[str], draws: int, seed: int) -> DataFrame:
    """(keys, mean, lo, hi) of a ratio of sums s / n over clusters (keys, cluster, s, n): clusters are drawn with replacement.

    A cluster's number of draws in a resample is Poisson of mean one, so resamples need no gathering and no self-join;
    it comes from a hash of seed, draw and cluster and is the same at any partitioning and retry.
    """
    upto, term = [], math.exp(-1)
    for k in range(1, 18):  # beyond 17 draws lies less than the hash resolves
        upto.append(term + (upto[-1] if upto else 0))
        term /= k
    rows = clusters.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    u = F.pmod(F.xxhash64(F.lit(seed), "draw", "cluster", *keys), F.lit(1 << 53)) / float(1 << 53)
    rows = rows.withColumn("u", u).withColumn("times", sum((F.when(F.col("u") >= e, 1).otherwise(0) for e in upto), F.lit(0)))
    means = rows.groupBy(*keys, "draw").agg(F.try_divide(F.sum(F.col("s") * F.col("times")), F.sum(F.col("n") * F.col("times"))).alias("m"))
    return means.groupBy(*keys).agg(F.avg("m").alias("mean"), F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi"))
