"""Calibration of chances, coverage of intervals, and gates that follow from them. Chances are ``p``, outcomes ``y`` (0 or 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluation import ranked_value


def brier(frame: DataFrame, keys: list[str], base: str) -> DataFrame:
    """(keys, n, brier, brier_base): mean squared errors of the chance and of a rival forecast."""
    square = lambda c: F.avg((F.col(c) - F.col("y")) * (F.col(c) - F.col("y")))
    return frame.groupBy(*keys).agg(F.count("*").alias("n"), square("p").alias("brier"), square(base).alias("brier_base"))


def reliability(frame: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """(keys, bin, n, mean_p, mean_y) of equal bins; empty bins stay with n = 0."""
    placed = frame.withColumn("bin", F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int"))
    filled = placed.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("mean_y"))
    every = filled.select(*keys).distinct().withColumn("bin", F.explode(F.array(*map(F.lit, range(bins)))))
    return every.join(filled, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def slope(bins: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, slope) of observed on expected means over bins that have rows; null below two of them."""
    return bins.groupBy(*keys).agg(F.when(F.count("mean_p") >= 2, F.regr_slope("mean_y", "mean_p")).alias("slope"))


def gate(scores: DataFrame, slopes: DataFrame, keys: list[str], least: int, low: float = 0.8, high: float = 1.2) -> DataFrame:
    """Adds ``status``: too few rows, no better than the rival, out of the slope's band, or calibrated."""
    status = (
        F.when(F.col("n") < least, "insufficient").when(F.col("brier") >= F.col("brier_base"), "no_better_than_persistence")
        .when(F.col("slope").isNull() | ~F.col("slope").between(low, high), "miscalibrated").otherwise("calibrated")
    )
    return scores.join(slopes, keys).withColumn("status", status)


def coverage(frame: DataFrame, keys: list[str], low: float = 0.77, high: float = 0.83) -> DataFrame:
    """(keys, n, n_interval, inside, coverage, width, status) of intervals (lo, hi); unavailable if any is missing."""
    c = frame.groupBy(*keys).agg(F.count("*").alias("n"), F.count("lo").alias("n_interval"), F.count_if(F.col("actual").between(F.col("lo"), F.col("hi"))).alias("inside"), F.avg(F.col("hi") - F.col("lo")).alias("width"))
    c = c.withColumn("coverage", F.try_divide("inside", "n_interval"))
    return c.withColumn("status", F.when(F.col("n_interval") < F.col("n"), "unavailable").when(F.col("coverage").between(low, high), "pass").otherwise("fail"))


def conformal(known: DataFrame, rows: DataFrame, keys: list[str], share: float = 0.8, least: int = 50, most: float = 100.0) -> DataFrame:
    """``rows`` with lo and hi moved by the conformal quantile of the signed scores of ``known`` rows, by keys.

    A score is how far the actual value lies outside (lo, hi), negative inside, so that intervals widen or narrow. Groups of fewer than
    ``least`` scores and intervals that would cross have none; rows without keys, bounds or a known group likewise. Known rows without a score don't count.
    """
    score = known.select(*keys, F.when(F.col("lo").isNotNull() & F.col("hi").isNotNull() & F.col("actual").isNotNull(), F.greatest(F.col("lo") - F.col("actual"), F.col("actual") - F.col("hi"))).alias("s_")).where("s_ IS NOT NULL")
    rank = lambda n: F.ceil(F.least(F.lit(1.0), F.ceil((n + 1) * share) / n) * (n - 1)) + 1
    moved = ranked_value(score, keys, "s_", rank).where(F.col("n") >= least).select(*keys, "s_")
    low, high = F.col("lo") - F.col("s_"), F.col("hi") + F.col("s_")
    x = rows.join(moved, keys, "left")
    return x.withColumns({"lo": F.when(low <= high, F.least(F.greatest(low, F.lit(0.0)), F.lit(most))), "hi": F.when(low <= high, F.least(F.greatest(high, F.lit(0.0)), F.lit(most)))}).drop("s_")


def additive(children: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """Whether each parent's counts are the sums of its children's."""
    sums = children.groupBy(*keys).agg(*[F.sum(c).alias(f"s_{c}") for c in ("n", "n_interval", "inside")])
    both = parents.join(sums, keys)
    return both.select(*keys, *[(F.col(c) == F.col(f"s_{c}")).alias(a) for c, a in (("n", "n_adds"), ("n_interval", "intervals_add"), ("inside", "inside_adds"))])


def confusion(frame: DataFrame, cuts: list[float]) -> DataFrame:
    """Counts and rates of the decision ``p >= cut``, for each cut."""
    x = frame.select("p", "y", F.explode(F.array(*map(F.lit, cuts))).alias("cut"))
    yes, true = F.col("p") >= F.col("cut"), F.col("y") == 1
    c = x.groupBy("cut").agg(F.count_if(yes & true).alias("tp"), F.count_if(yes & ~true).alias("fp"), F.count_if(~yes & ~true).alias("tn"), F.count_if(~yes & true).alias("fn"))
    rate = lambda a, b: F.round(F.expr(f"try_divide({a}, {b})"), 6)
    return c.select(
        "cut", "tp", "fp", "tn", "fn", rate("tp", "tp + fp").alias("precision"), rate("tp", "tp + fn").alias("recall"), rate("fp", "fp + tn").alias("fpr"), rate("tp + tn", "tp + fp + tn + fn").alias("accuracy"),
    )


def accuracy_status(blocked: Column, least: int, most: float) -> Column:
    """The ladder of an accuracy gate over columns n1, n2, m1, m2, m and base."""
    return (
        F.when(blocked, "display_blocked").when((F.col("n1") < least) | (F.col("n2") < least), "insufficient").when(F.col("m1") > most, "failed").when(F.col("m2") > most, "not_reproduced")
        .when(F.col("base").isNull(), "no_baseline").when(F.col("m") > F.col("base"), "below_baseline").otherwise("certified")
    )
