"""Model queries on Spark ML. Trained models have no SQL twin."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import boosting, models
from ..operators import evaluation as ev
from ..registry import query
from ..sources import bundles
from ..sources.tables import read
from ..streaming.windows import work_folder
from .evaluation import FOLDS, pairs, weekpart


def frame(spark, d):
    """Pairs of all horizons with all features: known rows up to the fold train, later ones test."""
    p = pairs(spark, d).where("actual IS NOT NULL AND occ_now IS NOT NULL")
    p = p.withColumns({"hour": F.hour("target_time"), "weekend": (weekpart() == "weekend").cast("int"), "past": F.coalesce("lag_24h", "occ_now"), "week": F.coalesce("lag_7d", "occ_now")})
    return p.withColumn("test", F.col("ts") >= F.expr("TIMESTAMP_NTZ'2024-01-24 00:00:00'"))


def staged(df, folder, name):
    """A written copy: what trees are learnt from is read once a level."""
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def kept(spark, d):
    """The pairs, written once: models read them several times, and each time unwritten ones would be joined anew."""
    return staged(frame(spark, d), work_folder(spark), "pairs")


FEATURES = ["horizon", "occ_now", "hour", "weekend", "past", "week"]
KNOWN = "NOT test AND target_time < TIMESTAMP_NTZ'2024-01-24 00:00:00'"


@query()
def gbt_median(spark, d):
    """Boosted trees with absolute loss over all horizons, the horizon a feature; the change from now, restored and clipped."""
    x = kept(spark, d)
    return models.boosted_change(x.where(KNOWN), x.where("test"), FEATURES).select("lot", "ts", "horizon", "actual", "predicted")


@query()
def pooled_horizon(spark, d):
    """One model learnt from the shortest and longest horizon and asked for one between: errors by horizon, and whether it was learnt."""
    x = kept(spark, d)
    out = models.boosted_change(x.where(KNOWN).where("horizon <> 720"), x.where("test"), FEATURES)
    return out.groupBy("horizon", (F.col("horizon") != 720).alias("learnt")).agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("predicted") - F.col("actual"))), 6).alias("mae"))


@query()
def quantile_triple(spark, d):
    """Low, middle and high forecasts, sorted so that they never cross: boosted medians and the offsets of calibration residuals."""
    x = kept(spark, d)
    cut = "TIMESTAMP_NTZ'2024-01-17 00:00:00'"
    fit, held = x.where(KNOWN).where(f"target_time < {cut}"), x.where(KNOWN).where(f"ts >= {cut}")
    return models.interval(fit, held, x.where("test"), FEATURES, ["horizon"], 0.1, 0.9).select("lot", "ts", "horizon", "actual", "lo", "mid", "hi")


@query()
def feature_importance(spark, d):
    """The share of each feature in the trees' splits, the largest first."""
    x = kept(spark, d)
    return models.importance(spark, x.where(KNOWN), FEATURES)


@query()
def global_vs_local(spark, d):
    """Errors of one ridge over all lots against one a lot; lots of fewer than 200 rows have no own model."""
    x = kept(spark, d)
    return models.ridge_local(x.where(KNOWN), x.where("test"), "lot", FEATURES, "actual", 1.0, 200).select("lot", "n", F.round("mae_global", 6).alias("mae_global"), F.round("mae_local", 6).alias("mae_local"))


@query()
def feature_ablation(spark, d):
    """Errors by horizon with all features and without each group of them."""
    x, groups = kept(spark, d), {"none": [], "clock": ["hour", "weekend"], "past": ["past", "week"], "now": ["occ_now"]}
    out = None
    for name, gone in groups.items():
        one = models.ridge_errors(x.where(KNOWN), x.where("test"), ["horizon"], [f for f in FEATURES if f not in gone], "actual", 1.0).select(F.lit(name).alias("without"), "horizon", "n", F.round("mae", 6).alias("mae"))
        out = one if out is None else out.unionByName(one)
    return out


@query()
def level_or_change(spark, d):
    """Errors by horizon of learning the level itself and of learning the change from now."""
    x = kept(spark, d)
    one = lambda name, back: models.ridge_errors(x.where(KNOWN), x.where("test"), ["horizon"], FEATURES, "actual", 1.0, back).select(F.lit(name).alias("target"), "horizon", "n", F.round("mae", 6).alias("mae"))
    return one("level", None).unionByName(one("change", "occ_now"))


@query()
def full_probability(spark, d):
    """The chance of being nearly full by boosted trees, recalibrated on its log-odds."""
    x = kept(spark, d).withColumn("full", (F.col("actual") >= 90).cast("double"))
    return models.calibrated_chance(x.where("NOT test"), x.where("test"), FEATURES, "full").select("lot", "ts", "horizon", "full", "p", "calibrated")


@query()
def kmeans_profiles(spark, d):
    """Clusters of vectors, with the number of clusters of the best silhouette."""
    e = read(spark, d, "embeddings").select("vec_id", F.expr("transform(embedding, x -> double(x))").alias("v"))
    return models.clusters(e, "v", (2, 3, 4)).select("vec_id", "cluster")


@query()
def ridge_leave_one_out(spark, d):
    """Ridge forecasts of each lot from all other lots."""
    x = kept(spark, d)
    return models.ridge_without(x, "lot", FEATURES, "actual", 1.0).select("lot", "n", F.round("mae", 6).alias("mae"))


QUANTILES = [0.1, 0.5, 0.9]


def learnt(spark, d, folder):
    """A forest of the change from now, learnt on known pairs, and all pairs, written."""
    x = staged(frame(spark, d).withColumn("change", F.col("actual") - F.col("occ_now")), folder, "pairs")
    return boosting.fit(x.where(KNOWN), FEATURES, "change", QUANTILES), x


@query()
def boosted_quantiles(spark, d):
    """Trees with pinball loss for three quantiles at once, learnt on histograms: forecasts of the change, restored and clipped."""
    forest, x = learnt(spark, d, work_folder(spark))
    bundle = bundles.Bundle("now", FEATURES, forest, None, None, {}, {})
    return bundles.forecast(x.where("test"), bundle).select("lot", "ts", "horizon", "actual", "p10", "p50", "p90")


@query()
def quantile_coverage(spark, d):
    """By horizon, the share of actual values inside the boosted quantiles and inside offsets of a median's residuals, their pinball losses and mean widths."""
    folder = work_folder(spark)
    forest, x = learnt(spark, d, folder)
    mine = bundles.forecast(x.where("test"), bundles.Bundle("now", FEATURES, forest, None, None, {}, {})).select(F.lit("trees").alias("method"), "horizon", "actual", F.col("p10").alias("lo"), F.col("p90").alias("hi"))
    cut = "TIMESTAMP_NTZ'2024-01-17 00:00:00'"
    other = models.interval(x.where(KNOWN).where(f"target_time < {cut}"), x.where(KNOWN).where(f"ts >= {cut}"), x.where("test"), FEATURES, ["horizon"], 0.1, 0.9).select(F.lit("offsets").alias("method"), "horizon", "actual", "lo", "hi")
    a = F.col("actual")
    loss = boosting.pinball(a, F.col("lo"), 0.1) + boosting.pinball(a, F.col("hi"), 0.9)
    return mine.unionByName(other).groupBy("method", "horizon").agg(F.count("*").alias("n"), F.round(F.avg(a.between(F.col("lo"), F.col("hi")).cast("int")), 6).alias("coverage"), F.round(F.avg(loss), 6).alias("loss"), F.round(F.avg(F.col("hi") - F.col("lo")), 6).alias("width"))


@query()
def published_forecast(spark, d):
    """The forecast as served: trees, chances and a calibration curve are learnt, published as a version, loaded again, and forecast from what was loaded."""
    folder = work_folder(spark)
    forest, x = learnt(spark, d, folder)
    bundles.publish(spark, f"{folder}/bundles", bundles.Bundle("v1", FEATURES, forest, None, None, {}, {}))
    got = bundles.load(spark.newSession(), f"{folder}/bundles")
    return bundles.forecast(x.where("test"), got).select("lot", "ts", "horizon", "p10", "p50", "p90", "model_version")


LOCAL_LEAST = 60


@query()
def local_global_folds(spark, d):
    """By fold and horizon, on the same rows: a model of all lots (g0), one of each lot (l0), and the first moved by each lot's median residual of the validation day (h0).

    Models are trained apart: a group each in one task, or over Spark where it is large.
    """
    folder = work_folder(spark)
    p = frame(spark, d).withColumn("change", F.col("actual") - F.col("occ_now")).drop("test")
    x = staged(ev.roles(p, list(FOLDS), False), folder, "roles")
    train, asked = x.where("role = 'train'"), x.where("role <> 'train'")
    keep = ["fold", "role", "horizon", "lot", "ts", "actual", "occ_now", *[f for f in FEATURES if f not in ("horizon", "occ_now")]]
    g = staged(boosting.fit_groups(train, asked.select(*keep), ["fold", "horizon"], FEATURES, "change", [0.5], ["g"], 1), folder, "global")
    g = staged(boosting.fit_groups(train, g, ["fold", "horizon", "lot"], FEATURES, "change", [0.5], ["l"], LOCAL_LEAST), folder, "both")
    restore = lambda c: F.least(F.greatest(F.col("occ_now") + c, F.lit(0.0)), F.lit(100.0))
    g = g.withColumns({"g0": restore(F.col("g")), "l0": restore(F.col("l"))})
    lot = ["fold", "horizon", "lot"]
    shift = g.where("role = 'validation'").groupBy(*lot).agg(F.percentile_approx(F.col("actual") - F.col("g0"), 0.5, 10_000).alias("shift"))
    t = g.where("role = 'test'").join(shift, lot, "left").withColumn("h0", F.least(F.greatest(F.col("g0") + F.coalesce("shift", F.lit(0.0)), F.lit(0.0)), F.lit(100.0)))
    s = ev.long_scores(t.where(ev.complete(["g0", "l0", "h0", "actual"])), ["g0", "l0", "h0"], ["fold", "horizon"])
    return s.select(F.col("fold").cast("string").alias("fold"), "horizon", "method", "n", F.round("mae", 6).alias("mae"), F.round("rmse", 6).alias("rmse"))


#: Twenty penalties from 0.01 to 1000, evenly by their logarithms.
ALPHAS = np.logspace(-2, 3, 20)


@query()
def ridge_cv(spark, d):
    """Ridge forecasts of each lot from all others, with the penalty chosen among twenty by folds of those others."""
    x = kept(spark, d)
    g = models.ridge_cv(x, "lot", FEATURES, "actual", ALPHAS)
    return g.select("lot", "n", *[F.round(c, 6).alias(c) for c in ("alpha", "rmse", "mae")])
