"""Models on Spark ML, and leave-one-group-out ridge regression from sums."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def boosted_change(train: DataFrame, test: DataFrame, features: list[str], now: str = "occ_now", actual: str = "actual", most: float = 100.0) -> DataFrame:
    """Test rows with ``predicted``: now plus the forecast change, between 0 and ``most``."""
    vector = VectorAssembler(inputCols=features, outputCol="x")
    rows = vector.transform(train).withColumn("change", F.col(actual) - F.col(now))
    model = GBTRegressor(featuresCol="x", labelCol="change", predictionCol="d", lossType="absolute", maxIter=20, maxDepth=4, seed=1).fit(rows)
    return model.transform(vector.transform(test)).withColumn("predicted", F.least(F.greatest(F.col(now) + F.col("d"), F.lit(0.0)), F.lit(most)))


def calibrated_chance(train: DataFrame, test: DataFrame, features: list[str], label: str) -> DataFrame:
    """Test rows with the chance ``p`` of trees and ``calibrated``, a logistic curve of its log-odds learnt on a held-back part."""
    vector = VectorAssembler(inputCols=features, outputCol="x")
    held = F.pmod(F.xxhash64("lot", "ts"), F.lit(4)) == 0
    rows = vector.transform(train)
    trees = GBTClassifier(featuresCol="x", labelCol=label, maxIter=15, maxDepth=3, seed=1).fit(rows.where(~held))
    odds = VectorAssembler(inputCols=["odds"], outputCol="z")

    def chances(frame: DataFrame) -> DataFrame:
        p = trees.transform(frame).withColumn("p", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
        safe = F.least(F.greatest("p", F.lit(1e-6)), F.lit(1 - 1e-6))
        return odds.transform(p.withColumn("odds", F.log(safe / (1 - safe))))

    curve = LogisticRegression(featuresCol="z", labelCol=label).fit(chances(rows.where(held)))
    return curve.transform(chances(vector.transform(test))).withColumn("calibrated", vector_to_array("probability")[1])


def clusters(frame: DataFrame, vector: str, ks: tuple[int, ...]) -> DataFrame:
    """Rows with ``cluster`` of the number of clusters with the best silhouette."""
    rows = frame.withColumn("features", array_to_vector(vector))
    fits = [KMeans(k=k, seed=1, predictionCol="cluster").fit(rows) for k in ks]
    judge = ClusteringEvaluator(predictionCol="cluster")
    return max(fits, key=lambda m: judge.evaluate(m.transform(rows))).transform(rows)


def interval(fit: DataFrame, held: DataFrame, test: DataFrame, features: list[str], keys: list[str], low: float, high: float) -> DataFrame:
    """Test rows with ``lo``, ``mid`` and ``hi``, in order: the boosted median and, by keys, the quantiles of the residuals of held-back rows added to it."""
    columns = test.columns
    both = boosted_change(fit, held.withColumn("part", F.lit(0)).unionByName(test.withColumn("part", F.lit(1))), features)
    offsets = both.where("part = 0").groupBy(*keys).agg(F.percentile_approx(F.col("actual") - F.col("predicted"), [low, high], 10_000).alias("q"))
    three = F.array_sort(F.array("predicted", *[F.least(F.greatest(F.col("predicted") + F.coalesce(F.col("q")[i], F.lit(0.0)), F.lit(0.0)), F.lit(100.0)) for i in range(2)]))
    return both.where("part = 1").join(F.broadcast(offsets), keys, "left").select(*columns, three.alias("t")).select(*columns, *[F.col("t")[i].alias(n) for i, n in enumerate(("lo", "mid", "hi"))])  # a row a horizon


def importance(spark, train: DataFrame, features: list[str], now: str = "occ_now", actual: str = "actual") -> DataFrame:
    """(feature, share, rank) of boosted trees on the change from now."""
    rows = VectorAssembler(inputCols=features, outputCol="x").transform(train).withColumn("change", F.col(actual) - F.col(now))
    share = GBTRegressor(featuresCol="x", labelCol="change", lossType="absolute", maxIter=20, maxDepth=4, seed=1).fit(rows).featureImportances.toArray()
    order = sorted(range(len(features)), key=lambda i: (-share[i], features[i]))
    return spark.createDataFrame([(features[i], float(share[i]), k + 1) for k, i in enumerate(order)], "feature string, share double, rank int")


def normal_sums(frame: DataFrame, group: list[str], features: list[str], target: str) -> DataFrame:
    """(group, sums): the normal equations of a group as one array of sums, and its number of rows ``rows``."""
    one = [F.lit(1.0), *[F.col(c).cast("double") for c in features]]
    terms = [a * b for a in one for b in one] + [a * F.col(target).cast("double") for a in one]
    named = frame.select(*group, *[t.alias(f"t{i}") for i, t in enumerate(terms)])
    return named.groupBy(*group).agg(F.array(*[F.sum(f"t{i}") for i in range(len(terms))]).alias("sums"), F.count("*").alias("rows"))


def ridge_local(train: DataFrame, test: DataFrame, group: str, features: list[str], target: str, alpha: float, least: int) -> DataFrame:
    """(group, n, mae_global, mae_local) on test rows of a ridge over all rows and of one over the group's own, null below ``least`` rows."""
    k = len(features) + 1

    def solve(sums: pd.Series) -> pd.Series:
        penalty = alpha * np.eye(k)
        penalty[0, 0] = 1e-9  # the constant isn't shrunk
        return pd.Series([np.linalg.solve(np.asarray(s)[: k * k].reshape(k, k) + penalty, np.asarray(s)[k * k :]) for s in sums])

    w = F.pandas_udf(solve, "array<double>")
    local = normal_sums(train, [group], features, target).where(F.col("rows") >= least).select(group, w("sums").alias("local"))
    whole = normal_sums(train, [], features, target).where("rows > 0").select(w("sums").alias("whole"))
    x = test.select(group, F.array(F.lit(1.0), *[F.col(c).cast("double") for c in features]).alias("x"), F.col(target).cast("double").alias("y")).withColumn("k", F.lit(1))
    both = x.join(F.broadcast(whole.withColumn("k", F.lit(1))), "k").join(local, group, "left")  # the whole is one row
    miss = lambda c: F.abs(F.aggregate(F.zip_with("x", c, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) - F.col("y"))
    return both.groupBy(group).agg(F.count("*").alias("n"), F.avg(miss("whole")).alias("mae_global"), F.avg(F.when(F.col("local").isNotNull(), miss("local"))).alias("mae_local"))


def ridge_errors(train: DataFrame, test: DataFrame, keys: list[str], features: list[str], target: str, alpha: float, back: str | None = None) -> DataFrame:
    """(keys, n, mae) on test rows of one ridge over all training rows; with ``back``, a column that is added to the forecast of a change from it."""
    k, goal = len(features) + 1, F.col(target) - F.col(back) if back else F.col(target)

    def solve(sums: pd.Series) -> pd.Series:
        penalty = alpha * np.eye(k)
        penalty[0, 0] = 1e-9  # the constant isn't shrunk
        return pd.Series([np.linalg.solve(np.asarray(s)[: k * k].reshape(k, k) + penalty, np.asarray(s)[k * k :]) for s in sums])

    w = normal_sums(train.withColumn("goal_", goal), [], features, "goal_").where("rows > 0").select(F.pandas_udf(solve, "array<double>")("sums").alias("w_"))
    x = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in features])
    guess = F.aggregate(F.zip_with(x, "w_", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    scored = test.join(F.broadcast(w), F.lit(True)).withColumn("guess_", guess + F.col(back) if back else guess)  # one row of weights
    return scored.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.abs(F.least(F.greatest("guess_", F.lit(0.0)), F.lit(100.0)) - F.col(target))).alias("mae"))


def ridge_without(frame: DataFrame, group: str, features: list[str], target: str, alpha: float) -> DataFrame:
    """(group, n, mae): each group is forecast from the other groups' rows.

    The normal equations are sums, so those without a group are the whole less its own; a group's
    sums are one small matrix, and the whole is gathered in one row.
    """
    k = len(features) + 1
    one = [F.lit(1.0), *[F.col(c).cast("double") for c in features]]
    terms = [a * b for a in one for b in one] + [a * F.col(target) for a in one]
    rows = frame.select(group, F.array(*one).alias("x"), F.col(target).cast("double").alias("y"), *[t.alias(f"t{i}") for i, t in enumerate(terms)])
    names = [f"t{i}" for i in range(len(terms))]
    own = rows.groupBy(group).agg(F.array(*[F.sum(n) for n in names]).alias("own"))
    whole = own.agg(F.array(*[F.sum(F.col("own")[i]) for i in range(len(names))]).alias("whole")).withColumn("k", F.lit(1))

    def solve(own_: pd.Series, whole_: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(own_, whole_, strict=True):
            s = np.asarray(b, float) - np.asarray(a, float)
            penalty = alpha * np.eye(k)
            penalty[0, 0] = 1e-9  # the constant isn't shrunk
            out.append(np.linalg.solve(s[: k * k].reshape(k, k) + penalty, s[k * k :]))
        return pd.Series(out)

    w = F.pandas_udf(solve, "array<double>")
    weights = own.withColumn("k", F.lit(1)).join(F.broadcast(whole), "k").select(group, w("own", "whole").alias("w"))
    guess = F.aggregate(F.zip_with("x", "w", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return rows.select(group, "x", "y").join(weights, group).groupBy(group).agg(F.count("*").alias("n"), F.avg(F.abs(guess - F.col("y"))).alias("mae"))


def cross_sums(frame: DataFrame, group: str, features: list[str], target: str) -> DataFrame:
    """(group, s): the sums of all products of 1, the features and the target, row by row of their matrix; rows with a null are left out."""
    one = [F.lit(1.0), *[F.col(c).cast("double") for c in features], F.col(target).cast("double")]
    whole = frame.where(F.concat_ws("", *[F.when(F.col(c).isNull(), "x") for c in [*features, target]]) == "")
    named = whole.select(group, *[(a * b).alias(f"t{i}_{j}") for i, a in enumerate(one) for j, b in enumerate(one) if i <= j])
    cell = lambda i, j: f"t{min(i, j)}_{max(i, j)}"
    sums = named.groupBy(group).agg(*[F.sum(cell(i, j)).alias(cell(i, j)) for i in range(len(one)) for j in range(i, len(one))])
    return sums.select(group, F.array(*[cell(i, j) for i in range(len(one)) for j in range(len(one))]).alias("s"))


class RidgePath:
    """Ridge weights for every penalty from matrices of sums (..., k, k), by one eigendecomposition each; features are z-scored by the rows of those sums."""

    def __init__(self, s: np.ndarray):
        n = s[..., 0, 0]
        m = s[..., 0, 1:] / np.maximum(n, 1.0)[..., None]
        cov = s[..., 1:, 1:] - n[..., None, None] * (m[..., :, None] * m[..., None, :])
        sd = np.sqrt(np.maximum(np.diagonal(cov, axis1=-2, axis2=-1)[..., :-1], 0) / np.maximum(n - 1, 1)[..., None])
        used = sd > 1e-12 * (1 + np.abs(m[..., :-1]))  # a constant feature has no weight
        self.mean, self.sd, self.used = m, np.where(used, sd, 1.0), used
        both = used[..., :, None] & used[..., None, :]
        self.values, self.vectors = np.linalg.eigh(np.where(both, cov[..., :-1, :-1] / (self.sd[..., :, None] * self.sd[..., None, :]), 0))
        self.turned = (np.where(used, cov[..., :-1, -1] / self.sd, 0)[..., None, :] @ self.vectors)[..., 0, :]

    def weights(self, alpha: float | np.ndarray) -> np.ndarray:
        """The constant and a weight for each feature as it is; a penalty for all matrices or one for each."""
        scaled = self.turned / (np.maximum(self.values, 0) + np.asarray(alpha)[..., None])
        w = np.where(self.used, (self.vectors @ scaled[..., None])[..., 0], 0) / self.sd
        return np.concatenate([self.mean[..., -1:] - (self.mean[..., :-1] * w).sum(axis=-1, keepdims=True), w], axis=-1)


def squared_error(s: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The sums of squared errors of weights on the rows of matrices of sums."""
    v = np.concatenate([w, np.full((*w.shape[:-1], 1), -1.0)], axis=-1)
    return ((v[..., None, :] @ s)[..., 0, :] * v).sum(axis=-1)


def chosen(own: np.ndarray, parts: np.ndarray, fold: np.ndarray, alphas: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each group (its own sums, its fold) the penalty of the least error over the inner folds, all of them without the group's own rows, and the weights of all other rows."""
    rest, loss = parts.sum(axis=0) - own, np.zeros((len(own), len(alphas)))
    for k, part in enumerate(parts):
        held = part - np.where((fold == k)[:, None, None], own, 0)
        learnt = rest - held
        some = (held[:, 0, 0] >= 0.5) & (learnt[:, 0, 0] >= 1.5)
        path = RidgePath(learnt[some])
        loss[some] += np.stack([squared_error(held[some], path.weights(a)) for a in alphas], axis=1)
    best = np.asarray(alphas, float)[loss.argmin(axis=1)]
    return best, RidgePath(rest).weights(best)


def ridge_cv(frame: DataFrame, group: str, features: list[str], target: str, alphas: np.ndarray, folds: int = 5) -> DataFrame:
    """(group, n, alpha, rmse, mae): each group is forecast from the others by a ridge whose penalty is chosen by folds of those others.

    Groups are dealt to inner folds by their hash. All fits come from sums, one small matrix a group, so the rows are read once for them and once
    for the absolute error; the sums of the whole and of the folds are one row. Of equal losses the smallest penalty counts. With one group only there is nothing to learn from: no rows.
    """
    k = len(features) + 2
    own = cross_sums(frame, group, features, target).withColumn("fold", F.pmod(F.xxhash64(group), F.lit(folds)).cast("int"))
    added = F.array(*[F.sum(F.col("s")[i]) for i in range(k * k)])
    by_fold = own.groupBy("fold").agg(added.alias("p"))
    of = F.map_from_entries(F.collect_list(F.struct("fold", "p")))  # a matrix a fold
    none = F.array_repeat(F.lit(0.0), k * k)
    parts = by_fold.agg(F.flatten(F.array(*[F.coalesce(F.try_element_at(of, F.lit(f)), none) for f in range(folds)])).alias("parts"))

    def solve(own_: pd.Series, fold_: pd.Series, parts_: pd.Series) -> pd.Series:
        if not len(own_):
            return pd.Series([], dtype=object)
        s, inner = np.stack(own_.to_numpy()).reshape(-1, k, k), np.asarray(parts_.iloc[0]).reshape(folds, k, k)
        out = np.zeros((len(s), k + 1))
        some = (inner.sum(axis=0) - s)[:, 0, 0] >= 1.5  # there is something to learn from
        if some.any():
            out[some, 0], out[some, 2:] = chosen(s[some], inner, fold_.to_numpy()[some], alphas)
        out[:, 1] = np.sqrt(np.maximum(squared_error(s, out[:, 2:]), 0.0) / s[:, 0, 0])
        return pd.Series(list(out))

    fit = F.pandas_udf(solve, "array<double>")
    found = own.join(F.broadcast(parts), F.lit(True)).select(group, fit("s", "fold", "parts").alias("f")).where(F.col("f")[0] > 0)
    x = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in features])
    guess = F.aggregate(F.zip_with(x, F.slice("f", 3, k - 1), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    miss = frame.join(found, group).withColumn("miss_", F.abs(guess - F.col(target))).where("miss_ IS NOT NULL")
    return miss.groupBy(group).agg(F.count("*").alias("n"), F.min(F.col("f")[0]).alias("alpha"), F.min(F.col("f")[1]).alias("rmse"), F.avg("miss_").alias("mae"))


def inflation(frame: DataFrame, features: list[str]) -> DataFrame:
    """(feature, vif): how much each feature's variance grows by the others, the diagonal of the inverse of their correlations.

    One pass gives all correlations; the matrix is one row. Infinite where features determine one another, null for a constant one.
    """
    k = len(features)
    pairs = [(i, j) for i in range(k) for j in range(i)]
    x = [F.col(c).cast("double") for c in features]
    cell = lambda i, j: F.try_divide(F.covar_pop(x[i], x[j]), F.stddev_pop(x[i]) * F.stddev_pop(x[j]))
    r = frame.agg(*[cell(i, j).alias(f"r{i}_{j}") for i, j in pairs], F.count("*").alias("n"))

    def inverse(cells: pd.Series) -> pd.Series:
        out = []
        for c in cells:
            m = np.eye(k)
            for (i, j), v in zip(pairs, c, strict=True):
                m[i, j] = m[j, i] = np.nan if v is None else v
            some = [i for i in range(k) if k == 1 or not np.isnan(np.delete(m[i], i)).all()]
            vif = np.full(k, np.nan)
            if some:
                values, vectors = np.linalg.eigh(np.nan_to_num(m[np.ix_(some, some)]))
                with np.errstate(divide="ignore", invalid="ignore"):
                    safe = np.where(values > 1e-12, values, 0.0)
                    vif[some] = np.nansum(np.where(vectors**2 > 1e-18, vectors**2 / safe, 0), axis=1)
            out.append([None if np.isnan(v) else float(v) for v in vif])
        return pd.Series(out)

    one = r.select(F.pandas_udf(inverse, "array<double>")(F.array(*[f"r{i}_{j}" for i, j in pairs]) if pairs else F.array().cast("array<double>")).alias("v"))
    return one.select(F.posexplode("v").alias("i", "vif")).select(F.element_at(F.array(*map(F.lit, features)), F.col("i") + 1).alias("feature"), "vif")
