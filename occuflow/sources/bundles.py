"""Model bundles: what a forecast needs, saved by version; a version counts from its manifest row on, which is written last.

Readers take the newest version that is whole and keep the one that they have where the newest isn't.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.boosting import Forest, Tree

FOREST = "quantile int, round int, feature array<int>, cut array<int>, leaf array<double>"


@dataclass
class Bundle:
    """A loaded version. ``adjustments`` widen intervals by key, ``gate`` says which keys may show one; ``error`` names what kept a newer version out."""

    version: str
    features: list[str]
    forest: Forest
    chance: Forest | None
    curve: LogisticRegressionModel | None
    adjustments: dict[str, float]
    gate: dict[str, bool]
    error: str | None = None

    def quantiles(self) -> Column:
        return self.forest.column(self.features)


def rows_of(forest: Forest) -> list[tuple]:
    return [(a, k, list(map(int, t.feature)), list(map(int, t.cut)), list(map(float, t.leaf))) for a, trees in enumerate(forest.trees) for k, t in enumerate(trees)]


def shape_of(forest: Forest) -> str:
    return json.dumps({"alphas": forest.alphas, "edges": forest.edges, "base": forest.base, "depth": forest.depth, "rate": forest.rate, "span": forest.span})


def forest_of(shape: str, rows: list) -> Forest:
    s = json.loads(shape)
    trees: list[list[Tree]] = [[] for _ in s["alphas"]]
    for r in sorted(rows, key=lambda r: (r["quantile"], r["round"])):
        trees[r["quantile"]].append(Tree(list(r["feature"]), list(r["cut"]), list(r["leaf"])))
    return Forest(s["alphas"], s["edges"], s["base"], trees, s["depth"], s["rate"], s["span"])


def publish(spark: SparkSession, folder: str, bundle: Bundle) -> None:
    """Write a version; one that exists already or has no trees is refused. Trees are few thousand rows at most."""
    if not any(bundle.forest.trees) or not bundle.features:
        raise ValueError("a bundle needs trees and features")
    at = f"{folder}/{bundle.version}"
    forests = {"forest": bundle.forest} | ({"chance": bundle.chance} if bundle.chance else {})
    for name, forest in forests.items():
        spark.createDataFrame(rows_of(forest), FOREST).coalesce(1).write.parquet(f"{at}/{name}")
    if bundle.curve is not None:
        bundle.curve.write().save(f"{at}/curve")
    says = {"features": bundle.features, "adjustments": bundle.adjustments, "gate": bundle.gate, "curve": bundle.curve is not None}
    shapes = {name: {"shape": shape_of(f), "trees": len(rows_of(f))} for name, f in forests.items()}
    manifest = spark.createDataFrame([(bundle.version, json.dumps(says), json.dumps(shapes))], "version string, says string, shapes string")
    manifest.withColumn("published", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")


def read(spark: SparkSession, folder: str, version: str, says: str, shapes: str) -> Bundle:
    """A version by its manifest row; raises if a part is missing or not whole."""
    says, forests = json.loads(says), {}
    for name, s in json.loads(shapes).items():
        rows = spark.read.schema(FOREST).parquet(f"{folder}/{version}/{name}").collect()
        if len(rows) != s["trees"] or not rows:
            raise ValueError(f"{name} of {version} has {len(rows)} trees, not {s['trees']}")
        forests[name] = forest_of(s["shape"], rows)
    curve = LogisticRegressionModel.load(f"{folder}/{version}/curve") if says["curve"] else None
    return Bundle(version, says["features"], forests["forest"], forests.get("chance"), curve, says["adjustments"], says["gate"])


def load(spark: SparkSession, folder: str, last: Bundle | None = None) -> Bundle | None:
    """The newest whole version; ``last``, with what was wrong as its error, if all newer ones are broken; None where nothing was ever whole."""
    error = None
    try:
        versions = spark.read.parquet(f"{folder}/manifest").orderBy(F.desc("published"), F.desc("version")).collect()  # a row a version
    except Exception as e:  # noqa: BLE001  no manifest yet, or one that can't be read: the reader goes on with what it has
        versions, error = [], type(e).__name__
    for v in versions:
        if last is not None and v["version"] == last.version:
            break
        try:
            got = read(spark, folder, v["version"], v["says"], v["shapes"])
            got.error = error
            return got
        except Exception as e:  # noqa: BLE001  any fault of a version only keeps that version out
            error = error or f"{v['version']}: {type(e).__name__}"
    if last is not None:
        last.error = error
    return last


def forecast(df: DataFrame, bundle: Bundle, now: str = "occ_now", most: float = 100.0) -> DataFrame:
    """Rows with ``p10``, ``p50`` and ``p90``: what the trees say of the change, added to now, between 0 and ``most``."""
    q = F.transform(bundle.quantiles(), lambda d: F.least(F.greatest(d + F.col(now), F.lit(0.0)), F.lit(most)))
    out = df.withColumn("q_", q)
    return out.withColumns({n: F.col("q_")[i] for i, n in enumerate(("p10", "p50", "p90"))}).drop("q_").withColumn("model_version", F.lit(bundle.version))
