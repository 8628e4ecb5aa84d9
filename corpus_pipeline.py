"""The corpus pipeline: quality, near duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of ``documents``. Work tables go to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from occuflow.llm import decontamination, jaccard_join, packing, quality, secrets
from occuflow.llm.common import shared_folder, staged, table

#: Ids to drop up to this many are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000


#: What decides about a row: a hash of its id and text. So rows that share an id, or have none, are judged each by its own text.
KEY, SCORE = "_pipeline_key", "_pipeline_score"


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn(KEY, F.xxhash64("doc_id", "text"))


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of other keys, in the columns they had."""
    few = keys.count() <= BROADCAST_ROWS
    return keyed(docs).join(F.broadcast(keys) if few else keys, KEY, "left_anti").drop(KEY)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the weak-label scorer rejects, and texts without words. Repeated rows are judged alike; an empty table stays empty."""
    _, scorer = quality.train(docs, shared_folder(spark))
    return quality.judge(docs, scorer, SCORE).where(F.col(SCORE) >= quality.KEEP).drop(SCORE)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of the Jaccard join at its query's setting: that of the smallest id, one without an id only if all are.

    Of rows that agree in id and text one stays; texts without words link with nothing.
    """
    folder = shared_folder(spark)
    rows = keyed(docs)
    groups = staged(jaccard_join.jaccard_components(rows.select(F.col(KEY).alias("doc_id"), "text"), f"{folder}/join"), folder, "groups")
    ids = rows.select(KEY, "doc_id").distinct().join(groups.select(F.col("doc_id").alias(KEY), "component_id"), KEY)
    kept = ids.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", KEY))[KEY].alias(KEY), F.count("*").alias("c")).where("c > 1")
    copies = staged(ids.join(kept.select("component_id"), "component_id").select(KEY).join(kept.select(KEY), KEY, "left_anti"), folder, "copies")
    repeated = staged(rows.groupBy(KEY).count().where("count > 1").select(KEY), folder, "repeated")
    left = keyed(without(docs, copies))
    if not repeated.limit(1).count():
        return left.drop(KEY)
    several = F.broadcast(repeated) if repeated.count() <= BROADCAST_ROWS else repeated
    return left.join(several, KEY, "left_anti").union(left.join(several, KEY, "left_semi").dropDuplicates([KEY])).drop(KEY)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item; null texts hold none, and an empty benchmark drops nothing."""
    folder = shared_folder(spark)
    rows = keyed(docs).select(F.col(KEY).alias("doc_id"), "text")
    found = decontamination.contaminations(rows, table(spark, sf_dir, "benchmark"), folder)
    return without(docs, staged(found.select(F.col("doc_id").alias(KEY)).distinct(), folder, "contaminated"))


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every span of the secret scan by its kind in brackets; all rows stay, null texts as they are."""
    return secrets.masked(docs, shared_folder(spark))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and batches of what is left; a text without tokens is one piece of length 0."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("secret scans", secrets_masked),
    ("packing", packed),
]

#: SQL can't express the trained and iterative stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again in the shared folder. An empty table gives no rows; further columns pass through all stages but the last."""
    folder = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
    return docs
