"""Structured Streaming over event files: drop repeated polls, then count in windows."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def work_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a temporary one where that is unset and all runs in this process, as in tests."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = Path(tempfile.gettempdir(), "occuflow-streams").as_uri()
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def polls(spark: SparkSession, sf_dir: str, name: str = "events.parquet", per_batch: int | None = None) -> DataFrame:
    """Files as a stream, ``per_batch`` a batch or all that are there."""
    schema = spark.read.parquet(f"{sf_dir}/{name}").schema
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).parquet(f"{sf_dir}/{name}*")


def span(spark: SparkSession, sf_dir: str, name: str = "events.parquet") -> str:
    """How late a row can be if files come in any order: the time from the table's first row to its last."""
    lo, hi = spark.read.parquet(f"{sf_dir}/{name}").agg(F.min("ts"), F.max("ts")).first()
    return f"{int((hi - lo).total_seconds()) + 1 if hi else 1} seconds"


def run(counted: DataFrame, keys: list[str], columns: list[str], mode: str) -> DataFrame:
    """Run a windowed stream over all that is there, and return the last version of each window (keys).

    Batches write what changed (``update``) or all (``complete``) with their number. A replayed batch writes the same folder again, so results are
    the same after a restart.
    """
    spark, folder = counted.sparkSession, work_folder(counted.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        batch.select(*keys, *columns).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    stream = counted.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(write).trigger(availableNow=True).start()
    stream.awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    if mode == "complete":
        newest = out.agg(F.max("batch").alias("batch"))
        return out.join(F.broadcast(newest), "batch").select(*keys, *columns)  # one row
    last = out.groupBy(*keys).agg(F.max_by(F.struct(*columns), "batch").alias("x"))
    return last.select(*keys, *[f"x.{c}" for c in columns])


def fresh(spark: SparkSession, sf_dir: str, late: str | None, per_batch: int | None = None) -> DataFrame:
    """Polls without repetitions. Rows later than ``late`` behind the newest are lost; None is the span of the table, so none is, in any order of files."""
    late = late or span(spark, sf_dir)
    return polls(spark, sf_dir, per_batch=per_batch).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def start() -> Column:
    return F.col("w.start").cast("timestamp_ntz").alias("start")


def tumbling(spark: SparkSession, sf_dir: str, width: str, late: str | None = None, per_batch: int | None = None) -> DataFrame:
    """(event_type, start, n, total)."""
    counted = fresh(spark, sf_dir, late, per_batch).groupBy("event_type", F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return run(counted.select("event_type", start(), "n", "total"), ["event_type", "start"], ["n", "total"], "update")


def sliding(spark: SparkSession, sf_dir: str, width: str, step: str, late: str | None = None, per_batch: int | None = None) -> DataFrame:
    """(event_type, start, n, total) of overlapping windows; sums of hundredths are exact, so they don't depend on the order of rows."""
    counted = fresh(spark, sf_dir, late, per_batch).groupBy("event_type", F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))
    return run(counted.select("event_type", start(), "n", "total"), ["event_type", "start"], ["n", "total"], "update")


def sessions(spark: SparkSession, sf_dir: str, gap: str, late: str | None = None, per_batch: int | None = None) -> DataFrame:
    """(user_id, start, n) of runs of polls with gaps below ``gap``; sessions may grow together, so all are written each time."""
    counted = fresh(spark, sf_dir, late, per_batch).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return run(counted.select("user_id", start(), "n"), ["user_id", "start"], ["n"], "complete")
