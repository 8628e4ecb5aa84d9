"""Row flags, gaps, error codes, digests and runs of hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timegrid import micros


def bad_flags(park: str = "park", cells: str = "cells") -> dict[str, Column]:
    """The four causes of a bad observation; a missing count is no other cause."""
    p, c = F.col(park), F.col(cells)
    return {"negative": p < 0, "over_capacity": p > c, "bad_cells": c.isNull() | (c <= 0), "missing": p.isNull()}


def gaps(obs: DataFrame, longer: float) -> DataFrame:
    """(lot, intervals, median_minutes, gaps, gap_minutes) between a lot's distinct times."""
    w = Window.partitionBy("lot").orderBy("ts")
    m = obs.select("lot", "ts").distinct().select("lot", ((micros("ts") - micros(F.lag("ts").over(w))) / 60_000_000).alias("m"))
    return m.groupBy("lot").agg(F.count("m").alias("intervals"), F.median("m").alias("median_minutes"), F.count_if(F.col("m") > longer).alias("gaps"), F.coalesce(F.sum(F.when(F.col("m") > longer, F.col("m"))), F.lit(0.0)).alias("gap_minutes"))


def error_codes(frame: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """A row for each check that a row fails; an unknown check passes."""
    codes = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))
    return frame.withColumn("code", F.explode(codes))


def digest(frame: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, n, digest): rows in any order give the same digest."""
    row = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns])), 1, 8), 16, 10).cast("decimal(38,0)")
    return frame.groupBy(*keys).agg(F.count("*").alias("n"), (F.sum(row) % 1_000_000_007).cast("long").alias("digest"))


def islands(hours: DataFrame, keys: list[str], step: int) -> DataFrame:
    """(keys, windows): runs of neighbouring parts ``h`` of the day, joined as text."""
    k = hours.withColumn("k", F.col("h") - F.row_number().over(Window.partitionBy(*keys).orderBy("h")))
    two = lambda c: F.concat(F.lpad((c * step).cast("string"), 2, "0"), F.lit(":00"))
    runs = k.groupBy(*keys, "k").agg(F.concat(two(F.min("h")), F.lit("-"), two(F.max("h") + 1)).alias("w"))
    return runs.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("w")), "|").alias("windows"))
