"""Slots and regular grids of irregular observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 on the wall clock of a timestamp without zone."""
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH), F.col(ts) if isinstance(ts, str) else ts)


def at_minute(minutes: Column) -> Column:
    return F.timestamp_add("MINUTE", minutes.cast("int"), F.expr(EPOCH))


def floor_slot(ts: Column | str, step: int) -> Column:
    """Start of the slot of so many minutes."""
    return at_minute(F.floor(micros(ts) / F.lit(step * 60_000_000)) * step)


def ceil_slot(ts: Column | str, step: int) -> Column:
    """End of the slot; a time on a boundary stays."""
    return at_minute(F.ceil(micros(ts) / F.lit(step * 60_000_000)) * step)


def occupancy(policy: str, park: str = "park", cells: str = "cells") -> Column:
    """Percent of cells taken. Policies: ``drop`` (invalid is null), ``clip120``, ``clip100``; ``ratio1`` and ``ratio1.2`` are shares."""
    share = F.try_divide(F.col(park) * 100.0, F.when(F.col(cells) > 0, F.col(cells)))
    if policy == "drop":
        return F.when((F.col(park) >= 0) & (F.col(park) <= F.col(cells)), share)
    most = {"clip120": 120.0, "clip100": 100.0, "ratio1": 100.0, "ratio1.2": 120.0}[policy]
    # greatest and least skip nulls, so a missing value is kept apart
    out = F.when(share.isNotNull(), F.least(F.greatest(share, F.lit(0.0)), F.lit(most)))
    return out / 100 if policy.startswith("ratio") else out


def invalid() -> Column:
    """No capacity, no count, a negative count, or more cars than cells."""
    return F.col("cells").isNull() | (F.col("cells") <= 0) | F.col("park").isNull() | (F.col("park") < 0) | (F.col("park") > F.col("cells"))


def grid_last(obs: DataFrame, step: int, policy: str = "drop", common: bool = False) -> DataFrame:
    """(lot, ts, occ): the last valid value of each slot, at the slot's end, on every slot from a lot's first to its last observation.

    Invalid observations span the grid but fill no slot; ``common`` spans all lots alike. Nothing is filled.
    """
    placed = obs.select("lot", ceil_slot("ts", step).alias("slot"), "ts", "event_id", occupancy(policy).alias("occ"))
    last = placed.where("occ IS NOT NULL").groupBy("lot", "slot").agg(F.max_by("occ", F.struct("ts", "event_id")).alias("occ"))
    return spanned(placed, last, step, common)


def grid_mean(obs: DataFrame, step: int, policy: str = "clip120") -> DataFrame:
    """(lot, ts, occ): the mean of each slot, at its start."""
    placed = obs.select("lot", floor_slot("ts", step).alias("slot"), occupancy(policy).alias("occ"))
    return spanned(placed, placed.groupBy("lot", "slot").agg(F.avg("occ").alias("occ")), step, False)


def spanned(placed: DataFrame, values: DataFrame, step: int, common: bool) -> DataFrame:
    span = placed.groupBy("lot").agg(F.min("slot").alias("lo"), F.max("slot").alias("hi"))
    if common:
        ends = placed.agg(F.min("slot").alias("lo"), F.max("slot").alias("hi")).withColumn("k", F.lit(1))
        span = span.select("lot", F.lit(1).alias("k")).join(F.broadcast(ends), "k").drop("k")  # one row of bounds
    slots = span.select("lot", F.explode(F.sequence("lo", "hi", F.expr(f"INTERVAL {step} MINUTES"))).alias("slot"))
    return slots.join(values, ["lot", "slot"], "left").withColumnRenamed("slot", "ts")


def interpolate_one(grid: DataFrame, step: int) -> DataFrame:
    """Fill the first missing slot of each gap on the line between its ends; nothing after the last value."""
    w = Window.partitionBy("lot")
    here = F.when(F.col("occ").isNotNull(), F.struct("ts", "occ"))
    upto = lambda order: F.last(here, True).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    both = grid.withColumn("p", upto(F.asc("ts"))).withColumn("n", upto(F.desc("ts")))
    minutes = lambda a, b: F.timestamp_diff("MINUTE", F.col(a), F.col(b))
    line = F.col("p.occ") + (F.col("n.occ") - F.col("p.occ")) * step / minutes("p.ts", "n.ts")
    fill = F.when((minutes("p.ts", "ts") == step) & F.col("n").isNotNull(), line)
    return both.select("lot", "ts", F.coalesce("occ", fill).alias("occ"))
