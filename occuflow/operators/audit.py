"""Findings of a data audit, features without information, and inserts that keep the first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .timegrid import micros


def gaps(times: DataFrame, ts: str = "ts") -> DataFrame:
    """(ts, minutes): the distance of each distinct time from the one before; the first has none.

    Days are the tasks; a day's first time is compared with the last of the days before, of which there is one row each.
    """
    each = times.select(ts).where(F.col(ts).isNotNull()).distinct().withColumn("day_", F.to_date(ts))
    ends = each.groupBy("day_").agg(F.max(ts).alias("last_"))
    carried = ends.select("day_", F.max("last_").over(Window.orderBy("day_").rowsBetween(Window.unboundedPreceding, -1)).alias("carried_"))
    inside = F.lag(ts).over(Window.partitionBy("day_").orderBy(ts))
    return each.join(carried, "day_").select(ts, ((micros(ts) - micros(F.coalesce(inside, F.col("carried_")))) / 60_000_000).alias("minutes"))


def findings(obs: DataFrame, hours: int, tolerance: float, interval: float, jump: float, within: float, still: float, least: int) -> DataFrame:
    """(code, n, fails) of the last so many hours of observations (lot, ts, park, cells).

    ``polling_gap``: distances of snapshots above the tolerance; ``snapshot_shortfall``: fewer than nine tenths of what the interval promises; ``over_capacity``: rows;
    ``step_change``: changes of the share above ``jump`` within so many minutes; ``frozen_count``: lots of ``least`` rows or more whose share moves less than ``still``, told but no failure;
    without any row ``no_data`` alone. Findings of none are left out, but for the frozen lots.
    """
    now = obs.agg(F.max("ts")).first()[0]
    if now is None:
        return obs.sparkSession.createDataFrame([("no_data", 1, True)], "code string, n long, fails boolean")
    late = obs.where(F.col("ts") >= F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {hours} HOURS"))
    polls = gaps(late).agg(F.count("*").alias("snapshots"), F.count_if(F.col("minutes") > tolerance).alias("polling_gap"))
    share = F.try_divide(F.col("park") * 1.0, F.col("cells"))
    w = Window.partitionBy("lot").orderBy("ts", "park")
    known = late.where("cells > 0").select("lot", "ts", "park", "cells", share.alias("share"))
    steps = known.withColumns({"change": F.abs(F.col("share") - F.lag("share").over(w)), "elapsed": (micros("ts") - micros(F.lag("ts").over(w))) / 60_000_000})
    lots = steps.groupBy("lot").agg(
        F.count_if(F.col("park") > F.col("cells")).alias("over"), F.count_if((F.col("change") > jump) & (F.col("elapsed") <= within)).alias("steps"), ((F.max("share") - F.min("share") < still) & (F.count("*") >= least)).cast("long").alias("frozen")
    )
    of_lots = lots.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("over", "over_capacity"), ("steps", "step_change"), ("frozen", "frozen_count"))])
    x = polls.join(F.broadcast(of_lots), F.lit(True))  # one row each
    short = (F.col("snapshots") < hours * 60 / interval * 0.9).cast("long")
    rows = [("polling_gap", F.col("polling_gap")), ("snapshot_shortfall", short), *[(c, F.col(c)) for c in ("over_capacity", "step_change", "frozen_count")]]
    each = F.array(*[F.struct(F.lit(c).alias("code"), n.cast("long").alias("n"), F.lit(c != "frozen_count").alias("fails")) for c, n in rows])
    return x.select(F.explode(each).alias("x")).select("x.*").where("n > 0 OR code = 'frozen_count'")


def informative(df: DataFrame, columns: list[str], within=None) -> DataFrame:
    """The frame without those of the columns that are constant, or always null, on the rows of ``within``; one pass decides."""
    rows = df.where(within) if within is not None else df
    seen = rows.agg(*[(F.max(c) > F.min(c)).alias(c) for c in columns]).first()
    return df.drop(*[c for c in columns if not seen[c]])


def insert_first(batches: list[DataFrame], key: list[str], order: str) -> DataFrame:
    """The union of batches by a composite key: the earliest batch's row stays, in a batch that of the least ``order``; nulls in a key are equal."""
    every = None
    for i, b in enumerate(batches):
        one = b.withColumn("batch_", F.lit(i))
        every = one if every is None else every.unionByName(one)
    rest = [c for c in batches[0].columns if c not in (*key, order)]
    first = every.groupBy(*key).agg(F.min(F.struct("batch_", order, *rest)).alias("x"))
    return first.select(*key, *[f"x.{c}" for c in batches[0].columns if c not in key], F.col("x.batch_").alias("batch"))
