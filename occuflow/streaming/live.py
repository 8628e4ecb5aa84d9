"""The last slots of each lot as stream state: features of the present, kept up to date batch by batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.timegrid import at_minute, micros
from .windows import polls, run

#: Slots that are kept of a lot: the present one and those of its lags.
SLOTS = 13
LAGS, MEANS = (1, 2, 3, 6, 12), (3, 6, 12)
NUMBERS = ["last", "slots", "occ_now", *(f"lag_{k}" for k in LAGS), *(f"roll_mean_{w}" for w in MEANS)]
OUT = "lot long, seen long, last long, " + ", ".join(f"{c} double" for c in NUMBERS[1:])
STATE = "slot array<long>, at array<long>, id array<long>, value array<double>"


def kept(held: pd.DataFrame) -> pd.DataFrame:
    """The last row of each of the last slots. A row met twice, or one older than the slots, changes nothing, so rows may come in any order."""
    newest = held.sort_values(["at", "id"]).drop_duplicates("slot", keep="last")
    return newest[newest["slot"] > newest["slot"].max() - SLOTS]


def features(held: pd.DataFrame) -> list[float]:
    """Numbers of the newest slot; a missing slot is null, and a mean is over what is there."""
    last = int(held["slot"].max())
    by = dict(zip(held["slot"], held["value"]))
    value = lambda k: by.get(last - k, np.nan)
    means = [np.nanmean([value(k) for k in range(w)]) for w in MEANS]
    return [last, float(len(by)), value(0), *(value(k) for k in LAGS), *means]


def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    parts = [pd.DataFrame(dict(zip(("slot", "at", "id", "value"), state.get)))] if state.exists else []
    for pdf in batches:
        parts = [kept(pd.concat([*parts, pdf[["slot", "at", "id", "value"]]]))]
    held = parts[0]
    state.update(tuple(held[c].tolist() for c in ("slot", "at", "id", "value")))
    yield pd.DataFrame([(key[0], int(held["at"].max()), *features(held))], columns=["lot", "seen", *NUMBERS])


def slotted(events: DataFrame, step: int) -> DataFrame:
    us = micros("ts")
    return events.where("user_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL").select(
        F.col("user_id").cast("long").alias("lot"), F.floor(us / (step * 60_000_000)).cast("long").alias("slot"), us.alias("at"), F.col("event_id").cast("long").alias("id"), F.col("value").cast("double").alias("value"),
    )


def live(spark: SparkSession, sf_dir: str, step: int, per_batch: int | None = None) -> DataFrame:
    """(lot, last_slot, slots, occ_now, lags, means, ready) after all files that are there.

    The state of a lot is its last slots, however long the stream; no watermark drops a row, as rows before those slots don't count anyway.
    A lot is ready if its newest slot is the stream's newest or the one before and none of its numbers is missing.
    """
    keyed = slotted(polls(spark, sf_dir, per_batch=per_batch), step).groupBy("lot")
    rows = run(keyed.applyInPandasWithState(update, OUT, STATE, "update", GroupStateTimeout.NoTimeout), ["lot"], ["seen", *NUMBERS], "update")
    now = rows.agg(F.max("last")).first()[0]
    whole = F.lit(True)
    for c in NUMBERS[2:]:
        whole = whole & ~F.isnan(c) & F.col(c).isNotNull()
    number = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return rows.select("lot", at_minute(F.col("last") * step).alias("last_slot"), F.col("slots").cast("long").alias("slots"), *[number(c) for c in NUMBERS[2:]], (whole & (F.col("last") >= (now or 0) - 1)).alias("ready"))
