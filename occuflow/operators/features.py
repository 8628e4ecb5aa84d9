"""Features of a regular grid (lot, ts, occ): all frames count slots, so the grid must have no holes.

Frames are bounded, so a lot's history is cut into pieces, and each piece has the slots before and after it that its frames reach:
``windowed`` does both, and no task sorts a whole history.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timegrid import micros


DAY = 86_400_000_000


def by_piece():
    return Window.partitionBy("lot", "piece").orderBy("ts")


def windowed(grid: DataFrame, step: int, columns: dict[str, Column], back: int = 0, ahead: int = 0) -> DataFrame:
    """The grid with columns over its windows, which reach ``back`` slots before and ``ahead`` slots after a slot of ``step`` minutes.

    Pieces are a day long, or eight times the reach where that is more, so at most an eighth of the slots is in two pieces.
    """
    slot, us = step * 60_000_000, micros("ts")
    width = max(DAY, 8 * max(back, ahead) * slot)
    piece = lambda shift: F.floor((us + shift) / width)
    cut = grid.withColumn("piece", F.explode(F.sequence(piece(-ahead * slot), piece(back * slot)))).withColumn("own", F.col("piece") == piece(0))
    return cut.withColumns(columns).where("own").drop("piece", "own")


def lag(k: int, c: str = "occ") -> Column:
    return F.lag(c, k).over(by_piece())


def rolling_mean(w: int, full: bool = False, c: str = "occ") -> Column:
    """Mean of the last w slots; ``full`` wants all of them present, else one is enough."""
    frame = by_piece().rowsBetween(-(w - 1), 0)
    mean = F.avg(c).over(frame)
    return F.when(F.count(c).over(frame) == w, mean) if full else mean


def past_complete(slots: int) -> Column:
    """The last so many slots, this one included, are present."""
    return F.count("occ").over(by_piece().rowsBetween(-(slots - 1), 0)) == slots


def future_complete(steps: int) -> Column:
    """This slot and the next so many are present."""
    return F.count("occ").over(by_piece().rowsBetween(0, steps)) == steps + 1


def recently(flag: Column, slots: int) -> Column:
    return F.max(flag.cast("int")).over(by_piece().rowsBetween(-(slots - 1), 0)) == 1


def minute_of_day(ts: str = "ts") -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def day_group(ts: str = "ts", holiday: Column | None = None) -> Column:
    sunday = F.weekday(ts) == 6
    return F.when(sunday | holiday if holiday is not None else sunday, "sunday_holiday").when(F.weekday(ts) == 5, "saturday").otherwise("weekday")


def cyclic(x: Column, period: float) -> tuple[Column, Column]:
    turn = x * (2 * math.pi / period)
    return F.sin(turn), F.cos(turn)


def operating(pos: Column, start: Column, end: Column, sunday: Column) -> dict[str, Column]:
    """Operating features at a minute of the day.

    A missing window is the whole day, an empty one is closed, one that ends before it starts passes midnight.
    """
    a, b = F.coalesce(start, F.lit(0)), F.coalesce(end, F.lit(1440))
    b = F.when(b < a, b + 1440).otherwise(b)
    closed = a == b
    at = F.when((pos >= a) & (pos < b), pos).when((b > 1440) & (pos + 1440 < b), pos + 1440)
    inside = ~closed & at.isNotNull()
    return {
        "is_operating": inside.cast("int"),
        "min_to_open": F.when(closed, 1440).when(inside, 0).when(pos < a, a - pos).otherwise(1440),
        "min_to_close": F.when(inside, b - at).otherwise(0),
        "is_free_now": (~inside | sunday).cast("int"),
    }


def features(grid: DataFrame, step: int, lags=(1, 2, 3, 6, 12), deltas=(1, 3, 6), means=(3, 6, 12)) -> DataFrame:
    """Lags, deltas, rolling means and clock features of every slot."""
    out = windowed(grid, step, {f"lag_{k}": lag(k) for k in lags} | {f"roll_mean_{w}": rolling_mean(w) for w in means}, max(*lags, *means))
    sin, cos = cyclic(minute_of_day(), 1440)
    return out.withColumns({f"delta_{k}": F.col("occ") - F.col(f"lag_{k}") for k in deltas} | {"minute_of_day": minute_of_day(), "dow": F.weekday("ts"), "hour_sin": sin, "hour_cos": cos})
