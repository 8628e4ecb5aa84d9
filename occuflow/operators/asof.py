"""As-of joins by one union and one window, and exact-offset joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .timegrid import micros

DAY = 86_400_000_000


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], value: str, tolerance_s: float | None, direction: str = "backward", ts: str = "ts") -> DataFrame:
    """Left rows with ``value`` and ``r_ts`` of the right row at or before them (``backward``), at or after (``forward``) or ``nearest``.

    Both sides are tagged, united and sorted once by key and time: n log n, no pairs. Of equal right times the
    largest value counts. Beyond the tolerance the match is null; on a tie of distances the earlier row wins.
    With a tolerance, a key's history is cut into pieces of a day (or of the tolerance, where that is longer), and right rows near an edge
    are given to the piece that can match them too: tasks are as many as keys and days, and none sorts a whole history. Rows without a time match nothing.
    """
    cols = left.columns
    kind = dict(right.dtypes)[value]
    r = right.select(*keys, ts, F.lit(0).alias("side_"), F.struct(F.col(ts).alias("t"), F.col(value).alias("v")).alias("r_"), *[F.lit(None).cast(t).alias(c) for c, t in left.dtypes if c not in keys and c != ts])
    l_ = left.select(*keys, ts, F.lit(1).alias("side_"), F.lit(None).cast(f"struct<t:timestamp_ntz,v:{kind}>").alias("r_"), *[c for c in cols if c not in keys and c != ts])
    if tolerance_s is not None:
        reach, width = int(tolerance_s * 1_000_000), max(int(tolerance_s * 1_000_000), DAY)
        piece = lambda shift: F.floor((micros(ts) + shift) / width)
        first, last = (0 if direction == "backward" else -reach), (0 if direction == "forward" else reach)
        r = r.where(F.col(ts).isNotNull()).withColumn("piece_", F.explode(F.sequence(piece(first), piece(last))))
        l_ = l_.withColumn("piece_", piece(0))
        keys = [*keys, "piece_"]
    both = l_.unionByName(r)
    by = Window.partitionBy(*keys)
    before = by.orderBy(ts, "side_", "r_.v").rowsBetween(Window.unboundedPreceding, 0)
    # the next right row is the last one in falling order: a frame that grows is summed up once, one that shrinks anew for each row
    after = by.orderBy(F.desc(ts), "side_", "r_.v").rowsBetween(Window.unboundedPreceding, 0)
    if direction in ("backward", "nearest"):
        both = both.withColumn("b_", F.last("r_", True).over(before))
    if direction in ("forward", "nearest"):
        both = both.withColumn("f_", F.last("r_", True).over(after))
    out = both.where("side_ = 1")
    gap = lambda c: F.abs(micros(f"{c}.t") - micros(ts))
    if direction == "nearest":
        hit = F.when(F.col("f_").isNull() | (gap("b_") <= gap("f_")), F.col("b_")).otherwise(F.col("f_"))
    else:
        hit = F.col("b_" if direction == "backward" else "f_")
    out = out.withColumn("m_", hit)
    if tolerance_s is not None:
        out = out.withColumn("m_", F.when(gap("m_") <= int(tolerance_s * 1_000_000), F.col("m_")))
    return out.select(*cols, F.col("m_.t").alias("r_ts"), F.col("m_.v").alias(value if value not in cols else f"r_{value}"))


def offset_join(left: DataFrame, lookup: DataFrame, keys: list[str], at: str, minutes: int, value: str, name: str) -> DataFrame:
    """``value`` exactly so many minutes before ``at``, never the nearest: an equi-join, so history of any gaps gives no wrong match."""
    past = lookup.select(*keys, F.timestamp_add("MINUTE", F.lit(minutes), F.col("ts")).alias(at), F.col(value).alias(name))
    return left.join(past, [*keys, at], "left")


def asof_series(left: DataFrame, series: DataFrame, time: str = "ts") -> DataFrame:
    """Left rows with ``r_ts`` and ``v`` of the latest row of a series (r_ts, v) that has no key and isn't later.

    Days are the tasks: inside a day rows are ordered by time, and each day starts from the last value of the days before it,
    taken over one row a day.
    """
    day = lambda c: F.to_date(c).alias("day")
    value = F.struct("r_ts", "v")
    last = series.groupBy(day("r_ts")).agg(F.max(value).alias("last"))
    days = left.select(day(time)).union(series.select(day("r_ts"))).distinct().join(last, "day", "left")
    before = days.select("day", F.max("last").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    columns = left.columns
    rows = left.select(day(time), F.col(time).alias("at"), F.lit(1).alias("side"), F.struct(*columns).alias("row"), F.lit(None).cast(series.select(value.alias("x")).schema["x"].dataType).alias("x"))
    more = series.select(day("r_ts"), F.col("r_ts").alias("at"), F.lit(0).alias("side"), F.lit(None).cast(rows.schema["row"].dataType).alias("row"), value.alias("x"))
    inside = F.last("x", ignorenulls=True).over(Window.partitionBy("day").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0))
    found = rows.union(more).withColumn("x", inside).where("side = 1").join(before, "day").select("row.*", F.coalesce("x", "carried").alias("x"))
    return found.select(*columns, "x.r_ts", "x.v")


def nearest_in_window(asked: DataFrame, rows: DataFrame, keys: list[str], values: list[str], window_s: float, time: str = "at", ts: str = "ts") -> DataFrame:
    """Asked rows (keys, time) with the values of the nearest row at most so many seconds away, its time as ``r_ts`` and the distance ``seconds``; nulls if there is none.

    Of rows equally near the earlier counts, of equal times the larger values.
    """
    both = rows.select(*keys, ts, F.struct(*values).alias("v_")).withColumnRenamed(ts, time)
    found = asof_join(asked, both, keys, "v_", window_s, "nearest", time)
    return found.select(*asked.columns, "r_ts", *[F.col("v_")[v].alias(v) for v in values], (F.abs(micros("r_ts") - micros(time)) / 1_000_000).alias("seconds"))


def point_lookup(asked: DataFrame, history: DataFrame, keys: list[str], value: str, stale_s: float, target: str = "target", horizon: str = "horizon") -> DataFrame:
    """Asked rows (keys, target, horizon in minutes) with what was known at target - horizon: the latest row, null if that is stale or has no value.

    The latest row decides even where it has no value: an older value isn't passed off as the present one.
    """
    base = asked.withColumn("base_", F.timestamp_add("MINUTE", -F.col(horizon).cast("int"), F.col(target)))
    # a null value sorts first among rows of one time, so it is wrapped
    rows = history.select(*keys, F.col("ts").alias("base_"), F.struct(F.col(value).alias("x")).alias("v_"))
    found = asof_join(base, rows, keys, "v_", stale_s, "backward", "base_")
    return found.select(*asked.columns, F.when(F.col("v_.x").isNotNull(), F.col("r_ts")).alias("r_ts"), F.col("v_.x").alias(value))
