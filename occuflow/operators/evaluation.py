"""Forecast pairs, folds, scores and certification. A pair frame has a row for each (lot, ts, horizon)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def horizon_frame(grid: DataFrame, horizons: list[int]) -> DataFrame:
    """(lot, ts, horizon, target_time, occ_now, actual) for all horizons at once, by an equi-join at the target time."""
    each = grid.select("lot", "ts", F.col("occ").alias("occ_now"), F.explode(F.array(*map(F.lit, horizons))).alias("horizon"))
    each = each.withColumn("target_time", F.timestamp_add("MINUTE", F.col("horizon"), F.col("ts")))
    return each.join(grid.select("lot", F.col("ts").alias("target_time"), F.col("occ").alias("actual")), ["lot", "target_time"], "left")


def with_baselines(frame: DataFrame, grid: DataFrame) -> DataFrame:
    """persistence, and the values exactly a day and a week before the target time."""
    out = frame.withColumn("persistence", F.col("occ_now"))
    for name, minutes in (("lag_24h", 1440), ("lag_7d", 10_080)):
        past = grid.withColumnRenamed("ts", "target_time")
        shifted = past.withColumn("target_time", F.timestamp_add("MINUTE", F.lit(minutes), F.col("target_time"))).withColumnRenamed("occ", name)
        out = out.join(shifted, ["lot", "target_time"], "left")
    return out


def complete(columns: list[str]) -> Column:
    """All columns are present: methods are compared on the same rows only."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull()
    return out


def errors(pred: str, actual: str = "actual") -> Column:
    return F.abs(F.col(pred) - F.col(actual))


def long_scores(frame: DataFrame, methods: list[str], keys: list[str]) -> DataFrame:
    """(keys, method, n, mae, rmse): a method is scored on the rows where it has a value."""
    rows = frame.select(*keys, "actual", F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.lit(i).alias("pos"), F.col(m).alias("pred")) for i, m in enumerate(methods)])).alias("x"))
    err = F.col("x.pred") - F.col("actual")
    return rows.groupBy(*keys, F.col("x.method").alias("method"), F.col("x.pos").alias("pos")).agg(F.count(err).alias("n"), F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"))


def strongest(scores: DataFrame, keys: list[str]) -> DataFrame:
    """The method of the least error; of equals the first in list order."""
    return scores.where("mae IS NOT NULL").groupBy(*keys).agg(F.min(F.struct("mae", "pos", "method")).alias("b")).select(*keys, F.col("b.method").alias("method"), F.col("b.mae").alias("mae"))


def with_margins(frame: DataFrame, keys: list[str], cells: DataFrame, aggregates: list[Column]) -> DataFrame:
    """A cube with 'all' for margins and a row for every cell, empty ones too."""
    cube = frame.cube(*keys).agg(*aggregates, *[F.grouping(k).alias(f"g_{k}") for k in keys])
    named = cube.select(*[F.when(F.col(f"g_{k}") == 1, "all").otherwise(F.col(k).cast("string")).alias(k) for k in keys], *[c for c in cube.columns if c not in keys and not c.startswith("g_")])
    return cells.join(named, keys, "left")


def test_days(first: str, last: str, days: int, least_train: int) -> list[str]:
    """The last complete days before ``last``; raises if the first of them has too short a history."""
    from datetime import date, timedelta

    end, start = date.fromisoformat(last), date.fromisoformat(first)
    out = [end - timedelta(days=k) for k in range(days, 0, -1)]
    if not out or (out[0] - timedelta(days=1) - start).days < least_train:
        raise ValueError("the history before the first test day is too short")
    return [d.isoformat() for d in out]


def roles(frame: DataFrame, folds: list[str], by_label: bool) -> DataFrame:
    """(fold, role) of every pair: train, validation (the day before) or test; by label time alone, or by both times."""
    day = F.expr("INTERVAL 1 DAY")
    out = frame.withColumn("fold", F.explode(F.array(*[F.lit(f).cast("timestamp_ntz") for f in folds])))
    start, cal, end = F.col("fold"), F.col("fold") - day, F.col("fold") + day
    target, ts = F.col("target_time"), F.col("target_time" if by_label else "ts")
    role = F.when(target < cal, "train").when((ts >= cal) & (target < start), "validation").when((ts >= start) & (target < end), "test")
    return out.withColumn("role", role).where("role IS NOT NULL")


def certified_prefix(table: DataFrame, ok: str = "ok", order: str = "horizon") -> DataFrame:
    """Adds ``certified``: this and all shorter horizons are ok. The table has a row for each horizon, so one window is small."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return table.withColumn("certified", F.min(F.col(ok).cast("int")).over(w) == 1)


def ranked_value(df: DataFrame, keys: list[str], value: str, rank, width: float = 0.5) -> DataFrame:
    """(keys, n, value): the value at a rank, a function of the group's number of rows, counting from 1.

    Values are counted in bins of ``width`` first and the rank is looked up in the bins' running sums; only the bin that holds it is
    sorted, so no task sorts a group.
    """
    binned = df.select(*keys, F.col(value).alias("v"), F.floor(F.col(value) / width).alias("bin"))
    bins = binned.groupBy(*keys, "bin").agg(F.count("*").alias("c"))
    upto = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = bins.withColumns({"upto": F.sum("c").over(upto), "n": F.sum("c").over(Window.partitionBy(*keys))}).withColumn("rank", rank(F.col("n")))
    hit = sums.where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("c") < F.col("rank"))).select(*keys, "bin", "n", (F.col("rank") - F.col("upto") + F.col("c")).alias("place"))
    counted = binned.join(hit, [*keys, "bin"]).groupBy(*keys, "n", "place", "v").agg(F.count("*").alias("c"))
    within = counted.withColumn("upto", F.sum("c").over(Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    return within.where("upto >= place").groupBy(*keys, "n").agg(F.min("v").alias(value))


def counts_of(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, c): how often each value occurs; a shuffle by key and value, so a group of few keys is spread over all tasks."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))


def quantiles_of(counted: DataFrame, keys: list[str], value: str, shares: dict[str, float], width: float = 0.5) -> DataFrame:
    """(keys, a column a share): exact quantiles on the line between neighbours, from counts of values.

    The ranks are looked up in running sums over bins of ``width``; only the values of the bins that hold one are sorted. No task holds a
    group, and nothing is rounded. Keys without values have no row.
    """
    binned = counted.withColumn("bin_", F.floor(F.col(value) / width))
    upto = Window.partitionBy(*keys).orderBy("bin_").rowsBetween(Window.unboundedPreceding, 0)
    bins = binned.groupBy(*keys, "bin_").agg(F.sum("c").alias("b_"))
    sums = bins.withColumns({"upto_": F.sum("b_").over(upto), "n_": F.sum("b_").over(Window.partitionBy(*keys))})
    # each share asks for the values at two ranks, counted from 0
    asked = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), ((F.col("n_") - 1) * p).alias("at"), end((F.col("n_") - 1) * p).cast("long").alias("rank")) for name, p in shares.items() for side, end in (("low", F.floor), ("high", F.ceil))])
    hit = sums.withColumn("ask_", F.explode(asked)).where((F.col("ask_.rank") < F.col("upto_")) & (F.col("ask_.rank") >= F.col("upto_") - F.col("b_")))
    places = hit.groupBy(*keys, "bin_").agg(F.collect_list(F.struct("ask_.name", "ask_.side", (F.col("ask_.at") - F.floor("ask_.at")).alias("part"), (F.col("ask_.rank") - F.col("upto_") + F.col("b_")).alias("place"))).alias("places_"))
    inside = Window.partitionBy(*keys, "bin_").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    found = binned.join(places, [*keys, "bin_"]).withColumn("upto_", F.sum("c").over(inside))  # two bins a share and key at most
    ends = found.withColumn("p_", F.explode("places_")).where((F.col("p_.place") < F.col("upto_")) & (F.col("p_.place") >= F.col("upto_") - F.col("c")))
    of = lambda name, side, c: F.max(F.when((F.col("p_.name") == name) & (F.col("p_.side") == side), F.col(c)))
    line = lambda name: of(name, "low", value) + (of(name, "high", value) - of(name, "low", value)) * of(name, "low", "p_.part")
    return ends.groupBy(*keys).agg(*[line(name).alias(name) for name in shares])
