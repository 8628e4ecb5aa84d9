"""Gradient-boosted trees with pinball loss: forecasts of quantiles, over Spark or inside a bounded group.

Spark ML has no such loss. A round grows one tree a quantile: splits are found on histograms of the
features' bins, and a leaf's value is the quantile of its residuals, read off a histogram too. Tasks
send their histograms' cells, Spark adds them up, and the driver sees at most as many numbers as the
histograms have cells, however many rows there are. Counts are whole numbers, so the trees don't
depend on the partitioning.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS, RESIDUAL_BINS = 32, 1024
#: Rows that a side of a split must have.
LEAST = 20


@dataclass
class Tree:
    """A full binary tree: at node i rows whose bin of ``feature`` is above ``cut`` go right."""

    feature: list[int]
    cut: list[int]
    leaf: list[float] = field(default_factory=list)

    def place(self, b: np.ndarray, levels: int) -> np.ndarray:
        """The position of each row among the nodes of a level."""
        at = np.zeros(len(b), np.int64)
        for level in range(levels):
            node = at + (1 << level) - 1
            at = 2 * at + (b[np.arange(len(b)), np.take(self.feature, node)] > np.take(self.cut, node))
        return at


@dataclass
class Forest:
    """Trees of several quantiles over the same bins."""

    alphas: list[float]
    edges: list[list[float]]
    base: list[float]
    trees: list[list[Tree]]
    depth: int
    rate: float
    span: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Bins of feature values; a missing value lies in the last one."""
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def start(self, b: np.ndarray) -> np.ndarray:
        return np.tile(np.array(self.base, float), (len(b), 1))

    def values(self, b: np.ndarray) -> np.ndarray:
        out = self.start(b)
        for a, trees in enumerate(self.trees):
            for tree in trees:
                out[:, a] += self.rate * np.take(tree.leaf, tree.place(b, self.depth))
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        """(rows, quantiles), sorted so that they never cross."""
        return np.sort(self.values(self.bins(x)), axis=1)

    def column(self, features: list[str]) -> Column:
        """An array of the forecasts of each row."""

        def run(rows: pd.DataFrame) -> pd.Series:
            return pd.Series(list(self.predict(rows.to_numpy(float))))

        return F.pandas_udf(run, "array<double>")(F.struct(*[F.col(c).cast("double").alias(c) for c in features]))

    def split_cells(self, b: np.ndarray, y: np.ndarray, now: np.ndarray, growing: list[Tree], level: int) -> np.ndarray:
        """(quantile, node, feature, bin, 2): rows, and those at or below the present forecast."""
        width = BINS + 1
        out, twice = np.zeros((len(self.alphas), 1 << level, b.shape[1], width, 2)), 2 * b.astype(np.int64)
        for a, tree in enumerate(growing):
            cell = tree.place(b, level) * (2 * width) + (y <= now[:, a])
            for j in range(b.shape[1]):
                out[a, :, j] = np.bincount(cell + twice[:, j], minlength=(1 << level) * 2 * width).reshape(-1, width, 2)
        out[..., 0] += out[..., 1]  # those above, and now all
        return out

    def leaf_cells(self, b: np.ndarray, y: np.ndarray, now: np.ndarray, growing: list[Tree]) -> np.ndarray:
        """(quantile, leaf, residual bin): rows."""
        out = np.zeros((len(self.alphas), 1 << self.depth, RESIDUAL_BINS))
        for a, tree in enumerate(growing):
            r = np.clip((y - now[:, a] + self.span) / (2 * self.span) * RESIDUAL_BINS, 0, RESIDUAL_BINS - 1).astype(np.int64)
            out[a] = np.bincount(tree.place(b, self.depth) * RESIDUAL_BINS + r, minlength=(1 << self.depth) * RESIDUAL_BINS).reshape(-1, RESIDUAL_BINS)
        return out

    def moved(self, b: np.ndarray, now: np.ndarray) -> np.ndarray:
        """Forecasts of all rounds but the last, moved by the last round's trees."""
        steps = [self.rate * np.take(trees[-1].leaf, trees[-1].place(b, self.depth)) for trees in self.trees]
        return now + np.stack(steps, axis=1)

    def residual(self, counts: np.ndarray, alpha: float) -> float:
        """The quantile of a leaf's residuals, on the line through the bin that holds it; 0 for an empty leaf."""
        total = counts.sum()
        if not total:
            return 0.0
        upto = counts.cumsum()
        k = int(np.searchsorted(upto, alpha * total))
        inside = (alpha * total - upto[k] + counts[k]) / counts[k]
        return float((k + inside) / RESIDUAL_BINS * 2 * self.span - self.span)


def best_split(cells: np.ndarray, alpha: float) -> tuple[int, int]:
    """(feature, cut) of the largest gain of squared gradient sums; of equals the first, and no cut where nothing gains."""
    n, below = cells[..., 0].cumsum(axis=1), cells[..., 1].cumsum(axis=1)
    g = alpha * n - below
    total, whole = n[:, -1:], g[:, -1:]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = g**2 / n + (whole - g) ** 2 / (total - n) - whole**2 / total
    gain = np.where((n >= LEAST) & (total - n >= LEAST), gain, 0.0)
    j, cut = np.unravel_index(int(gain.argmax()), gain.shape)
    return (int(j), int(cut)) if gain[j, cut] > 1e-9 else (0, BINS)


def started(alphas: list[float], edges: list[list[float]], base: list[float], low: float, high: float, depth: int, rate: float) -> Forest:
    return Forest(list(alphas), edges, base, [[] for _ in alphas], depth, rate, max(high - low, 1e-9))


#: f(forest's number, bins, targets, present forecasts) -> counts
Counting = Callable[[int, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def grow(forests: list[Forest], cells: Callable[[Counting], list[np.ndarray]], moved: Callable[[], None], rounds: int) -> None:
    """Forests of equal settings grow side by side: ``cells(f)`` sums f over the rows of each, ``moved()`` says that a round's trees are complete."""
    depth = forests[0].depth
    for r in range(rounds):
        growing = [[Tree([], []) for _ in f.alphas] for f in forests]
        for level in range(depth):
            got = cells(lambda k, b, y, now, growing=growing, level=level: forests[k].split_cells(b, y, now, growing[k], level))
            for f, trees, own in zip(forests, growing, got, strict=True):
                for a, tree in enumerate(trees):
                    for node in range(1 << level):
                        j, cut = best_split(own[a, node], f.alphas[a])
                        tree.feature.append(j)
                        tree.cut.append(cut)
        got = cells(lambda k, b, y, now, growing=growing: forests[k].leaf_cells(b, y, now, growing[k]))
        for f, trees, own in zip(forests, growing, got, strict=True):
            for a, tree in enumerate(trees):
                tree.leaf = [f.residual(c, f.alphas[a]) for c in own[a]]
                f.trees[a].append(tree)
        if r + 1 < rounds:
            moved()


def of_each(g: np.ndarray) -> list[tuple[int, slice | np.ndarray]]:
    """(number, where) of the groups in a batch."""
    if len(g) and (g == g[0]).all():
        return [(int(g[0]), slice(None))]
    return [(int(k), g == k) for k in np.unique(g)]


class Spread:
    """Rows of several forests on Spark: bins, target and present forecasts, kept between jobs, so that a job neither bins nor replays earlier trees.

    They are kept as blocks, a batch's columns in a row each as bytes: each of the many jobs would else turn every row anew into columns for Python.
    """

    SCHEMA = "g_ binary, y_ binary, b_ binary, n_ binary"

    def __init__(self, rows: DataFrame, features: list[str], forests: list[Forest]):
        self.forests, self.old = forests, None
        self.bins, self.now = len(features), len(forests[0].alphas)

        def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                x, g = pdf[features].to_numpy(float), pdf["g_"].to_numpy()
                b, now = np.zeros(x.shape, np.int8), np.zeros((len(x), self.now))
                for k, at in of_each(g):
                    b[at] = forests[k].bins(x[at])
                    now[at] = forests[k].start(b[at])
                yield self.block(g, pdf["y_"].to_numpy(float), b, now)

        self.rows = rows.mapInPandas(first, self.SCHEMA).persist()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("rows", "old")}  # for tasks

    @staticmethod
    def block(g: np.ndarray, y: np.ndarray, b: np.ndarray, now: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"g_": [g.astype(np.int32).tobytes()], "y_": [y.tobytes()], "b_": [b.tobytes("F")], "n_": [now.tobytes("F")]})

    def blocks(self, pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for g, y, b, now in zip(pdf["g_"], pdf["y_"], pdf["b_"], pdf["n_"], strict=True):
            b, now = np.frombuffer(b, np.int8).reshape(self.bins, -1).T, np.frombuffer(now).reshape(self.now, -1).T
            yield np.frombuffer(g, np.int32), np.frombuffer(y), b, now

    def cells(self, f: Counting) -> list[np.ndarray]:
        shape = f(0, np.zeros((0, self.bins), np.int8), np.zeros(0), np.zeros((0, self.now))).shape
        size = int(np.prod(shape))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total: dict[int, np.ndarray] = {}
            for g, y, b, now in chain.from_iterable(map(self.blocks, batches)):
                for k, at in of_each(g):
                    total[k] = total.get(k, 0) + f(k, b[at], y[at], now[at])
            for k, t in total.items():
                at = np.flatnonzero(t)
                yield pd.DataFrame({"cell": k * size + at, "n": t.ravel()[at].astype(np.int64)})

        got = self.rows.mapInPandas(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros(len(self.forests) * size)
        out[got["cell"].to_numpy()] = got["n"].to_numpy()
        self.forget(self.old)  # all rows of the round were read, so those it was made of may go
        self.old = None
        return list(out.reshape(len(self.forests), *shape))

    def moved(self) -> None:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for g, y, b, before in chain.from_iterable(map(self.blocks, batches)):
                now = before.copy()
                for k, at in of_each(g):
                    now[at] = self.forests[k].moved(b[at], before[at])
                yield self.block(g, y, b, now)

        self.old, self.rows = self.rows, self.rows.mapInPandas(run, self.SCHEMA).persist()

    @staticmethod
    def forget(rows: DataFrame | None) -> None:
        if rows is not None:
            rows.unpersist()


def fit_numbered(rows: DataFrame, n: int, features: list[str], alphas: list[float], rounds: int = 12, depth: int = 3, rate: float = 0.4) -> list[Forest]:
    """Forests 0 to n - 1 of rows (g_, features, y_), grown side by side: as many jobs for all as for one. One without rows forecasts 0."""
    cuts = [k / BINS for k in range(1, BINS)]
    of = rows.groupBy("g_").agg(F.percentile_approx("y_", list(alphas), 10_000).alias("base"), F.min("y_").alias("lo"), F.max("y_").alias("hi"), *[F.percentile_approx(c, cuts, 1000).alias(f"e{j}") for j, c in enumerate(features)])
    got = {r["g_"]: r for r in of.collect()}  # a row a forest
    edges = lambda r: [sorted(set(r[f"e{j}"] or [])) for j in range(len(features))]
    forests = [started(alphas, edges(got[k]), list(got[k]["base"]), got[k]["lo"], got[k]["hi"], depth, rate) if k in got else started(alphas, [[] for _ in features], [0.0] * len(alphas), 0, 0, depth, rate) for k in range(n)]
    if got:
        spread = Spread(rows if n == 1 else rows.sortWithinPartitions("g_"), features, forests)
        try:
            grow(forests, spread.cells, spread.moved, rounds)
        finally:
            spread.forget(spread.old)
            spread.forget(spread.rows)
    for k in set(range(n)) - set(got):
        forests[k].trees = [[] for _ in alphas]
    return forests


def numeric(train: DataFrame, features: list[str], target: str, number: Column) -> DataFrame:
    return train.select(number.cast("int").alias("g_"), *[F.col(c).cast("double").alias(c) for c in features], F.col(target).cast("double").alias("y_")).where("y_ IS NOT NULL")


def fit(train: DataFrame, features: list[str], target: str, alphas: list[float], rounds: int = 12, depth: int = 3, rate: float = 0.4) -> Forest:
    """A forest from rows with a target; ``train`` is read twice. An empty one forecasts 0."""
    return fit_numbered(numeric(train, features, target, F.lit(0)), 1, features, alphas, rounds, depth, rate)[0]


def fit_local(x: np.ndarray, y: np.ndarray, alphas: list[float], rounds: int = 12, depth: int = 3, rate: float = 0.4) -> Forest:
    """The same over arrays, for a group that is known to fit in a task."""
    if not len(y):
        return started(alphas, [[] for _ in range(x.shape[1])], [0.0] * len(alphas), 0, 0, depth, rate)
    edges = [sorted({float(v) for v in np.nanquantile(x[:, j], np.arange(1, BINS) / BINS, method="inverted_cdf")}) if np.isfinite(x[:, j]).any() else [] for j in range(x.shape[1])]
    forest = started(alphas, edges, [float(np.quantile(y, a, method="inverted_cdf")) for a in alphas], y.min(), y.max(), depth, rate)
    b = forest.bins(x)
    now = forest.start(b)

    def moved() -> None:
        now[:] = forest.moved(b, now)

    grow([forest], lambda f: [f(0, b, y, now)], moved, rounds)
    return forest


#: Rows of a group that one task may train on; larger groups are trained over Spark.
MOST = 500_000
#: Groups that are trained over Spark side by side; it bounds the histograms that the driver holds.
TOGETHER = 16


def meet(df: DataFrame, groups: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Rows joined with a table of groups; a key that is null equals a null one."""
    named = groups.withColumnsRenamed({k: f"{k}_of_" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}_of_"))
    return df.join(named, on, how).drop(*[f"{k}_of_" for k in keys])


def fit_groups(train: DataFrame, test: DataFrame, keys: list[str], features: list[str], target: str, alphas: list[float], names: list[str], least: int, most: int = MOST, **settings) -> DataFrame:
    """Test rows with ``names``, the forecasts of their group's own forest; null where the group has fewer than ``least`` rows to learn from.

    Groups are trained apart, each in a task that holds it; those above ``most`` rows to learn from or to forecast, which the counts tell
    beforehand, are trained over Spark instead, several side by side. There can't be more of those than all rows over ``most``. Groups with
    too few rows are told by the counts too and go to no task. A key that is null is a group of its own.
    """
    spark, columns = test.sparkSession, test.columns
    known = train.where(F.col(target).isNotNull())
    sides = known.select(*keys, F.lit(1).alias("a_"), F.lit(0).alias("t_")).unionAll(test.select(*keys, F.lit(0).alias("a_"), F.lit(1).alias("t_")))
    able = sides.groupBy(*keys).agg(F.sum("a_").alias("a_"), F.sum("t_").alias("t_")).where((F.col("a_") >= max(least, 1)) & (F.col("t_") > 0))
    is_large = (F.col("a_") > most) | (F.col("t_") > most)
    large = [tuple(r) for r in able.where(is_large).select(*keys).collect()]
    schema = ", ".join([*(f"`{n}` {t}" for n, t in test.dtypes), *(f"{n} double" for n in names)])

    def run(mine: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = asked.reindex(columns=[*columns, *names]).astype(dict.fromkeys(names, float))
        if len(mine) and len(asked):
            forest = fit_local(mine[features].to_numpy(float), mine[target].to_numpy(float), alphas, **settings)
            out[names] = forest.predict(asked[features].to_numpy(float))
        return out

    small = able.where(~is_large).select(*keys)
    # fresh columns: both sides may come from one table
    learnt = meet(known, small, keys, "left_semi").select(*[F.col(c).alias(c) for c in dict.fromkeys([*keys, *features, target])])
    got = learnt.groupBy(*keys).cogroup(meet(test, small, keys, "left_semi").groupBy(*keys)).applyInPandas(run, schema)
    out = got.select(*columns, *[F.when(~F.isnan(n), F.col(n)).alias(n) for n in names])
    few = meet(test, able.select(*keys), keys, "left_anti")
    out = out.union(few.select(*columns, *[F.lit(None).cast("double").alias(n) for n in names]))
    kinds = ", ".join(f"`{n}` {t}" for n, t in test.select(*keys).dtypes)
    for i in range(0, len(large), TOGETHER):
        some = large[i : i + TOGETHER]
        numbers = F.broadcast(spark.createDataFrame([(*g, k) for k, g in enumerate(some)], f"{kinds}, number_ int"))  # at most TOGETHER rows
        rows = numeric(meet(known, numbers, keys, "inner"), features, target, F.col("number_"))
        forests = fit_numbered(rows, len(some), features, alphas, **settings)
        own = meet(test, numbers, keys, "inner").withColumn("q_", numbered_column(forests, features, "number_"))
        out = out.union(own.select(*columns, *[F.col("q_")[i].alias(n) for i, n in enumerate(names)]))
    return out


def numbered_column(forests: list[Forest], features: list[str], number: str) -> Column:
    """An array of the forecasts of each row by the forest of its number."""

    def run(rows: pd.DataFrame) -> pd.Series:
        x = rows[features].to_numpy(float)
        out = np.zeros((len(x), len(forests[0].alphas)))
        for k, at in of_each(rows["n_"].to_numpy()):
            out[at] = forests[k].predict(x[at])
        return pd.Series(list(out))

    return F.pandas_udf(run, "array<double>")(F.struct(F.col(number).alias("n_"), *[F.col(c).cast("double").alias(c) for c in features]))


def pinball(actual: Column, forecast: Column, alpha: float) -> Column:
    """The loss that a quantile's forecast minimises."""
    gap = actual - forecast
    return F.greatest(gap * alpha, gap * (alpha - 1))
