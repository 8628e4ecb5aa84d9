"""Whitening of embeddings by a compensated covariance.

Tasks centre blocks of rows and sum their outer products as double-doubles, by error-free sums and
products; the high and low parts are merged across tasks as they are. The matrix is as wide as a
vector, so its eigenvectors are found in one place: LAPACK's tridiagonal divide and conquer, then
refinement of the leading ones in double-double, so that small eigenvalues beside large ones keep
their digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from .common import shared_folder, staged, table
from .vectors import dd_add, dd_matmul, dd_product, dd_total, integers, matrix, two_sum

SCALE, COMPONENTS = 256, 4
#: Cells of a block of products that a task holds at once.
CELLS = 1 << 18
#: Tasks whose sums are merged together before all are.
MERGE = 64
#: Components of a smaller share of the greatest eigenvalue are rounding, not variance.
LEAST = 2.0**-80
#: Most refinements of the eigenvectors; one or two are usual.
REFINEMENTS = 10


@dataclass
class Whitening:
    """What the fit list says: its size, exact sums, the leading components with their eigenvalues and the trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray  # (width, components)
    values: np.ndarray
    trace: float

    @property
    def mean(self) -> tuple[np.ndarray, np.ndarray]:
        return mean_of(self.sums, self.n)


def mean_of(sums: list[int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """S/n as double-doubles, from whole numbers: the rest of the division is exact."""
    high = np.array([s / n for s in sums])
    low = []
    for s, h in zip(sums, high.tolist(), strict=True):
        num, den = h.as_integer_ratio()
        low.append((s * den - num * n) / (den * n))
    return high, np.array(low)


def centred(x: np.ndarray, mean: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    high, e = two_sum(x.astype(float), -mean[0])
    return two_sum(high, e - mean[1])


def by_task(df: DataFrame, partial, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """Double-double sums over all rows of the arrays that ``partial(batches)`` gives for a task: (rows, columns) high and low.

    A task sends one row for each row of its matrix; they are merged in groups of tasks, then over the groups.
    """
    schema = "k int, task int, high array<double>, low array<double>"

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = partial(batches)
        task = TaskContext.get().partitionId()
        one = pd.DataFrame({"k": np.arange(len(high), dtype=np.int32), "task": np.full(len(high), task, np.int32), "high": list(high), "low": list(low)})
        yield pa.RecordBatch.from_pandas(one, pa.schema([("k", pa.int32()), ("task", pa.int32()), ("high", pa.list_(pa.float64())), ("low", pa.list_(pa.float64()))]), preserve_index=False)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("task")
        high, low = dd_total(np.stack(pdf["high"].to_list()), np.stack(pdf["low"].to_list()))
        return pd.DataFrame({"k": [pdf["k"].iloc[0]], "task": [pdf["task"].iloc[0] // MERGE], "high": [high], "low": [low]})

    merged = df.mapInArrow(sums, schema)
    merged = merged.groupBy("k", F.floor(F.col("task") / MERGE)).applyInPandas(merge, schema)
    got = merged.groupBy("k").applyInPandas(merge, schema).orderBy("k").collect()
    return np.array([r["high"] for r in got]).reshape(-1, columns), np.array([r["low"] for r in got]).reshape(-1, columns)


def products(batches: Iterator[np.ndarray], width: int, rows) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the outer products of double-double rows, upper half first."""
    high, low = np.zeros((width, width)), np.zeros((width, width))
    block = max(CELLS // max(width, 1), 1)
    for m in batches:
        for at in range(0, len(m), block):
            zh, zl = rows(m[at : at + block])
            for i in range(width):
                h, e = dd_total(*dd_product(zh[:, i : i + 1], zl[:, i : i + 1], zh[:, i:], zl[:, i:]))
                high[i, i:], low[i, i:] = dd_add(high[i, i:], low[i, i:], h, e)
    lower = np.tril_indices(width, -1)
    high[lower], low[lower] = high.T[lower], low.T[lower]
    return high, low


def integer_sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Rows and exact sums of each position."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * width
        for batch in batches:
            # 2^40 is the largest integer, so a batch's sums fit in a long
            n, total = n + batch.num_rows, [a + b for a, b in zip(total, matrix(batch, "x", width).sum(axis=0).tolist(), strict=True)]
        rows = [(-1, str(n)), *((i, str(s)) for i, s in enumerate(total))]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([s for _, s in rows])], names=["i", "s"])

    got = fit.mapInArrow(sums, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    by = {r["i"]: int(r["s"]) for r in got}
    return by.get(-1, 0), [by.get(i, 0) for i in range(width)]


def leading(high: np.ndarray, low: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k unit eigenvectors (columns) and eigenvalues of a symmetric double-double matrix, by falling eigenvalue.

    Divide and conquer gives all pairs to the accuracy of the greatest one; the leading ones, with some to spare, are refined
    by residuals in double-double until they stand. Vectors of equal eigenvalues stay any orthogonal ones.
    """
    values, vectors = np.linalg.eigh(high)  # LAPACK syevd
    values, vectors = values[::-1].copy(), np.ascontiguousarray(vectors[:, ::-1])
    m = min(len(values), 4 * k + 16)
    zero = np.zeros_like(vectors)
    for _ in range(REFINEMENTS):
        vh, vl = dd_matmul(high, low, vectors[:, :m], zero[:, :m])
        turned = vectors.T.copy()
        sh, sl = dd_matmul(turned, zero, vh, vl)
        rh, rl = dd_matmul(turned, zero, vectors[:, :m], zero[:, :m])
        s, rest = sh + sl, np.eye(len(vectors), m) - rh - rl
        values[:m] = np.diag(s) / (1 - np.diag(rest))
        gap = values[None, :m] - values[:, None]
        # pairs that can't be told apart are only made orthogonal
        close = np.abs(gap) <= 8 * np.finfo(float).eps * np.sqrt(np.abs(values[:, None] * values[None, :m])) + 1e-30 * np.abs(values).max()
        change = np.where(close, rest / 2, (s + values[None, :m] * rest) / np.where(close, 1, gap))
        vectors[:, :m] += vectors @ change
        if np.abs(change).max() < 1e-15:
            break
    order = np.argsort(-values[:m], kind="stable")[:k]
    return vectors[:, order] / np.linalg.norm(vectors[:, order], axis=0), values[order]


def fit(distinct: DataFrame, width: int, components: int = COMPONENTS) -> Whitening:
    """The whitening of a staged table of distinct vectors ``x``. Components without variance are left out."""
    n, sums = integer_sums(distinct, width)
    if not n or not width:
        return Whitening(n, sums, np.zeros((width, 0)), np.zeros(0), 0.0)
    mean = mean_of(sums, n)
    high, low = by_task(distinct, lambda batches: products((matrix(b, "x", width) for b in batches), width, lambda m: centred(m, mean)), width)
    high, low = dd_divided(high, low, n)
    vectors, values = leading(high, low, min(components, width))
    some = values > LEAST * values.max(initial=0)
    return Whitening(n, sums, vectors[:, some], values[some], float(np.trace(high) + np.trace(low)))


def dd_divided(high: np.ndarray, low: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    q = high / n
    p, e = dd_product(q, np.zeros_like(q), np.float64(n), np.float64(0))
    return two_sum(q, ((high - p) - e + low) / n)


def project(x: np.ndarray, model: Whitening, mean: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows on the components over the roots of their eigenvalues, summed in double-double: (rows, components) high and low."""
    zh, zl = centred(x, mean)
    w = model.vectors / np.sqrt(model.values)
    out = [dd_total(*dd_product(zh.T, zl.T, w[:, k : k + 1], np.zeros((len(w), 1)))) for k in range(w.shape[1])]
    return np.stack([h for h, _ in out], axis=1), np.stack([e for _, e in out], axis=1)


def identity_error(distinct: DataFrame, width: int, model: Whitening) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity, centred on its own mean."""
    k, mean = len(model.values), model.mean
    if not k:
        return 0.0
    block = max(CELLS // width, 1)

    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for b in batches:
            m = matrix(b, "x", width)
            for at in range(0, len(m), block):
                yield np.stack(project(m[at : at + block], model, mean), axis=1)

    def total(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        high, low = np.zeros((1, k)), np.zeros((1, k))
        for y in whitened(batches):
            h, e = dd_total(y[:, 0], y[:, 1])
            high[0], low[0] = dd_add(high[0], low[0], h, e)
        return high, low

    centre = tuple(x[0] for x in dd_divided(*by_task(distinct, total, k), model.n))

    def moved(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return dd_add(m[:, 0], m[:, 1], -centre[0], -centre[1])

    high, _ = dd_divided(*by_task(distinct, lambda batches: products(whitened(batches), k, moved), k), model.n)
    return float(np.abs(high - np.eye(k)).max())


def deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    """Sum over positions of (n*x - S)^2, exact; null where it passes a long."""
    most = max([abs(model.n) * int(np.abs(x).max(initial=0)), *map(abs, model.sums)]) * 2
    if x.shape[1] * most * most < 2**63:
        return ((model.n * x - np.array(model.sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum((model.n * c - s) ** 2 for c, s in zip(row, model.sums, strict=True)) for row in x.tolist()]
    return [d if d < 2**63 else None for d in exact]


def whiten(df: DataFrame, folder: str, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each finite vector and leading component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows of null vectors, or with null or non-finite entries, are dropped; the fit list has each distinct integer vector once, however
    often it repeats. Shorter vectors end in zeros. Rows without an id, or that share one, give rows of their own. Components
    without variance (fewer dimensions than components, one distinct vector) give no rows, nor does an empty table; equal eigenvalues
    keep any orthogonal vectors. Other columns aren't read. A deviation beyond a long is null; integers beyond 2^40 raise.
    """
    kept, width, _ = integers(df.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v")), "v", SCALE, "x")
    rows = kept.select("vec_id", "x")
    distinct = staged(rows.select("x").distinct(), folder, "fit")
    model = fit(distinct, width, components)
    error, mean = identity_error(distinct, width, model), model.mean if model.n else None
    schema = StructType([
        rows.schema["vec_id"], StructField("component", IntegerType()), StructField("n", LongType()), StructField("deviation", LongType()), StructField("whitened", DoubleType()),
        StructField("explained", DoubleType()), StructField("identity_error", DoubleType()),
    ])
    if not len(model.values):
        return df.sparkSession.createDataFrame([], schema)
    k, block = len(model.values), max(CELLS // width, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                x = matrix(part, "x", width)
                n = len(x) * k
                repeat = pa.array(np.repeat(np.arange(len(x)), k))
                yield pa.RecordBatch.from_arrays([
                    part.column("vec_id").take(repeat), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(n, model.n)),
                    pa.array(deviations(x, model), pa.int64()).take(repeat), pa.array(project(x, model, mean)[0].ravel()), pa.array(np.tile(model.values / model.trace, len(x))), pa.array(np.full(n, error)),
                ], names=schema.names)

    return rows.mapInArrow(run, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every embedding."""
    return whiten(table(spark, sf_dir, "embeddings"), shared_folder(spark))
