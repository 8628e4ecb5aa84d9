"""Integer vectors from a column of embeddings, and exact and double-double sums over them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Larger integers are refused: sums and squares over them would not fit.
LARGEST = 2.0**40


def finite(vector: Column) -> Column:
    """Not null, and all components numbers. NaN is greater than infinity to Spark, so one comparison finds both."""
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & (F.abs(c) < float("inf")))


def integers(df: DataFrame, vector: str, scale: int, name: str) -> tuple[DataFrame, int, int]:
    """The rows of finite vectors with floor(scale * component) as ``name``, the vectors' length and their largest absolute integer.

    Shorter vectors end in zeros. A vector with an integer beyond 2^40 raises.
    """
    c = F.col(vector).cast("array<double>")
    kept = df.where(finite(c))
    rounded = F.transform(c, lambda x: F.floor(x * scale).cast("long"))
    top = F.max(F.array_max(F.transform(c, lambda x: F.abs(x * scale))))
    size, most = kept.agg(F.max(F.size(c)), top).first()
    size, most = size or 0, most or 0.0
    if most >= LARGEST:
        raise ValueError(f"a component of {vector} times {scale} is beyond 2^40")
    padded = F.concat(rounded, F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(size) - F.size(c), F.lit(0))))
    return kept.withColumn(name, padded), size, int(most) + 1


def matrix(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    """A column of arrays of one length as rows of a matrix."""
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)


def rows_of(m: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The rows of a matrix as a column of arrays."""
    offsets = pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(m).ravel(), kind))


def two_sum(a, b):
    """The rounded sum and its exact error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def split(a):
    """Two halves of at most 26 bits each that add up to a; magnitudes stay far from overflow here."""
    t = a * 134217729.0
    high = t - (t - a)
    return high, a - high


def two_product(a, b):
    """The rounded product and its exact error."""
    p = a * b
    (ah, al), (bh, bl) = split(a), split(b)
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def dd_add(ah, al, bh, bl):
    """The sum of two double-doubles."""
    s, e = two_sum(ah, bh)
    t, f = two_sum(al, bl)
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def dd_product(ah, al, bh, bl):
    p, e = two_product(ah, bh)
    return two_sum(p, e + (ah * bl + al * bh))


def dd_total(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of double-doubles along the first axis, by halves."""
    while len(high) > 1:
        half = len(high) // 2
        h, e = dd_add(high[:half], low[:half], high[half : 2 * half], low[half : 2 * half])
        if len(high) % 2:
            h, e = np.concatenate([h, high[-1:]]), np.concatenate([e, low[-1:]])
        high, low = h, e
    return (high[0], low[0]) if len(high) else (np.zeros(high.shape[1:]), np.zeros(low.shape[1:]))


def dd_matmul(ah: np.ndarray, al: np.ndarray, bh: np.ndarray, bl: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The product of two matrices of double-doubles, a column of the second at a time."""
    out = [dd_total(*dd_product(ah.T, al.T, bh[:, k : k + 1], bl[:, k : k + 1])) for k in range(bh.shape[1])]
    empty = np.zeros((len(ah), 0))
    return (np.stack([h for h, _ in out], axis=1), np.stack([e for _, e in out], axis=1)) if out else (empty, empty)
