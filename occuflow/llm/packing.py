"""Packing: optimal length buckets and token-budget batches.

Dynamic programming over the global histogram of lengths picks the bucket boundaries with the
least padding; in each bucket, sequences padded to its boundary fill batches of a token budget.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, table

#: Longer texts are cut into pieces of this length and a rest, so the histogram has at most so many entries.
MAX_LENGTH = 2048
BUCKETS, BUDGET = 12, 65_536
#: Sequences that are ranked together in one group.
GROUP = 20_000


def n_tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SPACE.replace("[", "[^") + "+")).cast("long")


def pieces(df: DataFrame, max_length: int = MAX_LENGTH) -> DataFrame:
    """(doc_id, mark, piece, length): texts in pieces of at most max_length tokens; an empty text is one piece of length 0. ``mark`` is a hash of the text, which tells texts of one id, or of none, apart."""
    n = df.select("doc_id", n_tokens(F.col("text")).alias("n"), F.xxhash64("text").alias("mark"))
    last = F.greatest(F.ceil(F.col("n") / max_length) - 1, F.lit(0))
    cut = n.select("doc_id", "mark", "n", F.posexplode(F.sequence(F.lit(0).cast("long"), last)).alias("piece", "x"))
    return cut.select("doc_id", "mark", "piece", F.least(F.lit(max_length), F.col("n") - F.col("x") * max_length).alias("length"))


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The upper lengths of at most so many buckets that together pad the fewest tokens (least boundaries among equals)."""
    order = np.argsort(lengths)
    x, c = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    if not len(x):
        return []
    n = len(x)
    rows, tokens = np.concatenate([[0], np.cumsum(c)]), np.concatenate([[0], np.cumsum(c * x)])
    cost = x[None, :] * (rows[None, 1:] - rows[:-1, None]) - (tokens[None, 1:] - tokens[:-1, None])  # of one bucket from i to j
    cost = np.where(np.arange(n)[:, None] <= np.arange(n)[None, :], cost, np.iinfo(np.int64).max // 4)
    best, back = cost[0].copy(), [np.zeros(n, np.int64)]
    for _ in range(1, min(buckets, n)):
        through = np.concatenate([[0], best[:-1]])[:, None] + cost  # the last bucket starts at i
        through[0] = cost[0]
        back.append(np.argmin(through, axis=0))
        best = through.min(axis=0)
    out, j = [], n - 1
    for start in reversed(back):
        if j < 0:
            break
        out.append(int(x[j]))
        j = int(start[j]) - 1
    return out[::-1]


def pack(df: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, max_length: int = MAX_LENGTH, group: int = GROUP) -> DataFrame:
    """Batches of all sequences: doc_id, piece, length, bucket, padded_length, batch, position.

    In a bucket, sequences are ordered by a hash of doc_id, text and piece modulo the number of groups, then by doc_id, the text's hash and piece;
    ranks come from group offsets, so no task sorts a whole bucket, nor all pieces of a long text, nor all texts of one id. A null text has
    no tokens; texts without a doc_id come first in their groups. So places don't depend on the order of rows: rows that agree in id and text
    take neighbouring places, and are alike in all columns but those. An empty table gives no rows; other columns are not read.
    """
    seq = pieces(df, max_length)
    hist = seq.groupBy("length").count().collect()  # at most max_length + 1 rows
    total = sum(r["count"] for r in hist)
    upper = boundaries(np.array([r["length"] for r in hist], np.int64), np.array([r["count"] for r in hist], np.int64), buckets)
    if not upper:
        upper = [max_length]
    groups = max(1, -(-total // group))
    edges = F.array(*[F.lit(u).cast("long") for u in upper])
    bucket = F.size(F.filter(edges, lambda u: u < F.col("length")))
    seq = seq.withColumn("bucket", bucket).withColumn("padded_length", F.element_at(edges, F.col("bucket") + 1))
    seq = seq.withColumn("part", F.pmod(F.xxhash64("doc_id", "mark", "piece"), F.lit(groups)))
    sizes = seq.groupBy("bucket", "part").agg(F.count("*").alias("c"))
    before = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket", "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
    own = Window.partitionBy("bucket", "part").orderBy("doc_id", "mark", "piece")
    ranked = seq.withColumn("n", F.row_number().over(own) - 1).join(offsets, ["bucket", "part"])
    rank, each = F.col("offset") + F.col("n"), F.greatest(F.floor(F.lit(budget) / F.greatest("padded_length", F.lit(1))), F.lit(1))
    return ranked.select("doc_id", "piece", "length", "bucket", "padded_length", F.floor(rank / each).alias("batch"), F.pmod(rank, each).alias("position"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's sequences in buckets and batches."""
    return pack(table(spark, sf_dir, "documents"))
