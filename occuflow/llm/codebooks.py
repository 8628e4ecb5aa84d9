"""Compression of vectors into codes of four parts, by exact integer k-means with an exponion search.

A part's search starts at its previous entry a, at distance u. An entry c that is no farther from the
part lies within 2u of a by the triangle inequality, so only a's neighbours up to that radius are
scanned, in the order of their distance from a. All distances are whole numbers; ties go to the
lower index. Tasks hold the codebooks (256 entries a part) and a block of rows; sums are merged by
part and entry, and each round's rows with their entries are written for the next one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import remove, shared_folder, staged, table
from .vectors import integers, matrix, rows_of

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Neighbours of an entry that are compared at once.
SCAN = 64
#: Totals of up to this many labels are broadcast; more are joined by a shuffle with salted labels.
BROADCAST_ROWS = 500_000
SALTS = 16


class Codebook:
    """The entries of one part, with each entry's neighbours sorted by distance, then index."""

    def __init__(self, entries: np.ndarray):
        """``entries`` are rows of whole numbers, as doubles where all distances stay below 2^53, else as int64."""
        self.entries = entries
        norms = (entries * entries).sum(axis=1)
        between = norms[:, None] + norms - 2 * (entries @ entries.T)
        self.norms, self.order = norms, np.argsort(between, axis=1, kind="stable")
        self.far = np.take_along_axis(between, self.order, axis=1)

    def search(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row and its squared distance, from the entry ``start`` of each."""
        norms, best = (x * x).sum(axis=1), start.copy()
        least = ((x - self.entries[start]) ** 2).sum(axis=1)
        by_start = np.argsort(start, kind="stable")
        groups = np.split(by_start, np.flatnonzero(np.diff(start[by_start])) + 1) if len(x) else []
        for rows in groups:
            a = start[rows[0]]
            reach = np.searchsorted(self.far[a], 4 * least[rows], side="right")  # 2u, squared
            for at in range(0, int(reach.max()), SCAN):
                some = rows[reach > at]
                # in the order of indexes, so that the first least distance is that of the lowest index
                near = np.sort(self.order[a, at : at + SCAN])
                d = norms[some, None] + self.norms[near] - 2 * (x[some] @ self.entries[near].T)
                k = d.argmin(axis=1)
                entry, d = near[k], d[np.arange(len(some)), k]
                closer = (d < least[some]) | ((d == least[some]) & (entry < best[some]))
                best[some[closer]], least[some[closer]] = entry[closer], d[closer]
        return best, least


def books_of(entries: np.ndarray, largest: int) -> tuple[list[Codebook], type]:
    """Codebooks of (parts, entries, positions), and the kind of number in which all distances are exact."""
    most = entries.shape[2] * 16 * float(largest) ** 2  # four times the largest squared distance
    if most >= 2.0**63:
        raise ValueError("squared distances may pass 2^63")
    kind = np.float64 if most < 2.0**53 else np.int64
    return [Codebook(e.astype(kind)) for e in entries], kind


def first_entries(rows: DataFrame, vec_id: str, width: int) -> np.ndarray:
    """The vectors of the smallest ids, ascending, as (entries, width); of rows that share an id the least vector, a null id comes last.

    Each task keeps its own smallest ids only, so a repeated id is never gathered.
    """
    kind = rows.schema[vec_id].dataType
    schema = StructType([StructField(vec_id, kind), StructField("x", ArrayType(LongType()))])

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, arrow = {}, None
        for batch in batches:
            arrow, last = batch.schema, next(reversed(held), None)
            if len(held) == ENTRIES and last is not None:  # larger ids, and null ones, can't be among the smallest any more
                batch = batch.filter(pc.less_equal(batch.column(0), pa.scalar(last, arrow.field(0).type)))
            for key, x in zip(batch.column(0).to_pylist(), map(tuple, matrix(batch, "x", width).tolist()), strict=True):
                held[key] = min(held.get(key, x), x)
            held = {k: held[k] for k in sorted(held, key=lambda k: (k is None, k))[:ENTRIES]}
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), arrow.field(0).type), pa.array([list(x) for x in held.values()], arrow.field(1).type)], names=[vec_id, "x"])

    few = rows.select(vec_id, "x").mapInArrow(smallest, schema).groupBy(vec_id).agg(F.min("x").alias("x"))
    got = few.orderBy(F.col(vec_id).asc_nulls_last()).limit(ENTRIES).select("x").collect()
    return np.array([r["x"] for r in got], np.int64).reshape(len(got), width)


def assign(rows: DataFrame, entries: np.ndarray, largest: int) -> DataFrame:
    """The rows with the nearest entry of every part (``at``, from which the search starts) and their squared distances (``apart``)."""
    parts, _, size = entries.shape
    books, kind = books_of(entries, largest)
    schema = StructType([*rows.drop("at", "apart").schema.fields, StructField("at", ArrayType(LongType())), StructField("apart", ArrayType(LongType()))])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, at = matrix(batch, "x", parts * size).astype(kind), matrix(batch, "at", parts)
            found = [book.search(x[:, i * size : (i + 1) * size], at[:, i]) for i, book in enumerate(books)]
            new = {"at": np.stack([a for a, _ in found], axis=1), "apart": np.stack([d for _, d in found], axis=1).astype(np.int64)}
            yield pa.RecordBatch.from_arrays([rows_of(new[n], pa.int64()) if n in new else batch.column(n) for n in names], names=names)

    return rows.mapInArrow(run, schema)


def moved(rows: DataFrame, entries: np.ndarray) -> np.ndarray:
    """The floored means of each entry's parts; an entry without parts stays. Each task sends one row of sums an entry, and Spark merges them."""
    parts, count, size = entries.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((parts, count, size), np.int64), np.zeros((parts, count), np.int64)
        for batch in batches:
            x, at = matrix(batch, "x", parts * size), matrix(batch, "at", parts)
            for i in range(parts if len(x) else 0):
                order = np.argsort(at[:, i], kind="stable")
                used, first, c = np.unique(at[order, i], return_index=True, return_counts=True)
                total[i, used] += np.add.reduceat(x[order, i * size : (i + 1) * size], first, axis=0)
                n[i, used] += c
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(n[part, entry]), *(pa.array(total[part, entry, j]) for j in range(size))], names=names)

    names = ["part", "entry", "n", *(f"s{j}" for j in range(size))]
    partial = rows.mapInArrow(sums, ", ".join(f"{c} long" for c in names))
    out = entries.copy()
    # at most as many rows as the codebooks have entries
    for r in partial.groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in names[2:])).collect():
        out[r["part"], r["entry"]] = [r[c] // r["n"] for c in names[3:]]
    return out


def compress(df: DataFrame, folder: str, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, code, error, label_error, label) of every row of a finite vector, and the final entries (parts, entries, positions).

    Rows of null vectors, or with null or non-finite components, are dropped. Shorter vectors end in zeros, up to the
    longest one's length made a multiple of the parts. Rows that share an id are coded each, and the first entries have the
    least of their vectors; a row without an id is coded too, and starts an entry only if ids are too few. Entries that start equal
    stay so, and the lower one gets all parts. An empty table gives no rows. Other columns aren't read. Integers beyond 2^40, or whose
    squared distances may pass 2^63, raise.
    """
    columns = [F.col(vec_id).alias("vec_id"), F.col(label).alias("label")]
    kept, width, largest = integers(df, vector, SCALE, "_x")
    size = max(-(-width // PARTS), 1)
    pad = F.array_repeat(F.lit(0).cast("long"), size * PARTS - width)
    start = F.array_repeat(F.lit(0).cast("long"), PARTS)
    rows = kept.select(*columns, F.concat("_x", pad).alias("x"), start.alias("at"))
    first = first_entries(rows, "vec_id", size * PARTS)
    entries = np.ascontiguousarray(first.reshape(len(first), PARTS, size).transpose(1, 0, 2))
    if not len(first):
        empty = rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), "label").where(F.lit(False))
        return empty, entries
    for k in range(rounds):
        rows = staged(assign(rows, entries, largest).drop("apart"), folder, f"round{k}")
        entries = moved(rows, entries)
        if k:
            remove(df.sparkSession, f"{folder}/round{k - 1}")
    code = F.lower(F.array_join(F.transform("at", lambda e: F.lpad(F.hex(e), 2, "0")), ""))
    error = F.aggregate("apart", F.lit(0).cast("long"), lambda a, d: a + d)
    coded = staged(assign(rows, entries, largest).select("vec_id", code.alias("code"), error.alias("error"), "label"), folder, "coded")
    return coded.select("vec_id", "code", "error", "label").transform(with_label_error), entries


def with_label_error(coded: DataFrame) -> DataFrame:
    """The errors summed over equal labels, nulls together; many labels are joined by a shuffle, a hot one in salted parts."""
    total = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "same")
    if total.count() <= BROADCAST_ROWS:
        out = coded.join(F.broadcast(total), F.col("label").eqNullSafe(F.col("same")))
    else:
        salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        mine = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
        out = mine.join(total.withColumn("other", salt).hint("merge"), F.col("label").eqNullSafe(F.col("same")) & (F.col("salt") == F.col("other")))
    return out.select("vec_id", "code", "error", "label_error", "label")


def fingerprint(entries: np.ndarray) -> str:
    """SHA-256 of all entries' numbers by part, entry and position."""
    return hashlib.sha256(",".join(map(str, entries.ravel().tolist())).encode()).hexdigest()


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of every embedding: vec_id, code, error, label_error, codebooks_sha256."""
    coded, entries = compress(table(spark, sf_dir, "embeddings"), shared_folder(spark))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(fingerprint(entries)).cast(StringType()).alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds unrolled: every part against every entry."""
    apart = "list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.x[i]) * (p.x[i] - b.x[i])))"
    floored = "(sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*)"
    steps = [
        "kept AS (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings "
        "WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)",
        "parts AS MATERIALIZED (SELECT vec_id, label, part, x[part * (len(x) // 4) + 1 : (part + 1) * (len(x) // 4)] AS x FROM kept, range(4) t(part))",
        "book0 AS MATERIALIZED (SELECT part, dense_rank() OVER (ORDER BY vec_id) - 1 AS entry, x FROM parts QUALIFY entry < 256)",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"near{k} AS MATERIALIZED (SELECT p.vec_id, p.part, min(CAST({apart} AS BIGINT) * 256 + b.entry) AS m FROM parts p JOIN book{k} b ON p.part = b.part GROUP BY ALL)")
        if k < ROUNDS:
            steps.append(
                f"cells{k} AS (SELECT p.part, n.m % 256 AS entry, unnest(range(1, len(p.x) + 1)) AS i, unnest(p.x) AS v FROM parts p JOIN near{k} n ON p.vec_id = n.vec_id AND p.part = n.part), "
                f"means{k} AS (SELECT part, entry, list(v ORDER BY i) AS x FROM (SELECT part, entry, i, CAST({floored} AS BIGINT) AS v FROM cells{k} GROUP BY ALL) GROUP BY ALL), "
                f"book{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN means{k} m ON b.part = m.part AND b.entry = m.entry)"
            )
    steps.append(f"coded AS (SELECT vec_id, string_agg(printf('%02x', m % 256), '' ORDER BY part) AS code, CAST(sum(m // 256) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY vec_id)")
    steps.append(f"sha AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS h FROM book{ROUNDS})")
    return (
        "WITH " + ", ".join(steps) + " SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT h FROM sha) AS codebooks_sha256 FROM coded JOIN kept USING (vec_id)"
    )


SQL = {"op12_vector_codes": _sql()}
