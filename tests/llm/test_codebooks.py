import hashlib
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from occuflow.llm import codebooks

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """Every part against every entry, in Python numbers."""
    kept = [r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    ints = [[math.floor(1024 * float(np.float32(c))) for c in r[1]] for r in kept]
    size = len(ints[0]) // 4
    cut = lambda x, p: x[p * size : (p + 1) * size]
    order = sorted(range(len(kept)), key=lambda i: kept[i][0])[:256]
    books = [[cut(ints[i], p) for i in order] for p in range(4)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(4):
        for p in range(4):
            groups = {}
            for x in ints:
                groups.setdefault(near(cut(x, p), books[p])[1], []).append(cut(x, p))
            for k, g in groups.items():
                books[p][k] = [sum(c) // len(g) for c in zip(*g)]
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    out = {}
    for r, x in zip(kept, ints):
        found = [near(cut(x, p), books[p]) for p in range(4)]
        out[r[0]] = ("".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found))
    labels = {}
    for r in kept:
        labels[r[2]] = labels.get(r[2], 0) + out[r[0]][1]
    return {r[0]: (*out[r[0]], labels[r[2]], sha) for r in kept}


def result(spark, rows, tmp_path, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema).repartition(3).withColumn("code", F.lit(1)).withColumn("at", F.lit("x"))
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    return [tuple(r) for r in codebooks.op12_vector_codes(spark, str(tmp_path)).collect()]


def test_equals_brute_force(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(3 * i, [float(v) for v in (rng.normal(size=8) * 0.3 + i % 5)], int(i % 3) if i % 7 else None) for i in range(330)]
    rows += [(-5, rows[9][1], 1), (1, None, 1), (2, [0.1, None] + [0.0] * 6, 1), (4, [float("nan")] + [0.0] * 7, 2), (5, [float("-inf")] + [0.0] * 7, 2)]
    assert {r[0]: r[1:] for r in result(spark, rows, tmp_path)} == brute(rows)


def test_ties_copies_and_few_rows(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.integers(-1, 2, 4) / 1024], 0) for i in range(300)]
    assert {r[0]: r[1:] for r in result(spark, rows, tmp_path)} == brute(rows)


def test_search_is_exact_with_ties_for_any_start():
    rng = np.random.default_rng(4)
    for spread, kind in ((2, np.float64), (60, np.float64), (60, np.int64)):
        entries, x = rng.integers(-spread, spread, (256, 4)), rng.integers(-spread, spread, (700, 4))
        d = ((x[:, None] - entries) ** 2).sum(axis=2)
        got = codebooks.Codebook(entries.astype(kind)).search(x.astype(kind), rng.integers(0, 256, 700))
        assert (got[0] == d.argmin(axis=1)).all() and (got[1] == d.min(axis=1)).all()


def test_the_radius_leaves_entries_out():
    rng = np.random.default_rng(5)
    centres = rng.integers(-4000, 4000, (256, 4)).astype(float)
    x = np.repeat(centres, 3, axis=0) + rng.integers(-3, 4, (768, 4))
    book, start = codebooks.Codebook(centres), np.repeat(np.arange(256), 3)
    u = ((x - centres[start]) ** 2).sum(axis=1)
    reach = [np.searchsorted(book.far[a], 4 * d, side="right") for a, d in zip(start, u)]
    assert max(reach) < 20 and (book.search(x, start)[0] == start).all()


def test_null_and_repeated_ids_ragged_and_empty(spark, tmp_path):
    rows = [(None, [1.0, 2.0, 3.0, 4.0], None), (None, [1.0, 2.0, 3.0], 1), (7, [0.0] * 5, 1), (7, [0.5] * 5, 1), (7, [], None)]
    got = result(spark, rows, tmp_path)
    assert len(got) == 5 and sum(r[0] is None for r in got) == 2
    # entries: the least vector of id 7, and that of the null ids
    assert {r[1] for r in got} <= {a + b + c + d for a in ("00", "01") for b in ("00", "01") for c in ("00", "01") for d in ("00", "01")}
    for bad in ([(1, None, 1)], []):
        df = spark.createDataFrame(bad, SCHEMA)
        assert codebooks.compress(df, f"{tmp_path}/none")[0].count() == 0


def test_too_large_numbers_raise(spark, tmp_path):
    df = spark.createDataFrame([(1, [1e30] * 4, 1)], SCHEMA)
    with pytest.raises(ValueError, match="2\\^40"):
        codebooks.compress(df, str(tmp_path))
    df = spark.createDataFrame([(1, [9e8] * 4, 1)], SCHEMA)
    with pytest.raises(ValueError, match="2\\^63"):
        codebooks.compress(df, str(tmp_path))


def test_salted_label_sums_are_the_broadcast_ones(spark, monkeypatch):
    coded = spark.createDataFrame([(i, f"{i:08x}", i, None if i % 4 == 0 else i % 4) for i in range(50)], "vec_id long, code string, error long, label int")
    one = sorted(map(tuple, codebooks.with_label_error(coded).drop("label").collect()))
    monkeypatch.setattr(codebooks, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, codebooks.with_label_error(coded).drop("label").collect())) == one


def test_sql_twin_agrees(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(i * 7 % 401, [float(v) for v in rng.normal(size=8)], int(i % 4) if i % 9 else None) for i in range(300)] + [(900, None, 1)]
    got = result(spark, rows, tmp_path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert sorted(got) == sorted(con.execute(codebooks.SQL["op12_vector_codes"]).fetchall())


def test_the_first_entries_are_those_of_the_smallest_ids(spark):
    rng = np.random.default_rng(7)
    ids = [int(i) if i % 13 else None for i in rng.integers(0, 3000, 4000)]
    rows = [(i, [int(v) for v in rng.integers(-9, 9, 4)]) for i in ids]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 300)
    try:
        got = codebooks.first_entries(spark.createDataFrame(rows, "vec_id long, x array<long>").repartition(3), "vec_id", 4)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    least = {}
    for i, x in rows:
        least[i] = min(least.get(i, x), x)
    assert got.tolist() == [least[i] for i in sorted(i for i in least if i is not None)[:256]]
