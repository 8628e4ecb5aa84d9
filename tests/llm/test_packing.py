import itertools
import random

import numpy as np

from occuflow.llm import packing


def padding(lengths, counts, upper):
    return sum(c * (min(u for u in upper if u >= x) - x) for x, c in zip(lengths, counts))


def test_boundaries_are_optimal():
    rng = random.Random(5)
    for _ in range(30):
        x = sorted(rng.sample(range(40), rng.randint(1, 8)))
        c = [rng.randint(1, 9) for _ in x]
        k = rng.randint(1, 4)
        got = packing.boundaries(np.array(x), np.array(c), k)
        assert got[-1] == x[-1] and len(got) <= k
        best = min(padding(x, c, [*s, x[-1]]) for n in range(min(k, len(x))) for s in itertools.combinations(x[:-1], n))
        assert padding(x, c, got) == best


def test_pack_keeps_every_token_and_the_budget(make_docs):
    rng = random.Random(7)
    texts = [None, "", "  \n", "one", *(" ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(1, 90))) for _ in range(300)), "tok " * 1000]
    rows = packing.pack(make_docs(texts), buckets=4, budget=200, max_length=64, group=20).collect()
    tokens, batches = {}, {}
    for r in rows:
        tokens[r["doc_id"]] = tokens.get(r["doc_id"], 0) + r["length"]
        batches.setdefault((r["bucket"], r["batch"]), []).append(r)
        assert r["length"] <= r["padded_length"] <= 64
    assert tokens == {i: len((t or "").split()) for i, t in enumerate(texts)}
    for (bucket, batch), held in batches.items():
        assert sum(r["padded_length"] for r in held) <= 200
        assert sorted(r["position"] for r in held) == list(range(len(held)))
    full = {b: [k for bb, k in batches if bb == b] for b in {b for b, _ in batches}}
    assert all(sorted(v) == list(range(len(v))) for v in full.values())


def test_empty_null_id_and_repeated_rows(make_docs):
    docs = make_docs(["a b c"] * 5, [(None, "x y", None, None, None), (0, "a b c", "en", "s", 5)])
    assert packing.pack(docs).count() == 7
    assert packing.pack(docs.limit(0)).count() == 0


def test_clashing_columns_and_regular_ids(make_docs):
    from pyspark.sql import functions as F

    docs = make_docs([], [(10 * i, "a b c", "en", "s", 5) for i in range(400)])
    for c in ("length", "bucket", "piece", "part", "n", "mark", "offset", "batch"):
        docs = docs.withColumn(c, F.lit("mine"))
    rows = packing.pack(docs, budget=30, group=40).collect()
    assert sorted(r["doc_id"] for r in rows) == [10 * i for i in range(400)] and {r["length"] for r in rows} == {3}
    parts = docs.select(F.pmod(F.xxhash64("doc_id", F.xxhash64("text"), F.lit(0)), F.lit(10)).alias("p")).distinct().count()
    assert parts == 10


def test_texts_of_one_id_keep_their_places_in_any_order(make_docs):
    """Rows of one id, or none, with texts of several lengths: the same batches whatever the order and partitions; they lie in several groups."""
    rng = random.Random(11)
    rows = [(None if k % 3 else 7, "".join(rng.choice("ab") for _ in range(12)) + " x" * (k % 5), None, None, None) for k in range(300)]
    docs = make_docs([], rows)
    of = lambda df: sorted(map(str, packing.pack(df, buckets=3, budget=12, group=20).collect()))
    assert of(docs) == of(make_docs([], rows[::-1]).repartition(7))
    parts = packing.pieces(docs).where("doc_id = 7").selectExpr("pmod(xxhash64(doc_id, mark, piece), 15) AS part").groupBy("part").count().collect()
    assert len(parts) > 5
