import collections
import math
import random
import re

from pyspark.sql import functions as F

from occuflow.llm import decontamination

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width=5):
    w = [x for x in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if x]
    return [tuple(w[i : i + width]) for i in range(len(w) - width + 1)]


def width_of(text):
    return min(5, len(shingles(text, 1)))


def brute(docs, bench, least=0.8):
    """All windows of an item's length against all items that share a shingle with them."""
    items = [(i, width, shingles(t, width)) for i, t in set(bench) if (width := width_of(t))]
    df = collections.Counter(x for _, _, s in items for x in set(s))
    weight, foreign = {x: math.log(1 + len(items) / c) for x, c in df.items()}, math.log(1 + len(items))
    of = lambda xs: sum(weight.get(x, foreign) for x in xs)
    out = {}
    for d, t in docs:
        by_width = {width: shingles(t, width) for width in {w for _, w, _ in items}}
        for i, width, item in items:
            s, own = by_width[width], set(item)
            near = {a for p, x in enumerate(s) if x in own for a in range(p - len(item) + 1, p + 1)}
            for a in {min(max(a, 0), max(len(s) - len(item), 0)) for a in near}:
                w = set(s[a : a + len(item)])
                v = of(w & own) / of(w | own)
                if v >= least:
                    out[d, i] = max(v, out.get((d, i), 0))
    return out


def test_matches_brute_force(spark, make_docs, folder):
    rng = random.Random(4)
    vocabulary = ["Wa", "be", "çe", "do", "el", "fo", "gu", "ha", "it", "jo"]
    text = lambda n: " ".join(rng.choice(vocabulary) + str(rng.randint(0, 3)) for _ in range(n))
    bench = [(i, text(rng.randint(5, 60))) for i in range(25)] + [(25, "a b c"), (26, None), (27, "r r r r r r r r r")]
    bench += [(28, bench[3][1]), (29, "Wa0 zebra"), (30, "q1"), (31, ""), (None, bench[4][1])]
    docs = [None, "", "a b c", "so a b c d", "q1", "see wa0 Zebra, wa0 zebra", "r " * 500, *(text(rng.randint(1, 200)) for _ in range(20))]
    for _, t in bench[:25]:
        w = t.split()
        docs += [f"{text(30)}\n{t.upper()}\t{text(9)}", t, " ".join(w[:-1]), " ".join([*w[:3], "zz", *w[3:]]), f"{t} {bench[0][1]}"]
        w[rng.randrange(len(w))] = "changed"
        docs.append(f"{text(12)} {' '.join(w)}")
    df = make_docs(docs).withColumn("row", F.lit(0)).withColumn("n", F.lit(0)).withColumn("item_id", F.lit(7)).withColumn("start", F.lit(1)).withColumn("win", F.lit(1)).withColumn("all", F.lit(1))
    rest = [(None, docs[20]), (5, docs[21]), (5, docs[5])]
    df = df.unionByName(make_docs([], [(i, t, None, None, None) for i, t in rest]), allowMissingColumns=True)
    rows = decontamination.contaminations(df, spark.createDataFrame(bench, "item_id long, text string"), folder).collect()
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in rows}
    want = brute([*enumerate(docs), *rest], bench)
    assert set(got) == set(want) and len(rows) >= len(got)
    assert not [(k, got[k], want[k]) for k in got if not 0.8 <= got[k] <= want[k] + 1e-9]  # the best aligned window, which may lie beside the best of all
    assert sum(abs(got[k] - want[k]) < 1e-9 for k in got) > 0.9 * len(got)


def test_empty_tables(spark, make_docs, folder):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontamination.contaminations(make_docs(["a b c d e f"]), none, folder + "/a").count() == 0
    assert decontamination.contaminations(make_docs(["a"]).limit(0), some, folder + "/b").count() == 0


def test_recall_on_the_tables(spark, folder):
    """Of all windows of all items that reach the threshold, at least 0.9 of the pairs of text and item are found, and none besides."""
    sf = "/root/testdata/sf0.01"
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    pairs = lambda df, i: [tuple(r) for r in df.select(i, "text").collect()]
    want = set(brute(pairs(docs, "doc_id"), pairs(bench, "item_id")))
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminations(docs, bench, folder).collect()}
    assert want and got <= want and len(got) >= 0.9 * len(want), (len(got), len(want))


def within_radius(p, i):
    return sum(((p[f] ^ i[f]) & (2**64 - 1)).bit_count() for f in ("fp", "fp2")) <= decontamination.RADIUS


def test_the_index_passes_few_unrelated_pairs(spark):
    """Random fingerprints meet at a chance of 1 - (1 - 697 / 65,536)^8 = 8.2 percent; pairs just within the radius always do."""
    rng = random.Random(5)
    long = lambda: rng.getrandbits(64) - 2**63
    schema = "content long, item long, width int, n int, fp long, fp2 long"
    items = [(k, k, 5, 9, long(), long()) for k in range(200)]
    prints = [(k, k, 5, 9, long(), long()) for k in range(200, 400)]
    for k, _, w, n, *fp in items[:100]:
        for b in rng.sample(range(128), decontamination.RADIUS):
            x = (fp[b // 64] & (2**64 - 1)) ^ (1 << b % 64)
            fp[b // 64] = x - 2**64 if x >> 63 else x
        prints.append((1000 + k, k, w, n, *fp))
    met = decontamination.meetings(spark.createDataFrame(prints, schema).drop("item"), spark.createDataFrame(items, schema).drop("content")).select("content", "item").distinct().collect()
    got = {tuple(r) for r in met}
    assert {(1000 + k, k) for k in range(100)} <= got
    assert len([p for p in got if p[0] < 1000]) < 0.1 * 200 * 200


def test_what_the_index_passes_on_the_tables(spark, folder):
    """All pairs within the radius meet, and few others; those share a shingle at least, so more of them meet than of random ones."""
    sf = "/root/testdata/sf0.1"
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    _, prints, known, _ = decontamination.fingerprinted(docs, bench, folder)
    met = {(r["content"], r["item"]) for r in decontamination.meetings(prints, known).collect()}
    items = known.collect()
    pairs = {(p["content"], i["item"]): within_radius(p, i) for p in prints.collect() for i in items if (p["width"], p["n"]) == (i["width"], i["n"])}
    within = {p for p, near in pairs.items() if near}
    assert within and within <= met <= set(pairs)
    assert len(met - within) < 0.15 * (len(pairs) - len(within)), (len(met), len(within), len(pairs))


def test_large_sides_are_salted(spark, make_docs, folder, monkeypatch):
    """Without any broadcast the result is the same; a passage that most texts hold is verified once."""
    bench = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(12))) for i in range(5)], "item_id long, text string")
    passage = " ".join(f"W3x{k}" for k in range(12))
    docs = make_docs([f"{'left ' * (k % 4)}{passage} right {k}" for k in range(60)] + [" ".join(f"w1x{k}" for k in range(12)), None, "w2x0 w2x1"])
    rows = lambda name: sorted(map(tuple, decontamination.contaminations(docs, bench, f"{folder}/{name}").collect()))
    want = rows("broadcast")
    assert [(r[0], r[1]) for r in want] == [*((k, 3) for k in range(60)), (60, 1)]
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(decontamination, "BROADCAST_TEXTS", 0)
    assert rows("salted") == want
    assert spark.read.parquet(f"{folder}/salted/verified").count() < 10
