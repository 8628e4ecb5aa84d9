import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from occuflow.llm import jaccard_join
from occuflow.llm.components import components


def shingle_set(text, width=4):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute(texts, percent=85):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    label = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        x = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * x >= percent * (len(sets[a]) + len(sets[b]) - x) and label[a] != label[b]:
            lo, hi = sorted((label[a], label[b]))
            label = {k: lo if v == hi else v for k, v in label.items()}
    return {i: (len(sets[i]), label[i]) for i in sets}


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randint(0, 400)
    texts = [None, "", "  ", "one", "ONE", "one two", "two one", "A b\tc", "a b c", "long " * 4000, "long " * 4000 + "end"]
    passage = [word() for _ in range(60)]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(4, 120))]
        if rng.random() < 0.5:
            base = base[:20] + passage + base[20:]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    return dict(enumerate(texts))


@pytest.mark.parametrize(("rounds", "limits", "seed"), [(3, {}, 1), (1, {"rows": 2}, 2), (0, {"rows": 3, "shingles": 200}, 3), (2, {"rows": 5}, 4)])
def test_matches_brute_force(make_docs, folder, monkeypatch, rounds, limits, seed):
    monkeypatch.setattr(jaccard_join, "ROUNDS", rounds)
    monkeypatch.setattr(jaccard_join, "LEAF", 3)
    texts = corpus(seed)
    docs = make_docs(list(texts.values()), [(None, "x y z", "en", "s", 5), (3, "one", "en", "s", 3)])
    for c in ("n", "region", "rep", "node", "label", "maybe", "set"):
        docs = docs.withColumn(c, F.lit(1))
    rows = jaccard_join.jaccard_components(docs, folder, **limits).collect()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert got.pop(None) == (1, None)
    assert got == brute(texts) and len(rows) == len(got) + 1


def test_rows_of_one_id_are_one_document(make_docs, folder):
    w, z = "a large text of some ten words that is a copy", "another short text here"
    rows = [(1, z, None, None, None), (5, w, None, None, None), (5, z, None, None, None), (2, w, None, None, None), (7, "alone in all of this", None, None, None), (5, w, None, None, None)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(make_docs([], rows), folder).collect()}
    assert got == {1: (1, 1), 2: (8, 1), 5: (8, 1), 7: (2, 7)}


def test_large_groups_are_stars(spark, make_docs, folder):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for k in range(400):  # near copies at various distances of one text, many of them within the radius
        copy = list(base)
        for _ in range(rng.choice((0, 1, 1, 2, 3))):
            copy[rng.randrange(150)] = f"x{k}-{rng.random()}"
        texts.append(" ".join(copy))
    texts = dict(enumerate(texts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(make_docs(list(texts.values())), folder).collect()}
    assert got == brute(texts)
    rows = spark.read.parquet(f"{folder}/distances0")
    met, homes = rows.count(), rows.where("near AND node <> pivot").select("node").distinct().count()
    assert met < 8 * len(texts) and homes > 150, (met, homes)


def test_rows_without_an_id_keep_their_rows_sizes_and_links(make_docs, folder):
    w, z, lone = "a large text of some ten words that is a copy", "another text of seven short words here", "alone in all of this"
    near = w + " indeed"
    rows = [(None, t, None, None, None) for t in (w, w, near, lone, lone, None, "")] + [(8, w, None, None, None), (4, z, None, None, None), (None, z, None, None, None), (6, None, None, None, None)]
    got = [tuple(r) for r in jaccard_join.jaccard_components(make_docs([], rows), folder).collect()]
    n = lambda t: len(t.split()) - 3
    linked = 8 if 100 * n(w) >= 85 * n(near) else None
    want = [(None, n(w), 8)] * 2 + [(None, n(near), linked), (None, n(lone), None), (None, n(lone), None), (None, 0, None), (None, 0, None), (8, n(w), 8), (4, n(z), 4), (None, n(z), 4), (6, 0, 6)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_empty_table(make_docs, folder):
    assert jaccard_join.jaccard_components(make_docs(["a"]).limit(0), folder).count() == 0


def test_region_recursion_is_exact():
    rng = np.random.default_rng(0)
    for percent in (50, 70, 85):
        sets = []
        for _ in range(25):
            base = rng.choice(3000, 60, replace=False)
            for _ in range(12):
                keep = base[rng.random(60) > 0.06]
                sets.append(np.unique(np.append(keep, rng.integers(0, 3000, 3))).astype(np.uint64))
        region = jaccard_join.Region(np.arange(len(sets)), sets)
        region.join(np.arange(len(sets)), percent)
        label = np.arange(len(sets))
        for a, b in itertools.combinations(range(len(sets)), 2):
            x = len(np.intersect1d(sets[a], sets[b]))
            if 100 * x >= percent * (len(sets[a]) + len(sets[b]) - x):
                label[label == max(label[a], label[b])] = min(label[a], label[b])
        assert region.label.tolist() == label.tolist()


def test_components_of_a_long_chain(spark, folder):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (101, 100)], "a long, b long")
    got = {r["id"]: r["component"] for r in components(links, folder).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_texts_read_again_are_filtered_by_a_bitmap_of_fixed_size(make_docs, folder):
    docs = make_docs([f"one two three four {i}" for i in range(300)]).select("doc_id", "text")
    ids = docs.where("doc_id % 3 = 0").select("doc_id")
    assert jaccard_join.id_filter(ids.limit(3)).nbytes == jaccard_join.id_filter(ids).nbytes == jaccard_join.FILTER_BITS // 8
    got = jaccard_join.sets_table(docs, ids, True)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    held = {r["doc_id"] for r in got.collect()}
    assert held >= set(range(0, 300, 3)) and len(held) <= 105
    assert jaccard_join.sets_table(docs, ids.limit(0), True).count() == 0


def test_joins_move_the_sets_that_they_need_alone(spark, folder):
    rows = [(i, 4, np.arange(i // 2 * 2, i // 2 * 2 + 4, dtype=np.uint64).tobytes()) for i in range(600)]
    sets = spark.createDataFrame(rows, "node long, n long, set binary")
    held = {r["node"] for r in jaccard_join.among(sets, sets.where("node % 3 = 0").select("node")).collect()}
    assert held >= set(range(0, 600, 3)) and len(held) <= 205
    assert jaccard_join.among(sets, sets.limit(0)).count() == 0
    # own pairs are answered without sets: the set of a pivot that only meets itself isn't read
    bare = sets.withColumn("set", F.when(F.col("node") < 10, F.col("set")))
    pairs = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (500, 500)], "node long, pivot long")
    got = {(r["node"], r["pivot"]): (r["n"], round(r["similarity"], 6), r["near"]) for r in jaccard_join.distances(pairs, bare, 85).collect()}
    assert got == {(0, 0): (4, 1.0, True), (1, 0): (4, 1.0, True), (2, 0): (4, 0.333333, False), (500, 500): (4, 1.0, True)}


def test_no_table_of_a_join_lies_on_the_driver(spark, tmp_path, monkeypatch):
    plans = []

    def seen(df, folder, name, write=jaccard_join.staged):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, folder, name)

    monkeypatch.setattr(jaccard_join, "staged", seen)
    base = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join([*base[: 60 - i % 3], f"x{i % 7}"])) for i in range(40)], "doc_id long, text string")
    out = jaccard_join.jaccard_components(docs, str(tmp_path / "work"), rows=8)
    plans.append(("out", out._jdf.queryExecution().executedPlan().toString()))
    assert {"pairs0", "distances0", "regions", "label"} <= {name for name, _ in plans}
    assert [name for name, plan in plans if "Broadcast" in plan] == []
