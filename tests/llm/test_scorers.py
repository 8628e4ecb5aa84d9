import numpy as np
from pyspark.sql import functions as F

from occuflow.llm import quality, toxicity
from occuflow.llm.hashing import bucket, word_list


def texts_and_labels(n=600, seed=3):
    """Toxic only if an insult and a group stand together; either alone is not."""
    rng = np.random.default_rng(seed)
    texts, labels = [], []
    for i in range(n):
        w = [f"word{x}" for x in rng.integers(0, 60, 25)]
        insult, group = i % 2, i // 2 % 2
        w += ["fool"] * insult + ["zorgs"] * group
        rng.shuffle(w)
        texts.append(" ".join(w))
        labels.append(insult * group)
    return texts, np.array(labels)


def test_pairs_are_learnt():
    texts, labels = texts_and_labels()
    model = fitted(texts[:400], labels[:400])
    score = model.score(texts[400:])
    assert ((score >= 0.5) == labels[400:]).mean() > 0.98


def fitted(texts, labels):
    terms = [np.array(sorted(set().union(*map(toxicity.terms_of, set(word_list(t))))), np.int64) for t in texts]
    return toxicity.FactorizationMachine.fit(terms, hashed_words(texts), labels)


def hashed_words(texts):
    return [np.array(sorted({bucket(w, toxicity.BITS) for w in word_list(t)}), np.int64) for t in texts]


def test_pairs_without_marginal_effects_are_learnt():
    """Each word alone is as frequent in toxic as in clean texts; only both or neither is toxic."""
    texts, labels = texts_and_labels(1600)
    labels = np.array([(("fool" in t.split()) == ("zorgs" in t.split())) * 1 for t in texts])
    for word in ("fool", "zorgs"):
        assert labels[[word in t.split() for t in texts]].mean() == 0.5
    found = toxicity.paired(hashed_words(texts[:1200]), labels[:1200].astype(float))
    assert sorted(found) == sorted(bucket(w, toxicity.BITS) for w in (b"fool", b"zorgs"))
    score = fitted(texts[:1200], labels[:1200]).score(texts[1200:])
    assert ((score >= 0.5) == labels[1200:]).mean() > 0.98


def test_a_group_toxic_only_beside_an_insult_is_found():
    """The insult has a toxic share of its own; the group's mention, as frequent in both kinds, has none."""
    rng = np.random.default_rng(8)
    texts, labels = [], []
    for i in range(2400):
        insult, group, other = i % 4 == 0, i // 4 % 2 == 0, i // 8 % 8 < 3
        y = (insult and group) or (not insult and not group and other)
        w = [f"word{x}" for x in rng.integers(0, 60, 20)] + ["fool"] * insult + ["zorgs"] * group + ["vile"] * (y and not insult)
        texts.append(" ".join(w))
        labels.append(int(y))
    assert bucket(b"zorgs", toxicity.BITS) in toxicity.paired(hashed_words(texts), np.array(labels, float))
    score = fitted(texts[:1800], np.array(labels[:1800])).score(texts[1800:])
    assert ((score >= 0.5) == np.array(labels[1800:])).mean() > 0.98


def test_pair_counts_are_those_of_a_double_loop():
    rng = np.random.default_rng(9)
    docs = [np.unique(rng.integers(0, 14, rng.integers(0, 14))) for _ in range(1500)]
    y = np.array([float(((1 in d) == (2 in d)) ^ (rng.random() < 0.1)) for d in map(list, docs)])
    p, want = y.mean(), set()
    has = [np.array([w in d for d in docs]) for w in range(14)]
    odds = [np.log((y[h].sum() + p) / ((1 - y[h]).sum() + 1 - p)) - np.log(p / (1 - p)) for h in has]
    for a in range(14):
        for b in range(a + 1, 14):
            both = has[a] & has[b]
            k, e = both.sum(), 1 / (1 + np.exp(-(np.log(p / (1 - p)) + odds[a] + odds[b])))
            if min(has[a].sum(), has[b].sum()) >= toxicity.PAIR_WORD_DOCS and k >= toxicity.PAIR_DOCS and abs(y[both].sum() - k * e) >= toxicity.PAIR_Z * np.sqrt(k * e * (1 - e)):
                want |= {a, b}
    assert want and set(toxicity.paired(docs, y)) == want


def test_toxicity_over_spark(spark, make_docs):
    texts, labels = texts_and_labels(300)
    docs = make_docs([*texts, None, "", "word1 " * 50_000], [(0, texts[0], None, None, None), (None, "fool", None, None, None)]).withColumn("toxic", F.lit(9)).withColumn("score", F.lit(1.0))
    rows = [(i, int(x)) for i, x in enumerate(labels)] + [(5, None), (None, 1)]
    model = toxicity.train(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
    got = toxicity.score(docs, model).collect()
    assert len(got) == 305 and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["score"] for r in got}
    assert np.mean([(by[i] >= 0.5) == labels[i] for i in range(300)]) > 0.97
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs.limit(0), none).count() == 0 and toxicity.score(docs, none).count() == 305


def quality_texts():
    rng = np.random.default_rng(4)
    out = []
    for i in range(200):
        w = list(rng.choice("the of and a house tree river walks under green light stone with for".split(), 60))
        good = i % 5 > 0
        if not good:
            w = [[x + "$$$" for x in w], [x.upper() + "!!" for x in w], [y for x in w for y in (x, "|")], ["same"] * 60][i // 5 % 4]
        out.append((" ".join(w) + ".", good))
    return out


def test_weak_labels_and_scorer(make_docs, folder):
    data = quality_texts()
    docs = make_docs([t for t, _ in data] + [None, "", "Hi there."], [(0, data[0][0], None, None, None), (None, "The end.", None, None, None)]).withColumn("votes", F.lit(1)).withColumn("k", F.lit(1))
    model, scorer = quality.train(docs, folder)
    assert sum(a > 0.6 for a in model.accuracy().values()) >= 5
    rows = quality.judge(docs, scorer).collect()
    assert len(rows) == 205 and {*docs.columns, "quality_score"} == set(rows[0].asDict())
    by = {r["doc_id"]: r["quality_score"] for r in rows}
    assert all((by[i] >= 0.5) == good for i, (_, good) in enumerate(data))
    assert by[200] == by[201] == 0 and by[202] >= 0.5


def test_em_finds_accuracies():
    rng = np.random.default_rng(5)
    truth = rng.random(4000) < 0.7
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.75, 0.9, 0.7])
    votes = np.where(rng.random((4000, 7)) < right, truth[:, None], ~truth[:, None])
    silent = rng.random((4000, 7)) < 0.2
    patterns = ["".join("-" if s else str(int(v)) for v, s in zip(a, b)) for a, b in zip(votes, silent)]
    counts = {p: patterns.count(p) for p in sorted(set(patterns))}
    model = quality.LabelModel.fit(counts)
    assert np.abs(np.array(list(model.accuracy().values())) - right).max() < 0.05
    assert ((model.posterior(patterns) > 0.5) == truth).mean() > 0.93


def test_empty_table(make_docs, folder):
    docs = make_docs(["a"]).limit(0)
    _, scorer = quality.train(docs, folder)
    assert quality.judge(docs, scorer).count() == 0


def test_scores_are_the_sums_over_terms_and_pairs():
    rng = np.random.default_rng(6)
    words = [b"fool", b"zorgs", b"river", b"word1", b"stone"]
    terms = np.array(sorted({t for w in words for t in toxicity.terms_of(w)}))
    model = toxicity.FactorizationMachine(terms, rng.normal(size=len(terms)), rng.normal(size=(len(terms), toxicity.FACTORS)), -0.3)
    texts = [None, "", "unknown", "fool", "Fool the zorgs, fool", "river stone word1 zorgs fool", "stone " * 9]
    place = {int(t): i for i, t in enumerate(terms)}
    for text, got in zip(texts, model.score(texts), strict=True):
        mine = sorted({place[t] for w in word_list(text) for t in toxicity.terms_of(w) if t in place})
        total = model.bias + sum(model.w[i] for i in mine) + sum(model.v[a] @ model.v[b] for k, a in enumerate(mine) for b in mine[k + 1 :])
        assert abs(got - 1 / (1 + np.exp(-total))) < 1e-9


def test_linear_scores_are_sums_of_features():
    rng = np.random.default_rng(7)
    scorer = quality.Scorer(rng.normal(size=1 << quality.BITS), 0.2)
    for text in ("A house, 12 lines\nA house, 12 lines\nand more", "x", "$$$ ||| of the of", "É" * 300 + " 9a9"):
        w = text.split()
        total = scorer.bias + sum(scorer.weights[quality.shape(x)] for x in w) / len(w)
        lines = text.split("\n")
        total += scorer.weights[quality.EQUAL] * sum(a == b for a, b in zip(w, w[1:])) / len(w) + scorer.weights[quality.SEEN] * (1 - len(set(w)) / len(w)) * min(len(w), 50) / 50
        total += scorer.weights[quality.LINE] * (1 - len(set(lines)) / len(lines)) + scorer.weights[quality.FUNCTION] * sum(x in quality.FUNCTION_WORDS for x in w) / len(w)
        assert abs(scorer.score([text])[0] - 1 / (1 + np.exp(-total))) < 1e-9


def test_repeated_ids_are_learnt_from_once(spark, make_docs, folder):
    data = quality_texts()
    docs = make_docs([t for t, _ in data], [(0, data[0][0], None, None, None)] * 3 + [(1, "another text of one", None, None, None)] * 3).withColumn("quality_score", F.lit("mine")).withColumn("mark", F.lit(1))
    _, scorer = quality.train(docs, folder)
    rows = quality.judge(docs, scorer, "judged").collect()
    assert len(rows) == 206 and {r["quality_score"] for r in rows} == {"mine"}
    assert len(quality.judge(docs, scorer).collect()[0]) == len(docs.columns)
    texts, labels = texts_and_labels(200)
    both = make_docs(texts, [(0, texts[1], None, None, None)] * 5).withColumn("toxic", F.lit(1))
    model = toxicity.train(both, spark.createDataFrame([(i, int(x)) for i, x in enumerate(labels)] * 2, "doc_id long, toxic int"))
    assert toxicity.score(both, model).count() == 205
