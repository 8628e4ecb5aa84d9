import collections
import math
import zlib

import numpy as np
import xxhash
from pyspark.sql import functions as F

from occuflow.llm import lm_scoring
from occuflow.llm.ngram_trie import EliasFano, TemporaryTrie, Trie, discount


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 5), (1000, 1200), (1000, 10**6), (20_000, 10**9), (3, 10**12)):
        x = np.unique(rng.integers(0, top, n))
        seq = EliasFano.build(x)
        assert (seq.get(np.arange(len(x))) == x).all()
        q = np.concatenate([x, rng.integers(-3, top + 5, 500)])
        place = {int(v): i for i, v in enumerate(x)}
        assert seq.find(q).tolist() == [place.get(int(v), -1) for v in q]


def test_trie_gives_discounted_probabilities():
    rng = np.random.default_rng(1)
    size = 40
    t = rng.zipf(1.5, (6000, 3))
    t = t[(t < size).all(axis=1)]
    key, counts = np.unique((t[:2000, 0] * size + t[:2000, 1]) * size + t[:2000, 2], return_counts=True)
    near, far, word = key // size // size, key // size % size, key % size
    pair, context, triple, double = (collections.Counter() for _ in range(4))
    for a, b, w, n in zip(near.tolist(), far.tolist(), word.tolist(), counts.tolist()):
        pair[a, w] += n
        context[a] += n
        triple[a, b, w] += n
        double[a, b] += n
    d2, d3 = discount(np.array(list(pair.values()))), discount(np.array(list(triple.values())))

    def p(a, b, w, base):
        if context[a]:
            base = max(pair.get((a, w), 0) - d2, 0) / context[a] + d2 * sum(x[0] == a for x in pair) / context[a] * base
        if double[a, b]:
            base = max(triple.get((a, b, w), 0) - d3, 0) / double[a, b] + d3 * sum(x[:2] == (a, b) for x in triple) / double[a, b] * base
        return base

    with TemporaryTrie(Trie.build(near, far, word, counts, size)) as trie:
        got = trie.probability(t[:, 0], t[:, 1], t[:, 2], np.full(len(t), 0.001))
        all_words = trie.probability(np.full(size, 1), np.full(size, 1), np.arange(size), np.full(size, 1 / size))
    want = np.array([p(*map(int, x), 0.001) for x in t])
    assert np.abs(np.log10(got / want)).max() < 0.04  # a step of the quantised logarithms
    assert abs(all_words.sum() - 1) < 0.03


def tokens(text):
    return [*(text or "").encode().lower().split(), b"\n"]


def test_base_is_exact_and_context_helps(make_docs, folder):
    rng = np.random.default_rng(2)
    texts = [None, "", "  ", "Ünï wörd", *(" ".join(f"w{x} next{x} then{x}" for x in rng.integers(0, 40, 60)) for _ in range(200)), "far " * 20_000]
    docs = make_docs(texts, [(7, texts[7], "en", "s", 1), (None, "w1 next1", None, None, None)]).withColumn("key", F.lit(1)).withColumn("train", F.lit(True)).withColumn("score", F.lit(0))
    rows = lm_scoring.score(docs, folder).collect()
    all_rows = [*enumerate(texts), (7, texts[7]), (None, "w1 next1")]
    assert len(rows) == len(all_rows)
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 10 == 0
    count = collections.Counter(w for i, t in all_rows if not held(i) for w in tokens(t))
    n = sum(count.values())
    each = math.log10(n + 0.1 * (len(count) + 1))
    want = {i: (held(i), len(w := tokens(t)), sum(count[x] > 0 for x in w), n, sum(math.log10(count[x] + 0.1) - each for x in w)) for i, t in all_rows}
    for r in rows:
        a = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == a[:4]
        assert abs(r["base_score"] - a[4]) < 1e-6 * max(1, abs(a[4])) and r["score"] < 0
    test = [r for r in rows if r["held_out"] and r["n_tokens"] > 50]
    assert test and all(r["score"] > 0.8 * r["base_score"] for r in test)


def brute_scores(texts):
    """log10 P of each text under interpolated absolute discounting of order three, with one discount for pairs and one for trigrams."""
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 10 == 0
    one, pair, near_n, triple, far_n = (collections.Counter() for _ in range(5))

    def grams(text):
        w = [b"<", b"<", *tokens(text)]
        return [(w[i - 1], w[i - 2], w[i]) for i in range(2, len(w))]

    for i, t in texts:
        if not held(i):
            for a, b, w in grams(t):
                one[w] += 1
                pair[a, w] += 1
                near_n[a] += 1
                triple[a, b, w] += 1
                far_n[a, b] += 1
    successors, far_successors = collections.Counter(a for a, _ in pair), collections.Counter(x[:2] for x in triple)
    d2, d3 = discount(np.array([*pair.values(), 3])), discount(np.array([*triple.values(), 3]))
    n, v = sum(one.values()), len(one)

    def p(a, b, w):
        out = (one[w] + 0.1) / (n + 0.1 * (v + 1))
        if near_n[a]:
            out = max(pair[a, w] - d2, 0) / near_n[a] + d2 * successors[a] / near_n[a] * out
        if far_n[a, b]:
            out = max(triple[a, b, w] - d3, 0) / far_n[a, b] + d3 * far_successors[a, b] / far_n[a, b] * out
        return out

    return [sum(math.log10(p(*g)) for g in grams(t)) for _, t in texts]


def zipf_texts(n, seed=3):
    rng = np.random.default_rng(seed)
    return [" ".join(f"the w{x} of v{x * y % 11}" if y % 3 else f"w{x} the the v{y}" for x, y in rng.zipf(1.5, (12, 2)) % 30) for _ in range(n)]


def test_scores_match_brute_force(make_docs, folder, monkeypatch):
    texts = [None, "", *zipf_texts(150), "the " * 3000, "the the of the " * 50]
    rows = [*enumerate(texts), (None, "the w1 of v1"), (9, texts[9]), (9, "another text of the ninth")]
    docs = make_docs([], [(i, t, None, None, None) for i, t in rows])
    want = sorted(zip([str(i) for i, _ in rows], brute_scores(rows), [len(tokens(t)) for _, t in rows], strict=True))
    for name, shard, hot in (("whole", 10**6, 10**6), ("split", 200, 15)):
        monkeypatch.setattr(lm_scoring, "TRIE_SHARD", shard)
        monkeypatch.setattr(lm_scoring, "WORD_SHARD", shard)
        monkeypatch.setattr(lm_scoring, "HOT", hot)
        monkeypatch.setattr(lm_scoring, "BLOCK", 5 * shard)
        got = sorted((str(r["doc_id"]), r["score"], r["n_tokens"]) for r in lm_scoring.score(docs, f"{folder}/{name}").collect())
        assert len(got) == len(want)
        # a step of the quantised logarithms is 0.035, its half the most that one value is off; a token has up to four
        assert all(a[0] == b[0] and a[2] == b[2] and abs(a[1] - b[1]) < 0.036 * a[2] for a, b in zip(got, want, strict=True))
        assert abs(sum(a[1] for a in got) / sum(b[1] for b in want) - 1) < 0.01


def test_frequent_trigrams_are_dealt_by_text(make_docs, folder, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BLOCK", 400)
    hot = lm_scoring.Hot(np.sort(np.array([lm_scoring.model_hash(b"the"), lm_scoring.model_hash(b"of")])), np.array([10**6, 10**6]), 10**5)
    words = np.sort(np.array([lm_scoring.model_hash(x) for x in (b"the", b"of", b"rare", b"tiny")]))
    the, of, rare, tiny = (int(np.searchsorted(words, lm_scoring.model_hash(x))) for x in (b"the", b"of", b"rare", b"tiny"))
    text = np.arange(2000, dtype=np.int32)
    same = lambda x: np.full(2000, x)
    kinds = lambda a, b, c: len(np.unique(lm_scoring.salted(same(a), same(b), same(c), text, words, hot)))
    assert kinds(the, of, the) == 11 and kinds(the, of, rare) == kinds(the, rare, of) == kinds(tiny, the, of) == 1


def test_scores_do_not_depend_on_the_split(make_docs, folder, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BLOCK", 100)
    docs = make_docs(zipf_texts(90))

    def scores(name, shard, hot):
        monkeypatch.setattr(lm_scoring, "TRIE_SHARD", shard)
        monkeypatch.setattr(lm_scoring, "WORD_SHARD", shard)
        monkeypatch.setattr(lm_scoring, "HOT", hot)
        return {r["doc_id"]: r["score"] for r in lm_scoring.score(docs, f"{folder}/{name}").collect()}

    whole = scores("whole", 10**6, 10**6)
    for name, shard, hot in (("shards", 300, 10**6), ("split", 300, 20), ("one", 10**6, 20)):
        split = scores(name, shard, hot)
        assert all(abs(split[i] / x - 1) < 1e-5 for i, x in whole.items()), name


def test_rare_words_keep_their_own_counts(make_docs, folder):
    # over 2^20 tokens a word seen once shared a bucket, of the first 16 bits of its hash, with unseen ones
    top = lambda w: xxhash.xxh64_intdigest(w.encode()) >> 48
    unseen = next(w for i in range(10**7) if top(w := f"u{i}") == top("rare"))
    held = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0]
    train = sorted(set(range(1000)) - set(held))
    texts = {train[0]: "c " * 1_200_000, train[1]: "z rare", **{i: f"a{i} b{i}" for i in train[2:200]}, held[0]: "q rare q", held[1]: f"q {unseen} q"}
    docs = make_docs([], [(i, t, None, None, None) for i, t in texts.items()])
    got = {r["doc_id"]: r for r in lm_scoring.score(docs, folder).collect()}
    # 1.1 against 0.1 of a count; then q backs off from the seen word with the discount, 0.95 here, and from the unseen one with 1
    assert abs(got[held[0]]["score"] - got[held[1]]["score"] - math.log10(11 * 0.95)) < 0.06


def test_empty_table(make_docs, folder):
    assert lm_scoring.score(make_docs(["a"]).limit(0), folder).count() == 0
