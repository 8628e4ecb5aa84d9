import numpy as np
import pytest
from pyspark.sql import functions as F

from occuflow.llm import language

WORDS = {
    "en": "the house and river walk with green light stone over which there would again",
    "de": "das haus und der fluss geht mit grünem licht über steine welche nicht wieder",
    "fr": "la maison et le fleuve marche avec une lumière verte sur les pierres où déjà",
    "es": "la casa y el río camina con una luz verde sobre las piedras donde mañana",
    "it": "la casa e il fiume cammina con una luce verde sopra le pietre dove già gli",
    "nl": "het huis en de rivier loopt met een groen licht over stenen waar niet weer",
}


def texts(names, n, seed=1, size=40):
    rng = np.random.default_rng(seed)
    return [(" ".join(rng.choice(WORDS[x].split(), size)), x) for x in names for _ in range(n)]


def brute(text):
    """Hashed n-grams by a loop over the characters."""
    out, clean = np.zeros(1 << language.BITS, np.int64), " "
    for c in (text or "").lower():
        c = c if c.isalpha() else " "
        clean += "" if c == clean[-1] == " " else c
    clean += "" if clean[-1] == " " else " "
    if not clean.strip():
        return None
    for n in language.ORDERS:
        for i in range(len(clean) - n + 1):
            h = 0
            for c in clean[i : i + n]:
                h = (h * 0x01000193 + ord(c)) % 2**32
            h = (h ^ ((n - 1) * 0x5BD1E995 & 0xFFFFFFFF)) * 0x9E3779B1 % 2**32
            out[h >> (32 - language.BITS)] += 1
    return out


@pytest.mark.parametrize("slice_", [3, 7, 64, 1 << 18])
def test_histograms_are_those_of_a_loop(monkeypatch, slice_):
    monkeypatch.setattr(language, "SLICE", slice_)
    for text in ["Ein Haus, 12 Häuser!", "a", " a ", "日本語 と é̂", "x" * 30, "...b...", "a  b\n\tc" * 9, "𐐀𐐁 z"]:
        assert (language.histogram(text) == brute(text)).all()
    for text in [None, "", " ", "12 34", "!?" * 20]:
        assert language.histogram(text) is None


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6, 20])
def test_codewords_are_far_apart_and_bits_differ(n):
    words = language.codewords(n).astype(int)
    assert len(words) == n and {*words.ravel()} <= {-1, 1}
    bits = {tuple(b * b[0]) for b in words.T}
    assert len(bits) == words.shape[1] and all(len(set(b)) == 2 for b in bits)
    least = min((words[i] != words[j]).sum() for i in range(n) for j in range(i))
    assert least >= (1 if n == 2 else 2 ** (n - 2) if n <= 5 else 3)


def test_a_wrong_bit_is_corrected_and_loss_is_weighted():
    words = language.codewords(4)
    codes = language.Codes(["a", "b", "c", "d"], words, np.eye(7, dtype=np.float32), np.zeros(7, np.float32), np.full((4, 7), 1 / 7))
    margins = words.astype(np.float32) * 3
    margins[np.arange(4), [0, 2, 4, 6]] *= -1
    assert (codes.losses(margins).argmin(axis=1) == np.arange(4)).all()
    brute_loss = [[sum(np.log1p(np.exp(-m * w)) / 7 for m, w in zip(margin, word)) for word in words] for margin in margins.astype(float)]
    assert np.allclose(codes.losses(margins), brute_loss)


def learnt(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(rows)], "doc_id long, text string, lang string").repartition(3)
    return language.train(df, **kw)


@pytest.mark.parametrize("names", [["en", "de", "fr", "es"], list(WORDS)])
def test_held_out_texts_are_told_apart(spark, names):
    codes = learnt(spark, texts(names, 40) + [("words of none", None), (None, "en"), ("123", "de")])
    assert codes.languages == sorted(names)
    held = texts(names, 20, seed=2)
    got, score, near = codes.predict([t for t, _ in held])
    assert np.mean([g == x for g, (_, x) in zip(got, held)]) > 0.97 and ((score > 0) & (score <= 1)).all()
    short = texts(names, 20, seed=3, size=5)
    assert np.mean([g == x for g, (_, x) in zip(codes.predict([t for t, _ in short])[0], short)]) > 0.85
    mixed = codes.predict([WORDS["en"] + " " + WORDS["de"]])
    assert mixed[1][0] < 0.999


def test_nulls_repeats_clashes_and_long_texts(spark):
    rows = texts(["en", "de"], 30)
    codes = learnt(spark, rows + [rows[0]] * 500)
    long = WORDS["de"] * 20_000
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "123 !"), (4, long), (4, long), (None, WORDS["en"]), (5, "x")], "doc_id long, text string")
    docs = docs.withColumn("score", F.lit("mine")).withColumn("lang_pred", F.lit(1)).withColumn("n", F.lit(2))
    got = language.identify(docs, codes).collect()
    assert len(got) == 7 and set(got[0].asDict()) == {"doc_id", "text", "n", "score", "lang_pred", "ambiguous"}
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add((r["lang_pred"], r["score"]))
    assert by[1] == by[2] == by[3] == {("und", 0.0)} and len(by[4]) == 1
    assert {x for x, _ in by[4]} == {"de"} and {x for x, _ in by[None]} == {"en"}
    assert language.identify(docs.limit(0), codes).count() == 0


def test_none_one_and_bounded_samples(spark):
    docs = spark.createDataFrame([(1, "a text"), (2, None)], "doc_id long, text string")
    none = learnt(spark, [("a text", None)])
    assert [tuple(r)[2:4] for r in language.identify(docs, none).orderBy("doc_id").collect()] == [("und", 0.0)] * 2
    one = learnt(spark, [("a text", "en")])
    assert [tuple(r)[2:4] for r in language.identify(docs, one).orderBy("doc_id").collect()] == [("en", 1.0), ("und", 0.0)]
    rows = texts(["en", "de", "fr"], 60)
    assert (learnt(spark, rows, sample=30).weights == learnt(spark, rows[::-1], sample=30).weights).all()


def test_query_never_learns_from_held_out_rows(spark, tmp_path):
    from zlib import crc32

    held = [i for i in range(400) if crc32(str(i).encode()) % 4 == 2]
    rows = [(i, *r) for i, r in enumerate(texts(["en", "de"], 200))]
    rows = [(i, t, "secret" if i in held else x) for i, t, x in rows] + [(None, "the house", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = language.op11_language(spark, str(tmp_path)).collect()
    assert len(got) == 401 and {r["doc_id"] for r in got if r["held_out"]} == set(held)
    assert {r["lang_pred"] for r in got} == {"en", "de"}
