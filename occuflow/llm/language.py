"""Language identification by error-correcting output codes.

Every language has a codeword of bits; one binary classifier a bit, linear over hashed character
n-grams, predicts it. Decoding takes the codeword of least loss, where a bit's loss counts by how
well that bit told the language apart in training; a small gap to the second codeword flags an
ambiguous text. The classifiers are fitted on a bounded sample; predicting is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .common import id_crc, table
from .hashing import sigmoid

BITS = 13
ORDERS = (1, 2, 3, 4)
#: Most texts that the classifiers are fitted on, shared equally by the languages.
SAMPLE = 2_000
#: Besides its whole text, each sampled one gives a passage of this many characters, so that short texts are learnt too.
PASSAGE = 60
#: Code points of a text that are read at once.
SLICE = 1 << 18
#: A second codeword within this factor of the first one's probability makes a text ambiguous.
AMBIGUOUS = 0.5
UNKNOWN = "und"
SPACE = 32


class Letters:
    """Which code points are letters; the table is made once a worker."""

    table: np.ndarray | None = None

    @classmethod
    def of(cls, codes: np.ndarray) -> np.ndarray:
        if cls.table is None:
            cls.table = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        return cls.table[codes]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def slices(text: str) -> Iterator[tuple[np.ndarray, int]]:
    """A text's lower-case letters with one space for all between them, and one before and after: (code points, number of window starts).

    Long texts come in slices; each repeats the last code points of the one before, so that every window is met once.
    """
    most = max(ORDERS) - 1
    held = np.array([SPACE], np.uint32)
    for at in range(0, len(text), SLICE):
        codes = code_points(text[at : at + SLICE].lower())
        codes = np.where(Letters.of(codes), codes, SPACE).astype(np.uint32)
        joined = np.concatenate([held, codes])
        # of the code points held back only the last one can be doubled by a space that follows
        keep = np.concatenate([np.ones(len(held), bool), (joined[len(held) :] != SPACE) | (joined[len(held) - 1 : -1] != SPACE)])
        joined = joined[keep]
        last = at + SLICE >= len(text)
        if last and joined[-1] != SPACE:
            joined = np.append(joined, np.uint32(SPACE))
        starts = len(joined) if last else max(len(joined) - most, 0)
        yield joined, starts
        held = joined[starts:]


def histogram(text: str | None) -> np.ndarray | None:
    """Counts of the hashed n-grams of a whole text, or None if it has no letter."""
    out, letters = np.zeros(1 << BITS, np.int64), False
    for codes, starts in slices(text or ""):
        letters = letters or bool((codes != SPACE).any())
        h = np.zeros(len(codes), np.uint32)
        for k in range(max(ORDERS)):
            h = h[: len(codes) - k] * np.uint32(0x01000193) + codes[k:]
            if k + 1 in ORDERS:
                mixed = (h[:starts] ^ np.uint32(k * 0x5BD1E995 & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
                out += np.bincount(mixed >> np.uint32(32 - BITS), minlength=1 << BITS)
    return out if letters else None


def scaled(counts: np.ndarray) -> np.ndarray:
    """Roots of the shares, so that a text's features have length 1."""
    return np.sqrt(counts / counts.sum(axis=-1, keepdims=True)).astype(np.float32)


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """A codeword of +-1 for each of n languages: all distinct splits up to five of them, beyond that the best of many seeded draws.

    Best means the largest least distance between two codewords; two bits never make the same split.
    """
    if n <= 5:
        rows = [[1 if i == 0 or i in s else -1 for i in range(n)] for k in range(n - 1) for s in combinations(range(1, n), k)]
        return np.array(rows, np.int8).reshape(-1, n).T
    length, rng, best, most = int(np.ceil(6 * np.log2(n))), np.random.default_rng(seed), None, -1
    for _ in range(200):
        draw = np.where(rng.permuted(np.tile(np.arange(n), (length, 1)), axis=1) < n // 2, 1, -1)
        draw = np.unique(draw * draw[:, :1], axis=0).T  # one of each split
        near = draw.shape[1] - (draw.astype(np.int32) @ draw.T + draw.shape[1]) // 2 + np.eye(n, dtype=np.int32) * length
        if near.min() > most:
            best, most = draw, near.min()
    return best.astype(np.int8)


@dataclass
class Codes:
    """Languages, their codewords, the bits' linear classifiers, and how much each bit counts for each language."""

    languages: list[str]
    words: np.ndarray  # (languages, bits)
    weights: np.ndarray  # (features, bits)
    bias: np.ndarray
    trust: np.ndarray  # (languages, bits); rows sum to 1

    @classmethod
    def fit(cls, x: np.ndarray, language: list[str], rounds: int = 80) -> Codes:
        """Logistic regression of every bit, by Adam over the whole sample; languages count equally.

        No text: no language, one language: no bit, and it is always predicted.
        """
        names, y = np.unique(np.array(language, object).astype(str), return_inverse=True) if len(language) else (np.array([], str), np.zeros(0, int))
        words = codewords(len(names)) if len(names) else np.zeros((0, 0), np.int8)
        bits = words.shape[1]
        w, b = np.zeros((1 << BITS, bits), np.float32), np.zeros(bits, np.float32)
        if not bits:
            return cls(list(names), words, w, b, np.zeros(words.shape))
        target, share = (words[y] > 0).astype(np.float32), (1 / np.bincount(y)[y] / len(names)).astype(np.float32)[:, None]
        first, second, fb, sb = 0.0, 0.0, 0.0, 0.0
        for k in range(1, rounds + 1):
            err = (sigmoid(x @ w + b) - target) * share
            g, gb = x.T @ err + 1e-6 * w, err.sum(axis=0)
            first, second, fb, sb = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g, 0.9 * fb + 0.1 * gb, 0.99 * sb + 0.01 * gb * gb
            w -= 0.3 * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
            b -= 0.3 * (fb / (1 - 0.9**k)) / (np.sqrt(sb / (1 - 0.99**k)) + 1e-8)
        right = ((x @ w + b > 0) == (target > 0)).astype(float)
        trust = np.stack([right[y == c].mean(axis=0) for c in range(len(names))])
        trust = np.maximum(2 * trust - 1, 1e-3)  # a bit no better than a coin hardly counts
        return cls(list(names), words, w, b, trust / trust.sum(axis=1, keepdims=True))

    def losses(self, x: np.ndarray) -> np.ndarray:
        """(texts, languages): the trusted mean of the bits' logistic losses against each codeword."""
        margin = (x @ self.weights + self.bias).astype(float)
        return np.stack([(np.logaddexp(0, -margin * word) * trust).sum(axis=1) for word, trust in zip(self.words, self.trust, strict=True)], axis=1)

    def chances(self, x: np.ndarray) -> np.ndarray:
        """Losses over all bits as probabilities of the languages."""
        loss = self.losses(x) * max(self.words.shape[1], 1)
        e = np.exp(loss.min(axis=1, keepdims=True) - loss)
        return e / e.sum(axis=1, keepdims=True)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, its probability and whether the second is near; texts without a letter are unknown, with score 0."""
        names, score, near = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        if not self.languages:
            return names, score, near
        for i in range(0, len(texts), 200):
            found = [(i + k, h) for k, h in enumerate(map(histogram, texts[i : i + 200])) if h is not None]
            if not found:
                continue
            p = self.chances(scaled(np.stack([h for _, h in found])))
            best, ranked = p.argmax(axis=1), np.sort(p, axis=1)
            for (k, _), c, q, r in zip(found, best, p, ranked, strict=True):
                names[k], score[k] = self.languages[c], q[c]
                near[k] = len(r) > 1 and r[-2] > AMBIGUOUS * r[-1]
        return names, score, near


def passage(text: str) -> str:
    """A piece from a text's middle."""
    at = max((len(text) - PASSAGE) // 2, 0)
    return text[at : at + PASSAGE]


def train(docs: DataFrame, sample: int = SAMPLE, text: str = "text", lang: str = "lang") -> Codes:
    """Codes fitted on at most ``sample`` texts with a language, as many of each as there are, up to an equal share.

    Rows without a text, a letter or a language teach nothing; a text repeated in a language counts once. Texts are
    chosen by their hash: the same at any partitioning. Languages beyond ``sample`` would get no text: there is one each at least.
    """
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.where(F.regexp_like("text", F.lit("\\p{L}"))).withColumn("h", F.xxhash64("text"))
    each = rows.select("lang", "h").distinct()
    counts = each.groupBy("lang").count()
    share = F.greatest(F.floor(F.lit(sample) / F.count("*").over(Window.partitionBy(F.lit(0)))), F.lit(1))
    # one row a language: first by a threshold of the hash, with room to spare, then the exact number
    wanted = counts.select("lang", "count", share.alias("share"))
    part = F.pmod(F.xxhash64(F.lit(23), "h"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    few = each.join(F.broadcast(wanted), "lang").where(part * F.col("count") <= F.col("share") + 6 * F.sqrt("share") + 10)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(23), "h"), "h"))
    chosen = few.withColumn("rank", rank).where(F.col("rank") <= F.col("share")).select("lang", "h")

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for language, text in zip(pdf["lang"], pdf["text"], strict=True):
                for counts in filter(lambda c: c is not None, map(histogram, (text, passage(text)))):
                    k = np.flatnonzero(counts)
                    out.append((language, k.astype(np.int32), counts[k].astype(np.int32)))
            yield pd.DataFrame(out, columns=["lang", "k", "n"])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lang", kind="stable")
        x = np.zeros((len(pdf), 1 << BITS), np.float32)
        for row, k, n in zip(x, pdf["k"], pdf["n"], strict=True):
            row[k] = n
        codes = Codes.fit(scaled(x), list(pdf["lang"]))
        cells = lambda m: [float(v) for v in np.asarray(m).ravel()]
        return pd.DataFrame({"names": [codes.languages], "words": [cells(codes.words)], "weights": [cells(codes.weights)], "bias": [cells(codes.bias)], "trust": [cells(codes.trust)]})

    samples = rows.join(F.broadcast(chosen), ["lang", "h"]).dropDuplicates(["lang", "h"]).orderBy("h").mapInPandas(extract, "lang string, k array<int>, n array<int>")
    got = samples.groupBy().applyInPandas(fit, "names array<string>, words array<double>, weights array<float>, bias array<float>, trust array<double>").collect()
    if not got:
        return Codes.fit(np.zeros((0, 1 << BITS), np.float32), [])
    names, n = got[0]["names"], len(got[0]["names"])
    return Codes(
        list(names), np.array(got[0]["words"], np.int8).reshape(n, -1), np.array(got[0]["weights"], np.float32).reshape(1 << BITS, -1),
        np.array(got[0]["bias"], np.float32), np.array(got[0]["trust"]).reshape(n, -1),
    )


def identify(docs: DataFrame, codes: Codes, text: str = "text") -> DataFrame:
    """Every row with its columns and lang_pred, score, ambiguous, which replace columns of their names.

    Whole texts are read, in slices of bounded memory. A null text, an empty one and one without a letter are ``und``
    with score 0, as is every text if nothing was learnt; with one language learnt its score is 1. Repeated rows are judged alike, ties
    between codewords go to the first language by name, an empty table gives no rows.
    """
    docs = docs.drop("lang_pred", "score", "ambiguous")
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("ambiguous", BooleanType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 500):
                part = pdf.iloc[i : i + 500]
                names, score, near = codes.predict(list(part[text]))
                yield part.assign(lang_pred=names, score=score, ambiguous=near)

    return docs.mapInPandas(run, schema)


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from the documents that aren't held out: doc_id, held_out, lang_pred, score, ambiguous."""
    held = F.pmod(id_crc(F.col("doc_id")), F.lit(4)) == 2
    docs = table(spark, sf_dir, "documents")
    codes = train(docs.where(~held))
    return identify(docs.select("doc_id", held.alias("held_out"), "text"), codes).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
