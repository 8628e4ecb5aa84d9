"""Toxicity: a factorization machine over hashed terms.

A text's terms are its distinct words and their leading characters, hashed. Linear weights find
insults; products of the terms' factors find pairs that are toxic only together, such as an
insult with a group's mention; words that matter in such pairs alone are found by counting pairs. The model is trained in one task on a bounded sample of labelled
rows and broadcast; scoring is one pass over the texts without a shuffle.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_crc, table
from .hashing import Memo, bucket, sampled, sigmoid, word_list

BITS, FACTORS = 20, 4
#: Lengths, in bytes, of the leading characters of a word that are terms too.
LEADS = (4, 5, 6, 7, 8)
#: Most labelled rows that are learnt from; it bounds the terms that get weights too.
SAMPLE = 12_000
#: A term gets a weight if its toxic share is so many deviations from the whole's, or if it is half of a pair whose share is so many from
#: what its two words alone would give; the least numbers of texts for either, for a word of a pair, and the tests' deviations.
LEAST_DOCS, LEAST_Z, PAIR_WORD_DOCS, PAIR_DOCS, PAIR_Z = 5, 3.5, 20, 8, 8.0
EPOCHS, RATE, DECAY = 30, 0.1, 1e-4


def terms_of(word: bytes, bits: int = BITS) -> tuple[int, ...]:
    return tuple({bucket(word, bits), *(bucket(b"^%d:%s" % (n, word[:n]), bits) for n in LEADS if len(word) >= n)})


def paired(docs: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Hashed words of pairs whose toxic share deviates from what adding their own log-odds gives; docs are distinct hashed words.

    It finds words that are as frequent in clean as in toxic texts but for their company. Every pair of words of ``PAIR_WORD_DOCS`` texts
    or more is counted, one word's partners at a time, so memory is that of the sample and of one row of counts.
    """
    p = y.mean()
    sizes = np.array([len(d) for d in docs])
    flat, rows = np.concatenate(docs).astype(np.int64), np.repeat(np.arange(len(docs)), sizes)
    n = np.bincount(flat, minlength=1 << BITS)
    words = np.flatnonzero(n >= PAIR_WORD_DOCS)
    place = np.full(1 << BITS, -1)
    place[words] = np.arange(len(words))
    held = place[flat] >= 0
    rows, cols = rows[held], place[flat][held]
    by_row = np.lexsort((cols, rows))
    rows, cols = rows[by_row], cols[by_row]
    ends = np.searchsorted(rows, np.arange(len(docs)), "right")
    by_word = np.argsort(cols, kind="stable")  # entries of a word, which are also the starts of its later partners
    starts = np.searchsorted(cols[by_word], np.arange(len(words) + 1))
    odds = np.log((np.bincount(cols, y[rows], len(words)) + p) / (np.bincount(cols, 1 - y[rows], len(words)) + 1 - p)) - np.log(p / (1 - p))
    found = np.zeros(len(words), bool)
    for a in range(len(words)):
        at = by_word[starts[a] : starts[a + 1]]
        long = ends[rows[at]] - at - 1
        shift = np.repeat(at + 1 - np.cumsum(long) + long, long)
        partners, toxic = cols[shift + np.arange(len(shift))], np.repeat(y[rows[at]], long)
        both = np.bincount(partners, minlength=len(words))
        b = np.flatnonzero(both >= PAIR_DOCS)
        k, e = both[b], sigmoid(np.log(p / (1 - p)) + odds[a] + odds[b])
        far = np.abs(np.bincount(partners, toxic, len(words))[b] - k * e) >= PAIR_Z * np.sqrt(k * e * (1 - e))
        found[b[far]] = True
        found[a] |= far.any()
    return words[found]


@dataclass
class FactorizationMachine:
    """score = sigmoid(bias + sum of w + half of (sum of v)^2 - sum of v^2) over a text's terms."""

    terms: np.ndarray  # hashed terms, sorted
    w: np.ndarray
    v: np.ndarray
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        place = {int(t): i for i, t in enumerate(self.terms)}
        memo = Memo(lambda word: tuple(place[t] for t in terms_of(word) if t in place))
        rows, cols = [], []
        for i, text in enumerate(texts):
            mine = set().union(*map(memo.__getitem__, set(word_list(text))))
            cols += sorted(mine)
            rows += [i] * len(mine)
        return self.probability(np.array(rows, np.int64), np.array(cols, np.int64), len(texts))

    def probability(self, rows: np.ndarray, cols: np.ndarray, n: int) -> np.ndarray:
        return sigmoid(self.forward(rows, cols, n)[0])

    def forward(self, rows: np.ndarray, cols: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        total = np.full(n, self.bias) + np.bincount(rows, self.w[cols], n)
        sums = np.stack([np.bincount(rows, self.v[cols, f], n) for f in range(self.v.shape[1])], axis=1)
        squares = np.bincount(rows, (self.v[cols] ** 2).sum(axis=1), n)
        return total + 0.5 * ((sums**2).sum(axis=1) - squares), sums

    @classmethod
    def fit(cls, docs: list[np.ndarray], words: list[np.ndarray], labels: np.ndarray, seed: int = 1) -> FactorizationMachine:
        """Learn from each text's hashed terms, hashed whole words and 0/1 labels; terms are chosen by their own toxic share or by that of their pairs."""
        y = np.asarray(labels, np.float64)
        if not len(y) or y.min() == y.max():
            p = np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3)
            return cls(np.zeros(0, np.int64), np.zeros(0), np.zeros((0, FACTORS)), float(np.log(p / (1 - p))))
        sizes = np.array([len(d) for d in docs])
        flat = np.concatenate(docs).astype(np.int64) if sizes.sum() else np.zeros(0, np.int64)
        rows = np.repeat(np.arange(len(docs)), sizes)
        n = np.bincount(flat, minlength=1 << BITS)
        pos = np.bincount(flat, y[rows], minlength=1 << BITS)
        p = y.mean()
        z = (pos - n * p) / np.sqrt(np.maximum(n * p * (1 - p), 1e-9))
        terms = np.union1d(np.flatnonzero((n >= LEAST_DOCS) & (np.abs(z) >= LEAST_Z)), paired(words, y))
        place = np.full(1 << BITS, -1)
        place[terms] = np.arange(len(terms))
        held = place[flat] >= 0
        rows, cols = rows[held], place[flat][held]
        rng = np.random.default_rng(seed)
        m = cls(terms, np.zeros(len(terms)), rng.normal(0, 0.01, (len(terms), FACTORS)), float(np.log(p / (1 - p))))
        starts = np.searchsorted(rows, np.arange(len(y) + 1))
        gw, gv, gb = np.full(len(terms), 1e-8), np.full((len(terms), FACTORS), 1e-8), 1e-8
        for _ in range(EPOCHS):
            for batch in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
                spans = [np.arange(starts[i], starts[i + 1]) for i in batch]
                r, c = np.repeat(np.arange(len(batch)), [len(s) for s in spans]), cols[np.concatenate(spans)]
                total, sums = m.forward(r, c, len(batch))
                err = (sigmoid(total) - y[batch]) / len(batch)
                touched, at = np.unique(c, return_inverse=True)
                dw = np.bincount(at, err[r], len(touched)) + DECAY * m.w[touched]
                pull = err[r, None] * (sums[r] - m.v[c])
                dv = np.stack([np.bincount(at, pull[:, f], len(touched)) for f in range(FACTORS)], axis=1) + DECAY * m.v[touched]
                db = err.sum()
                gw[touched] += dw**2
                gv[touched] += dv**2
                gb += db**2
                m.w[touched] -= RATE * dw / np.sqrt(gw[touched])
                m.v[touched] -= 0.3 * RATE * dv / np.sqrt(gv[touched])
                m.bias -= 0.3 * RATE * db / np.sqrt(gb)
        return m


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> FactorizationMachine:
    """Fit on at most ``sample`` rows of labels (doc_id, toxic); conflicting labels of one id count as toxic, null ones not at all.

    Of rows that repeat an id with different texts, that of the least hash is learnt from. Columns other than doc_id and text are not read.
    The sample is chosen from the ids alone, so its size bounds what is broadcast against the texts and what the one fitting task reads.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = F.broadcast(sampled(known, "doc_id", sample))

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = Memo(terms_of)
        for pdf in batches:
            words = [set(word_list(t)) for t in pdf["text"]]
            terms = [sorted(set().union(*map(memo.__getitem__, w))) for w in words]
            whole = [sorted({bucket(x, BITS) for x in w}) for w in words]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "terms": [np.array(t, np.int32) for t in terms], "words": [np.array(w, np.int32) for w in whole]})

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        return pd.DataFrame({"model": [pickle.dumps(FactorizationMachine.fit(list(pdf["terms"]), list(pdf["words"]), pdf["toxic"].to_numpy()))]})

    held = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id")
    one = held.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = one.mapInPandas(extract, "doc_id long, toxic int, terms array<int>, words array<int>")
    model = rows.groupBy().applyInPandas(fit, "model binary").collect()
    return pickle.loads(model[0]["model"]) if model else FactorizationMachine.fit([], [], np.zeros(0))


def score(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """(doc_id, score) of every row; a null text is empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 500):
                part = pdf.iloc[i : i + 500]
                yield pd.DataFrame({"doc_id": part["doc_id"], "score": model.score(list(part["text"]))})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, score double")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels whose remainder is not 1."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = id_crc(F.col("doc_id")) % 3 == 1
    scored = score(docs, train(docs, labels.where(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
