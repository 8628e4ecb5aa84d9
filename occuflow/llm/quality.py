"""Quality classifier by weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every text. Expectation-maximisation
over the counts of vote patterns estimates each labeller's accuracy; the patterns' posteriors
label a bounded sample, on which a linear scorer over hashed word shapes is trained. The scorer
then judges every text in one pass without a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import shared_folder, staged, table
from .hashing import Memo, bucket, sampled, sigmoid

BITS = 14
#: Most texts that the linear scorer is trained on.
SAMPLE = 12_000
KEEP = 0.5
#: Frequent function words of the four languages.
FUNCTION_WORDS = frozenset(
    "the of and to in is that it was for on with as be by at der die das und den von zu mit ein eine ist nicht auf le la les de des et un une que qui en dans el los las y por para del con se".split()
)
LABELLERS = ("symbols", "capitals", "separators", "runs", "variety", "lines", "function words")
_SYMBOLS = str.maketrans("", "", "#$%&*|{}<>~^@=!\\")
_UPPER = str.maketrans("", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def vote(value: float, bad: float, good: float) -> str:
    """'0' bad, '1' good, '-' nothing; bad lies above good, or below it."""
    if bad > good:
        return "0" if value >= bad else "1" if value <= good else "-"
    return "0" if value <= bad else "1" if value >= good else "-"


def measures(text: str, words: list[str]) -> tuple[float, ...]:
    n, chars = max(len(words), 1), max(len(text), 1)
    lines = [x for x in text.split("\n") if x]
    return (
        1 - len(text.translate(_SYMBOLS)) / chars,
        1 - len(text.translate(_UPPER)) / chars,
        sum(1 for w in words if len(w) <= 2 and not w.isalnum()) / n,
        sum(map(eq, words, words[1:])) / n,
        len(set(words)) / n,
        1 - len(set(lines)) / max(len(lines), 1),
        sum(1 for w in words if w in FUNCTION_WORDS) / n,
    )


def votes(text: str | None) -> str:
    """One character for each of LABELLERS; an empty text gets no votes."""
    text = text or ""
    words = text.split()
    if not words:
        return "-" * len(LABELLERS)
    symbols, capitals, separators, runs, variety, lines, function = measures(text, words)
    long = len(words) >= 20
    return "".join((
        vote(symbols, 0.03, 0.006), vote(capitals, 0.3, 0.08), vote(separators, 0.15, 0.03), vote(runs, 0.3, 0.05),
        vote(variety, 0.25, 0.45) if long else "-", vote(lines, 0.4, 0.1) if long else "-", vote(function, 0.04, 0.12) if long else "-",
    ))


@dataclass
class LabelModel:
    """Share of good texts, and each labeller's chances of its votes given the class."""

    prior: float
    chance: np.ndarray  # (2 classes, labellers, 3 votes)

    @classmethod
    def fit(cls, counts: dict[str, int], rounds: int = 60) -> LabelModel:
        """Expectation-maximisation over patterns of votes; it starts from each pattern's share of good votes."""
        m = len(LABELLERS)
        codes = np.array([["01-".index(c) for c in p] for p in counts], np.int64).reshape(-1, m)
        n = np.array(list(counts.values()), np.float64)
        good, bad = (codes == 1).sum(axis=1), (codes == 0).sum(axis=1)
        q = (good + 1) / (good + bad + 2)  # of class 1, good
        model = cls(0.8, np.full((2, m, 3), 1 / 3))
        for _ in range(rounds if len(n) else 0):
            share = np.stack([1 - q, q])
            total = (share * n).sum(axis=1)
            for v in range(3):
                model.chance[:, :, v] = ((share * n) @ (codes == v) + 1) / (total[:, None] + 3)
            model.prior = float((total[1] + 1) / (total.sum() + 2))
            q = model.posterior_codes(codes)
        return model

    def posterior_codes(self, codes: np.ndarray) -> np.ndarray:
        """The chance of a good text for each pattern; a labeller that abstains says nothing."""
        x = np.log(np.array([1 - self.prior, self.prior]))[:, None] + np.zeros(len(codes))
        for k in range(codes.shape[1]):
            said = codes[:, k] < 2
            given = self.chance[:, k, :2] / self.chance[:, k, :2].sum(axis=1, keepdims=True)
            x[:, said] += np.log(given[:, codes[said, k]])
        return sigmoid(x[1] - x[0])

    def posterior(self, patterns: list[str]) -> np.ndarray:
        return self.posterior_codes(np.array([["01-".index(c) for c in p] for p in patterns], np.int64).reshape(-1, len(LABELLERS)))

    def accuracy(self) -> dict[str, float]:
        """The estimated share of right votes among those that a labeller casts."""
        p = np.array([1 - self.prior, self.prior])
        right = p[0] * self.chance[0, :, 0] + p[1] * self.chance[1, :, 1]
        return dict(zip(LABELLERS, right / (p[:, None] * self.chance[:, :, :2].sum(axis=2)).sum(axis=0), strict=True))


def shape(word: str) -> int:
    """Bucket of a word's shape: runs of letters, capitals and digits shrink to one sign each."""
    out = []
    for c in word:
        s = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
        if not out or out[-1] != s:
            out.append(s)
    return bucket("".join(out).encode(), BITS)


EQUAL, SEEN, LINE, FUNCTION = (bucket(b"\x00%d" % i, BITS) for i in range(4))


def features(text: str | None, memo: Memo) -> tuple[list[int], list[float]]:
    """Hashed features and their values: shares of the word shapes, of repeated neighbours, repeated words and lines, and function words."""
    text = text or ""
    words = text.split()
    n = max(len(words), 1)
    out = {k: v / n for k, v in Counter(map(memo.__getitem__, words)).items()}
    lines = [x for x in text.split("\n") if x]
    more = {
        EQUAL: sum(map(eq, words, words[1:])) / n, SEEN: (1 - len(set(words)) / n) * min(n, 50) / 50,
        LINE: 1 - len(set(lines)) / max(len(lines), 1), FUNCTION: sum(1 for w in words if w in FUNCTION_WORDS) / n,
    }
    for k, v in more.items():
        out[k] = out.get(k, 0.0) + v
    return list(out), list(out.values())


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    @classmethod
    def fit(cls, indices: list[np.ndarray], values: list[np.ndarray], target: np.ndarray, rounds: int = 400) -> Scorer:
        """Logistic regression on posteriors, by Adam over the whole sample."""
        w, b = np.zeros(1 << BITS), 2.0
        if not len(target):
            return cls(w, b)
        rows = np.repeat(np.arange(len(target)), [len(x) for x in indices])
        cols, x = np.concatenate(indices).astype(np.int64), np.concatenate(values)
        used, at = np.unique(cols, return_inverse=True)
        u, first, second = np.zeros(len(used) + 1), 0.0, 0.0
        u[-1] = b
        for k in range(1, rounds + 1):
            err = (sigmoid(np.bincount(rows, u[at] * x, len(target)) + u[-1]) - target) / len(target)
            g = np.append(np.bincount(at, err[rows] * x, len(used)) + 1e-5 * u[:-1], err.sum())
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
            u -= 0.2 * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-9)
        w[used] = u[:-1]
        return cls(w, float(u[-1]))

    def score(self, texts: list[str | None]) -> np.ndarray:
        memo = Memo(shape)
        out = np.empty(len(texts))
        for i, t in enumerate(texts):
            k, v = features(t, memo)
            out[i] = self.bias + np.dot(self.weights[k], v)
        return sigmoid(out)


def train(docs: DataFrame, folder: str, sample: int = SAMPLE) -> tuple[LabelModel, Scorer]:
    """Votes and their counts cover every row; the scorer learns from at most ``sample`` ids. Votes are staged in the folder.

    Of rows that repeat an id with different texts, the scorer may learn from that of the least hash; rows without an id vote, but aren't learnt from.
    """

    def voting(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "mark": pdf["mark"], "votes": [votes(t) for t in pdf["text"]]})

    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    voted = staged(marked.mapInPandas(voting, "doc_id long, mark long, votes string"), folder, "votes")
    counts = {r["votes"]: r["count"] for r in voted.groupBy("votes").count().orderBy("votes").collect()}  # at most 3^7 patterns
    model = LabelModel.fit(counts)
    posterior = dict(zip(counts, model.posterior(list(counts)), strict=True))
    one = voted.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.struct("mark", "votes")).alias("x")).select("doc_id", "x.*")
    ids = F.broadcast(sampled(one, "doc_id", sample))

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = Memo(shape)
        for pdf in batches:
            both = [features(t, memo) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "votes": pdf["votes"], "k": [np.array(k, np.int32) for k, _ in both], "v": [v for _, v in both]})

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        scorer = Scorer.fit(list(pdf["k"]), list(pdf["v"]), np.array([posterior[p] for p in pdf["votes"]]))
        return pd.DataFrame({"w": [scorer.weights], "b": [scorer.bias]})

    rows = marked.join(ids, ["doc_id", "mark"]).dropDuplicates(["doc_id"]).drop("mark").mapInPandas(extract, "doc_id long, votes string, k array<int>, v array<double>")
    fitted = rows.groupBy().applyInPandas(fit, "w array<double>, b double").collect()
    return model, Scorer(np.array(fitted[0]["w"]), fitted[0]["b"]) if fitted else Scorer.fit([], [], np.zeros(0))


def judge(docs: DataFrame, scorer: Scorer, name: str = "quality_score") -> DataFrame:
    """Every row with its columns and the score, which replaces a column of its name; rows without words have nothing to keep and score 0.

    Repeated rows are scored each; an empty table gives no rows.
    """
    docs = docs.drop(name)
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 500):
                part = pdf.iloc[i : i + 500]
                some = part["text"].map(lambda t: bool(t and t.split())).to_numpy(bool)
                yield part.assign(**{name: np.where(some, scorer.score(list(part["text"])), 0.0)})

    return docs.mapInPandas(run, schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document: doc_id, score, keep."""
    docs = table(spark, sf_dir, "documents")
    _, scorer = train(docs, shared_folder(spark))
    return judge(docs.select("doc_id", "text"), scorer).select("doc_id", F.col("quality_score").alias("score"), (F.col("quality_score") >= KEEP).alias("keep"))
