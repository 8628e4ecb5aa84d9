"""Language-model scores from a sharded n-gram trie.

Texts are packed into blocks, the same ones whenever the table is read. In a first exchange every block
sends its distinct words and their training counts to shards, which answer with the counts over all
blocks; they make the unigram base, and the probabilities that the trie backs off to.

A second exchange deals each block's trigrams (near, far, word), once for each text, by the word before the
last. Where that word is frequent they are split by the word before it; where both are, by the last word;
where all three are, by text, so no context or trigram is one task's. It is read twice. First each shard
counts: the numbers of n-grams seen once and twice give the discounts of the whole model, and the counts of
n-grams that lie in several shards are summed over all shards in a small exchange of their own. Then each
shard builds the Elias-Fano trie of its training trigrams, with those whole counts, in a memory-mapped file
and answers each block with the sums of log10 P of the texts that it has trigrams of.

So neither shards nor blocks change a score, and what is exchanged grows with the words of the texts, not with texts times shards.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyarrow.dataset import dataset
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_crc, open_fs, shared_folder, staged, table
from .ngram_trie import TemporaryTrie, Trie, context_counts, discount_of, once_twice, pair_counts
from .shingles import mixed, pack, pack_sorted, pieces, unpack, unpack_sorted, word_hashes

#: Tokens that no word equals: the end of a text, and what stands before its start.
END, START = b"\n", b"\t"
#: Words of one packed block, words of one counting shard, tokens of one trie shard.
BLOCK, WORD_SHARD, TRIE_SHARD = 1_200_000, 4_000_000, 2_000_000
#: Bits of a word's hash in the model (the base counts by all 64), and of a frequent word's rank.
WORD_BITS, RANK_BITS = 40, 20
CUT = np.uint64(64 - WORD_BITS)
#: A word of more training tokens is frequent: its contexts are split.
HOT = 1_000_000
#: Base smoothing of the contract.
ADD = 0.1


def trained(docs: DataFrame, held_out_remainder: int = 0) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("nameless"), (id_crc(F.col("doc_id")) % 10 != held_out_remainder).alias("train"), "text")


def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame, np.ndarray, np.ndarray]]:
    """(number, rows, word hashes, sizes) of blocks of texts; numbers are the same whenever the partition is read."""
    number = TaskContext.get().partitionId() << 32
    for pdf in batches:
        lengths = pdf["text"].map(lambda t: len(t) if t else 0).to_numpy() // 5
        for part in pieces(lengths, BLOCK):
            rows = pdf.iloc[part]
            yield number, rows, *word_hashes(list(rows["text"]), END)
            number += 1


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


WORDS = "shard int, part int, block long, words binary, counts binary"


def word_requests(docs: DataFrame, shards: int) -> DataFrame:
    """Each block's distinct words with their training counts there, by shard."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for number, rows, flat, sizes in blocks(batches):
            words, at = np.unique(flat, return_inverse=True)
            counts = np.bincount(at, np.repeat(rows["train"].to_numpy(bool), sizes), len(words)).astype(np.int64)
            edges = np.searchsorted(shard_of(words, shards), np.arange(shards + 1))
            out = [(k, number >> 32, number, pack_sorted(words[a:b]), pack(counts[a:b])) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if a < b]
            yield pd.DataFrame(out, columns=names(WORDS))

    return docs.mapInPandas(run, WORDS)


COUNTS = "part int, block long, shard int, counts binary, words binary, tokens long, kinds long"


def word_counts(requests: DataFrame, most: int) -> DataFrame:
    """The counts of each block's words over all blocks, in the request's order; and in part -1 a shard's training tokens, distinct words, and words of more than ``most`` tokens."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        held = [unpack_sorted(x) for x in pdf["words"]]
        words, at = np.unique(np.concatenate(held), return_inverse=True)
        count = np.bincount(at, np.concatenate([unpack(x) for x in pdf["counts"]]), len(words)).astype(np.int64)
        shard, place, out = int(pdf["shard"].iloc[0]), 0, []
        for part, block, w in zip(pdf["part"], pdf["block"], held, strict=True):
            out.append((part, block, shard, pack(count[at[place : place + len(w)]]), None, 0, 0))
            place += len(w)
        often = count > most
        out.append((-1, -1, shard, pack(count[often]), pack_sorted(words[often]), int(count.sum()), int((count > 0).sum())))
        return pd.DataFrame(out, columns=names(COUNTS))

    return requests.groupBy("shard").applyInPandas(run, COUNTS)


def stored(folder: str, name: str, columns: list[str]) -> pd.DataFrame:
    """A part of a table in the shared folder, read by a task that works on it."""
    fs, path = open_fs(folder)
    return dataset(f"{path}/{name}", filesystem=fs, format="parquet").to_table(columns=columns).to_pandas()


class Hot:
    """Frequent words, whose contexts are split: at most one for each HOT tokens of the corpus, and fewer than 2^RANK_BITS."""

    def __init__(self, h: np.ndarray, c: np.ndarray, most: int):
        self.h, first = np.unique(h, return_index=True)
        self.c, self.most = c[first], most

    def rank(self, h: np.ndarray) -> np.ndarray:
        """Each word's place among the frequent ones, -1 for others."""
        if not len(self.h):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[at] == h, at, -1)


def model_hash(token: bytes) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(token) >> (64 - WORD_BITS))


@dataclass
class Totals:
    """Of the training tokens: their number, how many are distinct, and the frequent ones."""

    tokens: int
    kinds: int
    hot: Hot

    @classmethod
    def of(cls, whole: DataFrame, most: int) -> Totals:
        """The start of a text is as frequent as the end."""
        rows = whole.select("counts", "words", "tokens", "kinds").collect()
        none = np.zeros(0, np.uint64)
        h = np.concatenate([none, *[unpack_sorted(r["words"]) for r in rows]]) >> CUT
        c = np.concatenate([none, *[unpack(r["counts"]) for r in rows]]).astype(np.int64)
        ends = h == model_hash(END)
        hot = Hot(np.append(h, np.full(ends.sum(), model_hash(START))), np.append(c, c[ends]), most)
        return cls(sum(r["tokens"] for r in rows), sum(r["kinds"] for r in rows), hot)


def sorted_order(near: np.ndarray, far: np.ndarray, word: np.ndarray, size: int) -> np.ndarray:
    """The stable order by (near, far, word), of numbers below size."""
    if size >= 2_000_000:
        return np.lexsort((word, far, near))
    key = near.astype(np.int64)
    for x in (far, word):
        key *= size
        key += x
    return np.argsort(key, kind="stable")


def salted(near: np.ndarray, far: np.ndarray, word: np.ndarray, text: np.ndarray, words: np.ndarray, hot: Hot) -> np.ndarray:
    """What deals each trigram to a shard: its near word, and for a frequent one a salt, of the first of the others that isn't frequent, or else of the text, and of those before it."""
    rank = hot.rank(words)
    key = mixed(words[near])
    often = np.flatnonzero(rank[near] >= 0)
    if not len(often):
        return key
    far, word = far[often], word[often]
    h = mixed(words[far])
    h = np.where(rank[far] >= 0, mixed(h ^ words[word]), h)
    h = np.where((rank[far] >= 0) & (rank[word] >= 0), mixed(h ^ text[often].astype(np.uint64)), h)
    parts = (1 + hot.c[rank[near[often]]] // hot.most).astype(np.uint64)
    key[often] = mixed(words[near[often]] + ((h % parts) << np.uint64(WORD_BITS)))
    return key


TRIGRAMS = (
    "shard int, block long, ids binary, n binary, known binary, logs binary, train binary, words binary, counts binary, near binary, far binary, word binary, text binary, times binary"
)


def trigram_requests(docs: DataFrame, totals: Totals, shards: int, folder: str) -> DataFrame:
    """Each block's trigrams with their texts and its words' counts, by shard. A block's first row has its texts' ids and base sums."""
    start, hot = model_hash(START), totals.hot

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counted = None
        for number, rows, flat, sizes in blocks(batches):
            if counted is None:
                counted = stored(folder, f"counts/part={number >> 32}", ["block", "shard", "counts"]).sort_values("shard")
            all_words, at = np.unique(flat, return_inverse=True)
            count = np.concatenate([unpack(x) for x in counted.loc[counted["block"] == number, "counts"]]).astype(np.int64)
            if len(count) != len(all_words):
                raise ValueError("the rows came in another order than before: score a table that is written")
            begin = np.cumsum(sizes) - sizes
            known, logs = np.add.reduceat((count > 0)[at].astype(np.int64), begin), np.add.reduceat(np.log10(count + ADD)[at], begin)
            words, word = np.unique(np.append(all_words >> CUT, start), return_inverse=True)
            s, word = word[-1], word[:-1].astype(np.int32)[at]
            most = np.zeros(len(words), np.int64)
            most[np.searchsorted(words, all_words >> CUT)] = count
            del flat, at
            near, far = np.roll(word, 1), np.roll(word, 2)
            near[begin] = s
            far[begin] = s
            far[begin[sizes > 1] + 1] = s
            text = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
            shard = shard_of(salted(near, far, word, text + np.int32(number & 0xFFFF), words, hot), shards).astype(np.uint16 if shards <= 1 << 16 else np.int64)
            order = sorted_order(near, far, word, len(words))
            order = order[np.argsort(shard[order], kind="stable")]
            near, far, word, text, shard = near[order], far[order], word[order], text[order], shard[order]
            new = np.ones(len(word), bool)
            new[1:] = (near[1:] != near[:-1]) | (far[1:] != far[:-1]) | (word[1:] != word[:-1]) | (text[1:] != text[:-1])
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(word)))
            near, far, word, text, shard = near[first], far[first], word[first], text[first], shard[first]
            edges = np.searchsorted(shard, np.arange(shards + 1))
            base = rows["id"].to_numpy("<i8").tobytes() + np.packbits(rows["nameless"].to_numpy(bool)).tobytes(), pack(sizes), pack(known), logs.astype("<f8").tobytes()
            train, out = np.packbits(rows["train"].to_numpy(bool)).tobytes(), []
            for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                if a == b:
                    continue
                used, i = np.unique(np.concatenate([near[a:b], far[a:b], word[a:b]]), return_inverse=True)
                i = i.reshape(3, -1)
                mine = base if not out else (b"", b"", b"", b"")
                out.append((k, number, *mine, train, pack_sorted(words[used]), pack(most[used]), pack_sorted(i[0]), pack(i[1]), pack(i[2]), pack(text[a:b]), pack(times[a:b])))
            yield pd.DataFrame(out, columns=names(TRIGRAMS))

    return docs.mapInPandas(run, TRIGRAMS)


def dealt(requests: DataFrame, shards: int) -> DataFrame:
    """The requests, one shard a partition. All that is computed from the returned table reads the same exchange."""
    spark, out = requests.sparkSession, requests.repartitionById(shards, F.col("shard"))._jdf
    return DataFrame(spark._jsparkSession.createDataFrame(out.toJavaRDD(), out.schema()), spark)


def by_shard(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
    held = [pdf for pdf in batches if len(pdf)]
    if held:
        yield from pd.concat(held).groupby("shard")


#: Kinds of n-grams that lie in several shards, as the top bits of their keys.
PAIR, DOUBLE, TRIPLE = range(3)


@dataclass
class Shared:
    """A shard's n-grams that lie in several shards: pairs (near, word) of frequent near words, contexts (near, far) of two frequent words, and trigrams of three."""

    keys: np.ndarray  # kind, ranks of the frequent words, a pair's word; sorted by bucket and key
    place: np.ndarray  # near * size + word of a pair, near * size + far of a double, the trigram's number
    counts: np.ndarray
    kinds: np.ndarray  # successors of a double that are not frequent, 0 for others
    edges: np.ndarray  # of the buckets


class Shard:
    """A shard's words and distinct trigrams (near, far, word), sorted, with training counts; and each text's occurrences of them."""

    def __init__(self, pdf: pd.DataFrame):
        vocabularies = [unpack_sorted(x) for x in pdf["words"]]
        self.words, at = np.unique(np.concatenate(vocabularies), return_inverse=True)
        self.word_counts = np.zeros(len(self.words), np.int64)
        self.word_counts[at] = np.concatenate([unpack(x) for x in pdf["counts"]])
        self.size, place, texts, self.edges, filled = len(self.words), 0, 0, [0], 0
        times = [unpack(x).astype(np.int32) for x in pdf["times"]]
        n = sum(map(len, times))
        near, far, word, text, learnt = (np.empty(n, np.int32) for _ in range(5))
        for r, v, t in zip(pdf.itertuples(), vocabularies, times, strict=True):
            mine, here = at[place : place + len(v)].astype(np.int32), slice(filled, filled + len(t))
            place += len(v)
            filled += len(t)
            mine_text, train = unpack(r.text).astype(np.int32), np.unpackbits(np.frombuffer(r.train, np.uint8))
            near[here], far[here], word[here] = mine[unpack_sorted(r.near)], mine[unpack(r.far)], mine[unpack(r.word)]
            text[here], learnt[here] = mine_text + texts, t * train[mine_text]
            texts += len(train)
            self.edges.append(texts)
        times = np.concatenate(times)
        del at, vocabularies
        order = sorted_order(near, far, word, self.size)
        near, far, word = near[order].astype(np.int64), far[order].astype(np.int64), word[order].astype(np.int64)
        self.text, self.times, learnt = text[order], times[order], learnt[order]
        del order, text, times
        new = np.ones(len(word), bool)
        new[1:] = (near[1:] != near[:-1]) | (far[1:] != far[:-1]) | (word[1:] != word[:-1])
        self.first = np.flatnonzero(new)
        self.near, self.far, self.word = near[self.first], far[self.first], word[self.first]
        self.counts = np.add.reduceat(learnt, self.first, dtype=np.int64) if len(self.first) else self.first

    def whole_pairs(self, hot: Hot) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that were seen here of contexts that are not split."""
        mine = (self.counts > 0) & (hot.rank(self.words)[self.near] < 0)
        return pair_counts(self.near[mine], self.word[mine], self.counts[mine], self.size)

    def split_triples(self, hot: Hot) -> np.ndarray:
        rank = hot.rank(self.words)
        return (rank[self.near] >= 0) & (rank[self.far] >= 0) & (rank[self.word] >= 0)

    def shared(self, hot: Hot, buckets: int) -> Shared:
        rank = hot.rank(self.words)
        r, bits = rank.astype(np.uint64), np.uint64(RANK_BITS)
        often = np.flatnonzero(rank[self.near] >= 0)
        pair, at = np.unique(self.near[often] * self.size + self.word[often], return_inverse=True)
        out = [((r[pair // self.size] << np.uint64(WORD_BITS)) | self.words[pair % self.size], pair, np.bincount(at, self.counts[often], len(pair)), np.zeros(len(pair)))]
        lot = out[0][0]
        both = often[rank[self.far[often]] >= 0]
        double, at = np.unique(self.near[both] * self.size + self.far[both], return_inverse=True)
        rare = (rank[self.word[both]] < 0) & (self.counts[both] > 0)
        mark = np.uint64(DOUBLE << 62) | (r[double // self.size] << bits) | r[double % self.size]
        out.append((mark, double, np.bincount(at, self.counts[both], len(double)), np.bincount(at, rare, len(double))))
        triple = both[rank[self.word[both]] >= 0]
        context = (r[self.near[triple]] << bits) | r[self.far[triple]]
        out.append(((np.uint64(TRIPLE) << np.uint64(62)) | (context << bits) | r[self.word[triple]], triple, self.counts[triple], np.zeros(len(triple))))
        # a double and its trigrams are summed in one bucket
        lot = mixed(np.concatenate([lot, mark, np.uint64(DOUBLE << 62) | context]))
        keys, place, counts, kinds = map(np.concatenate, zip(*out, strict=True))
        bucket = shard_of(lot, buckets)
        order = np.lexsort((keys, bucket))
        return Shared(keys[order], place[order], counts[order].astype(np.int64), kinds[order].astype(np.int64), np.searchsorted(bucket[order], np.arange(buckets + 1)))


PARTIAL = "bucket int, shard int, keys binary, counts binary, kinds binary, seen array<long>"


def partial_counts(requests: DataFrame, hot: Hot, buckets: int) -> DataFrame:
    """Each shard's counts of shared n-grams by bucket, and in bucket -1 its numbers of other pairs and trigrams seen once and twice."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for k, pdf in by_shard(batches):
            shard = Shard(pdf)
            x = shard.shared(hot, buckets)
            seen = [*once_twice(shard.whole_pairs(hot)[1]).tolist(), *once_twice(shard.counts[~shard.split_triples(hot)]).tolist()]
            out = [(-1, k, b"", b"", b"", seen)]
            out += [(i, k, pack_sorted(x.keys[a:b]), pack(x.counts[a:b]), pack(x.kinds[a:b]), []) for i, (a, b) in enumerate(zip(x.edges[:-1], x.edges[1:], strict=True)) if a < b]
            yield pd.DataFrame(out, columns=names(PARTIAL))

    return requests.mapInPandas(run, PARTIAL)


SUMMED = "shard int, bucket int, counts binary, kinds binary, seen array<long>, ranks array<long>, totals array<long>, successors array<long>"


def summed_counts(partial: DataFrame) -> DataFrame:
    """The sums over all shards, as each shard's answer in its order; and for shard -1 the totals and numbers of words of frequent contexts, and numbers of pairs and trigrams seen once and twice."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        held = [unpack_sorted(x) for x in pdf["keys"]]
        keys, at = np.unique(np.concatenate(held), return_inverse=True)
        counts, kinds = (np.bincount(at, np.concatenate([unpack(x) for x in pdf[c]]), len(keys)).astype(np.int64) for c in ("counts", "kinds"))
        kind, context = (keys >> np.uint64(62)).astype(np.int64), keys >> np.uint64(RANK_BITS)
        seen = (kind == TRIPLE) & (counts > 0)
        of = np.uint64(DOUBLE << 62) | (context[seen] & np.uint64((1 << 2 * RANK_BITS) - 1))
        kinds += np.bincount(np.searchsorted(keys, of), minlength=len(keys))
        bucket, place, out = int(pdf["bucket"].iloc[0]), 0, []
        for k, h in zip(pdf["shard"], held, strict=True):
            here = at[place : place + len(h)]
            out.append((k, bucket, pack(counts[here]), pack(kinds[here]), [], [], [], []))
            place += len(h)
        pairs = kind == PAIR
        ranks, of = np.unique((keys[pairs] >> np.uint64(WORD_BITS)).astype(np.int64), return_inverse=True)
        totals, successors = (np.bincount(of, x, len(ranks)).astype(np.int64).tolist() for x in (counts[pairs], counts[pairs] > 0))
        out.append((-1, bucket, None, None, [*once_twice(counts[pairs]).tolist(), *once_twice(counts[kind == TRIPLE]).tolist()], ranks.tolist(), totals, successors))
        return pd.DataFrame(out, columns=names(SUMMED))

    return partial.where("bucket >= 0").groupBy("bucket").applyInPandas(run, SUMMED)


def trie_scores(requests: DataFrame, totals: Totals, folder: str, shards: int, buckets: int) -> DataFrame:
    """A row for each block of a shard: its texts that have trigrams here and their sums of log10 P. Sums over shards are staged in the folder."""
    hot = totals.hot
    partial = staged(partial_counts(requests, hot, buckets), folder, "partial")
    summed_counts(partial).repartition(shards, "shard").write.partitionBy("shard").parquet(f"{folder}/summed")
    summed = requests.sparkSession.read.schema(SUMMED).parquet(f"{folder}/summed").where("shard = -1")
    total, kinds = np.zeros(len(hot.h), np.int64), np.zeros(len(hot.h), np.int64)
    for r in summed.selectExpr("inline(arrays_zip(ranks, totals, successors))").groupBy("ranks").agg(F.sum("totals"), F.sum("successors")).collect():
        total[r[0]], kinds[r[0]] = r[1], r[2]
    seen = partial.where("bucket = -1").select("seen").union(summed.select("seen")).agg(*[F.coalesce(F.sum(F.col("seen")[i]), F.lit(0)) for i in range(4)]).first()
    discounts = discount_of(seen[0], seen[1]), discount_of(seen[2], seen[3])

    def build(shard: Shard, k: int) -> Trie:
        x = shard.shared(hot, buckets)
        kind = (x.keys >> np.uint64(62)).astype(np.int64)
        count, successors = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(x.keys):
            got = stored(folder, f"summed/shard={k}", ["bucket", "counts", "kinds"]).sort_values("bucket")
            count, successors = (np.concatenate([unpack(v) for v in got[c]]).astype(np.int64) for c in ("counts", "kinds"))
        # trigrams, with the whole counts of those that lie in several shards
        counts = shard.counts.copy()
        counts[x.place[kind == TRIPLE]] = count[kind == TRIPLE]
        seen = counts > 0
        near, far, word, counts = shard.near[seen], shard.far[seen], shard.word[seen], counts[seen]
        # pairs, and their contexts: also those that only texts to score have here
        pair, pair_n = shard.whole_pairs(hot)
        mine = (kind == PAIR) & (count > 0)
        pair, pair_n = np.concatenate([pair, x.place[mine]]), np.concatenate([pair_n, count[mine]])
        order = np.argsort(pair)
        pair, pair_n = pair[order], pair_n[order]
        context, context_n, context_kinds = merged(context_counts(pair // shard.size, pair_n), np.unique(x.place[kind == PAIR] // shard.size))
        rank = hot.rank(shard.words[context])
        context_n[rank >= 0], context_kinds[rank >= 0] = total[rank[rank >= 0]], kinds[rank[rank >= 0]]
        held = context_n > 0
        # contexts of two words likewise
        split = np.sort(x.place[kind == DOUBLE])
        double, double_n, double_kinds = merged(context_counts(near * shard.size + far, counts), split)
        at = np.searchsorted(double, x.place[kind == DOUBLE])
        double_n[at], double_kinds[at] = count[kind == DOUBLE], successors[kind == DOUBLE]
        alive = double_n > 0
        contexts, doubles = (context[held], context_n[held], context_kinds[held]), (double[alive], double_n[alive], double_kinds[alive])
        return Trie.build(near, far, word, counts, shard.size, (pair, pair_n), contexts, doubles, discounts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for k, pdf in by_shard(batches):
            shard = Shard(pdf)
            base = (shard.word_counts + ADD) / (totals.tokens + ADD * (totals.kinds + 1))
            log = np.empty(len(shard.first))
            with TemporaryTrie(build(shard, k)) as trie:
                for i in range(0, len(log), 500_000):
                    j = slice(i, i + 500_000)
                    log[j] = np.log10(trie.probability(shard.near[j], shard.far[j], shard.word[j], base[shard.word[j]]))
            texts = shard.edges[-1]
            sums = np.bincount(shard.text, shard.times * np.repeat(log, np.diff(np.append(shard.first, len(shard.text)))), texts)
            here = np.bincount(shard.text, minlength=texts) > 0
            some = [np.flatnonzero(here[a:b]) for a, b in zip(shard.edges[:-1], shard.edges[1:], strict=True)]
            scores = [sums[a + i].astype("<f4").tobytes() for a, i in zip(shard.edges[:-1], some, strict=True)]
            yield pd.DataFrame({**{c: pdf[c].to_numpy() for c in ("block", "ids", "n", "known", "logs")}, "texts": [pack_sorted(i) for i in some], "score": scores})

    return requests.mapInPandas(run, "block long, ids binary, n binary, known binary, logs binary, texts binary, score binary")


def merged(known: tuple[np.ndarray, np.ndarray, np.ndarray], more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, totals and kinds with further contexts, of none so far."""
    context = np.union1d(known[0], more)
    at, out = np.searchsorted(context, known[0]), (np.zeros(len(context), np.int64), np.zeros(len(context), np.int64))
    out[0][at], out[1][at] = known[1], known[2]
    return context, *out


def by_text(answers: DataFrame) -> DataFrame:
    """(doc_id, n, known, logs, score) of every text, from its block's answers of all shards."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        base = pdf.loc[pdf["ids"].map(len).idxmax()]
        n = unpack(base["n"]).astype(np.int64)
        ids = pd.array(np.frombuffer(base["ids"], "<i8", len(n)), "Int64")
        ids[np.unpackbits(np.frombuffer(base["ids"][8 * len(n) :], np.uint8))[: len(n)].astype(bool)] = pd.NA
        score = np.zeros(len(n))
        for texts, x in zip(pdf["texts"], pdf["score"], strict=True):
            score[unpack_sorted(texts).astype(np.int64)] += np.frombuffer(x, "<f4")
        return pd.DataFrame({"doc_id": ids, "n": n, "known": unpack(base["known"]).astype(np.int64), "logs": np.frombuffer(base["logs"], "<f8"), "score": score})

    return answers.groupBy("block").applyInPandas(run, "doc_id long, n long, known long, logs double, score double")


def score(docs: DataFrame, folder: str) -> DataFrame:
    """Scores of every row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from rows whose crc32(doc_id) mod 10 is not 0. A null text is empty and has its end alone;
    a null id counts as the empty text; repeated rows count and are scored each; an empty table gives no rows.
    Columns other than doc_id and text are not read. The table is read twice and must give its rows in the same
    order (a written one does; it fails otherwise). Work tables are staged in the folder.
    """
    texts = trained(docs)
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    tokens = chars // 5 + 1
    most = max(HOT, tokens >> (RANK_BITS - 1))
    shards, buckets = -(-tokens // TRIE_SHARD), -(-tokens // WORD_SHARD)
    word_counts(word_requests(texts, buckets), most).repartition(buckets, "part").write.partitionBy("part").parquet(f"{folder}/counts")
    totals = Totals.of(docs.sparkSession.read.schema(COUNTS).parquet(f"{folder}/counts").where("part = -1"), most)
    requests = dealt(trigram_requests(texts, totals, shards, folder), shards)
    scores = by_text(trie_scores(requests, totals, folder, shards, buckets))
    each = float(np.log10(totals.tokens + ADD * (totals.kinds + 1)))
    return scores.select(
        "doc_id", (id_crc(F.col("doc_id")) % 10 == 0).alias("held_out"), F.col("n").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(totals.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n") * F.lit(each)).alias("base_score"), "score",
    )


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    return score(table(spark, sf_dir, "documents"), shared_folder(spark))
