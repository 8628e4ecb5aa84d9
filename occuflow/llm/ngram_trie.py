"""An n-gram trie of order three in Elias-Fano levels, memory-mapped from one file.

Level 2 has, for each context word, its successors; level 3 has, for each context of two words,
its successors as positions in the successor list of the nearer word, so their numbers are small
("context-relative"). All lists of a level lie in one monotone sequence: each list is lifted by
its context's number times the range of its values, or, for relative ones, by the start of the
list that they point into. Pointers to the lists are monotone too. Probabilities and back-off weights of absolute discounting are one byte each.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

#: For each byte and k, the place of its k-th set bit.
_SELECT = np.array([([i for i in range(8) if b >> i & 1] + [8] * 8)[:8] for b in range(256)], np.uint64)
#: The lowest, and the highest, bit of each byte of a word.
_EACH, _TOP = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
#: Least logarithm (base 10) that a byte holds.
LEAST = -9.0


def quantised(p: np.ndarray) -> np.ndarray:
    """Probabilities as bytes, linear in their logarithm; 0 is kept apart."""
    log = np.log10(np.maximum(p, 10.0**LEAST))
    return np.where(p > 0, 1 + np.round(254 * (1 - log / LEAST)), 0).astype(np.uint8)


LEVELS = np.concatenate([[0.0], 10 ** (LEAST * (1 - np.arange(255) / 254))])


def byte_counts(x: np.ndarray) -> np.ndarray:
    """For each 64-bit word, the numbers of set bits up to the end of each of its bytes, a byte each."""
    x = x - ((x >> np.uint64(1)) & np.uint64(0x5555555555555555))
    x = (x & np.uint64(0x3333333333333333)) + ((x >> np.uint64(2)) & np.uint64(0x3333333333333333))
    x = (x + (x >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)
    return x * _EACH


def select_in_word(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of each word's k-th set bit."""
    upto, k = byte_counts(x), k.astype(np.uint64)
    # all bytes are compared with k at once; those that don't exceed it are counted
    within = ((((k * _EACH) | _TOP) - upto) & _TOP) >> np.uint64(7)
    shift = ((within * _EACH) >> np.uint64(56)) << np.uint64(3)
    before = ((upto << np.uint64(8)) >> shift) & np.uint64(255)
    byte = (x >> shift) & np.uint64(255)
    return (shift + _SELECT.take((byte << np.uint64(3) | (k - before)).astype(np.int64))).astype(np.int64)


class EliasFano:
    """A non-decreasing sequence: low bytes as they are, high parts as a unary vector of 64-bit words, with a rank directory of half its size."""

    def __init__(self, n: int, shift: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.shift, self.low, self.high, self.ones = n, shift, low, high, ones
        self.zeros: np.ndarray | None = None

    @classmethod
    def build(cls, x: np.ndarray) -> EliasFano:
        x = x.astype(np.int64)
        n, top = len(x), int(x[-1]) if len(x) else 0
        shift = min((0, 8, 16, 24), key=lambda s: n * s + n + (top >> s))
        kind = {0: np.uint8, 8: np.uint8, 16: np.uint16, 24: np.uint32}[shift]
        low = (x & ((1 << shift) - 1)).astype(kind) if shift else np.zeros(0, np.uint8)
        bits = np.zeros(-(-(n + (top >> shift) + 2) // 64) * 64, np.uint8)
        bits[(x >> shift) + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view("<u8").astype(np.uint64)
        each = (byte_counts(high) >> np.uint64(56)).astype(np.int64)
        return cls(n, shift, low, high, (np.cumsum(each) - each).astype(np.uint32))

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.shift], np.int64), self.low, self.high, self.ones]

    @classmethod
    def of(cls, parts: list[np.ndarray]) -> EliasFano:
        return cls(int(parts[0][0]), int(parts[0][1]), *parts[1:])

    def select1(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i, side="right") - 1
        return word * 64 + select_in_word(self.high[word], i - self.ones[word].astype(np.int64))

    def zeros_before(self, h: np.ndarray) -> np.ndarray:
        """Number of elements whose high part is below h: ones before the h-th zero bit."""
        if self.zeros is None:
            self.zeros = 64 * np.arange(len(self.ones)) - self.ones
        k = np.maximum(h - 1, 0)
        word = np.searchsorted(self.zeros, k, side="right") - 1
        place = select_in_word(~self.high[word], k - self.zeros[word])
        return np.where(h > 0, 64 * word + place - k, 0)

    def get(self, i: np.ndarray) -> np.ndarray:
        high = self.select1(i) - i
        return (high << self.shift) | self.low[i].astype(np.int64) if self.shift else high

    def find(self, x: np.ndarray) -> np.ndarray:
        """The place of each value, -1 if it is absent: a successor search among the elements of its high part."""
        if not self.n:
            return np.full(len(x), -1)
        x = x.astype(np.int64)
        most = int(self.get(np.array([self.n - 1]))[0])
        inside = (x >= 0) & (x <= most)
        h = np.where(inside, x >> self.shift, 0)
        lo, end = self.zeros_before(h), self.zeros_before(h + 1)
        if not self.shift:
            return np.where(inside & (lo < end), lo, -1)
        want = (x & ((1 << self.shift) - 1)).astype(self.low.dtype)
        out, live = np.full(len(x), -1), np.flatnonzero(inside & (lo < end))
        lo, end, want = lo[live], end[live], want[live]
        while len(live):  # halve [lo, end) until its middle is the value or nothing is left
            mid = (lo + end) >> 1
            here = self.low[mid]
            hit, less = here == want, here < want
            out[live[hit]] = mid[hit]
            lo, end = np.where(less, mid + 1, lo), np.where(less, end, mid)
            on = np.flatnonzero(~hit & (lo < end))
            live, lo, end, want = live[on], lo[on], end[on], want[on]
        return out


def once_twice(counts: np.ndarray) -> np.ndarray:
    """Numbers of n-grams seen once and twice."""
    return np.array([np.count_nonzero(counts == 1), np.count_nonzero(counts == 2)])


def discount(counts: np.ndarray) -> float:
    """Ney's estimate from the counts of n-grams."""
    return discount_of(*once_twice(counts))


def discount_of(one: int, two: int) -> float:
    return min(max((one + 0.5) / (one + 2 * two + 1), 0.1), 0.95)


def grouped(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and their summed counts; keys are sorted."""
    if not len(keys):
        return keys, counts
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def pair_counts(near: np.ndarray, word: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys near * size + word and their counts."""
    key = near * size + word
    order = np.argsort(key, kind="stable")
    return grouped(key[order], counts[order])


def context_counts(of: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted contexts of successors: the distinct ones, their totals and their numbers of successors."""
    context, start = np.unique(of, return_index=True)
    return context, np.add.reduceat(counts, start) if len(of) else counts, np.diff(np.append(start, len(of)))


class Trie:
    """Built from sorted training trigrams (near, far, word) of numbers below ``size``; near is the word just before."""

    NAMES = ("near", "pair", "far", "relative", "lists")

    def __init__(self, size: int, fano: dict[str, EliasFano], codes: dict[str, np.ndarray]):
        self.size, self.fano, self.codes = size, fano, codes

    @classmethod
    def build(cls, near: np.ndarray, far: np.ndarray, word: np.ndarray, counts: np.ndarray, size: int, pairs=None, contexts=None, doubles=None, discounts=None) -> Trie:
        """Of a part of the model, give what lies beyond it: all counts of its pairs (sorted keys, counts), its contexts of one word and of two (sorted keys, totals, kinds), both discounts."""
        # level 2
        key = near * size + word
        pair, pair_n = pairs or pair_counts(near, word, counts, size)
        of = pair // size
        context, total, kinds = contexts or context_counts(of, pair_n)
        start = np.searchsorted(of, context)
        listed = np.diff(np.append(start, len(pair)))
        d2, d3 = discounts or (discount(pair_n), discount(counts))
        at = np.searchsorted(context, of)
        codes = {"pair": quantised(np.maximum(pair_n - d2, 0) / total[at]), "near_back": quantised(d2 * kinds / np.maximum(total, 1))}
        # level 3: contexts of two words, and their successors' places in the nearer word's list
        double = near * size + far
        far_key, far_total, far_kinds = doubles or context_counts(double, counts)
        far_at = np.searchsorted(far_key, double)
        codes |= {"triple": quantised(np.maximum(counts - d3, 0) / far_total[far_at]), "far_back": quantised(d3 * far_kinds / np.maximum(far_total, 1))}
        place = np.searchsorted(pair, key) - start[np.searchsorted(context, near)] if len(key) else key
        # a context's relative numbers are lifted by the lengths of the lists of the contexts before it
        span = listed[np.searchsorted(context, far_key // size)] if len(far_key) else far_key
        lift = np.cumsum(span) - span
        fano = {"near": context, "pair": pair, "far": far_key, "relative": lift[far_at] + place, "lists": lift}
        fano["starts"] = start
        return cls(size, {k: EliasFano.build(np.asarray(v)) for k, v in fano.items()}, codes)

    def save(self, path: str) -> None:
        """All levels end to end in one file, after a table of their kinds and lengths."""
        parts = [(f"{k}.{i}", p) for k, f in self.fano.items() for i, p in enumerate(f.parts())] + list(self.codes.items())
        head = repr((self.size, [(k, p.dtype.str, len(p)) for k, p in parts])).encode()
        with open(path, "wb") as f:
            f.write(len(head).to_bytes(8, "little") + head)
            for _, p in parts:
                f.write(bytes(-f.tell() % 8))
                f.write(np.ascontiguousarray(p).tobytes())

    @classmethod
    def mapped(cls, path: str) -> Trie:
        import ast

        data = np.memmap(path, np.uint8, "r")
        n = int.from_bytes(data[:8].tobytes(), "little")
        size, table = ast.literal_eval(data[8 : 8 + n].tobytes().decode())
        at, fano, codes = 8 + n, {}, {}
        for name, kind, length in table:
            at += -at % 8
            end = at + length * np.dtype(kind).itemsize
            part = data[at:end].view(kind)
            at = end
            if "." in name:
                fano.setdefault(name.split(".")[0], []).append(part)
            else:
                codes[name] = part
        return cls(size, {k: EliasFano.of(v) for k, v in fano.items()}, codes)

    def contexts(self, level: str, key: np.ndarray) -> np.ndarray:
        """The place of each context; runs of equal contexts are looked up once."""
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else key
        return np.repeat(self.fano[level].find(key[first]), np.diff(np.append(first, len(key))))

    def probability(self, near: np.ndarray, far: np.ndarray, word: np.ndarray, base: np.ndarray) -> np.ndarray:
        """P(word | far near), backing off to ``base``, the words' own probabilities."""
        p = base.astype(np.float64)
        context = self.contexts("near", near)
        seen = np.flatnonzero(context >= 0)
        if not len(seen):
            return p
        pair = self.fano["pair"].find(near[seen] * self.size + word[seen])
        hit = np.where(pair >= 0, LEVELS[self.codes["pair"][np.maximum(pair, 0)]], 0.0)
        p[seen] = hit + LEVELS[self.codes["near_back"][context[seen]]] * p[seen]
        double = self.contexts("far", near[seen] * self.size + far[seen])
        known = np.flatnonzero(double >= 0)
        if not len(known):
            return p
        rows, double, pair = seen[known], double[known], pair[known]
        here = np.flatnonzero(pair >= 0)  # a trigram's word is a successor of the nearer word
        triple = np.zeros(len(rows))
        if len(here):
            relative = pair[here] - self.fano["starts"].get(context[rows[here]])
            at = self.fano["relative"].find(self.fano["lists"].get(double[here]) + relative)
            triple[here] = np.where(at >= 0, LEVELS[self.codes["triple"][np.maximum(at, 0)]], 0.0)
        p[rows] = triple + LEVELS[self.codes["far_back"][double]] * p[rows]
        return p


class TemporaryTrie:
    """A trie written to the task's own folder and mapped for as long as it is used."""

    def __init__(self, trie: Trie):
        fd, self.path = tempfile.mkstemp(suffix=".trie")
        os.close(fd)
        trie.save(self.path)

    def __enter__(self) -> Trie:
        return Trie.mapped(self.path)

    def __exit__(self, *_):
        os.unlink(self.path)
