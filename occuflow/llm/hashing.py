"""Hashed terms and bounded training samples, shared by the trained scorers."""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


class Memo(dict):
    """A cache of a function of words, emptied when it has grown large."""

    def __init__(self, of, most: int = 400_000):
        super().__init__()
        self.of, self.most = of, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        out = self[key] = self.of(key)
        return out


def bucket(term: bytes, bits: int) -> int:
    return zlib.crc32(term) & ((1 << bits) - 1)


def word_list(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters, digits and non-ASCII bytes."""
    return WORD.findall((text or "").encode().lower())


def sampled(df: DataFrame, key: str, bound: int) -> DataFrame:
    """At most ``bound`` rows, those of the smallest hash of the key: the same at any partitioning."""
    return df.orderBy(F.xxhash64(F.lit(17), key), key).limit(bound)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
