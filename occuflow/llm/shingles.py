"""Word hashes and shingle hashes of batches of texts, in numpy, and packed blobs of sorted integers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import xxhash
import zstandard

_K = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M
    x = (x ^ (x >> np.uint64(29))) * _K
    return x ^ (x >> np.uint64(32))


def word_hashes(texts: Iterable[str | None], end: bytes | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, each closed by ``end`` if given, and each text's number of them."""
    # bytes.lower() changes A-Z alone, bytes.split() splits at 0x20 and 0x09-0x0D alone
    last = [] if end is None else [end]
    split = [(t or "").encode().lower().split() + last for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    flat = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(split)), np.uint64, int(sizes.sum()))
    return flat, sizes


def shingle_hashes(flat: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text's number) of all shingles; a text of fewer words is one shingle, one without words has none."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    n = len(flat) - width + 1
    out, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n > 0:
        h = flat[:n].copy()
        for k in range(1, width):
            h = h * _K + flat[k : n + k]
        whole = doc[:n] == doc[width - 1 :]
        out, of = mixed(h[whole]), doc[:n][whole]
    short = np.flatnonzero((sizes > 0) & (sizes < width))
    if len(short):
        starts = np.cumsum(sizes) - sizes
        h = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            here = sizes[short] > k
            h[here] = h[here] * _K + flat[starts[short[here]] + k]
        out, of = np.concatenate([out, mixed(h + sizes[short].astype(np.uint64))]), np.concatenate([of, short])
    return out, of


def pieces(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of consecutive rows that sum to about ``most``; a larger row stands alone."""
    total = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
        yield slice(at, to)
        at = to


def pack(x: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes; empty high planes cost nothing."""
    raw = np.ascontiguousarray(x.astype("<u8"))
    width = max(1, -(-int(raw.max()).bit_length() // 8)) if len(raw) else 1
    planes = raw.view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8")[:, 0].astype(np.uint64)


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=np.zeros(1, x.dtype)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)
