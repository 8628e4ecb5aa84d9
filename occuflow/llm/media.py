"""Media columns: telephony audio.

A payload is kept losslessly as the data chunk of a mono 8 kHz WAV in one of three codecs
(mu-law and A-law: one byte a sample; IMA ADPCM: 64-byte blocks of 121 samples). Reading it
back expands mu-law and A-law by lookup tables, decodes all ADPCM blocks of a chunk of rows
together (one numpy step for each sample position) and resamples to 16-bit PCM at 16 kHz.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

RATE, BLOCK = 8000, 64
BLOCK_SAMPLES = 2 * (BLOCK - 4) + 1
CODECS = ("mulaw", "alaw", "adpcm")
#: WAV format tags.
TAGS = {"mulaw": 7, "alaw": 6, "adpcm": 0x11}
HEAD = struct.Struct("<4sI4s4sIHHIIHHH4sI")
#: Rows are worked on in chunks of so many payload bytes.
CHUNK = 2_000_000


def mulaw_table() -> np.ndarray:
    """PCM of the 256 mu-law codes, by the rule of G.711."""
    u = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((u & 15) << 3) + 132 << ((u >> 4) & 7)) - 132
    return np.where(u & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """PCM of the 256 A-law codes, by the rule of G.711."""
    a = np.arange(256, dtype=np.int32) ^ 0x55
    e, m = (a >> 4) & 7, (a & 15) << 4
    size = np.where(e == 0, m + 8, m + 264 << np.maximum(e - 1, 0))
    return np.where(a & 128, size, -size).astype(np.int16)


#: Step sizes and index moves of IMA ADPCM.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130,
    143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282,
    1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493,
    10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """PCM of IMA ADPCM blocks, an array (blocks, 64) of bytes; step indices beyond the table are clamped."""
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    codes = np.empty((len(blocks), BLOCK_SAMPLES - 1), np.int32)
    codes[:, 0::2], codes[:, 1::2] = blocks[:, 4:] & 15, blocks[:, 4:] >> 4
    out = np.empty((len(blocks), BLOCK_SAMPLES), np.int16)
    out[:, 0] = value
    for k in range(BLOCK_SAMPLES - 1):
        step, code = STEPS[index], codes[:, k]
        diff = (step >> 3) + np.where(code & 1, step >> 2, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 4, step, 0)
        value = np.clip(value + np.where(code & 8, -diff, diff), -32768, 32767)
        index = np.clip(index + MOVES[code & 7], 0, 88)
        out[:, k + 1] = value
    return out


def wav(payload: bytes, codec: str) -> bytes:
    """The payload as a WAV file; ADPCM wants whole blocks."""
    adpcm = codec == "adpcm"
    rate = RATE * BLOCK // BLOCK_SAMPLES if adpcm else RATE
    fmt = (TAGS[codec], 1, RATE, rate, BLOCK if adpcm else 1, 4 if adpcm else 8, 0)
    return HEAD.pack(b"RIFF", len(payload) + HEAD.size - 8, b"WAVE", b"fmt ", 18, *fmt, b"data", len(payload)) + payload


def read_wav(media: bytes) -> tuple[str, bytes]:
    """Codec and payload of a file that ``wav`` made."""
    x = HEAD.unpack_from(media)
    return next(c for c, t in TAGS.items() if t == x[5]), media[HEAD.size : HEAD.size + x[-1]]


def resample2(pcm: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Twice the rate by linear interpolation; signals lie end to end, each up to its end."""
    after = np.empty(len(pcm), np.int32)
    after[:-1] = pcm[1:]
    after[ends - 1] = pcm[ends - 1]
    out = np.empty(2 * len(pcm), np.int16)
    out[0::2] = pcm
    out[1::2] = (pcm.astype(np.int32) + after) >> 1
    return out


def decode(media: list[bytes]) -> tuple[list[str], list[bytes], list[np.ndarray]]:
    """Codec, payload and 16 kHz PCM of each file, decoded together by codec."""
    codecs, payloads = map(list, zip(*map(read_wav, media), strict=True))
    pcm: list = [None] * len(media)
    tables = {"mulaw": mulaw_table(), "alaw": alaw_table()}
    for codec in CODECS:
        rows = [i for i, c in enumerate(codecs) if c == codec]
        if not rows:
            continue
        flat = np.frombuffer(b"".join(payloads[i] for i in rows), np.uint8)
        sizes = np.array([len(payloads[i]) for i in rows])
        if codec == "adpcm":
            out, sizes = decode_adpcm(flat.reshape(-1, BLOCK)).ravel(), sizes // BLOCK * BLOCK_SAMPLES
        else:
            out = tables[codec][flat]
        ends = np.cumsum(sizes)
        for i, x in zip(rows, np.split(resample2(out, ends), 2 * ends[:-1]), strict=True):
            pcm[i] = x
    return codecs, payloads, pcm


def chunks(column: pd.Series) -> Iterator[slice]:
    """Slices of a batch that hold about CHUNK bytes."""
    sizes = column.map(lambda x: len(x) if x is not None else 0).to_numpy().cumsum()
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + CHUNK, side="right")))
        yield slice(at, to)
        at = to


def store(df: DataFrame, text: str = "text") -> DataFrame:
    """Texts (null: empty) to WAV files: (doc_id, n_bytes, media). Equal texts give equal files; the text's crc32 picks the codec.

    Every row gives a row, repeated ones and those without an id too; other columns aren't read, and an empty table gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in chunks(pdf["data"]):
                n, media = [], []
                for x in pdf["data"].iloc[part]:
                    n.append(len(x))
                    media.append(wav(bytes(x) + bytes(-len(x) % BLOCK or BLOCK * (not x)), CODECS[zlib.crc32(x) % 3]))
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[part].to_numpy(), "n_bytes": n, "media": media})

    data = F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data")
    return df.select("doc_id", data).mapInPandas(run, "doc_id long, n_bytes long, media binary")


def features(df: DataFrame, keep_pcm: bool = False) -> DataFrame:
    """Digests and features of stored files, read from their bytes; ``keep_pcm`` adds the resampled signal (16-bit, 16 kHz).

    Every file gives a row, repeated ones and those without an id too; bytes that ``store`` didn't write raise.
    """
    schema = (
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
        "media_sha256 string, feature string" + ", pcm binary" * keep_pcm
    )

    def row(doc_id, n, media: bytes, codec: str, payload: bytes, pcm: np.ndarray) -> tuple:
        x = pcm.astype(np.float64)
        rms, zcr = np.sqrt(np.mean(x * x)), int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
        feature = f"{codec};samples={len(pcm)};rms={rms:.3f};peak={int(np.abs(pcm.astype(np.int32)).max())};crossings={zcr};pcm={zlib.crc32(pcm.tobytes()):08x}"
        out = doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature
        return (*out, pcm.astype("<i2").tobytes()) if keep_pcm else out

    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in chunks(pdf["media"]):
                p = pdf.iloc[part]
                yield pd.DataFrame(list(map(row, p["doc_id"], p["n_bytes"], p["media"], *decode(list(p["media"])))), columns=names)

    return df.mapInPandas(run, schema)


def op4_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text stored as telephony audio and read back."""
    return features(store(table(spark, sf_dir, "documents")))
