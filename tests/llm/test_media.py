import hashlib
import zlib

import numpy as np

from occuflow.llm import media


def test_lookup_tables_follow_g711():
    u, a = media.mulaw_table(), media.alaw_table()
    assert (u[0], u[0x7F], u[0x80], u[0xFF]) == (-32124, 0, 32124, 0)
    assert (a[0x55], a[0xD5], a[0x2A], a[0xAA]) == (-8, 8, -32256, 32256)
    assert len(set(u.tolist())) == 255 and len(set(a.tolist())) == 256


def slow_adpcm(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(media.STEPS[index])
            diff = step >> 3
            for bit, part in ((1, step >> 2), (2, step >> 1), (4, step)):
                diff += part if code & bit else 0
            value = max(-32768, min(32767, value - diff if code & 8 else value + diff))
            index = max(0, min(88, index + int(media.MOVES[code & 7])))
            out.append(value)
    return out


def test_adpcm_blocks_match_one_by_one():
    blocks = np.random.default_rng(3).integers(0, 256, (40, 64), dtype=np.uint8)
    assert media.decode_adpcm(blocks).tolist() == [slow_adpcm(b.tobytes()) for b in blocks]


def test_round_trip(make_docs):
    texts = [None, "", "a", "x" * 64, "y" * 65, "ü😀" * 3000, "same text", "same text", "z" * 300_000]
    rows = {r["doc_id"]: r for r in media.features(media.store(make_docs(texts)), keep_pcm=True).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + bytes(-len(data) % 64 or 64 * (not data))
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        n = len(payload) // 64 * 121 if r["feature"].startswith("adpcm") else len(payload)
        assert len(r["pcm"]) == 2 * 2 * n
    assert rows[6].asDict() | {"doc_id": 0} == rows[7].asDict() | {"doc_id": 0}


def test_resampling_keeps_signals_apart():
    out = media.resample2(np.array([0, 10, 100, 200], np.int16), np.array([2, 4]))
    assert out.tolist() == [0, 5, 10, 10, 100, 150, 200, 200]


def test_empty_table(make_docs):
    assert media.features(media.store(make_docs(["a"]).limit(0))).count() == 0


def test_null_ids_repeated_rows_clashing_columns(make_docs):
    import hashlib

    from pyspark.sql import functions as F

    texts = [None, "", "a text", "é" * 70, "long " * 60_000]
    docs = make_docs(texts, [(None, "no id", None, None, None), (2, "a text", None, None, None), (2, "another text", None, None, None)])
    for c in ("data", "media", "n_bytes", "feature", "payload_bytes", "pcm"):
        docs = docs.withColumn(c, F.lit("mine"))
    rows = media.features(media.store(docs), keep_pcm=True).collect()
    assert len(rows) == len(texts) + 3
    held = sorted((str(r["doc_id"]), r["n_bytes"], r["payload_sha256"]) for r in rows)
    want = []
    for i, t in [*enumerate(texts), (None, "no id"), (2, "a text"), (2, "another text")]:
        x = (t or "").encode()
        want.append((str(i), len(x), hashlib.sha256(x + bytes(-len(x) % 64 or 64 * (not x))).hexdigest()))
    assert held == sorted(want)
    same = [r for r in rows if r["n_bytes"] == 6]
    assert len({(r["feature"], bytes(r["pcm"])) for r in same}) == 1
    assert media.features(media.store(docs.limit(0))).count() == 0


def test_tables_by_the_rule_of_the_standard():
    # segments of mu-law start at 33 * 2^k - 33 steps of four, those of A-law double from the second on
    mu, a = media.mulaw_table().astype(int), media.alaw_table().astype(int)
    for code in range(256):
        u, sign = ~code & 255, -1 if ~code & 128 else 1
        size = ((2 * (u & 15) + 33) << ((u >> 4) & 7)) - 33
        assert mu[code] == sign * size * 4
        x = code ^ 0x55
        e, m = (x >> 4) & 7, x & 15
        size = 2 * m + 1 if e == 0 else (2 * m + 33) << (e - 1)
        assert a[code] == (1 if x & 128 else -1) * size * 8
