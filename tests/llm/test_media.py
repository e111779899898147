import hashlib
import math
import zlib

import numpy as np
import pytest

from tests.llm.data import AWKWARD, docs_frame
from tidemark.llm import media as m


def test_round_trip_of_awkward_texts(spark):
    df = docs_frame(spark, AWKWARD, extra=("media", "hash"))
    got = m.read_png(m.encode_png(df)).collect()
    want = []
    for i, t in AWKWARD:
        p = m.payload_of(t)
        assert len(p) % 64 == 0 and len(p) >= 64
        want.append((i, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), None))
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.error) for r in got), key=str) == sorted(want, key=str)
    assert all(len(r.hash) == 8 for r in got)


def test_all_filters_undo():
    rng = np.random.default_rng(0)
    image = rng.integers(0, 256, (40, 64), dtype=np.uint8)
    lines = np.empty((40, 65), np.uint8)
    for i in range(40):
        kind = i % 5
        left, up = np.concatenate([[0], image[i, :-1]]).astype(int), (image[i - 1] if i else np.zeros(64)).astype(int)
        corner = np.concatenate([[0], up[:-1]]).astype(int)
        p = left + up - corner
        a, b, c = abs(p - left), abs(p - up), abs(p - corner)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        guess = [0, left, up, (left + up) // 2, paeth][kind]
        lines[i, 0], lines[i, 1:] = kind, (image[i].astype(int) - guess) % 256
    assert (m.unfiltered(lines) == image).all()


def test_every_damaged_byte_is_noticed():
    png = m.to_png(m.payload_of("some text " * 30))
    for at in range(len(png)):
        bad = bytearray(png)
        bad[at] ^= 0x10
        with pytest.raises(ValueError):
            m.from_png(bytes(bad))
    with pytest.raises(ValueError):
        m.from_png(png[:-5])


def test_damaged_media_give_nulls(spark):
    df = spark.createDataFrame([(1, 3, bytearray(b"not a png")), (2, 0, None)], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in m.read_png(df).collect()}
    assert got[1].error and got[1].payload_sha256 is None and got[2].error == "no media"


def test_hash_is_stable_under_small_changes():
    text = "the quick brown fox jumps over the lazy dog " * 200
    a, b = (m.cosine_hash(m.from_png(m.to_png(m.payload_of(t)))) for t in (text, text.replace("lazy", "lamy", 1)))
    assert sum((x ^ y).bit_count() for x, y in zip(a, b)) <= 6


def test_empty_table(spark):
    assert m.read_png(m.encode_png(docs_frame(spark, []))).collect() == []


def plain_hash(image):
    """The cosine hash by plain loops."""
    n, side, low = image.shape, m.SIDE, m.LOW

    def cell(axis, i):
        if n[axis] < side:
            return [i * n[axis] // side]
        return range(i * n[axis] // side, (i + 1) * n[axis] // side)

    small = [[sum(float(image[r, c]) for r in cell(0, i) for c in cell(1, j)) / (len(cell(0, i)) * len(cell(1, j))) for j in range(side)] for i in range(side)]
    wave = [[math.cos(math.pi * (2 * x + 1) * u / (2 * side)) for x in range(side)] for u in range(low)]
    terms = [round(sum(wave[u][i] * wave[v][j] * small[i][j] for i in range(side) for j in range(side)), 6) for u in range(low) for v in range(low)]
    middle = sorted(terms[1:])[(low * low - 1) // 2]
    bits = "".join("1" if t > middle else "0" for t in terms)
    return int(bits, 2).to_bytes(low * low // 8, "big")


def test_cosine_hash_equals_plain_loops():
    for seed, rows in enumerate((1, 7, 32, 45)):
        image = np.random.default_rng(seed).integers(0, 256, (rows, m.WIDTH), dtype=np.uint8)
        assert m.cosine_hash(image) == plain_hash(image)


def test_query_equals_plain_python(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = m.op2_media_columns(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r.doc_id]
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(payload), zlib.crc32(payload[-64:]))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.feature == m.cosine_hash(np.frombuffer(payload, np.uint8).reshape(-1, 64)).hex()


def test_very_long_texts_come_back(spark):
    texts = {1: "é" * 3_000_000, 2: "ab\n" * 2_000_000, 3: "short"}
    for r in m.read_png(m.encode_png(docs_frame(spark, list(texts.items())))).collect():
        p = m.payload_of(texts[r.doc_id])
        assert (r.n_bytes, r.payload_sha256, r.error) == (len(texts[r.doc_id].encode()), hashlib.sha256(p).hexdigest(), None)
