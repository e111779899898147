"""Media columns: PNG bytes in binary columns, checked, unfiltered and hashed.

:func:`encode_png` stores a text's bytes as the samples of an 8-bit grey PNG;
:func:`read_png` walks the chunks, tests every checksum, inflates, undoes the
row filters with numpy and hashes the image by the signs of its low-frequency
cosine terms.

Defined cases: a null text is empty; the payload is never empty (64 zero bytes
at least); media that fail a check give nulls and the reason in ``error``.
Equal texts give equal media and equal hashes; other columns pass by unread.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, table, text_or_empty

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Side of the averaged image, and of the corner of low frequencies.
SIDE, LOW = 32, 8


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def filtered(rows: np.ndarray, kind: int) -> np.ndarray:
    """The rows under filter 0 (none), 1 (left) or 2 (above)."""
    out = rows.copy()
    if kind == 1:
        out[:, 1:] -= rows[:, :-1]
    elif kind == 2:
        out[1:] -= rows[:-1]
    return out


def to_png(payload: bytes, width: int = WIDTH, level: int = 4) -> bytes:
    """An 8-bit grey PNG of *payload*, under the filter with the smallest absolute sum."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    tried = [filtered(rows, k) for k in (0, 1, 2)]
    kind = int(np.argmin([int(np.abs(t.view(np.int8).astype(np.int32)).sum()) for t in tried]))
    lines = np.empty((len(rows), width + 1), np.uint8)
    lines[:, 0] = kind
    lines[:, 1:] = tried[kind]
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def unfiltered(lines: np.ndarray) -> np.ndarray:
    """Undo the row filters 0 to 4; runs of rows under 0, 1 or 2 at once."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if kinds.size and int(kinds.max()) > 4:
        raise ValueError("unknown row filter")
    edges = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(kinds)]
    for a, b in zip(edges, edges[1:]):
        if a == b:
            continue
        kind, above = int(kinds[a]), out[a - 1] if a else np.zeros(out.shape[1], np.uint8)
        if kind == 1:
            out[a:b] = np.cumsum(out[a:b], axis=1, dtype=np.uint8)
        elif kind == 2:
            out[a:b] = np.cumsum(np.vstack([above, out[a:b]]), axis=0, dtype=np.uint8)[1:]
        elif kind > 2:
            for i in range(a, b):
                out[i] = _serial(out[i], out[i - 1] if i else np.zeros_like(out[0]), kind)
    return out


def _serial(line: np.ndarray, above: np.ndarray, kind: int) -> np.ndarray:
    """Filters 3 (average) and 4 (Paeth), where each sample needs the one on its left."""
    left = corner = 0
    out = []
    for x, up in zip(line.tolist(), above.tolist()):
        if kind == 3:
            guess = (left + up) // 2
        else:
            p = left + up - corner
            guess = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
        left, corner = (x + guess) & 255, up
        out.append(left)
    return np.array(out, np.uint8)


def from_png(media: bytes) -> np.ndarray:
    """The samples of an 8-bit grey PNG; ValueError where a check fails."""
    if media[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, packed, ended = 8, None, [], False
    while at < len(media) and not ended:
        if at + 12 > len(media):
            raise ValueError("cut chunk")
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if len(media) < at + 12 + n:
            raise ValueError("cut chunk")
        if zlib.crc32(body, zlib.crc32(kind)) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError(f"checksum of {kind.decode('latin-1')}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if head is None or not ended:
        raise ValueError("no header or end")
    width, height, *form = head
    if form != [8, 0, 0, 0, 0]:
        raise ValueError("not an 8-bit grey image")
    try:
        lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    except zlib.error as e:
        raise ValueError(f"zlib: {e}") from None
    if lines.size != height * (width + 1):
        raise ValueError("wrong number of samples")
    return unfiltered(lines.reshape(height, width + 1))


def _cosines(n: int = SIDE, k: int = LOW) -> np.ndarray:
    return np.cos(np.pi * (2 * np.arange(n) + 1) * np.arange(k)[:, None] / (2 * n))


_COSINES = _cosines()


def _averaged(image: np.ndarray, side: int = SIDE) -> np.ndarray:
    """The image as side x side means (samples repeat where it is smaller)."""
    out = image.astype(np.float64)
    for axis in (0, 1):
        n = out.shape[axis]
        if n < side:
            out = np.take(out, np.arange(side) * n // side, axis=axis)
        else:
            starts = np.arange(side) * n // side
            width = np.diff(np.append(starts, n)).reshape([-1, 1] if axis == 0 else [1, -1])
            out = np.add.reduceat(out, starts, axis=axis) / width
    return out


def cosine_hash(image: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 low-frequency cosine terms exceed their median (the mean term aside)."""
    terms = (_COSINES @ _averaged(image) @ _COSINES.T).round(6).ravel()
    return np.packbits(terms > np.median(terms[1:])).tobytes()


def encode_png(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: the text's bytes, padded with zeros to a positive multiple of 64, as a PNG."""

    def rows(columns: list[list]) -> list[list]:
        ids, texts = columns
        sizes = [len((t or "").encode("utf-8", "surrogatepass")) for t in texts]
        return [ids, sizes, [to_png(payload_of(t)) for t in texts]]

    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
    return map_rows(docs.select("doc_id", text_or_empty().alias("text")), rows, schema, "doc_id long, n_bytes long, media binary")


def read_png(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media_bytes, media_sha256, payload_bytes, payload_sha256, tail_crc32, hash, error."""

    def one(blob: bytes | None) -> tuple:
        if blob is None:
            return (None, None, None, None, None, None, "no media")
        whole = (len(blob), hashlib.sha256(blob).hexdigest())
        try:
            image = from_png(blob)
        except ValueError as e:
            return (*whole, None, None, None, None, str(e))
        payload = image.tobytes()
        return (*whole, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), cosine_hash(image), None)

    def rows(columns: list[list]) -> list[list]:
        ids, sizes, blobs = columns
        found = [one(b) for b in blobs]
        return [ids, sizes, *(list(c) for c in zip(*found))]

    fields = [
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()),
        ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("hash", pa.binary()), ("error", pa.string()),
    ]
    ddl = "doc_id long, n_bytes long, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, hash binary, error string"
    return map_rows(media.select("doc_id", "n_bytes", "media"), rows, pa.schema(fields), ddl)


def op2_media_columns(spark, sf_dir: str) -> DataFrame:
    read = read_png(encode_png(table(spark, sf_dir, "documents")))
    return read.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
        F.lower(F.hex("hash")).alias("feature"),
    )
