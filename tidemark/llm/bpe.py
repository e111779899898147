r"""Byte-level BPE by a global distinct-word shuffle.

1. Texts are split by the pattern into pre-tokens.  Documents are taken together in
   *blocks* of bounded text; a block lists its distinct words once and keeps the
   positions as numbers into that list, so a word's occurrences cost a number each.
   Blocks are written bucketed by their number and do not move again.
2. The words of all blocks are shuffled by a hash of the word.  Equal words meet in
   one bucket and are encoded there once; a bucket's distinct words are remembered, so
   a table with more of them wants more shuffle partitions (four buckets each).
3. The ids are joined back to the blocks (only they are shuffled), one block at a time,
   and every document is put together by position.
4. Decoding joins each id with the token-byte table and the bytes by position.  That
   table is as long as the vocabulary, so this is a broadcast join on an index: every
   task holds the table as an array and looks ids up in it, without a row per token.

The blocks are written files, so retries see the same numbering; the catalogue entry
that lets Spark know their buckets is dropped as soon as they are planned.

Defined cases: a null text is empty and has no ids; a text longer than a block is a
block of its own; repeated rows are encoded each; null doc_ids are kept.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, table, text_or_empty

BLOCK_CHARS = 4_000_000
#: Documents in one batch of assembled ids.
BATCH = 500


def read_ranks(path: str) -> dict[bytes, int]:
    """The token-byte table of a ``.tiktoken`` file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def rank_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _pack(values: np.ndarray) -> bytes:
    """Unsigned 32-bit integers, byte plane by byte plane, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack(blob: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _pack_words(words: list[str]) -> tuple[bytes, bytes]:
    """The lengths, and the words end to end."""
    import zstandard

    return _pack(np.array([len(w) for w in words], np.uint32)), zstandard.ZstdCompressor(level=3).compress("".join(words).encode())


def _unpack_words(lengths: bytes, blob: bytes) -> list[str]:
    import zstandard

    text, at, out = zstandard.ZstdDecompressor().decompress(blob).decode(), 0, []
    for n in _unpack(lengths).tolist():
        out.append(text[at : at + n])
        at += n
    return out


# -- blocks ---------------------------------------------------------------------------------

_WORDS = pa.struct([("bucket", pa.int32()), ("first", pa.int64()), ("sizes", pa.binary()), ("words", pa.binary())])
_BLOCKS = pa.schema([("doc_ids", pa.list_(pa.int64())), ("lengths", pa.binary()), ("codes", pa.binary()), ("lists", pa.list_(_WORDS))])
_BLOCKS_DDL = "doc_ids array<long>, lengths binary, codes binary, lists array<struct<bucket:int,first:long,sizes:binary,words:binary>>"


class _Block:
    """Documents as numbers into a list of their distinct words."""

    def __init__(self):
        self.ids, self.lengths, self.codes, self.chars = [], [], [], 0
        self.known: dict[str, int] = {}

    def add(self, doc_id, words: list[str], chars: int) -> None:
        known = self.known
        self.codes.append(np.array([known.setdefault(w, len(known)) for w in words], np.uint32))
        self.ids.append(doc_id)
        self.lengths.append(len(words))
        self.chars += chars

    def row(self, buckets: int) -> dict:
        """Renumbered by bucket and word, so that each bucket's words are one range of numbers."""
        words = list(self.known)
        of = [zlib.crc32(w.encode("utf-8", "surrogatepass")) % buckets for w in words]
        order = sorted(range(len(words)), key=lambda i: (of[i], words[i]))
        renumbered = np.empty(len(words), np.uint32)
        renumbered[order] = np.arange(len(words), dtype=np.uint32)
        codes = np.concatenate(self.codes) if self.codes else np.empty(0, np.uint32)
        lists: list[dict] = []
        for at, i in enumerate(order):
            if not lists or lists[-1]["bucket"] != of[i]:
                lists.append({"bucket": of[i], "first": at, "words": []})
            lists[-1]["words"].append(words[i])
        for x in lists:
            x["sizes"], x["words"] = _pack_words(x["words"])
        return {
            "doc_ids": self.ids,
            "lengths": _pack(np.array(self.lengths, np.uint32)),
            "codes": _pack(renumbered[codes] if len(words) else codes),
            "lists": lists,
        }


def blocks(docs: DataFrame, pattern: str, buckets: int, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The table of blocks: block, doc_ids, lengths, codes, lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find, block = regex.compile(pattern).findall, _Block()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if block.ids and block.chars + len(text) > block_chars:
                    yield pa.RecordBatch.from_pylist([block.row(buckets)], _BLOCKS)
                    block = _Block()
                block.add(doc_id, find(text), len(text))
        if block.ids:
            yield pa.RecordBatch.from_pylist([block.row(buckets)], _BLOCKS)

    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, _BLOCKS_DDL)
    rows = rows.withColumn("block", F.monotonically_increasing_id())
    spark = docs.sparkSession
    name = f"bpe_blocks_{uuid.uuid4().hex}"
    writer = rows.write.format("parquet").option("path", scratch_path(spark, "bpe-blocks")).option("compression", "uncompressed")
    writer.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").saveAsTable(name)
    stored = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # an external table: its files stay, and the plan knows them
    return stored


# -- words to ids -------------------------------------------------------------------------------


def encoded_words(lists: DataFrame, path: str, pattern: str, buckets: int) -> DataFrame:
    """lists: bucket, block, first, sizes, words; returns block, first, counts and ids of those words, each distinct word encoded once."""
    schema = pa.schema([("block", pa.int64()), ("first", pa.int64()), ("counts", pa.binary()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoding = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
        known: dict[str, list[int]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                block, first, sizes, blob = (c[i].as_py() for c in batch.columns)
                found = []
                for w in _unpack_words(sizes, blob):
                    ids = known.get(w)
                    if ids is None:
                        ids = known[w] = encoding.encode_ordinary(w)
                    found.append(ids)
                counts = np.array([len(x) for x in found], np.uint32)
                flat = np.array([i for x in found for i in x], np.uint32)
                row = [[block], [first], [_pack(counts)], [_pack(flat)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, schema)], schema=schema)

    dealt = lists.select("block", "first", "sizes", "words", "bucket").repartitionById(buckets, "bucket")
    return dealt.drop("bucket").mapInArrow(run, "block long, first long, counts binary, ids binary")


def gathered(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """values[starts[i] : starts[i] + counts[i]] for every i, one after the other."""
    total = int(counts.sum())
    if not total:
        return values[:0]
    ends = np.cumsum(counts)
    return values[np.repeat(starts - (ends - counts), counts) + np.arange(total)]


def encode(docs: DataFrame, path: str, pattern: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) of every whole text."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = blocks(docs, pattern, buckets, block_chars)
    lists = stored.select("block", F.explode("lists").alias("x")).select("x.bucket", "block", "x.first", "x.sizes", "x.words")
    back = encoded_words(lists, path, pattern, buckets)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def assembled(block: pa.Table, parts: pa.Table) -> pa.Table:
        """The documents of one block, from the parts that hold its words' ids."""
        parts = parts.sort_by("first")
        counts, ids = ([_unpack(p.as_py()) for p in parts.column(k)] for k in ("counts", "ids"))
        n = np.concatenate(counts).astype(np.int64) if counts else np.empty(0, np.int64)
        flat = np.concatenate(ids) if ids else np.empty(0, np.uint32)
        starts, batches = np.cumsum(n) - n, []
        for i in range(block.num_rows):  # one
            doc_ids, lengths, codes = (block.column(k)[i].as_py() for k in ("doc_ids", "lengths", "codes"))
            codes, at, out = _unpack(codes), 0, []
            for length in _unpack(lengths).tolist():
                own = codes[at : at + length]
                at += length
                out.append(gathered(flat, starts[own], n[own]).astype("<u4").tobytes())
            for k in range(0, len(out), BATCH):
                part = [doc_ids[k : k + BATCH], out[k : k + BATCH]]
                batches.append(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(part, schema)], schema=schema))
        return pa.Table.from_batches(batches, schema)

    kept = stored.select("block", "doc_ids", "lengths", "codes").groupBy("block")
    return kept.cogroup(back.groupBy("block")).applyInArrow(assembled, "doc_id long, ids binary")


# -- ids to text -----------------------------------------------------------------------------


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of (doc_id, ids): each id joined with its bytes."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = sorted((i, b) for b, i in read_ranks(path).items())
        size = np.zeros(pieces[-1][0] + 1, np.int64)
        for i, b in pieces:
            size[i] = len(b)
        flat, starts = np.frombuffer(b"".join(b for _, b in pieces), np.uint8), np.cumsum(size) - size
        for batch in batches:
            rows = []
            for doc_id, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                blob = blob.as_py()
                ids = np.frombuffer(blob, "<u4")
                text = gathered(flat, starts[ids], size[ids])
                rows.append((doc_id, len(ids), hashlib.sha256(blob).hexdigest(), hashlib.sha256(text.tobytes()).hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode(encode(table(spark, sf_dir, "documents"), rank_path(), split_pattern()), rank_path())
