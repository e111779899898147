r"""Packing along a space-filling curve.

Documents become hashed vectors of byte 4-grams, projected to ``DIMENSIONS`` axes;
their place on a Hilbert curve through those axes is the sort key.  A range sort
by that key puts similar documents side by side, and each range is cut into
sequences of ``MAX_TOKENS`` tokens as it streams by, so neighbours on the curve
share sequences.  The last tokens of a range become sequences of powers of two:
no sequence is padded at all.  Where the ranges begin is taken from a sample of the
keys (about ``CUT_ROWS`` a range); every row is placed, so the sample decides only how
even the ranges are, and whole texts are read and hashed once.

Ids are those of the tokenizer file as it is, its two control strings included.

Defined cases: a null text is empty and still gives its end token; equal keys
are ordered by place in the table, so copies of one text spread over ranges, with or
without doc_ids; repeated rows are packed as often as they occur; an empty table gives
no pieces; other columns are unread.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, slices, table, text_or_empty

MAX_TOKENS = 2048
END_ID = 1
#: Axes of the curve and bits of each; buckets of the hashed vectors.
DIMENSIONS, BITS, BUCKETS = 4, 12, 1024
SEED = 7
#: Sampled rows a range by which the beginnings of ranges are placed.
CUT_ROWS = 32
#: Bytes in which a worker remembers the ids of strings, in each of two generations; the longest string; what an entry takes besides its contents.
REMEMBERED, LONGEST_REMEMBERED, ENTRY = 90_000_000, 64, 160


# -- the curve -----------------------------------------------------------------------


def _axes() -> np.ndarray:
    return np.random.default_rng(SEED).choice([-1.0, 1.0], (BUCKETS, DIMENSIONS))


_PROJECTION = _axes()


def hashed_vector(text: str) -> np.ndarray:
    """Counts of hashed byte 4-grams, at unit length."""
    raw = text.encode("utf-8", "surrogatepass")
    raw += bytes(max(0, 4 - len(raw)))
    grams = np.ndarray(len(raw) - 3, "<u4", raw, strides=(1,))  # every four bytes, overlapping
    counts = np.bincount((grams * np.uint32(2654435761)) >> np.uint32(22), minlength=BUCKETS).astype(np.float64)
    return counts / np.sqrt((counts * counts).sum())


def coordinates(vectors: np.ndarray) -> np.ndarray:
    """Projected, and squashed to integers of BITS bits (unit vectors project to about unit spread)."""
    squashed = 0.5 + 0.5 * np.tanh(vectors @ _PROJECTION)
    return np.minimum(squashed * (1 << BITS), (1 << BITS) - 1).astype(np.int64)


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of integer points (rows), by Skilling's transform of the axes."""
    x = points.T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0]) ^ swap
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where(x[n - 1] & q, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    keys = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            keys = keys << 1 | x[i] >> bit & 1
    return keys


def with_curve_keys(rows: DataFrame, cuts: list[tuple[int, int]] = (), max_chars: int = 4_000_000) -> DataFrame:
    """Of :func:`placed_rows`: doc_id, text, key, tie and range: how many of the sorted (key, tie) of *cuts* are not beyond the row."""
    names = ("doc_id", "text", "key", "tie", "range")
    schema = pa.schema(list(zip(names, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32()))))
    cut_keys, cut_ties = (np.array([c[i] for c in cuts], np.int64) for i in (0, 1))

    def ranges(keys: np.ndarray, ties: np.ndarray) -> np.ndarray:
        low, high = (np.searchsorted(cut_keys, keys, side) for side in ("left", "right"))
        for i in np.flatnonzero(low < high):  # keys that are cut inside
            low[i] += np.searchsorted(cut_ties[low[i] : high[i]], ties[i], "right")
        return low.astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, max_chars):
                vectors = np.array([hashed_vector(t) for t in part.column(1).to_pylist()]).reshape(-1, BUCKETS)
                keys, ties = hilbert_keys(coordinates(vectors)), part.column(2).to_numpy()
                columns = [part.column(0), part.column(1).cast(pa.string()), pa.array(keys, pa.int64()), part.column(2), pa.array(ranges(keys, ties))]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return rows.select("doc_id", "text", "tie").mapInArrow(run, "doc_id long, text string, key long, tie long, range int")


def placed_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text (null as empty) and tie, the row's place in the table."""
    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"), F.monotonically_increasing_id().alias("tie"))


def range_cuts(rows: DataFrame, ranges: int, cut_rows: int = CUT_ROWS) -> list[tuple[int, int]]:
    """At most ``ranges - 1`` pairs (key, tie) that part the rows about evenly, from about *cut_rows* rows a range."""
    every = max(1, rows.count() // (ranges * cut_rows))
    sample = rows.filter(F.pmod(F.xxhash64("tie"), F.lit(every)) == 0)
    found = sorted(map(tuple, with_curve_keys(sample).select("key", "tie").collect()))  # about cut_rows a range
    return [found[len(found) * r // ranges] for r in range(1, ranges)] if len(found) >= ranges else found


# -- tokens --------------------------------------------------------------------------------


class Memory:
    """A memory in two generations of *size* bytes each: what was asked for again outlives the turn to a new one."""

    def __init__(self, size: int = REMEMBERED):
        self.size, self.young, self.old, self.held = size, {}, {}, 0

    def recalled(self, keys: set[str]) -> tuple[dict[str, bytes], set[str]]:
        """What either generation knows of *keys* (the old one's goes to the young), and the others."""
        young, old = self.young, self.old
        found, unknown = {}, set()
        for k in keys:
            x = young.get(k)
            if x is None:
                x = old.get(k)
                if x is None:
                    unknown.add(k)
                    continue
                young[k] = x
                self.held += ENTRY + len(k) + len(x)
            found[k] = x
        return found, unknown

    def learn(self, new: dict[str, bytes]) -> None:
        """Remember short strings; called after use, as it may start a generation."""
        short = {k: x for k, x in new.items() if len(k) <= LONGEST_REMEMBERED}
        self.young.update(short)
        self.held += sum(map(len, short)) + sum(map(len, short.values())) + ENTRY * len(short)
        if self.held > self.size:
            self.old, self.young, self.held = self.young, {}, 0


def _byte_letters() -> dict[int, str]:
    """The letter of each byte in byte-level vocabularies: printable bytes are their own, the others count on from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in own]
    return {b: chr(256 + i) for i, b in enumerate(others)}


BYTE_LETTERS = _byte_letters()


class WordEncoder:
    """The ids of the word-level BPE file, each distinct string between white space encoded once per worker.

    White space always ends a word and gives no ids, so a text's ids are those of
    its parts between white space, one after the other.  Latin parts are split into
    words here, which more parts share: a word is lower case, composed and one match
    of the pattern, so the file's model reads its bytes without the steps before.
    What holds other letters or might hold a control string goes to the whole tokenizer.
    """

    # Fixed value: the file's own splitting pattern (white space is dropped).
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.find = regex.compile(self.PATTERN).findall
        self.separators = regex.compile(r"[\x1c-\x1f]").search  # white space to str.split() only
        self.spaces = regex.compile(r"\s+").split
        self.memory = Memory()

    @staticmethod
    def plain(part: str) -> bool:
        """Composed Latin letters, which lower-case one by one, and no control string."""
        return "<|" not in part and max(part, default="") < "\u0250" and "İ" not in part

    def words(self, part: str) -> list[str]:
        """Strings whose ids, one after the other, are those of *part*."""
        return self.find(part.lower()) if self.plain(part) else [part]

    def word_ids(self, word: str) -> bytes:
        """The ids of one of :meth:`words`."""
        if not self.plain(word):
            return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        letters = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(BYTE_LETTERS)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        parts = self.spaces(text) if self.separators(text) else text.split()
        held = list(map(self.memory.young.get, parts))
        if None not in held:
            return b"".join(held)
        found, new = self.memory.recalled({p for p, x in zip(parts, held) if x is None})
        if new:
            words = {p: self.words(p) for p in new}  # a word is a part of its own, so one memory serves both
            ids, unknown = self.memory.recalled({w for ws in words.values() for w in ws})
            ids |= {w: self.word_ids(w) for w in unknown}
            found |= {p: b"".join([ids[w] for w in ws]) for p, ws in words.items()}
            self.memory.learn(ids)
            self.memory.learn(found)
        return b"".join([found[p] if x is None else x for p, x in zip(parts, held)])


_encoders: dict[str, WordEncoder] = {}


def encoder_of(path: str, remembered: int = REMEMBERED) -> WordEncoder:
    """The worker's encoder, kept from task to task with what it remembers."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    if _encoders[path].memory.size != remembered:
        _encoders[path].memory = Memory(remembered)
    return _encoders[path]


def forget(path: str) -> None:
    """Drop the worker's encoder and return what is free: workers outlive tasks, and take turns at them."""
    _encoders.pop(path, None)
    give_back()


# -- sequences -------------------------------------------------------------------------------


class Packer:
    """Cuts a stream of documents into sequences; the open one is held, full ones leave."""

    def __init__(self, first_sequence: int, size: int = MAX_TOKENS):
        self.size, self.sequence = size, first_sequence
        self.open: list[tuple] = []  # (doc_id, start, ids, tokens of the document)
        self.held = 0

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[tuple]:
        total, at = len(ids) // 4, 0
        while at < total:
            n = min(total - at, self.size - self.held)
            self.open.append((doc_id, at, ids[4 * at : 4 * (at + n)], total))
            self.held, at = self.held + n, at + n
            if self.held == self.size:
                yield from self._leave()

    def _leave(self) -> Iterator[tuple]:
        offset = 0
        for doc_id, start, ids, total in self.open:
            n = len(ids) // 4
            yield doc_id, start, n, zlib.crc32(ids), total, self.sequence, offset
            offset += n
        self.sequence, self.open, self.held = self.sequence + 1, [], 0

    def finish(self) -> Iterator[tuple]:
        """The rest as sequences of descending powers of two."""
        rest, left = self.open, self.held
        self.open, self.held = [], 0
        whole = self.size
        while left:
            self.size = 1 << (left.bit_length() - 1)
            left -= self.size
            while self.held < self.size:
                doc_id, start, ids, total = rest.pop(0)
                n = min(len(ids) // 4, self.size - self.held)
                self.open.append((doc_id, start, ids[: 4 * n], total))
                self.held += n
                if 4 * n < len(ids):
                    rest.insert(0, (doc_id, start + n, ids[4 * n :], total))
            yield from self._leave()
        self.size = whole


PIECES = pa.schema(
    [(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
)
PIECES_DDL = ", ".join(f"{n} long" for n in PIECES.names)


def pack(docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS, max_chars: int = 4_000_000, remembered: int = REMEMBERED, keep: bool = True) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A worker keeps the ids of strings in twice *remembered* bytes, with *keep* from task to task; less memory costs time and changes nothing else.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path, remembered)
        packer = Packer(TaskContext.get().partitionId() << 40, max_tokens)
        end = array("I", [END_ID]).tobytes()

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=PIECES)

        for batch in batches:
            for part in slices(batch, max_chars):
                rows = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    rows += packer.add(doc_id, encoder.encode(text) + end)
                if rows:
                    yield out(rows)
        if not keep:
            del encoder
            forget(tokenizer_path)
        if rows := list(packer.finish()):
            yield out(rows)

    rows, ranges = placed_rows(docs), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = with_curve_keys(rows, range_cuts(rows, ranges))
    ordered = keyed.repartitionById(ranges, "range").sortWithinPartitions("key", "tie")
    return ordered.select("doc_id", "text").mapInArrow(run, PIECES_DDL)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())
