r"""N-gram Jaccard self-join by MinHash bands.

1. Each text becomes the set of its word 5-grams; equal sets are one *member*.
2. The rows of a band and the number of bands are chosen from the similarity and
   the target recall (:func:`choose_bands`); members meet by shuffling on band
   hashes.  Where they meet, one bit of each of their minimum hashes estimates the
   similarity, and pairs well below the threshold (``SLACK`` deviations) part again,
   so looser likeness does not chain buckets together.  A bucket returns a forest of its
   pairs: rows in proportion to its members and never to its pairs.
3. The components of those edges hold every pair that met.  They are
   dealt over cells, pairs of blocks of at most about ``BLOCK`` members, and each
   cell verifies its pairs on the full n-gram sets.  It returns, per member, the
   number of linked documents and an edge to the root of its links.
4. The components of the verified edges are the classes.

No link between members of one component is lost; a pair at the threshold shares no
bucket with the chance that the target recall states (5e-4, less above), and parts by its
estimate with one of 3e-7.  A component of m different texts costs m * m / 2
verifications, which exact link counts need, dealt over (m / BLOCK) ** 2 / 2 cells.

Defined cases: a null text is empty; a text without words is linked to none; one of
fewer than five words has its whole word sequence as its one n-gram; copies, repeated rows too, are one member
and count as links of each other; null doc_ids are documents too, sort last, and give no
class its id while another member has one; other columns are unread.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, skew_join, slices, table, text_or_empty
from .graph import components

NGRAM, THRESHOLD, RECALL = 5, 0.8, 0.9995
#: The most hashes spent on bands of more than one row.
MAX_HASHES = 400
#: Members of a block of a component, and of a bucket.
BLOCK, BUCKET_BLOCK = 256, 1024
#: How many standard deviations below the threshold an estimate may lie.
SLACK = 5.0
SEED = 11
REMEMBERED = 200_000
_WORD = re.compile(r"\w+")
_ODD = np.random.default_rng(SEED).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band can have so that enough bands reach *recall* at *threshold*.

    More rows let fewer dissimilar pairs meet; bands make up for the recall.  Bands of
    one row are used however many it takes, of more rows while *max_hashes* suffice.
    """
    if not (0 < threshold <= 1 and 0 < recall < 1):
        raise ValueError("threshold has to be in (0, 1], recall in (0, 1)")
    best = None
    for rows in range(1, 33):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-p))
        if best and bands * rows > max_hashes:
            break
        best = (bands, rows)
    return best


def least_estimate(threshold: float, hashes: int) -> float:
    """The least share of equal sketch bits of a pair that stays: SLACK deviations below that of a pair at the threshold."""
    p = (1 + threshold) / 2
    return p - SLACK * math.sqrt(p * (1 - p) / hashes)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


_word_hashes: dict[str, int] = {}


def ngram_set(text: str, n: int = NGRAM) -> np.ndarray:
    """The sorted 64-bit hashes of the distinct word n-grams of a text."""
    import xxhash

    words = _WORD.findall(text.lower())
    if len(_word_hashes) > REMEMBERED:
        _word_hashes.clear()
    known = _word_hashes.get
    hashes = []
    for w in words:
        h = known(w)
        if h is None:
            h = _word_hashes[w] = xxhash.xxh64_intdigest(w)
        hashes.append(h)
    w = np.array(hashes, np.uint64)
    k = min(n, len(w))
    if not k:
        return w
    grams = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        grams = _mixed(grams + w[j : len(w) - k + 1 + j] * _ODD[j])
    return np.unique(grams)


def set_key(grams: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for the whole set."""
    digest = hashlib.blake2b(grams.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


class Banding:
    """MinHash band hashes of n-gram sets."""

    def __init__(self, bands: int, rows: int):
        self.shape = (bands, rows)
        rng = np.random.default_rng(SEED + 1)
        self.times = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.plus = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
        self.fold = rng.integers(0, 2**63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def hashes(self, grams: np.ndarray) -> tuple[list[int], bytes]:
        """The band hashes, and a bit of each minimum hash."""
        least = np.full(len(self.times), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(grams), 1024):
            part = grams[at : at + 1024, None] * self.times + self.plus
            np.minimum(least, (part ^ (part >> np.uint64(29))).min(axis=0), out=least)
        folded = (least.reshape(self.shape) * self.fold).sum(axis=1, dtype=np.uint64)
        bands = _mixed(folded + np.arange(self.shape[0], dtype=np.uint64) * _ODD[8]).view(np.int64).tolist()
        return bands, np.packbits((_mixed(least) & np.uint64(1)).astype(bool)).tobytes()


SIGNATURES = pa.schema(
    [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())]
)
SIGNATURES_DDL = "doc_id long, text_hash long, h1 long, h2 long, n long, bands array<long>, sketch binary"


def hashed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text, text_hash."""
    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).withColumn("text_hash", F.xxhash64("text"))


def signatures(docs: DataFrame, bands: int, rows: int, ngram: int = NGRAM) -> DataFrame:
    """doc_id, text_hash, h1, h2 (the key of the n-gram set), n (its size), bands, sketch (a bit of each minimum hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        banding = Banding(bands, rows)
        for batch in batches:
            for part in slices(batch, 4_000_000):
                out = []
                for doc_id, text, text_hash in zip(*(c.to_pylist() for c in part.columns)):
                    grams = ngram_set(text, ngram)
                    out.append((doc_id, text_hash, *set_key(grams), len(grams), *(banding.hashes(grams) if len(grams) else ([], b""))))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), SIGNATURES)], schema=SIGNATURES)
        _word_hashes.clear()  # workers outlive tasks

    return hashed_texts(docs).mapInArrow(run, SIGNATURES_DDL)


# -- candidates -------------------------------------------------------------------------


def roots(hit: np.ndarray) -> list[int]:
    """The first member of each member's component, by a symmetric matrix of links."""
    root, todo = [-1] * len(hit), np.ones(len(hit), bool)
    for start in range(len(hit)):
        if not todo[start]:
            continue
        todo[start], front = False, [start]
        while front:
            i = front.pop()
            root[i] = start
            new = np.flatnonzero(hit[i] & todo)
            todo[new] = False
            front += new.tolist()
    return root


def both_ways(hit: np.ndarray) -> np.ndarray:
    """The symmetric matrix of links between two blocks."""
    a, b = hit.shape
    out = np.zeros((a + b, a + b), bool)
    out[:a, a:], out[a:, :a] = hit, hit.T
    return out


def streamed_cells(batches: Iterator[pa.RecordBatch], keys: int, max_chars: int = 4_000_000) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of each run of rows with equal first *keys* columns."""
    now, held = None, []
    for batch in batches:
        for part in slices(batch, max_chars):
            for row in zip(*(c.to_pylist() for c in part.columns)):
                if row[:keys] != now:
                    if held:
                        yield now, held
                    now, held = row[:keys], []
                held.append(row[keys:])
    if held:
        yield now, held


def dealt_over_cells(rows: DataFrame, size: str, block: int) -> DataFrame:
    """*rows* (rep, a group and its *size*) once for every cell of their block: block, ci, cj; a cell holds two blocks of the group, or one with itself."""
    blocks = F.ceil(F.col(size) / block).cast("int")
    dealt = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks").cast("long")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumn("ci", F.least("block", "with")).withColumn("cj", F.greatest("block", "with")).drop("with", "blocks")


def met(cells: DataFrame, least: float, hashes: int) -> DataFrame:
    """(rep, root): a forest of the pairs of each bucket's cell whose sketches agree in *least* of their bits or more."""
    schema = pa.schema([("rep", pa.int64()), ("root", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, ci, cj), rows in streamed_cells(batches, 3):
            rows = sorted(set(rows))
            blocks, reps, sketches = zip(*rows)
            bits = np.unpackbits(np.frombuffer(b"".join(sketches), np.uint8).reshape(len(rows), -1), axis=1, count=hashes)
            signs = bits.astype(np.float32) * 2 - 1
            cut = len(rows) if ci == cj else blocks.count(ci)
            agree = (signs[:cut] @ signs[0 if ci == cj else cut :].T + hashes) / 2
            hit = agree >= least * hashes - 1e-3
            root = roots(hit if ci == cj else both_ways(hit))
            out = [(reps[i], reps[r]) for i, r in enumerate(root) if i != r]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

    keys = ["bucket", "ci", "cj"]
    dealt = cells.select(*keys, "block", "rep", "sketch").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "rep long, root long")


# -- verification ----------------------------------------------------------------------


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of *left* with all of *right*, a slab of n-grams at a time."""
    out = np.zeros((len(left), len(right)), np.float32)
    if not left or not right:
        return out
    values = np.concatenate(left + right)
    rows = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in left + right])
    _, columns, counts = np.unique(values, return_inverse=True, return_counts=True)
    shared = counts[columns] > 1
    rows, columns = rows[shared], np.unique(columns[shared], return_inverse=True)[1]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    slab = 4096
    for at in range(0, int(columns[-1]) + 1 if columns.size else 0, slab):
        a, b = np.searchsorted(columns, [at, at + slab])
        dense = np.zeros((len(left) + len(right), slab), np.float32)
        dense[rows[a:b], columns[a:b] - at] = 1
        out += dense[: len(left)] @ dense[len(left) :].T
    return out


def linked(sets_a: list[np.ndarray], sets_b: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs have a Jaccard similarity of *threshold* or more."""
    common = overlaps(sets_a, sets_b).astype(np.float64)
    sizes = np.array([len(s) for s in sets_a], float)[:, None] + np.array([len(s) for s in sets_b], float)
    return common >= threshold * (sizes - common) - 1e-9


def verified_cell(reps: list[int], docs: list[int], blocks: list[int], sets: list[np.ndarray], diagonal: bool, threshold: float) -> list[tuple]:
    """(rep, other, links) of each member of a cell: the root of its links there, and the documents linked to it."""
    cut = len(reps) if diagonal else blocks.count(min(blocks))
    second = 0 if diagonal else cut
    if not diagonal and len(set(blocks)) < 2:
        return []
    hit = linked(sets[:cut], sets[second:], threshold)
    if diagonal:
        np.fill_diagonal(hit, False)
    weights = np.array(docs, np.int64)
    links = np.zeros(len(reps), np.int64)
    links[:cut] += hit @ weights[second:]
    if not diagonal:
        links[second:] += hit.T @ weights[:cut]
    root = roots(hit if diagonal else both_ways(hit))
    return [(reps[i], reps[root[i]], int(links[i])) for i in range(len(reps))]


def verify(cells: DataFrame, ngram: int, threshold: float) -> DataFrame:
    """cells: comp, ci, cj, block, rep, docs, text; returns (rep, other, links) per member and cell."""
    schema = pa.schema([("rep", pa.int64()), ("other", pa.int64()), ("links", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, ci, cj), rows in streamed_cells(batches, 3):
            blocks, reps, docs, texts = map(list, zip(*sorted(rows)))
            out = verified_cell(reps, docs, blocks, [ngram_set(t, ngram) for t in texts], ci == cj, threshold) if len(reps) > 1 else []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)
        _word_hashes.clear()

    keys = ["comp", "ci", "cj"]
    dealt = cells.select(*keys, "block", "rep", "docs", "text").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "rep long, other long, links long")


# -- the join -------------------------------------------------------------------------------


def near_duplicates(
    docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, ngram: int = NGRAM, block: int = BLOCK
) -> DataFrame:
    """doc_id, class_id (smallest doc_id of its class), class_size, n_links (other documents of its similarity or more)."""
    bands, rows = choose_bands(threshold, recall)
    signed = materialize(
        signatures(docs, bands, rows, ngram).withColumn("row_id", F.monotonically_increasing_id()), "ngram-signatures"
    )
    members = (
        signed.filter("n > 0")
        .groupBy("h1", "h2")
        .agg(
            F.min(F.struct("row_id", "doc_id", "text_hash")).alias("first"),
            F.min("doc_id").alias("doc_id"),
            F.count(F.lit(1)).alias("docs"),
            F.first("bands").alias("bands"),
            F.first("sketch").alias("sketch"),
        )
    )
    members = materialize(
        members.select("h1", "h2", F.col("first.row_id").alias("rep"), F.col("first.doc_id").alias("text_id"), F.col("first.text_hash").alias("text_hash"), "doc_id", "docs", "bands", "sketch"),
        "ngram-members",
    )
    buckets = members.select("rep", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sharing = materialize(buckets.join(shared.hint("merge"), "bucket"), "ngram-sharing")
    sketched = sharing.join(members.select("rep", "sketch").hint("merge"), "rep")
    near = met(dealt_over_cells(sketched, "n", BUCKET_BLOCK), least_estimate(threshold, bands * rows), bands * rows)
    candidates = components(near, "rep", "root").select(F.col("node").alias("rep"), F.col("label").alias("comp"))
    candidates = materialize(candidates, "ngram-candidates")

    narrow = members.select("h1", "h2", "rep", "text_id", "text_hash", "doc_id", "docs")
    sizes = candidates.groupBy("comp").agg(F.count(F.lit(1)).alias("n"))
    dealt = narrow.join(skew_join(candidates, sizes, "comp").hint("merge"), "rep")
    texts = dealt.join(_texts(docs).hint("merge"), _same_text(dealt)).dropDuplicates(["rep"])  # a row of the table may be repeated
    cells = dealt_over_cells(texts, "n", block)
    found = materialize(verify(cells, ngram, threshold), "ngram-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    labels = components(found.filter("rep <> other"), "rep", "other").select(F.col("node").alias("rep"), "label")

    classed = materialize(
        narrow.join(labels.hint("merge"), "rep", "left")
        .join(links.hint("merge"), "rep", "left")
        .select("h1", "h2", "doc_id", "docs", F.coalesce("label", "rep").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("docs") - 1).alias("links")),
        "ngram-classed",
    )
    heads = classed.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.sum("docs").alias("class_size"))
    by_set = skew_join(classed.select("h1", "h2", "label", "links"), heads, "label").drop("label")
    worded = skew_join(signed.filter("n > 0").select("doc_id", "h1", "h2"), materialize(by_set, "ngram-classes"), "h1", "h2")
    wordless = signed.filter("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).alias("class_size"), F.lit(0).alias("links"))
    columns = ["doc_id", "class_id", F.col("class_size").cast("long").alias("class_size"), F.col("links").cast("long").alias("n_links")]
    return worded.select(*columns).unionByName(wordless.select(*columns))


def _texts(docs: DataFrame) -> DataFrame:
    """found_id, found_hash, text; rows without a doc_id once for each text."""
    rows = hashed_texts(docs).select(F.col("doc_id").alias("found_id"), F.col("text_hash").alias("found_hash"), "text")
    return rows.filter("found_id is not null").unionByName(rows.filter("found_id is null").dropDuplicates(["found_hash"]))


def _same_text(members: DataFrame) -> Column:
    return members["text_id"].eqNullSafe(F.col("found_id")) & (members["text_hash"] == F.col("found_hash"))


def keep_class_heads(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of *docs*, with all their columns, that head their class of near duplicates."""
    heads = near_duplicates(docs, threshold).filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("tm_head")).distinct()
    return docs.join(heads, docs["doc_id"].cast("long").eqNullSafe(heads["tm_head"]), "left_semi").select(*docs.columns)


def op8_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
