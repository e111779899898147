r"""Near-duplicate components by circulant MinHash and exact Jaccard verification.

1. Each text becomes the set of its distinct 2-word shingles; equal sets are one *member*.
2. Two permutations make a whole signature: ``sigma`` scatters the shingles over a circle of
   ``CIRCLE`` places, and coordinate k is the least value of ``pi`` at the places shifted by k.
   The values of all shifts of a place are neighbours in one table, so a signature costs one
   gather and one minimum a shingle.  Coordinates k, k + bands, ... make up a band;
   band and row counts follow from the threshold and the target recall.
3. A bucket's members are first held against one *pivot*, the member with the most company over
   all its buckets; each member is verified on full sets against its likeliest pivot only.  That
   settles a group of copies of one original in rows proportional to its members.
4. Buckets that still hold several components are searched in cells, by one bit of every coordinate;
   members with a likely partner in another component are verified on full sets against the members
   of other components, in cells of two blocks.
5. The components of all verified links are the result.

No pair that shares a bucket is left out: after step 4 both are in one component, or were
verified, or their estimate was ``SLACK`` deviations below the threshold.  A pair at the
threshold shares no bucket with a chance of 1 - RECALL.

Defined cases: null texts and texts without words have an empty set and are linked to none; a
text of one word has that word as its one shingle; repeated rows are copies; component_id is
null only where no document of the component has a doc_id, and ``kept`` compares it null-safely; other columns are unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, skew_join, slices, table
from .graph import components
from .ngram_join import (
    _mixed, _same_text, _texts, both_ways, choose_bands, dealt_over_cells, hashed_texts, least_estimate, overlaps, roots, set_key, streamed_cells,
)

SHINGLE, THRESHOLD, RECALL = 2, 80, 0.9999
#: Places of the circle; larger sets than this only look more alike than they are.
CIRCLE = 1 << 20
MAX_HASHES = 420
#: Members of a pivot's task group, of a block of a bucket, and of a block of a component.
PIVOT_BLOCK, BUCKET_BLOCK, BLOCK = 512, 1024, 256
SEED = 17
#: Words of at most WORD_BYTES bytes a task remembers the hash of.
REMEMBERED, WORD_BYTES = 200_000, 48
_ODD = np.random.default_rng(SEED).integers(0, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Words:
    """Hashes of words; bounded, and of one task."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        known, out = self.known, []
        if len(known) > REMEMBERED:
            known.clear()
        for w in words:
            h = known.get(w)
            if h is None:
                h = xxhash.xxh64_intdigest(w)
                if len(w) <= WORD_BYTES:
                    known[w] = h
            out.append(h)
        return np.array(out, np.uint64)


def shingle_set(text: str, words: Words) -> np.ndarray:
    """The sorted 64-bit hashes of the distinct 2-word shingles; of the only word, if there is one."""
    w = words.hashes(text.encode().lower().split())  # both know ASCII letters and white space only
    if len(w) < SHINGLE:
        return _mixed(w * _ODD[2])
    return np.unique(_mixed(_mixed(w[:-1] * _ODD[0]) + w[1:] * _ODD[1]))


@lru_cache(1)
def permutations(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """sigma, and at each place the values of pi at its *hashes* shifts: a view of one table."""
    rng = np.random.default_rng(SEED + 1)
    sigma, pi = rng.permutation(CIRCLE).astype(np.uint32), rng.permutation(CIRCLE).astype(np.uint32)
    return sigma, np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: hashes - 1]]), hashes)


def signature(shingles: np.ndarray, hashes: int) -> np.ndarray:
    """All coordinates of the circulant MinHash of a set."""
    sigma, shifted = permutations(hashes)
    places = sigma[shingles & np.uint64(CIRCLE - 1)]
    least = np.full(hashes, CIRCLE, np.uint32)
    for at in range(0, len(places), 1024):
        np.minimum(least, shifted[places[at : at + 1024]].min(axis=0), out=least)
    return least


def banded(least: np.ndarray, bands: int, rows: int) -> tuple[list[int], bytes]:
    """The band hashes, and a bit of each coordinate."""
    folded = np.arange(bands, dtype=np.uint64) * _ODD[3]
    for r in range(rows):
        folded = _mixed(folded * _ODD[4] + least[r * bands : (r + 1) * bands])
    return folded.view(np.int64).tolist(), np.packbits((_mixed(least * _ODD[5]) & np.uint64(1)).astype(bool)).tobytes()


SIGNED = pa.schema(
    [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())]
)
SIGNED_DDL = "doc_id long, text_hash long, h1 long, h2 long, n long, bands array<long>, sketch binary"


def signed(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, text_hash, h1, h2 (the key of the set), n (its size), bands, sketch of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for part in slices(batch, 4_000_000):
                out = []
                for doc_id, text, text_hash in zip(*(c.to_pylist() for c in part.columns)):
                    s = shingle_set(text, words)
                    out.append((doc_id, text_hash, *set_key(s), len(s), *(banded(signature(s, bands * rows), bands, rows) if len(s) else ([], b""))))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), SIGNED)], schema=SIGNED)

    return hashed_texts(docs).mapInArrow(run, SIGNED_DDL)


# -- pivots -----------------------------------------------------------------------------


def likeliest_pivots(pairs: DataFrame, least: float, hashes: int) -> DataFrame:
    """(rep, pivot): of the pivots of each member (rep, sketch, pivot, pivot_sketch) the likeliest, if its estimate is *least* or more."""
    schema = pa.schema([("rep", pa.int64()), ("pivot", pa.int64()), ("agree", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (1, 3))
            agree = hashes - np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int32)
            near = pa.array(agree >= least * hashes - 1e-3)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(agree, pa.int32())], schema=schema).filter(near)

    met = pairs.select("rep", "sketch", "pivot", "pivot_sketch").mapInArrow(run, "rep long, pivot long, agree int")
    best = met.groupBy("rep").agg(F.max(F.struct("agree", "pivot")).alias("x"))
    return best.select("rep", F.col("x.pivot").alias("pivot"))


def linked_to_pivot(rows: DataFrame) -> DataFrame:
    """(rep, root) of the verified links of members to their pivots.

    *rows*: pivot, salt, rep, text, and is_pivot for the pivot's own row of each salt, which comes first;
    members pass by one after the other.
    """
    schema = pa.schema([("rep", pa.int64()), ("root", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, now, own = Words(), None, np.array([], np.uint64)
        for batch in batches:
            for part in slices(batch, 4_000_000):
                out = []
                for pivot, salt, is_pivot, rep, text in zip(*(c.to_pylist() for c in part.columns)):
                    s = shingle_set(text, words)
                    if is_pivot:
                        now, own = (pivot, salt), s
                    elif (pivot, salt) == now and alike(s, own):
                        out.append((rep, pivot))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

    dealt = rows.select("pivot", "salt", "is_pivot", "rep", "text").repartition("pivot", "salt")
    return dealt.sortWithinPartitions("pivot", "salt", F.desc("is_pivot")).mapInArrow(run, "rep long, root long")


def alike(a: np.ndarray, b: np.ndarray, threshold: int = THRESHOLD) -> bool:
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return False
    at = np.searchsorted(b, a)
    common = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * common >= threshold * (len(a) + len(b) - common)


# -- what pivots leave ---------------------------------------------------------------------


def met_across(cells: DataFrame, least: float, hashes: int) -> DataFrame:
    """(rep, root): a forest of the likely pairs of different components in each cell (bucket, ci, cj, block, rep, label, sketch)."""
    schema = pa.schema([("rep", pa.int64()), ("root", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, ci, cj), rows in streamed_cells(batches, 3):
            blocks, reps, labels, sketches = zip(*sorted(set(rows)))
            bits = np.unpackbits(np.frombuffer(b"".join(sketches), np.uint8).reshape(len(reps), -1), axis=1, count=hashes)
            signs, label = bits.astype(np.float32) * 2 - 1, np.array(labels)
            cut = len(reps) if ci == cj else blocks.count(ci)
            second = 0 if ci == cj else cut
            hit = ((signs[:cut] @ signs[second:].T + hashes) / 2 >= least * hashes - 1e-3) & (label[:cut, None] != label[None, second:])
            root = roots(hit if ci == cj else both_ways(hit))
            out = [(reps[i], reps[r]) for i, r in enumerate(root) if i != r]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

    keys = ["bucket", "ci", "cj"]
    dealt = cells.select(*keys, "block", "rep", "label", "sketch").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "rep long, root long")


def linked_across(cells: DataFrame) -> DataFrame:
    """(rep, root): a forest of the verified links of each cell (comp, ci, cj, block, rep, label, text); pairs of one label need none."""
    schema = pa.schema([("rep", pa.int64()), ("root", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for (_, ci, cj), rows in streamed_cells(batches, 3):
            blocks, reps, labels, texts = zip(*sorted(rows))
            if len(set(labels)) < 2 or (ci != cj and len(set(blocks)) < 2):
                continue
            sets, label = [shingle_set(t, words) for t in texts], np.array(labels)
            cut = len(reps) if ci == cj else blocks.count(ci)
            second = 0 if ci == cj else cut
            common = overlaps(sets[:cut], sets[second:]).astype(np.int64)
            n = np.array([len(s) for s in sets])
            hit = (100 * common >= THRESHOLD * (n[:cut, None] + n[None, second:] - common)) & (label[:cut, None] != label[None, second:])
            root = roots(hit if ci == cj else both_ways(hit))
            out = [(reps[i], reps[r]) for i, r in enumerate(root) if i != r]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

    keys = ["comp", "ci", "cj"]
    dealt = cells.select(*keys, "block", "rep", "label", "text").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "rep long, root long")


def _labelled(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """*rows* (rep, ...) with label, the smallest member of their component."""
    labels = components(edges, "rep", "root").select(F.col("node").alias("rep"), "label")
    return rows.join(labels.hint("merge"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))


def near_components(docs: DataFrame, recall: float = RECALL, block: int = BLOCK, bucket_block: int = BUCKET_BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id of the component), kept."""
    bands, rows = choose_bands(THRESHOLD / 100, recall, MAX_HASHES)
    hashes = bands * rows
    least = least_estimate(THRESHOLD / 100, hashes)
    all_ = materialize(signed(docs, bands, rows).withColumn("row_id", F.monotonically_increasing_id()), "circulant-signed")
    grouped = all_.filter("n > 0").groupBy("h1", "h2").agg(
        F.min(F.struct("row_id", "doc_id", "text_hash")).alias("one"), F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")
    )
    members = materialize(
        grouped.select("h1", "h2", F.col("one.row_id").alias("rep"), F.col("one.doc_id").alias("text_id"), F.col("one.text_hash").alias("text_hash"), "doc_id", "bands", "sketch"),
        "circulant-members",
    )
    buckets = members.select("rep", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sharing = materialize(buckets.join(shared.hint("merge"), "bucket"), "circulant-sharing")
    sketches = members.select("rep", "sketch")

    company = sharing.groupBy("rep").agg(F.sum("n").alias("company"))
    texts = members.select("rep", "text_id", "text_hash").join(company.hint("merge"), "rep")
    texts = texts.join(_texts(docs).hint("merge"), _same_text(texts)).dropDuplicates(["rep"]).select("rep", "text")  # a row of the table may be repeated
    texts = materialize(texts, "circulant-texts")

    pivots = sharing.join(company.hint("merge"), "rep").groupBy("bucket").agg(F.max(F.struct("company", "rep")).alias("x")).select("bucket", F.col("x.rep").alias("pivot"))
    pairs = sharing.join(pivots.hint("merge"), "bucket").filter("rep <> pivot").select("rep", "pivot").distinct()
    pairs = pairs.join(sketches.hint("merge"), "rep").join(sketches.select(F.col("rep").alias("pivot"), F.col("sketch").alias("pivot_sketch")).hint("merge"), "pivot")
    chosen = materialize(likeliest_pivots(pairs, least, hashes), "circulant-pivots")
    sizes = chosen.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / PIVOT_BLOCK).cast("long").alias("salts"))
    heads = sizes.select("pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(True).alias("is_pivot"), F.col("pivot").alias("rep"))
    others = chosen.join(sizes.hint("merge"), "pivot").select("pivot", F.pmod(F.xxhash64("rep"), "salts").alias("salt"), F.lit(False).alias("is_pivot"), "rep")
    direct = materialize(linked_to_pivot(heads.unionByName(others).join(texts.hint("merge"), "rep")), "circulant-direct")

    labelled = materialize(_labelled(sharing, direct), "circulant-labelled")
    open_ = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("bucket")
    left = labelled.join(open_.hint("merge"), "bucket").join(sketches.hint("merge"), "rep")
    likely = materialize(met_across(dealt_over_cells(left, "n", bucket_block), least, hashes), "circulant-likely")
    loose = components(likely, "rep", "root").select(F.col("node").alias("rep"), F.col("label").alias("comp"))
    loose = materialize(loose.join(labelled.select("rep", "label").distinct().hint("merge"), "rep"), "circulant-loose")
    counts = loose.groupBy("comp").agg(F.count(F.lit(1)).alias("n"))
    cells = dealt_over_cells(skew_join(loose, counts, "comp").join(texts.hint("merge"), "rep"), "n", block)
    across = materialize(linked_across(cells), "circulant-across")
    for spent in (sharing, texts, chosen, labelled, likely, loose):
        discard(spent)

    classed = _labelled(members.select("rep", "h1", "h2", "doc_id"), direct.unionByName(across))
    classed = materialize(classed, "circulant-classed")
    heads = classed.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    by_set = materialize(skew_join(classed.select("h1", "h2", "label"), heads, "label").drop("label"), "circulant-classes")
    worded = skew_join(all_.filter("n > 0").select("doc_id", "n", "h1", "h2"), by_set, "h1", "h2").select("doc_id", "n", "component_id")
    every = worded.unionByName(all_.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return every.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op11_circulant_minhash(spark, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))


#: All pairs that share a shingle, then components by repeated minima; doc_ids are unique there.
OP11_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, unnest(CASE WHEN len(words) < 2 THEN words ELSE list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) END) AS shingle FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
numbered AS MATERIALIZED (SELECT s.doc_id, n.n, dense_rank() OVER (ORDER BY shingle) AS g FROM s JOIN n USING (doc_id)),
links AS MATERIALIZED (
  SELECT a.doc_id AS u, b.doc_id AS v FROM numbered a JOIN numbered b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reached(doc_id, low) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT l.u, r.low FROM reached r JOIN links l ON l.v = r.doc_id WHERE r.low < l.u)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(low) AS component_id FROM reached GROUP BY doc_id) c USING (doc_id)
"""
