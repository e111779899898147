import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.data import AWKWARD, docs_frame, words
from tidemark.llm import ngram_join as m
from tidemark.llm.graph import components


def shingles(text):
    w = m._WORD.findall((text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows, threshold=0.8):
    """doc_id -> (class_id, class_size, n_links) by all pairs; doc_ids must be unique."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}
    links = dict.fromkeys(sets, 0)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and len(a & b) >= threshold * len(a | b):
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    size = {}
    for i in ids:
        size[find(i)] = size.get(find(i), 0) + 1
    return {i: (find(i), size[find(i)], links[i]) for i in ids}


def edited(base, k, rng):
    w = list(base)
    for _ in range(k):
        w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
    return " ".join(w)


def corpus():
    rng, rows, i = random.Random(2), [(i, t) for i, t in AWKWARD if i is not None and i != 6], 100
    for g in range(12):
        base = words(rng.randrange(60, 400), g)
        for _ in range(rng.randrange(1, 9)):
            rows.append((i, edited(base, rng.randrange(0, 8), rng)))
            i += 1
    base = words(150, 77)
    for _ in range(90):  # a large group of near copies
        rows.append((i, edited(base, rng.randrange(0, 4), rng)))
        i += 1
    rows += [(i + k, " ".join(words(120, 1000 + k))) for k in range(60)] + [(9000, "one two three"), (9001, "One, two three!"), (9002, "one two")]
    return rows


def got(df):
    return {r.doc_id: (r.class_id, r.class_size, r.n_links) for r in df.collect()}


def test_equals_all_pairs(spark):
    rows = corpus()
    assert got(m.near_duplicates(docs_frame(spark, rows, ("rep", "bands", "n")))) == brute(rows)


def test_blocks_and_cells_lose_no_link(spark):
    rows = corpus()
    assert got(m.near_duplicates(docs_frame(spark, rows), block=16)) == brute(rows)


def test_repeated_rows_nulls_and_empty_table(spark):
    text = " ".join(words(50, 1))
    rows = [(1, text), (1, text), (2, text), (None, text), (3, None), (3, ""), (None, None), (4, "other " + " ".join(words(50, 2)))]
    found = sorted(((r.doc_id, r.class_id, r.class_size, r.n_links) for r in m.near_duplicates(docs_frame(spark, rows)).collect()), key=str)
    want = [(1, 1, 4, 3), (1, 1, 4, 3), (2, 1, 4, 3), (None, 1, 4, 3), (3, 3, 1, 0), (3, 3, 1, 0), (None, None, 1, 0), (4, 4, 1, 0)]
    assert found == sorted(want, key=str)
    assert m.near_duplicates(docs_frame(spark, [])).collect() == []


def test_keep_class_heads(spark):
    rows = corpus()
    df = docs_frame(spark, rows, ("tm_head",))
    kept = m.keep_class_heads(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (c, _, _) in brute(rows).items() if i == c)


def test_bands_reach_the_recall():
    b, r = m.choose_bands()
    assert 1 - (1 - 0.8**r) ** b >= 0.9995 and b * r <= m.MAX_HASHES
    rng, banding, met = np.random.default_rng(0), m.Banding(b, r), 0
    for _ in range(200):
        base = rng.integers(0, 2**63, 450, dtype=np.uint64)
        x, y = np.unique(base[:405]), np.unique(base[45:])  # 360 of 450: exactly 0.8
        (bands_x, sketch_x), (bands_y, sketch_y) = banding.hashes(x), banding.hashes(y)
        met += bool(set(bands_x) & set(bands_y))
        equal = np.unpackbits(np.frombuffer(sketch_x, np.uint8) ^ np.frombuffer(sketch_y, np.uint8), count=b * r)
        assert 1 - equal.mean() >= m.least_estimate(0.8, b * r)
    assert met >= 198


@pytest.mark.parametrize("threshold", [0.9, 0.5, 0.1, 0.018, 0.005])
def test_any_threshold_reaches_the_recall(threshold):
    b, r = m.choose_bands(threshold)
    assert 1 - (1 - threshold**r) ** b >= 0.9995


@pytest.mark.parametrize("threshold, recall", [(0, 0.9), (-1, 0.9), (1.1, 0.9), (0.8, 1), (0.8, 0)])
def test_impossible_targets_are_refused(threshold, recall):
    with pytest.raises(ValueError):
        m.choose_bands(threshold, recall)


def test_near_copies_without_ids(spark):
    rng, base = random.Random(4), words(120, 5)
    rows = [(None, edited(base, k % 3, rng)) for k in range(60)] * 2 + [(5, " ".join(base))]
    found = m.near_duplicates(docs_frame(spark, rows)).collect()
    want = brute(list(enumerate(t for _, t in rows)))
    assert sorted((r.class_size, r.n_links) for r in found) == sorted((s, n) for _, s, n in want.values())
    assert {r.class_id for r in found if r.class_size > 1} == {5}


def test_looser_likeness_does_not_chain_candidates(spark):
    """A long chain of texts, each like the next one by half only, stays in small pieces."""
    vocabulary = [f"w{k}" for k in range(4000)]
    rows = [(i, " ".join(vocabulary[10 * i : 10 * i + 34])) for i in range(300)]
    b, r = m.choose_bands()
    signed = m.signatures(docs_frame(spark, rows), b, r).withColumn("rep", F.col("doc_id"))
    buckets = signed.select("rep", "sketch", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    loose = buckets.join(shared, "bucket")
    met = m.met(m.dealt_over_cells(loose, "n", 8), m.least_estimate(0.8, b * r), b * r).collect()
    assert loose.count() > 60 and len(met) < 5


def test_recall_and_precision_on_a_data_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert got(m.near_duplicates(df)) == brute(rows)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (300, 301), (301, 300)]
    df = spark.createDataFrame(edges, "a long, b long")
    found = {r.node: r.label for r in components(df).collect()}
    assert found == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100), 300: 300, 301: 300}
    assert components(df.limit(0)).collect() == []
