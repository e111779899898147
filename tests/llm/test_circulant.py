import random
import re

import numpy as np

from tests.llm.data import AWKWARD, docs_frame, words
from tidemark.llm import circulant as m

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 2]) for i in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} if w else set()


def brute(rows):
    """[(doc_id, n_shingles, component_id, kept)] by all pairs of rows."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(d)
    least = {r: min((d for d in group if d is not None), default=None) for r, group in ids.items()}
    return sorted(((d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def found(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str)


def edited(base, k, rng):
    w = list(base)
    for _ in range(k):
        w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
    return " ".join(w)


def corpus():
    rng, rows, i = random.Random(4), list(AWKWARD), 100
    for g in range(14):
        base = words(rng.randrange(30, 400), g)
        for _ in range(rng.randrange(1, 9)):
            rows.append((i, edited(base, rng.randrange(0, 1 + len(base) // 15), rng)))
            i += 1
    star = words(200, 77)  # copies that are near the original and hardly near each other
    rows += [(i + k, edited(star, 10, rng)) for k in range(70)] + [(i + 70, " ".join(star))]
    chain = words(300, 78)  # each near the one before only
    for k in range(25):
        chain = edited(chain, 9, rng).split(" ")
        rows.append((2000 + k, " ".join(chain)))
    rows += [(3000 + k, " ".join(words(120, 1000 + k))) for k in range(60)]
    rows += [(9000, "one two three"), (9001, "One\ttwo  three"), (9002, "one two"), (9003, "one"), (9004, "ONE"), (9005, "één"), (9006, "ÉÉN")]
    return rows


def test_equals_all_pairs(spark):
    rows = corpus()
    expected = brute(rows)
    assert found(m.near_components(docs_frame(spark, rows, ("rep", "bands", "label")).repartition(5))) == expected
    assert len({c for _, _, c, _ in expected}) < len(rows) - 80


def test_blocks_and_cells_lose_no_link(spark):
    rows = corpus()
    assert found(m.near_components(docs_frame(spark, rows), block=8, bucket_block=8)) == brute(rows)


def test_nulls_repeats_long_texts_and_the_empty_table(spark):
    long_ = " ".join(words(60_000, 5))
    rows = [(None, None), (None, "a b c d"), (None, "A b c d"), (1, None), (1, "x y"), (1, "x y"), (2, ""), (3, long_), (4, long_ + " end"), (5, "y" * 300_000), (6, "y" * 300_000)]
    assert found(m.near_components(docs_frame(spark, rows))) == brute(rows)
    assert m.near_components(docs_frame(spark, [])).collect() == []


def test_the_threshold_is_met_exactly(spark):
    """4 of 5 shingles in common is a link, 79 of 99 none."""
    a = [f"w{i}" for i in range(91)]
    rows = [(1, "a b c d e"), (2, "a b c d e f"), (3, "p q"), (4, " ".join(a)), (5, " ".join(a[:80] + [f"v{i}" for i in range(11)]))]
    assert found(m.near_components(docs_frame(spark, rows))) == brute(rows)


def test_a_large_group_of_different_copies_is_one_component(spark):
    base = words(150, 9)
    rows = [(i, " ".join(base[: i % 150] + [f"c{i}"] + base[i % 150 + 1 :])) for i in range(3000)]
    got = found(m.near_components(docs_frame(spark, rows).repartition(4)))
    assert {c for _, _, c, _ in got} == {0} and sum(k for *_, k in got) == 1


def test_a_signature_is_the_circulant_minimum_of_two_permutations():
    rng = np.random.default_rng(1)
    s = np.unique(rng.integers(0, 2**63, 3000, dtype=np.uint64))
    sigma, shifted = m.permutations(408)
    pi = shifted[:, 0]
    places = sigma[s & np.uint64(m.CIRCLE - 1)].astype(np.int64)
    assert sorted(sigma) == sorted(pi) == list(range(m.CIRCLE))
    got = m.signature(s, 408)
    assert all(got[k] == pi[(places + k) % m.CIRCLE].min() for k in range(0, 408, 37))


def test_agreement_of_signatures_estimates_the_similarity():
    rng = np.random.default_rng(2)
    errors = []
    for _ in range(30):
        s = np.unique(rng.integers(0, 2**63, 900, dtype=np.uint64))
        a, b = s[:800], s[100:]
        errors.append((m.signature(a, 408) == m.signature(b, 408)).mean() - len(np.intersect1d(a, b)) / len(s))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05
