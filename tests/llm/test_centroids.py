import hashlib
import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import centroids as m

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, upper string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], SCHEMA)


def lloyd(rows, k, rounds, dims):
    """(vec_id, cluster, distance, cluster_inertia, inertia, sha256) by plain integers."""
    kept = [(i, tuple(max(-m.LIMIT, min(m.LIMIT, math.floor(256 * x))) for x in v)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    text = lambda i: "" if i is None else str(i)
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{text(r[0])}".encode()).hexdigest(), np.array(r[1], "<i8").tobytes().hex()))
    centers = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centers))
    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(near(v)[1], []).append(v)
        centers = [tuple(sum(x) // len(own[j]) for x in zip(*own[j])) if j in own else c for j, c in enumerate(centers)]
    best = [(i, *near(v)) for i, v in kept]
    by = {}
    for _, d, j in best:
        by[j] = by.get(j, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i, j, d, by[j], sum(by.values()), digest[j]) for i, d, j in best), key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def blobs(n, dims, seed, spread=0.15):
    rng = random.Random(seed)
    heads = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(7)]
    return [(i, [x + rng.gauss(0, spread) for x in heads[rng.randrange(7)]]) for i in range(n)]


def test_equals_plain_rounds(spark):
    rows = blobs(500, 64, 1)
    assert found(m.clustered(frame(spark, rows).repartition(3))) == lloyd(rows, 40, 5, 64)


def test_ties_on_a_small_grid_and_a_third_of_copies(spark):
    rng = random.Random(3)
    rows = [(i, [rng.randrange(-2, 3) / 256 for _ in range(4)]) for i in range(300)] + [(1000 + i, [1 / 256] * 4) for i in range(150)]
    assert found(m.clustered(frame(spark, rows), k=12, dims=4)) == lloyd(rows, 12, 5, 4)


def test_awkward_rows(spark):
    good = [0.5, -0.25, 1.0]
    rows = [(1, good), (1, good), (1, [0.0, 0.0, 0.1]), (None, [3.0, 2.0, 1.0]), (2, None), (3, []), (4, [1.0, 2.0]), (5, [1.0, None, 2.0]), (6, [float("nan"), 0.0, 0.0]),
            (7, [float("inf"), 0.0, 0.0]), (8, [1e300, -1e300, 0.0]), (9, [-0.001, 0.001, -0.0])]
    for k in (1, 2, 3, 40):
        assert found(m.clustered(frame(spark, rows), k=k, dims=3)) == lloyd(rows, k, 5, 3)
    assert m.clustered(frame(spark, [])).collect() == []
    assert m.clustered(frame(spark, [(1, None)])).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 12), st.integers(1, 6))
def test_bounds_certify_what_a_scan_gives(seed, k, spread):
    """Rounds with random moves: the cluster is that of a full scan each time, and no bound is above the truth."""
    rng = np.random.default_rng(seed)
    vectors = rng.integers(-spread, spread + 1, (60, 3))
    centers = rng.integers(-spread, spread + 1, (k, 3))
    listed = max(1, min(k // 4, k - 2))
    state = m.scanned(vectors, centers, listed)
    for _ in range(4):
        after = centers + rng.integers(-1, 2, centers.shape)
        moves = np.sqrt(((after - centers) ** 2).sum(axis=1).astype(float)) * (1 + m.MARGIN)
        centers, listed = after, m.next_listed(k, int(rng.integers(0, k + 1)))
        *state, needed = m.moved_on(vectors, *state, centers, moves, listed)
        d = np.sqrt(((vectors[:, None] - centers[None]) ** 2).sum(axis=2).astype(float))
        cluster, upper, ids, lower, rest = state
        assert (cluster == m.scanned(vectors, centers, 1)[0]).all()
        assert (upper >= d[np.arange(60), cluster] - 1e-6).all()
        for i in range(60):
            listed_now = [c for c in ids[i] if c >= 0]
            assert all(low <= d[i, c] + 1e-6 for c, low in zip(ids[i], lower[i]) if c >= 0)
            others = [c for c in range(k) if c != cluster[i] and c not in listed_now]
            assert all(rest[i] <= d[i, c] + 1e-6 for c in others)


def test_bounds_spare_most_measurements():
    """Clear blobs: once centroids rest, no vector is measured again."""
    vectors = np.array([[round(256 * x) for x in v] for _, v in blobs(400, 8, 5, 0.02)])
    centers = vectors[:7].copy()
    state = m.scanned(vectors, centers, 2)
    *_, needed = m.moved_on(vectors, *state, centers, np.zeros(7), 2)
    settled = np.unique(vectors[:7], axis=0).shape[0] == 7
    assert not settled or (needed > 0).mean() < 0.5
