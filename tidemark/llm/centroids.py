r"""Centroid clustering with Drake's adaptive bounds.

Every vector keeps, from round to round, its cluster, an upper bound of the distance
to that cluster's centroid, a lower bound for each of its next nearest centroids and
one remainder bound for all others.  When centroids move, the bounds move with them;
a vector whose upper bound stays below every lower bound keeps its cluster unread.
Otherwise its own distance is made exact; then, if it is below the remainder bound, only
the listed centroids are measured, else all.  Every comparison that bounds decide
leaves ``MARGIN``, so ties and rounding always end in an exact scan on integers: the
clusters are those of plain Lloyd rounds.  The number of listed bounds follows the
rank that the last round needed (:func:`next_listed`).

A round is one pass over the state table: the new state is written to the shared folder and
the earlier one removed after it, sums are combined in the tasks, and the driver gets one row a
cluster.  Centroids (K times DIMS integers) travel with the tasks.

Defined cases: a vector that is null, of another length, or holds a null, NaN or infinity is left out;
integers saturate at 2 ** 27 on both sides, so that squared distances fit a long; a null vec_id hashes as
the empty text; of equal hashes (repeated vec_ids) the smaller vector comes first; with fewer than K vectors
each starts a centroid; a centroid that loses all vectors stays where it is; an empty table gives an
empty result; other columns are unread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, table

K, DIMS, ROUNDS, SCALE, SEED = 40, 64, 5, 256, 2
#: Integers saturate here: 64 * (2 * LIMIT) ** 2 is below 2 ** 63.
LIMIT = 2**27
#: What a bound has to leave, relative and absolute; bounds are doubles, distances integers.
MARGIN = 1e-9

STATE_DDL = "vec_id long, vector binary, cluster int, upper double, listed array<int>, lower array<double>, rest double, needed int"
STATE = pa.schema(
    [("vec_id", pa.int64()), ("vector", pa.binary()), ("cluster", pa.int32()), ("upper", pa.float64()), ("listed", pa.list_(pa.int32())), ("lower", pa.list_(pa.float64())), ("rest", pa.float64()), ("needed", pa.int32())]
)


def quantized(embeddings: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id, vector: the kept vectors, as little-endian 64-bit integers floor(scale * x)."""
    x = F.col("embedding").cast("array<double>")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    kept = embeddings.select(F.col("vec_id").cast("long"), x.alias("x")).filter(F.col("x").isNotNull() & (F.size(x) == dims)).filter(whole)
    schema = pa.schema([("vec_id", pa.int64()), ("vector", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            with np.errstate(over="ignore"):
                ints = np.clip(np.floor(flat * scale), -LIMIT, LIMIT).astype("<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([row.tobytes() for row in ints], pa.binary())], schema=schema)

    return kept.select("vec_id", F.col("x").alias("vector")).mapInArrow(run, "vec_id long, vector binary")


def first_centroids(vectors: DataFrame, k: int, dims: int, seed: int) -> np.ndarray:
    """The *k* vectors with the smallest hashes, in their order; tasks keep *k* rows each."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = vectors.select(key.alias("hash"), "vector").orderBy("hash", F.hex("vector")).limit(k).collect()
    return np.array([np.frombuffer(r.vector, "<i8") for r in rows], np.int64).reshape(len(rows), dims)


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of each vector (n, dims) to its own centroids (n, m, dims)."""
    d = vectors[:, None, :] - centroids
    return np.einsum("nmd,nmd->nm", d, d)


def _below(upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    return upper * (1 + MARGIN) + MARGIN < lower * (1 - MARGIN) - MARGIN


def next_listed(k: int, needed: int) -> int:
    """How many bounds a vector lists next: as many as the last round needed, at least an eighth of the centroids."""
    return max(1, -(-k // 8), min(needed, k - 2))


def scanned(vectors: np.ndarray, centroids: np.ndarray, listed: int) -> tuple[np.ndarray, ...]:
    """cluster, upper, ids, lower, rest of vectors measured against all *centroids*; ties go to the smaller number."""
    k = len(centroids)
    d = np.empty((len(vectors), k), np.int64)
    for at in range(0, len(vectors), 512):
        d[at : at + 512] = squared(vectors[at : at + 512], centroids[None])
    order = np.argsort(d, axis=1, kind="stable")
    near = np.sqrt(np.take_along_axis(d, order, axis=1).astype(np.float64))
    rest = near[:, listed + 1] if k > listed + 1 else np.full(len(d), np.inf)
    return order[:, 0].astype(np.int32), near[:, 0], order[:, 1 : listed + 1].astype(np.int32), near[:, 1 : listed + 1], rest


def moved_on(
    vectors: np.ndarray, cluster: np.ndarray, upper: np.ndarray, ids: np.ndarray, lower: np.ndarray, rest: np.ndarray,
    centroids: np.ndarray, moves: np.ndarray, listed: int,
) -> tuple[np.ndarray, ...]:
    """The state after the centroids have moved by *moves*: cluster, upper, ids, lower, rest, needed (the rank that was read)."""
    far = float(moves.max(initial=0.0))
    cluster, upper, needed = cluster.copy(), upper + moves[cluster], np.zeros(len(cluster), np.int32)
    ids, lower, rest = ids[:, :listed].copy(), lower - moves[ids], rest - far
    if lower.shape[1] > listed:  # what is listed no longer joins the remainder
        rest = np.minimum(rest, lower[:, listed:].min(axis=1))
        lower = lower[:, :listed]
    least = np.minimum(lower.min(axis=1, initial=np.inf), rest)
    open_ = np.flatnonzero(~_below(upper, least))
    exact = np.empty(len(open_))
    for at in range(0, len(open_), 4096):
        part = open_[at : at + 4096]
        exact[at : at + 4096] = np.sqrt(squared(vectors[part], centroids[cluster[part]][:, None])[:, 0].astype(np.float64))
    upper[open_] = exact
    open_ = open_[~_below(upper[open_], least[open_])]
    few = _below(upper[open_], rest[open_])
    some, all_ = open_[few], open_[~few]
    if ids.shape[1] < listed:  # more bounds are wanted than this state holds
        all_, some = open_, open_[:0]
        wide = listed - ids.shape[1]
        ids = np.pad(ids, ((0, 0), (0, wide)), constant_values=-1)
        lower = np.pad(lower, ((0, 0), (0, wide)), constant_values=np.inf)
    for at in range(0, len(some), 512):
        part = some[at : at + 512]
        choice = np.concatenate([cluster[part][:, None], ids[part]], axis=1)
        d = np.where(choice >= 0, squared(vectors[part], centroids[np.maximum(choice, 0)]), np.iinfo(np.int64).max)
        by = np.lexsort((np.where(choice >= 0, choice, len(centroids)), d), axis=1)
        choice, d = np.take_along_axis(choice, by, axis=1), np.take_along_axis(d, by, axis=1)
        near = np.where(choice >= 0, np.sqrt(d.astype(np.float64)), np.inf)
        needed[part] = (lower[part] <= upper[part][:, None] * (1 + MARGIN) + MARGIN).sum(axis=1)
        cluster[part], upper[part], ids[part], lower[part] = choice[:, 0], near[:, 0], choice[:, 1:], near[:, 1:]
    if len(all_):
        cluster[all_], upper[all_], ids[all_], lower[all_], rest[all_] = scanned(vectors[all_], centroids, listed)
        needed[all_] = listed
    return cluster, upper, ids, lower, rest, needed


def assigned(vectors: DataFrame, centroids: np.ndarray, listed: int) -> DataFrame:
    """The first state: every vector against every centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cluster, upper, ids, lower, rest = scanned(_ints(batch.column(1), centroids.shape[1]), centroids, listed)
                yield _state(batch, cluster, upper, ids, lower, rest, np.full(len(cluster), listed, np.int32))

    return vectors.mapInArrow(run, STATE_DDL)


def reassigned(state: DataFrame, centroids: np.ndarray, moves: np.ndarray, listed: int) -> DataFrame:
    """The next state, by bounds where they certify the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids = _rows(batch.column(4), np.int32, batch.num_rows)
                held = [batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3)]
                lower = _rows(batch.column(5), np.float64, batch.num_rows)
                now = moved_on(_ints(batch.column(1), centroids.shape[1]), *held, ids, lower, batch.column(6).to_numpy(zero_copy_only=False), centroids, moves, listed)
                yield _state(batch, *now)

    return state.mapInArrow(run, STATE_DDL)


def _ints(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, dims)


def _rows(column: pa.Array, kind: type, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(n, -1)


def _state(batch: pa.RecordBatch, cluster, upper, ids, lower, rest, needed) -> pa.RecordBatch:
    starts = pa.array(np.arange(len(cluster) + 1, dtype=np.int32) * ids.shape[1])
    lists = [pa.ListArray.from_arrays(starts, pa.array(np.ascontiguousarray(x).ravel(), t)) for x, t in ((ids, pa.int32()), (lower, pa.float64()))]
    return pa.RecordBatch.from_arrays(
        [batch.column(0), batch.column(1), pa.array(cluster, pa.int32()), pa.array(upper, pa.float64()), *lists, pa.array(rest, pa.float64()), pa.array(needed, pa.int32())], schema=STATE
    )


def sums(state: DataFrame, dims: int) -> DataFrame:
    """cluster, n, sums (decimals), needed: one row a cluster; tasks send one row a cluster each."""
    schema = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("parts", pa.list_(pa.string())), ("needed", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, cluster, needed = _ints(batch.column(1), dims), batch.column(0).to_numpy(), int(batch.column(2).to_numpy().max())
            for c in np.unique(cluster):
                own = vectors[cluster == c]  # a batch of arrow rows, so its sums fit 64 bits
                held = total.setdefault(int(c), [0, [0] * dims, 0])
                held[0] += len(own)
                held[1] = [a + b for a, b in zip(held[1], own.sum(axis=0).tolist())]
                held[2] = max(held[2], needed)
        if total:
            rows = [(c, n, list(map(str, s)), m) for c, (n, s, m) in total.items()]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    parts = state.select("cluster", "vector", "needed").mapInArrow(run, "cluster int, n long, parts array<string>, needed int")
    each = [F.sum(F.col("parts")[i].cast("decimal(38,0)")).cast("string") for i in range(dims)]
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*each).alias("sums"), F.max("needed").alias("needed"))


def clustered(embeddings: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, seed: int = SEED, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 after *rounds* of means and a last assignment."""
    spark = embeddings.sparkSession
    vectors = materialize(quantized(embeddings, dims, scale), "cluster-vectors")
    centroids = first_centroids(vectors, k, dims, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    listed = max(1, min(len(centroids) // 4, len(centroids) - 2))
    state = materialize(assigned(vectors, centroids, listed), "cluster-state")
    discard(vectors)
    for _ in range(rounds):
        means, needed = centroids.copy(), 0
        for r in sums(state, dims).collect():  # one row a cluster
            means[r.cluster] = [int(s) // r.n for s in r.sums]
            needed = max(needed, r.needed)
        moves = np.sqrt(((means - centroids) ** 2).sum(axis=1).astype(np.float64)) * (1 + MARGIN)
        centroids, listed, before = means, next_listed(len(centroids), needed), state
        state = materialize(reassigned(before, centroids, moves, listed), "cluster-state")
        discard(before)
    return _reported(state, centroids)


def _reported(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = _ints(batch.column(1), centroids.shape[1]) - centroids[batch.column(2).to_numpy()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array((d * d).sum(axis=1), pa.int64())], schema=schema)

    measured = state.select("vec_id", "vector", "cluster").mapInArrow(run, "vec_id long, cluster int, distance long")
    digests = [(c, hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest()) for c, row in enumerate(centroids)]
    own = measured.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    table_ = own.join(state.sparkSession.createDataFrame(digests, "cluster int, centroid_sha256 string"), "cluster").collect()  # one row a cluster
    inertia = sum(r.cluster_inertia for r in table_)
    rows = [(r.cluster, r.cluster_inertia, inertia, r.centroid_sha256) for r in table_]
    per = state.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return measured.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_drake_clusters(spark, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"))


def _sql(k: int = K, rounds: int = ROUNDS, dims: int = DIMS) -> str:
    """Plain Lloyd rounds, one after the other."""
    steps = [
        f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS vec FROM embeddings
  WHERE len(embedding) = {dims} AND list_count(embedding) = {dims} AND len(list_filter(embedding, lambda x: isfinite(x))) = {dims})""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS cluster, vec FROM
  (SELECT vec, sha256('{SEED}:' || vec_id::VARCHAR) AS h FROM v ORDER BY h LIMIT {k}))""",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (SELECT vec_id, any_value(vec) AS vec, min({{'d': d, 'c': cluster}}) AS best FROM
  (SELECT v.vec_id, v.vec, c{r}.cluster, list_sum(list_transform(list_zip(v.vec, c{r}.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{r}) GROUP BY vec_id)"""
        )
        if r < rounds:
            steps.append(
                f"""m{r} AS MATERIALIZED (SELECT cluster, list(mean ORDER BY i) AS vec FROM
  (SELECT cluster, i, (s - ((s % n) + n) % n) // n AS mean FROM
    (SELECT best.c AS cluster, i, sum(vec[i])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, {dims + 1}) t(i) GROUP BY ALL)) GROUP BY cluster),
c{r + 1} AS MATERIALIZED (SELECT c{r}.cluster, coalesce(m{r}.vec, c{r}.vec) AS vec FROM c{r} LEFT JOIN m{r} USING (cluster))"""
            )
    last = rounds
    return (
        "WITH "
        + ",\n".join(steps)
        + f"""
SELECT a.vec_id, a.best.c::INTEGER AS cluster, a.best.d AS distance, sum(a.best.d) OVER (PARTITION BY a.best.c)::BIGINT AS cluster_inertia,
  sum(a.best.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.vec, ',')) AS centroid_sha256
FROM a{last} a JOIN c{last} c ON c.cluster = a.best.c"""
    )


OP12_SQL = _sql()
