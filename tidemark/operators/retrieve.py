"""Retrieval: nearest neighbours, budgets, and comparison of retrievers."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors of one block, item vectors of one share, and those multiplied at once.
BLOCK_QUERIES, SHARE_ITEMS, STEP = 1024, 50_000, 2048
#: Similarities are compared to nine places.
PLACES = 1_000_000_000


def nearest(queries: DataFrame, items: DataFrame, k: int, same_type: bool = False, block: int = BLOCK_QUERIES, share: int = SHARE_ITEMS) -> DataFrame:
    """query_id, item_id, similarity, rank: the k most similar items (id, vector[, type]) of each query (id, vector[, type]); ties go to the smaller item.

    Exact.  Queries are dealt into blocks of about *block* rows and items into shares of about *share*; a task
    holds one block and its best k, and multiplies it with the items of a share as they stream by, so its memory
    grows with neither table.  Nothing is broadcast.  An item is no neighbour of itself.
    """
    blocks, shares = (max(1, math.ceil(df.count() / n)) for df, n in ((queries, block), (items, share)))
    kind = (lambda: F.col("type").cast("string")) if same_type else (lambda: F.lit(""))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    q = queries.select(dealt(blocks).alias("b"), every(shares).alias("s"), "id", "vector", kind().alias("type"))
    i = items.select(every(blocks).alias("b"), dealt(shares).alias("s"), "id", "vector", kind().alias("type"))
    return _best(q, i, ["b", "s"], k)


def nearest_in_context(queries: DataFrame, items: DataFrame, k: int, block: int = BLOCK_QUERIES, share: int = SHARE_ITEMS) -> DataFrame:
    """query_id, item_id, similarity, rank: the k most similar items (id, vector, context) of each query's own context (id, vector, context).

    Both sides are partitioned by context, so a query meets no other context.  A large context is cut into
    shares of items and blocks of queries by its own size.
    """
    sizes = items.groupBy("context").agg(F.ceil(F.count(F.lit(1)) / share).cast("int").alias("shares"))
    asked = queries.groupBy("context").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    cut = sizes.join(asked, "context")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    dealt = lambda c: F.pmod(F.xxhash64("id"), F.col(c).cast("long")).cast("int")
    own = F.col("context").cast("string").alias("c")
    q = queries.join(cut, "context").select(own, dealt("blocks").alias("b"), every("shares").alias("s"), "id", "vector", F.lit("").alias("type"))
    i = items.join(cut, "context").select(own, every("blocks").alias("b"), dealt("shares").alias("s"), "id", "vector", F.lit("").alias("type"))
    return _best(q, i, ["c", "b", "s"], k)


def _best(queries: DataFrame, items: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The best *k* items a query over all groups of *keys*: sorted so that a group's queries come before its items, and these by their id."""
    kinds = [df.schema["id"].dataType.simpleString() for df in (queries, items)]
    none = [F.lit(None).cast(t) for t in kinds]
    vector = F.col("vector").cast("array<double>").alias("vector")
    q = queries.select(*keys, F.lit(0).alias("side"), F.col("id").alias("query_id"), none[1].alias("item_id"), "type", vector)
    i = items.select(*keys, F.lit(1).alias("side"), none[0].alias("query_id"), F.col("id").alias("item_id"), "type", vector)
    ordered = q.unionByName(i).repartition(*keys).sortWithinPartitions(*keys, "side", "item_id")
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, None
        for batch in batches:
            marks = list(zip(*(batch.column(c).to_pylist() for c in range(n + 1))))
            start = 0
            while start < len(marks):
                end = start + 1
                while end < len(marks) and marks[end] == marks[start]:
                    end += 1
                if marks[start][:n] != now:
                    if group is not None:
                        yield from group.found()
                    now, group = marks[start][:n], Held(k)
                part = batch.slice(start, end - start)
                ids, types, vectors = part.column(n + 1 + marks[start][n]), part.column(n + 3), part.column(n + 4)
                if marks[start][n] == 0:
                    group.ask(ids, types, vectors)
                else:
                    for at in range(0, part.num_rows, STEP):
                        group.meet(ids.slice(at, STEP), types.slice(at, STEP), vectors.slice(at, STEP))
                start = end
        if group is not None:
            yield from group.found()

    found = ordered.mapInArrow(run, f"query_id {kinds[0]}, item_id {kinds[1]}, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "item_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


class Held:
    """A block of queries with the best *k* items that have passed; of equal similarities the earlier item."""

    def __init__(self, k: int):
        self.k, self.parts, self.seen, self.matrix = k, [], 0, None

    def ask(self, ids: pa.Array, types: pa.Array, vectors: pa.Array) -> None:
        self.parts.append((ids, types, vectors))

    def _begin(self) -> None:
        self.ids, types, vectors = (pa.concat_arrays(p) for p in zip(*self.parts))
        sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
        self.matrix = unit_rows(vectors, max(1, int(np.nan_to_num(sizes.astype(float)).max(initial=0))))
        self.types, self.place = types.to_pylist(), {}
        for r, x in enumerate(self.ids.to_pylist()):
            self.place.setdefault(x, []).append(r)
        self.keys = np.empty((len(self.matrix), 0), np.int64)
        self.items, self.parts = np.empty((len(self.matrix), 0), object), []

    def meet(self, ids: pa.Array, types: pa.Array, vectors: pa.Array) -> None:
        if self.matrix is None:
            if not self.parts:
                return
            self._begin()
        self.kind = ids.type
        other, names = unit_rows(vectors, self.matrix.shape[1]), ids.to_pylist()
        near = np.rint((self.matrix @ other.T) * PLACES).astype(np.int64)
        at = self.seen + np.arange(len(names))
        keys = (near << np.int64(31)) + (np.int64(2**31 - 1) - at)  # one number: similarity, then who came first
        kinds = types.to_pylist()
        if set(kinds) != {""} or set(self.types) != {""}:
            code = {t: c for c, t in enumerate({*kinds, *self.types})}
            own, its = (np.array([code[t] for t in x]) for x in (self.types, kinds))
            keys[own[:, None] != its] = NOT
        for c, x in enumerate(names):
            for r in self.place.get(x, ()):
                keys[r, c] = NOT
        both = np.concatenate([self.keys, keys], axis=1)
        if both.shape[1] > self.k:
            best = np.argpartition(both, both.shape[1] - self.k, axis=1)[:, -self.k :]
        else:
            best = np.tile(np.arange(both.shape[1]), (len(both), 1))
        held, new = self.keys.shape[1], np.empty(len(names), object)
        new[:] = names
        kept = np.take_along_axis(self.items, np.minimum(best, max(held - 1, 0)), axis=1) if held else np.empty(best.shape, object)
        self.items = np.where(best < held, kept, new[np.maximum(best - held, 0)])
        self.keys = np.take_along_axis(both, best, axis=1)
        self.seen += len(names)

    def found(self) -> Iterator[pa.RecordBatch]:
        if self.matrix is not None and self.keys.size:
            r, c = np.nonzero(self.keys != NOT)
            values = (self.keys[r, c] >> np.int64(31)) / PLACES
            item_ids = pa.array(self.items[r, c].tolist(), self.kind)
            yield pa.RecordBatch.from_arrays([self.ids.take(pa.array(r)), item_ids, pa.array(values)], names=["query_id", "item_id", "similarity"])


NOT = np.iinfo(np.int64).min


def unit_rows(vectors: pa.Array, width: int) -> np.ndarray:
    """Unit vectors as a matrix of *width* columns: zeros for a null or a vector without length, and where one is shorter."""
    sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    if vectors.null_count == 0 and (sizes == width).all():
        matrix = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
        return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)
    matrix = np.zeros((len(vectors), width))
    for row, v in enumerate(vectors.to_pylist()):
        full = np.array(v or [0.0], float)
        size = np.sqrt((full * full).sum())
        if size > 0:
            matrix[row, : min(width, len(full))] = full[:width] / size
    return matrix


def chronological(hits: DataFrame, items: DataFrame, key: str, time: str) -> DataFrame:
    """Hits with their position in time within each query."""
    w = Window.partitionBy("query_id").orderBy(time, key)
    return hits.join(items, key).withColumn("position", F.row_number().over(w))


def budgeted_prefix(parts: DataFrame, group: str, order: list, chars: str, budget: int) -> DataFrame:
    """The ranked parts of each group until the next one would exceed the budget, with the running sum."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return parts.withColumn("total_chars", F.sum(chars).over(w)).filter(F.col("total_chars") <= budget)


def set_comparison(a: DataFrame, b: DataFrame) -> DataFrame:
    """query_id, both, only_a, only_b: sizes of the overlap and the differences of two result sets."""
    x = a.select("query_id", "item_id").distinct().withColumn("a", F.lit(1))
    y = b.select("query_id", "item_id").distinct().withColumn("b", F.lit(1))
    j = x.join(y, ["query_id", "item_id"], "full")
    return j.groupBy("query_id").agg(
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"),
        F.count_if(F.col("b").isNull()).alias("only_a"),
        F.count_if(F.col("a").isNull()).alias("only_b"),
    )


def merged(sources: list[DataFrame], k: int) -> DataFrame:
    """The union of result lists, an item from the first source that has it, the first k by source and rank."""
    out = None
    for i, s in enumerate(sources):
        part = s.select("query_id", "item_id", "rank", F.lit(i).alias("source"))
        out = part if out is None else out.unionByName(part)
    best = out.groupBy("query_id", "item_id").agg(F.min(F.struct("source", "rank")).alias("x")).select("query_id", "item_id", "x.source", "x.rank")
    w = Window.partitionBy("query_id").orderBy("source", "rank", "item_id")
    return best.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)


def sectioned(sections: list[tuple[str, DataFrame]]) -> DataFrame:
    """query_id, section, position, line: lists of lines (query_id, position, line) one section after the other, in the given order."""
    out = None
    for i, (title, rows) in enumerate(sections):
        part = rows.select("query_id", F.lit(i).alias("section_order"), F.lit(title).alias("section"), "position", "line")
        out = part if out is None else out.unionByName(part)
    return out


def precision(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """query_id, precision: the share of hits among the gold items."""
    g = gold.select("query_id", "item_id").distinct().withColumn("good", F.lit(1.0))
    return hits.join(g, ["query_id", "item_id"], "left").groupBy("query_id").agg(F.avg(F.coalesce("good", F.lit(0.0))).alias("precision"))


def coherence(hits: DataFrame, transitions: DataFrame, from_us: int, to_us: int) -> DataFrame:
    """query_id, coherence: the share of hits with a transition in a time range."""
    active = transitions.filter(F.col("us").between(from_us, to_us)).select(F.col("entity_id").alias("item_id")).distinct().withColumn("in_range", F.lit(1.0))
    return hits.join(active, "item_id", "left").groupBy("query_id").agg(F.avg(F.coalesce("in_range", F.lit(0.0))).alias("coherence"))


def stratified(rows: DataFrame, stratum: str, order: list, limit: int) -> DataFrame:
    """The first rows of each stratum, evenly, the remainder to the first strata by name; *limit* rows in all.

    The limit is the operator's purpose: it draws a sample.
    """
    strata = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    ranked = strata.withColumn("i", F.row_number().over(Window.orderBy(stratum)) - 1).withColumn("k", strata.agg(F.count(F.lit(1))).scalar())
    per = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col("k")))
    quota = ranked.select(stratum, (per + (F.col("i") < limit - per * F.col("k")).cast("long")).alias("quota"), "i")
    w = Window.partitionBy(stratum).orderBy(*order)
    numbered = rows.withColumn("position", F.row_number().over(w))
    return numbered.join(quota, stratum).filter(F.col("position") <= F.col("quota")).drop("quota", "i")
