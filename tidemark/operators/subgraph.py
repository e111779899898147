"""Subgraph retrieval for many queries at once: seeds with fallbacks, one traversal keyed by query, best nodes with names.

Everything is keyed by query_id, so any number of queries is one plan.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import both_ways, settled
from .resolve import exact_matches, fuzzy_matches

MAX_SEEDS, VECTOR_LEAST, FUZZY_LEAST, FUZZY_EACH = 10, 0.7, 0.8, 2
#: Query vectors held by a task at once, and item vectors that it multiplies at once.
BLOCK, STEP = 512, 2048
SHARE_ROWS = 250_000


# -- vectors ------------------------------------------------------------------------------


def within(queries: DataFrame, items: DataFrame, least: float = VECTOR_LEAST, block: int = BLOCK, share_rows: int = SHARE_ROWS) -> DataFrame:
    """query_id, item_id, similarity: all items (id, vector) of cosine *least* or more to a query (id, vector).

    A range join: queries are dealt into blocks, items into shares of about *share_rows*; a task holds one block
    as a matrix and multiplies it with the items of a share as they stream by.  Only hits are made into rows.
    Vectors without length, null ones, or of another length than the block's first are similar to none.
    """
    blocks, shares = (max(1, math.ceil(df.count() / n)) for df, n in ((queries, block), (items, share_rows)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    vector = F.col("vector").cast("array<double>").alias("vector")
    q = queries.select(dealt(blocks).alias("b"), every(shares).alias("s"), F.lit(0).alias("side"), F.col("id").alias("query_id"), F.lit(None).cast(items.schema["id"].dataType).alias("item_id"), vector)
    i = items.select(every(blocks).alias("b"), dealt(shares).alias("s"), F.lit(1).alias("side"), F.lit(None).cast(queries.schema["id"].dataType).alias("query_id"), F.col("id").alias("item_id"), vector)
    rows = q.unionByName(i).filter("vector is not null and size(vector) > 0 and forall(vector, x -> x is not null)")
    ordered = rows.repartition("b", "s").sortWithinPartitions("b", "s", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, held = None, [], []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for start, end in zip(cuts, cuts[1:]):
                if start == end:
                    continue
                key, side = tuple(keys[start, :2]), keys[start, 2]
                if key != now:
                    now, ids, held = key, [], []
                part = batch.slice(start, end - start)
                if side == 0:
                    ids.append(part.column(3))
                    held.append(part.column(5))
                elif ids:
                    own = pa.concat_arrays(ids)
                    matrix, rows_ = unit(pa.concat_arrays(held))
                    ids, held = [own], [pa.concat_arrays(held)]
                    for at in range(0, part.num_rows, STEP):
                        some = part.slice(at, STEP)
                        other, kept = unit(some.column(5), matrix.shape[1])
                        near = np.round(matrix @ other.T, 9)
                        r, c = np.nonzero(near >= least)
                        yield pa.RecordBatch.from_arrays(
                            [own.take(pa.array(rows_[r])), some.column(4).take(pa.array(kept[c])), pa.array(near[r, c])], names=["query_id", "item_id", "similarity"]
                        )

    kinds = [df.schema["id"].dataType.simpleString() for df in (queries, items)]
    return ordered.mapInArrow(run, f"query_id {kinds[0]}, item_id {kinds[1]}, similarity double")


def unit(vectors: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of one length as a matrix, and the rows that they come from."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    width = width or int(sizes[0])
    rows = np.flatnonzero(sizes == width)
    taken = vectors if len(rows) == len(vectors) else vectors.take(pa.array(rows))
    matrix = taken.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    norms = np.sqrt((matrix * matrix).sum(axis=1))
    good = norms > 0
    return matrix[good] / norms[good, None], rows[good]


# -- seeds --------------------------------------------------------------------------------


def named_seeds(mentions: DataFrame, entities: DataFrame, least: float = FUZZY_LEAST, each: int = FUZZY_EACH) -> DataFrame:
    """query_id, entity_id, score, source of the mentions (query_id, position, mention) of each query.

    An exact name scores 1; a mention without one takes its *each* best fuzzy matches at 0.95 of their score.
    Of several mentions for one entity an exact one wins, then the first.
    """
    asked = mentions.select("query_id", "position", "mention", F.struct("query_id", "position").alias("mention_id"))
    exact = exact_matches(asked, entities).select("mention_id", "entity_id", F.lit(1.0).alias("score"), F.lit("named").alias("source"))
    other = asked.join(exact.select("mention_id"), "mention_id", "left_anti")
    best = Window.partitionBy("mention_id").orderBy(F.desc("score"), "entity_id")
    near = fuzzy_matches(other, entities, least).withColumn("r", F.row_number().over(best)).filter(F.col("r") <= each)
    both = exact.unionByName(near.select("mention_id", "entity_id", (F.col("score") * 0.95).alias("score"), F.lit("named_fuzzy").alias("source")))
    first = F.min_by(F.struct("score", "source"), F.struct(F.when(F.col("source") == "named", 0).otherwise(1), F.col("mention_id.position"))).alias("x")
    return both.groupBy(F.col("mention_id.query_id").alias("query_id"), "entity_id").agg(first).select("query_id", "entity_id", "x.score", "x.source")


def with_fallbacks(queries: DataFrame, named: DataFrame, vector_hits: DataFrame, entities: DataFrame, quota: int = MAX_SEEDS) -> DataFrame:
    """query_id, entity_id, score, source, rank: the *quota* best seeds of each query (query_id, types).

    Named seeds come first, then vector hits (query_id, item_id, similarity), of the query's types where it names
    any.  What grows with the queries or entities is joined by shuffles, as broadcasts pass the driver.  Only a query with types and fewer than half its quota found so far is filled up: with the first
    *quota* entities (by importance, then id) of each of its types, at half their importance.  *entities*: entity_id, type,
    importance.  The first source of an entity holds.
    """
    typed = queries.select("query_id", F.coalesce("types", F.array().cast("array<string>")).alias("types"))
    hits = vector_hits.select("query_id", F.col("item_id").alias("entity_id"), F.col("similarity").alias("score")).join(typed.hint("merge"), "query_id")
    hits = hits.join(entities.select("entity_id", "type").hint("merge"), "entity_id").filter((F.size("types") == 0) | F.array_contains("types", F.col("type")))
    hits = hits.select("query_id", "entity_id", "score").join(named.select("query_id", "entity_id").hint("merge"), ["query_id", "entity_id"], "left_anti")
    found = settled(named.select("query_id", "entity_id", "score", "source").unionByName(hits.withColumn("source", F.lit("embedding"))))

    counts = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    poor = typed.join(counts.hint("merge"), "query_id", "left").filter(F.coalesce("n", F.lit(0)) < quota // 2)
    top = Window.partitionBy("type").orderBy(F.desc("importance"), "entity_id")
    asked = entities.join(poor.select(F.explode("types").alias("type")).distinct(), "type", "left_semi")
    firsts = asked.withColumn("r", F.row_number().over(top)).filter(F.col("r") <= quota)
    fill = poor.select("query_id", F.explode(F.array_distinct("types")).alias("type")).join(firsts, "type")
    fill = fill.join(found.select("query_id", "entity_id").hint("merge"), ["query_id", "entity_id"], "left_anti").select("query_id", "entity_id", (F.col("importance") * 0.5).alias("score"), F.lit("type_match").alias("source"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "entity_id")
    return found.unionByName(fill).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= quota)


# -- traversal ------------------------------------------------------------------------------


def explored(edges: DataFrame, seeds: DataFrame, queries: DataFrame, hops: int = 2, max_paths: int | None = 50) -> DataFrame:
    """query_id, nodes, types, score, hop: paths from each query's seeds (query_id, node, score) by its own rules.

    *queries*: query_id, pattern (direct: seeds only; transitive: edges of one type after the first; else all), wanted (types;
    others score 0.3; empty or null: all).  0.8 a hop.  Within a query each undirected edge is used once, by the
    first path in the order of (hop, score descending, nodes, types), and of those the first *max_paths* count, seeds included.
    All queries advance together; edges meet the frontier on the node, so a hub's edges move once a hop and not once a query.
    A path grows only by the first *max_paths* neighbours of its end in each type: those are alike but for the last node, so of
    each later one as many edges that are taken or come before it are at hand, and it can't count.
    """
    rules = queries.select("query_id", F.coalesce("pattern", F.lit("direct")).alias("pattern"), F.coalesce("wanted", F.array().cast("array<string>")).alias("wanted"))
    order = [F.desc("score"), "nodes", "types"]
    kind = edges.schema["src"].dataType.simpleString()

    def best(df: DataFrame, taken: DataFrame | None) -> DataFrame:
        if max_paths is None:
            return df
        numbered = df.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
        if taken is not None:
            numbered = numbered.join(taken, "query_id", "left").withColumn("r", F.col("r") + F.coalesce("taken", F.lit(0))).drop("taken")
        return numbered.filter(F.col("r") <= max_paths).drop("r")

    start = seeds.select("query_id", F.array("node").alias("nodes"), F.array().cast("array<string>").alias("types"), "score", F.lit(0).alias("hop"), F.lit(None).cast(f"struct<a:{kind},b:{kind}>").alias("edge"))
    paths = settled(best(start, None))
    sides = both_ways(edges)
    for h in range(1, hops + 1):
        frontier = paths.filter(F.col("hop") == h - 1).drop("hop", "edge").join(rules.filter("pattern <> 'direct'"), "query_id")
        ends = frontier.withColumn("node", F.element_at("nodes", -1))
        grown = ends.join(sides if max_paths is None else first_neighbours(sides, ends, max_paths), "node")
        grown = grown.filter((F.col("pattern") != "transitive") | (F.size("types") == 0) | (F.col("type") == F.try_element_at("types", F.lit(-1))))
        factor = F.when((F.size("wanted") == 0) | F.array_contains("wanted", F.col("type")), 1.0).otherwise(0.3)
        grown = grown.select(
            "query_id", F.concat("nodes", F.array("other")).alias("nodes"), F.concat("types", F.array("type")).alias("types"),
            (F.col("score") * 0.8 * factor).alias("score"), F.lit(h).alias("hop"), F.struct(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).alias("edge"),
        )
        if h > 1:
            grown = grown.join(paths.filter("edge is not null").select("query_id", "edge"), ["query_id", "edge"], "left_anti").select(paths.columns)
        first = F.min_by(F.struct("nodes", "types", "score"), F.struct((-F.col("score")).alias("s"), "nodes", "types")).alias("x")
        once = grown.groupBy("query_id", "edge").agg(first).select("query_id", "x.nodes", "x.types", "x.score", F.lit(h).alias("hop"), "edge")
        taken = paths.groupBy("query_id").agg(F.count(F.lit(1)).alias("taken")) if max_paths is not None else None
        paths = settled(paths.unionByName(best(once, taken)))
    return paths.select("query_id", "nodes", "types", "score", "hop")


def first_neighbours(sides: DataFrame, ends: DataFrame, n: int) -> DataFrame:
    """node, other, type: of the sides that start at one of *ends* (node), the first *n* different neighbours by node and type."""
    near = sides.join(ends.select("node").distinct(), "node", "left_semi")
    w = Window.partitionBy("node", "type").orderBy("other")
    return near.withColumn("r", F.dense_rank().over(w)).filter(F.col("r") <= n).select("node", "other", "type").distinct()


def retrieved(paths: DataFrame, top: int = 15, names: DataFrame | None = None) -> DataFrame:
    """query_id, node, score, source (seed, or hop_ and the number of its nearest path), rank[, name]: each query's *top* nodes by the best path through them."""
    at = paths.select("query_id", "score", F.posexplode("nodes").alias("i", "node"))
    nodes = at.groupBy("query_id", "node").agg(F.max("score").alias("score"), F.min("i").alias("hop"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "node")
    ranked = nodes.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    out = ranked.select("query_id", "node", "score", source_of("hop").alias("source"), "rank")
    return out if names is None else out.join(names.select("node", "name"), "node", "left")


def source_of(hop: str) -> Column:
    return F.when(F.col(hop) == 0, F.lit("seed")).otherwise(F.concat(F.lit("hop_"), F.col(hop).cast("string")))
