"""Graph operators over edges (src, dst, type): degrees, hops, scored paths, components."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Tasks over which the neighbours of one node are dealt while components are found.
SALTS = 8


def both_ways(edges: DataFrame) -> DataFrame:
    """node, other, type: every edge seen from both ends."""
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "type")
    return out.unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), "type"))


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree (a loop counts twice), neighbours (distinct, itself aside)."""
    other = F.when(F.col("other") != F.col("node"), F.col("other"))
    return both_ways(edges).groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.count_distinct(other).alias("neighbours"))


def within_hops(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """node, hop: the least number of edges from any seed, up to *hops*.

    Each round joins the newest ring only and drops nodes already reached, so a
    node enters once.
    """
    sides = both_ways(edges).select("node", "other").distinct()
    reached = seeds.select("node").distinct().withColumn("hop", F.lit(0))
    ring = reached
    for h in range(1, hops + 1):
        step = sides.join(ring.select("node"), "node").select(F.col("other").alias("node")).distinct()
        ring = step.join(reached, "node", "left_anti").withColumn("hop", F.lit(h))
        reached = reached.unionByName(ring)
    return reached


def scored_paths(edges: DataFrame, seeds: DataFrame, hops: int = 2, wanted_types: tuple[str, ...] = (), same_type: bool = False, max_paths: int | None = None) -> DataFrame:
    """nodes, types, score: paths from seeds (node, score), 0.8 per hop, 0.3 for a type that is not wanted.

    Every undirected edge is used once, by the first path in the order of (hop, score
    descending, nodes); the type rule holds before that.  All paths, or with *max_paths*
    the best of each hop (a beam), counted in the same order; paths of earlier hops come first.
    """
    best = lambda df: df if max_paths is None else df.limit(max_paths)
    key = F.concat_ws(" ", F.least("node", "other"), F.greatest("node", "other"))
    sides = both_ways(edges).withColumn("edge", key)
    frontier = seeds.select(F.array("node").alias("nodes"), F.array().cast("array<string>").alias("types"), "score", F.lit(0).alias("hop"))
    paths, used = frontier, None
    for h in range(1, hops + 1):
        ends = frontier.withColumn("node", F.element_at("nodes", -1))
        grown = ends.join(sides, "node")
        if same_type:
            grown = grown.filter((F.size("types") == 0) | (F.col("type") == F.try_element_at("types", F.lit(-1))))
        if used is not None:
            grown = grown.join(used, "edge", "left_anti")
        factor = F.when(F.col("type").isin(*wanted_types), 1.0).otherwise(0.3) if wanted_types else F.lit(1.0)
        grown = grown.select(
            "edge",
            F.concat("nodes", F.array("other")).alias("nodes"),
            F.concat("types", F.array("type")).alias("types"),
            (F.col("score") * 0.8 * factor).alias("score"),
        )
        first = Window.partitionBy("edge").orderBy(F.desc("score"), "nodes", "types")
        grown = grown.withColumn("r", F.row_number().over(first)).filter("r = 1").drop("r")
        grown = best(grown.orderBy(F.desc("score"), "nodes", "types")) if max_paths is not None else grown
        used = grown.select("edge") if used is None else used.unionByName(grown.select("edge"))
        frontier = grown.select("nodes", "types", "score", F.lit(h).alias("hop"))
        paths = paths.unionByName(frontier)
    return best(paths.orderBy("hop", F.desc("score"), "nodes", "types"))


def described(path: DataFrame, names: DataFrame) -> DataFrame:
    """nodes, types, score and text: "A --[type]--> B …", by the names (node, name) of the nodes, a node's own value where it has none."""
    at = path.select("nodes", "types", "score", F.posexplode("nodes").alias("i", "node")).join(names, "node", "left")
    step = F.struct("i", F.coalesce("name", F.col("node").cast("string")).alias("name"))
    grouped = at.groupBy("nodes", "types", "score").agg(F.array_sort(F.collect_list(step)).alias("steps"))  # a path has few nodes
    part = lambda s: F.when(s["i"] == 0, s["name"]).otherwise(F.concat(F.lit(" --["), F.try_element_at("types", s["i"]), F.lit("]--> "), s["name"]))
    return grouped.select("nodes", "types", "score", F.array_join(F.transform("steps", part), "").alias("text"))


def rescored(paths: DataFrame, entities: DataFrame, pattern: str, now: float, matches=None) -> DataFrame:
    """Paths with a temporal score.

    *entities*: node, n_transitions, first_seen, last_seen (seconds).  evolution boosts by
    transitions, first by age in years, last by recency in half years; a node that
    *matches* (a Column over entities) refuses costs 0.9, and the share that matches scales the rest.
    """
    days = lambda c: (F.lit(now) - F.col(c)) / 86_400
    boost = {
        "evolution": F.least(1.0 + F.col("n_transitions") * 0.1, F.lit(2.0)),
        "first": F.least(1.0 + days("first_seen") / 365, F.lit(2.0)),
        "last": F.greatest(F.lit(0.3), 1.0 - days("last_seen") / 180),
    }.get(pattern, F.lit(1.0))
    good = F.lit(True) if matches is None else matches
    factor = boost * F.when(good, 1.0).otherwise(0.1)
    numbered = paths.select("nodes", "types", "score").withColumn("node", F.explode("nodes"))
    per = numbered.join(entities, "node", "left").groupBy("nodes", "types", "score")
    known = F.col("n_transitions").isNotNull()
    sums = per.agg(
        F.collect_list(F.when(known, factor)).alias("factors"),  # a path has few nodes
        F.count_if(known & good).alias("ok"),
    )
    product = F.aggregate(F.array_sort("factors"), F.lit(1.0), lambda a, x: a * x)
    share = F.lit(1.0) if matches is None else 0.5 + 0.5 * F.col("ok") / F.size("nodes")
    return sums.select("nodes", "types", (F.col("score") * product * share).alias("score"))


def best_nodes(paths: DataFrame, top: int = 15) -> DataFrame:
    """The nodes by the best score of any path through them."""
    return paths.select(F.explode("nodes").alias("node"), "score").groupBy("node").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "node").limit(top)


def settled(df: DataFrame) -> DataFrame:
    """Cut the lineage, in the folder all executors share."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError(f"spark.checkpoint.dir is unset: on {context.master} it has to name a folder that all executors share")
        context.setCheckpointDir(folder or "/tmp/checkpoints/tidemark")
    return df.checkpoint()


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node): large and small stars in turn until no edge changes."""
    now = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("u <> v").distinct()
    loops = edges.filter("src = dst").select(F.col("src").alias("node")).distinct()
    now, last = settled(now), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        salted = both.filter("v > u").withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
        every = least.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        large = salted.join(every, ["u", "salt"]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        joined = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = settled(small.unionByName(joined.select("u", F.col("m").alias("v"))).distinct())
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == last:
            break
        last = state
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
    alone = loops.join(found, "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.unionByName(alone)
