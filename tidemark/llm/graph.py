"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Tasks over which the neighbours of one node are dealt in the large star.
SALTS = 16


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node of the component of every node with an edge to another node.

    Each round hangs neighbours on the smallest node around (large star, small
    star); rounds are written to the shared folder and end when none changes an
    edge.  Minima are combined in the tasks first and no neighbour list is
    collected; the neighbours of a node of any degree are dealt over SALTS tasks, and
    nothing is broadcast.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    now, last = materialize(now, "edges"), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        salted = both.filter("v > u").withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
        every = least.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        large = salted.join(every.hint("merge"), ["u", "salt"]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(smallest.hint("merge"), "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.unionByName(joined.select("u", F.col("m").alias("v"))).distinct(), "stars")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == last:
            break
        last = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )
