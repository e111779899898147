"""The domain's tables, derived from the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.times import epoch_seconds

NOW = "2024-02-01 00:00:00"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column | str) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(ts) if isinstance(ts, str) else ts)


def transitions(events: DataFrame) -> DataFrame:
    """entity_id, ts, us (microseconds), ord, transition_type, k, event_type, value."""
    first = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) == 1
    kind = F.when(first, "creation").when(F.col("event_type") == "error", "contradiction").otherwise("update")
    return events.select(
        F.col("user_id").alias("entity_id"),
        "ts",
        micros("ts").alias("us"),
        F.col("event_id").alias("ord"),
        kind.alias("transition_type"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        "event_type",
        "value",
    )


def entities(events: DataFrame, embeddings: DataFrame) -> DataFrame:
    """entity_id, type (the label of its vector), first_us, last_us, n_events."""
    seen = events.groupBy(F.col("user_id").alias("entity_id")).agg(
        F.min(micros("ts")).alias("first_us"), F.max(micros("ts")).alias("last_us"), F.count(F.lit(1)).alias("n_events")
    )
    return seen.join(embeddings.select(F.col("vec_id").alias("entity_id"), F.col("label").cast("string").alias("type")), "entity_id", "left")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, type: customers and suppliers in nations, nations in regions, orders of customers."""
    t = lambda n: load(spark, sf_dir, n)
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    parts = [
        t("customer").select(key("c", "c_custkey").alias("src"), key("n", "c_nationkey").alias("dst"), F.lit("located_in").alias("type")),
        t("supplier").select(key("s", "s_suppkey").alias("src"), key("n", "s_nationkey").alias("dst"), F.lit("located_in").alias("type")),
        t("nation").select(key("n", "n_nationkey").alias("src"), key("r", "n_regionkey").alias("dst"), F.lit("part_of").alias("type")),
        t("orders").select(key("o", "o_orderkey").alias("src"), key("c", "o_custkey").alias("dst"), F.lit("placed_by").alias("type")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def facts(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """subject, role, object, start and end (years), start_day and end_day."""
    j = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    a, b = F.least("o_orderdate", "l_shipdate"), F.greatest("o_orderdate", "l_shipdate")
    return j.select(
        F.col("l_suppkey").alias("subject"),
        F.col("l_returnflag").alias("role"),
        F.col("l_partkey").alias("object"),
        a.cast("date").alias("start_day"),
        b.cast("date").alias("end_day"),
        F.year(a).alias("start"),
        F.year(b).alias("end"),
    )


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, created_us: user and assistant turns, an hour per conversation number."""
    kept = conversations.filter(F.col("role").isin("user", "assistant"))
    return kept.select("conv_id", "turn", "role", "text", (F.lit(1_704_067_200_000_000) + F.col("conv_id") * 3_600_000_000).alias("created_us"))


def stage_visits(events: DataFrame) -> DataFrame:
    """prospect_id, seq, stage, entered_us, dwell_days (null for the last), is_last, outcome (won, lost or null)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = micros("ts")
    last = F.lead("event_id").over(w).isNull()
    out = events.select(
        F.col("user_id").alias("prospect_id"),
        F.row_number().over(w).alias("seq"),
        F.col("event_type").alias("stage"),
        us.alias("entered_us"),
        ((F.lead(us).over(w) - us) / 86_400e6).alias("dwell_days"),
        last.alias("is_last"),
    )
    ended = F.when(F.col("stage") == "purchase", "won").when(F.col("stage") == "error", "lost")
    return out.withColumn("outcome", F.when(F.col("is_last"), ended))


__all__ = ["NOW", "edges", "entities", "epoch_seconds", "facts", "load", "micros", "stage_visits", "transitions", "turns"]
