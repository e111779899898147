"""Reports over entities, transitions and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def type_counts(entities: DataFrame) -> DataFrame:
    return entities.groupBy("type").agg(F.count(F.lit(1)).alias("n_entities"))


def per_entity(entities: DataFrame, transitions: DataFrame, degrees: DataFrame) -> DataFrame:
    """Each entity with n_transitions, n_changes (creation aside) and degree; zeros stay."""
    t = transitions.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_transitions"), F.count_if(F.col("transition_type") != "creation").alias("n_changes"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    joined = entities.join(t, "entity_id", "left").join(degrees.select(F.col("node").alias("entity_id"), "degree"), "entity_id", "left")
    return joined.select(*entities.columns, zero("n_transitions"), zero("n_changes"), zero("degree"))


def summary(table: DataFrame) -> DataFrame:
    """One row: entities, mean, median and most transitions, unchanged, orphans, orphan rate, mean degree."""
    return table.agg(
        F.count(F.lit(1)).alias("n_entities"),
        F.avg("n_transitions").alias("avg_transitions"),
        F.median("n_transitions").alias("median_transitions"),
        F.max("n_transitions").alias("max_transitions"),
        F.count_if(F.col("n_changes") == 0).alias("n_unchanged"),
        F.count_if(F.col("degree") == 0).alias("n_orphans"),
        (F.count_if(F.col("degree") == 0) / F.count(F.lit(1))).alias("orphan_rate"),
        F.avg("degree").alias("avg_degree"),
    )


def noise(table: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The entities that break a rule, their reasons, and a severity by their number (generic_name alone is medium)."""
    reasons = F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in rules.items())))
    n = F.size("reasons")
    severity = F.when(n >= 3, "high").when((n >= 2) | F.array_contains("reasons", "generic_name"), "medium").otherwise("low")
    order = F.when(F.col("severity") == "high", 2).when(F.col("severity") == "medium", 1).otherwise(0)
    return table.withColumn("reasons", reasons).filter(n > 0).withColumn("severity", severity).withColumn("severity_rank", order)


def by_quarter(transitions: DataFrame, time: str) -> DataFrame:
    """Per quarter: transitions, entities touched, new ones, those known before, and their share."""
    label = F.concat(F.year(time).cast("string"), F.lit("-Q"), F.quarter(time).cast("string"))
    created = F.col("transition_type") == "creation"
    # an entity is created once, so those touched less those created here were known before
    per = transitions.groupBy(label.alias("period"), "entity_id").agg(F.count(F.lit(1)).alias("n"), F.max(created.cast("int")).alias("created"))
    out = per.groupBy("period").agg(F.sum("n").alias("n_transitions"), F.count(F.lit(1)).alias("n_touched"), F.sum("created").alias("n_new"))
    matched = F.col("n_touched") - F.col("n_new")
    return out.withColumn("n_matched", matched).withColumn("match_rate", matched / F.col("n_touched"))
