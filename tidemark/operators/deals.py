"""Deals: pipeline value, funnels by stage, rule gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import lookup


def pipeline_value(deals: DataFrame, order: Sequence[str], chance: dict[str, float]) -> DataFrame:
    """Per stage, in order and with zeros: n_deals, value and chance-weighted value (closed stages have none)."""
    spark = deals.sparkSession
    rows = [(i, s, float(chance.get(s, 0.1)), not s.startswith("closed")) for i, s in enumerate(order)]
    stages = spark.createDataFrame(rows, "position int, stage string, chance double, active boolean")
    exact = F.sum(F.col("value").cast("decimal(18,2)"))
    sums = deals.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), exact.cast("double").alias("v"))
    joined = stages.join(F.broadcast(sums), "stage", "left")  # a row per stage
    value = F.when(F.col("active"), F.coalesce("v", F.lit(0.0))).otherwise(0.0)
    return joined.select("position", "stage", F.coalesce("n", F.lit(0)).alias("n_deals"), value.alias("value"), (value * F.col("chance")).alias("weighted_value"))


def rule_gaps(rows: DataFrame, key: str, rules: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """key, gap, impact: a row for each rule (name, impact, condition) that a row breaks, in one pass."""
    found = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(n).alias("gap"), F.lit(i).alias("impact"))) for n, i, c in rules)))
    return rows.select(key, F.explode(found).alias("x")).select(key, "x.gap", "x.impact")


def uncertainties(prospects: DataFrame) -> DataFrame:
    """id, type, reference, impact from prospect documents: no decision maker, no budget or timeline signal, hard blockers, unheard stakeholders.

    Blockers count even when resolved.
    """
    people, signals, objections = (F.coalesce(c, F.array().cast(prospects.schema[c].dataType)) for c in ("stakeholders", "buying_signals", "objections"))
    one = lambda kind, ref, impact: F.struct(F.lit(kind).alias("type"), (ref if isinstance(ref, Column) else F.lit(ref)).alias("reference"), F.lit(impact).alias("impact"))
    unless = lambda ok, row: F.when(~ok, F.array(row)).otherwise(F.array().cast("array<struct<type:string,reference:string,impact:string>>"))
    key = F.exists(people, lambda s: s["influence"] == "decision_maker")
    has = lambda kind: F.exists(signals, lambda s: s["type"] == kind)
    blockers = F.transform(F.filter(objections, lambda o: o["severity"] == "hard_blocker"), lambda o: one("low_confidence", o["description"], "high"))
    unheard = F.transform(
        F.filter(people, lambda s: s["influence"].isin("decision_maker", "blocker") & (s["sentiment"] == "unknown")),
        lambda s: one("missing_critical", s["name"], "medium"),
    )
    everything = F.concat(
        unless(F.coalesce(key, F.lit(False)), one("missing_critical", "Decision maker", "high")),
        unless(F.coalesce(has("budget"), F.lit(False)), one("missing_critical", "Budget", "high")),
        unless(F.coalesce(has("timeline"), F.lit(False)), one("missing_critical", "Timeline", "high")),
        blockers,
        unheard,
    )
    return prospects.select("id", F.explode(everything).alias("x")).select("id", "x.*")


def summary(deals: DataFrame, chance: dict[str, float]) -> DataFrame:
    """One row: deals, active ones, their value, chance-weighted value and mean size (0 without any).

    *deals*: stage and value; closed stages are not active, an unknown stage counts with a chance of 0.1.
    Sums are exact decimals, so the order of the rows does not matter.
    """
    active = ~F.startswith(F.coalesce("stage", F.lit("")), F.lit("closed"))
    worth = F.when(active, F.col("value").cast("decimal(18,2)"))
    weight = lookup({k: str(v) for k, v in chance.items()}, F.col("stage"), "0.1").cast("decimal(4,2)")
    total = lambda c: F.coalesce(F.sum(c).cast("double"), F.lit(0.0))
    n = F.count_if(active)
    return deals.agg(
        F.count(F.lit(1)).alias("n_deals"),
        n.alias("n_active"),
        total(worth).alias("value"),
        total(worth * weight).alias("weighted_value"),
        F.when(n > 0, total(worth) / n).otherwise(0.0).alias("mean_value"),
    )
