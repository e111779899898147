"""Negotiations: payoffs, remaining time, and roll-ups by condition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def payoffs(contracts: DataFrame, table: DataFrame) -> DataFrame:
    """contract_id, payoff: the sum of the values of a contract's choices (a map of issue to option)."""
    choices = contracts.select("contract_id", F.explode("choices").alias("issue", "option"))
    return choices.join(table, ["issue", "option"], "left").groupBy("contract_id").agg(F.coalesce(F.sum("value"), F.lit(0)).alias("payoff"))


def remaining_time(turns: DataFrame, limit: float, per_word: float = 0.4) -> DataFrame:
    """Each turn (run_id, turn, words) with the time that is left after it and whether the run is over."""
    w = Window.partitionBy("run_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    left = F.lit(limit) - F.sum("words").over(w) * per_word
    return turns.withColumn("remaining", left).withColumn("over", F.col("remaining") <= 0)


def urgency(remaining: Column) -> Column:
    return F.when(remaining < 60, "HIGH").when(remaining < 120, "MEDIUM").otherwise("LOW")


def by_condition(results: DataFrame) -> DataFrame:
    """scenario, condition, n, closure_rate, avg_turns, avg_payoff (of closed deals)."""
    closed = F.col("deal_reached")
    return results.groupBy("scenario", "condition").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(closed.cast("int")).alias("closure_rate"),
        F.avg("num_turns").alias("avg_turns"),
        F.avg(F.when(closed, F.col("joint_payoff"))).alias("avg_payoff"),
    )


def effect(rolled: DataFrame, control: str, treated: str) -> DataFrame:
    """scenario and the difference in closure rate between two conditions."""
    rate = lambda c: F.max(F.when(F.col("condition") == c, F.col("closure_rate")))
    return rolled.groupBy("scenario").agg((rate(treated) - rate(control)).alias("closure_delta"))


def sequence_totals(steps: DataFrame) -> DataFrame:
    """Per simulated sequence: change of chance, distinct pains and concerns, the riskiest step (the first on ties).

    *steps*: sequence_id, step, delta, ghost_risk, pains and concerns (arrays of (name, score)).
    """
    named = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(F.transform(F.filter(c, lambda p: p["score"] > 0.6), lambda p: p["name"])))))
    return steps.groupBy("sequence_id").agg(
        F.sum("delta").alias("delta"),
        named("pains").alias("n_pains"),
        named("concerns").alias("n_concerns"),
        F.max_by("step", F.struct("ghost_risk", -F.col("step"))).alias("riskiest_step"),
    )


def win_trajectory(steps: DataFrame) -> DataFrame:
    """Each step with 0.3 plus its own delta times its number, within 0.05 and 0.95."""
    n = F.row_number().over(Window.partitionBy("sequence_id").orderBy("step"))
    return steps.withColumn("chance", F.least(F.greatest(0.3 + F.col("delta") * n, F.lit(0.05)), F.lit(0.95)))


def compared(totals: DataFrame, score: str, band: float = 0.5) -> DataFrame:
    """a, b, winner of sequences of one prospect, a tie within the band (a self-join per prospect)."""
    x, y = (totals.select("prospect_id", F.col("sequence_id").alias(p), F.col(score).alias(f"s{p}")) for p in "ab")
    d = F.col("sa") - F.col("sb")
    return x.join(y, "prospect_id").filter("a < b").select("prospect_id", "a", "b", F.when(F.abs(d) <= band, "tie").when(d > 0, "a").otherwise("b").alias("winner"))


def rated(totals: DataFrame) -> DataFrame:
    """Sequences with a rating of strong, moderate, weak or risky, and the points behind it.

    *totals*: objection_change (less is better), n_pains, n_risks, response (mean chance of an answer; null without steps).
    """
    change, pains, risks, response = (F.col(c) for c in ("objection_change", "n_pains", "n_risks", "response"))
    points = (
        F.when(change < -0.3, 2).when(change < -0.1, 1).when(change > 0.1, -1).otherwise(0)
        + F.when(pains >= 3, 2).when(pains >= 1, 1).otherwise(0)
        - F.when(risks > 2, 2).when(risks > 0, 1).otherwise(0)
        + F.when(response > 0.5, 1).when(response < 0.2, -1).otherwise(0)
    )
    rating = F.when(F.col("points") >= 3, "strong").when(F.col("points") >= 1, "moderate").when(F.col("points") >= -1, "weak").otherwise("risky")
    return totals.withColumn("points", points).withColumn("rating", rating)


def advice(totals: DataFrame) -> DataFrame:
    """sequence_id, advice: ghost_risk, preempt_concerns, cover_pains, tighten_timing or spread_timing, a row for each that holds.

    *totals*: sequence_id, riskiest_response, n_risks, n_pains, days, n_steps.
    """
    days, steps = F.col("days"), F.col("n_steps")
    rules = {
        "ghost_risk": F.col("riskiest_response") < 0.2,
        "preempt_concerns": F.col("n_risks") > 1,
        "cover_pains": F.col("n_pains") < 2,
        "tighten_timing": (days > 14) & (steps <= 3),
        "spread_timing": (days < 5) & (steps >= 3),
    }
    return totals.select("sequence_id", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())))).alias("advice"))
