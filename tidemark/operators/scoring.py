"""Roll-ups of evaluation results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rolled_up(results: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """n, mean, correct (0.9 or more), partial (0.4 or more) by every prefix of the keys; null keys are totals."""
    s = F.col(score)
    return results.rollup(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(s).alias("mean_score"),
        F.count_if(s >= 0.9).alias("n_correct"),
        F.count_if((s >= 0.4) & (s < 0.9)).alias("n_partial"),
    )


def matrix(results: DataFrame, row: str, column: str, values: Sequence[str], score: str) -> DataFrame:
    """Mean scores with a column for each of the given values; null where there are none."""
    return results.groupBy(row).pivot(column, list(values)).agg(F.avg(score))


def pairwise(results: DataFrame, row: str, column: str, score: str) -> DataFrame:
    """a, b, mean_delta (b less a), wins and losses of b, n: every two columns of the matrix of mean scores, over the rows that have both."""
    cells = results.groupBy(row, column).agg(F.avg(score).alias("m")).filter("m is not null")
    a, b = (cells.select(F.col(row).alias("r" + x), F.col(column).alias(x), F.col("m").alias("m" + x)) for x in "ab")
    met = a.join(b, F.col("ra").eqNullSafe(F.col("rb")) & (F.col("a") < F.col("b")))  # means only: few columns a row
    return met.groupBy("a", "b").agg(
        F.avg(F.col("mb") - F.col("ma")).alias("mean_delta"), F.count_if(F.col("mb") > F.col("ma")).alias("wins"), F.count_if(F.col("mb") < F.col("ma")).alias("losses"), F.count(F.lit(1)).alias("n")
    )


def flips(results: DataFrame, before: str, after: str) -> DataFrame:
    """One row: accuracy of both runs, their difference, answers rescued and hurt."""
    a, b = F.col(before) == 1, F.col(after) == 1
    return results.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(a.cast("int")).alias("accuracy_before"),
        F.avg(b.cast("int")).alias("accuracy_after"),
        (F.avg(b.cast("int")) - F.avg(a.cast("int"))).alias("delta"),
        F.count_if(~a & b).alias("rescued"),
        F.count_if(a & ~b).alias("hurt"),
    )


def advantages(rollouts: DataFrame, group: str, reward: str, baseline: str = "mean") -> DataFrame:
    """Each rollout's reward less its group's mean (or least) reward."""
    per = rollouts.groupBy(group).agg(F.avg(reward).alias("_mean"), F.min(reward).alias("_min"))
    base = {"mean": F.col("_mean"), "min": F.col("_min")}.get(baseline, F.lit(0.0))
    return rollouts.join(per, group).withColumn("advantage", F.col(reward) - base).drop("_mean", "_min")


def shortest_first(rows: DataFrame, kind: str, text: str, key: str, n: int, question: str | None = None, budget: int | None = None) -> DataFrame:
    """The *n* shortest texts of each kind (a sampling operator), of those that stay below *budget* characters with a line break and their *question*."""
    w = Window.partitionBy(kind).orderBy(F.length(text), key)
    size = F.length(text) + (1 + F.length(F.coalesce(question, F.lit(""))) if question else F.lit(0))
    fitting = rows if budget is None else rows.filter(size < budget)
    return fitting.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n)


def policy_loss(rollouts: DataFrame, group: str, reward: str, log_probs: str, baseline: str = "mean") -> DataFrame:
    """One row: mean of -advantage x log chance over all steps (0 without steps), mean reward, mean advantage.

    *log_probs* is an array per rollout; a rollout without steps counts for the two means only.
    """
    steps = F.filter(F.coalesce(log_probs, F.array().cast("array<double>")), lambda p: p.isNotNull())
    scored = advantages(rollouts, group, reward, baseline)
    loss = F.aggregate(steps, F.lit(0.0), lambda a, p: a - p * F.col("advantage"))
    return scored.agg(
        F.coalesce(F.sum(loss) / F.nullif(F.sum(F.size(steps)), F.lit(0)), F.lit(0.0)).alias("loss"),
        F.avg(reward).alias("mean_reward"),
        F.avg("advantage").alias("mean_advantage"),
    )


def overview(results: DataFrame, name: str, score: str) -> DataFrame:
    """Each run with its mean score, n, its rank (ties by name) and how far it lies below the best."""
    means = results.groupBy(name).agg(F.avg(score).alias("mean_score"), F.count(score).alias("n"))
    w = Window.orderBy(F.desc_nulls_last("mean_score"), name)  # a row per run
    best = F.max("mean_score").over(Window.partitionBy())
    return means.select(name, "mean_score", "n", F.row_number().over(w).alias("rank"), (best - F.col("mean_score")).alias("below_best"))


def query_grid(entities: DataFrame, templates: Sequence[tuple[str, str]], conditions: Sequence[str]) -> DataFrame:
    """query_id, entity_id, query_type, condition, query_text: every template (type, wording with {name}) and condition for each entity.

    *entities*: entity_id and name.  Templates and conditions are parameters, so the rows grow with the entities only.
    """
    asked = F.array(*(F.struct(F.lit(k).alias("query_type"), F.lit(t).alias("wording")) for k, t in templates))
    rows = entities.select("entity_id", "name", F.explode(asked).alias("q")).withColumn("condition", F.explode(F.array(*map(F.lit, conditions))))
    return rows.select(
        F.concat_ws("_", F.col("entity_id").cast("string"), "q.query_type").alias("query_id"), "entity_id", "q.query_type", "condition",
        F.replace(F.col("q.wording"), F.lit("{name}"), F.coalesce("name", F.lit("unknown"))).alias("query_text"),
    )
