"""Process mining over stage visits (prospect_id, seq, stage, dwell_days, is_last, outcome)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def transition_matrix(visits: DataFrame) -> DataFrame:
    """from_stage, to_stage, n, probability; a closed deal adds its last stage to its outcome, if they differ."""
    w = Window.partitionBy("prospect_id").orderBy("seq")
    pairs = visits.select(F.col("stage").alias("from_stage"), F.coalesce(F.lead("stage").over(w), F.col("outcome")).alias("to_stage"), "is_last")
    kept = pairs.filter(F.col("to_stage").isNotNull() & ~(F.col("is_last") & (F.col("from_stage") == F.col("to_stage"))))
    counts = kept.groupBy("from_stage", "to_stage").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("from_stage"))
    return counts.select("from_stage", "to_stage", "n", (F.col("n") / total).alias("probability"))


def bottlenecks(visits: DataFrame, stall_days: float, flag_over: float = 30.0) -> DataFrame:
    """Per stage: visits, avg_days, stall_rate, loss_rate, and 0.3 days + 50 stalls + 100 losses as the score."""
    days = F.coalesce("dwell_days", F.lit(0.0))
    stats = visits.groupBy("stage").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.round(days * 86_400).cast("long")).alias("secs"),
        F.count_if(days > stall_days).alias("stalled"),
        F.count_if(F.col("outcome") == "lost").alias("lost"),
    )
    n = F.col("n")
    out = stats.select("stage", "n", (F.col("secs") / 86_400).alias("avg_days"), (F.col("stalled") / n).alias("stall_rate"), (F.col("lost") / n).alias("loss_rate"))
    score = F.col("avg_days") * 0.3 + F.col("stall_rate") * 50 + F.col("loss_rate") * 100
    return out.withColumn("score", score).withColumn("is_bottleneck", F.col("score") > flag_over)


def funnel(visits: DataFrame, order: Sequence[str]) -> DataFrame:
    """Per stage, in order and with zeros: the distinct deals that reached it, and their share of all deals."""
    spark = visits.sparkSession
    stages = spark.createDataFrame([(i, s) for i, s in enumerate(order)], "position int, stage string")
    reached = visits.groupBy("stage").agg(F.count_distinct("prospect_id").alias("deals"))
    total = visits.agg(F.count_distinct("prospect_id").alias("total"))
    joined = stages.join(F.broadcast(reached), "stage", "left").withColumn("total", total.scalar())  # a row per stage
    deals = F.coalesce("deals", F.lit(0))
    return joined.select("position", "stage", deals.alias("deals"), F.when(F.col("total") > 0, deals * 100.0 / F.col("total")).otherwise(0.0).alias("percent"))


def stalls(visits: DataFrame, now_us: int, stall_days: float) -> DataFrame:
    """The open deals whose last stage began over *stall_days* ago."""
    last = visits.filter(F.col("is_last") & F.col("outcome").isNull())
    days = (F.lit(now_us) - F.col("entered_us")) / 86_400e6
    return last.select("prospect_id", "stage", days.alias("days_in_stage")).filter(F.col("days_in_stage") > stall_days)


def stage_name(raw):
    """Lower-cased, blanks and dashes as underscores, known synonyms mapped, anything else as it is."""
    s = F.regexp_replace(F.lower(raw), "[ -]", "_")
    return F.when(s.isin("closed", "won"), "closed_won").when(s == "lost", "closed_lost").otherwise(s)


def stage_mentions(texts: DataFrame, text: str, keywords: Sequence[tuple[str, str]]) -> DataFrame:
    """stage, mentions: case-folded, non-overlapping counts of each stage's keywords over all texts, most first.

    The keywords are a parameter, so each text is read once with one count per keyword.
    """
    from ..functions.text import occurrences

    stages = sorted({s for s, _ in keywords})
    per = {s: [occurrences(F.col(text), F.lit(k)) for t, k in keywords if t == s] for s in stages}
    sums = texts.agg(*(F.coalesce(F.sum(sum(per[s][1:], per[s][0])), F.lit(0)).alias(s) for s in stages))
    pairs = F.array(*(F.struct(F.lit(s).alias("stage"), F.col(f"`{s}`").cast("long").alias("mentions")) for s in stages))
    return sums.select(F.explode(pairs).alias("x")).select("x.*").filter("mentions > 0").orderBy(F.desc("mentions"), "stage")


def win_path(matrix: DataFrame, spark: SparkSession, stage: str, order: Sequence[str], default: float = 0.5) -> DataFrame:
    """The chance to win from a stage: the product along the rest of the order, *default* for unseen steps."""
    rest = [s for s in order[list(order).index(stage) :] if s not in ("closed_won", "closed_lost")] + ["closed_won"]
    steps = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(rest, rest[1:]))], "i int, from_stage string, to_stage string")
    known = F.broadcast(steps).join(matrix, ["from_stage", "to_stage"], "left").withColumn("p", F.coalesce("probability", F.lit(default)))
    return known.agg(F.aggregate(F.collect_list("p"), F.lit(1.0), lambda a, p: a * p).alias("chance"))  # a row per stage


def what_if(chance, rep_change: bool = False, speedup: float | None = None, remove_objection: bool = False, add_champion: bool = False):
    """A chance under changes, 0.95 at most."""
    factor = (1.15 if rep_change else 1) * (1 + (1 - speedup) * 0.2 if speedup else 1) * (1.25 if remove_objection else 1) * (1.35 if add_champion else 1)
    return F.least(F.lit(0.95), chance * factor)


def summary(visits: DataFrame, now_us: int, stall_days: float) -> DataFrame:
    """One row from the last visits: deals, open ones, stalled ones and their share of all in percent (0 without deals)."""
    is_open = F.col("outcome").isNull()
    stalled = F.count_if(is_open & ((F.lit(now_us) - F.col("entered_us")) / 86_400e6 > stall_days))
    n = F.count(F.lit(1))
    last = visits.filter("is_last")
    return last.agg(
        n.alias("n_deals"),
        F.count_if(is_open).alias("n_active"),
        stalled.alias("n_stalled"),
        F.when(n > 0, F.round(stalled * 100.0 / n, 1)).otherwise(0.0).cast("double").alias("stall_percent"),
    )


def current_stages(visits: DataFrame) -> DataFrame:
    """stage, n_deals: the deals by the stage that they are in."""
    return visits.filter("is_last").groupBy("stage").agg(F.count(F.lit(1)).alias("n_deals"))


def analysis(visits: DataFrame, order: Sequence[str], now_us: int, stall_days: float) -> dict[str, DataFrame]:
    """All reports on one set of visits, by name; cache the visits where several of them are read."""
    return {
        "summary": summary(visits, now_us, stall_days),
        "transition_matrix": transition_matrix(visits),
        "bottlenecks": bottlenecks(visits, stall_days),
        "funnel": funnel(visits, order),
        "current_stages": current_stages(visits),
        "stalls": stalls(visits, now_us, stall_days),
    }
