"""Conversations: statistics and texts for prompts, within budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def statistics(conversations: DataFrame, by: str | None = None) -> DataFrame:
    """n, turns and characters (sum, mean, least, most) of conversations (n_turns, n_chars), also by a column."""
    grouped = conversations.groupBy(*([by] if by else []))
    out = [F.count(F.lit(1)).alias("n_conversations")]
    for c in ("n_turns", "n_chars"):
        out += [F.sum(c).alias(f"{c}_sum"), F.avg(c).alias(f"{c}_mean"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return grouped.agg(*out)


def budgeted_texts(turns: DataFrame, budget: int, per_turn: int = 3000) -> DataFrame:
    """conv_id, text, n_kept: a conversation's turns in order ("ROLE:" and the text, cut to *per_turn*) while they fit the budget.

    The running sum never falls, so the filter keeps exactly the prefix that fits.
    """
    line = F.concat(F.upper("role"), F.lit(":\n"), F.substring("text", 1, per_turn))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    sized = turns.withColumn("line", line).withColumn("held", F.sum(F.length("line")).over(w))
    kept = sized.filter(F.col("held") <= budget)
    lines = F.array_sort(F.collect_list(F.struct("turn", "line")))  # within the budget
    return kept.groupBy("conv_id").agg(lines.alias("x"), F.count(F.lit(1)).alias("n_kept")).select("conv_id", F.array_join(F.transform("x", lambda s: s["line"]), "\n\n").alias("text"), "n_kept")


def preamble(entities: DataFrame, transitions: DataFrame, us: int, days: int = 3, projects: int = 15, others: int = 20, changes: int = 10) -> DataFrame:
    """section, position, line: active projects, recently active others and recent changes as of a time, each capped.

    *entities*: entity_id, name, type, importance, description; *transitions*: entity_id, us, ord, transition_type, summary.
    """
    day = 86_400_000_000
    past = transitions.filter(F.col("us") <= us)
    last = past.groupBy("entity_id").agg(F.max("us").alias("last_us"))
    ago = F.floor((F.lit(us) - F.col("last_us")) / day).cast("long")
    when = F.when(ago < 1, "today").when(ago < 2, "yesterday").otherwise(F.concat(ago.cast("string"), F.lit(" days ago")))

    def numbered(df: DataFrame, section: str, order: list, line: Column, cap: int) -> DataFrame:
        top = df.orderBy(*order).limit(cap)
        return top.select(F.lit(section).alias("section"), F.row_number().over(Window.orderBy(*order)).alias("position"), line.alias("line"))

    active = entities.filter((F.col("type") == "project") & (F.col("importance") >= 0.1)).join(last, "entity_id", "left")
    changed = F.coalesce(F.concat(F.lit(" (last changed: "), when, F.lit(")")), F.lit(""))
    first = numbered(active, "projects", [F.desc("importance"), "entity_id"], F.concat("name", F.lit(": "), "description", changed), projects)
    recent = past.filter(F.col("us") >= us - days * day)
    touched = recent.select("entity_id").distinct()
    rest = entities.filter("type <> 'project'").join(touched, "entity_id", "left_semi")
    second = numbered(rest, "entities", [F.desc("importance"), "entity_id"], F.concat("name", F.lit(" ("), "type", F.lit("): "), "description"), others)
    newest = recent.join(entities.select("entity_id", "name"), "entity_id", "left")
    mark = F.when(F.col("transition_type") == "contradiction", " ⚠ CONTRADICTION").otherwise("")
    third = numbered(newest, "changes", [F.desc("us"), F.desc("ord")], F.concat(F.coalesce("name", F.lit("unknown")), F.lit(": "), "summary", mark), changes)
    return first.unionByName(second).unionByName(third)


def previous_links(conversations: DataFrame, partition: str, order: list[str], key: str) -> DataFrame:
    """Each conversation with the one before it in its partition."""
    return conversations.withColumn("previous", F.lag(key).over(Window.partitionBy(partition).orderBy(*order)))
