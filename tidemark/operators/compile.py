"""Narratives: per-entity context strings within budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import from_epoch, humanized, season_period
from .history import DAY_US


def _lines(rows: DataFrame, key: str, order: list[str], line: Column, cap: int | None = None) -> DataFrame:
    """key, lines: the ordered lines of each key, the first *cap* only where a cap is part of the format."""
    if cap is not None:
        w = Window.partitionBy(key).orderBy(*order)
        rows = rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= cap)
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))).alias("x")).select(key, F.array_join(F.transform("x", lambda s: s["line"]), "\n").alias("lines"))


def timeline_line(transition_type: Column, seconds_ago: Column, ts: Column, summary: Column) -> Column:
    mark = F.when(transition_type == "contradiction", "  ⚠").when(transition_type == "creation", "  ★").otherwise("  •")
    return F.concat(mark, F.lit(" "), humanized(seconds_ago), F.lit(" ("), season_period(ts), F.lit("): "), summary)


def narratives(entities: DataFrame, transitions: DataFrame, relations: DataFrame, now_us: int, max_timeline: int = 50, max_relations: int = 8) -> DataFrame:
    """entity_id, context: header, velocity, timeline (the newest *max_timeline* changes, oldest first) and relations.

    *entities*: entity_id, name, type, first_us, last_us, n_changes; *transitions*: entity_id, us, ord,
    transition_type, summary; *relations*: entity_id, rank, line.
    """
    ago = lambda us: (F.lit(now_us) - us) / 1e6
    at = lambda us: from_epoch(us / 1e6)
    newest = Window.partitionBy("entity_id").orderBy(F.desc("us"), F.desc("ord"))
    kept = transitions.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= max_timeline)
    timeline = _lines(kept, "entity_id", ["us", "ord"], timeline_line(F.col("transition_type"), ago(F.col("us")), at(F.col("us")), F.col("summary")))
    related = _lines(relations, "entity_id", ["rank"], F.concat(F.lit("  "), "line"), max_relations).withColumnRenamed("lines", "related")
    months = F.greatest((F.col("last_us") - F.col("first_us")) / (30.0 * DAY_US), F.lit(1.0))
    head = F.concat(
        F.lit("## "), "name", F.lit(" ("), "type", F.lit(")\nFirst appeared "), humanized(ago(F.col("first_us"))), F.lit(" ("), season_period(at(F.col("first_us"))),
        F.lit("), last referenced "), humanized(ago(F.col("last_us"))), F.lit(".\nChanged state "), F.col("n_changes").cast("string"), F.lit(" times (~"),
        F.format_string("%.1f", F.col("n_changes") / months), F.lit("x/month)."),
    )
    joined = entities.join(timeline, "entity_id", "left").join(related, "entity_id", "left")
    text = F.concat(head, F.coalesce(F.concat(F.lit("\n\nTimeline:\n"), "lines"), F.lit("")), F.coalesce(F.concat(F.lit("\n\nRelationships:\n"), "related"), F.lit("")))
    return joined.select("entity_id", text.alias("context"))


def succession_chains(facts: DataFrame) -> DataFrame:
    """object, role, chain: the holders in order, "A → B → C", all of them: the chain is the row."""
    holders = F.array_sort(F.collect_list(F.struct("start", "end", "subject")))
    return facts.groupBy("object", "role").agg(F.array_join(F.transform(holders, lambda x: x["subject"].cast("string")), " → ").alias("chain"))


def temporal_groups(entities: DataFrame, reference: Column) -> DataFrame:
    """status, n, names: entities by ongoing, past, upcoming, atemporal."""
    from .bitemporal import temporal_status

    return entities.withColumn("status", temporal_status(F.col("valid_from"), F.col("valid_to"), reference))


def entity_text(name: Column, kind: Column, state: Column, most: int = 500) -> Column:
    """What stands for an entity when it is embedded: "name (type): description", cut to *most* characters.

    Without a description the other values of its state, by key, stand in for it.
    """
    filled = F.filter(F.array_sort(F.map_entries(state)), lambda e: ~e["key"].isin("description", "_is_event") & (F.coalesce(e["value"], F.lit("")) != ""))
    listed = F.array_join(F.transform(filled, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")
    told = F.coalesce(F.nullif(F.try_element_at(state, F.lit("description")), F.lit("")), listed, F.lit(""))
    return F.substring(F.concat(F.coalesce(name, F.lit("")), F.lit(" ("), F.coalesce(kind, F.lit("")), F.lit("): "), told), 1, most)
