"""Applying extractions to a model: creations, updates, aliases, relations; and recall by keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normal_score, normalize_name
from .resolve import improving_names

#: The least score by which a correction means a name.
CORRECTION_LEAST = 0.7


def applied(resolved: DataFrame, batch_us: int) -> DataFrame:
    """New transitions of resolved mentions: entity_id, us, transition_type, summary.

    *resolved*: mention_id, action, matched_id, contradiction, summary; a created entity takes its
    mention's id.
    """
    entity = F.coalesce("matched_id", "mention_id")
    kind = F.when(F.col("action") == "create", "creation").when(F.coalesce("contradiction", F.lit(False)), "contradiction").otherwise("update")
    return resolved.select(entity.alias("entity_id"), F.lit(batch_us).alias("us"), kind.alias("transition_type"), "summary")


def births(entities: DataFrame) -> DataFrame:
    """name (normalised), born (at, i): the first mention of every name that is not empty, of entities (at, i, name)."""
    named = entities.select(normalize_name("name").alias("name"), F.struct("at", "i").alias("place")).filter("name <> ''")
    return named.groupBy("name").agg(F.min("place").alias("born"))


def upserted(entities: DataFrame, changes: DataFrame) -> DataFrame:
    """Transitions of whole extractions, any number at once: name, at, i, transition_type, state, summary.

    *entities*: at, i, name, state; *changes*: at, i, entity_name, to_state, what_changed, is_contradiction;
    ``at`` orders the extractions and ``i`` the rows of one.  The first mention of a name creates it, later
    ones update it.  A change applies from the extraction on that creates its name, whose entities come first;
    one of an unknown name goes.  Mentions and changes that are told twice apply twice.
    """
    told = entities.select(
        normalize_name("name").alias("name"), "at", "i", F.lit(False).alias("is_change"), F.lit(False).alias("against"), "state", F.lit("Updated from session").alias("summary"),
    )
    changed = changes.select(
        normalize_name("entity_name").alias("name"), "at", "i", F.lit(True).alias("is_change"), F.coalesce("is_contradiction", F.lit(False)).alias("against"),
        F.create_map(F.lit("description"), F.coalesce("to_state", F.lit(""))).alias("state"), F.coalesce("what_changed", F.lit("state changed")).alias("summary"),
    )
    first = ~F.col("is_change") & (F.struct("at", "i") == F.col("born"))
    kind = F.when(first, "creation").when(F.col("against"), "contradiction").otherwise("update")
    known = told.unionByName(changed).join(births(entities), "name").filter(F.col("at") >= F.col("born.at"))
    return known.select("name", "at", "i", kind.alias("transition_type"), "state", F.when(~first, F.col("summary")).alias("summary"))


def correction_targets(entities: DataFrame, corrections: DataFrame, least: float = CORRECTION_LEAST) -> DataFrame:
    """at, i, name, score: the best name that each correction (at, i, what) can mean among those known by then.

    An as-of similarity join: names of *entities* (at, i, name) count from the conversation that first tells
    them, whose entities come before its corrections; the best score of *least* or more wins, then the name born first.
    A name that is known itself scores 1, as no other can; only the rest is searched.
    """
    known = births(entities)
    asked = corrections.select("at", "i", normalize_name("what").alias("na")).filter("na <> ''")
    told = asked.join(known.select(F.col("name").alias("na"), "born"), "na", "left").withColumn("is_known", F.coalesce(F.col("born.at") <= F.col("at"), F.lit(False)))
    rest = told.filter("not is_known").select("at", "i", "na")
    scored = improving_names(rest.select(F.col("na").alias("normal")), known.select(F.col("name").alias("normal"), "born"), "born", least)
    met = rest.join(scored, "na").filter(F.col("born.at") <= F.col("at")).select("at", "i", "score", "born", "nb")
    every = met.unionByName(told.filter("is_known").select("at", "i", F.lit(1.0).alias("score"), "born", F.col("na").alias("nb")))
    best = F.min(F.struct((-F.col("score")).alias("minus"), "born", "nb")).alias("x")
    return every.groupBy("at", "i").agg(best).select("at", "i", F.col("x.nb").alias("name"), (-F.col("x.minus")).alias("score"))


def remembered(entities: DataFrame, corrections: DataFrame, least: float = CORRECTION_LEAST) -> DataFrame:
    """Transitions of feedback conversations, all at once: name, at, i, transition_type, state, summary.

    *entities*: at, i, name, state; *corrections*: at, i, what, right, wrong.  Mentions create or update as in
    :func:`upserted`; a correction contradicts the name that it means, and one that means none goes.
    """
    empty = corrections.limit(0).select("at", "i", F.lit("").alias("entity_name"), F.lit("").alias("to_state"), F.lit("").alias("what_changed"), F.lit(False).alias("is_contradiction"))
    meant = correction_targets(entities, corrections, least).join(corrections, ["at", "i"])
    state = F.create_map(F.lit("corrected"), F.coalesce("right", F.lit("")), F.lit("was_wrong"), F.coalesce("wrong", F.lit("")))
    against = meant.select("name", "at", "i", F.lit("contradiction").alias("transition_type"), state.alias("state"), F.concat(F.lit("Correction: "), F.col("what")).alias("summary"))
    return upserted(entities, empty).unionByName(against)


def linked(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """source, target (normalised), at, type, description: relations (at, source, target, type, description) of which both ends are known by then."""
    known = births(entities).select("name", F.col("born.at").alias("born"))
    at = lambda end: known.select(F.col("name").alias(end), F.col("born").alias(f"{end}_born"))
    r = relations.select(normalize_name("source").alias("source"), normalize_name("target").alias("target"), "at", "type", "description")
    met = r.join(at("source"), "source").join(at("target"), "target")
    return met.filter("at >= source_born and at >= target_born").select("source", "target", "at", "type", "description")


def with_aliases(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """Entities with the distinct mentioned names (entity_id, name) that differ from their own added to the aliases."""
    seen = mentions.select("entity_id", F.col("name").alias("alias")).distinct()
    fresh = seen.join(entities.select("entity_id", "name"), "entity_id").filter(F.lower("alias") != F.lower("name"))
    grouped = fresh.groupBy("entity_id").agg(F.array_sort(F.collect_set("alias")).alias("_new"))  # distinct names of one entity
    none = F.array().cast("array<string>")
    return entities.join(grouped, "entity_id", "left").withColumn("aliases", F.array_union(F.coalesce("aliases", none), F.coalesce("_new", none))).drop("_new")


def merged_missing(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """The existing rows and the incoming ones whose key is not there."""
    return existing.unionByName(incoming.join(existing.select(*key), key, "left_anti").select(*existing.columns))


def importance(degree: Column, transitions: Column, days_since: Column, neighbours: Column, accesses: Column) -> Column:
    """A design extra: shares of 0.25, 0.20, 0.20, 0.20 and 0.15, each part between 0 and 1."""
    part = lambda x, full: F.least(x / full, F.lit(1.0))
    recency = F.exp(-days_since / 30.0)
    return part(degree, 10.0) * 0.25 + part(transitions, 10.0) * 0.20 + recency * 0.20 + neighbours * 0.20 + part(accesses, 10.0) * 0.15


def recalled(queries: DataFrame, notes: DataFrame, k: int = 10) -> DataFrame:
    """query_id, note_id: the notes that share a word with a query, most shared words first, *k* per query."""
    from pyspark.sql import Window

    words = lambda df, key, text: df.select(key, F.explode(F.array_distinct(F.filter(F.split(F.lower(text), r"\W+"), lambda w: F.length(w) > 3))).alias("word"))
    met = words(queries, "query_id", "query").join(words(notes, "note_id", "note"), "word").groupBy("query_id", "note_id").agg(F.count(F.lit(1)).alias("shared"))
    w = Window.partitionBy("query_id").orderBy(F.desc("shared"), "note_id")
    return met.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
