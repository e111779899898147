"""Scores and classes of answers, deals and rewards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .json_text import json_body

# The base chance of winning by stage.
STAGE_CHANCE = {
    "lead": 0.05, "discovery": 0.15, "evaluation": 0.35, "proposal": 0.55, "negotiation": 0.75, "closed_won": 1.0, "closed_lost": 0.0,
}


def lookup(values: dict, key: Column, default=None) -> Column:
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def judged(score: Column) -> Column:
    """1, a half or 0; null counts as 0."""
    return F.when(score >= 0.75, 1.0).when(score >= 0.25, 0.5).otherwise(0.0)


def judged_by_words(answer: Column) -> Column:
    """A number in a judge's words (1.0, then 0.5, then 0.0), else a one or "correct", else "partial"."""
    a = F.lower(answer)
    has = lambda w: F.contains(a, F.lit(w))
    number = F.when(has("1.0"), 1.0).when(has("0.5"), 0.5).when(has("0.0"), 0.0)
    return F.coalesce(number, F.when(has("1") | has("correct"), 1.0).when(has("partial"), 0.5).otherwise(0.0))


def does_not_know(answer: Column) -> Column:
    return F.contains(F.lower(answer), F.lit("i don't know"))


def win_chance(stage: Column, champion: Column, pain_points: Column, positive: Column, open_objection: Column) -> Column:
    """Base chance of the stage, with signals added, kept between 0 and 1."""
    bonus = lambda c, x: F.when(c, F.lit(x)).otherwise(0.0)
    raw = lookup(STAGE_CHANCE, stage, 0.1) + bonus(champion, 0.10) + bonus(pain_points >= 3, 0.05) + bonus(positive, 0.05) - bonus(open_objection, 0.10)
    return F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))


def recommendation(chance: Column) -> Column:
    return (
        F.when(chance > 0.7, "close: remove the last blockers")
        .when(chance > 0.4, "engage the decision maker, resolve objections")
        .when(chance > 0.2, "review the qualification")
        .otherwise("consider leaving the deal")
    )


def reward(correct: Column, precision: Column, coherence: Column, retrieved: Column) -> Column:
    """Correctness, a part for precision and temporal coherence, less a little per retrieved item."""
    return correct * 1.0 + precision * 0.3 + coherence * 0.2 - retrieved * 0.1


def judged_json(answer: Column) -> Column:
    """The clamped ``score`` of a judge's JSON; 0 where there is none."""
    return judged(F.get_json_object(json_body(answer), "$.score").try_cast("double"))


def judged_overall(answer: Column) -> Column:
    """The ``overall`` score of a judge's JSON; a half where there is none."""
    return F.coalesce(F.get_json_object(json_body(answer), "$.overall").try_cast("double"), F.lit(0.5))


def gold_text(gold: Column) -> Column:
    """A list of accepted answers as one text of alternatives."""
    return F.array_join(gold, " | ")


def judged_answer(hypothesis: Column, answer: Column) -> Column:
    """:func:`judged_json` of a judge's *answer*; 0 where there is no hypothesis to judge."""
    given = F.trim(F.coalesce(hypothesis, F.lit(""))) != ""
    return F.when(given, judged_json(answer)).otherwise(0.0)


def topic(fact: Column) -> Column:
    """job, interests, family or background, by the first list of words that has one in the fact."""
    return F.when(_has_any(fact, "work", "job", "career"), "job").when(_has_any(fact, "hobby", "like", "enjoy", "love"), "interests").when(
        _has_any(fact, "family", "children", "married"), "family"
    ).otherwise("background")


def _has_any(text: Column, *words: str) -> Column:
    return F.rlike(F.lower(text), F.lit("|".join(words)))
