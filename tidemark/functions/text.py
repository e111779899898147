"""String functions as Column expressions; the one that SQL lacks (F.ratio) as an Arrow UDF."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .json_text import json_answer


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_name(name: Column | str) -> Column:
    """Lower-cased, trimmed, then dashes and underscores as blanks (in this order)."""
    return F.translate(F.trim(F.lower(col(name))), "-_", "  ")


def contains_either(a: Column, b: Column) -> Column:
    """One holds the other; an empty string holds nothing."""
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two strings; the argument order counts."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def match_score(mention: Column, known: Column) -> Column:
    """Ratio of the normalised names, at least 0.9 where one contains the other."""
    return normal_score(normalize_name(mention), normalize_name(known))


def normal_score(a: Column, b: Column) -> Column:
    """:func:`match_score` of names that are normalised already."""
    score = ratio(a, b)
    return F.when(contains_either(a, b), F.greatest(score, F.lit(0.9))).otherwise(score)


def occurrences(text: Column, keyword: Column) -> Column:
    """Case-folded, non-overlapping occurrences of a keyword; none for an empty one."""
    t, k = F.lower(text), F.lower(keyword)
    n = (F.length(t) - F.length(F.replace(t, k, F.lit("")))) / F.length(k)
    return F.when(F.length(k) > 0, n.cast("long")).otherwise(F.lit(0).cast("long"))


def word_count(text: Column) -> Column:
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " "))).cast("long")


def reading_minutes(text: Column, per_minute: int = 200) -> Column:
    return F.greatest(F.lit(1), F.floor(word_count(text) / per_minute)).cast("long")


def speech_seconds(text: Column) -> Column:
    return word_count(text) * F.lit(0.4)


def middle_truncated(text: Column, max_chars: int) -> Column:
    """Head and tail of a text that is too long, with a mark between."""
    half = max_chars // 2 - 50
    mark = "\n\n[... content truncated due to length ...]\n\n"
    cut = F.concat(F.substring(text, 1, half), F.lit(mark), F.right(text, F.lit(half)))
    return F.when(F.length(text) > max_chars, cut).otherwise(text)


def query_hash(text: Column) -> Column:
    """The first 16 hex digits of the MD5."""
    return F.substring(F.md5(text), 1, 16)


def normalize_answer(answer: Column) -> Column:
    """An answer out of JSON, quotes, full stops and lead-ins such as "Answer:"."""
    a = F.trim(answer)
    a = F.when(F.startswith(a, F.lit("{")), F.coalesce(json_answer(a), a)).otherwise(a)
    a = F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.trim(a), r"^\.+|\.+$", "")), r"^\"+|\"+$", ""))
    a = F.trim(F.regexp_replace(a, r"^'+|'+$", ""))
    for prefix in ("answer:", "the answer is", "answer is", "final answer:"):
        a = F.when(F.startswith(F.lower(a), F.lit(prefix)), F.trim(F.substring(a, len(prefix) + 1, 1 << 30))).otherwise(a)
    return F.regexp_replace(a, r"\.+$", "")


def answers_match(predicted: Column, label: Column) -> Column:
    """Equal but for case, or equal as comma-separated lists."""
    p, g = normalize_answer(predicted), normalize_answer(label)
    parts = lambda x: F.transform(F.split(x, ","), lambda v: F.trim(v))
    return F.coalesce(F.when(F.lower(p) == F.lower(g), True).when(F.contains(g, F.lit(",")), parts(p) == parts(g)), F.lit(False))


FACT_PATTERN = r"(E\d+) was the (R\d+) of (E\d+) from (\d{4}) to (\d{4})\."


def parsed_facts(text: Column) -> Column:
    """Array of (subject, role, object, start, end) of the sentences "E1 was the R2 of E3 from 1990 to 1995."."""
    sentences = F.regexp_extract_all(text, F.lit(FACT_PATTERN), F.lit(0))

    def fact(s: Column) -> Column:
        part = lambda i: F.regexp_extract(s, FACT_PATTERN, i)
        return F.struct(
            part(1).alias("subject"), part(2).alias("role"), part(3).alias("object"),
            part(4).cast("int").alias("start"), part(5).cast("int").alias("end"),
        )

    return F.transform(sentences, fact)


def email_templates(note: Column, max_body: int = 1500) -> Column:
    """Array of (touch, subject, body) of a sales note: one per "1st TOUCH - A" heading that has a subject line.

    Placeholders in double braces become [PERSONALIZE].
    """
    sections = F.split(note, r"(?i)(?=\b\d+(?:st|nd|rd|th) TOUCH - [A-Z])")
    subject = r"(?im)^\s*subject lines?[^:\n]*:[ \t]*([^\n]+)$"

    def template(s: Column) -> Column:
        body = F.regexp_extract(s, r"(?is)subject lines?[^:\n]*:[^\n]*\n(.*)$", 1)
        return F.struct(
            F.regexp_extract(s, r"(?i)^(\d+(?:st|nd|rd|th) TOUCH - [A-Z])", 1).alias("touch"),
            F.trim(F.translate(F.regexp_extract(s, subject, 1), '"“”', "")).alias("subject"),
            F.substring(F.trim(F.regexp_replace(F.regexp_replace(body, r"\{\{[^}]+\}\}", "[PERSONALIZE]"), r"^\s+|\s+$", "")), 1, max_body).alias("body"),
        )

    return F.filter(F.transform(sections, template), lambda t: (t["touch"] != "") & (t["subject"] != ""))
