"""JSON inside model answers: extraction with fallbacks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_answer(text: Column) -> Column:
    """The field ``answer`` of a JSON object, also of a damaged one; null if there is none."""
    quoted = F.nullif(F.regexp_extract(text, r'"answer"\s*:\s*"([^"]+)"', 1), F.lit(""))
    number = F.nullif(F.regexp_extract(text, r'"answer"\s*:\s*(\d+)', 1), F.lit(""))
    return F.trim(F.coalesce(F.get_json_object(text, "$.answer"), quoted, number))


def json_body(text: Column) -> Column:
    """The JSON object of an answer: as it is, in a fence, or between the outer braces; null if none parses."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    outer = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    ok = lambda t: F.when(F.try_parse_json(t).isNotNull() & (t != ""), t)
    return F.coalesce(ok(F.trim(text)), ok(fenced), ok(outer))


def scalar_equal(a: Column, b: Column) -> Column:
    """Equal as numbers where both are numbers, else as trimmed strings without regard to case."""
    x, y = a.try_cast("double"), b.try_cast("double")
    return F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(F.lower(F.trim(a)) == F.lower(F.trim(b)))


def list_equal_unordered(a: Column, b: Column) -> Column:
    """Equal as multisets of trimmed, lower-cased strings."""
    clean = lambda x: F.array_sort(F.transform(x, lambda v: F.lower(F.trim(v))))
    return clean(a) == clean(b)


def contains_run(words: Column, run: Column) -> Column:
    """The list *run* occurs in *words* without gaps; an empty run does not."""
    n, k = F.size(words), F.size(run)
    starts = F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1)))
    return (k > 0) & (k <= n) & F.exists(starts, lambda i: F.slice(words, i, k) == run)


def label_fields(label: Column) -> Column:
    """The fields of a label as a map of JSON texts (quotes of either kind); a label that is no object is its field ``raw``."""
    parsed = F.from_json(label, "map<string,string>")
    return F.when(F.startswith(F.ltrim(label), F.lit("{")) & (F.size(parsed) > 0), parsed).otherwise(F.create_map(F.lit("raw"), label))


def _items(value: Column) -> Column:
    """A JSON list, or the parts between commas of any other text."""
    is_list = F.startswith(F.ltrim(value), F.lit("["))
    return F.when(is_list, F.from_json(value, "array<string>")).otherwise(F.split(value, ","))


def _plain(items: Column) -> Column:
    """Numbers written one way, texts trimmed and lower-cased, in order."""
    return F.array_sort(F.transform(items, lambda v: F.coalesce(v.try_cast("double").cast("string"), F.lower(F.trim(v)))))


def arithmetic_match(response: Column, label: Column) -> Column:
    """A response answers a label: its ``answer``, its ``unordered_list``, or all of its other fields are equal.

    Numbers compare as numbers.  A response without JSON matches if it holds the label's answer as text.
    """
    want = label_fields(label)
    got = F.from_json(json_body(response), "map<string,string>")
    field = lambda m, k: F.try_element_at(m, k if isinstance(k, Column) else F.lit(k))
    a, b = field(want, "answer"), field(got, "answer")
    lists = F.startswith(a, F.lit("[")) & F.startswith(b, F.lit("["))
    one = F.when(lists, _plain(_items(a)) == _plain(_items(b))).otherwise(scalar_equal(a, b))
    items = _plain(_items(field(want, "unordered_list"))) == _plain(_items(F.coalesce(field(got, "unordered_list"), b)))
    rest = F.map_filter(want, lambda k, _: ~k.isin("answer", "unordered_list", "explanation", "raw"))
    fields = (F.size(rest) > 0) & F.forall(F.map_keys(rest), lambda k: F.coalesce(scalar_equal(field(rest, k), field(got, k)), F.lit(False)))
    no = F.lit(False)
    with_json = F.coalesce(one, no) | F.coalesce(items, no) | F.coalesce(fields, no)
    return F.when(got.isNull(), F.coalesce(F.contains(F.lower(response), F.lower(F.trim(a))), no)).otherwise(with_json)


def semantic_match(response: Column, label: Column, timeline: Column) -> Column:
    """A response answers a label: equal but for case; a run of entities for timelines; else a number, entity or year in it."""
    p, g = F.trim(response), F.trim(label)
    wanted = F.transform(F.split(F.lower(g), ","), lambda v: F.trim(v))
    named = F.transform(F.regexp_extract_all(p, F.lit(r"(?i)E\d+"), F.lit(0)), lambda v: F.lower(v))
    whole = F.rlike(p, F.concat(F.lit(r"(?i)\b"), g, F.lit(r"\b")))
    known = F.rlike(g, F.lit(r"^(?i:E?\d+)$"))
    year = F.rlike(g, F.lit(r"^\d{4}$")) & F.contains(p, g)
    other = F.when(known, whole | year).otherwise(False)
    return F.coalesce((F.lower(p) == F.lower(g)) | F.when(timeline, contains_run(named, wanted)).otherwise(other), F.lit(False))
