"""Times as seconds since 1970 and back, dates in free text, and wordings of durations; all in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400.0
# The months, in order.
MONTHS = (
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
)


def epoch_seconds(ts: Column | str) -> Column:
    """Seconds since 1970 of a timestamp without zone, whatever the session's zone is."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c.cast("timestamp_ntz")) / F.lit(1e6)


def from_epoch(seconds: Column) -> Column:
    """The timestamp without zone of seconds since 1970."""
    return F.timestamp_add("MICROSECOND", F.round(seconds * 1_000_000).cast("long"), F.lit("1970-01-01").cast("timestamp_ntz"))


def _count(n: Column, unit: str, before: str = "", after: str = " ago") -> Column:
    return F.concat(F.lit(before), n.cast("string"), F.when(n == 1, f" {unit}").otherwise(f" {unit}s"), F.lit(after))


def humanized(seconds: Column) -> Column:
    """today, yesterday, days, weeks, about months, about years; months have 30 days and years 365."""
    days = seconds / DAY
    whole = lambda x: F.floor(x).cast("long")
    months = whole(days / 30)
    return (
        F.when(days < 1, "today")
        .when(days < 2, "yesterday")
        .when(days < 7, F.concat(whole(days).cast("string"), F.lit(" days ago")))
        .when(days < 30, _count(whole(days / 7), "week"))
        .when(days < 365, _count(months, "month", "about "))
        .when(days < 730, F.concat(F.lit("about "), months.cast("string"), F.lit(" months ago")))
        .otherwise(F.concat(F.lit("about "), F.format_string("%.1f", days / 365), F.lit(" years ago")))
    )


def humanized_short(seconds: Column) -> Column:
    """The variant with "~", with a wording for the future and no case between one and two years."""
    days = seconds / DAY
    whole = lambda x: F.floor(x).cast("long")
    return (
        F.when(seconds < 0, "in the future")
        .when(days < 1, "today")
        .when(days < 2, "yesterday")
        .when(days < 7, F.concat(whole(days).cast("string"), F.lit(" days ago")))
        .when(days < 30, _count(whole(days / 7), "week", "~"))
        .when(days < 365, _count(whole(days / 30), "month", "~"))
        .otherwise(F.concat(F.lit("~"), F.format_string("%.1f", days / 365), F.lit(" years ago")))
    )


def season_period(ts: Column) -> Column:
    """early, mid, late summer/fall or late, and the year."""
    m = F.month(ts)
    season = F.when(m < 4, "early").when(m < 7, "mid").when(m < 10, "late summer/fall").otherwise("late")
    return F.concat_ws(" ", season, F.year(ts).cast("string"))


def month_period(ts: Column) -> Column:
    return F.date_format(ts, "MMMM yyyy")


def life_period(ts: Column) -> Column:
    """early, summer or fall with the year from 2023 to 2025, early 2026, else the year alone."""
    y, m = F.year(ts), F.month(ts)
    part = F.when(m < 6, "early").when(m < 9, "summer").otherwise("fall")
    year = y.cast("string")
    return F.when(y.between(2023, 2025), F.concat_ws(" ", part, year)).when(y == 2026, F.lit("early 2026")).otherwise(year)


def duration_words(years: Column) -> Column:
    n = years.cast("string")
    return (
        F.when(years == 0, "less than a year")
        .when(years == 1, "1 year")
        .when(years <= 2, F.concat(n, F.lit(" years (brief)")))
        .when(years <= 5, F.concat(n, F.lit(" years")))
        .when(years <= 10, F.concat(n, F.lit(" years (extended)")))
        .otherwise(F.concat(n, F.lit(" years (long-standing)")))
    )


def relative_years(reference: Column, target: Column) -> Column:
    d = target - reference
    return F.when(d == 0, "at the same time").when(d > 0, _count(d, "year", after=" later")).otherwise(_count(-d, "year", after=" earlier"))


def _month_number(name: Column) -> Column:
    """1 to 12 of a full or three-letter month name; null otherwise."""
    names = {m: i + 1 for i, m in enumerate(MONTHS)}
    names |= {m[:3]: i + 1 for i, m in enumerate(MONTHS)}
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.lower(name))


def _made(year: Column, month: Column, day: Column, hour=0, minute=0) -> Column:
    """Null where the parts make no time."""
    two = lambda x: F.lpad((x if isinstance(x, Column) else F.lit(x)).cast("string"), 2, "0")
    text = F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), two(month), F.lit("-"), two(day), F.lit(" "), two(hour), F.lit(":"), two(minute), F.lit(":00"))
    return text.try_cast("timestamp_ntz")


def parsed_date(text: Column, reference: Column) -> Column:
    """``YYYY-MM-DD``, ``Month D YYYY`` or ``Month D`` (in the reference's year); null for anything else."""
    t = F.regexp_replace(F.trim(text), ",", "")
    iso = F.when(F.rlike(t, F.lit(r"^\d{4}-\d{2}-\d{2}$")), F.concat(t, F.lit(" 00:00:00")).try_cast("timestamp_ntz"))
    pattern = r"^([A-Za-z]+)\s+(\d{1,2})(?:\s+(\d{4}))?$"
    part = lambda i: F.nullif(F.regexp_extract(t, pattern, i), F.lit(""))
    year = F.coalesce(part(3).cast("int"), F.year(reference))
    return F.coalesce(iso, _made(year, _month_number(part(1)), part(2).cast("int")))


def parsed_session_date(text: Column) -> Column:
    """``2023/05/20 (Sat) 02:21``."""
    pattern = r"^\s*(\d{4})/(\d{2})/(\d{2})\s+\([A-Za-z]+\)\s+(\d{2}):(\d{2})"
    return _made(*(F.nullif(F.regexp_extract(text, pattern, i), F.lit("")) for i in range(1, 6)))


def parsed_chat_date(text: Column) -> Column:
    """``18 May 2023 at 1:39 pm``, with full or three-letter months."""
    pattern = r"(?i)^\s*(\d{1,2})\s+(\w+)\s+(\d{4})\s+at\s+(\d{1,2}):(\d{2})\s*(am|pm)"
    part = lambda i: F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))
    hour = part(4).cast("int") % 12 + F.when(F.lower(part(6)) == "pm", 12).otherwise(0)
    return _made(part(3), _month_number(part(2)), part(1), hour, part(5))


def temporal_bounds(query: Column, reference: Column) -> Column:
    """struct(event_after, event_before, ingested_before) in seconds, read from a question.

    "in <month> [year]", then "last week", "last month" or "yesterday", then
    "before <date>" and "after <date>" set the event bounds, later rules over
    earlier ones; "as of <date>" sets the ingestion bound.
    """
    q, ref = F.lower(query), epoch_seconds(reference)
    found = lambda p, i=1: F.nullif(F.regexp_extract(q, p, i), F.lit(""))
    in_month = rf"\bin\s+({'|'.join(MONTHS)})(?:\s+(\d{{4}}))?"
    month = _month_number(found(in_month))
    first = _made(F.coalesce(found(in_month, 2).cast("int"), F.year(reference)), month, F.lit(1))
    days = F.when(F.contains(q, F.lit("last week")), 7).when(F.contains(q, F.lit("last month")), 30).when(F.contains(q, F.lit("yesterday")), 1)
    back = ref - days * DAY
    date = r"(\d{4}-\d{2}-\d{2}|\w+\s+\d+,?\s*\d*)"
    bound = lambda word: epoch_seconds(parsed_date(found(rf"{word}\s+{date}"), reference))
    return F.struct(
        F.coalesce(bound("after"), back, epoch_seconds(first)).alias("event_after"),
        F.coalesce(bound("before"), F.when(days.isNotNull(), ref), epoch_seconds(F.add_months(first, 1).cast("timestamp_ntz"))).alias("event_before"),
        epoch_seconds(parsed_date(found(r"as of\s+(\d{4}-\d{2}-\d{2}|\w+\s+\d+)"), reference)).alias("ingested_before"),
    )


def worded_session_date(text: Column) -> Column:
    """``May 20, 2023 at 02:21`` of a session's date; any other text as it is."""
    return F.coalesce(F.date_format(parsed_session_date(text), "MMMM dd, yyyy 'at' HH:mm"), text)


def worded_chat_date(text: Column) -> Column:
    """``May 18, 2023 at 01:39 PM`` of a chat's date; any other text as it is."""
    return F.coalesce(F.date_format(parsed_chat_date(text), "MMMM dd, yyyy 'at' hh:mm a"), text)
