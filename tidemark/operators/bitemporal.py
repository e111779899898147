"""Bi-temporal predicates: when something held, and when it became known; null bounds are open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _within(value: Column, after: Column | None, before: Column | None) -> Column:
    out = F.lit(True)
    if after is not None:
        out = out & (value >= after)
    if before is not None:
        out = out & (value <= before)
    return out


def entity_matches(first_seen, valid_from, valid_to, event_after=None, event_before=None, ingested_after=None, ingested_before=None) -> Column:
    """Known within the ingestion bounds; valid in a part of the event bounds, or first seen within them if it has no validity."""
    lit = lambda x: None if x is None else (x if isinstance(x, Column) else F.lit(x))
    known = _within(first_seen, lit(ingested_after), lit(ingested_before))
    atemporal = valid_from.isNull() & valid_to.isNull()
    overlaps = F.lit(True)
    if event_after is not None:
        overlaps = overlaps & F.coalesce(valid_to >= lit(event_after), F.lit(True))
    if event_before is not None:
        overlaps = overlaps & F.coalesce(valid_from <= lit(event_before), F.lit(True))
    return known & F.when(atemporal, _within(first_seen, lit(event_after), lit(event_before))).otherwise(overlaps)


def transition_matches(timestamp, ingested_at, valid_at, event_after=None, event_before=None, ingested_after=None, ingested_before=None) -> Column:
    """Both instants within their bounds; validity falls back to ingestion, ingestion to the timestamp."""
    lit = lambda x: None if x is None else (x if isinstance(x, Column) else F.lit(x))
    known = F.coalesce(ingested_at, timestamp)
    return _within(known, lit(ingested_after), lit(ingested_before)) & _within(F.coalesce(valid_at, known), lit(event_after), lit(event_before))


def temporal_status(valid_from: Column, valid_to: Column, reference: Column) -> Column:
    """ongoing, past, upcoming or atemporal."""
    return (
        F.when(valid_from.isNull() & valid_to.isNull(), "atemporal")
        .when(valid_to < reference, "past")
        .when(valid_from > reference, "upcoming")
        .otherwise("ongoing")
    )
