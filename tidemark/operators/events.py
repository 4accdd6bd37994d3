"""The shared event filter: class, date range, place and type subtrees, text, and suppression of alternates."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import day_of
from tidemark.model import EventStore

CLASSES = {"major": ["MajorEvent"], "incidents": ["Incident"], "all": ["MajorEvent", "Incident"]}


@dataclass(frozen=True)
class EventFilter:
    """What to look for. Lists mean any of; different settings must all hold. Raises ValueError for malformed values."""

    event_type: str = "all"
    start: str | None = None
    end: str | None = None
    locations: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    text: str | None = None

    def __post_init__(self):
        if self.event_type not in CLASSES:
            raise ValueError("event_type must be major, incidents or all")
        for day in (self.start, self.end):
            if day is not None:
                date.fromisoformat(day)
        if self.start and self.end and self.start > self.end:
            raise ValueError("start must not be after end")
        for name in ("locations", "types"):
            values = tuple(sorted(set(getattr(self, name))))
            if bad := [v for v in values if not re.fullmatch(r"[A-Za-z0-9_#&.-]+", v)]:
                raise ValueError(f"{name} must be local names: {bad}")
            object.__setattr__(self, name, values)


def suppressed(event: DataFrame, alternate: DataFrame) -> DataFrame:
    """Ids of events with a direct alternate that starts earlier, or on the same day with a smaller id.

    Only alternates with a start count. Independent of any filter, so it is worked out once for a data set.
    """
    starts = event.filter("start_date IS NOT NULL").select("event", day_of(F.col("start_date")).alias("day"))
    mine, other = starts.toDF("a", "my_day"), starts.toDF("b", "other_day")
    pairs = alternate.select("a", "b").join(mine, "a").join(other, "b")
    return pairs.filter("other_day < my_day OR (other_day = my_day AND b < a)").select(F.col("a").alias("event")).distinct()


def filtered_events(store: EventStore, where: EventFilter = EventFilter(), suppress: bool = True) -> DataFrame:  # noqa: B008
    """Events that satisfy the filter: event, source, event_class, event_name, start_date, end_date.

    The name falls back to the incident description. Events without a start are left out.
    """
    name = F.coalesce("event_name", "incident_description")
    found = (
        store.event.filter(F.col("event_class").isin(*CLASSES[where.event_type]) & F.col("start_date").isNotNull())
        .select("event", "source", "event_class", name.alias("event_name"), "start_date", "end_date")
    )
    day = day_of(F.col("start_date"))
    # The plain comparisons, which a scan can use, hold for every day in range.
    if where.start:
        found = found.filter((F.col("start_date") >= where.start) & (day >= where.start))
    if where.end:
        found = found.filter((F.col("start_date") <= where.end + "~") & (day <= where.end))
    if where.text:
        found = found.filter(F.contains(F.lower(F.concat(F.coalesce("event_name", F.lit("")), F.lit(" "), "event")), F.lower(F.lit(where.text))))
    if suppress:
        found = found.join(store.suppressed, "event", "left_anti")
    if where.locations:
        inside = store.location_closure.filter(F.col("ancestor").isin(*where.locations)).select(F.col("descendant").alias("code"))
        found = found.join(store.event_location.join(inside, "code", "left_semi").select("event"), "event", "left_semi")
    if where.types:
        below = store.taxonomy_closure.filter(F.col("ancestor").isin(*where.types)).select(F.col("descendant").alias("type_id"))
        found = found.join(store.event_type.join(below, "type_id", "left_semi").select("event"), "event", "left_semi")
    return found


#: Columns that a page of events can be sorted by.
SORTS = {"name": "event_name", "start": "start_date", "end": "end_date", "class": "event_class", "source": "source"}


def page(events: DataFrame, by: str = "start", descending: bool = True, offset: int = 0, limit: int = 25) -> DataFrame:
    """A page of events; ties by id. Missing values come first when ascending, last when descending."""
    key = F.desc_nulls_last(SORTS[by]) if descending else F.asc_nulls_first(SORTS[by])
    return events.orderBy(key, "event").offset(offset).limit(limit)
