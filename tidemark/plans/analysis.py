"""The analysis API: summary, counts, trends, rankings, histogram, calendar and stacks over filtered events."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.strings import spreadsheet_safe
from tidemark.model import EventStore
from tidemark.operators.events import EventFilter, filtered_events
from tidemark.operators.impacts import METRICS, PEOPLE, damage_by_unit, with_facets, with_impacts
from tidemark.session import durable

ALL = EventFilter()
CASUALTIES = METRICS[:3]


def event_count(store: EventStore, where: EventFilter = ALL) -> DataFrame:
    return filtered_events(store, where).agg(F.count_distinct("event").alias("n"))


def summary(store: EventStore, where: EventFilter = ALL) -> DataFrame:
    """Totals over the filtered events: one row."""
    events = with_impacts(filtered_events(store, where), store, damage=False, narrow=where != ALL)
    return events.agg(F.count(F.lit(1)).alias("records"), *[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in ("dead", "injured", "missing", "families", "persons")])


def summary_damage(store: EventStore, where: EventFilter = ALL) -> DataFrame:
    """Damage of the filtered events by unit."""
    return damage_by_unit(store).join(filtered_events(store, where).select("event"), "event", "left_semi").groupBy("unit").agg(F.sum("amount").alias("amount"))


def typed_events(store: EventStore, where: EventFilter = ALL, by_root: bool = False) -> DataFrame:
    """Each filtered event with each of its types once, or with each of their top-level ancestors (unknown types: themselves)."""
    pairs = filtered_events(store, where).join(store.event_type, "event")
    if not by_root:
        return pairs.withColumn("grp", F.col("type_id")).dropDuplicates(["event", "grp"])
    named = pairs.join(store.taxonomy_roots.withColumnRenamed("id", "type_id"), "type_id", "left")
    return named.withColumn("grp", F.coalesce("root", "type_id")).dropDuplicates(["event", "grp"])


def counts_by_type(store: EventStore, where: EventFilter = ALL, by_root: bool = False) -> DataFrame:
    return typed_events(store, where, by_root).groupBy("grp").agg(F.count(F.lit(1)).alias("events")).orderBy(F.desc("events"), F.lower("grp"))


def victim_trends(store: EventStore, where: EventFilter = ALL) -> DataFrame:
    """Casualties by year; starts that do not begin with four digits are left out."""
    events = with_impacts(filtered_events(store, where), store, CASUALTIES, damage=False, narrow=where != ALL)
    year = F.substring("start_date", 1, 4)
    return events.filter(year.rlike(r"^\d{4}$")).groupBy(year.alias("year")).agg(*[F.sum(m).alias(m) for m in CASUALTIES]).orderBy("year")


def region_rankings(store: EventStore, where: EventFilter = ALL, level: str = "Region") -> DataFrame:
    """Distinct events in each place of a level, those in places below it included."""
    places = store.location.filter(F.col("level") == level).select(F.col("code").alias("ancestor"), "label")
    inside = store.location_closure.join(places, "ancestor").select(F.col("descendant").alias("code"), F.col("ancestor").alias("region"), "label")
    events = filtered_events(store, where).select("event").join(store.event_location, "event")
    return events.join(inside, "code").groupBy("region", "label").agg(F.count_distinct("event").alias("events")).orderBy(F.desc("events"), "label", "region")


def type_rankings(store: EventStore, where: EventFilter = ALL) -> DataFrame:
    """Deaths by type; an event counts in full under each of its types."""
    return with_impacts(typed_events(store, where), store, ("dead",), damage=False, narrow=where != ALL).groupBy("grp").agg(F.sum("dead").alias("dead")).orderBy(F.desc("dead"), F.lower("grp"))


def damage_histogram(store: EventStore, where: EventFilter = ALL, bins: int = 10, unit: str | None = None) -> DataFrame:
    """Bins of equal width between the least and the largest damage of each unit, empty ones included.

    The largest amount is in the last bin. A unit whose amounts are all (nearly) equal has one bin.
    """
    if bins < 1 or unit is not None and not re.fullmatch(r"[A-Za-z0-9_-]+", unit):
        raise ValueError("bins must be positive and unit a local name")
    amounts = damage_by_unit(store).join(filtered_events(store, where).select("event"), "event", "left_semi").withColumn("v", F.col("amount").cast("double"))
    if unit is not None:
        amounts = amounts.filter(F.col("unit") == unit)
    amounts = durable(amounts.select("unit", "v"))  # for the range and for the bins
    ranges = amounts.groupBy("unit").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("n"))
    ranges = ranges.withColumn("flat", F.abs(F.col("high") - F.col("low")) <= 1e-9 * F.greatest(F.abs("high"), F.abs("low"))).withColumn("width", (F.col("high") - F.col("low")) / bins)
    place = F.when(F.col("flat"), 0).otherwise(F.least(F.floor((F.col("v") - F.col("low")) / F.col("width")), F.lit(bins - 1))).cast("int")
    counted = amounts.join(ranges, "unit").groupBy("unit", place.alias("bin")).agg(F.count(F.lit(1)).alias("events"))
    frame = ranges.withColumn("bin", F.explode(F.when(F.col("flat"), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(bins - 1)))))
    upper = F.when(F.col("flat") | (F.col("bin") == bins - 1), F.col("high")).otherwise(F.col("low") + (F.col("bin") + 1) * F.col("width"))
    return frame.join(counted, ["unit", "bin"], "left").select("unit", "bin", (F.col("low") + F.col("bin") * F.col("width")).alias("lower"), upper.alias("upper"), F.coalesce("events", F.lit(0)).alias("events"))


def damage_vs_affected(store: EventStore, where: EventFilter = ALL) -> DataFrame:
    """A point for each filtered event and unit of its damage."""
    events = with_impacts(filtered_events(store, where), store, PEOPLE, narrow=where != ALL)
    points = events.select("event", "event_name", "families", "persons", F.explode("damage_by_unit").alias("d"))
    return points.select("event", "event_name", "d.unit", F.col("d.amount").alias("amount"), "families", "persons")


def calendar(store: EventStore, where: EventFilter = ALL, digits: int = 4, prefix: str | None = None, casualties: bool = False) -> DataFrame:
    """Events (and casualties) by the first ``digits`` characters of the start: 4 for years, 7 for months, 10 for days."""
    events = filtered_events(store, where)
    if prefix is not None:
        if not re.fullmatch(r"\d{4}(-\d{2}(-\d{2})?)?", prefix):
            raise ValueError("prefix must be a year, month or day")
        events = events.filter(F.col("start_date").startswith(prefix))
    period = F.substring("start_date", 1, digits)
    if casualties:
        events = with_impacts(events, store, CASUALTIES, damage=False, narrow=where != ALL or prefix is not None)
    sums = [F.sum(F.col("dead") + F.col("injured") + F.col("missing")).alias("casualties")] if casualties else []
    return events.filter(F.length(period) == digits).groupBy(period.alias("period")).agg(F.count(F.lit(1)).alias("events"), *sums).orderBy("period")


def category_stacks(store: EventStore, where: EventFilter = ALL, month_of_year: bool = False) -> DataFrame:
    """Events by month (or month of year) and top-level type; starts shorter than a month are left out."""
    period = F.substring("start_date", 6, 2) if month_of_year else F.substring("start_date", 1, 7)
    return typed_events(store, where, by_root=True).filter(F.length("start_date") >= 7).groupBy(period.alias("period"), "grp").agg(F.count(F.lit(1)).alias("events"))


def sliding_periods(stacks: DataFrame, before: int = 15) -> DataFrame:
    """Events of each period and of the ``before`` periods ahead of it, by type."""
    w = Window.partitionBy("grp").orderBy("period").rowsBetween(-before, 0)
    return stacks.withColumn("recent", F.sum("events").over(w))


def export_rows(store: EventStore, where: EventFilter = ALL) -> DataFrame:
    """The rows of the CSV export: joined lists, one damage cell, and no cell that a spreadsheet takes for a formula."""
    events = with_facets(with_impacts(filtered_events(store, where), store, narrow=where != ALL), store)
    names = lambda c: F.array_join(F.transform(c, lambda x: x["label"]), "; ")
    several = F.coalesce(F.size("damage_by_unit"), F.lit(0)) > 1
    listed = F.array_join(F.transform("damage_by_unit", lambda d: F.concat(d["amount"].cast("double").cast("string"), F.lit(" "), d["unit"])), " | ")
    return events.select(
        "event", spreadsheet_safe(F.coalesce("event_name", F.lit("(unnamed event)"))).alias("event_name"), "event_class", "source",
        F.substring("start_date", 1, 10).alias("start"), F.substring("end_date", 1, 10).alias("end"), names("locations").alias("locations"), names("types").alias("types"),
        "dead", "injured", "missing", "families", "persons",
        F.when(several, listed).otherwise(F.coalesce(F.col("damage").cast("double"), F.lit(0.0)).cast("string")).alias("damage"),
        F.when(several, "multiple").otherwise(F.coalesce("damage_unit", F.lit(""))).alias("damage_unit"),
    )


def map_events(store: EventStore, where: EventFilter = ALL) -> DataFrame:
    """The map's list: alternates stay, a type is demanded; one row an event with its types and number of deaths."""
    events = filtered_events(store, where, suppress=False)
    types = store.event_type.groupBy("event").agg(F.array_join(F.array_sort(F.collect_set("type_id")), ", ").alias("types"))
    dead = store.casualty.filter("kind = 'dead'").groupBy("event").agg(F.sum("cnt").alias("dead"))
    return events.join(types, "event").join(dead, "event", "left").select("event", "event_name", "start_date", "types", "dead")


def filter_options(store: EventStore) -> DataFrame:
    """What events can be filtered by: kind (place, type, class, source), id, label, parent and the number of events below."""
    dated = store.event.filter("start_date IS NOT NULL").select("event", "event_class", "source")
    below = lambda links, key, closure: links.join(dated.select("event"), "event", "left_semi").join(closure.withColumnRenamed("descendant", key), key).groupBy(F.col("ancestor").alias("id")).agg(F.count_distinct("event").alias("events"))
    places = store.location.select(F.lit("place").alias("kind"), F.col("code").alias("id"), "label", "parent").join(below(store.event_location, "code", store.location_closure), "id", "left")
    types = store.taxonomy.select(F.lit("type").alias("kind"), "id", "label", "parent").join(below(store.event_type, "type_id", store.taxonomy_closure), "id", "left")
    plain = [dated.groupBy(F.col(c).alias("id")).agg(F.count(F.lit(1)).alias("events")).select(F.lit(kind).alias("kind"), "id", F.col("id").alias("label"), F.lit(None).cast("string").alias("parent"), "events") for kind, c in (("class", "event_class"), ("source", "source"))]
    out = places.unionByName(types)
    for part in plain:
        out = out.unionByName(part)
    return out.na.fill(0, ["events"]).select("kind", "id", "label", "parent", "events")


def top_regions(store: EventStore, where: EventFilter = ALL, most: int = 8) -> DataFrame:
    """The first of the region rankings, as a bar chart shows them."""
    return region_rankings(store, where).orderBy(F.desc("events"), "label", "region").limit(most)


def instance_counts(store: EventStore) -> DataFrame:
    """Events of each class and type, those without a start included."""
    return store.event.join(store.event_type, "event").groupBy("event_class", "type_id").agg(F.count_distinct("event").alias("events"))
