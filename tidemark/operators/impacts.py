"""Impacts of events: sums by metric and unit, one row an event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.model import EventStore

METRICS = ("dead", "injured", "missing", "families", "persons")
PEOPLE = METRICS[3:]


def metric_sums(store: EventStore) -> DataFrame:
    """event, metric, total: casualties by kind and affected families and persons, in one bag."""
    casualties = store.casualty.groupBy("event", F.col("kind").alias("metric")).agg(F.sum("cnt").cast("decimal(38,6)").alias("total"))
    people = store.population.unpivot("event", ["families", "persons"], "metric", "value").filter("value IS NOT NULL")
    return casualties.unionByName(people.groupBy("event", "metric").agg(F.sum("value").cast("decimal(38,6)").alias("total")))


def damage_by_unit(store: EventStore) -> DataFrame:
    """event, unit, amount. Amounts of different units are never added."""
    return store.damage.filter("amount IS NOT NULL").groupBy("event", "unit").agg(F.sum("amount").alias("amount"))


def event_totals(store: EventStore, metrics: tuple[str, ...] = METRICS, only: DataFrame | None = None) -> DataFrame:
    """event and the sums of the given metrics, null where there is nothing to add up; of the events in ``only`` if given."""
    narrowed = lambda df: df if only is None else df.join(only.select("event"), "event", "left_semi")
    kinds, people = [m for m in metrics if m not in PEOPLE], [m for m in metrics if m in PEOPLE]
    parts = []
    if kinds:
        rows = narrowed(store.casualty.filter(F.col("kind").isin(*kinds)))
        parts.append(rows.groupBy("event").agg(*[F.sum(F.when(F.col("kind") == m, F.col("cnt"))).alias(m) for m in kinds]))
    if people:
        parts.append(narrowed(store.population).groupBy("event").agg(*[F.sum(m).alias(m) for m in people]))
    return parts[0] if len(parts) == 1 else parts[0].join(parts[1], "event", "full")


def damage_lists(store: EventStore, only: DataFrame | None = None) -> DataFrame:
    """event, damage and its unit if there is one unit, and damage_by_unit: all units with their amounts."""
    rows = damage_by_unit(store) if only is None else damage_by_unit(store).join(only.select("event"), "event", "left_semi")
    units = rows.groupBy("event").agg(F.count(F.lit(1)).alias("units"), F.max("amount").alias("one"), F.max("unit").alias("one_unit"), F.array_sort(F.collect_list(F.struct("unit", "amount"))).alias("damage_by_unit"))
    single = F.col("units") == 1
    return units.select("event", F.when(single, F.col("one").cast("decimal(38,6)")).alias("damage"), F.when(single, F.col("one_unit")).alias("damage_unit"), "damage_by_unit")


def _filled(df: DataFrame, metrics: tuple[str, ...], damage: bool) -> DataFrame:
    """Zeros for metrics without rows; no damage at all is 0 without a unit."""
    made = {m: F.coalesce(m, F.lit(0).cast("bigint")).cast("bigint") for m in metrics}
    if damage:
        made["damage"] = F.when(F.col("damage_by_unit").isNull(), F.lit(0).cast("decimal(38,6)")).otherwise(F.col("damage"))
    return df.withColumns(made)


def impacts(store: EventStore) -> DataFrame:
    """One row an event with any impact: the metrics (0 where absent), damage and its unit, and all damage by unit.

    With one unit, damage is its amount; with several it is null and only the list holds amounts; without any it is 0
    and the unit null.
    """
    joined = event_totals(store).join(damage_lists(store), "event", "full")
    return _filled(joined, METRICS, True).select("event", *METRICS, "damage", "damage_unit", "damage_by_unit")


def with_impacts(events: DataFrame, store: EventStore, metrics: tuple[str, ...] = METRICS, damage: bool = True, narrow: bool = False) -> DataFrame:
    """``events`` with the given metrics and, if wanted, their damage as in ``impacts``; zeros for events without any.

    Only what is asked for is read. ``narrow``: the events are few, so rows of others are dropped before they are added up.
    """
    only = events.select("event").distinct() if narrow else None
    out = events.join(event_totals(store, metrics, only), "event", "left") if metrics else events
    if damage:
        out = out.join(damage_lists(store, only), "event", "left")
    return _filled(out, metrics, damage)


def with_facets(events: DataFrame, store: EventStore) -> DataFrame:
    """``events`` with sorted lists of their distinct places and types (id and label)."""

    def facet(links: DataFrame, key: str, names: DataFrame, name_key: str, alias: str) -> DataFrame:
        labelled = links.join(names.select(F.col(name_key).alias(key), "label"), key, "left").groupBy("event", key).agg(F.max("label").alias("label"))
        entry = F.struct(F.lower(F.coalesce("label", key)).alias("order"), F.col(key).alias("id"), F.coalesce("label", key).alias("label"))
        return labelled.groupBy("event").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: F.struct(x["id"].alias("id"), x["label"].alias("label"))).alias(alias))

    places = facet(store.event_location, "code", store.location, "code", "locations")
    types = facet(store.event_type, "type_id", store.taxonomy, "id", "types")
    return events.join(places, "event", "left").join(types, "event", "left")
