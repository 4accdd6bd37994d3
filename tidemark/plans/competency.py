"""The competency questions as functions of a graph; types and places are parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import hours_between
from tidemark.plans.graph import Graph, listed, literal_rows, narrowed, sources_of
from tidemark.session import written

EVENT, NAME = ":DisasterEvent", {"event_name": ":eventName"}


def types_of(graph: Graph, *types: str, narrower: bool = True, only=None) -> DataFrame:
    """event and type_id of whatever has one of the types (or a narrower one); ``only``: as in ``Graph.facts``."""
    wanted = listed(graph.within("skos:broader", *types, name="type_id")) if narrower else list(types)
    few = wanted if isinstance(wanted, list) else None
    found = graph.pairs(":hasDisasterType", ":hasDisasterSubtype", names=("event", "type_id"), to=few, only=only)
    return (found if few is not None else narrowed(found, "type_id", wanted)).distinct()


def events_of(graph: Graph, *types: str, narrower: bool = True) -> DataFrame:
    """event and type_id of disaster events with one of the types (or a narrower one)."""
    return types_of(graph, *types, narrower=narrower).join(graph.typed(EVENT, name="event"), "event", "left_semi")


def records(graph: Graph, link: str, types: tuple[str, ...] = (), places: tuple[str, ...] = (), at_event: bool = False) -> DataFrame:
    """event, node and location of records that events link to, by types of the event and places of the record.

    With ``at_event`` the record's location must be one of the event's own.
    """
    found = graph.paths((0, (link,)), (1, (":hasLocation",)), names=("event", "node", "location"), by="node")
    within = listed(graph.within(":isPartOf", *places, name="location")) if places else None
    if places:
        found = narrowed(found, "location", within)
    sure = graph.known(link, EVENT)
    if not (at_event or types) and sure:
        return found
    # What is known of other events need not be moved.
    found = graph.kept(found)
    only = graph.only(found, "event")
    if at_event:
        own = graph.pairs(":hasLocation", names=("event", "location"), of=(link,), only=only)
        found = found.join(own if within is None else narrowed(own, "location", within), ["event", "location"], "left_semi")
    if not sure:
        found = found.join(graph.typed(EVENT, name="event", only=only), "event", "left_semi")
    return found.join(types_of(graph, *types, only=only).select("event"), "event", "left_semi") if types else found


def having(graph: Graph, found: DataFrame, column: str, *predicates: str) -> DataFrame:
    """Rows whose node has a value of each of the predicates."""
    for p in predicates:
        found = found.join(graph.pairs(p, names=(column, "_o")).select(column), column, "left_semi")
    return found


def totals(graph: Graph, found: DataFrame, fields: dict[str, str], by: list[str], measured: bool = False, only=None) -> DataFrame:
    """Sums of a record's numbers (name: predicate), or of the values of its measures, by the given columns; missing ones count as 0.

    ``only``: a test that the nodes pass, if one is known.
    """
    if only is None:
        found = graph.kept(found)
        only = graph.only(found, "node")
    if measured:
        said = graph.paths((0, tuple(fields.values())), (1, ("qudt:numericValue",)), names=("node", None, "o"), p="p", by="node", only=only)
    else:
        said = graph.facts(*fields.values(), only=only).select(F.col("s").alias("node"), "p", "o")
    amount = F.col("o").try_cast("decimal(38,6)")
    sums = [F.coalesce(F.sum(F.when(F.col("p") == p, amount)), F.lit(0)).cast("decimal(38,6)").alias(n) for n, p in fields.items()]
    return found.join(said, "node", "left").groupBy(*by).agg(*sums)


def with_area(graph: Graph, found: DataFrame, area_class: str, region: str) -> DataFrame:
    """``found`` with each area of the class that its location lies in and that lies in ``region``: area, area_name."""
    areas = graph.typed(area_class, name="area").join(graph.above(":isPartOf").filter(F.col("ancestor") == region).select(F.col("descendant").alias("area")), "area", "left_semi")
    return graph.labelled(graph.lifted(":isPartOf", found, "location", "area").join(areas, "area", "left_semi"), "area", "area_name")


def attributed(graph: Graph, found: DataFrame) -> DataFrame:
    """``found`` with each organisation at the end of the event's chain of records: source."""
    traced = graph.traced((":startDate",))
    if traced is None:
        found = written(found)
        traced = sources_of(graph, found.select("event"))
    return found.join(traced.select(F.col("start").alias("event"), "source").distinct(), "event")


def cq1(graph: Graph, type_id: str) -> DataFrame:
    """Major events of a type, and whether they have related incidents."""
    typed = types_of if graph.implies(":MajorEvent", EVENT) else events_of
    events = graph.kept(typed(graph, type_id, narrower=False).select("event").join(graph.typed(":MajorEvent", name="event"), "event", "left_semi"))
    only = graph.only(events, "event")
    marked = events.join(graph.pairs(":hasRelatedIncident", names=("event", "incident"), only=only).select("event").distinct().withColumn("has", F.lit("Yes")), "event", "left")
    return graph.optional(marked, "event", NAME | {"start": ":startDate"}, only=only).filter("start IS NOT NULL").select("event", "event_name", "start", F.coalesce("has", F.lit("No")).alias("has_incident")).distinct()


def cq2(graph: Graph, types: tuple[str, ...]) -> DataFrame:
    """Events of exactly these types that have a start, with their places and the regions of those."""
    placed = having(graph, events_of(graph, *types, narrower=False), "event", ":startDate").join(graph.pairs(":hasLocation", names=("event", "location"), of=(":hasDisasterType", ":hasDisasterSubtype")), "event")
    regions = graph.lifted(":isPartOf", placed, "location", "region").join(graph.typed(":Region", name="region"), "region", "left_semi")
    return graph.labelled(graph.labelled(graph.optional(regions, "event", NAME | {"start": ":startDate"}), "location", "location_label"), "region", "region_label")


def cq3(graph: Graph, type_id: str) -> DataFrame:
    """Each type from this one up to the top with the number of events under it, 0 included."""
    ups = graph.above("skos:broader").filter(F.col("descendant") == type_id).select("ancestor").unionByName(literal_rows(graph.spark, [type_id], "ancestor"))
    links = graph.pairs(":hasDisasterType", names=("event", "type_id")).join(graph.typed(EVENT, name="event"), "event", "left_semi")
    counted = graph.lifted("skos:broader", links, "type_id", "ancestor").groupBy("ancestor").agg(F.count_distinct("event").alias("events"))
    return graph.labelled(ups.distinct().join(counted, "ancestor", "left").na.fill(0, ["events"]), "ancestor", "label")


def cq4(graph: Graph, type_id: str, regions: tuple[str, ...]) -> DataFrame:
    """Events below a type that have a start, with the provinces of their places within the regions, and the regions of those."""
    started = having(graph, events_of(graph, type_id), "event", ":startDate")
    placed = started.join(graph.pairs(":hasLocation", names=("event", "location"), of=(":hasDisasterType", ":hasDisasterSubtype")), "event").join(graph.within(":isPartOf", *regions, name="location"), "location", "left_semi")
    provinces = graph.lifted(":isPartOf", placed, "location", "province").join(graph.typed(":Province", name="province"), "province", "left_semi")
    above = graph.above(":isPartOf").toDF("province", "region").join(graph.typed(":Region", name="region"), "region", "left_semi")
    named = graph.labelled(graph.labelled(graph.labelled(provinces.join(above, "province"), "province", "province_name"), "region", "region_name"), "type_id", "type_label")
    described = graph.optional(named, "event", NAME | {"start": ":startDate"}).filter("province_name IS NOT NULL AND region_name IS NOT NULL")
    return described.select("event", "event_name", "start", "type_id", "type_label", "province_name", "region_name").distinct()


def cq5(graph: Graph, types: tuple[str, ...], regions: tuple[str, ...], year: int) -> DataFrame:
    """Events of a year by type and region."""
    started = graph.pairs(":startDate", names=("event", "start")).filter(F.substring("start", 1, 4) == str(year)).select("event")
    placed = events_of(graph, *types).join(started, "event", "left_semi").join(graph.pairs(":hasLocation", names=("event", "location"), of=(":hasDisasterType", ":hasDisasterSubtype")), "event")
    return graph.lifted(":isPartOf", placed, "location", "region").filter(F.col("region").isin(*regions)).groupBy("type_id", "region").agg(F.count_distinct("event").alias("events"))


def cq6(graph: Graph, region: str) -> DataFrame:
    """Displaced families and persons by event with a start in a region, of records that say both."""
    found = having(graph, having(graph, records(graph, ":hasAffectedPopulation", places=(region,), at_event=True), "event", ":startDate"), "node", ":displacedPersons", ":displacedFamilies")
    return totals(graph, found, {"families": ":displacedFamilies", "persons": ":displacedPersons"}, ["event"])


def cq7(graph: Graph, type_id: str, region: str) -> DataFrame:
    """Casualties by province of a region and kind."""
    found = graph.optional(with_area(graph, records(graph, ":hasCasualties", (type_id,), (region,), at_event=True), ":Province", region), "node", {"kind": ":isOfCasualtyType"}).filter("kind IS NOT NULL")
    return totals(graph, found, {"total": ":casualtyCount"}, ["area_name", "kind"])


def cq8(graph: Graph, type_id: str, region: str, year: int | None = None) -> DataFrame:
    """Evacuation centres by source."""
    found = records(graph, ":hasPreemptiveEvacuation", (type_id,), (region,))
    if year is not None:
        found = found.join(graph.pairs(":startDate", names=("event", "start")).filter(F.substring("start", 1, 4) == str(year)).select("event"), "event", "left_semi")
    return totals(graph, attributed(graph, found), {"total": ":evacuationCenters"}, ["source"])


INFRASTRUCTURE = {"commercial": ":commercialDamageAmount", "cross_sectoral": ":crossSectoralDamageAmount", "infrastructure": ":infraDamageAmount", "social": ":socialDamageAmount"}


def cq9(graph: Graph, type_id: str, region: str) -> DataFrame:
    """All damage to infrastructure by event in a region."""
    sums = totals(graph, records(graph, ":hasInfrastructureDamage", (type_id,), (region,), at_event=True), INFRASTRUCTURE, ["event"], measured=True)
    return sums.select("event", sum((F.col(c) for c in INFRASTRUCTURE), F.lit(0)).cast("decimal(38,6)").alias("total"))


def cq10(graph: Graph, type_id: str, region: str) -> DataFrame:
    """Damaged houses by province of a region."""
    found = with_area(graph, records(graph, ":hasHousingDamage", (type_id,), (region,), at_event=True), ":Province", region)
    return totals(graph, found, {"partially": ":partiallyDamagedHouses", "totally": ":totallyDamagedHouses"}, ["area_name"])


def cq11(graph: Graph, type_id: str, region: str) -> DataFrame:
    """Damage to agriculture by event in a region: amounts, and volume lost."""
    found = written(records(graph, ":hasAgricultureDamage", (type_id,), (region,), at_event=True))
    only = graph.only(found, "node")
    amounts = totals(graph, found, {"amount": ":agriDamageAmount", "loss": ":productionLossCost"}, ["event"], measured=True, only=only)
    return amounts.join(totals(graph, found, {"volume": ":productionLossVolume"}, ["event"], only=only), "event")


def described(graph: Graph, found: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Records with fields of theirs, the label of their place and the name of their event."""
    found = graph.kept(found)
    nodes, events = graph.only(found, "node"), graph.only(found, "event")
    return graph.optional(graph.labelled(graph.gathered(found, "node", fields, only=nodes), "location", "location_label"), "event", NAME, only=events)


def cq12(graph: Graph, type_id: str) -> DataFrame:
    """Seaports disrupted, with their status."""
    return described(graph, records(graph, ":hasSeaportDisruption", (type_id,)), {"port": ":portOrTerminalName", "status": ":portStatus"})


def cq13(graph: Graph, type_id: str) -> DataFrame:
    """Airports disrupted, with the hours between cancellation and resumption."""
    found = described(graph, records(graph, ":hasAirportDisruption", (type_id,)), {"port": ":portOrTerminalName", "cancelled": ":cancellationDateTime", "resumed": ":resumptionDateTime"})
    return found.withColumn("hours", hours_between(F.col("cancelled").try_cast("timestamp"), F.col("resumed").try_cast("timestamp")))


def cq14(graph: Graph, region: str) -> DataFrame:
    """Class suspensions in a region with their levels."""
    return described(graph, records(graph, ":hasClassSuspension", places=(region,)), {"from_level": ":fromClassLevel", "to_level": ":toClassLevel"})


def cq15(graph: Graph, place: str) -> DataFrame:
    """Assistance in a place by source and contributor."""
    found = described(graph, attributed(graph, records(graph, ":hasAssistance", places=(place,))), {"type": ":itemTypeOrNeeds", "org": ":contributingOrg", "measure": ":contributionAmount"})
    return graph.optional(found, "measure", {"contribution": "qudt:numericValue"}).drop("measure")


def cq16(graph: Graph, region: str) -> DataFrame:
    """Declarations of calamity by province of a region, as one text each."""
    found = described(graph, with_area(graph, records(graph, ":hasDeclarationOfCalamity", places=(region,), at_event=True), ":Province", region), {"date": ":resolutionDate"})
    line = F.concat(F.coalesce("event_name", F.lit("no name")), F.lit(" - "), F.coalesce("date", F.lit("unknown")), F.lit(" - "), F.coalesce("location_label", "location"))
    return found.groupBy("area_name").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("events"))


def cq17(graph: Graph, place: str) -> DataFrame:
    """Rescue units and equipment in a place."""
    return described(graph, records(graph, ":hasRescue", places=(place,)), {"unit": ":rescueUnit", "equipment": ":rescueEquipment"}).select("event", "event_name", "unit", "equipment").distinct()


def cq18(graph: Graph, region: str, income_class: str, level: str = ":Municipality", above: str = ":Province") -> DataFrame:
    """Municipalities of an income class with an event, and whether any such event had a pre-emptive evacuation."""
    towns = graph.typed(level, name="town").join(graph.within(":isPartOf", region, name="town"), "town", "left_semi").join(graph.pairs(":incomeClassification", names=("town", "income")).filter(F.col("income") == income_class), "town", "left_semi")
    parents = graph.pairs(":isPartOf", names=("town", "province")).join(graph.typed(above, name="province"), "province", "left_semi")
    placed = graph.kept(towns.join(parents, "town"))
    events = graph.kept(narrowed(graph.pairs(":hasLocation", names=("event", "town"), of=(":startDate",)), "town", placed.select("town")))
    only = graph.only(events, "event")
    events = events.join(graph.typed(EVENT, name="event", only=only), "event", "left_semi")
    evacuated = graph.pairs(":hasPreemptiveEvacuation", names=("event", "node"), only=only).select("event", F.lit(1).alias("pre")).distinct()
    found = events.join(placed, "town").join(evacuated, "event", "left").groupBy("town", "province").agg(F.max(F.coalesce("pre", F.lit(0))).alias("pre"))
    return graph.labelled(graph.labelled(found, "town", "t"), "province", "p").select(F.concat("t", F.lit(", "), "p").alias("loc"), F.when(F.col("pre") > 0, "Yes").otherwise("No").alias("evacuated"))


def cq19(graph: Graph, types: tuple[str, ...], sources: tuple[str, ...]) -> DataFrame:
    """Events of exactly these types by source."""
    return attributed(graph, events_of(graph, *types, narrower=False)).filter(F.col("source").isin(*sources)).groupBy("source").agg(F.count("event").alias("events"))


def cq20(graph: Graph) -> DataFrame:
    """Pairs of alternates with the names, starts and sources of either side."""
    side = attributed(graph, graph.optional(graph.typed(EVENT, name="event"), "event", NAME | {"start": ":startDate"}).filter("start IS NOT NULL"))
    first, second = side.toDF("e1", "name1", "d1", "s1"), side.toDF("e2", "name2", "d2", "s2")
    return graph.pairs("prov:alternateOf", names=("e1", "e2")).filter("e1 < e2").distinct().join(first, "e1").join(second, "e2")
