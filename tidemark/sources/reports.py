"""Report tables: one declarative spec a table, one builder for all, and their triples.

A spec names the columns of a table and what they hold; the builder renames, fills, filters and casts with column
expressions. Header synonyms come as a parameter (header: canonical name), since reports change them from year to year.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dates, numbers, strings
from tidemark.functions.identity import part_iri
from tidemark.model import literal_triples
from tidemark.operators import reshape, sequence

PLACE = ["region", "province", "municipality"]


@dataclass
class TableSpec:
    """What a report table holds.

    ``times`` maps a result to its date column and, optionally, its time column; ``key`` and ``value`` mark summary rows:
    those with a key but no value are dropped.
    """

    name: str
    link: str  # from the event to a row's node
    cls: str
    texts: list[str] = field(default_factory=list)
    ints: list[str] = field(default_factory=list)
    floats: list[str] = field(default_factory=list)
    millions: list[str] = field(default_factory=list)
    times: dict[str, tuple[str, str | None]] = field(default_factory=dict)
    time_formats: list[str] = field(default_factory=lambda: ["d MMMM yyyy hh:mm a", "d MMMM yyyy HH:mm", "MMMM d, yyyy HH:mm", "d-MMM-yy HH:mm"])
    date_formats: list[str] = field(default_factory=lambda: ["d MMMM yyyy", "MMMM d, yyyy", "d-MMM-yy", "yyyy-MM-dd"])
    key: str | None = None
    value: str | None = None

    @property
    def fields(self) -> list[str]:
        return [*self.texts, *self.ints, *self.floats, *self.millions, *self.times]


def _span(first: str, second: str) -> dict[str, tuple[str, str | None]]:
    return {f"{first}DateTime": (f"{first}Date", f"{first}Time"), f"{second}DateTime": (f"{second}Date", f"{second}Time")}


# The tables of the situation reports, with the names that their columns have in the ontology.
TABLES = {
    spec.name: spec
    for spec in [
        TableSpec("affected_population", "hasAffectedPopulation", "AffectedPopulation", ints=["affectedBarangays", "affectedFamilies", "affectedPersons", "displacedFamilies", "displacedPersons", "evacuationCenters"], key="affectedPersons", value="affectedBarangays"),
        TableSpec("related_incidents", "hasRelatedIncident", "Incident", texts=["hasOrigType", "incidentStatus", "incidentDescription", "incidentActionsTaken", "remarks"], times={"startDateTime": ("startDate", "startTime")}),
        TableSpec("casualties", "hasCasualties", "Casualties", texts=["casualtyCause", "casualtyDataSource", "summary_type", "remarks"], ints=["qty"]),
        TableSpec("assistance_provided", "hasAssistance", "Assistance", texts=["itemTypeOrNeeds", "itemUnit", "itemSource", "remarks"], floats=["itemQuantity"], millions=["itemCost", "itemCostPerUnit"]),
        TableSpec("damage_to_infrastructure", "hasInfrastructureDamage", "InfrastructureDamage", texts=["infraDamageType", "infraDamageClassification", "infraName", "remarks"], ints=["numberInfraDamaged"], millions=["infraDamageAmount"]),
        TableSpec("damaged_houses", "hasHousingDamage", "HousingDamage", texts=["remarks"], ints=["totallyDamagedHouses", "partiallyDamagedHouses"], millions=["housingDamageAmount"]),
        TableSpec("agriculture", "hasAgricultureDamage", "AgricultureDamage", texts=["agriDamageClassification", "agriDamageType"], ints=["numberAgriDamaged"], floats=["productionLossVolume"], millions=["agriDamageAmount", "productionLossCost"]),
        TableSpec("pre-emptive_evacuation", "hasPreemptiveEvacuation", "PreemptiveEvacuation", ints=["preemptFamilies", "preemptPersons"], key="preemptPersons", value="qty"),
        TableSpec("roads_and_bridges", "hasRoadAndBridgesDamage", "RoadAndBridgesDamage", texts=["roadBridgeType", "roadBridgeStatus", "remarks"], times=_span("interruption", "restoration")),
        TableSpec("power", "hasPowerDisruption", "PowerDisruption", texts=["serviceProvider", "remarks"], times=_span("interruption", "restoration")),
        TableSpec("communication_lines", "hasCommunicationLineDisruption", "CommunicationLineDisruption", texts=["serviceProvider", "remarks"], times=_span("interruption", "restoration")),
        TableSpec("water", "hasWaterDisruption", "WaterDisruption", texts=["serviceProvider", "remarks"], times=_span("interruption", "restoration")),
        TableSpec("declaration_of_calamity", "hasDeclarationOfCalamity", "DeclarationOfCalamity", texts=["declarationType", "resolutionNumber", "remarks"], times={"resolutionDateTime": ("resolutionDate", None)}),
        TableSpec("class_suspension", "hasClassSuspension", "ClassSuspension", texts=["fromClassLevel", "toClassLevel", "remarks"], times=_span("cancellation", "resumption")),
        TableSpec("work_suspension", "hasWorkSuspension", "WorkSuspension", texts=["workType", "remarks"], times=_span("cancellation", "resumption")),
        TableSpec("stranded", "hasStrandedEvent", "StrandedEvent", texts=["portOrTerminalName", "remarks"], ints=["strandedPassengers", "strandedRollingCargoes", "strandedVessels", "strandedMotorbancas"]),
        TableSpec("seaport", "hasSeaportDisruption", "SeaportDisruption", texts=["portOrTerminalName", "portStatus", "remarks"], times=_span("cancellation", "resumption")),
        TableSpec("airport", "hasAirportDisruption", "AirportDisruption", texts=["portOrTerminalName", "portStatus", "remarks"], ints=["strandedPassengers"], times=_span("cancellation", "resumption")),
        TableSpec("flight", "hasFlightDisruption", "FlightDisruption", texts=["flightNumber", "flightRoute", "remarks"], times=_span("cancellation", "resumption")),
    ]
}


def build(cells: DataFrame, spec: TableSpec, headers: dict[str, str] | None = None) -> DataFrame:
    """The typed rows of a table of text cells: file, row, region, province, municipality and the spec's fields.

    ``cells`` has file and row; places are filled downwards within a file, a new region emptying those below. Missing
    columns are null; the text ``none`` is null; cells that are no number or date are null.
    """
    named = reshape.snake_columns(cells).withColumnsRenamed(headers or {})
    wanted = [*PLACE, *spec.texts, *spec.ints, *spec.floats, *spec.millions, *[c for pair in spec.times.values() for c in pair if c], *[c for c in (spec.key, spec.value) if c]]
    whole = named.select("file", "row", *[strings.none_to_null(F.col(c)).alias(c) if c in named.columns else F.lit(None).cast("string").alias(c) for c in dict.fromkeys(wanted)])
    filled = sequence.hierarchical_fill(whole, PLACE, ["file"], ["row"])
    if spec.key and spec.value:
        filled = reshape.collapse(filled, spec.value, spec.key)
    made = {c: numbers.to_int(F.col(c)) for c in spec.ints} | {c: numbers.to_float(F.col(c)) for c in spec.floats} | {c: numbers.to_millions(F.col(c)) for c in spec.millions}
    for name, (day, time) in spec.times.items():
        made[name] = dates.first_time(F.col(day), F.col(time), spec.time_formats, spec.date_formats) if time else dates.first_date(F.col(day), spec.date_formats).cast("timestamp")
    return filled.select("file", "row", *PLACE, *[made.get(c, F.col(c)).alias(c) for c in spec.fields]).na.drop(how="all", subset=spec.fields)


def rows_to_triples(rows: DataFrame, spec: TableSpec, graph: str, event: str = "event") -> DataFrame:
    """The nodes of a table's rows (with a column of event IRIs): link from the event, type, and a triple for each value."""
    nodes = rows.withColumn("node", part_iri(F.col(event), spec.name, F.col("row"))).withColumn("type", F.lit(f":{spec.cls}"))
    linked = literal_triples(nodes, event, {"node": f":{spec.link}"}, graph, "iri")
    typed = literal_triples(nodes, "node", {"type": "rdf:type"}, graph, "iri")
    return linked.unionByName(typed).unionByName(literal_triples(nodes, "node", {c: f":{c}" for c in spec.fields}, graph)).dropDuplicates()


def reconciled_evacuation(evacuation: DataFrame, population: DataFrame) -> DataFrame:
    """Evacuated people by place, from the table of evacuations and that of affected people: a full outer join on the place."""
    keys = {c: F.coalesce(c, F.lit("")) for c in PLACE}
    place = lambda df: df.withColumn("place", F.concat_ws("|", *keys.values()))
    left = place(evacuation).select("place", "preemptFamilies", "preemptPersons")
    right = place(population).select("place", "evacuationCenters", "displacedFamilies", "displacedPersons")
    return reshape.full_merge([left, right], "place")


def displaced_totals(df: DataFrame, inside: str, outside: str, total: str) -> DataFrame:
    """A total that a table lacks, of the people inside and outside of centres; missing ones count as none."""
    return df if total in df.columns else df.withColumn(total, F.coalesce(F.col(inside), F.lit(0)) + F.coalesce(F.col(outside), F.lit(0)))


def split_merged_values(df: DataFrame, columns: list[str], sample: int = 10, share: float = 0.5) -> DataFrame:
    """Spreads cells that hold the numbers of several columns over those columns.

    A column counts as merged if at least ``share`` of its first ``sample`` values by file and row (a bounded look at the
    data) hold several numbers; the commonest count says over how many columns to spread.
    """
    order = [c for c in ("file", "row") if c in df.columns]
    for i, column in enumerate(columns):
        some = df.filter(F.col(column).isNotNull())
        some = some.orderBy(*order) if order else some
        seen = [r[0].strip() for r in some.select(F.col(column).cast("string")).limit(sample).collect()]
        merged = [v for v in seen if re.fullmatch(r"[\d,.\-]+(?:\s+[\d,.\-]+)+", v)]
        if not merged or len(merged) < share * len(seen):
            continue
        n = Counter(len(v.split()) for v in merged).most_common(1)[0][0]
        if i + n <= len(columns):
            parts = F.split(F.trim(F.col(column)), r"\s+")
            df = df.withColumns({c: F.coalesce(F.try_element_at(parts, F.lit(j + 1)), F.lit(None)) for j, c in enumerate(columns[i : i + n])})
    return df


def repeated_headers(df: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows without those in which at least half of the filled cells repeat the column's name."""
    key = lambda c: F.regexp_replace(F.lower(c), r"[^a-z0-9]", "")
    same = sum((F.when(key(F.col(f"`{c}`").cast("string")) == re.sub(r"[^a-z0-9]", "", c.lower()), 1).otherwise(0) for c in df.columns), F.lit(0))
    filled = sum((F.when(F.col(f"`{c}`").isNotNull(), 1).otherwise(0) for c in df.columns), F.lit(0))
    return df.filter((filled == 0) | (same < filled * least))
