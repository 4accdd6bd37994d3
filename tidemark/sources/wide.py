"""Wide record tables: one row an event with all that is known of it, taken apart into entities and their triples.

An entity names a class, the link from the event, and the columns that describe it; one builder serves all of them.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dates, identity, numbers, strings
from tidemark.functions.identity import part_iri
from tidemark.model import literal_triples
from tidemark.operators import reshape

# Words that stand for no value.
SENTINELS = ["", "-", "Not applicable", "n.a.", "Not indicated"]
#: Places that are wider than any event of one place.
WIDE_PLACES = ("Philippines", "Mindanao", "Visayas", "Luzon")


@dataclass
class Entity:
    """What a class of records takes from a wide row; columns of ``amounts`` become measures with a unit."""

    cls: str
    link: str
    segment: str
    texts: list[str] = field(default_factory=list)
    ints: list[str] = field(default_factory=list)
    floats: list[str] = field(default_factory=list)
    amounts: list[str] = field(default_factory=list)

    @property
    def columns(self) -> list[str]:
        return [*self.texts, *self.ints, *self.floats, *self.amounts]


# The entities of the two wide sources, by the names of the ontology.
ARCHIVE = [
    Entity("Warning", "hasWarning", "warning", texts=["agencyLGUsPresentPreparedness", "warningReleased"]),
    Entity("PreemptiveEvacuation", "hasPreemptiveEvacuation", "evacuation", texts=["evacuationPlan"], ints=["evacuationCenters"]),
    Entity("Rescue", "hasRescue", "rescue", texts=["rescueEquipment", "rescueUnit"]),
    Entity("DeclarationOfCalamity", "hasDeclarationOfCalamity", "calamity", texts=["declarationOfCalamity"]),
    Entity("AffectedPopulation", "hasAffectedPopulation", "population", ints=["affectedBarangays", "affectedFamilies", "affectedPersons", "displacedFamilies", "displacedPersons"]),
    Entity("HousingDamage", "hasHousingDamage", "housing", ints=["totallyDamagedHouses", "partiallyDamagedHouses"]),
    Entity("InfrastructureDamage", "hasInfrastructureDamage", "infrastructure", amounts=["infraDamageAmount", "commercialDamageAmount", "socialDamageAmount", "crossSectoralDamageAmount"]),
    Entity("DamageGeneral", "hasDamageGeneral", "damage", amounts=["generalDamageAmount"]),
    Entity("PowerDisruption", "hasPowerDisruption", "power", texts=["powerAffected"]),
    Entity("CommunicationLineDisruption", "hasCommunicationLineDisruption", "communication", texts=["communicationAffected"]),
    Entity("RoadAndBridgesDamage", "hasRoadAndBridgesDamage", "roads", texts=["roadBridgeAffected"]),
    Entity("SeaportDisruption", "hasSeaportDisruption", "seaport", texts=["seaportsAffected"]),
    Entity("WaterDisruption", "hasWaterDisruption", "water", texts=["areDamsAffected", "isTapAffected"]),
    Entity("Assistance", "hasAssistance", "assistance", texts=["agencyLGUsPresentAssistance", "internationalOrgsPresent"], amounts=["allocatedFunds", "amountNGOs"]),
    Entity("Recovery", "hasRecovery", "recovery", texts=["srrDone", "policyChanges", "postTraining"], amounts=["postStructureCost"]),
]
CATALOGUE = [
    Entity("Assistance", "hasAssistance", "assistance", texts=["internationalOrgsPresent"], amounts=["contributionAID"]),
    Entity("Recovery", "hasRecovery", "recovery", amounts=["postStructureCost"]),
    Entity("DamageGeneral", "hasDamageGeneral", "damage", floats=["cpi"], amounts=["insuredDamage", "generalDamageAmount"]),
    Entity("AffectedPopulation", "hasAffectedPopulation", "population", ints=["affectedPersons", "displacedPersons"]),
]
CASUALTIES = {"dead": "Dead", "injured": "Injured", "missing": "Missing"}
# Kinds of relief items with their columns of cost and quantity, and what the kinds are called.
RELIEF = [
    ("goods", "itemCostGoods", "itemQtyGoods"), ("water", "itemCostWater", "itemQtyWater"), ("clothing", "itemCostClothing", "itemQtyClothing"),
    ("medicine", "itemCostMedicine", "itemQtyMedicine"), ("unspecified", "itemCostOthers1", None), ("general", "itemCostOthers2", None),
]
RELIEF_LABELS = {"goods": "Canned Goods, Rice, etc.", "water": "Water", "clothing": "Clothing", "medicine": "Medicine", "unspecified": "Unspecified", "general": "Unspecified"}
# Headers of the catalogue.
CATALOGUE_HEADERS = {
    "AID Contribution ('000 US$)": "contributionAID", "OFDA/BHA Response": "internationalOrgsPresent", "Magnitude": "hasMagnitude", "Magnitude Scale": "hasMagnitudeScale", "Latitude": "latitude", "Longitude": "longitude",
    "Total Deaths": "dead", "No. Injured": "injured", "No. Affected": "affectedPersons", "No. Homeless": "displacedPersons", "Reconstruction Costs, Adjusted ('000 US$)": "postStructureCost",
    "Insured Damage, Adjusted ('000 US$)": "insuredDamage", "Total Damage, Adjusted ('000 US$)": "generalDamageAmount", "CPI": "cpi", "Entry Date": "entryDate", "Last Update": "lastUpdateDate", "DisNo.": "id", "Event Name": "eventName", "Location": "hasLocation",
}


def no_sentinels(df: DataFrame, words: list[str] | None = None) -> DataFrame:
    """Texts that stand for no value become null, spaces around the others go."""
    texts = [c for c, kind in df.dtypes if kind == "string"]
    return df.withColumns({c: F.when(F.trim(c).isin(words or SENTINELS), None).otherwise(F.trim(c)) for c in texts})


def archive_rows(cells: DataFrame, headers: dict[str, str], first_row: int = 8) -> DataFrame:
    """The archive's rows with typed dates, ids and types, ready to be taken apart.

    ``cells`` has the texts of the sheet and ``row`` (from 1); headers that are not there are null. Rows without a date,
    a place or a start are left out. The general damage counts only where no part of it is known, and a note on the state
    of calamity that does not speak of one is a warning.
    """
    named = cells.withColumnsRenamed(headers)
    wanted = {c for e in ARCHIVE for c in e.columns} | set(headers.values()) | {"date", "eventName", "hasType", "hasSubtype", "hasLocation", "eventClass", "declarationOfCalamity", "agricultureDamageAmount", *CASUALTIES, *[c for r in RELIEF for c in r[1:] if c]}
    missing = {c: F.lit(None).cast("string") for c in sorted(wanted - set(named.columns))}
    rows = no_sentinels(named.withColumns(missing)).na.drop(subset=["date", "hasLocation"])
    span = dates.date_range(F.col("date"))
    calamity = F.coalesce(F.lower("declarationOfCalamity").contains("calamity"), F.lit(False))
    parts = ["infraDamageAmount", "agricultureDamageAmount", "commercialDamageAmount", "socialDamageAmount", "crossSectoralDamageAmount"]
    known = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in parts])
    made = {
        "rowNumber": (F.col("row") + first_row - 1).cast("int"), "startDate": span["start"], "endDate": span["end"], "eventName": F.replace(F.col("eventName"), F.lit('"'), F.lit("")),
        "warningReleased": F.when(~calamity, F.col("declarationOfCalamity")), "declarationOfCalamity": F.when(calamity, F.col("declarationOfCalamity")), "generalDamageAmount": F.when(~known, F.col("generalDamageAmount")),
    }
    rows = rows.withColumns(made).filter("startDate IS NOT NULL")
    key = F.lower(F.trim(F.concat_ws("|", F.coalesce("eventName", F.lit("")), F.coalesce("startDate", F.lit("")), F.coalesce("hasLocation", F.lit("")), (F.col("row") - 1).cast("string"))))
    return rows.withColumn("id", F.replace(identity.uuid5(identity.GDA_NAMESPACE, key), F.lit("-"), F.lit("")))


def catalogue_rows(cells: DataFrame, subtypes: dict[str, str], headers: dict[str, str] | None = None) -> DataFrame:
    """The catalogue's rows with types looked up (``subtypes``: name in lower case to type), places cleaned, dates put together."""
    named = cells.withColumnsRenamed(headers or CATALOGUE_HEADERS)
    columns = {"Disaster Subtype", "Associated Types", "hasLocation", "Start Year", "Start Month", "Start Day", "End Year", "End Month", "End Day", "id"} | {c for e in CATALOGUE for c in e.columns} | {"dead", "injured"}
    named = no_sentinels(named.withColumns({c: F.lit(None).cast("string") for c in sorted(columns - set(named.columns))}), [""])
    number = lambda c: F.col(c).try_cast("int")
    several = F.array_compact(F.transform(F.split("Associated Types", r"\|"), lambda t: looked_up(F.trim(t), subtypes)))
    return named.withColumns({
        "hasDisasterType": looked_up(F.col("Disaster Subtype"), subtypes), "hasDisasterSubtype": F.array_join(several, "|"),
        "hasLocation": F.array_join(strings.place_names(F.coalesce("hasLocation", F.lit("Philippines"))), "|"),
        "startDate": dates.assembled(number("Start Year"), number("Start Month"), number("Start Day")), "endDate": dates.assembled(number("End Year"), number("End Month"), number("End Day"), end=True),
        "id": F.replace(identity.uuid5(identity.EMDAT_NAMESPACE, F.col("id")), F.lit("-"), F.lit("")), "rowNumber": F.col("row").cast("int"),
    })


def looked_up(name: Column, table: dict[str, str], default: str | None = None) -> Column:
    """The entry of a small constant table for a name in any case; ``default`` if there is none."""
    known = F.create_map(*[F.lit(x) for kv in sorted(table.items()) for x in (kv[0].lower(), kv[1])])
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(name))), F.lit(default).cast("string"))


def single_place(place: Column) -> Column:
    """The place of a record: that of its event, unless the event has several; those stay with the event."""
    return F.when(~F.contains(place, F.lit("|")), place)


def entity_rows(rows: DataFrame, entity: Entity, key: str = "event") -> DataFrame:
    """event, hasLocation and the typed columns of an entity, for each row that says anything of it."""
    text = lambda c: F.when(~F.lower(F.trim(c)).isin("none", "nan", ""), F.col(c))
    typed = {c: text(c) for c in entity.texts} | {c: numbers.to_int(F.col(c)) for c in entity.ints} | {c: numbers.to_float(F.col(c)) for c in entity.floats}
    typed |= {c: numbers.large_to_millions(numbers.to_float(F.col(c))) for c in entity.amounts}
    return rows.select(F.col(key).alias("event"), single_place(F.col("hasLocation")).alias("hasLocation"), *[v.alias(c) for c, v in typed.items()]).na.drop(how="all", subset=entity.columns)


def casualty_rows(rows: DataFrame, key: str = "event") -> DataFrame:
    """event, hasLocation, ordinal, kind and cnt: the casualties that a row has numbers of, counted through."""
    wide = rows.select(F.col(key).alias("event"), single_place(F.col("hasLocation")).alias("hasLocation"), *[(numbers.to_int(F.col(c)) if c in rows.columns else F.lit(None).cast("bigint")).alias(c) for c in CASUALTIES])
    return reshape.long_counts(wide, ["event", "hasLocation"], CASUALTIES)


def relief_rows(rows: DataFrame, key: str = "event") -> DataFrame:
    """event, hasLocation, itemType, itemCost and itemQty: a row for each kind of relief with a cost or a quantity.

    The total counts only where the cost of no single kind is known.
    """
    guard = reduce(lambda a, b: a | b, [F.col(cost).isNotNull() for kind, cost, _ in RELIEF if kind != "general"])
    items = [
        F.struct(F.lit(kind).alias("itemType"), (F.when(~guard, F.col(cost)) if kind == "general" else F.col(cost)).cast("string").alias("itemCost"), (F.col(qty) if qty else F.lit(None)).cast("string").alias("itemQty"))
        for kind, cost, qty in RELIEF
    ]
    listed = rows.select(F.col(key).alias("event"), single_place(F.col("hasLocation")).alias("hasLocation"), F.explode(F.array(*items)).alias("i"))
    return listed.select("event", "hasLocation", "i.itemType", numbers.to_float(F.col("i.itemCost")).alias("itemCost"), "i.itemQty").filter("itemCost IS NOT NULL OR itemQty IS NOT NULL")


def sub_incidents(rows: DataFrame, column: str = "hasSubtype", key: str = "event") -> DataFrame:
    """event, sub_id (from 1), type and place of the bracketed parts ``[Type: place]; [Type: place]`` of a cell."""
    listed = rows.filter(F.contains(column, F.lit("["))).select(F.col(key).alias("event"), F.posexplode(F.split(column, ";")).alias("pos", "part"))
    bare = F.regexp_replace("part", r"[\[\]]", "")
    return listed.select("event", (F.col("pos") + 1).alias("sub_id"), F.trim(F.split(bare, ":")[0]).alias("type"), F.trim(F.try_element_at(F.split(bare, ":"), F.lit(2))).alias("place"))


def entity_triples(rows: DataFrame, entity: Entity, graph: str, unit: str = ":PHP_millions") -> DataFrame:
    """The node of each row of ``entity_rows``: its link, type, place and values; amounts as measures with their unit."""
    nodes = rows.withColumns({"node": part_iri(F.col("event"), entity.segment), "type": F.lit(f":{entity.cls}")})
    out = literal_triples(nodes, "event", {"node": f":{entity.link}"}, graph, "iri").unionByName(literal_triples(nodes, "node", {"type": "rdf:type", "hasLocation": ":hasLocation"}, graph, "iri"))
    plain = {c: f":{c}" for c in entity.columns if c not in entity.amounts}
    if plain:
        out = out.unionByName(literal_triples(nodes, "node", plain, graph))
    for amount in entity.amounts:
        measures = nodes.filter(F.col(amount).isNotNull()).withColumns({"m": F.concat(F.lit("_:"), F.sha1(F.concat("node", F.lit(f"/{amount}")))), "unit": F.lit(unit)})
        for part in (literal_triples(measures, "node", {"m": f":{amount}"}, graph, "blank"), literal_triples(measures, "m", {amount: "qudt:numericValue"}, graph), literal_triples(measures, "m", {"unit": "qudt:unit"}, graph, "iri")):
            out = out.unionByName(part)
    return out.dropDuplicates()


# --- what kind of event a row is ---


def incident_by_name(name: Column) -> Column:
    """Names that speak of an incident or a conflict."""
    return F.lower(name).rlike("incident|conflict|disorganization")


def incident_by_place(place: Column, type_id: Column) -> Column:
    """An event of one place that is no part of the country or wider, and no cyclone, storm or ground movement."""
    one = place.isNotNull() & ~F.contains(place, F.lit("|")) & ~place.rlike("|".join(WIDE_PLACES))
    return F.coalesce(one & ~F.lower(F.coalesce(type_id, F.lit(""))).rlike("cyclone|storm|ground"), F.lit(False))


def event_class(name: Column | None = None, mark: Column | None = None, place: Column | None = None, type_id: Column | None = None) -> Column:
    """Incident or MajorEvent, by whichever is given: the source's own mark (I), the name, or the place and type."""
    said = mark == "I" if mark is not None else incident_by_name(name) if name is not None else incident_by_place(place, type_id)
    return F.when(F.coalesce(said, F.lit(False)), "Incident").otherwise("MajorEvent")
