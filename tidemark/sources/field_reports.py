"""Field reports on displaced people, houses and assistance: several tables a report, whose headers change from one to the next.

Columns are recognised by the words in their headers; tables of one report meet on the place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import numbers, strings
from tidemark.operators import reshape, sequence
from tidemark.sources.wide import Entity

# Columns by the words that their headers hold; any group of words counts, the first that fits.
POPULATION = {
    "evacuationCenters": [["evacuation", "center", "cum"], ["evacuation", "center"]],
    "displacedFamiliesI": [["displaced", "inside", "families", "cum"], ["inside", "families", "evacuation"]],
    "displacedFamiliesO": [["displaced", "outside", "families", "cum"], ["outside", "families", "evacuation"]],
    "displacedPersonsI": [["displaced", "inside", "persons", "cum"], ["inside", "person", "evacuation"]],
    "displacedPersonsO": [["displaced", "outside", "persons", "cum"], ["outside", "person", "evacuation"]],
    "affectedBarangays": [["affected", "barangays"], ["affected", "brgy"]],
    "affectedFamilies": [["affected", "families"]],
    "affectedPersons": [["affected", "person"]],
    "displacedFamilies": [["displaced", "total", "families", "cum"], ["served", "total", "families", "cum"], ["served", "total", "families"], ["evacuee", "families"]],
    "displacedPersons": [["displaced", "total", "person", "cum"], ["served", "total", "persons", "cum"], ["served", "total", "persons"], ["evacuee", "person"]],
}
HOUSES = {"totallyDamagedHouses": [["totally"]], "partiallyDamagedHouses": [["partially"]]}
ASSISTANCE = {"dswd": [["dswd"]], "lgu": [["lgu"]], "ngo": [["ngo"]], "others": [["others"]], "nga": [["nga"]]}
# Who gives, by column.
GIVERS = {"dswd": "DSWD", "lgu": "LGU", "ngo": "NGO", "others": "Unspecified", "nga": "NGA"}
PLACE = ["region", "province", "municipality"]
#: What becomes of the rows of a report.
ENTITIES = {
    "population": Entity("AffectedPopulation", "hasAffectedPopulation", "population", ints=["affectedBarangays", "affectedFamilies", "affectedPersons", "displacedFamilies", "displacedPersons"]),
    "evacuation": Entity("PreemptiveEvacuation", "hasPreemptiveEvacuation", "evacuation", ints=["evacuationCenters"]),
    "houses": Entity("HousingDamage", "hasHousingDamage", "housing", ints=["totallyDamagedHouses", "partiallyDamagedHouses"]),
    "assistance": Entity("Assistance", "hasAssistance", "assistance", texts=["contributingOrg"], amounts=["contributionAmount"]),
}


def table(cells: DataFrame, tokens: dict[str, list[list[str]]]) -> DataFrame:
    """file, place (region|province|municipality) and the recognised columns, of a table of text cells with file and row.

    Places are filled downwards within a file; rows without a municipality are sums of those below and go.
    """
    known = reshape.rename_by_tokens(reshape.snake_columns(cells), tokens)
    columns = [c for c in tokens if c in known.columns]
    given = [strings.none_to_null(F.nullif(F.trim(F.col(c)), F.lit(""))).alias(c) if c in known.columns else F.lit(None).cast("string").alias(c) for c in PLACE]
    filled = sequence.hierarchical_fill(known.select("file", "row", *given, *columns), PLACE[:2], ["file"], ["row"]).filter("municipality IS NOT NULL")
    return filled.select("file", F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in PLACE]).alias("place"), *columns)


def population(tables: list[DataFrame]) -> DataFrame:
    """One row a file and place of all tables of people: a full outer join; totals of the displaced, where no table has
    them, out of those inside and outside of centres."""
    typed = [df.withColumns({c: numbers.to_int(F.col(c)) for c in df.columns if c not in ("file", "place")}).withColumn("key", F.struct("file", "place")).drop("file", "place") for df in tables]
    merged = reshape.full_merge(typed, "key")
    for total in ("displacedFamilies", "displacedPersons"):
        parts = [c for c in (f"{total}O", f"{total}I") if c in merged.columns]
        if parts and total not in merged.columns:
            merged = merged.withColumn(total, reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in parts]))
        merged = merged.drop(*parts)
    return merged.select("key.file", "key.place", *[c for c in merged.columns if c != "key"])


def houses(cells: DataFrame) -> DataFrame:
    found = table(cells, HOUSES)
    return found.withColumns({c: numbers.to_int(F.col(c)) for c in HOUSES if c in found.columns})


def assistance(cells: DataFrame) -> DataFrame:
    """file, place, contributingOrg and contributionAmount (millions) of each giver with an amount; digits that a reader has repeated are repaired."""
    found = table(cells, ASSISTANCE)
    givers = [c for c in GIVERS if c in found.columns]
    amounts = found.select("file", "place", *[numbers.to_millions(numbers.repair_digits(F.col(c))).alias(GIVERS[c]) for c in givers])
    return reshape.unpivot_amounts(amounts, ["file", "place"], [GIVERS[c] for c in givers], "contributingOrg", "contributionAmount")
