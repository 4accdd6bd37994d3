import datetime as dt

from tidemark.sources import reports


def test_tables_are_built_from_specs(spark):
    cells = spark.createDataFrame(
        [("f", 1, "Region V", None, None, None, "100", None), ("f", 2, None, "Albay", None, "3", "1,200", " 40"), ("f", 3, None, None, "Daraga", "x", "none", "7"), ("f", 4, "Region VI", None, None, "1", "5", None)],
        "file string, row int, Region string, Province string, Municipality string, Brgys string, `Affected  Persons` string, affectedFamilies string",
    )
    spec = reports.TABLES["affected_population"]
    rows = reports.build(cells, spec, {"brgys": "affectedBarangays", "affected_persons": "affectedPersons", "affectedfamilies": "affectedFamilies"}).orderBy("row").collect()
    assert [(r.row, r.region, r.province, r.municipality, r.affectedBarangays, r.affectedPersons, r.affectedFamilies) for r in rows] == [(2, "Region V", "Albay", None, 3, 1200, 40), (3, "Region V", "Albay", "Daraga", None, None, 7), (4, "Region VI", None, None, 1, 5, None)]


def test_times_and_triples(spark):
    cells = spark.createDataFrame([("f", 1, "PortA", "5 May 2020", "08:30 AM", "6 May 2020", None), ("f", 2, None, "bad", None, None, None)], "file string, row int, portOrTerminalName string, cancellationDate string, cancellationTime string, resumptionDate string, resumptionTime string")
    spec = reports.TABLES["seaport"]
    headers = {c.lower(): c for c in ("portOrTerminalName", "cancellationDate", "cancellationTime", "resumptionDate", "resumptionTime")}
    rows = reports.build(cells, spec, headers)
    assert [(r.portOrTerminalName, r.cancellationDateTime, r.resumptionDateTime) for r in rows.collect()] == [("PortA", dt.datetime(2020, 5, 5, 8, 30), dt.datetime(2020, 5, 6))]
    from pyspark.sql import functions as F

    triples = {(r.s, r.p, r.o) for r in reports.rows_to_triples(rows.withColumn("event", F.lit("e")), spec, "g").collect()}
    assert {("e", ":hasSeaportDisruption", "e/seaport/1"), ("e/seaport/1", "rdf:type", ":SeaportDisruption"), ("e/seaport/1", ":portOrTerminalName", "PortA")} <= triples and len(triples) == 5


def test_merged_values_headers_and_merges(spark):
    frame = spark.createDataFrame([("144,784.20 300,000.00", None, "x"), ("5 6", None, "y"), (None, None, "z")], "a string, b string, c string")
    assert [tuple(r) for r in reports.split_merged_values(frame, ["a", "b"]).collect()] == [("144,784.20", "300,000.00", "x"), ("5", "6", "y"), (None, None, "z")]
    table = spark.createDataFrame([("Total Families", "Persons"), ("1", "2"), (None, None)], "`total_families` string, persons string")
    assert [tuple(r) for r in reports.repeated_headers(table).collect()] == [("1", "2"), (None, None)]
    place = "region string, province string, municipality string"
    evacuated = spark.createDataFrame([("R", "P", None, 1, 2)], f"{place}, preemptFamilies long, preemptPersons long")
    affected = spark.createDataFrame([("R", "P", None, 3, 4, 5), ("R", None, None, 6, 7, 8)], f"{place}, evacuationCenters long, displacedFamilies long, displacedPersons long")
    merged = {r.place: (r.preemptFamilies, r.displacedPersons) for r in reports.reconciled_evacuation(evacuated, affected).collect()}
    assert merged == {"R|P|": (1, 5), "R||": (None, 8)}
    assert [r.t for r in reports.displaced_totals(affected, "displacedFamilies", "displacedPersons", "t").collect()] == [9, 15]
