import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators.hierarchy import reached
from tidemark.plans import competency as cq
from tidemark.plans import graph as g
from tidemark.plans import cleaning, questions  # noqa: F401  (they register their queries)
from tidemark.plans.catalog import QUERIES
from tidemark.plans.tables import driver_graph, related_orders
from tidemark.session import shared_folder

LINES = """
e1 rdf:type :MajorEvent; e1 :eventName Ana; e1 :startDate 2022-01-05T00:00:00; e1 :hasDisasterType TC; e1 :hasLocation m1; e1 :hasRelatedIncident i1; e1 prov:wasDerivedFrom rec1; rec1 prov:wasDerivedFrom rep1; rep1 prov:wasAttributedTo orgA
i1 rdf:type :Incident; i1 :startDate 2022-01-06; i1 :hasDisasterType Flood; i1 :hasLocation m2; i1 :isRelatedTo e1; i1 prov:wasDerivedFrom rep2; rep2 prov:wasAttributedTo orgB
e2 rdf:type :MajorEvent; e2 :startDate 2021-03-01; e2 :hasDisasterType Flood; e2 :hasLocation p1; e2 prov:alternateOf e1; e1 prov:alternateOf e2; e2 prov:wasDerivedFrom rep2
:MajorEvent rdfs:subClassOf :DisasterEvent; :Incident rdfs:subClassOf :DisasterEvent; :Casualties rdfs:subClassOf :Impact; TC skos:broader Storm; Storm skos:broader Natural; Flood skos:broader Natural
m1 :isPartOf p1; m2 :isPartOf p1; p1 :isPartOf r1; m1 rdf:type :Municipality; m2 rdf:type :Municipality; p1 rdf:type :Province; r1 rdf:type :Region; m1 rdfs:label "Em"; p1 rdfs:label "Pe"; r1 rdfs:label "Ar"; m1 :incomeClassification "4th"
e1 :hasCasualties n1; n1 rdf:type :Casualties; n1 :hasLocation m1; n1 :casualtyCount "3"; n1 :isOfCasualtyType Dead; n1 :note "x"
e1 :hasPreemptiveEvacuation n2; n2 :hasLocation m1; n2 :evacuationCenters "2"; e1 :hasInfrastructureDamage n3; n3 :hasLocation m1; n3 :infraDamageAmount _:q; _:q qudt:numericValue "5.5"; _:q qudt:unit PHP; n3 :socialDamageAmount _:q2; _:q2 qudt:numericValue "1"
e1 :hasAirportDisruption n4; n4 :hasLocation m1; n4 :cancellationDateTime "2022-01-05T08:00:00"; n4 :resumptionDateTime "2022-01-05T20:00:00"; n4 :contributingOrg org1; org1 rdf:type :Organization; org1 skos:prefLabel "Org"
e1 :hasHousingDamage n5; n5 :hasLocation m1; n5 :totallyDamagedHouses "7"; e1 :hasDeclarationOfCalamity n6; n6 :hasLocation m1; e1 :hasRescue n7; n7 :hasLocation m1; n7 :rescueUnit "U"; e1 :hasSeaportDisruption n8; n8 :hasLocation m1; n8 :portStatus "closed"
e1 :hasAffectedPopulation n9; n9 :hasLocation m1; n9 :displacedFamilies "4"; n9 :displacedPersons "20"; e1 :hasClassSuspension n10; n10 :hasLocation m1; n10 :fromClassLevel "K"; e1 :hasAssistance n11; n11 :hasLocation m1; n11 :contributionAmount _:q3; _:q3 qudt:numericValue "9"
e1 :hasAgricultureDamage n12; n12 :hasLocation m1; n12 :agriDamageAmount _:q4; _:q4 qudt:numericValue "8"; n12 :productionLossVolume "2"; Natural skos:prefLabel "N"
"""


@pytest.fixture(scope="module")
def graph(spark):
    rows = []
    for triple in LINES.replace("\n", ";").split(";"):
        if triple.strip():
            s, p, o = triple.strip().split(" ", 2)
            literal = o.startswith('"') or p in (":eventName", ":startDate")
            rows.append((s, p, o.strip('"'), "literal" if literal else "blank" if o.startswith("_:") else "iri"))
    return g.Graph(spark.createDataFrame(rows, "s string, p string, o string, o_kind string").cache())


def rows(df, *columns):
    return sorted((tuple(str(x) if x is not None else None for x in r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def test_competency_questions(graph):
    assert rows(cq.cq1(graph, "TC")) == [("e1", "Ana", "2022-01-05T00:00:00", "Yes")]
    assert rows(cq.cq2(graph, ("Flood",)), "event", "location", "region_label") == [("e2", "p1", "Ar"), ("i1", "m2", "Ar")]
    assert rows(cq.cq3(graph, "TC"), "ancestor", "label", "events") == [("Natural", "N", "3"), ("Storm", None, "1"), ("TC", None, "1")]
    assert rows(cq.cq4(graph, "Natural", ("r1",)), "event", "province_name") == [("e1", "Pe"), ("e2", "Pe"), ("i1", "Pe")]
    assert rows(cq.cq5(graph, ("Natural",), ("r1",), 2022)) == [("Flood", "r1", "1"), ("TC", "r1", "1")]
    assert rows(cq.cq6(graph, "r1")) == [("e1", "4.000000", "20.000000")]
    assert rows(cq.cq7(graph, "Storm", "r1")) == [("Pe", "Dead", "3.000000")]
    assert rows(cq.cq8(graph, "TC", "r1", 2022)) == [("orgA", "2.000000")] and rows(cq.cq8(graph, "TC", "r1", 2021)) == []
    assert rows(cq.cq9(graph, "Natural", "r1")) == [("e1", "6.500000")]
    assert rows(cq.cq10(graph, "Natural", "r1")) == [("Pe", "0.000000", "7.000000")]
    assert rows(cq.cq11(graph, "TC", "r1")) == [("e1", "8.000000", "0.000000", "2.000000")]
    assert rows(cq.cq12(graph, "TC"), "event_name", "location_label", "port", "status") == [("Ana", "Em", None, "closed")]
    assert rows(cq.cq13(graph, "Natural"), "event", "hours") == [("e1", "12.0")]
    assert rows(cq.cq14(graph, "p1"), "event", "from_level", "to_level") == [("e1", "K", None)]
    assert rows(cq.cq15(graph, "m1"), "event", "source", "contribution") == [("e1", "orgA", "9")]
    assert rows(cq.cq16(graph, "r1")) == [("Pe", "Ana - unknown - Em")]
    assert rows(cq.cq17(graph, "r1")) == [("e1", "Ana", "U", None)]
    assert rows(cq.cq18(graph, "r1", "4th")) == [("Em, Pe", "Yes")]
    assert rows(cq.cq19(graph, ("Flood", "TC"), ("orgA", "orgB"))) == [("orgA", "1"), ("orgB", "2")]
    assert rows(cq.cq20(graph), "e1", "s1", "e2", "s2") == [("e1", "orgA", "e2", "orgB")]


def test_event_pages(graph):
    impacts = g.event_impacts(graph, "e1", ":Impact")
    assert ("n1", ":casualtyCount", "3") in rows(impacts, "impact", "predicate", "value") and {r[0] for r in rows(impacts, "impact")} == {"n1"}
    assert rows(g.event_organisations(graph, "e1"), "organisation", "label", "holder") == [("org1", "Org", "n4")]
    assert rows(g.event_sources(graph, "e1"), "source", "record", "event") == [("orgA", "rep1", "e1"), ("orgB", "rep2", "i1")]
    details = rows(g.event_details(graph, "e1"), "kind", "resource")
    assert details == [("alternate", "e2"), ("core", "e1"), ("disasterType", "TC"), ("incident", "i1"), ("location", "m1"), ("source", "orgA")]
    with pytest.raises(LookupError):
        g.event_details(graph, "nobody")


def test_places_and_trees(graph):
    assert rows(g.places_of_level(graph, ":Province"), "place", "label", "parent_label") == [("p1", "Pe", "Ar")]
    assert rows(g.cities(graph), "place", "parent", "region_label") == [("m1", "p1", "Ar"), ("m2", "p1", "Ar")]
    assert rows(g.ontology_links(graph, ":"), "source", "target") == [(":Casualties", ":Impact"), (":Incident", ":DisasterEvent"), (":MajorEvent", ":DisasterEvent")]
    assert g.tree([("a", "A", None), ("c", "c", "a"), ("b", "B", "a"), ("x", None, "lost")]) == [{"id": "a", "label": "A", "children": [{"id": "b", "label": "B", "children": []}, {"id": "c", "label": "c", "children": []}]}, {"id": "x", "label": None, "children": []}]


def test_questions_store_no_triples(spark, sf_dir):
    """Each reads what it names: loading all triples first took more disk than the tables."""
    folder = shared_folder(spark).removeprefix("file:")
    files = lambda: {f"{d}/{x}" for d, _, names in os.walk(folder) for x in names}
    before = files()
    graph = driver_graph(spark, sf_dir)
    nodes, places = graph.pairs(":hasHousingDamage"), graph.pairs(":hasLocation", after=(":hasHousingDamage",))
    assert nodes.count() == places.count() == spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("l_linenumber = 5").count() and files() == before


def test_paths_from_some_nodes(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "c"), ("c", "d"), ("d", None)], "child string, parent string")
    found = reached(edges, spark.createDataFrame([("a",), ("x",), ("x",), (None,)], "n string"))
    assert rows(found) == [(s, n) for s in "ax" for n in "abcd"]
    assert rows(reached(edges, spark.createDataFrame([("d",)], "n string"))) == []


def test_paths_through_rows_are_those_of_joins(spark, sf_dir):
    """Paths whose triples come from one row of a table move that row once."""
    graph = driver_graph(spark, sf_dir)
    joined = g.Graph(spark=spark, parts=graph._parts, make=graph._make)
    steps = [(0, (":hasInfrastructureDamage", ":hasAgricultureDamage")), (1, (":infraDamageAmount", ":socialDamageAmount", ":agriDamageAmount")), (2, ("qudt:numericValue",)), (2, ("qudt:unit",))]
    fast, slow = (x.paths(*steps, names=("event", None, "m", "v", "unit"), p="p", by="event") for x in (graph, joined))
    assert fast._jdf.queryExecution().toString().split("Physical Plan")[-1].count("/lineitem.parquet") == 1 and rows(fast) == rows(slow) != []
    starts = graph.pairs(":hasRelatedIncident").select("s").distinct()
    assert joined.traced() is None and rows(g.sources_of(graph, starts)) == rows(g.sources_of(joined, starts)) != []
    # What a table of triples holds need not come from rows of one table: an amount may be told twice.
    table = [("n", ":a", "_:1", "blank"), ("n", ":a", "_:2", "blank"), ("_:1", "v", "5", "literal"), ("_:2", "v", "5", "literal")]
    twice = g.Graph(spark.createDataFrame(table, "s string, p string, o string, o_kind string"))
    assert rows(twice.paths((0, (":a",)), (1, ("v",)), names=("n", None, "v"), by="n")) == [("n", "5")] * 2


@pytest.mark.parametrize("name", ["cq19_by_source", "sources_of_events"])
def test_sources_are_not_stored(spark, sf_dir, name):
    folder = shared_folder(spark).removeprefix("file:")
    stored = lambda: sum(os.path.getsize(f"{d}/{x}") for d, _, names in os.walk(folder) for x in names)
    before = stored()
    assert QUERIES[name](spark, sf_dir).count() and stored() - before < 20_000


def test_literals_of_events_need_no_records(spark, sf_dir):
    plan = QUERIES["any_literal"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "/orders.parquet" in plan and "/lineitem.parquet" not in plan


def test_sieves_lose_nothing_and_pass_few_others(spark):
    for n in (0, 1, 3000):
        wanted = spark.range(n).select(F.concat(F.lit("e"), "id").alias("e"))
        test = g.sieve(wanted, "e")
        assert wanted.filter(test(F.col("e"))).count() == n
        assert spark.range(10**6, 10**6 + 10000).filter(test(F.concat(F.lit("e"), "id"))).count() < 2000


def test_what_is_known_of_other_events_is_not_moved(spark, sf_dir):
    graph = driver_graph(spark, sf_dir)
    found = cq.records(graph, ":hasSeaportDisruption")
    assert found._jdf.queryExecution().toString().split("Physical Plan")[-1].count("/lineitem.parquet") == 1
    events = {r[0] for r in found.select("event").collect()}
    named = graph.pairs(":hasLocation", of=(":startDate",), only=graph.only(graph.kept(found), "event"))
    assert events <= {r[0] for r in named.select("s").collect()} and named.count() < spark.read.parquet(f"{sf_dir}/orders.parquet").count() / 2


@pytest.mark.parametrize("name", ["cq12_seaports", "cq11_agriculture", "cq13_airports", "cq16_calamities", "cq17_rescue", "cq18_evacuated_towns"])
def test_questions_about_few_events_leave_out_others(spark, sf_dir, name):
    assert "subquery" in QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_types_of_records_are_a_set_where_their_orders_are(spark, tmp_path, sf_dir):
    """Lines that come twice give one node, which is not moved again to find that out."""
    for name in os.listdir(sf_dir):
        os.symlink(f"{sf_dir}/{name}", tmp_path / name)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    os.remove(tmp_path / "lineitem.parquet")
    lines.unionByName(lines.filter("l_orderkey % 3 = 0")).write.parquet(str(tmp_path / "lineitem.parquet"))
    found = QUERIES["focus_nodes"](spark, str(tmp_path))
    assert rows(found) == rows(QUERIES["focus_nodes"](spark, sf_dir)) != []
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" not in plan and "hashpartitioning(focus" not in plan


def test_lines_of_other_kinds_of_parts_are_not_moved(spark, sf_dir):
    graph = driver_graph(spark, sf_dir)
    few, every = graph.pairs(":hasDisasterType", to=["PROMO"]), graph.pairs(":hasDisasterType")
    assert "subquery" in few._jdf.queryExecution().optimizedPlan().toString() and rows(few) == rows(every.filter("o = 'PROMO'")) != []
    assert rows(graph.pairs(":hasDisasterType", to=["none"])) == []


def test_major_events_of_a_type_leave_out_others(spark, sf_dir, graph):
    plan = QUERIES["cq1_related_incidents"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "subquery" in plan and plan.count("/lineitem.parquet") == 0
    assert graph.implies(":MajorEvent", ":DisasterEvent") and graph.implies("x", "x") and not graph.implies(":Casualties", ":DisasterEvent")


@pytest.mark.parametrize("twice", [False, True])
def test_related_orders(spark, twice):
    """An order that has a row of either status, or none, counts as whatever a row of it says."""
    found = [(1, 7, "O", 1), (2, 7, "P", 20), (3, 7, None, 30), (4, 7, "P", 45), (5, 8, "P", 1), (6, 8, "F", 60), (7, None, "P", 1)] + ([(5, 7, "O", 50), (2, 8, "O", 2)] if twice else [])
    orders = spark.createDataFrame(found, "o_orderkey long, o_custkey long, o_orderstatus string, d int").withColumn("o_orderdate", F.date_add(F.lit("2020-01-01").cast("date"), "d").cast("timestamp"))
    said = lambda k, p: any((x[2] == "P") == p for x in found if x[0] == k)
    wanted = [(a[0], b[0]) for a in found for b in found if a[0] != b[0] and a[1] is not None and a[1] == b[1] and abs(a[3] - b[3]) <= 30 and said(a[0], False) and said(b[0], True)]
    assert rows(related_orders(orders)) == rows(spark.createDataFrame(wanted, "a long, b long")) != []


def test_fields_of_records_are_read_together(spark, sf_dir):
    graph = driver_graph(spark, sf_dir)
    nodes = graph.pairs(":hasAirportDisruption", names=("event", "node")).select("node").unionByName(g.literal_rows(spark, ["nobody"], "node"))
    fields = {"port": ":portOrTerminalName", "cancelled": ":cancellationDateTime", "resumed": ":resumptionDateTime"}
    fast, slow = graph.gathered(nodes, "node", fields), graph.optional(nodes, "node", fields)
    reads = lambda df: df._jdf.queryExecution().toString().split("Physical Plan")[-1].count("/lineitem.parquet")
    assert reads(fast) == 2 < reads(slow)
    assert rows(fast) == rows(slow) and ("nobody", None, None, None) in rows(fast)


def test_rows_are_not_moved_to_few_labels(spark, sf_dir):
    graph = driver_graph(spark, sf_dir)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = graph.labelled(graph.pairs(":hasLocation", of=(":startDate",)), "o", "label")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin [o#" in plan
