"""Registered queries over the graph of the driver's tables: competency questions, event pages, places, inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.inference import TYPE, Axioms, materialise
from tidemark.plans import competency as cq
from tidemark.plans import graph as g
from tidemark.plans.catalog import query
from tidemark.plans.tables import GRAPH_SQL, ONTOLOGY, RECORDS, driver_graph, loaded_store


def question(sql: str):
    return query(GRAPH_SQL + sql)


def _number(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


# --- competency questions --------------------------------------------------------------------------------------------


@question("""SELECT DISTINCT e.event, e.name AS event_name, e.start_date AS start, CASE WHEN EXISTS (SELECT 1 FROM related r WHERE r.a = e.event) THEN 'Yes' ELSE 'No' END AS has_incident
    FROM raw e JOIN event_type t ON t.event = e.event WHERE t.type_id = 'PROMO' AND e.event_class = 'MajorEvent' AND e.start_date IS NOT NULL""")
def cq1_related_incidents(spark, sf_dir):
    return cq.cq1(driver_graph(spark, sf_dir), "PROMO")


@question("""SELECT e.event, e.name AS event_name, t.type_id, l.code AS location, x.label AS location_label, c.ancestor AS region, y.label AS region_label FROM raw e JOIN event_type t ON t.event = e.event
    JOIN event_location l ON l.event = e.event JOIN location x ON x.code = l.code JOIN location_closure c ON c.descendant = l.code JOIN location y ON y.code = c.ancestor AND y.level = 'Region'
    WHERE t.type_id IN ('PROMO', 'SMALL') AND e.start_date IS NOT NULL""")
def cq2_places_of_types(spark, sf_dir):
    return cq.cq2(driver_graph(spark, sf_dir), ("PROMO", "SMALL")).select("event", "event_name", "type_id", "location", "location_label", "region", "region_label")


@question("""SELECT u.ancestor, lower(u.ancestor) AS label, count(DISTINCT t.event) AS events FROM taxonomy_closure u LEFT JOIN typed t ON t.ancestor = u.ancestor WHERE u.descendant = 'STANDARD' GROUP BY ALL""")
def cq3_type_path(spark, sf_dir):
    return cq.cq3(driver_graph(spark, sf_dir), "STANDARD")


@question("""SELECT DISTINCT e.event, e.name AS event_name, e.start_date AS start, t.type_id, lower(t.type_id) AS type_label, x.label AS province_name, y.label AS region_name
    FROM raw e JOIN typed t ON t.event = e.event AND t.ancestor = 'Hydro' JOIN event_location l ON l.event = e.event JOIN location x ON x.code = l.code AND x.level = 'Province'
    JOIN location y ON y.code = x.parent AND y.level = 'Region' WHERE y.code IN ('R1', 'R3') AND e.start_date IS NOT NULL""")
def cq4_provinces_of_subtypes(spark, sf_dir):
    return cq.cq4(driver_graph(spark, sf_dir), "Hydro", ("R1", "R3"))


@question("""SELECT t.type_id, c.ancestor AS region, count(DISTINCT e.event) AS events FROM event e JOIN typed t ON t.event = e.event AND t.ancestor IN ('Meteo', 'SMALL') JOIN event_location l ON l.event = e.event
    JOIN location_closure c ON c.descendant = l.code AND c.ancestor IN ('R0', 'R2') WHERE e.start_date[1:4] = '1998' GROUP BY ALL""")
def cq5_counts_of_a_year(spark, sf_dir):
    return cq.cq5(driver_graph(spark, sf_dir), ("Meteo", "SMALL"), ("R0", "R2"), 1998)


@question("""SELECT r.event, CAST(sum(l_suppkey % 9 + 1) AS DOUBLE) AS families, CAST(sum(q) AS DOUBLE) AS persons FROM rec r JOIN location_closure c ON c.descendant = r.location AND c.ancestor = 'R1' JOIN event e ON e.event = r.event
    WHERE l_linenumber = 1 AND l_partkey % 4 <> 0 AND r.location = r.own AND e.start_date IS NOT NULL GROUP BY ALL""")
def cq6_displaced(spark, sf_dir):
    return _number(cq.cq6(driver_graph(spark, sf_dir), "R1"), "families", "persons")


@question("""SELECT x.label AS area_name, l_returnflag AS kind, CAST(sum(q) AS DOUBLE) AS total FROM rec r JOIN location x ON x.code = r.location AND x.parent = 'R2'
    WHERE l_linenumber = 2 AND r.location = r.own AND r.event IN (SELECT event FROM typed WHERE ancestor = 'Natural') GROUP BY ALL""")
def cq7_casualties_by_province(spark, sf_dir):
    return _number(cq.cq7(driver_graph(spark, sf_dir), "Natural", "R2"), "total")


@question("""SELECT o.source, CAST(sum(q) AS DOUBLE) AS total FROM rec r JOIN origin o ON o.event = r.event JOIN event e ON e.event = r.event JOIN location_closure c ON c.descendant = r.location AND c.ancestor = 'R3'
    WHERE l_linenumber = 3 AND e.start_date[1:4] = '1997' AND r.event IN (SELECT event FROM typed WHERE ancestor = 'Meteo') GROUP BY ALL""")
def cq8_evacuation_by_source(spark, sf_dir):
    return _number(cq.cq8(driver_graph(spark, sf_dir), "Meteo", "R3", 1997), "total")


@question("""SELECT r.event, CAST(sum(round(CAST(l_extendedprice AS DECIMAL(18, 2)), 0) + CASE WHEN l_partkey % 2 = 0 THEN l_suppkey ELSE 0 END) AS DOUBLE) AS total FROM rec r JOIN location x ON x.code = r.location AND x.parent = 'R4'
    WHERE l_linenumber = 4 AND r.location = r.own AND r.event IN (SELECT event FROM typed WHERE ancestor = 'Hydro') GROUP BY ALL""")
def cq9_infrastructure(spark, sf_dir):
    return _number(cq.cq9(driver_graph(spark, sf_dir), "Hydro", "R4"), "total")


@question("""SELECT x.label AS area_name, CAST(coalesce(sum(q) FILTER (l_returnflag <> 'A'), 0) AS DOUBLE) AS partially, CAST(coalesce(sum(q) FILTER (l_returnflag = 'A'), 0) AS DOUBLE) AS totally FROM rec r JOIN location x ON x.code = r.location AND x.parent = 'R0'
    WHERE l_linenumber = 5 AND r.location = r.own AND r.event IN (SELECT event FROM typed WHERE ancestor = 'Meteo') GROUP BY ALL""")
def cq10_houses(spark, sf_dir):
    return _number(cq.cq10(driver_graph(spark, sf_dir), "Meteo", "R0"), "partially", "totally")


@question("""SELECT r.event, CAST(coalesce(sum(l_suppkey + 1) FILTER (l_partkey % 3 = 0), 0) AS DOUBLE) AS amount, CAST(coalesce(sum(l_suppkey + 2) FILTER (l_partkey % 3 = 1), 0) AS DOUBLE) AS loss, CAST(sum(q) AS DOUBLE) AS volume
    FROM rec r JOIN location x ON x.code = r.location AND x.parent = 'R1' WHERE l_linenumber = 6 AND r.location = r.own AND r.event IN (SELECT event FROM typed WHERE ancestor = 'Natural') GROUP BY ALL""")
def cq11_agriculture(spark, sf_dir):
    return _number(cq.cq11(driver_graph(spark, sf_dir), "Natural", "R1"), "amount", "loss", "volume")


def _disrupted(fields: str, place: int) -> str:
    return f"""SELECT r.event, e.name AS event_name, r.node, r.location, x.label AS location_label, {fields} FROM rec r JOIN raw e ON e.event = r.event JOIN location x ON x.code = r.location
    WHERE l_linenumber = 7 AND l_suppkey % 6 = {place} AND r.event IN (SELECT event FROM typed WHERE ancestor = 'Meteo')"""


@question(_disrupted("'Port ' || l_suppkey AS port, CASE WHEN l_partkey % 4 <> 0 THEN l_linestatus END AS status", 0))
def cq12_seaports(spark, sf_dir):
    return cq.cq12(driver_graph(spark, sf_dir), "Meteo").select("event", "event_name", "node", "location", "location_label", "port", "status")


@question(_disrupted("'Field ' || l_suppkey AS port, CASE WHEN l_partkey % 4 <> 0 THEN CAST(q AS DOUBLE) END AS hours", 1))
def cq13_airports(spark, sf_dir):
    return cq.cq13(driver_graph(spark, sf_dir), "Meteo").select("event", "event_name", "node", "location", "location_label", "port", "hours")


@question("""SELECT r.event, r.node, x.label AS location_label, l_returnflag AS from_level, CASE WHEN l_partkey % 4 <> 0 THEN l_linestatus END AS to_level FROM rec r JOIN location x ON x.code = r.location AND x.parent = 'R2'
    JOIN event e ON e.event = r.event WHERE l_linenumber = 7 AND l_suppkey % 6 = 2""")
def cq14_class_suspensions(spark, sf_dir):
    return cq.cq14(driver_graph(spark, sf_dir), "R2").select("event", "node", "location_label", "from_level", "to_level")


@question("""SELECT r.event, r.node, o.source, l_returnflag AS type, 'org/' || l_suppkey AS org, CAST(q AS DOUBLE) AS contribution FROM rec r JOIN origin o ON o.event = r.event JOIN location x ON x.code = r.location AND x.parent = 'R3'
    WHERE l_linenumber = 7 AND l_suppkey % 6 = 3""")
def cq15_assistance(spark, sf_dir):
    return _number(cq.cq15(driver_graph(spark, sf_dir), "R3").select("event", "node", "source", "type", "org", "contribution"), "contribution")


@question("""SELECT x.label AS area_name, string_agg(coalesce(e.name, 'no name') || ' - ' || CASE WHEN l_partkey % 4 <> 0 THEN strftime(l_shipdate, '%Y-%m-%d') ELSE 'unknown' END || ' - ' || x.label, chr(10)
    ORDER BY coalesce(e.name, 'no name') || ' - ' || CASE WHEN l_partkey % 4 <> 0 THEN strftime(l_shipdate, '%Y-%m-%d') ELSE 'unknown' END || ' - ' || x.label) AS events
    FROM rec r JOIN raw e ON e.event = r.event JOIN location x ON x.code = r.location AND x.parent = 'R1' WHERE l_linenumber = 7 AND l_suppkey % 6 = 4 AND r.location = r.own GROUP BY ALL""")
def cq16_calamities(spark, sf_dir):
    return cq.cq16(driver_graph(spark, sf_dir), "R1")


@question("""SELECT DISTINCT r.event, e.name AS event_name, 'Unit ' || (l_suppkey % 7) AS unit, CASE WHEN l_partkey % 4 <> 0 THEN l_returnflag END AS equipment FROM rec r JOIN raw e ON e.event = r.event
    JOIN location x ON x.code = r.location AND x.parent = 'R0' WHERE l_linenumber = 7 AND l_suppkey % 6 = 5""")
def cq17_rescue(spark, sf_dir):
    return cq.cq17(driver_graph(spark, sf_dir), "R0")


@question("""SELECT x.label || ', ' || y.label AS loc, CASE WHEN max(CASE WHEN r.event IS NOT NULL THEN 1 ELSE 0 END) > 0 THEN 'Yes' ELSE 'No' END AS evacuated FROM location x JOIN location y ON y.code = x.parent
    JOIN event_location l ON l.code = x.code LEFT JOIN (SELECT DISTINCT event FROM rec WHERE l_linenumber = 3) r ON r.event = l.event WHERE x.level = 'Province' AND x.parent = 'R1' AND CAST(x.code[2:] AS INTEGER) % 3 + 1 = 2 GROUP BY ALL""")
def cq18_evacuated_towns(spark, sf_dir):
    return cq.cq18(driver_graph(spark, sf_dir), "R1", "2th", ":Province", ":Region")


@question("""SELECT o.source, count(*) AS events FROM (SELECT DISTINCT event, type_id FROM event_type WHERE type_id IN ('PROMO', 'LARGE')) t JOIN origin o ON o.event = t.event JOIN event e ON e.event = t.event
    WHERE o.source IN ('https://example.org/org/1', 'https://example.org/org/4') GROUP BY ALL""")
def cq19_by_source(spark, sf_dir):
    return cq.cq19(driver_graph(spark, sf_dir), ("PROMO", "LARGE"), ("https://example.org/org/1", "https://example.org/org/4"))


@question("""SELECT x.event AS e1, x.name AS name1, x.start_date AS d1, ox.source AS s1, y.event AS e2, y.name AS name2, y.start_date AS d2, oy.source AS s2 FROM alternate a JOIN raw x ON x.event = a.a JOIN raw y ON y.event = a.b
    JOIN origin ox ON ox.event = x.event JOIN origin oy ON oy.event = y.event WHERE a.a < a.b AND x.start_date IS NOT NULL AND y.start_date IS NOT NULL""")
def cq20_alternates(spark, sf_dir):
    return cq.cq20(driver_graph(spark, sf_dir))


# --- the pages of one event, and of places ---------------------------------------------------------------------------

#: Of all events with a related incident and assistance, that of the smallest name.
_ROOT = "(SELECT min(a) FROM related WHERE a IN (SELECT event FROM rec WHERE l_linenumber = 7 AND l_suppkey % 6 = 3))"


def _root(graph: g.Graph) -> str:
    helped = graph.pairs(":hasAssistance").select("s")
    return graph.pairs(":hasRelatedIncident").join(helped, "s", "left_semi").agg(F.min("s")).first()[0]


_SCOPE = f"scope AS (SELECT {_ROOT} AS event UNION SELECT b FROM related WHERE a = {_ROOT})"


@query(GRAPH_SQL + f""", {_SCOPE}, hit AS (SELECT r.* FROM rec r JOIN scope s ON s.event = r.event WHERE l_linenumber <= 6),
    said(node, predicate, value, unit) AS (SELECT node, unnest(CASE l_linenumber WHEN 1 THEN [':displacedFamilies', ':displacedPersons'] WHEN 2 THEN [':casualtyCount', ':isOfCasualtyType'] WHEN 3 THEN [':evacuationCenters'] WHEN 4 THEN [':infraDamageAmount', ':socialDamageAmount']
            WHEN 5 THEN [CASE WHEN l_returnflag = 'A' THEN ':totallyDamagedHouses' ELSE ':partiallyDamagedHouses' END] ELSE [':productionLossVolume', CASE l_partkey % 3 WHEN 0 THEN ':agriDamageAmount' WHEN 1 THEN ':productionLossCost' END] END),
        unnest(CASE l_linenumber WHEN 1 THEN [CAST(l_suppkey % 9 + 1 AS VARCHAR), CASE WHEN l_partkey % 4 <> 0 THEN CAST(q AS VARCHAR) END] WHEN 2 THEN [CAST(q AS VARCHAR), l_returnflag] WHEN 4 THEN [CAST(CAST(round(CAST(l_extendedprice AS DECIMAL(18, 2)), 0) AS BIGINT) AS VARCHAR), CASE WHEN l_partkey % 2 = 0 THEN CAST(l_suppkey AS VARCHAR) END]
            WHEN 6 THEN [CAST(q AS VARCHAR), CAST(l_suppkey + l_partkey % 3 + 1 AS VARCHAR)] ELSE [CAST(q AS VARCHAR)] END), unnest(CASE l_linenumber WHEN 4 THEN ['PHP', 'PHP'] WHEN 6 THEN [NULL, 'PHP'] ELSE [NULL, NULL] END) FROM hit)
    SELECT h.event, h.node AS impact, h.location, x.label AS location_label, s.predicate, s.value, s.unit FROM hit h JOIN said s ON s.node = h.node AND s.predicate IS NOT NULL AND s.value IS NOT NULL JOIN location x ON x.code = h.location""")
def event_impacts(spark, sf_dir):
    graph = driver_graph(spark, sf_dir)
    return g.event_impacts(graph, _root(graph), ":Impact").select("event", "impact", "location", "location_label", "predicate", "value", "unit")


@question(f""", {_SCOPE} SELECT DISTINCT 'org/' || l_suppkey AS organisation, ':contributingOrg' AS property, r.node AS holder, r.event FROM rec r JOIN scope s ON s.event = r.event WHERE l_linenumber = 7 AND l_suppkey % 6 = 3""")
def event_organisations(spark, sf_dir):
    graph = driver_graph(spark, sf_dir)
    return g.event_organisations(graph, _root(graph), "org/").select("organisation", "property", "holder", "event")


@question(f""", {_SCOPE} SELECT DISTINCT o.source, o.record, o.event FROM origin o JOIN scope s ON s.event = o.event""")
def event_sources(spark, sf_dir):
    graph = driver_graph(spark, sf_dir)
    return g.event_sources(graph, _root(graph)).select("source", "record", "event")


@question(f""", own AS (SELECT * FROM raw WHERE event = {_ROOT}) SELECT 'core' AS kind, event AS resource, name AS label, start_date[1:10] AS start, end_date[1:10] AS "end" FROM own
    UNION ALL SELECT 'location', l.code, x.label, NULL, NULL FROM event_location l JOIN own ON own.event = l.event JOIN location x ON x.code = l.code
    UNION ALL SELECT 'disasterType', t.type_id, lower(t.type_id), NULL, NULL FROM event_type t JOIN own ON own.event = t.event UNION ALL SELECT 'source', o.source, NULL, NULL, NULL FROM origin o JOIN own ON own.event = o.event
    UNION ALL SELECT 'incident', r.b, e.name, e.start_date[1:10], e.end_date[1:10] FROM related r JOIN own ON own.event = r.a JOIN raw e ON e.event = r.b
    UNION ALL SELECT 'alternate', a.b, e.name, e.start_date[1:10], e.end_date[1:10] FROM alternate a JOIN own ON own.event = a.a JOIN raw e ON e.event = a.b""")
def event_details(spark, sf_dir):
    graph = driver_graph(spark, sf_dir)
    return g.event_details(graph, _root(graph))


@question("SELECT x.code AS place, x.label, x.parent, y.label AS parent_label FROM location x LEFT JOIN location y ON y.code = x.parent WHERE x.level = 'Province'")
def places_of_level(spark, sf_dir):
    return g.places_of_level(driver_graph(spark, sf_dir), ":Province")


_LINKS = ", ".join(f"('{s}', '{p}', '{o}')" for s, p, o in ONTOLOGY)


@query(f"""WITH t(s, p, o) AS (VALUES {_LINKS}) SELECT s AS source, o AS target, 'subClassOf' AS property FROM t WHERE p = 'rdfs:subClassOf'
    UNION SELECT d.o, r.o, d.s FROM t d JOIN t r ON r.s = d.s AND r.p = 'rdfs:range' WHERE d.p = 'rdfs:domain'""")
def ontology_links(spark, sf_dir):
    return g.ontology_links(driver_graph(spark, sf_dir), ":")


@query(f"WITH t(s, p, o) AS (VALUES {_LINKS}) SELECT DISTINCT s AS class FROM t WHERE p = 'rdf:type' AND o = 'owl:Class'")
def ontology_classes(spark, sf_dir):
    return g.ontology_classes(driver_graph(spark, sf_dir), ":").select("class")


@query(f"WITH t(s, p, o) AS (VALUES {_LINKS}) SELECT s AS class FROM t WHERE o = 'owl:Class' AND s NOT IN (SELECT o FROM t WHERE p = 'rdfs:subClassOf')")
def leaf_classes(spark, sf_dir):
    return g.leaves(driver_graph(spark, sf_dir), "rdf:type", "owl:Class", "rdfs:subClassOf").select(F.col("node").alias("class"))


@question("SELECT t.id, lower(t.id) AS label, t.parent FROM taxonomy t")
def taxonomy_rows(spark, sf_dir):
    return g.taxonomy(driver_graph(spark, sf_dir), loaded_store(spark, sf_dir).taxonomy.select("id"))


# --- inference -------------------------------------------------------------------------------------------------------


def _facts(graph: g.Graph, *predicates: str) -> DataFrame:
    return graph.facts(*predicates).select("s", "p", "o")


@question("SELECT event AS s, node AS o FROM rec WHERE l_linenumber <= 6")
def inferred_subproperties(spark, sf_dir):
    links = [f":{link}" for _, link, _, _, _ in RECORDS[:6]]
    facts = materialise(_facts(driver_graph(spark, sf_dir), *links), Axioms(subproperty=[(p, ":hasImpact") for p in links]), regime="rdfs")
    return facts.filter("p = ':hasImpact' AND inferred").select("s", "o")


@question("""SELECT a AS s, location AS o FROM related JOIN rec ON rec.event = b WHERE l_linenumber = 2 UNION SELECT event, location FROM rec WHERE l_linenumber = 2""")
def inferred_chains(spark, sf_dir):
    """Where the casualties of an event or of its incidents were, through two chains, one of which builds on the other."""
    graph = driver_graph(spark, sf_dir)
    harmed = graph.pairs("rdf:type", to=[":Casualties"]).select("s")
    facts = _facts(graph, ":hasRelatedIncident", ":hasCasualties").unionByName(graph.facts(":hasLocation", after=(":hasCasualties",)).select("s", "p", "o").join(harmed, "s", "left_semi"))
    axioms = Axioms(chains=[(":hasCasualties", ":hasLocation", ":harmedAt"), (":hasRelatedIncident", ":harmedAt", ":harmedAt")])
    return materialise(facts, axioms).filter("p = ':harmedAt'").select("s", "o")


@question("SELECT descendant AS s, ancestor AS o FROM location_closure WHERE depth > 0")
def inferred_transitive(spark, sf_dir):
    return materialise(_facts(driver_graph(spark, sf_dir), ":isPartOf"), Axioms(transitive=[":isPartOf"])).select("s", "o")


@question("SELECT a AS o, b AS s FROM related")
def inferred_inverses(spark, sf_dir):
    facts = _facts(driver_graph(spark, sf_dir), ":hasRelatedIncident")
    return materialise(facts, Axioms(inverse=[(":hasRelatedIncident", ":isRelatedTo")])).filter("p = ':isRelatedTo'").select("s", "o")


@question("SELECT event AS s, 'other:' || event_class AS o FROM event WHERE event_class = 'Incident' UNION ALL SELECT event, ':DisasterEvent' FROM event WHERE event_class = 'Incident'")
def inferred_equivalents(spark, sf_dir):
    graph = driver_graph(spark, sf_dir)
    incidents = graph.facts("rdf:type", to=[":Incident"]).select("s", "p", "o")
    facts = materialise(incidents, Axioms(equivalent=[(":Incident", "other:Incident")], subclass=[("other:Incident", ":DisasterEvent")]))
    return facts.filter(F.col("p") == TYPE).filter("inferred").select("s", "o")


@question("SELECT event AS s, ':DisasterEvent' AS o FROM rec WHERE l_linenumber = 3 UNION SELECT node, ':PreemptiveEvacuation' FROM rec WHERE l_linenumber = 3")
def inferred_domains(spark, sf_dir):
    facts = _facts(driver_graph(spark, sf_dir), ":hasPreemptiveEvacuation")
    axioms = Axioms(domain=[(":hasPreemptiveEvacuation", ":DisasterEvent")], range=[(":hasPreemptiveEvacuation", ":PreemptiveEvacuation")])
    return materialise(facts, axioms, regime="rdfs").filter(F.col("p") == TYPE).select("s", "o")


@question("""SELECT event AS s, name AS o FROM raw WHERE contains(lower(name), 'urgent') UNION ALL SELECT event, incident FROM (SELECT event, CASE WHEN event_name LIKE 'status%' THEN event_name END AS incident FROM event) WHERE contains(lower(incident), 'urgent')""")
def any_literal(spark, sf_dir):
    """Literals of any property of events that hold a word, as a wildcard data property finds them."""
    graph = driver_graph(spark, sf_dir)
    return graph.literals(":DisasterEvent").filter(F.contains(F.lower("o"), F.lit("urgent"))).join(graph.typed(":DisasterEvent"), "s", "left_semi").select("s", "o")
