import pytest

from tidemark.plans.sparql import sparql

ROWS = """e1 rdf:type :MajorEvent iri|e2 rdf:type :MajorEvent iri|e3 rdf:type :Incident iri|e4 rdf:type :Incident iri|e1 :startDate 2020-01-05 literal|e2 :startDate 2020-01-03 literal|e3 :startDate 2021-02-01 literal
e1 :eventName Storm_Ana literal|e2 :eventName Ana literal|e1 prov:alternateOf e2 iri|e2 prov:alternateOf e1 iri|e1 :hasLocation c1 iri|e2 :hasLocation p1 iri|e3 :hasLocation r2 iri
c1 :isPartOf p1 iri|p1 :isPartOf r1 iri|x :isPartOf y iri|y :isPartOf x iri|e1 :hasCasualties b1 blank|b1 :dead 3 literal|e1 :hasCasualties b2 blank|b2 :dead 4 literal|e3 :dead 10 literal|r1 rdfs:label North literal"""


@pytest.fixture(scope="module")
def graph(spark):
    rows = [r.split(" ") for line in ROWS.splitlines() for r in line.split("|")]
    return spark.createDataFrame([(s, p, o.replace("_", " "), k) for s, p, o, k in rows], "s string, p string, o string, o_kind string")


def rows(graph, text):
    return sorted(map(tuple, sparql(graph, text).collect()), key=repr)


E, N = ("VALUES ?e { <e1> <e2> <e3> <e4> }"), None


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("SELECT ?e WHERE { ?e a :Incident }", [("e3",), ("e4",)]),
        ("SELECT ?e ?n WHERE { ?e a ?c ; :startDate ?d . OPTIONAL { ?e :eventName ?n } FILTER(?d >= '2020-01-04') }", [("e1", "Storm Ana"), ("e3", None)]),
        ("SELECT ?r WHERE { <c1> :isPartOf* ?r }", [("c1",), ("p1",), ("r1",)]),
        ("SELECT ?r WHERE { <x> :isPartOf+ ?r }", [("x",), ("y",)]),
        ("SELECT ?l WHERE { <e1> :hasLocation/:isPartOf+/rdfs:label ?l }", [("North",)]),
        ("SELECT ?a WHERE { <e2> (:hasLocation|^prov:alternateOf) ?a }", [("e1",), ("p1",)]),
        (
            "SELECT ?e WHERE { ?e :startDate ?d FILTER NOT EXISTS { ?e prov:alternateOf ?o . ?o :startDate ?od . FILTER(?od < ?d || (?od = ?d && STR(?o) < STR(?e))) } }",
            [("e2",), ("e3",)],
        ),
        ("SELECT ?e WHERE { ?e :startDate ?d FILTER(?d > '2021' || EXISTS { ?e :hasLocation <p1> }) }", [("e2",), ("e3",)]),
        ("SELECT ?e (SUM(xsd:decimal(?n)) AS ?dead) WHERE { ?e :hasCasualties [ :dead ?n ] } GROUP BY ?e", [("e1", "7.000000")]),
        ("SELECT (COUNT(DISTINCT ?e) AS ?n) (GROUP_CONCAT(DISTINCT ?c ; SEPARATOR = '|') AS ?cs) WHERE { ?e a ?c }", [("4", ":Incident|:MajorEvent")]),
        ("SELECT ?c (COUNT(*) AS ?n) WHERE { ?e a ?c . ?e :startDate ?d } GROUP BY ?c HAVING(COUNT(*) > 1)", [(":MajorEvent", "2")]),
        ("SELECT ?e ?k WHERE { { ?e :eventName ?n BIND('named' AS ?k) } UNION { ?e :dead ?n } FILTER(isIRI(?e)) }", [("b1", N), ("b2", N), ("e1", "named"), ("e2", "named"), ("e3", N)]),
        ("SELECT ?e WHERE { ?e a ?c MINUS { ?e :startDate ?d } }", [("e4",)]),
        ("SELECT ?e ?l WHERE { VALUES (?e ?l) { (<e1> UNDEF) (<e3> <r2>) } ?e :hasLocation ?l }", [("e1", "c1"), ("e3", "r2")]),
        ("SELECT ?e ?d WHERE { ?e :startDate ?d } ORDER BY DESC(?d) LIMIT 1 OFFSET 1", [("e1", "2020-01-05")]),
        ("SELECT DISTINCT ?p WHERE { <b1> ?p ?o FILTER(isLiteral(?o)) }", [(":dead",)]),
        ("SELECT ?e (COALESCE(?n, 'none') AS ?m) (IF(BOUND(?n), 1, 0) AS ?f) WHERE { ?e a :MajorEvent OPTIONAL { ?e :eventName ?n FILTER(CONTAINS(LCASE(?n), 'storm')) } }", [("e1", "Storm Ana", "1"), ("e2", "none", "0")]),
        ("SELECT ?y (MAX(?v) AS ?m) WHERE { { SELECT ?e (YEAR(?d) AS ?y) WHERE { ?e :startDate ?d } } ?e :dead ?v } GROUP BY ?y", [("2021", "10")]),
        ("SELECT (STRAFTER('a#b', '#') AS ?x) (SUBSTR('abcd', 2, 2) AS ?y) (2 + 3 AS ?z) WHERE { }", [("b", "bc", "5.000000")]),
        ("PREFIX q: <c> SELECT ?r WHERE { q:1 :isPartOf ?r } # done", [("p1",)]),
    ],
)
def test_queries(graph, text, expected):
    assert rows(graph, text) == sorted(expected, key=repr)


def test_ask_and_guard(graph):
    assert rows(graph, "ASK { ?e a :Incident }") == [(True,)] and rows(graph, "ASK { ?e a :Nothing }") == [(False,)]
    for text in ("DELETE WHERE { ?s ?p ?o }", "SELECT ?x WHERE { ?x :p 'load' }"):
        with pytest.raises(ValueError, match="read-only"):
            sparql(graph, text)
    for text in ("SELECT ?x WHERE { ?x :p", "SELECT ?x WHERE { } extra", "SELECT (FOO(?x) AS ?y) WHERE { ?x a ?z }"):
        with pytest.raises(ValueError):
            sparql(graph, text)


@pytest.fixture(scope="module")
def named(spark):
    rows = [("g1", "a", ":name", "Haus", "literal", None, "de"), ("g1", "a", ":name", "house", "literal", None, "en-GB"), ("g1", "a", ":n", "5", "literal", "xsd:int", None), ("g2", "a", ":name", "house", "literal", None, None), ("g2", "b", ":of", "a", "iri", None, None), ("g1", "b", ":of", "a", "iri", None, None)]
    return spark.createDataFrame(rows, "g string, s string, p string, o string, o_kind string, o_dt string, o_lang string")


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("SELECT ?n WHERE { GRAPH <g2> { ?x :name ?n } }", [("house",)]),
        ("SELECT ?g ?x WHERE { GRAPH ?g { ?x :of <a> } }", [("g1", "b"), ("g2", "b")]),
        ("SELECT ?g WHERE { GRAPH ?g { ?x :of ?y . ?y :n ?v } }", [("g1",)]),
        ("SELECT ?x WHERE { ?x :of <a> }", [("b",)]),
        ("SELECT ?n WHERE { ?x :name ?n FILTER(LANG(?n) = 'de') }", [("Haus",)]),
        ("SELECT ?n WHERE { ?x :name ?n FILTER(LANGMATCHES(LANG(?n), 'en')) }", [("house",)]),
        ("SELECT ?x ?g WHERE { GRAPH ?g { ?x :name 'house'@en-GB } }", [("a", "g1")]),
        ("SELECT ?x WHERE { ?x :n '5'^^xsd:int }", [("a",)]),
        ("SELECT ?x WHERE { ?x :n '5'^^xsd:string }", []),
        ("SELECT (DATATYPE(?v) AS ?d) WHERE { ?x ?p ?v FILTER(isLiteral(?v) && isNumeric(?v)) }", [("xsd:int",)]),
        ("CONSTRUCT { ?y :has ?x ; :called ?n . ?n :bad ?x } WHERE { ?x :of ?y . ?y :name ?n }", [("a", ":called", "Haus", "literal", None, "de"), ("a", ":called", "house", "literal", None, "en-GB"), ("a", ":called", "house", "literal", None, None), ("a", ":has", "b", "iri", None, None)]),
        ("DESCRIBE <b>", [("b", ":of", "a", "iri", None, None)]),
        ("DESCRIBE ?y WHERE { GRAPH <g1> { <b> :of ?y } }", [("a", ":n", "5", "literal", "xsd:int", None), ("a", ":name", "Haus", "literal", None, "de"), ("a", ":name", "house", "literal", None, "en-GB"), ("a", ":name", "house", "literal", None, None)]),
    ],
)
def test_graphs_tags_and_built_triples(named, text, expected):
    assert rows(named, text) == sorted(expected, key=repr)
