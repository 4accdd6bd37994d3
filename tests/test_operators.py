"""Operators on small tables with nulls and ties; expected values are worked out by hand."""

import datetime as dt
import random
import uuid
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates, identity, numbers, similarity, strings
from tidemark.model import EventStore
from tidemark.operators import checks, classify, hierarchy, inference, match, reshape, resolve, sequence
from tidemark.operators.components import connected_components
from tidemark.operators.events import EventFilter, filtered_events, page
from tidemark.operators.impacts import impacts, with_facets, with_impacts
from tidemark.plans import analysis


def values(spark, cells, make):
    frame = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    return [r[0] for r in frame.orderBy("i").select(make(F.col("c"))).collect()]


@pytest.fixture(scope="module")
def store(spark):
    make = spark.createDataFrame
    events = [
        ("x/gda/1", "GDA", "MajorEvent", "Ana", None, "2023-08-01", None), ("x/emdat/2", "EM-DAT", "MajorEvent", None, "=SUM(1,1)", "2023-08-01T05:00:00", "2023-08-03"),
        ("x/ndrrmc/3", "NDRRMC", "Incident", None, None, "2024-01-10", None), ("x/gda/4", "GDA", "Incident", "No date", None, None, None), ("x/gda/5", "GDA", "MajorEvent", "Short", None, "2024", None), ("x/gda/6", "GDA", "Incident", "Late", None, "2024-02-01", None),
    ]
    alternates = [("x/gda/1", "x/emdat/2"), ("x/gda/6", "x/gda/1"), ("x/ndrrmc/3", "x/gda/4")]
    return EventStore(
        event=make(events, "event string, source string, event_class string, event_name string, incident_description string, start_date string, end_date string"),
        event_location=make([("x/gda/1", "C1"), ("x/emdat/2", "P1"), ("x/ndrrmc/3", "R2"), ("x/gda/5", None)], "event string, code string"),
        event_type=make([("x/gda/1", "Flood"), ("x/emdat/2", "Storm"), ("x/emdat/2", "Flood"), ("x/ndrrmc/3", "Unknown")], "event string, type_id string"),
        casualty=make([("x/emdat/2", "dead", 2), ("x/emdat/2", "dead", 3), ("x/ndrrmc/3", "injured", 1)], "event string, kind string, cnt long"),
        population=make([("x/emdat/2", 15, None), ("x/emdat/2", None, 50)], "event string, families long, persons long"),
        damage=make([("x/emdat/2", Decimal("7.5"), "PHP"), ("x/gda/5", Decimal("10"), "PHP"), ("x/gda/5", Decimal("20"), "USD"), ("x/ndrrmc/3", None, "PHP")], "event string, amount decimal(18,2), unit string"),
        alternate=make(alternates + [(b, a) for a, b in alternates], "a string, b string"),
        location=make([("C1", "City", "City", "P1"), ("P1", "Province", "Province", "R1"), ("R1", "One", "Region", None), ("R2", "Two", "Region", None)], "code string, label string, level string, parent string"),
        taxonomy=make([("Flood", "flood", None, "Hydro"), ("Storm", "Storm", None, "Meteo"), ("Hydro", None, None, "Natural"), ("Meteo", None, None, "Natural"), ("Natural", None, None, None)], "id string, label string, note string, parent string"),
    )


def ids(df):
    return [r.event.split("/")[-1] for r in df.orderBy("event").collect()]


def test_suppression_and_filters(store):
    # Same day: the smaller id stays; 6 has an earlier alternate; 3's alternate has no date and does not count.
    assert ids(filtered_events(store)) == ["2", "5", "3"]
    assert ids(filtered_events(store, suppress=False)) == ["2", "1", "5", "6", "3"]
    assert ids(filtered_events(store, EventFilter(locations=("R1",)))) == ["2"]
    assert ids(filtered_events(store, EventFilter(types=("Natural",)))) == ["2"]
    assert ids(filtered_events(store, EventFilter(event_type="incidents"))) == ["3"]
    # An event hidden by an alternate stays hidden though that alternate is outside the range.
    assert ids(filtered_events(store, EventFilter(start="2024-01-15", end="2024-03-01"))) == []
    assert ids(filtered_events(store, EventFilter(text="sum(1"))) == ["2"] and ids(filtered_events(store, EventFilter(text="%"))) == []
    first = page(filtered_events(store), "end", False, 0, 2).collect()
    assert [r.end_date for r in first] == [None, None] and first[0].event < first[1].event


@pytest.mark.parametrize("bad", [{"event_type": "x"}, {"start": "2024-13-01"}, {"start": "2025-01-02", "end": "2025-01-01"}, {"locations": ("1) } UNION {",)}, {"types": ("Flood> }",)}])
def test_filters_reject_malformed_values(bad):
    with pytest.raises(ValueError):
        EventFilter(**bad)


def test_filters_are_sorted_and_unique():
    assert EventFilter(locations=("B", "A", "B")).locations == ("A", "B")


def test_impacts_and_units(store):
    got = {r.event: r for r in impacts(store).collect()}
    two, five = got["x/emdat/2"], got["x/gda/5"]
    assert (two.dead, two.injured, two.families, two.persons, two.damage, two.damage_unit) == (5, 0, 15, 50, Decimal("7.5"), "PHP")
    assert (five.damage, five.damage_unit, len(five.damage_by_unit), five.dead) == (None, None, 2, 0)
    assert {r.event: r.damage for r in with_impacts(filtered_events(store), store).collect()}["x/ndrrmc/3"] == 0
    facets = {r.event: r for r in with_facets(store.event.select("event"), store).collect()}
    assert [(t.id, t.label) for t in facets["x/emdat/2"].types] == [("Flood", "flood"), ("Storm", "Storm")] and facets["x/ndrrmc/3"].types[0].label == "Unknown"


def test_analysis(store):
    assert analysis.summary(store).first().asDict() == {"records": 3, "dead": 5, "injured": 1, "missing": 0, "families": 15, "persons": 50}
    assert {(r.grp, r.events) for r in analysis.counts_by_type(store, by_root=True).collect()} == {("Natural", 1), ("Unknown", 1)}
    assert [(r.period, r.events) for r in analysis.calendar(store, digits=7).collect()] == [("2023-08", 1), ("2024-01", 1)]
    assert {(r.period, r.grp) for r in analysis.category_stacks(store, month_of_year=True).collect()} == {("08", "Natural"), ("01", "Unknown")}
    assert {(r.region, r.events) for r in analysis.region_rankings(store).collect()} == {("R1", 1), ("R2", 1)}
    bins = {(r.unit, r.bin): (r.lower, r.upper, r.events) for r in analysis.damage_histogram(store, bins=2).collect()}
    assert bins == {("PHP", 0): (7.5, 8.75, 1), ("PHP", 1): (8.75, 10.0, 1), ("USD", 0): (20.0, 20.0, 1)}
    rows = {r.event: r for r in analysis.export_rows(store).collect()}
    assert rows["x/emdat/2"].event_name == "'=SUM(1,1)" and rows["x/ndrrmc/3"].event_name == "(unnamed event)" and rows["x/gda/5"].damage_unit == "multiple" and rows["x/gda/5"].damage == "10.0 PHP | 20.0 USD"
    for wrong in ({"bins": 0}, {"unit": "PHP> UNION"}):
        with pytest.raises(ValueError):
            analysis.damage_histogram(store, **wrong)
    with pytest.raises(ValueError):
        analysis.calendar(store, prefix="2023-8")


def test_closures_on_cycles_and_long_paths(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", None), ("y", "y")], "child string, parent string")
    got = {(r.descendant, r.ancestor): r.depth for r in hierarchy.path_closure(edges).collect()}
    assert got[("a", "a")] == 3 and got[("a", "d")] == 3 and got[("y", "y")] == 1 and len(got) == 13
    assert {r.root for r in hierarchy.roots(spark.createDataFrame([("a", "b"), ("b", None)], "id string, parent string"), "id", "parent").collect()} == {"b"}
    for links in ([("a", "b"), ("b", "c"), ("c", None)], [(str(i), str(i + 1)) for i in range(12)] + [("12", None)], [("a", "b"), ("b", "a")], [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", None)]):
        got = {(r.descendant, r.ancestor): r.depth for r in hierarchy.closure(spark.createDataFrame(links, "id string, parent string"), "id", "parent").collect()}
        expected = {(x, x): 0 for x, _ in links}
        for _ in links:
            for (x, y), depth in list(expected.items()):
                for child, up in links:
                    if child == y and up is not None:
                        expected[(x, up)] = min(depth + 1, expected.get((x, up), 99))
        assert got == expected
    places = spark.createDataFrame([("1400101001", "Bgy"), ("1400101000", "Mun"), ("1400100000", "Prov"), ("1400000000", "Reg"), ("1300500000", "City")], "code string, level string")
    assert {r.code: r.parent for r in hierarchy.resolve_parents(places.unionByName(spark.createDataFrame([("1300000000", "Reg")], places.schema))).collect()} == {"1400101001": "1400101000", "1400101000": "1400100000", "1400100000": "1400000000", "1400000000": None, "1300500000": "1300000000", "1300000000": None}


def test_components_of_chains_stars_and_cycles(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(1, i) for i in range(2, 30)] + [(50, 51), (51, 52), (52, 50), (60, 60), (None, 5), (3, None), (51, 50)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 141)} == {100} and {got[i] for i in range(1, 30)} == {1} and got[52] == 50 and 60 not in got
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_identity(spark):
    names = ["", "abc", "Ümläut", "x" * 200]
    assert values(spark, [*names, None], lambda c: identity.uuid5(identity.EVENT_NAMESPACE, c)) == [str(uuid.uuid5(uuid.UUID(identity.EVENT_NAMESPACE), n)) for n in names] + [None]
    assert values(spark, [" Ana "], lambda c: identity.named_event_id(identity.DROMIC_NAMESPACE, c, F.lit("2020-01-01"))) == [uuid.uuid5(uuid.UUID(identity.DROMIC_NAMESPACE), "ana:2020-01-01").hex]
    assert values(spark, ["a b.v1, #2.pdf"], identity.report_iri) == [identity.BASE + "a_bv1_2"]
    assert values(spark, ["http://x/y#z", "plain", "http://x/"], identity.local_name) == ["z", "plain", ""]
    assert values(spark, ["h/ndrrmc/3", "h/other"], lambda c: identity.source_of(c, {"ndrrmc": "NDRRMC"})) == ["NDRRMC", None]


def test_numbers(spark):
    assert values(spark, ["1,234", "12.5", "-3 ", "none", "", None, "1-2", "PHP 7"], numbers.to_int) == [1234, 13, -3, None, None, None, None, 7]
    assert values(spark, ["2,500,000.00", "-1000000", ""], numbers.to_millions) == [2.5, 1.0, None]
    assert values(spark, ["17, 7, 785", "28. 8. 23", " ,5.", "1, 1, 562, 599"], numbers.repair_digits) == ["17785", "28.23", "5", "1562599"]
    assert values(spark, ["up to -3.5 m", "1,200 mm", "no"], numbers.first_number) == [-3.5, 1200.0, None]


def test_strings(spark):
    assert values(spark, ["TS Ana", "TD TS x", "none"], lambda c: strings.expand_first(c, {"TD": "Tropical depression", "TS": "Tropical storm"})) == ["Tropical storm Ana", "Tropical depression TS x", "none"]
    assert [tuple(r) for r in values(spark, ["Brgy. Proper, Calamba, Laguna", "Quezon City"], strings.barangay)] == [("Proper", "Calamba, Laguna"), (None, "Quezon City")]
    assert values(spark, ["DSWD, LGU and NGO; LGU / X", " "], strings.split_list) == [["DSWD", "LGU", "NGO", "X"], []]
    assert values(spark, ["=1", "+x", "@", "ok", "-5"], strings.spreadsheet_safe) == ["'=1", "'+x", "'@", "ok", "'-5"]
    assert values(spark, ["Flashflood|Fire (Misc)", "[a: b]", "none"], lambda c: strings.type_slugs(c, [("Misc", "Miscellaneous"), ("Flashflood", "FlashFlood")])) == [["FlashFlood", "FireMiscellaneous"], [], []]
    assert values(spark, ["Ñueva  Écija!"], strings.folded) == ["nueva ecija"] and values(spark, ["Typhoon Ana hit Cebu City"], strings.proper_nouns) == [["Typhoon", "Cebu", "City"]]


def test_each_step_of_place_names(spark):
    steps = {
        "(3) Cebu": ["Cebu"], "Cebu PROVINCES": ["Cebu"], "Panay Isl.": ["Western Visayas"], "Region IV": ["IV"], "Quezon Municipality": ["Quezon"], "near Mt. Apo": ["Apo"], "Samar-East": ["Samar"], "Leyte (Ormoc)": ["Leyte", "Ormoc"],
        "Cebu and Bohol": ["Cebu", "Bohol"], "Cebu cty": ["Cebu City"], "A;B,C": ["A", "B", "C"], "Manille": ["Manila"], "Nationwide": ["Philippines"], "all country": ["Philippines"], "Visayan": ["Visayas"], "central": ["Visayas"],
        "W. Samar": ["Samar"], "n. Samar": ["Samar"], "Ctr.x": ["Centralx"], "West Luzon": ["Luzon"], "Luzonnn": ["Luzon"], "Luzo": ["Luzon"], "Visayas Luzon": ["Visayas", "Luzon"], "Davao city": ["Davao City"], "Bagio": ["Baguio"],
    }
    assert dict(zip(steps, values(spark, list(steps), strings.place_names), strict=True)) == steps
    assert values(spark, ["Ţăndărei Žižkov", "ça_va? 42", "e\u0301te\u0301", "Ελλάς!"], strings.folded) == ["tandarei zizkov", "ca_va 42", "ete", "ελλας"]


def test_places_and_merged_rows(spark):
    assert values(spark, ["Manilla, Cebu province; Bagio cty", "nationwide", "Samar and Leyte"], strings.place_names) == [["Manila", "Cebu", "Baguio City"], ["Philippines"], ["Samar", "Leyte"]]
    frame = spark.createDataFrame([("r", "a  b   c", "1  2"), ("q", None, "5")], "k string, x string, y string")
    assert sorted((tuple(r) for r in reshape.split_rows(frame, ["x", "y"]).collect()), key=repr) == sorted([("r", "a", "1"), ("r", "b", "2"), ("r", "c", None), ("q", None, None)], key=repr)


def test_dates(spark):
    cells = ["1918–1919", "August 10, 2008 – July 14, 2009", "April–June 1957", "2–7 July 2001", "Nov 12–15 2003", "August 31 – September 4, 1984", "1984", "2001-02-03", "April 1965-June 1966", "5 May 2005", "gibberish", None]
    assert [tuple(r) for r in values(spark, cells, dates.date_range)] == [
        ("1918-01-01", "1919-12-31"), ("2008-08-10", "2009-07-14"), ("1957-04-01", "1957-06-30"), ("2001-07-02", "2001-07-07"), ("2003-11-12", "2003-11-15"), ("1984-08-31", "1984-09-04"),
        ("1984-01-01", "1984-12-31"), ("2001-02-03", "2001-02-03"), ("1965-04-01", "1966-06-30"), ("2005-05-05", "2005-05-05"), (None, None), (None, None),
    ]
    more = {
        "10 May 1990 PST": ("1990-05-10", "1990-05-10"), "10 MAY 1990": ("1990-05-10", "1990-05-10"), "May 10, 1990 08:30 AM": ("1990-05-10", "1990-05-10"), "Sept 3rd 2001": ("2001-09-03", "2001-09-03"),
        "30 Feb 2001": (None, None), "2001-02-03 10:11:12": ("2001-02-03", "2001-02-03"), "April–June 1957 (some say more)": ("1957-04-01", "1957-06-30"), "April 5, 2001 – 2003": (None, None), "5 – May 2001": (None, None),
        "Foo–June 1957": (None, None), "1 2 May 2001": (None, None), "12/25/2003": ("2003-12-25", "2003-12-25"), "25/12/2003": ("2003-12-25", "2003-12-25"), "31–2 May 2001": ("2001-05-31", "2001-05-02"), "Nov 30 — Dec 2, 1999": ("1999-11-30", "1999-12-02"), "": (None, None),
    }
    assert dict(zip(more, (tuple(r) for r in values(spark, list(more), dates.date_range)), strict=True)) == more
    parts = spark.createDataFrame([(2020, 2, None), (2020, None, None), (2020, 3, 4)], "y int, m int, d int")
    ends = [r[0] for r in parts.select(dates.assembled(F.col("y"), F.col("m"), F.col("d"), end=True)).collect()]
    assert ends == [dt.date(2020, 2, 29), dt.date(2020, 12, 31), dt.date(2020, 3, 4)]
    assert values(spark, ["2020-01-05", "2020-12-05", "2020-06-05"], lambda c: dates.year_windows(c.cast("date"))) == [[2020, 2019], [2020, 2021], [2020]]
    assert values(spark, ["12 March 2020", "x"], lambda c: dates.first_time(c, F.lit("5:30 PM"), ["d MMMM yyyy h:mm a"], ["d MMMM yyyy"])) == [dt.datetime(2020, 3, 12, 17, 30), None]


def test_similarity():
    assert similarity.common_length("abcde", "acxe") == 3 and similarity.indel_ratio("", "") == 1.0
    assert similarity.token_sort_ratio("city quezon", "quezon city") == 1.0 and similarity.token_set_ratio("quezon city", "quezon city ncr") == 1.0 and similarity.partial_ratio("cebu", "in cebu city") == 1.0


def test_sequences(spark):
    rows = spark.createDataFrame([("f", 1, None, None), ("f", 2, "R1", None), ("f", 3, None, "P1"), ("f", 4, None, None), ("f", 5, "R2", None), ("g", 1, None, "P9")], "file string, row int, region string, province string")
    filled = sequence.hierarchical_fill(rows, ["region", "province"], ["file"], ["row"]).orderBy("file", "row").collect()
    assert [(r.region, r.province) for r in filled] == [(None, None), ("R1", None), ("R1", "P1"), ("R1", "P1"), ("R2", None), (None, "P9")]
    assert [r.region for r in sequence.forward_fill(rows, ["region"], ["file"], ["row"]).orderBy("file", "row").collect()] == [None, "R1", "R1", "R1", "R2", None]
    boxes = spark.createDataFrame([(1.0,), (2.0,), (9.0,), (9.5,), (30.0,)], "x double").withColumn("p", F.lit(1))
    assert [r.cluster for r in sequence.gap_clusters(boxes, "x", 3.0, ["p"], ["x"]).orderBy("x").collect()] == [0, 0, 1, 1, 2]


def test_reshaping(spark):
    frame = spark.createDataFrame([("a", "[Flood: Cebu]; [Fire]; ", "1 2")], "k string, inc string, nums string")
    assert [(r.ordinal, r.incident_type, r.incident_place) for r in reshape.bracketed_incidents(frame, "inc").collect()] == [(1, "Flood", "Cebu"), (2, "Fire", None)]
    split = reshape.split_cells(frame, "nums", ["x", "y", "z"]).first()
    assert (split.x, split.y, split.z) == ("1", "2", None)
    left = spark.createDataFrame([("L1", 1), (None, 2)], "loc string, a int")
    right = spark.createDataFrame([("L1", 5, 9), ("L2", 6, 8)], "loc string, b int, a int")
    assert sorted(map(tuple, reshape.full_merge([left, right], "loc").collect()), key=repr) == sorted([("L1", 1, 5), (None, 2, None), ("L2", None, 6)], key=repr)
    moved = reshape.move_values(spark.createDataFrame([("x", "y"), ("k", None)], "s string, t string"), "s", "t", F.col("t").isNull()).collect()
    assert [tuple(r) for r in moved] == [("x", "y"), (None, "k")]
    assert reshape.rename_by_tokens(spark.createDataFrame([(1, 2, 3)], "`Total Families Cum` int, `Evacuee families` int, z int"), {"fam": [["displaced"], ["families", "cum"]], "evac": [["evacuee", "families"]]}).columns == ["fam", "evac", "z"]
    assert [tuple(r) for r in reshape.entities(spark.createDataFrame([(" None ", "5"), ("none", "x"), ("a", None)], "n string, q string"), {"n": "string", "q": "int", "extra": "date"}).collect()] == [(None, 5, None), ("a", None, None)]
    assert [r.v for r in reshape.drop_words(spark.createDataFrame([("Total",), (None,), ("ok",)], "v string"), "v", ["TOTAL"]).collect()] == ["ok"]


def test_entity_resolution(spark):
    day = dt.date(2020, 1, 1)
    events = [("a/ndrrmc/1", "NDRRMC", "Flood", day), ("b/gda/1", "GDA", "Flood", day + dt.timedelta(5)), ("c/gda/2", "GDA", "Flood", day + dt.timedelta(6)), ("d/gda/3", "GDA", "Fire", day), ("e/gda/4", "GDA", "Flood", None), ("f/emdat/5", "EM-DAT", "Flood", None), ("g/dromic/9", "DROMIC", "Flood", dt.date(2019, 12, 30))]
    frame = spark.createDataFrame(events, "event string, source string, type_base string, start date")
    pairs = sorted(tuple(x[0] for x in r) for r in resolve.blocked_pairs(frame).collect())
    assert pairs == [("a", "b"), ("a", "g"), ("e", "f")]
    about = [("x", "MajorEvent", day, "FloodWet", "H", "Typhoon Ana", ["0730600000"]), ("y", "Incident", day + dt.timedelta(3), "FloodDry", "G", "ana TYPHOON", ["1130700000"]), ("z", "MajorEvent", None, None, None, None, None), ("w", "Incident", day, "FloodWet", "H", "Other Typhoon", ["0730600001"])]
    described = spark.createDataFrame(about, "event string, event_class string, start date, type_id string, type_parent string, label string, codes array<string>")
    judged = {(r.a, r.b): (r.date_ok, r.type_ok, r.label_ok, r.place_ok, r.is_match) for r in resolve.scored_pairs(spark.createDataFrame([("x", "y"), ("x", "z"), ("x", "w")], "a string, b string"), described).collect()}
    assert judged == {("x", "y"): (False, True, True, False, False), ("x", "z"): (None, None, None, None, True), ("x", "w"): (True, True, True, True, True)}
    grouped = resolve.clusters(spark.createDataFrame([("p/gda/1", "q/emdat/1"), ("q/emdat/1", "r/ndrrmc/1")], "a string, b string"))
    canonical = resolve.canonical_events(grouped, {"ndrrmc": -1}).first()
    assert canonical.preferred == "r/ndrrmc/1" and canonical.canonical == identity.BASE + "common/" + str(uuid.uuid5(uuid.UUID(identity.EVENT_NAMESPACE), "p/gda/1|q/emdat/1|r/ndrrmc/1"))
    registry = spark.createDataFrame([("k1", "m1"), ("k1", "m2"), ("k2", "m3"), ("k3", "m9")], "canonical string, member string")
    updated = {(r.canonical, r.member) for r in resolve.update_registry(registry, spark.createDataFrame([("m2", "m3"), ("m4", "m1"), ("n1", "n2")], "a string, b string")).collect()}
    assert {x for x in updated if x[1].startswith("m")} == {("k1", "m1"), ("k1", "m2"), ("k1", "m3"), ("k1", "m4"), ("k3", "m9")} and len(updated) == 7
    assert [tuple(r) for r in resolve.new_pairs(spark.createDataFrame([("b", "a"), ("c", "d")], "a string, b string"), spark.createDataFrame([("a", "b")], "a string, b string")).collect()] == [("c", "d")]


def test_label_gate_takes_the_best_ratio(spark):
    pairs = [("flood", "flood in region five", True), ("flood in the north", "north flood", True), ("flood", "landslide", False), ("Typhoon Ana", "quake near Typhoon", True), ("Flood!", "flood", True), (None, "flood", None)]
    frame = spark.createDataFrame([((x,), (y,), e) for x, y, e in pairs], "a struct<label: string>, b struct<label: string>, expected boolean")
    assert [r.got for r in frame.select(resolve.label_gate().alias("got")).collect()] == [e for *_, e in pairs]


def test_classification(spark):
    labels = values(spark, ["Flash flood after rain", "LANDSLIDE in rain", "landslide", "all calm", None], lambda c: classify.rule_labels(c, classify.RULES))
    assert labels == [["FlashFlood", "FloodGeneral"], ["LandslideWet", "LandslideDry"], ["LandslideDry"], [], []]
    groups = [{"LandslideWet", "LandslideDry", "Mudslide"}]
    routed = values(spark, ["Flash flood after rain", "LANDSLIDE in rain", "landslide", "all calm"], lambda c: classify.routed(classify.rule_labels(c, classify.RULES), groups))
    assert [tuple(r) for r in routed] == [("FlashFlood", None), (None, ["LandslideDry", "LandslideWet", "Mudslide"]), ("LandslideDry", None), (None, None)]
    said = spark.createDataFrame([(1, "TCWS No. 2a and storm signal #3; RED rainfall warning, heavy rainfall warning. Flood alert! flood advisory")], "k int, t string")
    assert {(r.kind, r.level) for r in classify.warnings(said, "k", "t").collect()} == {("TCWS", "2A"), ("Public Storm Signal", "3"), ("Rainfall Warning", "RED"), ("Rainfall Warning", None), ("Flood Warning", None)}


def test_fuzzy_matching(spark):
    names = spark.createDataFrame([("Department of Health", "doh", 0), ("DOH", "doh", 1), ("Department of Heath Services", "dhs", 2)], "name string, id string, pos int")
    asked = spark.createDataFrame([("doh",), ("Departmnt of Health",), ("Health, Department of",), ("Unrelated",), (None,)], "query string")
    for exact in (False, True):
        assert {r.query: r.id for r in match.match_names(asked, names, exact_ratio=exact).collect()} == {"doh": "doh", "Departmnt of Health": "doh", "Health, Department of": "doh", "Unrelated": None, None: None}
    places = spark.createDataFrame([("R1", "Laguna", None), ("C1", "Calamba", "R1"), ("R2", "Misamis", None), ("C2", "Calamba", "R2")], "code string, label string, parent string")
    texts = spark.createDataFrame([("Calamba, Laguna",), ("Calamba, Misamis",), ("Laguna",), ("Nowhere",)], "text string")
    assert {r.text: r.code for r in match.match_places(texts, places).collect()} == {"Calamba, Laguna": "C1", "Calamba, Misamis": "C2", "Laguna": "R1", "Nowhere": None}


def test_fuzzy_matching_finds_names_with_other_first_letters(spark):
    names = spark.createDataFrame([("Cagayan", "C", 0), ("Zamboanga", "Z", 1), ("Mindoro", "M", 2), ("Laguna", "L", 3)], "name string, id string, pos int")
    expected = {"Kagayan": "C", "Samboanga": "Z", "Mindoroan": "M", "aguna": "L", "Palawan": None}  # Mindoroan: 0.875, by edits 0.78
    asked = spark.createDataFrame([(q,) for q in expected], "query string")
    for exact in (False, True):
        assert {r.query: r.id for r in match.match_names(asked, names, exact_ratio=exact).collect()} == expected
    letters, rng = "abc ", random.Random(5)
    words = sorted({" ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 9))).split()) for _ in range(60)} - {""})
    known = spark.createDataFrame([(w, str(i), i) for i, w in enumerate(words[::2])], "name string, id string, pos int")
    found = match.match_all(spark.createDataFrame([(w,) for w in words], "query string"), known.select("name", "id"), 0.7)
    brute = {(q, str(i)) for q in words for i, w in enumerate(words[::2]) if similarity.token_sort_ratio(q, w) >= 0.7}
    assert {(r.query, r.id) for r in found.collect()} == brute
    places = spark.createDataFrame([("R1", "Zamboanga", None), ("C1", "Cagayan", "R1")], "code string, label string, parent string")
    assert match.match_places(spark.createDataFrame([("Kagayan, Samboanga",)], "text string"), places).first().code == "C1"


def test_inference(spark):
    facts = spark.createDataFrame([("e", "rdf:type", "Major"), ("e", "hasIncident", "i"), ("i", "hasImpact", "n"), ("n", "hasLocation", "c"), ("c", "partOf", "p"), ("p", "partOf", "r"), ("e", "bawStart", "2020")], "s string, p string, o string")
    axioms = inference.Axioms(subclass=[("Major", "Event"), ("Event", "Entity")], inverse=[("hasIncident", "relatedTo")], transitive=["partOf"], equivalent=[("bawStart", "start")], chains=[("hasImpact", "hasLocation", "hasLocation"), ("hasIncident", "hasLocation", "hasLocation")], subproperty=[("hasIncident", "has")])
    full = {(r.s, r.p, r.o) for r in inference.materialise(facts, axioms).filter("inferred").collect()}
    assert full == {("e", "rdf:type", "Event"), ("e", "rdf:type", "Entity"), ("i", "relatedTo", "e"), ("c", "partOf", "r"), ("e", "start", "2020"), ("i", "hasLocation", "c"), ("e", "hasLocation", "c"), ("e", "has", "i")}
    assert {(r.p, r.o) for r in inference.materialise(facts, axioms, "rdfs").filter("inferred").collect()} == {("rdf:type", "Event"), ("rdf:type", "Entity"), ("has", "i")}
    assert inference.materialise(facts, axioms, "none").filter("inferred").isEmpty()


def test_checks_and_gate(spark):
    rows = spark.createDataFrame([("b1", "e1", "5", 1, 2), ("b1", "e2", "x", 3, 2), ("b2", "e3", None, None, 1)], "batch string, event string, n string, lo int, hi int")
    bad = checks.check_datatype(rows, "event", "n", "int").unionByName(checks.check_less_or_equal(rows, "event", "lo", "hi"))
    assert sorted((r.focus, r.check) for r in bad.collect()) == [("e2", "datatype:n"), ("e2", "order:lo:hi")]
    assert [r.event for r in checks.conforming(rows, "event", bad).orderBy("event").collect()] == ["e1", "e3"]
    kept = []
    assert checks.gate(rows, "batch", "event", bad, lambda df: kept.extend(r.event for r in df.collect())) == ["b1"] and kept == ["e3"]
    with pytest.raises(ValueError):
        checks.gate(rows, "batch", "event", bad, lambda df: None, fail_fast=True)


def test_pairs_judged_where_they_meet(spark):
    """As when pairs are made first and looked up, also where an event is there twice; pairs themselves are not moved."""
    rows = [(i, i % 3, "t" if i % 2 else None, None if i % 7 == 0 else f"2020-01-{i % 9 + 1:02d}", f"flood {i % 4}" if i % 5 else None) for i in range(40)]
    for some in (rows, rows + [(3, 0, "t", "2020-01-02", "flood 9")]):
        df = spark.createDataFrame(some, "event long, source int, type_id string, day string, label string").withColumn("start", F.col("day").cast("date"))
        events = df.select("event", "source", F.lit("b").alias("type_base"), "start")
        described = df.select("event", F.lit("MajorEvent").alias("event_class"), "start", "type_id", F.lit(None).cast("string").alias("type_parent"), "label", F.array().cast("array<string>").alias("codes"))
        fast, slow = resolve.scored_blocked_pairs(events, described, 1), resolve.scored_pairs(resolve.blocked_pairs(events, 1), described)
        assert sorted(map(str, fast.collect())) == sorted(map(str, slow.collect())) and fast.count()
        if some is rows:
            assert "Aggregate" not in fast._jdf.queryExecution().optimizedPlan().toString()
