import datetime as dt
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark import session
from tidemark.__main__ import main
from tidemark.functions import dates, identity, similarity
from tidemark.operators import checks, hierarchy, match, resolve
from tidemark.sources import sheets, turtle, wide, workbooks


def test_header_tiers_and_spans():
    assert sheets.tier_names([["A", "B", None], ["x", "Unnamed: 1", "y"], ["nan", "z", "q"]]) == ["A_x", "B", ""]
    assert sheets.spanned_names([["Families", "", "Total (No.)"], ["cum", "now", None]]) == ["Families_cum", "Families_now", "Total_No_now"]
    assert sheets.spanned_names([["Total", None], ["a b/c", ""]]) == ["Total_a_b_c", "Total_a_b_c"] and sheets.spanned_names([["", ""]]) == ["Column_0", "Column_1"]
    assert sheets.header_lines([["Region", "Families"], ["", "Total"], ["REGION IV", "12"], ["Type", "x"]]) == 2 and sheets.header_lines([["5", "6"]]) == 0 and sheets.header_lines([]) == 0


def test_headers_of_frames(spark):
    frame = spark.createDataFrame([(1, "Place", "Total"), (2, "", "Total"), (3, "x", "5")], "row int, a string, b string")
    assert sheets.with_headers(frame, "row", lines=2).columns == ["row", "Place", "Total"]
    plain = spark.createDataFrame([(1, "x", "5")], "row int, a string, b string")
    assert sheets.with_headers(plain, "row").columns == ["row", "a", "b"] and sheets.with_headers(plain.limit(0), "row").count() == 0
    assert sheets.with_headers(frame, "row", lambda lines: ["n", "n"], 1).columns == ["row", "n", "n_2"]


def test_alignment_and_names():
    assert sheets.aligned(["Total Families", "Persons"], ["persons", "families (total)", "other"]) == {"persons": "Persons", "families (total)": "Total Families"}
    assert sheets.table_name(["Damaged Houses"]) == "number_of_damaged_houses" and sheets.table_name([], 7) == "table_7" and sheets.table_name(["x" * 99]) == "x" * 60


def test_subheaders_and_cleaned_names(spark):
    rows = [("f", 1, "P", "Partially", "Totally"), ("f", 2, "P", "1", "2"), ("f", 3, "P", "both", "words"), ("g", 1, "P", "3", "4"), ("h", 1, "P", "one", None)]
    frame = spark.createDataFrame(rows, "file string, row int, place string, a string, b string")
    kept = sheets.without_subheaders(frame, "row", ["place"], ["file"]).collect()
    assert sorted((r.file, r.row) for r in kept) == [("f", 2), ("f", 3), ("g", 1), ("h", 1)]
    assert sheets.cleaned_names(spark.createDataFrame([(1, 2, 3)], "`Houses.Total.115,840` int, `Region..GRAND TOTAL` int, `5` int")).columns == ["Houses.Total", "Region", "5"]


def test_turtle_takes_no_nonsense(spark):
    for bad in (":a :b :c .", "@prefix : <x:> . :a :b", '@prefix : <x:> . :a :b "open .', "@prefix : <x:> . :a :b ; ; .. "):
        with pytest.raises(ValueError):
            turtle.parse_turtle(bad)
    assert turtle.parse_turtle("") == [] and turtle.parse_turtle("# nothing\n@prefix a: <http://a/> .") == []
    two = spark.createDataFrame([("one", "@prefix : <x:> . :a :b [ :c 1 ] ."), ("two", "@prefix : <x:> . :a :b [ :c 1 ] ."), ("three", None)], "path string, text string")
    rows = turtle.turtle_triples(two, "g").collect()
    assert len(rows) == 4 and len({r.o for r in rows if r.o_kind == "blank"}) == 2


def test_wide_rows_of_nothing(spark):
    empty = spark.createDataFrame([], "row int, Dead string, Event string")
    assert wide.archive_rows(empty, {"Dead": "dead", "Event": "eventName"}).count() == 0 and wide.catalogue_rows(empty, {"x": "Y"}).count() == 0
    row = spark.createDataFrame([("e", "A|B", None, "none", "5")], "event string, hasLocation string, areDamsAffected string, isTapAffected string, dead string")
    water = next(e for e in wide.ARCHIVE if e.cls == "WaterDisruption")
    assert wide.entity_rows(row, water).count() == 0
    assert [tuple(r) for r in wide.casualty_rows(row).collect()] == [("e", None, 1, "Dead", 5)]


def test_dates_in_running_text(spark):
    texts = ["Rain on 3 May 2020, Feb 1, 2020 and 5/6/2020.", "Held (1 JANUARY 2019 - 5 JANUARY 2019) after 3 May 2018", "as of 4 May 2021, 6PM nothing", "no date", "", None]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    spans = {r.i: tuple(str(x) if x else None for x in r.s) for r in frame.select("i", dates.narrative_range(F.col("t")).alias("s")).collect()}
    assert spans == {0: ("2020-02-01", "2020-06-05"), 1: ("2019-01-01", "2019-01-05"), 2: ("2021-05-04", "2021-05-04"), 3: (None, None), 4: (None, None), 5: (None, None)}
    near = frame.select("i", dates.nearest_date(F.lit("On 21 May 2000 a fire. On 1 May 2000 rain and 3 May 2000 flood, 9 May 2000"), "flood").alias("d")).first().d
    assert str(near) == "2000-05-03" and frame.select(dates.nearest_date(F.col("t"), "flood").alias("d")).filter("d IS NOT NULL").count() == 0
    lines = spark.createDataFrame([("f", 1, "x"), ("f", 2, "on 2 May 2020"), ("f", 3, "y"), ("f", 4, "on 4 May 2020")], "file string, row int, t string")
    assert [str(r.context_date) for r in dates.dated_lines(lines, "t", ["file"], "row").orderBy("row").collect()] == ["None", "2020-05-02", "2020-05-02", "2020-05-04"]


def test_flat_places_and_weighted_ratio(spark):
    assert similarity.weighted_ratio("cebu", "cebu") == 1.0 and similarity.weighted_ratio("", "x") == 0.0 and similarity.weighted_ratio("cebu", "province of cebu in visayas") == pytest.approx(0.9)
    places = spark.createDataFrame([("City of Cebu", "1"), ("Cebu", "2"), (None, "3")], "name string, code string")
    texts = spark.createDataFrame([("Cebu City",), ("cebu",), ("NCR",), ("somewhere in luzon",), ("qqq",), (None,), (" ",)], "text string")
    found = {r.text: r.codes for r in match.match_flat(texts, places, {"ncr": "13"}, {"luzon": ["01", "02"]}).collect()}
    assert found == {"Cebu City": ["1"], "cebu": ["2"], "NCR": ["13"], "somewhere in luzon": ["01", "02"], "qqq": None, None: None, " ": None}


def test_places_and_shapes(spark):
    sheet = spark.createDataFrame([("1300000000", "Reg", "", "a"), ("137400000", "Prov", None, " "), ("5", "Total", "", "")], "Code string, Level string, `_c2` string, `_c3` string")
    rows = hierarchy.clean_places(sheet, {"Code": "code", "Level": "level"}).collect()
    assert [tuple(r) for r in rows] == [("1300000000", "Reg", None, "a"), ("0137400000", "Prov", None, None)]
    placed = spark.createDataFrame([("1300000000", "Reg", None), ("0137400000", "Prov", "1300000000"), ("12", "Mun", "0137400000"), ("x", "Moon", None)], "code string, level string, parent string")
    assert sorted((r.focus, r.check) for r in checks.check_places(placed).collect()) == [("12", "code"), ("1300000000", "parent"), ("x", "level")]
    assert [r[0] for r in placed.select(identity.island_of(F.col("code"))).collect()][0] == "NCR"


def test_years_of_folders_are_those_of_dates(spark):
    name = "DSWD DROMIC Report #3 on the Fire in {} as of 4 May 2021, 6PM.pdf"
    expected = {
        **{name.format(f"{n} Manila"): f"Fire in {n} Manila 2021" for n in (7, 2009, 2021, 12021)}, name.format("Manila 2021"): "Fire in Manila 2021",
        "DSWD DROMIC Report #1 on Typhoon Ana 2020.pdf": "Typhoon Ana 2020", "2019 Fire in 2020.pdf": "2019 Fire in 2020", "Fire as of today.pdf": "Fire",
    }
    found = spark.createDataFrame([(x,) for x in expected], "f string").select("f", sheets.folder_name(F.col("f")), sheets.folder_name(F.col("f"), F.lit("2021-05-04"))).collect()
    assert {r[0]: r[1] for r in found} == expected and {r[2] for r in found if " 2009 " in r[0]} == {"Fire in 2009 Manila 20210504"}


def test_representatives_and_specific_types(spark):
    grouped = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "event string, cluster long")
    events = spark.createDataFrame([("a", None), ("b", "2020"), ("c", None)], "event string, start string")
    assert {tuple(r) for r in resolve.representatives(grouped, events).collect()} == {(1, "b"), (2, "c")}
    typed = spark.createDataFrame([("e", "x"), ("e", "y"), ("f", "z")], "event string, type_id string")
    assert {tuple(r) for r in resolve.most_specific(typed, spark.createDataFrame([("y", 3), ("x", 1)], "type_id string, depth int")).collect()} == {("e", "y"), ("f", "z")}


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, *_):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())


def _workbook(rows, name="Data"):
    """A workbook of one sheet with shared, inline and plain cells."""
    texts = sorted({v for r in rows for v in r if isinstance(v, str) and not v.startswith("=")})
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cells = []
    for n, row in enumerate(rows, 1):
        own = ""
        for i, v in enumerate(row):
            at = f"{chr(65 + i)}{n}"
            if isinstance(v, str) and v.startswith("="):
                own += f'<c r="{at}" t="inlineStr"><is><t>{v[1:]}</t></is></c>'
            elif isinstance(v, str):
                own += f'<c r="{at}" t="s"><v>{texts.index(v)}</v></c>'
            elif v is not None:
                own += f'<c r="{at}"><v>{v}</v></c>'
        cells.append(f'<row r="{n}">{own}</row>')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="{name}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        book.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><r><t>{t[:1]}</t></r><r><t>{t[1:]}</t></r></si>" for t in texts) + "</sst>")
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{''.join(cells)}</sheetData></worksheet>")
    return out.getvalue()


def test_workbooks(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(_workbook([("Place", "Total", None), ("=x &amp; y", 5.5, 43831), (None, None, None), ("Place", None, 1)]))
    cells = workbooks.read_workbooks(spark, str(tmp_path / "*.xlsx"), 3, "Data")
    assert [tuple(r) for r in cells.orderBy("row").drop("file").collect()] == [(1, "Place", "Total", None), (2, "x & y", "5.5", "43831"), (4, "Place", None, "1")]
    assert str(cells.filter("row = 2").select(workbooks.sheet_date(F.col("c2")).alias("d")).first().d) == "2020-01-01"
    assert sheets.with_headers(cells.drop("file"), "row", lines=1).columns == ["row", "Place", "Total", "Total_2"]
    with pytest.raises(LookupError):
        list(workbooks.sheet_rows((tmp_path / "a.xlsx").read_bytes(), "Other"))
    assert [workbooks.column_number(c) for c in ("A1", "Z9", "AA3")] == [0, 25, 26]


def test_entry_points(spark, tmp_path, capsys):
    (tmp_path / "power.csv").write_text("Region,serviceProvider,interruptionDate,interruptionTime\nRegion V,\"Co \"\"A\"\"\",5 May 2020,08:30 AM\n,,6 May 2020,\n")
    (tmp_path / "o.ttl").write_text("@prefix : <http://e/> . :a :name \"x\"@en .")
    target = str(tmp_path / "out")
    headers = json.dumps({c.lower(): c for c in ("serviceProvider", "interruptionDate", "interruptionTime")})
    main(["tables", "--source", f"{tmp_path}/power.csv", "--target", target, "--table", "power", "--event", "http://e/1", "--headers", headers])
    main(["turtle", "--source", f"{tmp_path}/o.ttl", "--target", target, "--graph", "onto"])
    assert [r.serviceProvider for r in spark.read.parquet(f"{target}/power").orderBy("row").collect()] == ['Co "A"', None]
    capsys.readouterr()
    main(["ask", "--target", target, "--query", "SELECT ?g ?n WHERE { GRAPH ?g { ?x <http://e/name> ?n } }"])
    main(["ask", "--target", target, "--query", "SELECT nonsense"])
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert lines[0] == {"g": "onto", "n": "x"} and "error" in lines[1]
    events = [(f"https://e/{s}/{i}", s, "MajorEvent", f"T{i}", "Flood", None, "flood of the river", [], dt.date(2020, 1, i)) for i in (1, 2) for s in ("gda", "emdat")]
    spark.createDataFrame(events, "event string, source string, event_class string, type_base string, type_id string, type_parent string, label string, codes array<string>, start date").write.parquet(f"{tmp_path}/events")
    main(["align", "--source", f"{tmp_path}/events", "--target", target])
    registry = spark.read.parquet(f"{target}/registry").collect()
    assert len(registry) == 4 and len({r.canonical for r in registry}) == 2
    main(["align", "--source", f"{tmp_path}/events", "--target", f"{target}2", "--registry", f"{target}/registry"])
    assert {tuple(r) for r in spark.read.parquet(f"{target}2/registry").collect()} == {tuple(r) for r in registry}
    main(["clear", "--target", target, "--graph", "onto"])
    assert {r.g for r in spark.read.parquet(f"{target}/graphs").select("g").distinct().collect()} == {"http://e/1/power", "alignment"}
