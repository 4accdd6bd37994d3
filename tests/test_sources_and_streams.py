import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.model import literal_triples
from tidemark.plans import catalog, cleaning, questions  # noqa: F401  (the latter two register their queries)
from tidemark.sources import readers, sinks
from tidemark.streaming.incremental import calendar_counts, link_arrivals


def test_cells_keep_file_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,"two\nlines"\n,3\nz,\n')
    rows = readers.read_cells(spark, str(tmp_path / "*.csv"), strict=False).orderBy("row").collect()
    assert [(r.x, r.y, r.row) for r in rows] == [("1", "two\nlines", 1), (None, "3", 2), ("z", None, 3)]


def test_sidecars_discovery_and_registry(spark, tmp_path):
    for event, name in (("e1", "Ana"), ("e2", "Bo")):
        (tmp_path / event).mkdir()
        (tmp_path / event / "metadata.json").write_text(json.dumps({"eventName": name}, indent=1))
        (tmp_path / event / "Casualties_1.csv").write_text("a\n1\n")
    sidecars = readers.read_sidecars(spark, f"{tmp_path}/*/metadata.json", "eventName string")
    assert {(r.folder, r.eventName) for r in sidecars.collect()} == {("e1", "Ana"), ("e2", "Bo")}
    files = readers.discover(spark, str(tmp_path), {"meta": "metadata", "cas": "casualties"})
    assert sorted((r.folder, r.kind) for r in files.collect()) == [("e1", "cas"), ("e1", "meta"), ("e2", "cas"), ("e2", "meta")] and readers.latest(files).count() == 2
    (tmp_path / "orgs.json").write_text(json.dumps({"doh": ["DOH", "Health"], "none": []}))
    registry = readers.read_registry(spark, str(tmp_path / "orgs.json"))
    assert {(r.id, r.alias, r.pos) for r in registry.collect()} == {("doh", "DOH", 0), ("doh", "Health", 1)}
    assert {(r.p, r.o) for r in sinks.registry_triples(registry, "g").collect()} == {("skos:prefLabel", "DOH"), ("skos:altLabel", "Health")}


def test_new_entries_of_a_listing(spark):
    schema = "download_url string, posted_at string"
    listing = spark.createDataFrame([("a", "2020-01-01"), ("b", "2020-01-05"), ("c", "2020-01-04")], schema)
    assert [r.download_url for r in readers.new_entries(listing, spark.createDataFrame([("b", "2020-01-05"), ("x", "2020-01-02")], schema)).collect()] == []
    assert [r.download_url for r in readers.new_entries(listing, spark.createDataFrame([("x", "2020-01-05")], schema)).collect()] == ["b"]
    assert readers.new_entries(listing, spark.createDataFrame([], schema)).count() == 3


def test_ntriples_round_trip(spark, tmp_path):
    rows = [("g", "http://a", "http://p", "http://b", "iri", None, None), ("g", "_:x", "http://p", 'say "hi"\nback\\slash', "literal", None, "en"), ("g", "http://a", "http://q", "5", "literal", "http://int", None), ("g", "http://a", "http://q", "_:x", "blank", None, None)]
    triples = spark.createDataFrame(rows, "g string, s string, p string, o string, o_kind string, o_dt string, o_lang string")
    sinks.write_ntriples(triples, str(tmp_path / "out"))
    (tmp_path / "out" / "more.txt").write_text("# comment\nnot a triple\n")
    assert sorted(map(tuple, readers.read_ntriples(spark, str(tmp_path / "out"), "g").collect()), key=repr) == sorted(rows, key=repr)


def test_named_graphs_are_replaced_alone(spark, tmp_path):
    store = str(tmp_path / "store")
    make = lambda g, o: literal_triples(spark.createDataFrame([("s", o)], "s string, v string"), "s", {"v": "p"}, g)
    sinks.append_graph(make("one", "1").unionByName(make("two", "2")), store)
    sinks.replace_graphs(make("one", "9"), store)
    sinks.append_graph(make("two", "3"), store)
    assert sorted((r.g, r.o) for r in spark.read.parquet(store).collect()) == [("one", "9"), ("two", "2"), ("two", "3")]
    sinks.clear_graph(spark, store, "two")
    assert [(r.g, r.o) for r in spark.read.parquet(store).collect()] == [("one", "9")]
    assert not sinks.promote(make("x", "1"), f"{store}-staged", f"{store}-final", lambda df: df.isEmpty())
    assert sinks.promote(make("x", "1"), f"{store}-staged", f"{store}-final", lambda df: df.count() == 1) and spark.read.parquet(f"{store}-final").count() == 1


def test_slices_and_registry_files(spark, tmp_path):
    frame = spark.createDataFrame([("a", "5", None, "Quake here"), ("b", None, "x", "rain"), ("c", "bad", None, "QUAKE")], "id string, n string, m string, t string")
    spec = sinks.Slice("q", ["id", "n", "gone"], required=["n"], contains=("t", "quake"), only_if_missing="m", casts={"n": "int"})
    assert [tuple(r) for r in sinks.slice_rows(frame, spec).collect()] == [("a", 5)]
    sinks.export_slices(frame, [spec], str(tmp_path))
    assert spark.read.csv(str(tmp_path / "q"), header=True).count() == 1
    registry = spark.createDataFrame([("k", "m2"), ("k", "m1")], "canonical string, member string")
    sinks.save_registry(registry, str(tmp_path / "reg"))
    assert sorted(map(tuple, sinks.load_registry(spark, str(tmp_path / "reg")).collect())) == [("k", "m1"), ("k", "m2")]


def test_streaming_counts_equal_batch_counts(spark, sf_dir, tmp_path):
    batch = {(r.period, r.events) for r in calendar_counts(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts").collect()}
    source = tmp_path / "in"
    spark.read.parquet(f"{sf_dir}/events.parquet").write.parquet(str(source))
    stream = calendar_counts(spark.readStream.schema(spark.read.parquet(str(source)).schema).parquet(str(source)), "ts")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination(120)
    assert {(r.period, r.events) for r in spark.table("counts").collect()} == batch


def test_arrivals_are_linked_with_earlier_events(spark, tmp_path):
    schema = "event string, source string, type_base string, start date"
    folder = tmp_path / "in"
    day = dt.date(2020, 1, 1)
    spark.createDataFrame([("a", "X", "F", day)], schema).write.mode("append").parquet(str(folder))
    for new in ([("b", "Y", "F", day + dt.timedelta(2))], [("c", "Z", "F", day + dt.timedelta(4))]):
        link_arrivals(spark.readStream.schema(schema).parquet(str(folder)), str(tmp_path / "all"), str(tmp_path / "pairs"), str(tmp_path / "c")).awaitTermination(120)
        spark.createDataFrame(new, schema).write.mode("append").parquet(str(folder))
    link_arrivals(spark.readStream.schema(schema).parquet(str(folder)), str(tmp_path / "all"), str(tmp_path / "pairs"), str(tmp_path / "c")).awaitTermination(120)
    assert sorted((r.a, r.b) for r in spark.read.parquet(str(tmp_path / "pairs")).collect()) == [("a", "b"), ("a", "c"), ("b", "c")]


duckdb = pytest.importorskip("duckdb")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return connection


def _same(value):
    return round(float(value), 6) if isinstance(value, float) or type(value).__name__ == "Decimal" else value


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_queries_equal_their_oracles(spark, sf_dir, oracle, name):
    frame = catalog.QUERIES[name](spark, sf_dir)
    cursor = oracle.execute(catalog.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    expected = sorted((tuple(_same(v) for v in row) for row in cursor.fetchall()), key=repr)
    assert sorted((tuple(_same(r[c]) for c in columns) for r in frame.collect()), key=repr) == expected


def test_plans_push_filters_and_prune_columns(spark, sf_dir):
    plan = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_orderkey > 5").select("o_custkey")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderkey), GreaterThan(o_orderkey,5)]" in plan and "o_totalprice" not in plan
    counted = catalog.QUERIES["calendar_years"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in counted and "BroadcastNestedLoopJoin" not in counted
    assert F is not None
