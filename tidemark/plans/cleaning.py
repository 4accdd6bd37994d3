"""Registered queries that read, clean and take apart tables: messy cells are made of the driver's tables, and the oracle
says what must come out from the tables themselves."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import dates, identity, numbers, strings
from tidemark.model import literal_triples
from tidemark.operators import checks, classify, hierarchy, match, reshape, resolve
from tidemark.operators.events import filtered_events, page
from tidemark.plans import analysis
from tidemark.plans.catalog import _pair_events, query
from tidemark.plans.questions import question
from tidemark.plans.tables import ORGANISATION, driver_graph, driver_store, read
from tidemark.session import shared_folder
from tidemark.sources import field_reports, readers, reports, sheets, sinks, turtle, wide


def _folder(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A folder of a query's own files in the shared folder."""
    return f"{shared_folder(spark)}/files-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}/{name}"


# --- sources and sinks -----------------------------------------------------------------------------------------------


@query("SELECT CAST(n_nationkey AS VARCHAR) AS key, CASE WHEN n_nationkey % 4 <> 0 THEN n_name || ', \"' || n_regionkey || '\"' END AS name, CAST(row_number() OVER (ORDER BY n_nationkey) AS INTEGER) AS row FROM nation")
def csv_cells(spark, sf_dir):
    path = _folder(spark, sf_dir, "cells")
    named = F.when(F.col("n_nationkey") % 4 != 0, F.concat("n_name", F.lit(', "'), "n_regionkey", F.lit('"')))
    read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), named.alias("name"), F.lit("x").alias("unused")).orderBy("key").coalesce(1).write.mode("overwrite").option("escape", '"').csv(path, header=True)
    return readers.read_cells(spark, path, ["key", "name"]).select("key", "name", "row")


@query("SELECT r_name AS name, r_regionkey AS key, 'region=' || r_regionkey AS folder FROM region")
def json_sidecars(spark, sf_dir):
    path = _folder(spark, sf_dir, "sidecars")
    read(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("key"), F.col("r_regionkey").alias("region")).coalesce(1).write.mode("overwrite").partitionBy("region").json(path)
    return readers.read_sidecars(spark, path, "name string, key long").select("name", "key", "folder")


@query("SELECT 'region=' || r_regionkey AS folder, 'report' AS kind, 1 AS files, 1 AS newest FROM region")
def discovered_files(spark, sf_dir):
    path = _folder(spark, sf_dir, "discovered")
    read(spark, sf_dir, "region").select("r_name", F.col("r_regionkey").alias("region")).coalesce(1).write.mode("overwrite").partitionBy("region").json(path)
    files = readers.discover(spark, path, {"report": "part-", "other": "nothing-like-it"})
    newest = readers.latest(files).groupBy("kind").agg(F.count(F.lit(1)).cast("int").alias("newest"))
    return files.groupBy("folder", "kind").agg(F.count(F.lit(1)).cast("int").alias("files")).join(newest, "kind").select("folder", "kind", "files", "newest")


@query("SELECT r_name AS s, CASE WHEN n = 1 THEN 'skos:prefLabel' ELSE 'skos:altLabel' END AS p, n_name AS o FROM (SELECT r_name, n_name, row_number() OVER (PARTITION BY r_name ORDER BY n_name) AS n FROM nation JOIN region ON r_regionkey = n_regionkey)")
def organisation_registry(spark, sf_dir):
    path = _folder(spark, sf_dir, "registry")
    named = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    text = named.agg(F.map_from_entries(F.collect_list(F.struct("r_name", "names"))).alias("m")).select(F.to_json("m").alias("value"))
    text.coalesce(1).write.mode("overwrite").text(path)
    return sinks.registry_triples(readers.read_registry(spark, path), "registry").select("s", "p", "o")


_TRIPLES_SQL = "SELECT 'http://e/' || c_custkey AS s, p, o, 'xsd:string' AS o_dt FROM (SELECT c_custkey, unnest(['http://e/name', 'http://e/note']) AS p, unnest([c_name, 'says \"' || c_mktsegment || '\"' || chr(10) || 'and \\']) AS o FROM customer WHERE c_custkey % 5 = 0)"


def _customer_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = read(spark, sf_dir, "customer").filter("c_custkey % 5 = 0")
    noted = customers.select(F.concat(F.lit("http://e/"), "c_custkey").alias("s"), F.col("c_name").alias("name"), F.concat(F.lit('says "'), "c_mktsegment", F.lit('"\nand \\')).alias("note"))
    return literal_triples(noted, "s", {"name": "http://e/name", "note": "http://e/note"}, "customers")


@query(_TRIPLES_SQL)
def ntriples_round_trip(spark, sf_dir):
    path = _folder(spark, sf_dir, "ntriples")
    sinks.write_ntriples(_customer_triples(spark, sf_dir), path)
    return readers.read_ntriples(spark, path, "read").select("s", "p", "o", "o_dt")


@query("SELECT g, count(*) AS n FROM (SELECT 'nations' AS g FROM nation UNION ALL SELECT 'regions' FROM region UNION ALL SELECT 'regions' FROM region) GROUP BY g")
def named_graphs(spark, sf_dir):
    """Graphs appended, one replaced, one cleared: what is left of each."""
    store = _folder(spark, sf_dir, "graphs")
    sinks.clear_graph(spark, store)
    named = lambda table, key, value, graph: literal_triples(read(spark, sf_dir, table), key, {value: "name"}, graph)
    for triples in (named("nation", "n_nationkey", "n_name", "nations"), named("nation", "n_nationkey", "n_name", "nations"), named("region", "r_regionkey", "r_name", "regions"), named("region", "r_regionkey", "r_name", "gone")):
        sinks.append_graph(triples, store)
    sinks.replace_graphs(named("nation", "n_nationkey", "n_name", "nations"), store)
    sinks.append_graph(named("region", "r_regionkey", "r_name", "regions"), store)
    sinks.clear_graph(spark, store, "gone")
    return spark.read.parquet(store).groupBy("g").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 0")
def promoted_table(spark, sf_dir):
    """A table that passes its check takes the place of the one before; one that fails leaves it."""
    staging, target = _folder(spark, sf_dir, "staging"), _folder(spark, sf_dir, "promoted")
    suppliers = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    whole = lambda df: df.filter("s_acctbal <= 0").isEmpty()
    sinks.promote(suppliers.filter("s_acctbal > 5000"), staging, target, whole)
    sinks.promote(suppliers.filter("s_acctbal > 0"), staging, target, whole)
    sinks.promote(suppliers, staging, target, whole)
    return spark.read.parquet(target).select("s_suppkey", "s_name")


@query("SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS price FROM orders WHERE contains(lower(o_orderpriority), 'urgent') AND o_orderkey % 3 <> 0")
def export_slice(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.floor("o_totalprice").cast("string")).alias("price"), "o_orderpriority")
    return sinks.slice_rows(orders, sinks.Slice("urgent", ["o_orderkey", "price", "nothing"], required=["price"], contains=("o_orderpriority", "URGENT"), casts={"price": "bigint"}))


@query("SELECT 'c' || c_nationkey AS canonical, c_name AS member FROM customer")
def registry_round_trip(spark, sf_dir):
    path = _folder(spark, sf_dir, "clusters")
    sinks.save_registry(read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_nationkey").alias("canonical"), F.col("c_name").alias("member")), path)
    return sinks.load_registry(spark, path)


@query("SELECT 'f' || p_partkey AS path FROM part WHERE p_size > 20")
def files_to_read_again(spark, sf_dir):
    files = read(spark, sf_dir, "part").select(F.concat(F.lit("f"), "p_partkey").alias("path"), "p_size")
    return sinks.needs_rerun(files.select("path"), files.filter("p_size <= 20").select("path"))


@query("SELECT o_orderkey AS download_url FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderdate >= (SELECT max(o_orderdate) FROM orders WHERE o_orderkey % 3 = 0 AND o_orderdate < TIMESTAMP '2000-01-01')")
def new_listing_entries(spark, sf_dir):
    listing = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("download_url"), F.col("o_orderdate").alias("posted_at"))
    manifest = listing.filter("download_url % 3 = 0 AND posted_at < TIMESTAMP '2000-01-01'")
    return readers.new_entries(listing.filter("download_url % 3 <> 0"), manifest).select("download_url")


@query("SELECT 'http://e/r' || n_regionkey AS s, 'http://e/has' AS p, 'http://e/n' || n_nationkey AS o, 'iri' AS o_kind, NULL AS o_lang FROM nation UNION ALL SELECT 'http://e/n' || n_nationkey, 'http://e/label', n_name, 'literal', 'en' FROM nation")
def turtle_documents(spark, sf_dir):
    nations = read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(
        F.concat_ws(", ", F.transform(F.collect_list("n_nationkey"), lambda k: F.concat(F.lit(":n"), k))).alias("keys"),
        F.concat_ws("\n", F.collect_list(F.concat(F.lit(":n"), "n_nationkey", F.lit(' :label "'), "n_name", F.lit('"@en .')))).alias("labels"),
    )
    text = F.concat(F.lit("@prefix : <http://e/> . # a comment\n:r"), "n_regionkey", F.lit(" :has "), "keys", F.lit(" ;\n .\n"), "labels")
    return turtle.turtle_triples(nations.select(F.col("n_regionkey").cast("string").alias("path"), text.alias("text")), "nations").select("s", "p", "o", "o_kind", "o_lang")


# --- sheets and their headers ----------------------------------------------------------------------------------------


def _lined(spark: SparkSession, sf_dir: str, headers: list[tuple]) -> DataFrame:
    """The regions as a sheet of texts below some lines of headers."""
    top = " UNION ALL ".join("SELECT " + ", ".join(f"{v!r} AS c{i}" if v is not None else f"CAST(NULL AS STRING) AS c{i}" for i, v in enumerate(line)) + f", {n} AS row" for n, line in enumerate(headers))
    rows = read(spark, sf_dir, "region").select(F.concat(F.lit("x"), "r_regionkey").alias("c0"), F.col("r_name").alias("c1"), F.col("r_regionkey").cast("string").alias("c2"), (F.col("r_regionkey") + len(headers)).cast("int").alias("row"))
    return spark.sql(top).unionByName(rows)


@query("SELECT 'x' || r_regionkey AS \"Place_Code\", r_name AS \"Place_Name_long\", CAST(r_regionkey AS VARCHAR) AS \"Number\" FROM region")
def tiered_headers(spark, sf_dir):
    sheet = _lined(spark, sf_dir, [("Place", "Place", "Number"), ("Code", "Name", "Unnamed: 2"), ("Unnamed: 0", "long", "never")])
    return sheets.with_headers(sheet, "row", sheets.tier_names, 3).drop("row")


@query("SELECT 'x' || r_regionkey AS \"Region_Code\", r_name AS \"Region_Type_of_place\", CAST(r_regionkey AS VARCHAR) AS \"Total_Cum\" FROM region")
def spanned_headers(spark, sf_dir):
    return sheets.with_headers(_lined(spark, sf_dir, [("Region", "", "Total"), ("Code", "Type of/place", "Cum.")]), "row").drop("row")


@query("SELECT s_suppkey AS total_families, s_name AS \"Name of Province\" FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer")
def joined_fragments(spark, sf_dir):
    first = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("total_families"), F.col("s_name").alias("Name of Province"))
    return sheets.joined_fragments(first, read(spark, sf_dir, "customer").select(F.col("c_name").alias("PROVINCE (name of)"), F.col("c_custkey").alias("Families, total")))


@query("SELECT 'number_of_damaged_houses' AS t0, 'inside_ec_displaced_families_persons' AS t1, 'total_ec_displaced_families_persons' AS t2, 'number_of_affected_population' AS t3, 'foo bar' AS t4")
def table_names(spark, sf_dir):
    headers = [["Damaged Houses", "Totally"], ["Affected", "in evacuation"], ["Evacuee families"], ["Affected brgys"], ["foo", "bar"]]
    return spark.range(1).select(*[F.lit(sheets.table_name(h)).alias(f"t{i}") for i, h in enumerate(headers)])


@query("SELECT o_orderkey, 'Fire in ' || o_custkey || ' Manila 2021' AS folder, CASE o_orderkey % 4 WHEN 0 THEN 'region' WHEN 1 THEN 'municipality' WHEN 2 THEN 'province' END AS level, o_orderkey % 5 = 0 AS total FROM orders")
def report_lines(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    file = F.concat(F.lit("DSWD DROMIC Report #3 on the Fire in "), "o_custkey", F.lit(" Manila as of 4 May 2021, 6PM.pdf"))
    kind = F.col("o_orderkey") % 4
    cell = F.when(kind == 0, "ILOCOS").when(kind == 1, "Some City").when(kind == 2, "Abra").otherwise("note")
    first = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit(" Grand  Total "), "o_orderkey")).otherwise("Totals of none")
    return orders.select("o_orderkey", sheets.folder_name(file).alias("folder"), sheets.level_of_cell(cell, kind.isin(0, 2), F.lit(False), F.lit(10)).alias("level"), sheets.summary_row(first).alias("total"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 3 = 0 THEN 'Region ' || l_suppkey ELSE NULL END AS region, CASE WHEN l_partkey % 3 = 0 THEN 'old' ELSE 'Town ' || l_suppkey END AS municipality, CASE WHEN l_partkey % 2 = 0 THEN 'Poblacion' END AS \"hasBarangay\", l_quantity AS qty FROM lineitem")
def misplaced_cells(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    named = lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.concat(F.when(F.col("l_partkey") % 3 == 0, "Region ").otherwise("Town "), "l_suppkey").alias("region"), F.lit("old").alias("municipality"),
        F.when(F.col("l_partkey") % 2 == 0, "Poblacion").otherwise(F.concat(F.lit(" "), "l_partkey")).alias("barangay"), F.col("l_quantity").alias("region_total"),
    )
    return reshape.null_counts(reshape.move_invalid_regions(reshape.quantity_headers(named)), "hasBarangay")


@query("SELECT CAST(p_size AS VARCHAR) AS dswd, CAST(p_partkey AS VARCHAR) AS lgu, CASE WHEN p_partkey % 2 = 0 THEN '7' END AS ngo, p_name AS total_families FROM part")
def headers_by_tokens(spark, sf_dir):
    sheet = read(spark, sf_dir, "part").select(F.concat_ws(" ", "p_size", "p_partkey", F.when(F.col("p_partkey") % 2 == 0, "7")).alias("Cost  DSWD LGU NGO"), F.col("p_name").alias("Total  Families Cum"))
    named = reshape.rename_by_tokens(reshape.snake_columns(sheet), {"total_families": [["families", "cum"]]})
    return reshape.split_cells(named, "cost_dswd_lgu_ngo", ["dswd", "lgu", "ngo"]).drop("cost_dswd_lgu_ngo")


@query("SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS a, CAST(o_orderkey AS VARCHAR) AS b FROM orders")
def merged_values(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws(" ", "o_custkey", "o_orderkey").alias("a"), F.lit(None).cast("string").alias("b"))
    return reports.split_merged_values(orders, ["a", "b"])


@query("SELECT c_name AS name, p AS part, CAST(n AS VARCHAR) AS n FROM (SELECT c_name, unnest(['a', 'b', 'c']) AS p, unnest([c_custkey, c_nationkey, NULL]) AS n FROM customer)")
def merged_rows(spark, sf_dir):
    customers = read(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.lit("a  b   c").alias("part"), F.concat_ws("  ", "c_custkey", "c_nationkey").alias("n"))
    return reshape.split_rows(customers, ["part", "n"])


@query("SELECT o_orderkey, o_orderstatus AS qty FROM orders WHERE o_orderkey % 4 <> 0 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 4 = 0 AND o_orderkey % 3 = 0")
def collapsed_rows(spark, sf_dir):
    """Rows with a key but no value are summaries; rows with neither stay, and those without anything go."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus")).alias("qty"), F.when(F.col("o_orderkey") % 3 != 0, "place").alias("key"), F.lit(None).cast("string").alias("void"))
    empty = orders.select(*[F.lit(None).cast(t).alias(c) for c, t in orders.dtypes])
    return reshape.drop_empty_rows(reshape.collapse(orders.unionByName(empty), "qty", "key")).select("o_orderkey", "qty")


@query("SELECT o_orderkey, 'Name ' || o_orderkey AS name, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_custkey AS INTEGER) END AS qty, CAST(o_orderdate AS DATE) AS day FROM orders")
def entity_cells(spark, sf_dir):
    cells = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("o_orderkey"), F.concat(F.lit("Name "), "o_orderkey").alias("name"), F.when(F.col("o_orderkey") % 3 == 0, " NONE ").otherwise(F.col("o_custkey").cast("string")).alias("qty"), F.col("o_orderdate").cast("date").cast("string").alias("day"))
    return reshape.entities(cells, {"o_orderkey": "bigint", "name": "string", "qty": "int", "day": "date"})


@query("""SELECT o_custkey AS region, o_orderkey, floor(o_totalprice) AS n, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 5 HOUR + INTERVAL 30 MINUTE AS "interruptionDateTime" FROM orders WHERE o_orderkey % 10 = 1""")
def report_table(spark, sf_dir):
    """A table of a report by its specification: places filled, numbers and times out of cells."""
    orders = read(spark, sf_dir, "orders").filter("o_orderkey % 10 = 1")
    cells = orders.select(
        F.col("o_custkey").cast("string").alias("file"), F.col("o_orderkey").alias("row"), F.col("o_custkey").cast("string").alias("Region"), F.format_number(F.floor("o_totalprice"), 0).alias("Places Cut Off"),
        F.date_format("o_orderdate", "dd MMMM yyyy").alias("cut date"), F.lit("05:30 AM").alias("cut time"), F.lit(" None ").alias("remarks"),
    )
    spec = reports.TableSpec("power", "hasPower", "Power", texts=["remarks"], ints=["n"], times={"interruptionDateTime": ("interruptionDate", "interruptionTime")})
    built = reports.build(cells, spec, {"places_cut_off": "n", "cut_date": "interruptionDate", "cut_time": "interruptionTime"})
    return built.select(F.col("region").cast("bigint").alias("region"), F.col("row").alias("o_orderkey"), F.col("n").cast("double").alias("n"), F.col("interruptionDateTime").cast("timestamp_ntz").alias("interruptionDateTime"))


@query("SELECT p_partkey, coalesce(p_size, 0) + CASE WHEN p_partkey % 2 = 0 THEN p_partkey ELSE 0 END AS total, 'k' || p_partkey AS place, p_size AS inside FROM part")
def displaced_totals(spark, sf_dir):
    parts = read(spark, sf_dir, "part")
    key = F.concat(F.lit("k"), "p_partkey").alias("place")
    inside, outside = parts.select("p_partkey", key, F.col("p_size").cast("bigint").alias("inside")), parts.filter("p_partkey % 2 = 0").select(key, F.col("p_partkey").alias("outside"), F.lit(1).alias("inside"))
    return reports.displaced_totals(reshape.full_merge([inside, outside], "place"), "inside", "outside", "total").select("p_partkey", "total", "place", F.col("inside").cast("int").alias("inside"))


# --- wide records ----------------------------------------------------------------------------------------------------


def _archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rows of the archive's sheet."""
    orders = read(spark, sf_dir, "orders").filter("o_orderkey % 7 = 1")
    key = F.col("o_orderkey")
    text = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    cells = orders.select(
        (key + 1).alias("row"), F.when(key % 2 == 0, "I").otherwise("M").alias("M or I"), F.concat(F.lit('"Order'), key, F.lit('"')).alias("Disaster Name"), F.date_format("o_orderdate", "d MMMM yyyy").alias("Date/Period"),
        F.when(key % 3 == 0, "Cebu|Bohol").when(key % 11 == 0, "-").otherwise("Cebu").alias("Place"), F.when(key % 5 == 0, "Not applicable").otherwise(text("o_custkey")).alias("Dead"), F.when(key % 4 == 0, text("o_custkey")).alias("Missing"),
        F.when(key % 2 == 0, text(F.col("o_totalprice"))).alias("Infra"), F.lit("12").alias("Total cost"), F.when(key % 3 == 1, "State of Calamity").otherwise("Red alert").alias("State"), F.when(key % 2 == 1, text("o_custkey")).alias("Water cost"), F.lit("99").alias("All cost"),
        F.lit("[Flood: Leyte]; [Fire: Samar]").alias("Subtypes"),
    )
    headers = {"M or I": "eventClass", "Disaster Name": "eventName", "Date/Period": "date", "Place": "hasLocation", "Dead": "dead", "Missing": "missing", "Infra": "infraDamageAmount", "Total cost": "generalDamageAmount", "State": "declarationOfCalamity", "Water cost": "itemCostWater", "All cost": "itemCostOthers2", "Subtypes": "hasSubtype"}
    rows = wide.archive_rows(cells, headers)
    return rows.withColumns({"event": identity.event_iri(F.lit("gda"), F.col("id")), "key": F.col("row") - 1})


_ARCHIVE_SQL = """WITH a AS (SELECT *, o_orderkey AS key, CASE WHEN o_orderkey % 3 <> 0 THEN 'Cebu' END AS place, CASE WHEN o_orderkey % 3 = 0 THEN 'Cebu|Bohol' ELSE 'Cebu' END AS whole FROM orders WHERE o_orderkey % 7 = 1 AND (o_orderkey % 11 <> 0 OR o_orderkey % 3 = 0)) """


@query(_ARCHIVE_SQL + """SELECT key, 'Order' || key AS "eventName", strftime(o_orderdate, '%Y-%m-%d') AS "startDate", CAST(key + 8 AS INTEGER) AS "rowNumber", CASE WHEN key % 2 = 0 THEN 'Incident' ELSE 'MajorEvent' END AS class,
    CASE WHEN key % 2 = 1 THEN '12' END AS general, CASE WHEN key % 3 = 1 THEN 'State of Calamity' END AS calamity, CASE WHEN key % 3 <> 1 THEN 'Red alert' END AS warning,
    md5(key || '') IS NOT NULL AND true AS named FROM a""")
def archive_rows(spark, sf_dir):
    rows = _archive(spark, sf_dir)
    return rows.select("key", "eventName", "startDate", "rowNumber", wide.event_class(mark=F.col("eventClass")).alias("class"), F.col("generalDamageAmount").alias("general"), F.col("declarationOfCalamity").alias("calamity"), F.col("warningReleased").alias("warning"), (F.length("id") == 32).alias("named"))


@query(_ARCHIVE_SQL + """SELECT key, 'infrastructure' AS entity, place, CASE WHEN o_totalprice > 1000 THEN round(o_totalprice / 1000000, 6) ELSE o_totalprice END AS amount FROM a WHERE key % 2 = 0
    UNION ALL SELECT key, 'damage', place, 12 FROM a WHERE key % 2 = 1 UNION ALL SELECT key, 'calamity', place, NULL FROM a WHERE key % 3 = 1 UNION ALL SELECT key, 'warning', place, NULL FROM a WHERE key % 3 <> 1""")
def archive_entities(spark, sf_dir):
    rows = _archive(spark, sf_dir)
    out = None
    for entity in wide.ARCHIVE:
        found = wide.entity_rows(rows.withColumn("event", F.col("key").cast("string")), entity)
        amount = F.round(F.col(entity.amounts[0]), 6) if entity.amounts else F.lit(None).cast("double")
        part = found.select(F.col("event").cast("bigint").alias("key"), F.lit(entity.segment).alias("entity"), F.col("hasLocation").alias("place"), amount.alias("amount"))
        out = part if out is None else out.unionByName(part)
    return out


@query(_ARCHIVE_SQL + """SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY k) AS INTEGER) AS ordinal, k AS kind, o_custkey AS cnt FROM (SELECT key, o_custkey, unnest(['Dead', 'Missing']) AS k, unnest([key % 5 <> 0, key % 4 = 0]) AS yes FROM a) WHERE yes""")
def archive_casualties(spark, sf_dir):
    return wide.casualty_rows(_archive(spark, sf_dir), "key").select(F.col("event").alias("key"), "ordinal", "kind", "cnt")


@query(_ARCHIVE_SQL + """SELECT key, 'water' AS "itemType", CAST(o_custkey AS DOUBLE) AS cost FROM a WHERE key % 2 = 1 UNION ALL SELECT key, 'general', 99 FROM a WHERE key % 2 = 0""")
def archive_relief(spark, sf_dir):
    return wide.relief_rows(_archive(spark, sf_dir), "key").select(F.col("event").alias("key"), "itemType", F.col("itemCost").alias("cost"))


@query(_ARCHIVE_SQL + """SELECT key, CAST(n AS INTEGER) AS sub_id, t AS type, p AS place FROM (SELECT key, unnest([1, 2]) AS n, unnest(['Flood', 'Fire']) AS t, unnest(['Leyte', 'Samar']) AS p FROM a)""")
def archive_incidents(spark, sf_dir):
    return wide.sub_incidents(_archive(spark, sf_dir), key="key").withColumnRenamed("event", "key")


@query(_ARCHIVE_SQL + """SELECT p, count(*) AS n FROM (SELECT unnest([':hasInfrastructureDamage', 'rdf:type', ':infraDamageAmount', 'qudt:numericValue', 'qudt:unit']) AS p FROM a WHERE key % 2 = 0 UNION ALL SELECT ':hasLocation' FROM a WHERE key % 2 = 0 AND place IS NOT NULL) GROUP BY p""")
def archive_triples(spark, sf_dir):
    entity = next(e for e in wide.ARCHIVE if e.cls == "InfrastructureDamage")
    return wide.entity_triples(wide.entity_rows(_archive(spark, sf_dir), entity), entity, "gda").groupBy("p").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'FloodGeneral' END AS type, CASE WHEN o_orderkey % 3 = 0 THEN 'StormSurge|FloodGeneral' ELSE '' END AS also, CASE WHEN o_orderkey % 5 = 0 THEN 'Philippines' ELSE 'Manila|Cebu' END AS place,
    make_date(year(o_orderdate), month(o_orderdate), 1) AS start, CAST(last_day(CAST(o_orderdate AS DATE)) AS DATE) AS "end", CASE WHEN o_orderkey % 5 <> 0 OR o_orderkey % 2 = 0 THEN 'MajorEvent' ELSE 'MajorEvent' END AS class FROM orders""")
def catalogue_rows(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    cells = orders.select(
        key.alias("row"), key.cast("string").alias("DisNo."), F.when(key % 2 == 0, " FLOOD (General) ").alias("Disaster Subtype"), F.when(key % 3 == 0, "storm surge| Flood (General)|nothing").alias("Associated Types"), F.when(key % 5 != 0, "Manilla, Cebu province").otherwise("").alias("Location"),
        F.year("o_orderdate").cast("string").alias("Start Year"), F.month("o_orderdate").cast("string").alias("Start Month"), F.lit("").alias("Start Day"), F.year("o_orderdate").cast("string").alias("End Year"), F.month("o_orderdate").cast("string").alias("End Month"), F.lit(None).cast("string").alias("End Day"),
    )
    rows = wide.catalogue_rows(cells, {"flood (general)": "FloodGeneral", "Storm Surge": "StormSurge"})
    return rows.select(F.col("row").alias("o_orderkey"), F.col("hasDisasterType").alias("type"), F.coalesce("hasDisasterSubtype", F.lit("")).alias("also"), F.col("hasLocation").alias("place"), F.col("startDate").alias("start"), F.col("endDate").alias("end"), wide.event_class(place=F.col("hasLocation"), type_id=F.col("hasDisasterType")).alias("class"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Incident' ELSE 'MajorEvent' END AS by_name, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 5 <> 0 THEN 'Incident' ELSE 'MajorEvent' END AS by_place,
    CASE o_orderkey % 4 WHEN 0 THEN 'NCR' WHEN 1 THEN 'Luzon' WHEN 2 THEN 'Visayas' ELSE 'Mindanao' END AS island FROM orders""")
def event_classes(spark, sf_dir):
    key = F.col("o_orderkey")
    name = F.concat(F.when(key % 3 == 0, "Fire INCIDENT in ").otherwise("Typhoon at "), "o_custkey")
    place, kind = F.when(key % 2 == 0, "Cebu").otherwise(F.when(key % 3 == 0, "Northern Luzon").otherwise("Cebu|Bohol")), F.when(key % 5 == 0, "TropicalCyclone").otherwise("FireMiscellaneous")
    region = F.when(key % 4 == 0, "1300000000").when(key % 4 == 1, "0400000000").when(key % 4 == 2, "1800000000").otherwise("1600000000")
    return read(spark, sf_dir, "orders").select("o_orderkey", wide.event_class(name=name).alias("by_name"), wide.event_class(place=place, type_id=kind).alias("by_place"), identity.island_of(region).alias("island"))


# --- places and names ------------------------------------------------------------------------------------------------


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions and nations as places with ten-digit codes."""
    regions = read(spark, sf_dir, "region").select(F.concat(F.lpad((F.col("r_regionkey") + 1).cast("string"), 2, "0"), F.lit("00000000")).alias("code"), F.lit("Reg").alias("level"), F.lower("r_name").alias("label"))
    nations = read(spark, sf_dir, "nation").select(F.concat(F.lpad((F.col("n_regionkey") + 1).cast("string"), 2, "0"), F.lpad((F.col("n_nationkey") + 1).cast("string"), 3, "0"), F.lit("00000")).alias("code"), F.lit("Prov").alias("level"), F.lower("n_name").alias("label"))
    customers = read(spark, sf_dir, "customer").filter("c_custkey % 100 < 40").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    towns = customers.select(F.concat(F.lpad((F.col("n_regionkey") + 1).cast("string"), 2, "0"), F.lpad((F.col("n_nationkey") + 1).cast("string"), 3, "0"), F.lpad((F.col("c_custkey") % 99 + 1).cast("string"), 2, "0"), F.lit("000")).alias("code"), F.lit("Mun").alias("level"), F.lower("c_name").alias("label"))
    return regions.unionByName(nations).unionByName(towns.dropDuplicates(["code"]).withColumn("label", F.concat(F.lit("town "), F.substring("code", 3, 5))))


_PLACES_SQL = """WITH place AS (SELECT lpad(CAST(r_regionkey + 1 AS VARCHAR), 2, '0') || '00000000' AS code, 'Reg' AS level FROM region
    UNION ALL SELECT lpad(CAST(n_regionkey + 1 AS VARCHAR), 2, '0') || lpad(CAST(n_nationkey + 1 AS VARCHAR), 3, '0') || '00000', 'Prov' FROM nation
    UNION ALL SELECT DISTINCT lpad(CAST(n_regionkey + 1 AS VARCHAR), 2, '0') || lpad(CAST(n_nationkey + 1 AS VARCHAR), 3, '0') || lpad(CAST(c_custkey % 99 + 1 AS VARCHAR), 2, '0') || '000', 'Mun' FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 100 < 40) """


@query(_PLACES_SQL + "SELECT code, level, CASE level WHEN 'Prov' THEN code[1:2] || '00000000' WHEN 'Mun' THEN code[1:5] || '00000' END AS parent FROM place")
def place_parents(spark, sf_dir):
    return hierarchy.resolve_parents(_places(spark, sf_dir).select("code", "level"))


@query(_PLACES_SQL + "SELECT code, level, 'x' AS note FROM place WHERE level <> 'Mun'")
def clean_places(spark, sf_dir):
    sheet = _places(spark, sf_dir).select(F.col("code").cast("bigint").cast("string").alias("10-digit code"), F.when(F.col("level") == "Mun", "Total").otherwise(F.col("level")).alias("Geographic Level"), F.lit(" x ").alias(" "), F.lit(" ").alias("old"))
    return hierarchy.clean_places(sheet, {"10-digit code": "code", "Geographic Level": "level"}).filter("old IS NULL").select("code", "level", "note")


@query(_PLACES_SQL + """, p AS (SELECT code, level, CASE level WHEN 'Prov' THEN code[1:2] || '00000000' WHEN 'Mun' THEN CASE WHEN code[7] = '1' THEN code ELSE code[1:5] || '00000' END END AS parent FROM place)
    SELECT code AS focus, 'code' AS "check", level AS value FROM p WHERE level = 'Prov' AND code[4:5] = '00' UNION ALL SELECT code, 'parent', parent FROM p WHERE level = 'Reg' UNION ALL SELECT code, 'parent', parent FROM p WHERE level = 'Mun' AND code[7] = '1'""")
def place_shapes(spark, sf_dir):
    placed = hierarchy.resolve_parents(_places(spark, sf_dir).select("code", "level"))
    broken = placed.withColumn("parent", F.when((F.col("level") == "Mun") & (F.substring("code", 7, 1) == "1"), F.col("code")).otherwise(F.col("parent")))
    return checks.check_places(broken)


@query("SELECT x.code, max(c.descendant = x.code AND contains(lower(x.label), 'nation_1')) AS matched FROM location x JOIN location_closure c ON c.ancestor = x.code JOIN location y ON y.code = c.descendant AND contains(lower(y.label), 'nation_1') GROUP BY x.code", store=True)
def tree_search(spark, sf_dir):
    return hierarchy.search_tree(driver_store(spark, sf_dir).location, "code", "label", "parent", "NATION_1").select("code", "matched")


@query("SELECT n_nationkey, n_name AS matched FROM nation")
def misspelt_names(spark, sf_dir):
    """Names with a letter lost or changed at the front, words turned round: each finds its own."""
    key = F.col("n_nationkey")
    names = read(spark, sf_dir, "nation").select(key, F.concat_ws(" ", F.concat(F.lit("b"), F.substring(F.sha1(key.cast("string")), 1, 9)), F.lit("republic"), F.concat(F.lit("z"), F.substring(F.md5(key.cast("string")), 1, 7))).alias("name"), "n_name")
    words = F.split("name", " ")
    said = F.when(key % 3 == 0, F.concat(F.lit("c"), F.substring("name", 2, 99))).when(key % 3 == 1, F.substring("name", 2, 99)).otherwise(F.concat_ws(" ", words[2], words[0], words[1]))
    found = match.match_names(names.select(said.alias("query")), names.select("name", F.col("n_name").alias("id"), F.col("n_nationkey").alias("pos")))
    return names.withColumn("query", said).join(found.select("query", "id"), "query").select("n_nationkey", F.col("id").alias("matched"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'R' || c_custkey % 3 WHEN 1 THEN 'C' || c_nationkey WHEN 2 THEN 'broad' END AS code FROM customer")
def flat_places(spark, sf_dir):
    nations = read(spark, sf_dir, "nation")
    place = lambda k: F.concat(F.lit("quezon "), F.translate(F.lpad(k.cast("string"), 2, "0"), "0123456789", "abcdefghij"), F.translate(F.lpad((k * 7 % 100).cast("string"), 2, "0"), "0123456789", "klmnopqrst"))
    known = nations.select(F.concat(F.lit("City of "), place(F.col("n_nationkey"))).alias("name"), F.concat(F.lit("C"), "n_nationkey").alias("code"))
    kind = F.col("c_custkey") % 4
    text = F.when(kind == 0, F.concat(F.lit(" Region "), F.col("c_custkey") % 3)).when(kind == 1, F.concat(place(F.col("c_nationkey")), F.lit(" City"))).when(kind == 2, F.concat(F.lit("all over the country "), "c_custkey")).otherwise(F.lit("zzzzzz"))
    customers = read(spark, sf_dir, "customer").select("c_custkey", text.alias("text"))
    found = match.match_flat(customers.select("text").distinct(), known, {f"region {i}": f"R{i}" for i in range(3)}, {"country": ["broad"]})
    return customers.join(found, "text").select("c_custkey", F.col("codes")[0].alias("code"))


# --- scalars ---------------------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 1000 THEN round(o_totalprice / 1000000, 9) ELSE o_totalprice END AS millions, CAST(o_custkey * 1000 + 7 AS VARCHAR) AS repaired, CAST(-o_custkey AS DOUBLE) AS first, CAST(o_custkey AS DOUBLE) AS close FROM orders""")
def more_numbers(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    doubled = F.concat("o_custkey", F.lit(", 0, 007"))
    return orders.select(
        "o_orderkey", F.round(numbers.large_to_millions(F.col("o_totalprice")), 9).alias("millions"), F.regexp_replace(numbers.repair_digits(doubled), r"^0+(?=\d)", "").alias("repaired"),
        numbers.first_number(F.concat(F.lit("about -"), "o_custkey", F.lit(" of 12"))).alias("first"), F.when(numbers.close_to(F.col("o_custkey") * F.lit(1.0000000001), F.col("o_custkey").cast("double")), F.col("o_custkey").cast("double")).alias("close"),
    )


@query("""SELECT c_custkey, 'Tropical storm ' || c_name AS expanded, 'mount ' || lower(c_name) AS place, c_mktsegment || '/' || c_custkey AS joined, ['Typhoon', 'Segment'] AS nouns, [c_mktsegment, 'LGU', 'NGO'] AS orgs,
    'Village ' || c_custkey AS barangay, 'Town' AS rest, CASE WHEN c_custkey % 2 = 0 THEN 'NDRRMC' END AS source, ['FlashFlood', 'FireMiscellaneous'] AS slugs FROM customer""")
def more_strings(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    village = strings.barangay(F.concat(F.lit("Brgy. Village "), "c_custkey", F.lit(", Town")))
    iri = F.concat(F.lit("https://e/"), F.when(F.col("c_custkey") % 2 == 0, "ndrrmc").otherwise("nobody"), F.lit("/1"))
    return c.select(
        "c_custkey", strings.expand_first(F.concat(F.lit("TS "), "c_name"), {"TC": "Tropical cyclone", "TS": "Tropical storm"}).alias("expanded"), match.place_label(F.concat(F.lit(" Mt. "), "c_name")).alias("place"),
        F.concat_ws("/", "c_mktsegment", F.lit(None), "c_custkey").alias("joined"), strings.proper_nouns(F.lit("Typhoon Ana in a Segment of Typhoon")).alias("nouns"), strings.split_list(F.concat("c_mktsegment", F.lit(", LGU and NGO; LGU"))).alias("orgs"),
        village["barangay"].alias("barangay"), village["rest"].alias("rest"), identity.source_of(iri, {"ndrrmc": "NDRRMC"}).alias("source"), strings.type_slugs(F.lit("Flashflood|Fire (Misc)"), [("Misc", "Miscellaneous"), ("Flashflood", "FlashFlood")]).alias("slugs"),
    )


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(36 AS DOUBLE) AS hours, CAST(o_orderdate AS DATE) AS first, CAST(o_orderdate AS DATE) + 9 AS last, CAST(o_orderdate AS DATE) + 9 AS near,
    strftime(o_orderdate, '%Y-%m-%d') AS start, strftime(CAST(o_orderdate AS DATE) + 9, '%Y-%m-%d') AS "end" FROM orders""")
def more_dates(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    later = F.date_add(day, 9)
    told = F.concat(F.lit("It began on "), F.date_format(later, "MMMM d, yyyy"), F.lit(", they say, though others name "), F.date_format(day, "d MMM yyyy"), F.lit("; as of 1 January 2030 all is over. End."))
    said = F.concat(F.date_format(day, "d MMMM yyyy"), F.lit(" was calm. Rain fell on "), F.date_format(later, "d MMMM yyyy"), F.lit(" and the flood came, not on 1 May 1999."))
    known = dates.narrative_range(told)
    span = dates.date_range(F.concat(F.date_format(day, "MMM d yyyy"), F.lit(" – "), F.date_format(later, "d MMMM yyyy"), F.lit(" PST")))
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", F.substring_index(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), "T", 1).alias("day"), dates.hours_between(F.col("o_orderdate"), F.col("o_orderdate") + F.expr("INTERVAL 36 HOURS")).cast("double").alias("hours"),
        known["start"].alias("first"), known["end"].alias("last"), dates.nearest_date(said, "flood").alias("near"), span["start"].alias("start"), span["end"].alias("end"),
    )


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'FlashFlood|FloodGeneral' WHEN 1 THEN 'LandslideWet|LandslideDry|TropicalCyclone' WHEN 2 THEN 'LandslideDry' WHEN 3 THEN 'FireIndustrial|FireMiscellaneous' ELSE '' END AS labels,
    CASE o_orderkey % 5 WHEN 0 THEN 'FlashFlood' WHEN 2 THEN 'LandslideDry' END AS label,
    CASE o_orderkey % 5 WHEN 1 THEN 'LandslideDry|LandslideWet' WHEN 3 THEN 'FireIndustrial|FireMiscellaneous|ForestFire|LandFire|WildfireGeneral' END AS candidates FROM orders""")
def classified_texts(spark, sf_dir):
    """All rules of the classifier over short texts, and what they settle."""
    kind = F.col("o_orderkey") % 5
    text = F.when(kind == 0, "A FLASH FLOOD hit").when(kind == 1, "Landslide after the typhoon").when(kind == 2, "A land slide on a dry day").when(kind == 3, "Fire and blaze").otherwise("Nothing of note")
    labels = classify.rule_labels(text)
    out = read(spark, sf_dir, "orders").select("o_orderkey", labels.alias("labels")).withColumn("r", classify.routed(F.col("labels")))
    return out.select("o_orderkey", F.array_join("labels", "|").alias("labels"), F.col("r.label").alias("label"), F.array_join("r.candidates", "|").alias("candidates"))


# --- resolution, order, checks ---------------------------------------------------------------------------------------

_LINKED = """, linked AS (SELECT a, b FROM alternate WHERE a IN (SELECT event FROM event WHERE start_date[1:4] = '1998') AND b IN (SELECT event FROM event WHERE start_date[1:4] = '1998')), r(x, y) AS (SELECT a, a FROM linked UNION SELECT r.x, l.b FROM r JOIN linked l ON l.a = r.y),
    grouped AS (SELECT x AS event, min(y) AS cluster FROM r GROUP BY x)"""


def _clusters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    store = driver_store(spark, sf_dir)
    year = store.event.filter("substring(start_date, 1, 4) = '1998'")
    links = store.alternate.join(year.select(F.col("event").alias("a")), "a", "left_semi").join(year.select(F.col("event").alias("b")), "b", "left_semi")
    return resolve.clusters(links), store.event


@question(_LINKED + " SELECT min_by(g.event, e.start_date || g.event) AS event, count(*) AS members FROM grouped g JOIN event e ON e.event = g.event GROUP BY g.cluster")
def cluster_representatives(spark, sf_dir):
    grouped, events = _clusters(spark, sf_dir)
    sizes = grouped.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"))
    return resolve.representatives(grouped, events.select("event", F.col("start_date").alias("start"))).join(sizes, "cluster").select("event", "members")


@question(_LINKED + """, ranked AS (SELECT cluster, event, row_number() OVER (PARTITION BY cluster ORDER BY CASE WHEN contains(event, '/gda/') THEN -1 WHEN contains(event, '/emdat/') THEN 1 ELSE 0 END, event) AS n FROM grouped)
    SELECT string_agg(g.event, '|' ORDER BY g.event) AS members, max(r.event) AS preferred FROM grouped g JOIN ranked r ON r.cluster = g.cluster AND r.n = 1 GROUP BY g.cluster""")
def canonical_events(spark, sf_dir):
    return resolve.canonical_events(_clusters(spark, sf_dir)[0], {"gda": -1, "emdat": 1}).select(F.array_join("members", "|").alias("members"), "preferred")


@question(_LINKED + """, m AS (SELECT event, cluster, split_part(event, '/', -2) AS source FROM grouped) SELECT 'link' AS kind, count(*) AS n FROM m x JOIN m y ON x.cluster = y.cluster AND x.source <> y.source
    UNION ALL SELECT 'member', count(*) FROM m UNION ALL SELECT 'statement', count(DISTINCT cluster) FROM m UNION ALL SELECT 'run', 1""")
def alignment_triples(spark, sf_dir):
    grouped, _ = _clusters(spark, sf_dir)
    named = grouped.groupBy("cluster").agg(identity.canonical_iri(F.collect_set("event")).alias("canonical"))
    registry = grouped.join(named, "cluster").select("canonical", F.col("event").alias("member"))
    t = resolve.alignment_triples(registry, "https://example.org/alignment-run/1", "2024-01-01T00:00:00", "alignment")
    common = F.contains("s", F.lit("/common/"))
    kind = F.when((F.col("p") == "prov:alternateOf") & ~common, "link").when((F.col("p") == "prov:alternateOf") & common, "member").when(F.col("o") == "rdf:Statement", "statement").when(F.col("o") == "prov:Activity", "run")
    return t.select(kind.alias("kind")).filter("kind IS NOT NULL").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event, min(type_id) AS type_id FROM event_type GROUP BY event", store=True)
def most_specific_types(spark, sf_dir):
    store = driver_store(spark, sf_dir)
    with_roots = store.event_type.unionByName(store.event_type.join(store.taxonomy_roots.withColumnRenamed("id", "type_id"), "type_id").select("event", F.col("root").alias("type_id")).distinct())
    depth = store.taxonomy_closure.groupBy(F.col("descendant").alias("type_id")).agg(F.max("depth").alias("depth"))
    deepest = depth.withColumn("depth", F.least("depth", F.lit(1)))
    return resolve.most_specific(with_roots, deepest)


_EVENTS_SQL = """WITH e AS (SELECT o_orderkey AS event, o_orderkey % 4 AS source, o_orderpriority || '/' || CAST(o_custkey % 50 AS VARCHAR) AS type_base, CAST(o_orderdate AS DATE) AS start FROM orders)
    SELECT least(a.event, b.event) AS a, greatest(a.event, b.event) AS b FROM e a JOIN e b ON a.type_base = b.type_base AND a.source <> b.source AND a.event < b.event AND abs(date_diff('day', a.start, b.start)) <= 5 WHERE a.event % 10 = 0 OR b.event % 10 = 0"""


@query(_EVENTS_SQL)
def pairs_of_arrivals(spark, sf_dir):
    events = _pair_events(spark, sf_dir)
    return resolve.blocked_pairs(events, fresh=events.filter("event % 10 = 0"))


@query("""WITH e AS (SELECT o_orderkey AS k, o_custkey % 50 AS c, CAST(o_orderdate AS DATE) AS d, o_orderkey % 3 AS t FROM orders)
    SELECT x.k AS a, y.k AS b, x.t = y.t OR x.t = 0 AND y.t = 1 OR x.t = 1 AND y.t = 0 AS type_ok, CASE WHEN x.k % 5 <> 0 AND y.k % 5 <> 0 THEN x.k % 2 = y.k % 2 END AS label_ok FROM e x JOIN e y ON x.c = y.c AND x.k < y.k AND x.k % 4 <> y.k % 4 AND abs(date_diff('day', x.d, y.d)) <= 1""")
def label_and_type_gates(spark, sf_dir):
    """Pairs judged by type and by label: subtypes and their parent agree, and so do labels that are parts of each other."""
    orders = read(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    events = orders.select(key.alias("event"), (key % 4).alias("source"), (F.col("o_custkey") % 50).cast("string").alias("type_base"), F.col("o_orderdate").cast("date").alias("start"))
    kind = F.when(key % 3 == 0, "Flood").when(key % 3 == 1, "FlashFloodWet").otherwise("RiverineFlood")
    label = F.when(key % 2 == 0, F.when(key % 3 == 0, "flood").otherwise("flood in region five of the plains")).otherwise(F.when(key % 3 == 0, "armed clash").otherwise("armed clash at a mountain pass"))
    described = orders.select(
        key.alias("event"), F.lit("MajorEvent").alias("event_class"), F.col("o_orderdate").cast("date").alias("start"), kind.alias("type_id"), F.when(key % 3 == 1, "Flood").when(key % 3 == 2, "Plain").alias("type_parent"),
        F.when(key % 5 != 0, label).alias("label"), F.array().cast("array<string>").alias("codes"),
    )
    return resolve.scored_blocked_pairs(events, described, days=1).select("a", "b", "type_ok", "label_ok")


@query("SELECT s.event, s.end_date FROM shown s ORDER BY s.end_date ASC NULLS FIRST, s.event LIMIT 40", store=True)
def first_page_ascending(spark, sf_dir):
    return page(filtered_events(driver_store(spark, sf_dir)), "end", False, 0, 40).select("event", "end_date")


@query("SELECT x.code AS region, x.label, count(DISTINCT s.event) AS events FROM shown s JOIN event_location l ON l.event = s.event JOIN location_closure c ON c.descendant = l.code JOIN location x ON x.code = c.ancestor AND x.level = 'Region' GROUP BY ALL ORDER BY events DESC, label, region LIMIT 3", store=True)
def top_regions(spark, sf_dir):
    return analysis.top_regions(driver_store(spark, sf_dir), most=3)


@query("""SELECT 'place' AS kind, x.code AS id, x.label, x.parent, count(DISTINCT e.event) AS events FROM location x LEFT JOIN location_closure c ON c.ancestor = x.code LEFT JOIN event_location l ON l.code = c.descendant LEFT JOIN event e ON e.event = l.event AND e.start_date IS NOT NULL GROUP BY ALL
    UNION ALL SELECT 'type', x.id, x.id, x.parent, count(DISTINCT e.event) FROM taxonomy x LEFT JOIN taxonomy_closure c ON c.ancestor = x.id LEFT JOIN event_type t ON t.type_id = c.descendant LEFT JOIN event e ON e.event = t.event AND e.start_date IS NOT NULL GROUP BY ALL
    UNION ALL SELECT 'class', event_class, event_class, NULL, count(*) FROM event WHERE start_date IS NOT NULL GROUP BY ALL UNION ALL SELECT 'source', source, source, NULL, count(*) FROM event WHERE start_date IS NOT NULL GROUP BY ALL""", store=True)
def filter_options(spark, sf_dir):
    return analysis.filter_options(driver_store(spark, sf_dir))


@query("SELECT e.event_class, t.type_id, count(DISTINCT e.event) AS events FROM event e JOIN event_type t ON t.event = e.event GROUP BY ALL", store=True)
def instance_counts(spark, sf_dir):
    return analysis.instance_counts(driver_store(spark, sf_dir))


@question("SELECT node AS focus, 'kind::portStatus' AS \"check\", l_linestatus AS value FROM rec WHERE l_linenumber = 7 AND l_suppkey % 6 = 0 AND l_partkey % 4 <> 0")
def check_node_kind(spark, sf_dir):
    return checks.check_node_kind(driver_graph(spark, sf_dir).facts(":portStatus"), ":portStatus", "iri")


@query("SELECT CAST(c_custkey AS VARCHAR) AS focus, 'value:F' AS \"check\" FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def check_has_value(spark, sf_dir):
    return checks.check_has_value(read(spark, sf_dir, "customer"), "c_custkey", read(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", "F").drop("value")


@question("SELECT node AS focus FROM rec WHERE l_linenumber = 2")
def focus_nodes(spark, sf_dir):
    graph = driver_graph(spark, sf_dir)
    return checks.focus_nodes(graph.facts("rdf:type", to=[":Casualties"], by=None), ":Casualties", "https://example.org/", once=graph.once)


@query("SELECT o_custkey % 7 AS batch, o_orderkey FROM orders WHERE o_custkey % 7 NOT IN (SELECT o_custkey % 7 FROM orders WHERE o_orderkey % 1000 = 3)")
def gated_batches(spark, sf_dir):
    """The batches of which no row breaks a rule, as they are written."""
    path = _folder(spark, sf_dir, "gated")
    orders = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 7).alias("batch"), "o_orderkey")
    bad = checks.check_in(orders.withColumn("rest", F.col("o_orderkey") % 1000).filter("rest = 3"), "o_orderkey", "rest", [0])
    checks.gate(orders, "batch", "o_orderkey", bad, lambda df: df.write.mode("overwrite").parquet(path))
    return spark.read.schema(orders.schema).parquet(path)


@question("""SELECT r.event, CAST(sum(CAST(round(CAST(l_extendedprice AS DECIMAL(18, 2)), 0) AS DOUBLE) * CAST(l_linenumber = 4 AS INTEGER) + CASE WHEN l_linenumber = 4 AND l_partkey % 2 = 0 THEN l_suppkey ELSE 0 END
    + CASE WHEN l_linenumber = 6 AND l_partkey % 3 = 0 THEN l_suppkey + 1 ELSE 0 END) AS DOUBLE) AS amount, 'PHP' AS unit FROM rec r WHERE l_linenumber = 4 OR l_linenumber = 6 AND l_partkey % 3 = 0 GROUP BY r.event""")
def damage_over_properties(spark, sf_dir):
    """Damage of events by unit over several links and several properties of amounts."""
    graph = driver_graph(spark, sf_dir)
    links = (":hasInfrastructureDamage", ":hasAgricultureDamage", ":hasHousingDamage", ":hasDamageGeneral")
    amounts = (":infraDamageAmount", ":socialDamageAmount", ":commercialDamageAmount", ":crossSectoralDamageAmount", ":agriDamageAmount", ":housingDamageAmount", ":generalDamageAmount")
    measured = graph.paths((0, links), (1, amounts), (2, ("qudt:numericValue",)), (2, ("qudt:unit",)), names=("event", None, "m", "v", "unit"), by="event")
    return measured.groupBy("event", "unit").agg(F.sum(F.col("v").try_cast("decimal(38,6)")).cast("double").alias("amount")).select("event", "amount", "unit")


@question(f"SELECT event, '{ORGANISATION}' || source[-1:] AS source FROM origin")
def sources_of_events(spark, sf_dir):
    """The path of one or more steps, then one more: where events come from."""
    graph = driver_graph(spark, sf_dir)
    traced = graph.traced()
    if traced is None:
        attributed = graph.pairs("prov:wasAttributedTo", names=("record", "source"))
        traced = hierarchy.reached(graph.pairs("prov:wasDerivedFrom"), attributed.select("record"), "o", "s").select(F.col("start").alias("record"), F.col("node").alias("start")).join(attributed, "record")
    return traced.filter("start LIKE 'https://%'").select(F.col("start").alias("event"), "source").distinct()


# --- field reports ---------------------------------------------------------------------------------------------------


def _field_cells(spark: SparkSession, sf_dir: str, keep: str, **columns) -> DataFrame:
    """Orders of a customer as the places of a report, its region on the first row only, with a row of sums on top."""
    orders = read(spark, sf_dir, "orders").filter("o_custkey % 10 = 0")
    own = orders.filter(keep).select(F.col("o_custkey").cast("string").alias("file"), (F.col("o_orderkey") + 1).alias("row"), F.lit(None).cast("string").alias("REGION"), F.lit(None).cast("string").alias("PROVINCE"), F.concat(F.lit("T"), "o_orderkey").alias("MUNICIPALITY"), *[c.cast("string").alias(n) for n, c in columns.items()])
    top = orders.select(F.col("o_custkey").cast("string").alias("file")).distinct().select("file", F.lit(0).cast("bigint").alias("row"), F.concat(F.lit("R"), "file").alias("REGION"), F.lit("P").alias("PROVINCE"), F.lit(None).cast("string").alias("MUNICIPALITY"), *[F.lit("99999").alias(n) for n in columns])
    return own.unionByName(top)


@query("""SELECT o_custkey || '' AS file, 'R' || o_custkey || '|P|T' || o_orderkey AS place, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END AS "affectedFamilies", CASE WHEN o_orderkey % 3 = 0 THEN 3 END AS "evacuationCenters",
    CASE WHEN o_orderkey % 3 = 0 THEN 7 + CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey ELSE 0 END ELSE 0 END AS "displacedFamilies" FROM orders WHERE o_custkey % 10 = 0 AND (o_orderkey % 2 = 0 OR o_orderkey % 3 = 0)""")
def field_population(spark, sf_dir):
    key = F.col("o_orderkey")
    affected = _field_cells(spark, sf_dir, "o_orderkey % 2 = 0", **{"NO. OF AFFECTED Families": F.format_number(key, 0)})
    inside = _field_cells(spark, sf_dir, "o_orderkey % 3 = 0", **{"No. of Evacuation Centers CUM": F.lit("3"), "INSIDE Families Evacuation": F.lit(" 7 "), "Displaced OUTSIDE Families Cum": F.when(key % 5 != 0, F.col("o_custkey").cast("string")).otherwise("-")})
    return field_reports.population([field_reports.table(affected, field_reports.POPULATION), field_reports.table(inside, field_reports.POPULATION)])


@query("""SELECT o_custkey || '' AS file, 'R' || o_custkey || '|P|T' || o_orderkey AS place, k AS "contributingOrg", v AS "contributionAmount" FROM (SELECT *, unnest(['DSWD', 'NGO']) AS k, unnest([round(o_custkey / 1000.0, 6), CASE WHEN o_orderkey % 3 = 0 THEN 0.5 ELSE 0 END]) AS v FROM orders WHERE o_custkey % 10 = 0) WHERE v <> 0""")
def field_assistance(spark, sf_dir):
    cells = _field_cells(spark, sf_dir, "true", **{"Cost.DSWD": F.format_number(F.col("o_custkey") * 1000, 2), "Cost.NGOs": F.when(F.col("o_orderkey") % 3 == 0, "500,000.00").otherwise("0"), "Cost.LGU": F.lit("none")})
    return field_reports.assistance(cells)


@query("""SELECT o_custkey || '' AS file, 'R' || o_custkey || '|P|T' || o_orderkey AS place, o_orderkey AS totally, CASE WHEN o_orderkey % 4 <> 0 THEN 2 END AS partially FROM orders WHERE o_custkey % 10 = 0""")
def field_houses(spark, sf_dir):
    cells = _field_cells(spark, sf_dir, "true", **{"Damaged.Totally": F.format_number(F.col("o_orderkey"), 0), "Damaged.Partially": F.when(F.col("o_orderkey") % 4 != 0, "2").otherwise("x")})
    return field_reports.houses(cells).select("file", "place", F.col("totallyDamagedHouses").alias("totally"), F.col("partiallyDamagedHouses").alias("partially"))
