"""Registered queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import dates, identity, numbers, strings
from tidemark.model import literal_triples, store_triples
from tidemark.operators import checks, classify, hierarchy, reshape, resolve, sequence
from tidemark.operators.components import connected_components
from tidemark.operators.events import EventFilter, filtered_events, page
from tidemark.operators.inference import Axioms, materialise
from tidemark.operators.impacts import damage_by_unit, impacts, metric_sums, with_facets
from tidemark.operators.match import match_names
from tidemark.plans import analysis
from tidemark.plans.sparql import sparql
from tidemark.plans.tables import STORE_SQL, driver_store, read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None, store: bool = False) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its oracle; ``store``: the SQL continues the common views."""

    def register(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLES[run.__name__] = (STORE_SQL + sql) if store else sql
        return run

    return register


# --- the analysis API ------------------------------------------------------------------------------------------------

HYDRO = EventFilter(types=("Hydro",))
WHERE = EventFilter(event_type="major", start="1996-02-01", end="2000-06-30", locations=("R1", "N7"), types=("Natural",), text="Order")
_WHERE_SQL = """s.event_class = 'MajorEvent' AND s.start_date[1:10] BETWEEN '1996-02-01' AND '2000-06-30'
    AND EXISTS (SELECT 1 FROM event_location l JOIN location_closure c ON c.descendant = l.code WHERE l.event = s.event AND c.ancestor IN ('R1', 'N7'))
    AND EXISTS (SELECT 1 FROM event_type t JOIN taxonomy_closure c ON c.descendant = t.type_id WHERE t.event = s.event AND c.ancestor = 'Natural')
    AND contains(lower(coalesce(s.event_name, '') || ' ' || s.event), 'order')"""


@query("""SELECT x.code AS region, x.label, count(DISTINCT s.event) AS events FROM shown s JOIN event_location l ON l.event = s.event
    JOIN location_closure c ON c.descendant = l.code JOIN location x ON x.code = c.ancestor AND x.level = 'Region'
    WHERE EXISTS (SELECT 1 FROM event_type t JOIN taxonomy_closure k ON k.descendant = t.type_id WHERE t.event = s.event AND k.ancestor = 'Hydro') GROUP BY ALL""", store=True)
def region_rankings(spark, sf_dir):
    return analysis.region_rankings(driver_store(spark, sf_dir), HYDRO)


@query(f"SELECT s.event, s.event_name, s.start_date, s.end_date FROM shown s WHERE {_WHERE_SQL} ORDER BY s.end_date DESC NULLS LAST, s.event LIMIT 25 OFFSET 10", store=True)
def filtered_events_page(spark, sf_dir):
    return page(filtered_events(driver_store(spark, sf_dir), WHERE), "end", True, 10, 25).select("event", "event_name", "start_date", "end_date")


@query(f"SELECT count(DISTINCT s.event) AS n FROM shown s WHERE {_WHERE_SQL}", store=True)
def event_count(spark, sf_dir):
    return analysis.event_count(driver_store(spark, sf_dir), WHERE)


@query("SELECT event FROM suppressed", store=True)
def alternate_suppression(spark, sf_dir):
    return driver_store(spark, sf_dir).suppressed


@query("""SELECT event, kind AS metric, CAST(sum(cnt) AS BIGINT) AS total FROM lines GROUP BY ALL
    UNION ALL SELECT event, 'families', CAST(sum(families) AS BIGINT) FROM lines GROUP BY ALL UNION ALL SELECT event, 'persons', CAST(sum(cnt) AS BIGINT) FROM lines GROUP BY ALL""", store=True)
def impact_by_metric(spark, sf_dir):
    return metric_sums(driver_store(spark, sf_dir)).withColumn("total", F.col("total").cast("bigint"))


@query("""SELECT i.event, coalesce(dead, 0) AS dead, coalesce(injured, 0) AS injured, coalesce(missing, 0) AS missing, families, persons,
    CAST(CASE WHEN u.n = 1 THEN u.amount END AS DOUBLE) AS damage, CASE WHEN u.n = 1 THEN u.unit END AS damage_unit FROM impact i
    JOIN (SELECT event, count(*) AS n, max(amount) AS amount, max(unit) AS unit FROM by_unit GROUP BY event) u ON u.event = i.event""", store=True)
def impacts_wide(spark, sf_dir):
    return impacts(driver_store(spark, sf_dir)).drop("damage_by_unit").withColumn("damage", F.col("damage").cast("double"))


@query("SELECT event, unit, CAST(amount AS DOUBLE) AS amount FROM by_unit", store=True)
def damage_unit_sums(spark, sf_dir):
    return damage_by_unit(driver_store(spark, sf_dir)).withColumn("amount", F.col("amount").cast("double"))


@query("""SELECT count(*) AS records, CAST(sum(dead) AS BIGINT) AS dead, CAST(sum(injured) AS BIGINT) AS injured, CAST(sum(missing) AS BIGINT) AS missing,
    CAST(sum(families) AS BIGINT) AS families, CAST(sum(persons) AS BIGINT) AS persons FROM shown s LEFT JOIN impact i ON i.event = s.event""", store=True)
def summary_totals(spark, sf_dir):
    return analysis.summary(driver_store(spark, sf_dir))


@query("SELECT unit, CAST(sum(amount) AS DOUBLE) AS amount FROM by_unit WHERE event IN (SELECT event FROM shown) GROUP BY unit", store=True)
def summary_damage(spark, sf_dir):
    return analysis.summary_damage(driver_store(spark, sf_dir)).withColumn("amount", F.col("amount").cast("double"))


@query("SELECT t.type_id AS grp, count(*) AS events FROM shown s JOIN event_type t ON t.event = s.event GROUP BY ALL", store=True)
def disaster_counts_type(spark, sf_dir):
    return analysis.counts_by_type(driver_store(spark, sf_dir))


@query("SELECT grp, count(*) AS events FROM rooted GROUP BY ALL", store=True)
def disaster_counts_taxonomy(spark, sf_dir):
    return analysis.counts_by_type(driver_store(spark, sf_dir), by_root=True)


@query("""SELECT start_date[1:4] AS year, CAST(coalesce(sum(dead), 0) AS BIGINT) AS dead, CAST(coalesce(sum(injured), 0) AS BIGINT) AS injured, CAST(coalesce(sum(missing), 0) AS BIGINT) AS missing
    FROM shown s LEFT JOIN impact i ON i.event = s.event GROUP BY ALL""", store=True)
def victim_trends(spark, sf_dir):
    return analysis.victim_trends(driver_store(spark, sf_dir))


@query("SELECT t.type_id AS grp, CAST(sum(coalesce(dead, 0)) AS BIGINT) AS dead FROM shown s JOIN event_type t ON t.event = s.event LEFT JOIN impact i ON i.event = s.event GROUP BY ALL", store=True)
def type_rankings(spark, sf_dir):
    return analysis.type_rankings(driver_store(spark, sf_dir))


@query("""SELECT f.unit, CAST(f.bin AS INTEGER) AS bin, round(f.low + f.bin * f.width, 4) AS lower, round(CASE WHEN f.bin = 9 THEN f.high ELSE f.low + (f.bin + 1) * f.width END, 4) AS upper, coalesce(n, 0) AS events FROM
    (SELECT unit, low, high, (high - low) / 10 AS width, unnest(range(10)) AS bin FROM (SELECT unit, min(CAST(amount AS DOUBLE)) AS low, max(CAST(amount AS DOUBLE)) AS high FROM by_unit WHERE event IN (SELECT event FROM shown) GROUP BY unit)) f
    LEFT JOIN (SELECT b.unit, least(CAST(floor((CAST(amount AS DOUBLE) - low) / ((high - low) / 10)) AS BIGINT), 9) AS bin, count(*) AS n FROM by_unit b
        JOIN (SELECT unit, min(CAST(amount AS DOUBLE)) AS low, max(CAST(amount AS DOUBLE)) AS high FROM by_unit WHERE event IN (SELECT event FROM shown) GROUP BY unit) r ON r.unit = b.unit
        WHERE b.event IN (SELECT event FROM shown) GROUP BY ALL) c ON c.unit = f.unit AND c.bin = f.bin""", store=True)
def damage_histogram(spark, sf_dir):
    return analysis.damage_histogram(driver_store(spark, sf_dir)).withColumns({c: F.round(c, 4) for c in ("lower", "upper")})


@query("SELECT s.event, s.event_name, b.unit, CAST(b.amount AS DOUBLE) AS amount, i.families, i.persons FROM shown s JOIN by_unit b ON b.event = s.event JOIN impact i ON i.event = s.event", store=True)
def damage_vs_affected(spark, sf_dir):
    return analysis.damage_vs_affected(driver_store(spark, sf_dir)).withColumn("amount", F.col("amount").cast("double"))


def _calendar_sql(n: int, extra: str = "") -> str:
    return f"SELECT start_date[1:{n}] AS period, count(*) AS events, CAST(sum(coalesce(dead, 0) + coalesce(injured, 0) + coalesce(missing, 0)) AS BIGINT) AS casualties FROM shown s LEFT JOIN impact i ON i.event = s.event {extra} GROUP BY ALL"


@query(_calendar_sql(4), store=True)
def calendar_years(spark, sf_dir):
    return analysis.calendar(driver_store(spark, sf_dir), digits=4, casualties=True)


@query(_calendar_sql(7, "WHERE starts_with(start_date, '1997')"), store=True)
def calendar_months(spark, sf_dir):
    return analysis.calendar(driver_store(spark, sf_dir), digits=7, prefix="1997", casualties=True)


@query("SELECT start_date[1:10] AS period, count(*) AS events FROM shown WHERE starts_with(start_date, '1997-03') GROUP BY ALL", store=True)
def calendar_days(spark, sf_dir):
    return analysis.calendar(driver_store(spark, sf_dir), digits=10, prefix="1997-03")


@query("SELECT start_date[1:7] AS period, grp, count(*) AS events FROM rooted GROUP BY ALL", store=True)
def category_stacks(spark, sf_dir):
    return analysis.category_stacks(driver_store(spark, sf_dir))


@query("SELECT start_date[6:7] AS period, grp, count(*) AS events FROM rooted GROUP BY ALL", store=True)
def category_stacks_month_of_year(spark, sf_dir):
    return analysis.category_stacks(driver_store(spark, sf_dir), month_of_year=True)


@query("SELECT *, CAST(sum(events) OVER (PARTITION BY grp ORDER BY period ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) AS BIGINT) AS recent FROM (SELECT start_date[1:7] AS period, grp, count(*) AS events FROM rooted GROUP BY ALL)", store=True)
def sliding_16(spark, sf_dir):
    return analysis.sliding_periods(analysis.category_stacks(driver_store(spark, sf_dir)))


@query("SELECT event, event_name, start_date FROM shown WHERE starts_with(start_date, '1998-05')", store=True)
def date_events(spark, sf_dir):
    return filtered_events(driver_store(spark, sf_dir)).filter(F.col("start_date").startswith("1998-05")).select("event", "event_name", "start_date")


@query("""SELECT e.event, e.event_name, e.start_date, t.types, i.dead FROM event e JOIN (SELECT event, string_agg(DISTINCT type_id, ', ' ORDER BY type_id) AS types FROM event_type GROUP BY event) t ON t.event = e.event
    LEFT JOIN impact i ON i.event = e.event WHERE e.start_date IS NOT NULL""", store=True)
def map_list(spark, sf_dir):
    return analysis.map_events(driver_store(spark, sf_dir))


@query("SELECT (SELECT count(*) FROM event WHERE start_date IS NOT NULL) AS listed, (SELECT count(*) FROM shown) AS counted", store=True)
def map_list_vs_count(spark, sf_dir):
    store = driver_store(spark, sf_dir)
    listed = filtered_events(store, suppress=False).select(F.lit(1).alias("listed"), F.lit(0).alias("counted"))
    return listed.unionByName(filtered_events(store).select(F.lit(0).alias("listed"), F.lit(1).alias("counted"))).agg(F.sum("listed").alias("listed"), F.sum("counted").alias("counted"))


@query("SELECT t.event, string_agg(DISTINCT t.type_id, '|' ORDER BY t.type_id) AS types, string_agg(DISTINCT x.label, '|' ORDER BY x.label) AS places FROM event_type t JOIN event_location l ON l.event = t.event JOIN location x ON x.code = l.code GROUP BY t.event", store=True)
def group_concat_facets(spark, sf_dir):
    store = driver_store(spark, sf_dir)
    faceted = with_facets(store.event.select("event"), store).filter("types IS NOT NULL AND locations IS NOT NULL")
    return faceted.select("event", *[F.array_join(F.array_sort(F.transform(c, lambda x: x["label"])), "|").alias(n) for c, n in (("types", "types"), ("locations", "places"))])


@query("""SELECT s.event, coalesce(s.event_name, '(unnamed event)') AS event_name, CAST(coalesce(i.dead, 0) AS BIGINT) AS dead,
    CASE WHEN u.n > 1 THEN 'multiple' ELSE coalesce(u.unit, '') END AS damage_unit FROM shown s LEFT JOIN impact i ON i.event = s.event
    LEFT JOIN (SELECT event, count(*) AS n, max(unit) AS unit FROM by_unit GROUP BY event) u ON u.event = s.event""", store=True)
def export_rows(spark, sf_dir):
    return analysis.export_rows(driver_store(spark, sf_dir)).select("event", "event_name", "dead", "damage_unit")


# --- joins, sets and paths -------------------------------------------------------------------------------------------


@query("""SELECT event, 'location' AS kind, code AS id, CAST(NULL AS VARCHAR) AS label FROM event_location UNION ALL SELECT event, 'disasterType', type_id, CAST(NULL AS VARCHAR) FROM event_type
    UNION ALL SELECT a, 'alternate', b, CAST(NULL AS VARCHAR) FROM alternate UNION ALL SELECT event, 'source', NULL, source FROM event""", store=True)
def metadata_union(spark, sf_dir):
    s = driver_store(spark, sf_dir)
    branches = [
        s.event_location.select("event", F.lit("location").alias("kind"), F.col("code").alias("id")), s.event_type.select("event", F.lit("disasterType").alias("kind"), F.col("type_id").alias("id")),
        s.alternate.select(F.col("a").alias("event"), F.lit("alternate").alias("kind"), F.col("b").alias("id")), s.event.select("event", F.lit("source").alias("kind"), F.col("source").alias("label")),
    ]
    out = branches[0].withColumn("label", F.lit(None).cast("string"))
    for branch in branches[1:]:
        out = out.unionByName(branch, allowMissingColumns=True)
    return out


@query("SELECT c_custkey, c_name, n AS orders, round(total, 2) AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey")
def optional_subselect(spark, sf_dir):
    totals = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return customers.join(totals, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", "orders", F.round("total", 2).alias("total"))


@query("""SELECT coalesce(s.k, c.k) AS nation, suppliers, customers FROM (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier WHERE s_nationkey % 3 <> 0 GROUP BY 1) s
    FULL JOIN (SELECT c_nationkey AS k, count(*) AS customers FROM customer WHERE c_nationkey % 4 <> 0 GROUP BY 1) c ON s.k = c.k""")
def full_outer_coalesce(spark, sf_dir):
    suppliers = read(spark, sf_dir, "supplier").filter("s_nationkey % 3 <> 0").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("suppliers"))
    customers = read(spark, sf_dir, "customer").filter("c_nationkey % 4 <> 0").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("customers"))
    return reshape.full_merge([suppliers, customers], "nation")


@query("SELECT descendant, ancestor, CAST(depth AS INTEGER) AS depth FROM location_closure", store=True)
def closure_star(spark, sf_dir):
    return driver_store(spark, sf_dir).location_closure


@query("SELECT descendant, ancestor, CAST(depth AS INTEGER) AS depth FROM location_closure WHERE depth > 0", store=True)
def closure_plus(spark, sf_dir):
    return hierarchy.path_closure(driver_store(spark, sf_dir).location, "code", "parent")


@query("SELECT c.descendant AS id, c.ancestor AS root FROM taxonomy_closure c JOIN taxonomy t ON t.id = c.ancestor AND t.parent IS NULL", store=True)
def taxonomy_roots(spark, sf_dir):
    return driver_store(spark, sf_dir).taxonomy_roots


@query("""SELECT x.code, x.label, count(DISTINCT s.s_suppkey) AS suppliers FROM location x LEFT JOIN location_closure c ON c.ancestor = x.code
    LEFT JOIN supplier s ON 'N' || CAST(s.s_nationkey AS VARCHAR) = c.descendant AND s.s_acctbal > 5000 GROUP BY ALL""", store=True)
def ancestor_counts_with_zero(spark, sf_dir):
    store = driver_store(spark, sf_dir)
    rich = read(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select("s_suppkey", F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("descendant"))
    counted = store.location_closure.join(rich, "descendant").groupBy(F.col("ancestor").alias("code")).agg(F.count_distinct("s_suppkey").alias("suppliers"))
    return store.location.select("code", "label").join(counted, "code", "left").na.fill(0, ["suppliers"])


@query("SELECT a AS first, b AS second FROM alternate WHERE a < b", store=True)
def self_pairs_ordered(spark, sf_dir):
    return driver_store(spark, sf_dir).alternate.filter("a < b").select(F.col("a").alias("first"), F.col("b").alias("second"))


@query("SELECT c_custkey AS s, p, o FROM (SELECT c_custkey, unnest(['name', 'segment', 'nation']) AS p, unnest([c_name, c_mktsegment, CAST(c_nationkey AS VARCHAR)]) AS o FROM customer) WHERE o IS NOT NULL")
def var_predicate_scan(spark, sf_dir):
    triples = literal_triples(read(spark, sf_dir, "customer"), "c_custkey", {"c_name": "name", "c_mktsegment": "segment", "c_nationkey": "nation"}, "customers")
    return triples.select("s", "p", "o")


@query("SELECT o_orderkey AS stmt, c_name AS subject, 'ordered' AS predicate, CAST(o_totalprice AS VARCHAR) IS NOT NULL AS has_object FROM orders JOIN customer ON o_custkey = c_custkey")
def reified_join(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").withColumn("pred", F.lit("ordered"))
    t = literal_triples(orders, "o_orderkey", {"o_custkey": "rdf:subject", "pred": "rdf:predicate", "o_totalprice": "rdf:object"}, "statements")
    part = lambda p, name: t.filter(F.col("p") == p).select(F.col("s").alias("stmt"), F.col("o").alias(name))
    joined = part("rdf:subject", "cust").join(part("rdf:predicate", "predicate"), "stmt").join(part("rdf:object", "object"), "stmt")
    names = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("cust"), F.col("c_name").alias("subject"))
    return joined.join(names, "cust").select("stmt", "subject", "predicate", F.col("object").isNotNull().alias("has_object"))


_PAIRS_SQL = """WITH e AS (SELECT o_orderkey AS event, o_orderkey % 4 AS source, o_orderpriority || '/' || CAST(o_custkey % 50 AS VARCHAR) AS type_base, CAST(o_orderdate AS DATE) AS start FROM orders)
    SELECT least(a.event, b.event) AS a, greatest(a.event, b.event) AS b FROM e a JOIN e b ON a.type_base = b.type_base AND a.source <> b.source AND a.event < b.event AND abs(date_diff('day', a.start, b.start)) <= 5"""


def _pair_events(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderkey").alias("event"), (F.col("o_orderkey") % 4).alias("source"), F.concat("o_orderpriority", F.lit("/"), (F.col("o_custkey") % 50).cast("string")).alias("type_base"), F.col("o_orderdate").cast("date").alias("start"), "o_orderstatus", "o_custkey")


@query(_PAIRS_SQL)
def blocked_pairs(spark, sf_dir):
    return resolve.blocked_pairs(_pair_events(spark, sf_dir))


@query(f"WITH p AS ({_PAIRS_SQL}) SELECT (SELECT count(*) FROM orders) AS n, count(*) AS pairs FROM p")
def blocking_reduction(spark, sf_dir):
    events = _pair_events(spark, sf_dir)
    return resolve.reduction(resolve.blocked_pairs(events), events).select("n", "pairs")


@query(f"""WITH p AS ({_PAIRS_SQL}), g AS (SELECT p.a, p.b, abs(date_diff('day', CAST(x.o_orderdate AS DATE), CAST(y.o_orderdate AS DATE))) <= CASE WHEN x.o_orderstatus = 'P' OR y.o_orderstatus = 'P' THEN 2 ELSE 5 END AS date_ok,
    CASE WHEN x.o_orderstatus = 'P' OR y.o_orderstatus = 'P' THEN lpad(CAST(x.o_custkey AS VARCHAR), 10, '0')[1:4] = lpad(CAST(y.o_custkey AS VARCHAR), 10, '0')[1:4] END AS place_ok
    FROM p JOIN orders x ON x.o_orderkey = p.a JOIN orders y ON y.o_orderkey = p.b) SELECT a, b, date_ok, place_ok, coalesce(date_ok, true) AND coalesce(place_ok, true) AS is_match FROM g""")
def pair_gates(spark, sf_dir):
    events = _pair_events(spark, sf_dir)
    described = events.select(
        "event", F.when(F.col("o_orderstatus") == "P", "Incident").otherwise("MajorEvent").alias("event_class"), "start", F.lit("Flood").alias("type_id"), F.lit(None).cast("string").alias("type_parent"),
        F.lit(None).cast("string").alias("label"), F.array(identity.place_code(F.col("o_custkey"))).alias("codes"),
    )
    return resolve.scored_pairs(resolve.blocked_pairs(events), described).select("a", "b", "date_ok", "place_ok", "is_match")


@query("""WITH RECURSIVE e AS (SELECT a.o_orderkey AS x, b.o_orderkey AS y FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey AND abs(date_diff('day', CAST(a.o_orderdate AS DATE), CAST(b.o_orderdate AS DATE))) <= 30),
    r(x, y) AS (SELECT x, x FROM e UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y) SELECT x AS node, min(y) AS component FROM r GROUP BY x""")
def components_of_alternates(spark, sf_dir):
    slim = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    a, b = slim.alias("a"), slim.alias("b")
    near = (F.col("a.o_custkey") == F.col("b.o_custkey")) & (F.col("a.o_orderkey") < F.col("b.o_orderkey")) & (F.abs(F.datediff("a.o_orderdate", "b.o_orderdate")) <= 30)
    return connected_components(a.join(b, near).select(F.col("a.o_orderkey").alias("a"), F.col("b.o_orderkey").alias("b")))


@query(f"WITH p AS ({_PAIRS_SQL}) SELECT a, b FROM p WHERE (a + b) % 3 <> 0")
def registry_new_pairs(spark, sf_dir):
    pairs = resolve.blocked_pairs(_pair_events(spark, sf_dir))
    known = pairs.filter("(a + b) % 3 = 0").select(F.col("b").alias("a"), F.col("a").alias("b"))
    return resolve.new_pairs(pairs, known)


# --- order-dependent operators ---------------------------------------------------------------------------------------

_CELL = "CASE WHEN event_id % 4 = 0 THEN event_type END"


def _cells(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.expr(_CELL).alias("cell"), "value")


@query(f"SELECT event_id, last_value(cell IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cell FROM (SELECT *, {_CELL} AS cell FROM events)")
def forward_fill(spark, sf_dir):
    return sequence.forward_fill(_cells(spark, sf_dir), ["cell"], ["user_id"], ["ts", "event_id"]).select("event_id", "cell")


@query("SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS row FROM events")
def row_index(spark, sf_dir):
    return sequence.row_index(_cells(spark, sf_dir), ["user_id"], ["ts", "event_id"]).select("event_id", "row")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def keep_first(spark, sf_dir):
    return sequence.keep_first(read(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id, value) > 1 AS duplicated FROM events")
def dup_flag(spark, sf_dir):
    return sequence.duplicate_flag(read(spark, sf_dir, "events"), ["user_id", "value"]).select("event_id", "duplicated")


@query("""WITH b AS (SELECT *, CASE WHEN event_id % 7 = 0 THEN event_type END AS region, CASE WHEN event_id % 3 = 0 THEN event_type END AS province FROM events),
    r AS (SELECT *, last_value(region IGNORE NULLS) OVER w AS filled, count(region) OVER w AS run FROM b WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
    SELECT event_id, filled AS region, last_value(province IGNORE NULLS) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS province FROM r""")
def hierarchical_fill(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.expr("CASE WHEN event_id % 7 = 0 THEN event_type END").alias("region"), F.expr("CASE WHEN event_id % 3 = 0 THEN event_type END").alias("province"))
    return sequence.hierarchical_fill(rows, ["region", "province"], ["user_id"], ["ts", "event_id"]).select("event_id", "region", "province")


@query("""SELECT event_id, CAST(sum(far) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM
    (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 3600000000 THEN 1 ELSE 0 END AS far FROM events)""")
def gap_clusters(spark, sf_dir):
    events = read(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    return sequence.gap_clusters(events, "at", 3_600_000_000, ["user_id"], ["ts", "event_id"]).select("event_id", "cluster")


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events) WHERE n = 1")
def best_of_key(spark, sf_dir):
    return sequence.best_of(read(spark, sf_dir, "events"), ["user_id"], "value", ["event_id"]).select("user_id", "event_id", "value")


# --- reshaping -------------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, kind, amount FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, unnest(['l_tax', 'l_discount']) AS kind, unnest([l_tax, l_discount]) AS amount FROM lineitem) WHERE amount <> 0")
def unpivot_costs(spark, sf_dir):
    return reshape.unpivot_amounts(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], ["l_tax", "l_discount"], "kind", "amount")


@query("SELECT p_partkey, part, CAST(ordinal AS INTEGER) AS ordinal FROM (SELECT p_partkey, unnest(string_split(p_name || ' ' || p_type, ' ')) AS part, generate_subscripts(string_split(p_name || ' ' || p_type, ' '), 1) AS ordinal FROM part)")
def explode_list(spark, sf_dir):
    parts = read(spark, sf_dir, "part").select("p_partkey", F.concat_ws("|", F.translate("p_name", " ", "|"), "p_type").alias("listed"))
    return reshape.explode_list(parts, "listed", r"\|", "part", "ordinal").select("p_partkey", "part", "ordinal")


@query("""SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice ORDER BY k) AS INTEGER) AS ordinal, kind, cnt FROM
    (SELECT *, unnest([1, 2, 3]) AS k, unnest(['dead', 'injured', 'missing']) AS kind, unnest([CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS BIGINT) END, CAST(l_linenumber AS BIGINT), CASE WHEN l_linestatus = 'O' THEN CAST(l_quantity AS BIGINT) END]) AS cnt FROM lineitem) WHERE cnt IS NOT NULL""")
def casualty_ordinals(spark, sf_dir):
    wide = read(spark, sf_dir, "lineitem").select("l_orderkey", F.expr("CASE WHEN l_returnflag = 'A' THEN l_quantity END").alias("d"), F.col("l_linenumber").alias("i"), F.expr("CASE WHEN l_linestatus = 'O' THEN l_quantity END").alias("m"))
    return reshape.long_counts(wide, ["l_orderkey"], {"d": "dead", "i": "injured", "m": "missing"})


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'R' THEN l_linestatus ELSE l_shipmode END AS target, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_linestatus END AS l_linestatus FROM (SELECT *, 'x' AS l_shipmode FROM lineitem)")
def move_values(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").withColumn("target", F.lit("x"))
    return reshape.move_values(lines, "l_linestatus", "target", F.col("l_returnflag") == "R").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "target", "l_linestatus")


@query("SELECT p_name, p_type, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1 ORDER BY n DESC, p_name, p_type LIMIT 5")
def duplicate_report(spark, sf_dir):
    return reshape.duplicate_report(read(spark, sf_dir, "part"), ["p_name", "p_type"])


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE lower(o_orderpriority) NOT IN ('5-low', '1-urgent')")
def drop_words(spark, sf_dir):
    return reshape.drop_words(read(spark, sf_dir, "orders"), "o_orderpriority", ["5-LOW", "1-Urgent"]).select("o_orderkey", "o_orderstatus")


# --- cleaning --------------------------------------------------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_quantity) AS BIGINT) AS whole, floor(l_extendedprice) AS price, round(floor(l_extendedprice) / 1000000, 6) AS millions FROM lineitem""")
def clean_numbers(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    messy = F.concat(F.lit("PHP "), F.format_number(F.floor("l_extendedprice"), 0), F.lit(" *"))
    whole = F.concat(F.lit(" "), F.col("l_quantity").cast("string"), F.lit(" pax"))
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", numbers.to_int(whole).alias("whole"), numbers.to_float(messy).alias("price"), numbers.to_millions(messy).alias("millions"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(last_day(CAST(o_orderdate AS DATE)) AS DATE) AS month_end, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders")
def parse_dates(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "dd MMMM yyyy")).otherwise(F.date_format("o_orderdate", "MMMM d, yyyy"))
    day = dates.first_date(text, ["d MMMM yyyy", "MMMM d, yyyy"])
    return orders.select("o_orderkey", day.alias("day"), dates.assembled(F.year(day), F.month(day), F.lit(None).cast("int"), end=True).alias("month_end"), dates.year_windows(day)[0].alias("year"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-01') AS first, strftime(last_day(CAST(o_orderdate AS DATE)), '%Y-%m-%d') AS last FROM orders")
def date_ranges(spark, sf_dir):
    month, year = F.date_format("o_orderdate", "MMMM"), F.date_format("o_orderdate", "yyyy")
    r = dates.date_range(F.concat(month, F.lit("–"), month, F.lit(" "), year))
    return read(spark, sf_dir, "orders").select("o_orderkey", r.alias("r")).select("o_orderkey", F.col("r.start").alias("first"), F.col("r.end").alias("last"))


@query("""SELECT c_custkey, lower(replace(c_name, '#', ' ')) AS folded, lower(replace(c_name, '#', '')) AS key, '''' || '=' || c_name AS safe, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END AS segment FROM customer""")
def string_clean(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    return c.select("c_custkey", strings.folded(F.col("c_name")).alias("folded"), strings.alphanumeric_key(F.col("c_name")).alias("key"), strings.spreadsheet_safe(F.concat(F.lit("="), "c_name")).alias("safe"), strings.null_if_in(F.col("c_mktsegment"), ["building"]).alias("segment"))


@query("SELECT page_id, regexp_extract(url, '([^/#]*)$', 1) AS name FROM pages")
def local_names(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", identity.local_name(F.col("url")).alias("name"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def json_extract(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("""SELECT o_orderkey, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || translate(h[17], '0123456789abcdef', '89ab89ab89ab89ab') || h[18:20] || '-' || h[21:32] AS uuid FROM
    (SELECT o_orderkey, sha1(unhex('f47ac10b58cc4372a5670e02b2c3d479') || encode(CAST(o_orderkey AS VARCHAR))) AS h FROM orders)""")
def uuid5_ids(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", identity.uuid5(identity.EVENT_NAMESPACE, F.col("o_orderkey").cast("string")).alias("uuid"))


# --- text and vectors ------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(t, 'thth|ouea') THEN 'Double' END, CASE WHEN regexp_matches(t, 'token') AND regexp_matches(t, 'the|les') THEN 'Secret' END,
    CASE WHEN regexp_matches(t, 'license') THEN 'License' END], lambda x: x IS NOT NULL), '|') AS labels FROM (SELECT doc_id, lower(text) AS t FROM documents)""")
def rule_classify(spark, sf_dir):
    rules = [(["thth", "ouea"], "Double", []), (["token"], "Secret", ["the", "les"]), (["license"], "License", [])]
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(classify.rule_labels(F.col("text"), rules), "|").alias("labels"))


@query("""SELECT conv_id, turn, kind, level FROM (SELECT conv_id, turn, 'TCWS' AS kind, upper(CAST(turn AS VARCHAR)) AS level FROM conversations WHERE turn > 0
    UNION ALL SELECT conv_id, turn, 'Rainfall Warning', 'RED' FROM conversations WHERE conv_id % 2 = 0 UNION ALL SELECT conv_id, turn, 'Flood Warning', NULL FROM conversations WHERE conv_id % 3 = 0)""")
def warning_extract(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    said = F.concat_ws(". ", F.when(F.col("turn") > 0, F.concat(F.lit("TCWS no. "), F.col("turn").cast("string"))), F.when(F.col("conv_id") % 2 == 0, F.lit("Red rainfall warning")), F.when(F.col("conv_id") % 3 == 0, F.lit("flood advisory")), F.lit("end"))
    keyed = c.select(F.struct("conv_id", "turn").alias("key"), said.alias("said"))
    return classify.warnings(keyed, "key", "said").select("key.conv_id", "key.turn", "kind", "level")


@query("""WITH v AS (SELECT vec_id, embedding AS e FROM embeddings), c AS (SELECT * FROM (VALUES ('even', [CASE WHEN i % 2 = 0 THEN 1.0 ELSE 0.0 END FOR i IN range(64)]), ('low', [CASE WHEN i < 32 THEN 1.0 ELSE 0.0 END FOR i IN range(64)]), ('odd', [CASE WHEN i % 2 = 1 THEN 1.0 ELSE 0.0 END FOR i IN range(64)])) t(label, w)),
    s AS (SELECT vec_id, label, list_cosine_similarity(CAST(e AS DOUBLE[]), CAST(w AS DOUBLE[])) AS score FROM v, c) SELECT vec_id, arg_max(label, score) AS label, round(max(score), 6) AS score FROM s GROUP BY vec_id""")
def nearest_label(spark, sf_dir):
    labels = {"even": [float(i % 2 == 0) for i in range(64)], "low": [float(i < 32) for i in range(64)], "odd": [float(i % 2) for i in range(64)]}
    return classify.nearest_label(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", labels).withColumn("score", F.round("score", 6))


@query("""SELECT p_partkey, label FROM (SELECT p_partkey, label, row_number() OVER (PARTITION BY p_partkey ORDER BY length(alias) DESC, alias DESC) AS n FROM part
    JOIN (VALUES ('red', 'warm'), ('ring', 'round'), ('widget', 'thing'), ('small', 'little'), ('blue', 'cold')) a(alias, label) ON contains(lower(p_name), alias)) WHERE n = 1""")
def longest_alias(spark, sf_dir):
    aliases = spark.createDataFrame([("red", "warm"), ("ring", "round"), ("widget", "thing"), ("small", "little"), ("blue", "cold")], "alias string, label string")
    return classify.longest_alias(read(spark, sf_dir, "part"), "p_partkey", "p_name", aliases)


# --- checks ----------------------------------------------------------------------------------------------------------


@query("SELECT CAST(o_orderkey AS VARCHAR) AS focus, 'datatype:o_orderpriority' AS \"check\", o_orderpriority AS value FROM orders")
def check_datatype(spark, sf_dir):
    return checks.check_datatype(read(spark, sf_dir, "orders"), "o_orderkey", "o_orderpriority", "int")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS focus, 'class:o_custkey' AS \"check\", CAST(o_custkey AS VARCHAR) AS value FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def check_class(spark, sf_dir):
    return checks.check_class(read(spark, sf_dir, "orders"), "o_orderkey", "o_custkey", read(spark, sf_dir, "customer").filter("c_acctbal > 0").select("c_custkey"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS focus, 'count' AS \"check\", CAST(count(o_orderkey) AS VARCHAR) AS value FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey HAVING count(o_orderkey) < 8 OR count(o_orderkey) > 14")
def check_count(spark, sf_dir):
    return checks.check_count(read(spark, sf_dir, "customer"), "c_custkey", read(spark, sf_dir, "orders"), "o_custkey", 8, 14)


@query("SELECT CAST(o_orderkey AS VARCHAR) AS focus, 'in:o_orderstatus' AS \"check\", o_orderstatus AS value FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
def check_in(spark, sf_dir):
    return checks.check_in(read(spark, sf_dir, "orders"), "o_orderkey", "o_orderstatus", ["F", "O"])


@query("SELECT CAST(o_orderkey AS VARCHAR) AS focus, 'pattern:o_orderpriority' AS \"check\", o_orderpriority AS value FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[1-3]-[A-Z]+$')")
def check_pattern(spark, sf_dir):
    return checks.check_pattern(read(spark, sf_dir, "orders"), "o_orderkey", "o_orderpriority", "^[1-3]-[A-Z]+$")


@query("SELECT CAST(l_orderkey AS VARCHAR) AS focus, 'order:l_discount:l_tax' AS \"check\", l_discount IS NOT NULL AS some FROM lineitem WHERE l_discount > l_tax")
def check_less_or_equal(spark, sf_dir):
    return checks.check_less_or_equal(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_discount", "l_tax").select("focus", "check", F.col("value").isNotNull().alias("some"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS focus, 'detail' AS \"check\" FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def check_detail(spark, sf_dir):
    return checks.check_detail(read(spark, sf_dir, "customer"), "c_custkey", read(spark, sf_dir, "orders").filter("o_orderstatus = 'P'"), "o_custkey").drop("value")


# --- SPARQL over the triples of the same store -----------------------------------------------------------------------


def _ask(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return sparql(store_triples(driver_store(spark, sf_dir), "driver"), text)


@query("""SELECT c.ancestor AS region, x.label, CAST(count(DISTINCT e.event) AS VARCHAR) AS n FROM event e JOIN event_location l ON l.event = e.event JOIN location_closure c ON c.descendant = l.code
    JOIN location x ON x.code = c.ancestor WHERE x.level = 'Region' AND e.start_date IS NOT NULL GROUP BY ALL""", store=True)
def sparql_region_counts(spark, sf_dir):
    text = "SELECT ?region ?label (COUNT(DISTINCT ?e) AS ?n) WHERE { ?e :startDate ?d ; :hasLocation ?l . ?l :isPartOf* ?region . ?region :isPartOf <W> ; rdfs:label ?label } GROUP BY ?region ?label"
    return _ask(spark, sf_dir, text)


@query("SELECT event AS e FROM shown", store=True)
def sparql_suppression(spark, sf_dir):
    return _ask(spark, sf_dir, """SELECT ?e WHERE { ?e :startDate ?d FILTER NOT EXISTS { ?e prov:alternateOf ?o . ?o :startDate ?x
        FILTER(SUBSTR(?x, 1, 10) < SUBSTR(?d, 1, 10) || (SUBSTR(?x, 1, 10) = SUBSTR(?d, 1, 10) && STR(?o) < STR(?e))) } }""")


@query("""SELECT e.event AS e, e.end_date AS d, string_agg(DISTINCT t.type_id, '|' ORDER BY t.type_id) AS types FROM event e JOIN event_type t ON t.event = e.event
    WHERE e.event_class = 'Incident' GROUP BY ALL""", store=True)
def sparql_optional_concat(spark, sf_dir):
    return _ask(spark, sf_dir, "SELECT ?e ?d (GROUP_CONCAT(DISTINCT ?t ; SEPARATOR='|') AS ?types) WHERE { ?e a :Incident ; :hasDisasterType ?t OPTIONAL { ?e :endDate ?d } } GROUP BY ?e ?d")


@query("""SELECT event AS e, code AS v, 'place' AS kind FROM event_location WHERE code IN ('N1', 'N2') UNION ALL SELECT event, type_id, 'type' FROM event_type WHERE type_id = 'PROMO'""", store=True)
def sparql_union_values(spark, sf_dir):
    return _ask(spark, sf_dir, "SELECT ?e ?v ?kind WHERE { { VALUES ?v { <N1> <N2> } ?e :hasLocation ?v BIND('place' AS ?kind) } UNION { ?e :hasDisasterType ?v FILTER(?v = 'PROMO') BIND('type' AS ?kind) } }")


@query("SELECT year(CAST(start_date AS TIMESTAMP)) || '' AS y, CAST(count(*) AS VARCHAR) AS n FROM event WHERE start_date IS NOT NULL AND contains(lower(coalesce(CASE WHEN event_name LIKE 'Order%' THEN event_name END, '')), 'urgent') GROUP BY ALL", store=True)
def sparql_text_by_year(spark, sf_dir):
    return _ask(spark, sf_dir, "SELECT ?y (COUNT(?e) AS ?n) WHERE { ?e :startDate ?d ; :eventName ?name FILTER(CONTAINS(LCASE(?name), 'urgent')) BIND(YEAR(?d) AS ?y) } GROUP BY ?y")


@query("SELECT DISTINCT least(a, b) AS x, greatest(a, b) AS y FROM alternate WHERE a IN (SELECT event FROM event_type WHERE type_id = 'SMALL') AND b IN (SELECT event FROM event_type WHERE type_id = 'SMALL')", store=True)
def sparql_shared_type_pairs(spark, sf_dir):
    return _ask(spark, sf_dir, "SELECT DISTINCT ?x ?y WHERE { ?x prov:alternateOf ?y ; :hasDisasterType <SMALL> . ?y :hasDisasterType <SMALL> FILTER(STR(?x) < STR(?y)) }")


@query("SELECT a.a AS s, ':sameAs' AS p, a.b AS o, 'iri' AS o_kind FROM alternate a JOIN event e ON e.event = a.a WHERE e.event_class = 'Incident' UNION ALL SELECT e.event, ':day', e.start_date, 'literal' FROM event e WHERE e.event_class = 'Incident' AND e.start_date IS NOT NULL AND e.event IN (SELECT a FROM alternate)", store=True)
def sparql_construct(spark, sf_dir):
    return _ask(spark, sf_dir, "CONSTRUCT { ?e :sameAs ?o ; :day ?d } WHERE { ?e a :Incident ; prov:alternateOf ?o OPTIONAL { ?e :startDate ?d } }").select("s", "p", "o", "o_kind")


@query("SELECT code AS s, ':isPartOf' AS p, parent AS o, 'iri' AS o_kind FROM location WHERE parent = 'R1' UNION ALL SELECT code, 'rdfs:label', label, 'literal' FROM location WHERE parent = 'R1'", store=True)
def sparql_describe(spark, sf_dir):
    return _ask(spark, sf_dir, "DESCRIBE ?x WHERE { GRAPH <driver> { ?x :isPartOf <R1> } }").select("s", "p", "o", "o_kind")


@query("SELECT 'driver' AS g, 'xsd:string' AS d, CAST(count(*) AS VARCHAR) AS n FROM event WHERE start_date IS NOT NULL", store=True)
def sparql_graphs_and_datatypes(spark, sf_dir):
    return _ask(spark, sf_dir, "SELECT ?g ?d (COUNT(?v) AS ?n) WHERE { { SELECT ?g ?v (DATATYPE(?v) AS ?d) WHERE { GRAPH ?g { ?e :startDate ?v } } } } GROUP BY ?g ?d")


@query("SELECT least(a, b) AS x, greatest(a, b) AS y, string_agg(DISTINCT o.code, '|' ORDER BY o.code) AS places FROM alternate JOIN event_location o ON o.event = a OR o.event = b WHERE a < b AND a IN (SELECT event FROM event_type WHERE type_id = 'LARGE') GROUP BY a, b", store=True)
def sparql_path_alternatives(spark, sf_dir):
    return _ask(spark, sf_dir, "SELECT ?x ?y (GROUP_CONCAT(DISTINCT ?l ; SEPARATOR='|') AS ?places) WHERE { ?x prov:alternateOf ?y ; :hasDisasterType <LARGE> ; (:hasLocation|prov:alternateOf/:hasLocation) ?l FILTER(STR(?x) < STR(?y)) } GROUP BY ?x ?y")


@query("SELECT id, root FROM (SELECT c.descendant AS id, c.ancestor AS root FROM taxonomy_closure c JOIN taxonomy t ON t.id = c.ancestor AND t.parent IS NULL) WHERE id <> root", store=True)
def inferred_taxonomy(spark, sf_dir):
    store = driver_store(spark, sf_dir)
    broader = store.taxonomy.filter("parent IS NOT NULL").select(F.col("id").alias("s"), F.lit("broader").alias("p"), F.col("parent").alias("o"))
    facts = materialise(broader, Axioms(transitive=["broader"], inverse=[("broader", "narrower")]))
    tops = store.taxonomy.filter("parent IS NULL").select(F.col("id").alias("o"))
    return facts.filter("p = 'broader'").join(tops, "o", "left_semi").select(F.col("s").alias("id"), F.col("o").alias("root"))


@query("""SELECT c_name AS query, n_name AS matched FROM (SELECT c_name, c_nationkey FROM customer) JOIN nation ON n_nationkey = c_nationkey""")
def fuzzy_names(spark, sf_dir):
    nations = read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_name").alias("id"), F.col("n_nationkey").alias("pos"))
    customers = read(spark, sf_dir, "customer").select("c_name", F.concat(F.lit("nation"), F.when(F.col("c_custkey") % 2 == 0, "_").otherwise("  "), F.col("c_nationkey").cast("string")).alias("query"))
    matched = match_names(customers.select("query").distinct(), nations).select("query", F.col("id").alias("matched"))
    return customers.join(matched, "query").select(F.col("c_name").alias("query"), "matched")
