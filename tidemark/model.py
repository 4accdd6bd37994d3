"""The logical model: typed tables of events, their facets and impacts, hierarchies and links; and triples."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import stored

#: g: named graph; o_kind: iri, literal or blank.
TRIPLES = "g string, s string, p string, o string, o_kind string, o_dt string, o_lang string"
EVENT = "event string, source string, event_class string, event_name string, incident_description string, start_date string, end_date string"
ENTITY_KEYS = {"casualty": "kind", "population": "node", "damage": "unit"}


@dataclass
class EventStore:
    """One loaded data set. Closures and suppressed ids are worked out once, on first use."""

    event: DataFrame  # EVENT; start_date and end_date are ISO texts
    event_location: DataFrame  # event, code
    event_type: DataFrame  # event, type_id
    casualty: DataFrame  # event, kind (dead, injured, missing), cnt
    population: DataFrame  # event, families, persons
    damage: DataFrame  # event, amount (decimal), unit
    alternate: DataFrame  # a, b; both directions
    location: DataFrame  # code, label, level, parent
    taxonomy: DataFrame  # id, label, note, parent
    provenance: DataFrame | None = None  # child, parent
    attribution: DataFrame | None = None  # node, org
    _kept: dict = field(default_factory=dict, repr=False)

    def saved(self, folder: str) -> EventStore:
        """The same store as Parquet tables in ``folder``, with its closures, roots and suppressed ids, all worked out now."""
        tables = {f.name: getattr(self, f.name) for f in fields(self) if isinstance(getattr(self, f.name), DataFrame)}
        out = EventStore(**{name: stored(df, f"{folder}/{name}") for name, df in tables.items()})
        for name, df in {"location": out.location_closure, "taxonomy": out.taxonomy_closure, "roots": out.taxonomy_roots, "suppressed": out.suppressed}.items():
            out._kept[name] = stored(df, f"{folder}/kept_{name}")
        return out

    def _once(self, name: str, make) -> DataFrame:
        if name not in self._kept:
            self._kept[name] = make()
        return self._kept[name]

    @property
    def location_closure(self) -> DataFrame:
        from tidemark.operators.hierarchy import closure

        return self._once("location", lambda: closure(self.location, "code", "parent"))

    @property
    def taxonomy_closure(self) -> DataFrame:
        from tidemark.operators.hierarchy import closure

        return self._once("taxonomy", lambda: closure(self.taxonomy, "id", "parent"))

    @property
    def taxonomy_roots(self) -> DataFrame:
        from tidemark.operators.hierarchy import roots

        return self._once("roots", lambda: roots(self.taxonomy, "id", "parent"))

    @property
    def suppressed(self) -> DataFrame:
        from tidemark.operators.events import suppressed

        return self._once("suppressed", lambda: suppressed(self.event, self.alternate))


def literal_triples(rows: DataFrame, subject: str, predicates: dict[str, str], graph: str, kind: str = "literal") -> DataFrame:
    """One triple for each non-null column named in ``predicates`` (column: predicate), as one pass over the rows."""
    cells: list[Column] = []
    types = dict(rows.dtypes)
    xsd = {"bigint": "integer", "int": "int", "double": "float", "date": "date", "timestamp": "dateTime", "boolean": "boolean"}
    for column, predicate in predicates.items():
        datatype = None if kind != "literal" else f"xsd:{xsd.get(types[column], 'decimal' if types[column].startswith('decimal') else 'string')}"
        cells.append(F.struct(F.lit(predicate).alias("p"), F.col(column).cast("string").alias("o"), F.lit(datatype).cast("string").alias("o_dt")))
    return (
        rows.select(F.col(subject).alias("s"), F.explode(F.array(*cells)).alias("x")).filter("s IS NOT NULL AND x.o IS NOT NULL")
        .select(F.lit(graph).alias("g"), "s", "x.p", "x.o", F.lit(kind).alias("o_kind"), "x.o_dt", F.lit(None).cast("string").alias("o_lang"))
    )


def store_triples(store: EventStore, graph: str) -> DataFrame:
    """The triples of a store's events, facets, impacts and links; a set."""
    iri = lambda df, s, p: literal_triples(df, s, p, graph, "iri")
    parts = [
        literal_triples(store.event, "event", {"event_name": ":eventName", "incident_description": ":incidentDescription", "start_date": ":startDate", "end_date": ":endDate"}, graph),
        iri(store.event.withColumn("event_class", F.concat(F.lit(":"), "event_class")), "event", {"event_class": "rdf:type"}),
        iri(store.event_location, "event", {"code": ":hasLocation"}),
        iri(store.event_type, "event", {"type_id": ":hasDisasterType"}),
        iri(store.alternate, "a", {"b": "prov:alternateOf"}),
        iri(store.location, "code", {"parent": ":isPartOf"}),
        literal_triples(store.location, "code", {"label": "rdfs:label"}, graph),
        iri(store.taxonomy, "id", {"parent": "skos:broader"}),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.dropDuplicates()
