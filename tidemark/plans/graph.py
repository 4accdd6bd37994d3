"""Questions about single events and places, over a triple table (s, p, o, o_kind)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.hierarchy import path_closure, reached
from tidemark.session import written

LABELS = ["rdfs:label", "skos:prefLabel"]


def literal_rows(spark: SparkSession, values: list[str] | tuple[str, ...], name: str) -> DataFrame:
    """Constants as rows, a plan of known size; none gives no rows."""
    return spark.range(1).select(F.explode(F.array(*map(F.lit, values)).cast("array<string>")).alias(name))


#: A list of so many values at most becomes part of the plan, so that it reaches the scans; longer ones are joined.
FEW = 1000


def listed(wanted: DataFrame) -> DataFrame | list[str]:
    """The values of a frame's only column as a list, or the frame if they are many."""
    few = [r[0] for r in wanted.distinct().limit(FEW + 1).collect()]
    return wanted if len(few) > FEW else sorted(x for x in few if x is not None)


def narrowed(df: DataFrame, column: str, wanted: DataFrame | list[str]) -> DataFrame:
    """Rows whose column is among the values of a list or of a frame's only column."""
    if isinstance(wanted, DataFrame):
        wanted = listed(wanted)
    if isinstance(wanted, DataFrame):
        return df.join(wanted.toDF(column), column, "left_semi").select(*df.columns)
    return df.filter(F.col(column).isin(*wanted)) if wanted else df.filter(F.lit(False))


#: A sieve has eight bits or more for each value, and is made of so many values at most: 8 MB.
MOST_SIFTED = 1 << 23


def sieve(df: DataFrame, column: str) -> Callable[[Column], Column] | None:
    """A test that all values of a column pass and about one in ten of others, so that rows are left out before they are moved for
    an exact join; None if the values are too many. It reads ``df`` twice, so that should be a table or slim rows of one."""
    n = df.count()
    if n > MOST_SIFTED:
        return None
    words = 1 << max(4, (8 * n - 1).bit_length() - 6)
    bit = lambda c: F.xxhash64(c).bitwiseAND(F.lit(words * 64 - 1))
    word, inside = (lambda b: F.shiftright(b, 6).cast("int")), (lambda b: b.bitwiseAND(F.lit(63)).cast("int"))
    some = df.select(bit(F.col(column)).alias("b")).groupBy(word(F.col("b")).alias("id")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), inside(F.col("b")))).alias("bits"))
    every = df.sparkSession.range(words).join(some, "id", "left").select(F.struct("id", F.coalesce("bits", F.lit(0)).alias("bits")).alias("x"))
    # As a table it is read once for each plan, by a subquery, and is no literal of it.
    table = written(every.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["bits"]).alias("bits")))

    def test(value: Column) -> Column:
        b = bit(value)
        return F.call_function("shiftright", F.get(table.scalar(), word(b)), inside(b)).bitwiseAND(F.lit(1)) == 1

    return test


@dataclass(frozen=True)
class Part:
    """Where the triples of a predicate come from whose subjects and objects are nodes of one shape each.

    A node has one shape only; ``constant`` is the object if all have the same, ``of_class`` a class that every subject is
    known to have. ``source`` is for whoever makes the rows. ``rows`` names the rows of a table that each give one triple at
    most, with the two ``ends``; ``one_subject``: an object has one subject only, ``one_object``: a subject has one object only.
    """

    predicate: str
    subject: str
    object: str
    o_kind: str
    source: object
    constant: str | None = None
    of_class: str | None = None
    rows: str | None = None
    ends: tuple | None = None
    one_subject: bool = False
    one_object: bool = False


class Graph:
    """Views of a triple table by predicate, and the closures that questions share, each worked out once.

    A graph is a table (s, p, o, o_kind), or parts and a function that makes the triples of some of them as a set. Of the
    latter nothing is stored, and a question reads only the parts that it names.
    """

    def __init__(self, triples: DataFrame | None = None, spark: SparkSession | None = None, parts: list[Part] = (), make: Callable[..., DataFrame] | None = None, along: Callable[..., DataFrame] | None = None):
        self._table = None if triples is None else triples.select("s", "p", "o", "o_kind")
        self.spark = triples.sparkSession if triples is not None else spark
        self._parts, self._make, self._along = list(parts), make, along
        self._above: dict[str, DataFrame] = {}
        self._few_labels: bool | None = None

    @property
    def triples(self) -> DataFrame:
        """All triples."""
        return self._table if self._table is not None else self._make(self._parts, True, "s")

    def facts(self, *predicates: str, to: list[str] | None = None, after: tuple[str, ...] = (), of: tuple[str, ...] = (), by: str | None = "s", only: Callable[[Column], Column] | None = None) -> DataFrame:
        """The triples of the predicates, with an object in ``to`` if that is given; ``by``: the column that they are joined on next, None if
        on none: then they lie where they were made. Those of parts are a set in any case.

        Others may be left out where no subject can be an object of a predicate in ``after``, or a subject of one in ``of``, or
        where the subject fails the test ``only``.
        """
        if self._table is not None:
            found = self._table.filter(F.col("p").isin(*predicates))
        else:
            shapes = {x.object for x in self._parts if x.predicate in after} | {x.subject for x in self._parts if x.predicate in of}
            chosen = [x for x in self._parts if x.predicate in predicates and (not (after or of) or x.subject in shapes) and (to is None or x.constant is None or x.constant in to)]
            found = self._make(chosen, False, by, only, to)
        return found if to is None else narrowed(found, "o", to)

    def kept(self, found: DataFrame) -> DataFrame:
        """``found`` as a table if the graph is made of parts, for ``only``."""
        return found if self._table is not None else written(found)

    def only(self, found: DataFrame, column: str) -> Callable[[Column], Column] | None:
        """A test that the values of a column of a table pass, for ``facts``; None if there is no use for one."""
        return None if self._table is not None else sieve(found.select(column), column)

    @property
    def once(self) -> bool:
        """Whether no triple comes twice."""
        return self._table is None

    def pairs(self, *predicates: str, names: tuple[str, str] = ("s", "o"), **where) -> DataFrame:
        return self.facts(*predicates, **where).select("s", "o").toDF(*names)

    def _chains(self, steps: list[tuple[int, tuple[str, ...]]], of: tuple[str, ...] = ()) -> list[list[Part]] | None:
        """The parts that follow each other on paths; None if not every path comes from one row of a table.

        Of a row come all paths through its nodes if no other row has another object for the next step's subject, or if no
        other row has a subject of its own anywhere before.
        """
        shapes = {x.subject for x in self._parts if x.predicate in of}
        chains = [[x] for x in self._parts if x.predicate in steps[0][1] and (not of or x.subject in shapes)]
        for start, predicates in steps[1:]:
            chains = [[*c, y] for c in chains for y in self._parts if y.predicate in predicates and y.subject == (c[start - 1].object if start else c[0].subject)]
        straight = [i == start for i, (start, _) in enumerate(steps)]
        for c in chains:
            for i, y in enumerate(c):
                if y.rows is None or y.rows != c[0].rows or i and not (y.one_object or all(straight[: i + 1]) and all(x.one_subject for x in c[:i])):
                    return None
        return chains

    def paths(self, *steps: tuple[int, tuple[str, ...]], names: tuple[str | None, ...], p: str | None = None, of: tuple[str, ...] = (), by: str, only: Callable[[Column], Column] | None = None) -> DataFrame:
        """One row for each way along the steps: the nodes by ``names`` (None: left out) and the first step's predicate as ``p``.

        A step is the number of the node that it starts from (0: the first) and its predicates. ``of``, and ``only`` for the first node: as in
        ``facts``; ``by``: the column that the rows are joined on next. Paths through rows of one table are read off them without joins.
        """
        chains = self._chains(list(steps), of) if self._table is None and self._along else None
        kept = [n for n in names if n] + ([p] if p else [])
        if chains is not None:
            told = []
            for c in chains:
                # A node is told by another one that is kept if it is that one's only object or subject.
                sure = [bool(n) or i > 0 and c[i - 1].one_object and bool(names[steps[i - 1][0]]) and (len(steps[i - 1][1]) == 1 or i == 1 and bool(p))
                        or any(start == i and x.one_subject and names[j + 1] for j, ((start, _), x) in enumerate(zip(steps, c, strict=True))) for i, n in enumerate(names)]
                told.append(sure)
            wanted = [n or f"_{i}" for i, n in enumerate(names)]
            columns = [[i, wanted[i]] for i in range(len(names)) if names[i] or not all(t[i] for t in told)] + ([["p", p]] if p else [])
            return self._along(chains, [start for start, _ in steps], columns, by, only).select(*kept)
        found = None
        for i, (start, predicates) in enumerate(steps):
            ends = (f"_{start}", f"_{i + 1}")
            step = self.facts(*predicates, after=steps[start - 1][1] if start else (), of=() if i else of, only=None if i else only).select(F.col("s").alias(ends[0]), F.col("o").alias(ends[1]), *([F.col("p").alias("_p")] if not i else []))
            found = step if found is None else found.join(step, ends[0])
        renamed = [F.col(f"_{i}").alias(n) for i, n in enumerate(names) if n]
        return found.select(*renamed, *([F.col("_p").alias(p)] if p else []))

    def traced(self, of: tuple[str, ...] = ()) -> DataFrame | None:
        """All (start, record, source): who the records are attributed to that starts derive from, over any number of steps; None if
        the paths do not come from rows of one table each."""
        if self._table is not None or not self._along:
            return None
        depth, derived, attributed = 1, ("prov:wasDerivedFrom",), ("prov:wasAttributedTo",)
        frames = []
        while self._chains([(i, derived) for i in range(depth)], of) != []:
            steps = [*((i, derived) for i in range(depth)), (depth, attributed)]
            chains = self._chains(steps, of)
            if chains is None or depth > len(self._parts):
                return None
            if chains:
                frames.append(self.paths(*steps, names=("start", *[None] * (depth - 1), "record", "source"), of=of, by="start"))
            depth += 1
        if not frames:
            return None
        return frames[0] if len(frames) == 1 else reduce(DataFrame.unionByName, frames).distinct()

    def ends(self, predicate: str) -> set[str] | None:
        """Shapes of the subjects and objects of a predicate; None if they are not known."""
        return None if self._table is not None else {shape for x in self._parts if x.predicate == predicate for shape in (x.subject, x.object)} or None

    def known(self, predicate: str, cls: str) -> bool:
        """Whether all subjects of a predicate are known to have a class."""
        return self._table is None and all(x.of_class == cls for x in self._parts if x.predicate == predicate)

    def typed(self, *classes: str, name: str = "s", only: Callable[[Column], Column] | None = None) -> DataFrame:
        """Nodes of the classes or of any below them; ``only``: as in ``facts``."""
        below = self.above("rdfs:subClassOf").filter(F.col("ancestor").isin(*classes)).select("descendant").distinct().limit(FEW + 1).collect()
        if len(below) <= FEW:
            return self.pairs("rdf:type", to=sorted({*classes, *(r[0] for r in below)}), only=only).select(F.col("s").alias(name)).distinct()
        wanted = self.within("rdfs:subClassOf", *classes, name="o")
        return self.pairs("rdf:type", only=only).join(wanted, "o", "left_semi").select(F.col("s").alias(name)).distinct()

    def implies(self, cls: str, other: str) -> bool:
        """Whether all nodes of a class are known to be of another one."""
        return cls == other or not self.above("rdfs:subClassOf").filter((F.col("descendant") == cls) & (F.col("ancestor") == other)).isEmpty()

    def above(self, predicate: str) -> DataFrame:
        """Path ``+`` of a predicate between few nodes: descendant, ancestor."""
        if predicate not in self._above:
            self._above[predicate] = written(path_closure(self.pairs(predicate), "s", "o").select("descendant", "ancestor"))
        return self._above[predicate]

    def within(self, predicate: str, *tops: str, name: str) -> DataFrame:
        """Nodes that a path ``*`` leads from to one of ``tops``."""
        below = self.above(predicate).filter(F.col("ancestor").isin(*tops)).select(F.col("descendant").alias(name))
        return below.unionByName(literal_rows(self.spark, tops, name)).distinct()

    def lifted(self, predicate: str, df: DataFrame, column: str, name: str) -> DataFrame:
        """``df`` with each ancestor (path ``*``) of a column."""
        ups = self.above(predicate).groupBy(F.col("descendant").alias("_d")).agg(F.collect_set("ancestor").alias("_ups"))
        own = F.array(F.col(column))
        every = F.array_distinct(F.concat(own, F.coalesce("_ups", F.array().cast("array<string>"))))
        return df.join(ups, df[column] == F.col("_d"), "left").withColumn(name, F.explode(every)).drop("_d", "_ups").filter(F.col(name).isNotNull())

    def literals(self, *classes: str) -> DataFrame:
        """Literals whatever their property, as the top data property has them: s, p, o; all, or at least those of nodes of the classes."""
        found = self.kinds("literal", shapes=self._shapes(classes) if classes else None)
        return found.select("s", "p", "o")

    def _shapes(self, classes: tuple[str, ...]) -> set[str] | None:
        """Shapes of the nodes that can have one of the classes or one below; None if any can."""
        if self._table is not None:
            return None
        below = {*classes, *(r[0] for r in self.above("rdfs:subClassOf").filter(F.col("ancestor").isin(*classes)).select("descendant").distinct().collect())}
        return {x.subject for x in self._parts if x.predicate == "rdf:type" and (x.constant is None or x.constant in below)}

    def kinds(self, *kinds: str, shapes: set[str] | None = None, but: tuple[str, ...] = (), subjects: DataFrame | None = None) -> DataFrame:
        """The triples with objects of these kinds, but of some predicates, and of subjects in a frame's only column if that is given.

        Others than of subjects of the shapes may be left out.
        """
        wanted = None if subjects is None else listed(subjects)
        if self._table is not None:
            found = self._table.filter(F.col("o_kind").isin(*kinds) & ~F.col("p").isin(*but))
        else:
            chosen = [x for x in self._parts if x.o_kind in kinds and x.predicate not in but and (shapes is None or x.subject in shapes)]
            found = self._make(chosen, True, "s", (lambda s: s.isin(*wanted) if wanted else F.lit(False)) if isinstance(wanted, list) else None)
        return found if wanted is None else narrowed(found, "s", wanted)

    def optional(self, df: DataFrame, column: str, fields: dict[str, str], after: tuple[str, ...] = (), of: tuple[str, ...] = (), only: Callable[[Column], Column] | None = None) -> DataFrame:
        """``df`` with a column for each field (name: predicate) of a node; null where it has none, repeated where it has several.

        ``after``, ``of`` and ``only``: as in ``facts``.
        """
        for name, predicate in fields.items():
            df = df.join(self.pairs(predicate, names=(f"_{name}", name), after=after, of=of, only=only), F.col(column) == F.col(f"_{name}"), "left").drop(f"_{name}")
        return df

    def gathered(self, df: DataFrame, column: str, fields: dict[str, str], only: Callable[[Column], Column] | None = None) -> DataFrame:
        """As ``optional``; where triples are made, those of all fields are made and moved together."""
        if not self.once or len(fields) < 2:
            return self.optional(df, column, fields, only=only)
        sets = [F.collect_set(F.when(F.col("p") == p, F.col("o"))).alias(f"_{name}") for name, p in fields.items()]
        said = self.facts(*fields.values(), only=only).groupBy(F.col("s").alias("_s")).agg(*sets)
        df = df.join(said, F.col(column) == F.col("_s"), "left").drop("_s")
        for name in fields:
            df = df.withColumn(name, F.explode_outer(f"_{name}")).drop(f"_{name}")
        return df

    def labelled(self, df: DataFrame, column: str, name: str) -> DataFrame:
        labels = self.pairs(*LABELS).groupBy("s").agg(F.min("o").alias(name)).withColumnRenamed("s", "_l")
        if self.once:
            if self._few_labels is None:
                self._few_labels = labels.limit(FEW + 1).count() <= FEW
            # Then the rows need not be moved to them.
            labels = F.broadcast(labels) if self._few_labels else labels
        return df.join(labels, F.col(column) == F.col("_l"), "left").drop("_l")


def event_scope(graph: Graph, root: str) -> DataFrame:
    """An event and its related incidents, with their names."""
    own = literal_rows(graph.spark, [root], "event")
    related = graph.pairs(":hasRelatedIncident", names=("a", "event")).filter(F.col("a") == root).select("event")
    scope = written(own.unionByName(related).distinct())
    names = narrowed(graph.pairs(":eventName", names=("_e", "event_name")), "_e", scope)
    return scope.join(names, F.col("event") == F.col("_e"), "left").drop("_e")


def event_impacts(graph: Graph, root: str, impact_class: str) -> DataFrame:
    """What an event and its incidents caused: event, property, impact, location, and each value of the impact with its unit."""
    scope = event_scope(graph, root)
    links = graph.kinds("iri", shapes=graph.ends(":hasRelatedIncident"), but=(":hasRelatedIncident",)).select(F.col("s").alias("event"), F.col("p").alias("property"), F.col("o").alias("impact"))
    linked = written(scope.join(narrowed(links, "event", scope.select("event")), "event"))
    nodes = linked.select("impact")
    found = linked.join(narrowed(graph.typed(impact_class, name="impact"), "impact", nodes), "impact")
    places = narrowed(graph.pairs(":hasLocation", names=("_n", "location")), "_n", nodes)
    found = graph.labelled(found.join(places, F.col("impact") == F.col("_n"), "left").drop("_n"), "location", "location_label")
    said = written(narrowed(graph.triples.filter(~F.col("p").isin("rdf:type", ":hasLocation")), "s", nodes))
    plain = said.filter("o_kind <> 'blank'").select(F.col("s").alias("impact"), F.col("p").alias("predicate"), F.col("o").alias("value"), F.lit(None).cast("string").alias("unit"))
    blank = said.filter("o_kind = 'blank'").select(F.col("s").alias("impact"), F.col("p").alias("predicate"), F.col("o").alias("m"))
    numbers, units = (narrowed(graph.pairs(p, names=(m, v)), m, blank.select("m")) for p, m, v in (("qudt:numericValue", "m", "value"), ("qudt:unit", "_m", "unit")))
    measured = blank.join(numbers, "m").join(units, F.col("m") == F.col("_m"), "left").select("impact", "predicate", "value", "unit")
    return found.join(plain.unionByName(measured), "impact", "left").distinct()


def event_organisations(graph: Graph, root: str, base: str = "https://example.org/org/") -> DataFrame:
    """Organisations that an event, an incident of it or one of their records names: organisation, label, property, holder, event."""
    scope = event_scope(graph, root).select("event")
    # An event and its incidents are subjects or objects of one predicate, so their shapes are known.
    links = graph.kinds("iri", "blank", shapes=graph.ends(":hasRelatedIncident"), subjects=scope).select(F.col("s").alias("event"), F.col("o").alias("holder"))
    holders = written(scope.join(links, "event").unionByName(scope.select("event", F.col("event").alias("holder"))).distinct())
    named = graph.kinds("iri", but=("prov:wasAttributedTo",), subjects=holders.select("holder")).select(F.col("s").alias("holder"), F.col("p").alias("property"), F.col("o").alias("organisation"))
    known = graph.pairs("rdf:type", to=[":Organization", "prov:Agent"]).select(F.col("s").alias("organisation"), F.lit(True).alias("known")).distinct()
    found = holders.join(named, "holder").join(known, "organisation", "left").filter(F.col("organisation").startswith(base) | F.coalesce("known", F.lit(False)))
    return graph.labelled(found, "organisation", "label").select("organisation", "label", "property", "holder", "event").distinct()


def sources_of(graph: Graph, starts: DataFrame, of: tuple[str, ...] = ()) -> DataFrame:
    """Who the records are attributed to that the starts (one column) derive from, over any number of steps: start, record, source.

    ``of``: predicates of which one has all starts as subjects.
    """
    traced = graph.traced(of)
    if traced is not None:
        return narrowed(traced, "start", starts)
    records = reached(graph.pairs("prov:wasDerivedFrom"), starts, "s", "o")
    return records.withColumnRenamed("node", "record").join(graph.pairs("prov:wasAttributedTo", names=("record", "source")), "record").select("start", "record", "source")


def event_sources(graph: Graph, root: str) -> DataFrame:
    """Where an event's and its incidents' data come from: source, label, record, event."""
    scope = event_scope(graph, root).select("event")
    derived = sources_of(graph, scope).select(F.col("start").alias("event"), "record", "source")
    direct = narrowed(graph.pairs("prov:wasAttributedTo", names=("event", "source")), "event", scope).select("event", F.col("event").alias("record"), "source")
    return graph.labelled(scope.join(derived.unionByName(direct), "event"), "source", "label").select("source", "label", "record", "event").distinct()


def event_details(graph: Graph, root: str) -> DataFrame:
    """Everything on an event's page as tagged rows: kind, resource, label, start, end. Raises LookupError for an unknown event."""
    dates = {"start": ":startDate", "end": ":endDate"}

    def described(df: DataFrame, column: str) -> DataFrame:
        nodes = df.select(column)
        for name, predicate in {"label": ":eventName", **dates}.items():
            df = df.join(narrowed(graph.pairs(predicate, names=(f"_{name}", name)), f"_{name}", nodes), F.col(column) == F.col(f"_{name}"), "left").drop(f"_{name}")
        return df

    core = written(described(graph.pairs("rdf:type", names=("event", "class")).filter(F.col("event") == root), "event"))
    if core.isEmpty():
        raise LookupError(root)
    linked = lambda *p: graph.pairs(*p, names=("event", "resource")).filter(F.col("event") == root).select("resource")
    cut = lambda df: df.withColumns({c: F.substring_index(c, "T", 1) for c in dates})
    branches = [cut(core.select(F.lit("core").alias("kind"), F.col("event").alias("resource"), "label", "start", "end"))]
    for kind, found in {
        "location": linked(":hasLocation"), "disasterType": linked(":hasDisasterType", ":hasDisasterSubtype"), "source": event_sources(graph, root).filter(F.col("event") == root).select(F.col("source").alias("resource")),
    }.items():
        branches.append(graph.labelled(found.distinct(), "resource", "label").select(F.lit(kind).alias("kind"), "resource", "label"))
    both = linked("prov:alternateOf").unionByName(graph.pairs("prov:alternateOf", names=("resource", "event")).filter(F.col("event") == root).select("resource"))
    for kind, found in {"incident": linked(":hasRelatedIncident"), "majorEvent": linked(":isRelatedTo"), "alternate": both}.items():
        branches.append(cut(described(written(found.distinct()), "resource").select(F.lit(kind).alias("kind"), "resource", "label", *dates)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), branches).distinct()


# --- the ontology and the places ---


def ontology_classes(graph: Graph, namespace: str) -> DataFrame:
    classes = graph.pairs("rdf:type", to=["owl:Class"]).filter(F.col("s").startswith(namespace)).select(F.col("s").alias("class"))
    return graph.labelled(classes, "class", "label")


def ontology_links(graph: Graph, namespace: str) -> DataFrame:
    """Subclass links between named classes, and object properties from domain to range: source, target, property."""
    inside = lambda c: F.col(c).startswith(namespace)
    subclass = graph.pairs("rdfs:subClassOf", names=("source", "target")).filter(inside("source") & inside("target") & (F.col("source") != F.col("target"))).withColumn("property", F.lit("subClassOf"))
    spans = graph.pairs("rdfs:domain", names=("property", "source")).join(graph.pairs("rdfs:range", names=("property", "target")), "property").filter(inside("source") & inside("target"))
    wider = graph.above("rdfs:subPropertyOf").toDF("narrow", "property").join(graph.pairs("rdfs:domain", names=("narrow", "source")), "narrow").select("property", "source")
    return subclass.unionByName(spans.join(wider, ["property", "source"], "left_anti").select("source", "target", "property")).distinct()


def leaves(graph: Graph, kind: str, of: str, below: str) -> DataFrame:
    """Nodes with a ``kind`` link to ``of`` that no other node is ``below``."""
    nodes = graph.pairs(kind, to=[of]).select(F.col("s").alias("node")).distinct()
    return nodes.join(graph.pairs(below, names=("lower", "node")).select("node"), "node", "left_anti")


def taxonomy(graph: Graph, types: DataFrame) -> DataFrame:
    """Each type (id) with its label and its broader type, null at the top; the rows that ``tree`` nests."""
    named = graph.labelled(types.distinct(), "id", "label")
    return graph.optional(named, "id", {"parent": "skos:broader"}).select("id", "label", "parent")


def places_of_level(graph: Graph, level: str) -> DataFrame:
    """Places of a class with label, the place they are part of, and its label."""
    found = graph.optional(graph.typed(level, name="place"), "place", {"parent": ":isPartOf"})
    return graph.labelled(graph.labelled(found, "place", "label"), "parent", "parent_label")


def cities(graph: Graph) -> DataFrame:
    """Cities and municipalities with their parent and their region."""
    own = places_of_level(graph, ":City").withColumn("level", F.lit("City")).unionByName(places_of_level(graph, ":Municipality").withColumn("level", F.lit("Municipality")))
    regions = graph.typed(":Region", name="region")
    placed = graph.lifted(":isPartOf", own, "place", "region").join(regions, "region")
    return graph.labelled(graph.optional(placed, "place", {"income_class": ":incomeClassification", "population": ":population"}), "region", "region_label")


def tree(rows: list[tuple[str, str, str | None]]) -> list[dict]:
    """Nested nodes of (id, label, parent) rows of a small tree, sorted by label; a node with an unknown parent is a root."""
    nodes = {i: {"id": i, "label": label, "children": []} for i, label, _ in rows}
    tops = []
    for i, _, parent in sorted(rows, key=lambda r: ((r[1] or r[0]).casefold(), r[0])):
        (nodes[parent]["children"] if parent in nodes and parent != i else tops).append(nodes[i])
    return tops
