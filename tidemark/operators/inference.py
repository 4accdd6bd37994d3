"""OWL-lite materialisation over a triple table (s, p, o): hierarchies, inverses, equivalences, chains, transitivity."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.hierarchy import path_closure
from tidemark.session import durable, written

TYPE = "rdf:type"


@dataclass
class Axioms:
    """A small, constant ontology."""

    subclass: list[tuple[str, str]] = field(default_factory=list)  # class, wider class
    subproperty: list[tuple[str, str]] = field(default_factory=list)
    equivalent: list[tuple[str, str]] = field(default_factory=list)  # properties or classes
    inverse: list[tuple[str, str]] = field(default_factory=list)
    transitive: list[str] = field(default_factory=list)
    chains: list[tuple[str, str, str]] = field(default_factory=list)  # first, second, implied
    domain: list[tuple[str, str]] = field(default_factory=list)  # property, class of its subjects
    range: list[tuple[str, str]] = field(default_factory=list)  # property, class of its objects, which must be nodes


def _above(pairs: list[tuple[str, str]]) -> dict[str, list[str]]:
    """Everything that each name leads to, over any number of steps."""
    out: dict[str, set[str]] = {}
    for name in {a for a, _ in pairs}:
        seen, todo = set(), {name}
        while todo:
            todo = {b for a, b in pairs if a in todo} - seen
            seen |= todo
        out[name] = seen - {name}
    return {k: sorted(v) for k, v in out.items() if v}


def _lookup(table: dict[str, list[str]], column: str):
    if not table:
        return F.array().cast("array<string>")
    known = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.try_element_at(known, F.col(column)), F.array().cast("array<string>"))


def materialise(triples: DataFrame, axioms: Axioms, regime: str = "owl_lite", most_rounds: int = 20) -> DataFrame:
    """s, p, o and inferred (boolean): the asserted triples and what the regime (none, rdfs, owl_lite) adds, as a set.

    Axioms are constants of the plan; every round adds what single steps give and stops when nothing is new.
    """
    facts = triples.select("s", "p", "o").na.drop().distinct()
    if regime == "none":
        return facts.withColumn("inferred", F.lit(False))
    if regime not in ("rdfs", "owl_lite"):
        raise ValueError("regime must be none, rdfs or owl_lite")
    owl = regime == "owl_lite"
    both = axioms.equivalent + [(b, a) for a, b in axioms.equivalent] if owl else []
    classes, properties = _above(axioms.subclass + both), _above(axioms.subproperty + both)
    grouped = lambda pairs: {p: sorted(c for q, c in pairs if q == p) for p, _ in pairs}
    domains, ranges = grouped(axioms.domain), grouped(axioms.range)
    inverse = dict(axioms.inverse + [(b, a) for a, b in axioms.inverse]) if owl else {}
    facts = known = written(facts)
    for _ in range(most_rounds):
        wider = known.filter(F.col("p") == TYPE).select("s", "p", F.explode(_lookup(classes, "o")).alias("o"))
        added = wider.unionByName(known.select("s", F.explode(_lookup(properties, "p")).alias("p"), "o"))
        for end, table in (("s", domains), ("o", ranges)):
            if table:
                added = added.unionByName(known.filter(F.col("p").isin(*table)).select(F.col(end).alias("s"), F.lit(TYPE).alias("p"), F.explode(_lookup(table, "p")).alias("o")))
        if inverse:
            turned = known.filter(F.col("p").isin(*inverse))
            added = added.unionByName(turned.select(F.col("o").alias("s"), _lookup({k: [v] for k, v in inverse.items()}, "p")[0].alias("p"), F.col("s").alias("o")))
        for first, second, implied in axioms.chains if owl else []:
            x, y = known.filter(F.col("p") == first).select("s", F.col("o").alias("m")), known.filter(F.col("p") == second).select(F.col("s").alias("m"), "o")
            added = added.unionByName(x.join(y, "m").select("s", F.lit(implied).alias("p"), "o"))
        for p in axioms.transitive if owl else []:
            added = added.unionByName(path_closure(known.filter(F.col("p") == p), "s", "o").select(F.col("descendant").alias("s"), F.lit(p).alias("p"), F.col("ancestor").alias("o")))
        fresh = durable(added.distinct().join(known, ["s", "p", "o"], "left_anti"))
        if fresh.isEmpty():
            break
        known = durable(known.unionByName(fresh))
    else:
        raise RuntimeError("inference did not settle")
    asserted = facts.withColumn("asserted", F.lit(True))
    return known.join(asserted, ["s", "p", "o"], "left").select("s", "p", "o", F.col("asserted").isNull().alias("inferred"))
