"""Batch entry points: ``python -m tidemark COMMAND ...``. Paths may lie in any store that Spark reads.

tables  CSV tables of a report as typed Parquet tables, and their triples
turtle  Turtle files into a named graph
align   candidate pairs, clusters and alignment triples of events, on top of an earlier registry if there is one
clear   one named graph, or all, removed
ask     a SPARQL query over named graphs, as JSON lines
"""

from __future__ import annotations

import argparse
import json
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.operators import resolve
from tidemark.plans.sparql import answer
from tidemark.session import durable
from tidemark.sources import readers, reports, sinks, turtle


def tables(spark: SparkSession, args: argparse.Namespace) -> None:
    spec = reports.TABLES[args.table]
    headers = json.loads(args.headers) if args.headers else {}
    rows = reports.build(readers.read_cells(spark, args.source, strict=False), spec, headers)
    rows.write.mode("overwrite").parquet(f"{args.target}/{spec.name}")
    kept = spark.read.parquet(f"{args.target}/{spec.name}")
    sinks.replace_graphs(reports.rows_to_triples(kept.withColumn("event", F.lit(args.event)), spec, f"{args.event}/{spec.name}"), f"{args.target}/graphs")


def load_turtle(spark: SparkSession, args: argparse.Namespace) -> None:
    sinks.replace_graphs(turtle.read_turtle(spark, args.source, args.graph), f"{args.target}/graphs")


def align(spark: SparkSession, args: argparse.Namespace) -> None:
    """Events: event, source, event_class, type_base, type_id, type_parent, label, codes, start (date)."""
    events = spark.read.parquet(args.source)
    pairs = resolve.blocked_pairs(events)
    registry = spark.read.parquet(args.registry) if args.registry else None
    if registry is not None:
        sides = registry.toDF("canonical", "a").join(registry.toDF("canonical", "b"), "canonical").filter("a < b").select("a", "b")
        pairs = resolve.new_pairs(pairs, sides)
    links = durable(resolve.scored_pairs(pairs, events).filter("is_match").select("a", "b"))
    empty = spark.createDataFrame([], "canonical string, member string")
    resolve.update_registry(empty if registry is None else registry, links).write.mode("overwrite").parquet(f"{args.target}/registry")
    kept = spark.read.parquet(f"{args.target}/registry")
    run = f"https://example.org/alignment-run/{datetime.now(UTC):%Y%m%dT%H%M%S}"
    sinks.replace_graphs(resolve.alignment_triples(kept, run, datetime.now(UTC).isoformat(), "alignment"), f"{args.target}/graphs")


def clear(spark: SparkSession, args: argparse.Namespace) -> None:
    sinks.clear_graph(spark, f"{args.target}/graphs", args.graph)


def ask(spark: SparkSession, args: argparse.Namespace) -> None:
    found = answer(spark.read.parquet(f"{args.target}/graphs"), args.query, args.most)
    for row in found if isinstance(found, list) else [{"error": found}]:
        print(json.dumps(row, ensure_ascii=False, default=str))


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tidemark", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, run, options in (
        ("tables", tables, ["source", "target", "table", "event"]), ("turtle", load_turtle, ["source", "target", "graph"]), ("align", align, ["source", "target"]), ("clear", clear, ["target"]), ("ask", ask, ["target", "query"]),
    ):
        command = commands.add_parser(name)
        command.set_defaults(run=run)
        for option in options:
            command.add_argument(f"--{option}", required=True)
    commands.choices["tables"].add_argument("--headers", help="JSON object of headers and the names of the table's columns")
    commands.choices["align"].add_argument("--registry", help="the registry of an earlier run")
    commands.choices["clear"].add_argument("--graph")
    commands.choices["ask"].add_argument("--most", type=int, default=50)
    return parser


def main(words: list[str] | None = None) -> None:
    args = arguments().parse_args(words)
    args.run(SparkSession.builder.appName(f"tidemark {args.command}").getOrCreate(), args)


if __name__ == "__main__":
    main()
