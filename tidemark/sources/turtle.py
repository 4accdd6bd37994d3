"""Turtle files as triples: prefixes, lists of predicates and objects, blank nodes, collections, typed literals.

Each file is one value and is parsed by one task; ontologies and batches are small. The result is the triple table that
``read_ntriples`` gives.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.model import TRIPLES

RDF, XSD = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2001/XMLSchema#"
_TOKEN = re.compile(r"""
    (?P<space>\s+|\#[^\n]*) | (?P<iri><[^<>"{}|^`\\\x00-\x20]*>) | (?P<long>\"{3}(?:[^"\\]|\\.|"(?!""))*\"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*'{3})
    | (?P<text>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*') | (?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*) | (?P<type>\^\^)
    | (?P<number>[+-]?(?:\d+\.\d*|\.?\d+)(?:[eE][+-]?\d+)?(?<!\.)) | (?P<blank>_:[\w.-]*[\w-]) | (?P<mark>[;,.\[\]()])
    | (?P<name>(?:[^\W\d_][\w.-]*)?:(?:[\w:%-]|\\.|\.(?=[\w:%\\-]))*|[A-Za-z]+)
""", re.X)  # fmt: skip
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def _unescaped(text: str) -> str:
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) > 1 else _ESCAPES.get(m[1], m[1]), text, flags=re.S)


class _Parser:
    """One document; nodes are (value, kind, datatype, language). Raises ValueError where the text is no Turtle."""

    def __init__(self, text: str, scope: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            token = _TOKEN.match(text, at)
            if token is None:
                raise ValueError(f"no Turtle at {text[at : at + 40]!r}")
            if token.lastgroup != "space":
                self.tokens.append((token.lastgroup, token[0]))
            at = token.end()
        self.at, self.scope, self.count = 0, scope, 0
        self.prefixes: dict[str, str] = {}
        self.base = ""
        self.triples: list[tuple] = []

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, value: str | None = None) -> tuple[str, str]:
        token = self.peek()
        if token[0] == "end" or value is not None and token[1] != value:
            raise ValueError(f"{value or 'something'} expected, not {token[1]!r}")
        self.at += 1
        return token

    def fresh(self) -> tuple:
        self.count += 1
        return (f"_:{self.scope}b{self.count}", "blank", None, None)

    def iri(self, token: tuple[str, str]) -> str:
        kind, value = token
        if kind == "iri":
            value = _unescaped(value[1:-1])
            return value if re.match(r"[A-Za-z][\w+.-]*:", value) else self.base + value
        if kind == "name" and ":" in value:
            prefix, local = value.split(":", 1)
            if prefix not in self.prefixes:
                raise ValueError(f"unknown prefix {prefix!r}")
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        raise ValueError(f"a name expected, not {value!r}")

    def directive(self, word: str) -> None:
        if word.lower().endswith("prefix"):
            name = self.take()[1].rstrip(":")
            self.prefixes[name] = self.iri(self.take())
        else:
            self.base = self.iri(self.take())
        if word.startswith("@"):
            self.take(".")

    def node(self) -> tuple:
        kind, value = self.take()
        if value == "[":
            own = self.fresh()
            if self.peek()[1] != "]":
                self.predicates(own)
            self.take("]")
            return own
        if value == "(":
            items = []
            while self.peek()[1] != ")":
                items.append(self.node())
            self.take(")")
            after = (RDF + "nil", "iri", None, None)
            for item in reversed(items):
                own = self.fresh()
                self.triples += [(own, RDF + "first", item), (own, RDF + "rest", after)]
                after = own
            return after
        if kind in ("text", "long"):
            body = _unescaped(value[3:-3] if kind == "long" else value[1:-1])
            if self.peek()[0] == "at":
                return (body, "literal", None, self.take()[1][1:])
            if self.peek()[0] == "type":
                self.take()
                return (body, "literal", self.iri(self.take()), None)
            return (body, "literal", None, None)
        if kind == "number":
            return (value, "literal", XSD + ("double" if "e" in value.lower() else "decimal" if "." in value else "integer"), None)
        if kind == "name" and value in ("true", "false"):
            return (value, "literal", XSD + "boolean", None)
        if kind == "blank":
            return (f"_:{self.scope}{value[2:]}", "blank", None, None)
        return (self.iri((kind, value)), "iri", None, None)

    def predicates(self, subject: tuple) -> None:
        while True:
            token = self.take()
            predicate = RDF + "type" if token == ("name", "a") else self.iri(token)
            while True:
                self.triples.append((subject, predicate, self.node()))
                if self.peek()[1] != ",":
                    break
                self.take()
            while self.peek()[1] == ";":
                self.take()
                if self.peek()[1] not in (";", ".", "]"):
                    break
            else:
                return
            if self.peek()[1] in (".", "]"):
                return

    def parse(self) -> list[tuple]:
        while self.peek()[0] != "end":
            kind, value = self.peek()
            if value.lower() in ("@prefix", "@base", "prefix", "base"):
                self.take()
                self.directive(value)
                continue
            open_bracket = value == "["
            subject = self.node()
            if not (open_bracket and self.peek()[1] == "."):
                self.predicates(subject)
            self.take(".")
        return self.triples


def parse_turtle(text: str, scope: str = "") -> list[tuple[str, str, str, str, str | None, str | None]]:
    """s, p, o, kind of o, its datatype and its language, for each triple of a document; ``scope`` keeps blank nodes apart."""
    return [(s[0], p, o[0], o[1], o[2], o[3]) for s, p, o in _Parser(text, scope).parse()]


def turtle_triples(files: DataFrame, graph: str) -> DataFrame:
    """The triples of documents (path, text); blank nodes of different paths are different."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in TRIPLES.split(", ")]
        for batch in batches:
            for scope, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                columns = list(zip(*[(graph, *t) for t in parse_turtle(text or "", f"{scope}.")], strict=True)) or [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=names)

    return files.select(F.substring(F.sha1("path"), 1, 12), F.col("text").cast("string")).mapInArrow(run, TRIPLES)


def read_turtle(spark: SparkSession, path: str, graph: str) -> DataFrame:
    """Turtle files as the triple table."""
    return turtle_triples(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")), graph)
