"""A read-only SPARQL front end (SELECT, ASK, CONSTRUCT, DESCRIBE) that compiles queries to DataFrame plans over a triple table.

Supported: PREFIX, SELECT [DISTINCT] with expressions, basic graph patterns with ``;`` ``,`` and ``[ ]``, property paths
(``/ | ^ + *`` and groups), VALUES, OPTIONAL, UNION, MINUS, GRAPH, BIND, FILTER with EXISTS and NOT EXISTS, sub-SELECT, GROUP BY,
HAVING, aggregates, ORDER BY, LIMIT, OFFSET, ASK. A variable is a text column (unbound: null) with a companion column of its
kind with its language or datatype, if the table has them. Without GRAPH all named graphs are one. Numbers compare as numbers when both sides are numbers, else texts compare as texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.hierarchy import path_closure

# Words that a read-only query must not contain.
WRITES = ("insert", "delete", "load", "clear", "create", "drop", "copy", "move")
_TOKEN = re.compile(
    r"""\s+|\#[^\n]*|(?P<iri><[^<>\s]*>)|(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')(?P<tail>@[A-Za-z-]+|\^\^(?:<[^>]*>|[\w-]*:[\w.-]*))?|(?P<var>[?$]\w+)
    |(?P<number>[+-]?\d+(?:\.\d+)?)|(?P<name>[A-Za-z_][\w-]*:[\w.%-]*(?<!\.)|:[\w.%-]*(?<!\.)|_:\w+)|(?P<word>[A-Za-z_]\w*)|(?P<op>&&|\|\||!=|<=|>=|\^\^|[{}()\[\].;,=<>!+*/|^-])""",
    re.X,
)


def guard(text: str) -> None:
    """Raises ValueError if the text has a word of an update anywhere."""
    if found := [w for w in WRITES if re.search(rf"\b{w}\b", text, re.I)]:
        raise ValueError(f"only read-only queries are allowed: {found}")


@dataclass
class Solution:
    """Rows of bindings; ``sure`` are the variables that every row binds."""

    df: DataFrame
    names: list[str]
    sure: set[str]


KIND = "k__"
#: Columns of a graph that CONSTRUCT and DESCRIBE give.
GRAPH = ["s", "p", "o", "o_kind", "o_dt", "o_lang"]


class Literal(str):
    """The text of a literal, with what stands behind its quotes."""

    tail = ""


class Compiler:
    def __init__(self, triples: DataFrame, text: str):
        guard(text)
        optional = lambda c: F.col(c) if c in triples.columns else F.lit(None).cast("string")
        tagged = F.concat("o_kind", F.coalesce(F.concat(F.lit("@"), optional("o_lang")), F.concat(F.lit("^^"), optional("o_dt")), F.lit("")))
        self.named = triples.select(optional("g").alias("g"), "s", "p", "o", tagged.alias("o_kind"))
        self.triples = self.named.select("s", "p", "o", "o_kind").dropDuplicates(["s", "p", "o", "o_kind"])
        self.graph: str | None = None  # the variable of the GRAPH clause that is read
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"cannot read the query at: {text[at : at + 30]!r}")
            at = m.end()
            if m.lastgroup:
                kind = "string" if m["string"] else m.lastgroup
                token = Literal(m["string"]) if m["string"] else m[0]
                if m["tail"]:
                    token.tail = m["tail"]
                self.tokens.append((kind, token))
        self.at, self.prefixes, self.blanks = 0, {}, 0
        self.spark = triples.sparkSession

    # -- tokens --

    def peek(self, n: int = 0) -> str:
        return self.tokens[self.at + n][1] if self.at + n < len(self.tokens) else ""

    def kind(self) -> str:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else ""

    def take(self, expected: str | None = None) -> str:
        token = self.peek()
        if not token or expected is not None and token.upper() != expected:
            raise ValueError(f"expected {expected or 'more'} but found {token!r}")
        self.at += 1
        return token

    def word(self, *words: str) -> bool:
        return self.kind() in ("word", "op") and self.peek().upper() in words

    def skip(self, *words: str) -> bool:
        if self.word(*words):
            self.at += 1
            return True
        return False

    # -- terms --

    def term(self) -> tuple[str, str]:
        """('var', name) or ('term', text) or ('literal', text)."""
        kind, token = self.kind(), self.take()
        if kind == "var":
            return "var", token[1:]
        if kind == "iri":
            return "term", token[1:-1]
        if kind == "name":
            if token.startswith("_:"):
                return "var", f"_blank_{token[2:]}"
            prefix, local = token.split(":", 1)
            return "term", self.prefixes.get(prefix, f"{prefix}:") + local
        if kind == "string":
            text = Literal(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), token[1:-1]))
            if token.tail.startswith("@"):
                text.tail = token.tail
            elif token.tail:
                prefix, _, local = token.tail[2:].partition(":")
                text.tail = "^^" + (token.tail[3:-1] if token.tail[2] == "<" else self.prefixes.get(prefix, f"{prefix}:") + local)
            return "literal", text
        if kind == "number":
            return "literal", token
        if token == "a":
            return "term", self.prefixes.get("rdf", "rdf:") + "type"
        if token.lower() in ("true", "false"):
            return "literal", token.lower()
        raise ValueError(f"not a term: {token!r}")

    # -- queries --

    def query(self) -> DataFrame:
        while self.skip("PREFIX"):
            name = self.take().rstrip(":")
            self.prefixes[name] = self.take()[1:-1]
        if self.skip("ASK"):
            self.skip("WHERE")
            return self.group().df.limit(1).agg((F.count(F.lit(1)) > 0).alias("answer"))
        if self.word("CONSTRUCT", "DESCRIBE"):
            out = self.construct() if self.skip("CONSTRUCT") else self.describe()
            if self.skip("LIMIT"):
                out = out.limit(int(self.take()))
            if self.at < len(self.tokens):
                raise ValueError(f"unexpected {self.peek()!r}")
            tag = lambda mark: F.nullif(F.regexp_extract("o_kind", mark + "(.*)$", 1), F.lit(""))
            return out.distinct().select("s", "p", "o", F.regexp_extract("o_kind", "^[a-z]+", 0).alias("o_kind"), tag(r"^literal\^\^").alias("o_dt"), tag("^literal@").alias("o_lang"))
        out = self.select()
        if self.at < len(self.tokens):
            raise ValueError(f"unexpected {self.peek()!r}")
        return out.df.select(*[F.col(f"`{n}`") for n in out.names])

    def construct(self) -> DataFrame:
        """The triples of a template for each solution; those with an unbound term, or a literal where none may stand, are left out."""
        template: list[tuple] = []
        self.take("{")
        while not self.skip("}"):
            subject = self.term()
            while True:
                predicate = self.term()
                while True:
                    template.append((subject, predicate, self.term()))
                    if not self.skip(","):
                        break
                if not self.skip(";") or self.word(".", "}"):
                    break
            self.skip(".")
        self.skip("WHERE")
        body = self.group()

        def cell(term: tuple[str, str]) -> tuple[Column, Column]:
            kind, value = term
            if kind != "var":
                return F.lit(str(value)), F.lit("iri" if kind == "term" else f"literal{getattr(value, 'tail', '')}")
            if value not in body.names:
                return F.lit(None).cast("string"), F.lit(None).cast("string")
            return F.col(f"`{value}`"), F.col(KIND + value) if KIND + value in body.df.columns else F.lit("literal")

        parts = []
        for subject, predicate, node in template:
            (a, ka), (q, kq), (b, kb) = cell(subject), cell(predicate), cell(node)
            parts.append(body.df.select(a.alias("s"), q.alias("p"), b.cast("string").alias("o"), kb.alias("o_kind"), (~F.startswith(ka, F.lit("literal")) & (kq == "iri")).alias("_fits")))
        rows = reduce(DataFrame.unionByName, parts)
        return rows.filter("_fits AND s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL").select("s", "p", "o", "o_kind")

    def describe(self) -> DataFrame:
        """All triples of the nodes that are named or found."""
        self.take("DESCRIBE")
        nodes, variables = [], []
        while self.kind() in ("iri", "name", "var"):
            kind, value = self.term()
            (variables if kind == "var" else nodes).append(value)
        found = self.spark.range(1).select(F.explode(F.array(*map(F.lit, nodes)).cast("array<string>")).alias("s"))
        if self.word("WHERE", "{"):
            self.skip("WHERE")
            body = self.group()
            for v in variables:
                found = found.unionByName(body.df.select(F.col(f"`{v}`").alias("s")))
        return self.triples.join(found.distinct(), "s", "left_semi").select("s", "p", "o", "o_kind")

    def select(self) -> Solution:
        self.take("SELECT")
        distinct = self.skip("DISTINCT")
        chosen: list[tuple[str, int | None]] = []
        while not self.word("WHERE", "{"):
            if self.skip("*"):
                continue
            if self.skip("("):
                begin, depth = self.at, 0
                while not (depth == 0 and self.word("AS")):
                    depth += {"(": 1, ")": -1}.get(self.peek(), 0)
                    self.at += 1
                self.take("AS")
                chosen.append((self.take()[1:], begin))
                self.take(")")
            else:
                chosen.append((self.take()[1:], None))
        self.skip("WHERE")
        body = self.group()
        keys: list[str] = []
        grouped = self.skip("GROUP")
        if grouped:
            self.take("BY")
            while self.kind() == "var":
                keys.append(self.take()[1:])
        aggregates: list[Column] = []

        def expression_at(begin: int) -> Column:
            end, self.at = self.at, begin
            self.aggregates = aggregates
            out = self.expression(body)
            self.at = end
            return out

        df, names = body.df, body.names
        made = {n: expression_at(b) for n, b in chosen if b is not None}
        having = None
        if self.skip("HAVING"):
            self.aggregates = aggregates
            having = self.expression(body)
        if aggregates or grouped:
            kinds = [KIND + k for k in keys if KIND + k in df.columns]
            cells = [c.alias(f"_agg{i}") for i, c in enumerate(aggregates)] + [F.first(k).alias(k) for k in kinds]
            cells = cells or [F.lit(1).alias("_none")]
            df = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(*cells) if keys else df.agg(*cells)
            names = keys
            if having is not None:
                df = df.filter(having)
        for n, column in made.items():
            df = df.withColumn(n, column.cast("string"))
        picked = [n for n, _ in chosen] or [n for n in names if not n.startswith("_")]
        for n in picked:
            if n not in df.columns:
                df = df.withColumn(n, F.lit(None).cast("string"))
        orders: list[Column] = []
        if self.skip("ORDER"):
            self.take("BY")
            body_now = Solution(df, [c for c in df.columns if not c.startswith(KIND)], set())
            while self.kind() in ("var", "word") and not self.word("LIMIT", "OFFSET") or self.word("("):
                down = self.word("DESC")
                self.skip("DESC", "ASC")
                key = self.primary(body_now)
                number = key.try_cast("double")
                orders += [number.desc_nulls_last(), key.desc_nulls_last()] if down else [number.asc_nulls_first(), key.asc_nulls_first()]
        if orders and not distinct:
            df = df.orderBy(*orders)
        kept = df.select(*[F.col(f"`{n}`") for n in picked], *[F.col(KIND + n) for n in picked if KIND + n in df.columns])
        if distinct:
            kept = kept.dropDuplicates(picked)
            kept = kept.orderBy(*orders) if orders else kept
        while self.word("LIMIT", "OFFSET"):
            word, n = self.take().upper(), int(self.take())
            kept = kept.limit(n) if word == "LIMIT" and not self.word("OFFSET") else kept.offset(n) if word == "OFFSET" and not self.word("LIMIT") else self._both(kept, word, n)
        sure = {n for n in picked if n in body.sure} | set(made)
        return Solution(kept, picked, sure)

    def _both(self, df: DataFrame, word: str, n: int) -> DataFrame:
        other = self.take().upper()
        m = int(self.take())
        limit, offset = (n, m) if word == "LIMIT" else (m, n)
        if other == word:
            raise ValueError(f"two {word} clauses")
        return df.offset(offset).limit(limit)

    # -- patterns --

    def group(self, seed: Solution | None = None) -> Solution:
        self.take("{")
        if self.word("SELECT"):
            inner = self.select()
            self.take("}")
            return self.join(seed, inner) if seed else inner
        current = seed
        filters: list[int] = []
        while not self.word("}"):
            if self.skip("FILTER"):
                filters.append(self.at)
                self._pass_filter()
            elif self.skip("OPTIONAL"):
                current = self.optional(current or self.unit(), self.group())
            elif self.skip("MINUS"):
                current = self.minus(current or self.unit(), self.group())
            elif self.skip("BIND"):
                current = current or self.unit()
                self.take("(")
                column = self.expression(current)
                self.take("AS")
                name = self.take()[1:]
                self.take(")")
                current = Solution(current.df.withColumn(name, column.cast("string")), [*current.names, name], set(current.sure))
            elif self.skip("GRAPH"):
                current = self.in_graph(current)
            elif self.skip("VALUES"):
                current = self.join(current, self.values())
            elif self.word("{"):
                branch = self.group()
                while self.skip("UNION"):
                    branch = self.union(branch, self.group())
                current = self.join(current, branch)
            else:
                current = self.triples_block(current)
            self.skip(".")
        self.take("}")
        current = current or self.unit()
        end = self.at
        for begin in filters:
            self.at = begin
            current = self.filtered(current)
        self.at = end
        return current

    def in_graph(self, current: Solution | None) -> Solution:
        """A group that is read in one named graph, or in each of them with its name as a binding."""
        kind, value = self.term()
        before = self.triples, self.graph
        if kind == "var":
            self.triples, self.graph = self.named.filter("g IS NOT NULL").dropDuplicates(), value
        else:
            self.triples, self.graph = self.named.filter(F.col("g") == value).select("s", "p", "o", "o_kind").dropDuplicates(), None
        inner = self.group()
        self.triples, self.graph = before
        return self.join(current, inner)

    def unit(self) -> Solution:
        return Solution(self.spark.range(1).select(F.lit(1).alias("_unit")), [], set())

    def _pass_filter(self) -> None:
        if self.word("NOT", "EXISTS"):
            self.skip("NOT")
            self.take("EXISTS")
        elif self.kind() == "word":
            self.take()
        depth = 0
        while True:
            token = self.take()
            depth += {"(": 1, "{": 1, ")": -1, "}": -1}.get(token, 0)
            if depth == 0:
                return

    def filtered(self, current: Solution) -> Solution:
        if self.word("NOT", "EXISTS"):
            without = self.skip("NOT")
            self.take("EXISTS")
            held = self.holds(current)
            on = reduce(lambda a, b: a & b, [current.df[n].eqNullSafe(held[f"x_{n}"]) for n in current.names], F.lit(True))
            return Solution(current.df.join(held, on, "left_anti" if without else "left_semi"), current.names, current.sure)
        self.markers: list[DataFrame] = []
        condition = self.primary(current)
        df = current.df
        for i, held in enumerate(self.markers):
            on = reduce(lambda a, b: a & b, [df[n].eqNullSafe(held[f"x_{n}"]) for n in current.names], F.lit(True))
            df = df.join(held.withColumn(f"_held{i}", F.lit(True)), on, "left").drop(*[f"x_{n}" for n in current.names])
        bound = set(current.sure)
        return Solution(df.filter(condition).drop(*[f"_held{i}" for i in range(len(self.markers))]), current.names, bound)

    def holds(self, current: Solution) -> DataFrame:
        """The distinct bindings of ``current`` for which the group that follows has a solution; outer variables are seen inside."""
        own = current.df.select(*[F.col(f"`{n}`") for n in current.names], *[F.col(c) for c in current.df.columns if c.startswith(KIND)]).dropDuplicates(current.names)
        kept = Solution(own.withColumns({f"x_{n}": F.col(f"`{n}`") for n in current.names}), current.names, current.sure)
        inner = self.group(kept)
        return inner.df.select(*[f"x_{n}" for n in current.names]).distinct()

    def values(self) -> Solution:
        names = []
        if self.skip("("):
            while not self.skip(")"):
                names.append(self.take()[1:])
            many = True
        else:
            names, many = [self.take()[1:]], False
        self.take("{")
        rows = []
        while not self.skip("}"):
            cells = []
            if many:
                self.take("(")
            for _ in names:
                cells.append(None if self.skip("UNDEF") else self.term()[1])
            if many:
                self.take(")")
            rows.append(tuple(cells))
        df = self.spark.createDataFrame([tuple(None if c is None else str(c) for c in row) for row in rows], ", ".join(f"`{n}` string" for n in names))
        return Solution(df, names, {n for i, n in enumerate(names) if all(r[i] is not None for r in rows)})

    def triples_block(self, current: Solution | None) -> Solution:
        subject, current = self.node(current)
        if self.word(".", "}"):
            return current
        return self.predicates(subject, current)

    def predicates(self, subject, current: Solution | None) -> Solution:
        while True:
            if self.kind() == "var":
                path = ("var", self.take()[1:])
            else:
                path = self.path()
            while True:
                node, current = self.node(current)
                current = self.join(current, self.pattern(subject, path, node))
                if not self.skip(","):
                    break
            if not self.skip(";"):
                return current
            if self.word(".", "}", "]"):
                return current

    def node(self, current: Solution | None):
        if self.skip("["):
            self.blanks += 1
            blank = ("var", f"_anon_{self.blanks}")
            if not self.skip("]"):
                current = self.predicates(blank, current)
                self.take("]")
            return blank, current
        return self.term(), current

    def path(self):
        parts = [self.path_sequence()]
        while self.skip("|"):
            parts.append(self.path_sequence())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def path_sequence(self):
        parts = [self.path_step()]
        while self.skip("/"):
            parts.append(self.path_step())
        return parts[0] if len(parts) == 1 else ("then", parts)

    def path_step(self):
        if self.skip("^"):
            return "inverse", self.path_step()
        if self.skip("("):
            inner = self.path()
            self.take(")")
        else:
            inner = ("one", self.term()[1])
        while self.word("*", "+"):
            inner = ("closure" + self.take(), inner)
        return inner

    def pairs(self, path) -> DataFrame:
        """Columns a, b and the kind of b for a path; alternatives and sequences keep repeated pairs, closures do not."""
        kind, arg = path
        if kind == "one":
            return self.triples.filter(F.col("p") == arg).select(F.col("s").alias("a"), F.col("o").alias("b"), F.col("o_kind").alias("k"))
        if kind == "inverse":
            return self.pairs(arg).filter("NOT startswith(k, 'literal')").select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit("iri").alias("k"))
        if kind == "or":
            return reduce(DataFrame.unionByName, [self.pairs(p) for p in arg])
        if kind == "then":
            out = self.pairs(arg[0])
            for p in arg[1:]:
                step = self.pairs(p).toDF("m", "b2", "k2")
                out = out.join(step, out["b"] == step["m"]).select("a", F.col("b2").alias("b"), F.col("k2").alias("k"))
            return out
        plus = path_closure(self.pairs(arg), "a", "b").select(F.col("descendant").alias("a"), F.col("ancestor").alias("b"), F.lit("iri").alias("k"))
        if kind == "closure+":
            return plus
        nodes = self.triples.select("s").unionByName(self.triples.filter("NOT startswith(o_kind, 'literal')").select(F.col("o").alias("s"))).distinct()
        return plus.filter("a <> b").unionByName(nodes.select(F.col("s").alias("a"), F.col("s").alias("b"), F.lit("iri").alias("k")))

    def pattern(self, subject, path, node) -> Solution:
        own = [F.col("g").alias("g")] if self.graph is not None else []
        if path[0] == "var":
            df = self.triples.select(F.col("s").alias("a"), F.col("p").alias("q"), F.col("o").alias("b"), F.col("o_kind").alias("k"), *own)
        elif own:
            if path[0] != "one":
                raise ValueError("a path within GRAPH ?g is not supported; name the graph")
            df = self.triples.filter(F.col("p") == path[1]).select(F.col("s").alias("a"), F.col("o").alias("b"), F.col("o_kind").alias("k"), *own)
        else:
            df = self.pairs(path)
        columns: list[Column] = []
        names: list[str] = []
        for (kind, value), c in ((subject, "a"), *(((path, "q"),) if path[0] == "var" else ()), (node, "b")):
            if kind != "var":
                df = df.filter(F.col(c) == str(value))
                if getattr(value, "tail", ""):
                    df = df.filter(F.col("k") == f"literal{value.tail}")
            elif value in names:
                df = df.filter(F.col(c) == F.col("a"))
            else:
                names.append(value)
                columns += [F.col(c).alias(value), (F.col("k") if c == "b" else F.when(F.col(c).startswith("_:"), "blank").otherwise("iri")).alias(KIND + value)]
        if own and self.graph not in names:
            names.append(self.graph)
            columns += [F.col("g").alias(self.graph), F.lit("iri").alias(KIND + self.graph)]
        return Solution(df.select(*columns) if columns else df.select(F.lit(1).alias("_unit")), names, set(names))

    # -- algebra --

    def join(self, left: Solution | None, right: Solution, how: str = "inner") -> Solution:
        if left is None:
            return right
        shared = [n for n in left.names if n in right.names]
        r = right.df.select(*[F.col(f"`{n}`").alias(f"r_{n}" if n in shared else n) for n in right.names], *[F.col(c) for c in right.df.columns if c.startswith(KIND) and c not in left.df.columns])
        if not right.names:
            r = right.df.select(F.lit(1).alias("_r"))
        conditions = []
        for n in shared:
            equal = left.df[n] == r[f"r_{n}"]
            conditions.append(equal if n in left.sure and n in right.sure else equal | left.df[n].isNull() | r[f"r_{n}"].isNull())
        df = left.df.join(r, reduce(lambda a, b: a & b, conditions), how) if conditions else left.df.join(r, F.lit(True), how) if how != "inner" else left.df.crossJoin(r)
        for n in shared:
            df = df.withColumn(n, F.coalesce(F.col(f"`{n}`"), F.col(f"r_{n}"))).drop(f"r_{n}")
        sure = left.sure | right.sure if how == "inner" else set(left.sure)
        return Solution(df.drop("_r"), [*left.names, *[n for n in right.names if n not in shared]], sure)

    def optional(self, left: Solution, right: Solution) -> Solution:
        return self.join(left, right, "left")

    def minus(self, left: Solution, right: Solution) -> Solution:
        shared = [n for n in left.names if n in right.names]
        if not shared:
            return left
        r = right.df.select(*[F.col(f"`{n}`").alias(f"r_{n}") for n in shared])
        return Solution(left.df.join(r, reduce(lambda a, b: a & b, [left.df[n] == r[f"r_{n}"] for n in shared]), "left_anti"), left.names, left.sure)

    def union(self, left: Solution, right: Solution) -> Solution:
        names = [*left.names, *[n for n in right.names if n not in left.names]]
        return Solution(left.df.unionByName(right.df, allowMissingColumns=True), names, left.sure & right.sure)

    # -- expressions --

    def expression(self, body: Solution) -> Column:
        out = self.conjunction(body)
        while self.skip("||"):
            out = out | self.conjunction(body)
        return out

    def conjunction(self, body: Solution) -> Column:
        out = self.relation(body)
        while self.skip("&&"):
            out = out & self.relation(body)
        return out

    def relation(self, body: Solution) -> Column:
        left = self.sum(body)
        if self.word("=", "!=", "<", ">", "<=", ">="):
            op, right = self.take(), self.sum(body)
            compare = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}[op]
            a, b = left.cast("string"), right.cast("string")
            x, y = a.try_cast("double"), b.try_cast("double")
            return F.when(x.isNotNull() & y.isNotNull(), compare(x, y)).otherwise(compare(a, b))
        if self.word("IN", "NOT"):
            without = self.skip("NOT")
            self.take("IN")
            self.take("(")
            options = []
            while not self.skip(")"):
                options.append(self.expression(body).cast("string"))
                self.skip(",")
            inside = left.cast("string").isin(*options) if options else F.lit(False)
            return ~inside if without else inside
        return left

    def sum(self, body: Solution) -> Column:
        out = self.product(body)
        while self.word("+", "-"):
            op, right = self.take(), self.product(body)
            a, b = out.cast("string").try_cast("decimal(38,6)"), right.cast("string").try_cast("decimal(38,6)")
            out = a + b if op == "+" else a - b
        return out

    def product(self, body: Solution) -> Column:
        out = self.primary(body)
        while self.word("*", "/"):
            op, right = self.take(), self.primary(body)
            a, b = out.cast("string").try_cast("double"), right.cast("string").try_cast("double")
            out = a * b if op == "*" else F.try_divide(a, b)
        return out

    def primary(self, body: Solution) -> Column:
        if self.skip("!"):
            return ~self.primary(body)
        if self.skip("("):
            out = self.expression(body)
            self.take(")")
            return out
        if self.word("NOT", "EXISTS"):
            without = self.skip("NOT")
            self.take("EXISTS")
            self.markers.append(self.holds(body))
            held = F.coalesce(F.col(f"_held{len(self.markers) - 1}"), F.lit(False))
            return ~held if without else held
        if self.kind() == "var":
            name = self.take()[1:]
            return F.col(f"`{name}`") if name in body.names else F.lit(None).cast("string")
        if self.kind() == "word" and self.peek(1) == "(" or self.kind() in ("name", "iri") and self.peek(1) == "(":
            return self.call(body)
        return F.lit(str(self.term()[1]))

    def call(self, body: Solution) -> Column:
        is_cast = self.kind() in ("name", "iri")
        name = self.take().lower()
        self.take("(")
        if name in ("count", "sum", "min", "max", "avg", "sample", "group_concat"):
            return self.aggregate(name, body)
        if name == "bound":
            column = self.expression(body)
            self.take(")")
            return column.isNotNull()
        if name in ("isiri", "isuri", "isliteral", "isblank", "lang", "datatype"):
            variable = self.take()[1:]
            self.take(")")
            kind = F.col(KIND + variable) if KIND + variable in body.df.columns else F.lit(None).cast("string")
            literal = F.startswith(kind, F.lit("literal"))
            if name == "lang":
                return F.when(literal, F.regexp_extract(kind, "^literal@(.*)$", 1))
            if name == "datatype":
                said = F.regexp_extract(kind, r"^literal\^\^(.*)$", 1)
                return F.when(literal & ~F.contains(kind, F.lit("@")), F.when(said == "", self.prefixes.get("xsd", "xsd:") + "string").otherwise(said))
            return F.regexp_extract(kind, "^[a-z]+", 0) == {"isiri": "iri", "isuri": "iri", "isliteral": "literal", "isblank": "blank"}[name]
        args = []
        while not self.skip(")"):
            args.append(self.expression(body))
            self.skip(",")
        if is_cast:
            target = re.split(r"[:#/]", name.strip("<>"))[-1]
            return args[0].cast("string").try_cast({"integer": "bigint", "int": "bigint", "float": "double", "double": "double", "decimal": "decimal(38,6)", "boolean": "boolean"}.get(target, "string"))
        text = [a.cast("string") for a in args]
        number = lambda i: args[i].cast("string").try_cast("int")
        table = {
            "str": lambda: text[0], "lcase": lambda: F.lower(text[0]), "ucase": lambda: F.upper(text[0]), "strlen": lambda: F.length(text[0]), "concat": lambda: F.concat(*text),
            "contains": lambda: F.contains(text[0], text[1]), "strstarts": lambda: F.startswith(text[0], text[1]), "strends": lambda: F.endswith(text[0], text[1]),
            "substr": lambda: F.substr(text[0], number(1), number(2)) if len(args) > 2 else F.substr(text[0], number(1)),
            "strafter": lambda: F.when(F.contains(text[0], text[1]), F.substr(text[0], F.position(text[1], text[0]) + F.length(text[1]))).otherwise(""),
            "strbefore": lambda: F.when(F.contains(text[0], text[1]), F.substr(text[0], F.lit(1), F.position(text[1], text[0]) - 1)).otherwise(""),
            "replace": lambda: F.regexp_replace(text[0], text[1], text[2]), "regex": lambda: F.regexp_like(text[0], F.concat(F.when(text[2] == "i", "(?i)").otherwise(""), text[1]) if len(args) > 2 else text[1]),
            "langmatches": lambda: F.when(text[1] == "*", text[0] != "").otherwise((F.lower(text[0]) == F.lower(text[1])) | F.startswith(F.lower(text[0]), F.concat(F.lower(text[1]), F.lit("-")))),
            "isnumeric": lambda: text[0].try_cast("double").isNotNull(), "coalesce": lambda: F.coalesce(*text), "if": lambda: F.when(args[0], text[1]).otherwise(text[2]), "year": lambda: F.substring(text[0], 1, 4).try_cast("int"), "month": lambda: F.substring(text[0], 6, 2).try_cast("int"),
            "day": lambda: F.substring(text[0], 9, 2).try_cast("int"), "abs": lambda: F.abs(text[0].try_cast("double")), "round": lambda: F.round(text[0].try_cast("double")),
        }
        if name not in table:
            raise ValueError(f"unknown function {name}")
        return table[name]()

    def aggregate(self, name: str, body: Solution) -> Column:
        distinct = self.skip("DISTINCT")
        if self.skip("*"):
            column = F.lit(1)
        else:
            column = self.expression(body)
        separator = " "
        if self.skip(";"):
            self.take("SEPARATOR")
            self.take("=")
            separator = self.term()[1]
        self.take(")")
        number = column.cast("string").try_cast("decimal(38,6)")
        made = {
            "count": lambda: F.count_distinct(column) if distinct else F.count(column), "sum": lambda: F.coalesce(F.sum_distinct(number) if distinct else F.sum(number), F.lit(0).cast("decimal(38,6)")),
            "min": lambda: F.min(column), "max": lambda: F.max(column), "avg": lambda: F.avg(number), "sample": lambda: F.min(column),
            "group_concat": lambda: F.array_join(F.array_sort(F.collect_set(column.cast("string")) if distinct else F.collect_list(column.cast("string"))), separator),
        }[name]()
        self.aggregates.append(made)
        return F.col(f"_agg{len(self.aggregates) - 1}")


def sparql(triples: DataFrame, text: str) -> DataFrame:
    """The solutions of a query over (s, p, o, o_kind, and g, o_dt and o_lang if there) as text columns, one a variable.

    CONSTRUCT and DESCRIBE give the columns of ``GRAPH`` instead.
    """
    return Compiler(triples, text).query()


def answer(triples: DataFrame, text: str, most: int = 50) -> list[dict] | str:
    """At most ``most`` solutions as dictionaries, or what is wrong with the query as a text, as callers of an endpoint expect."""
    try:
        return [r.asDict() for r in sparql(triples, text).limit(most).collect()]
    except (ValueError, IndexError) as wrong:
        return f"query error: {wrong}"
