"""A small pattern-query front end: text to joins over a Graph.

    MATCH (a:Label {k: v})-[r:TYPE|TYPE2]->(b:Label)<-[s:T]-(c), (d:L) WHERE cond RETURN [DISTINCT] items
    [ORDER BY items] [SKIP n] [LIMIT n]

Conditions: =, <>, <, <=, >, >=, CONTAINS, STARTS WITH, ENDS WITH, IN, IS [NOT] NULL, NOT, AND, OR, parentheses. Items: properties,
count(*), count([DISTINCT] x), sum, min, max, avg, collect; items that aggregate nothing are the groups. $names are bound
parameters; user text is never part of the query. Patterns that share no variable must be tied by an equality in WHERE,
which becomes their join; a product is refused.
"""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import Graph

TOKEN = re.compile(r"\s*(?:(?P<num>\d+\.\d+|\d+)|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<par>\$\w+)|(?P<word>[A-Za-z_]\w*)|(?P<op><=|>=|<>|<-|->|[-()\[\]{}:,.|=<>*]))")
AGGREGATES = {"count", "sum", "min", "max", "avg", "collect"}


class CypherError(ValueError):
    pass


class Parser:
    def __init__(self, text: str, params: dict[str, Any]):
        self.items: list[tuple[str, str]] = []
        at, text = 0, text.strip().rstrip(";")
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise CypherError(f"cannot read: {text[at:at + 20]!r}")
            self.items.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
            while at < len(text) and text[at].isspace():
                at += 1
        self.at, self.params = 0, params
        self.nodes: dict[str, dict] = {}
        self.rels: list[dict] = []

    def peek(self, k: int = 0) -> str:
        return self.items[self.at + k][1] if self.at + k < len(self.items) else ""

    def word(self, *names: str) -> bool:
        """Takes these key words if they come next."""
        if all(self.peek(i).upper() == n for i, n in enumerate(names)):
            self.at += len(names)
            return True
        return False

    def take(self, what: str | None = None) -> str:
        got = self.peek()
        if what is not None and got != what or not got:
            raise CypherError(f"expected {what or 'more'}, found {got or 'the end'}")
        self.at += 1
        return got

    def value(self) -> Any:
        kind, text = self.items[self.at]
        self.at += 1
        if kind == "num":
            return float(text) if "." in text else int(text)
        if kind == "str":
            return re.sub(r"\\(.)", r"\1", text[1:-1])
        if kind == "par":
            if text[1:] not in self.params:
                raise CypherError(f"no value for {text}")
            return self.params[text[1:]]
        if text.lower() in ("true", "false", "null"):
            return {"true": True, "false": False, "null": None}[text.lower()]
        raise CypherError(f"expected a value, found {text}")

    # --- patterns
    def node(self) -> str:
        self.take("(")
        name = self.take() if self.peek() not in (":", ")", "{") else f"_n{len(self.nodes)}"
        got = self.nodes.setdefault(name, {"labels": [], "props": {}})
        while self.peek() in (":", "|"):
            self.take()
            got["labels"].append(self.take())
        if self.peek() == "{":
            self.take("{")
            while self.peek() != "}":
                key = self.take()
                self.take(":")
                got["props"][key] = self.value()
                if self.peek() == ",":
                    self.take()
            self.take("}")
        self.take(")")
        return name

    def pattern(self) -> None:
        left = self.node()
        while self.peek() in ("-", "<-"):
            back = self.take() == "<-"
            name, types = f"_r{len(self.rels)}", []
            if self.peek() == "[":
                self.take("[")
                if self.peek() not in (":", "]"):
                    name = self.take()
                while self.peek() in (":", "|"):
                    self.take()
                    types.append(self.take())
                self.take("]")
            end = self.take()
            if back == (end == "->") or end not in ("-", "->"):
                raise CypherError("relationships need one direction")
            right = self.node()
            self.rels.append({"name": name, "types": types, "src": right if back else left, "dst": left if back else right})
            left = right

    # --- expressions, as functions of a name resolver
    def term(self):
        if self.peek() == "(":
            self.take("(")
            inner = self.either()
            self.take(")")
            return inner
        kind, text = self.items[self.at] if self.at < len(self.items) else ("", "")
        if kind == "word" and self.peek(1) == ".":
            var, _, prop = self.take(), self.take("."), self.take()
            return lambda r: r(var, prop)
        if kind == "word" and text.lower() not in ("true", "false", "null"):
            self.at += 1
            return lambda r: r(text, None)
        v = self.value()
        return lambda r: F.lit(v)

    def compare(self):
        if self.word("NOT"):
            inner = self.compare()
            return lambda r: ~inner(r)
        left = self.term()
        if self.word("IS", "NOT", "NULL"):
            return lambda r: left(r).isNotNull()
        if self.word("IS", "NULL"):
            return lambda r: left(r).isNull()
        if self.word("IN"):
            if self.peek() == "[":
                self.take("[")
                values = []
                while self.peek() != "]":
                    values.append(self.value())
                    if self.peek() == ",":
                        self.take()
                self.take("]")
            else:
                values = list(self.value())
            return lambda r: left(r).isin(values)
        for names, method in ((("CONTAINS",), "contains"), (("STARTS", "WITH"), "startswith"), (("ENDS", "WITH"), "endswith")):
            if self.word(*names):
                right = self.term()
                return lambda r, m=method: getattr(left(r), m)(right(r))
        ops = {"=": "__eq__", "<>": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}
        if self.peek() in ops:
            op = ops[self.take()]
            right = self.term()
            made = lambda r: getattr(left(r), op)(right(r))
            made.sides = (left, right) if op == "__eq__" else None
            return made
        return left

    def both(self):
        parts = [self.compare()]
        while self.word("AND"):
            parts.append(self.compare())
        if len(parts) == 1:
            return parts[0]
        made = lambda r: _fold(parts, r, "__and__")
        made.parts = parts
        return made

    def either(self):
        parts = [self.both()]
        while self.word("OR"):
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else lambda r: _fold(parts, r, "__or__")

    def item(self):
        """(aggregate or None, distinct, expression, name)."""
        begin = self.at
        agg, distinct, expr = None, False, None
        if self.peek().lower() in AGGREGATES and self.peek(1) == "(":
            agg = self.take().lower()
            self.take("(")
            distinct = self.word("DISTINCT")
            if self.peek() == "*":
                self.take()
            else:
                expr = self.term()
            self.take(")")
        else:
            expr = self.term()
        name = "".join(t for _, t in self.items[begin : self.at])
        if self.word("AS"):
            name = self.take()
        return agg, distinct, expr, name


def _fold(parts, r, op: str) -> Column:
    out = parts[0](r)
    for p in parts[1:]:
        out = getattr(out, op)(p(r))
    return out


def run(g: Graph, text: str, params: dict[str, Any] | None = None) -> DataFrame:
    p = Parser(text, params or {})
    where: list = []
    if not p.word("MATCH"):
        raise CypherError("a query begins with MATCH")
    while True:
        p.pattern()
        while p.peek() == ",":
            p.take()
            p.pattern()
        if p.word("WHERE"):
            cond = p.either()
            where += getattr(cond, "parts", [cond])
        if not p.word("MATCH"):
            break
    if not p.word("RETURN"):
        raise CypherError("a query needs RETURN")
    distinct = p.word("DISTINCT")
    items = [p.item()]
    while p.peek() == ",":
        p.take()
        items.append(p.item())
    orders: list = []
    if p.word("ORDER", "BY"):
        while True:
            orders.append((p.item(), p.word("DESC") or (p.word("ASC") and False)))
            if p.peek() != ",":
                break
            p.take()
    skip = p.value() if p.word("SKIP") else 0
    limit = p.value() if p.word("LIMIT") else None
    if p.peek():
        raise CypherError(f"unexpected {p.peek()}")

    kinds = {name: "node" for name in p.nodes} | {r["name"]: "rel" for r in p.rels}

    def resolve(var: str, prop: str | None) -> Column:
        if var not in kinds:
            raise CypherError(f"unknown variable {var}")
        if prop is None:
            prop = "id" if kinds[var] == "node" else "type"
        return F.col(f"{var}__{prop}")

    def names_of(cond) -> set[str]:
        seen: set[str] = set()
        cond(lambda v, q: (seen.add(v), resolve(v, q))[1])
        return seen

    tables: dict[str, DataFrame] = {}
    for name, n in p.nodes.items():
        t = g.nodes
        if n["labels"]:
            t = t.filter(F.col("label").isin(n["labels"]))
        for k, v in n["props"].items():
            t = t.filter(F.col(k) == F.lit(v))
        tables[name] = t.select(*(F.col(c).alias(f"{name}__{c}") for c in t.columns))
    for r in p.rels:
        t = g.edges.filter(F.col("type").isin(r["types"])) if r["types"] else g.edges
        tables[r["name"]] = t.select(*(F.col(c).alias(f"{r['name']}__{c}") for c in t.columns))
    # conditions on one variable go to its table
    rest = []
    for cond in where:
        seen = names_of(cond)
        if len(seen) == 1 and next(iter(seen)) in tables:
            v = next(iter(seen))
            tables[v] = tables[v].filter(cond(resolve))
        else:
            rest.append(cond)

    done: set[str] = set()
    out: DataFrame | None = None

    def add(name: str, on: Column | None) -> None:
        nonlocal out
        out = tables[name] if out is None else out.join(tables[name], on)
        done.add(name)

    todo = list(p.rels)
    while todo or set(p.nodes) - done:
        rel = next((r for r in todo if out is None or r["src"] in done or r["dst"] in done), None)
        if rel is not None:
            todo.remove(rel)
            ends = [(rel["src"], "sourceId"), (rel["dst"], "targetId")]
            on = None
            for v, side in ends:
                if v in done:
                    eq = F.col(f"{rel['name']}__{side}") == F.col(f"{v}__id")
                    on = eq if on is None else on & eq
            add(rel["name"], on)
            for v, side in ends:
                if v not in done:
                    add(v, F.col(f"{rel['name']}__{side}") == F.col(f"{v}__id"))
            continue
        free = sorted(set(p.nodes) - done, key=list(p.nodes).index)
        if out is None:
            add(free[0], None)
            continue
        for v in [*free, *(r["name"] for r in todo)]:
            ties = [x for x in rest if getattr(x, "sides", None) and v in names_of(x) and names_of(x) <= done | {v} and len(names_of(x)) > 1]
            if ties:
                add(v, _fold(ties, resolve, "__and__"))
                rest = [x for x in rest if x not in ties]
                break
        else:
            raise CypherError("these patterns have nothing in common; tie them in WHERE")
    for cond in rest:
        out = out.filter(cond(resolve))

    def aggregate(agg: str, dist: bool, expr) -> Column:
        if expr is None:
            return F.count(F.lit(1))
        col = expr(resolve)
        if agg == "count":
            return F.count_distinct(col) if dist else F.count(col)
        if agg == "collect":
            return F.array_sort(F.collect_set(col) if dist else F.collect_list(col))
        return {"sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg}[agg](col)

    if any(i[0] for i in items):
        keys = [i[2](resolve).alias(i[3]) for i in items if not i[0]]
        out = out.groupBy(*keys).agg(*(aggregate(a, d, e).alias(n) for a, d, e, n in items if a)).select(*(F.col(f"`{i[3]}`") for i in items))
        sort = lambda i: F.col(f"`{i[3]}`")
    else:
        by = {i[3] for i in items}
        extra = [(k, o[0]) for k, o in enumerate(orders) if o[0][3] not in by]
        out = out.select(*(i[2](resolve).alias(i[3]) for i in items), *(o[2](resolve).alias(f"__o{k}") for k, o in extra if not distinct))
        at = {id(o): f"__o{k}" for k, o in extra}
        sort = lambda i: F.col(at[id(i)]) if id(i) in at else F.col(f"`{i[3]}`")
    if distinct:
        out = out.distinct()
    if orders:
        out = out.orderBy(*(sort(i).desc() if desc else sort(i).asc() for i, desc in orders))
    if skip:
        out = out.offset(skip)
    if limit is not None:
        out = out.limit(limit)
    return out.select(*(F.col(f"`{i[3]}`") for i in items))
