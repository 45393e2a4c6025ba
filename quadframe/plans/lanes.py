"""Lanes: how a variable's values lie in a column, and relations of lanes."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import V, constant, is_plain, lexical, to_term
from ..terms import XSD, BNode, IRI, Literal

_numbers = itertools.count()


def fresh() -> str:
    """A column name that no other relation has."""
    return f"_q{next(_numbers)}"


@dataclass(frozen=True)
class Lane:
    """kind: key (an IRI, prefix + native key), iri, string, term (N-Triples text), or a literal kind in a
    native column. null: may be unbound. poisoned: NULL is an error, not a wildcard."""

    kind: str
    col: str
    prefix: str | None = None
    null: bool = False
    poisoned: bool = False

    def value(self) -> V:
        c = F.col(self.col)
        if self.kind == "key":
            return V("iri", F.concat(F.lit(self.prefix), c.cast("string")), (self.prefix, c))
        if self.kind == "string":
            return V("lit", c)
        return V(self.kind, c)

    def term(self) -> Column:
        return to_term(self.value())


class Rel:
    """A DataFrame and the lanes of its variables."""

    def __init__(self, df: DataFrame, lanes: dict[str, Lane], order: list[Column] | None = None):
        self.df, self.lanes, self.order = df, lanes, order or []

    def with_value(self, name: str, v: V, null: bool = True, poisoned: bool = False) -> Rel:
        lane, col = to_lane(v)
        lane = replace(lane, null=null, poisoned=poisoned)
        return Rel(self.df.withColumn(lane.col, col), self.lanes | {name: lane}, self.order)

    def pruned(self, names) -> Rel:
        lanes = {n: self.lanes[n] for n in names if n in self.lanes}
        return Rel(self.df.select(*dict.fromkeys(x.col for x in lanes.values())), lanes)

    def renamed(self) -> Rel:
        """The same rows under column names of their own."""
        new = {x.col: fresh() for x in self.lanes.values()}
        df = self.df.select(*[F.col(a).alias(b) for a, b in new.items()])
        return Rel(df, {n: replace(x, col=new[x.col]) for n, x in self.lanes.items()})

    def sorted(self) -> DataFrame:
        return self.df.orderBy(*self.order) if self.order else self.df


def to_lane(v: V) -> tuple[Lane, Column]:
    name = fresh()
    if v.kind == "iri" and v.extra:
        return Lane("key", name, v.extra[0]), v.extra[1]
    if is_plain(v):
        return Lane("string", name), v.col
    if v.kind in ("lit", "num", "bnode", "term"):
        return Lane("term", name), to_term(v)
    return Lane(v.kind, name), v.col


def alike(a: Lane, b: Lane) -> bool:
    return a.kind == b.kind and a.prefix == b.prefix


def never(a: Lane, b: Lane) -> bool:
    """No term can lie in both lanes."""
    if "term" in (a.kind, b.kind) or alike(a, b):
        return False
    resources = {"key", "iri"}
    if a.kind in resources and b.kind in resources:
        return a.kind == b.kind == "key" and not a.prefix.startswith(b.prefix) and not b.prefix.startswith(a.prefix)
    return True


def pair(a: Lane, b: Lane) -> tuple[Column, Column]:
    """Columns that are equal iff the terms are."""
    if alike(a, b):
        return F.col(a.col), F.col(b.col)
    if "term" in (a.kind, b.kind):
        return a.term(), b.term()
    return lexical(a.value()), lexical(b.value())


def is_constant(lane: Lane, t: IRI | BNode | Literal, dtype: str) -> Column:
    """The lane's value is the term t, in a form that is pushed down to the scan where it can be."""
    c = F.col(lane.col)
    if lane.kind == "term":
        return c == t.n3()
    if isinstance(t, IRI) and lane.kind == "iri":
        return c == t.value
    if isinstance(t, IRI) and lane.kind == "key" and t.value.startswith(lane.prefix):
        key = t.value[len(lane.prefix) :]
        if dtype == "string":
            return c == key
        if key.lstrip("-").isdigit() and str(int(key)) == key and abs(int(key)) < 1 << 63:
            return c == int(key)
    if isinstance(t, Literal) and (lane.kind == "string" and t.dt == XSD + "string" or t.dt == XSD + lane.kind):
        v = constant(t)
        if v.kind == lane.kind or lane.kind == "string" and is_plain(v):
            return c == v.col
        if lane.kind in ("dateTime", "date"):
            return c == F.lit(t.lex).try_cast(dtype)
    return F.lit(False)


def unify(rels: list[Rel], names: list[str]) -> list[Rel]:
    """Relations with the same columns for names, to be united; lanes that differ become terms."""
    target: dict[str, Lane] = {}
    for n in names:
        own = [r.lanes[n] for r in rels if n in r.lanes]
        null = len(own) < len(rels) or any(x.null for x in own)
        kind, prefix = (own[0].kind, own[0].prefix) if all(alike(x, own[0]) for x in own) else ("iri", None) if all(x.kind in ("key", "iri") for x in own) else ("term", None)
        target[n] = Lane(kind, fresh(), prefix, null, bool(own) and all(x.poisoned for x in own) and len(own) == len(rels))
    out = []
    for r in rels:
        cols = []
        for n, t in target.items():
            x = r.lanes.get(n)
            c = F.lit(None) if x is None else F.col(x.col) if alike(x, t) else x.term() if t.kind == "term" else lexical(x.value())
            if x is None:
                other = next((q for q in rels if n in q.lanes), None)
                c = c.cast(dict(other.df.dtypes)[other.lanes[n].col] if alike(other.lanes[n], t) else "string")
            cols.append(c.alias(t.col))
        out.append(Rel(r.df.select(*cols) if cols else r.df.select(F.lit(1).alias("_unit")), target))
    return out


def union(rels: list[Rel]) -> Rel:
    names = list(dict.fromkeys(n for r in rels for n in r.lanes))
    parts = unify(rels, names)
    df = parts[0].df
    for p in parts[1:]:
        df = df.unionByName(p.df)
    return Rel(df, parts[0].lanes)

